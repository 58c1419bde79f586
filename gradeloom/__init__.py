"""Analytics of evaluation results on Spark."""
