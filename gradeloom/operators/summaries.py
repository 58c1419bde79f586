"""Summaries of runs from their cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pass", "fail", "error", "skip", "xfail", "xpass")


def summarise(cases: DataFrame, *by: str) -> DataFrame:
    """One row for each run (or other group): cases by status, tokens (those read from a provider's cache count as sent), costs,
    what the cache saved, graders' costs, hits, misses, retries and graded cases that a fallback answered. Costs are null
    where none is known, savings where there are none. Sums are whole micro-dollars, so their order doesn't matter."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    cached = F.coalesce(F.col("cached"), F.lit(False))
    priced = F.greatest(F.col("cost_microusd"), F.when(F.col("cost_microusd").isNotNull(), F.lit(0)))
    sent = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("cache_read_tokens", F.lit(0))
    return cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[n(F.col("status") == s).alias(f"n_{s}") for s in STATUSES],
        F.sum(sent).alias("prompt_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("completion_tokens"),
        F.sum(F.coalesce("cache_read_tokens", F.lit(0))).alias("cache_read_tokens"),
        F.sum(priced).alias("cost_microusd"),
        F.nullif(F.sum(F.when(cached, priced)), F.lit(0)).alias("cache_savings_microusd"),
        F.sum("grader_cost_microusd").alias("grader_cost_microusd"),
        n(cached).alias("cache_hits"),
        n(~cached).alias("cache_misses"),
        n(~cached & (F.col("attempts") > 1)).alias("retried_cases"),
        n((F.col("status") != "skip") & (F.col("answered_by") != "")).alias("fallback_cases"),
    )


def empty_counts(cases: DataFrame, *by: str) -> DataFrame:
    """Cases by empty reason, for groups that have any; `` means not empty and isn't counted."""
    return cases.where(F.col("empty_reason") != "").groupBy(*by, "empty_reason").agg(F.count(F.lit(1)).alias("n"))


def empty_map(cases: DataFrame, *by: str) -> DataFrame:
    """The same as one map for each group, in order of the reasons."""
    entries = F.array_sort(F.collect_list(F.struct("empty_reason", "n")))
    return empty_counts(cases, *by).groupBy(*by).agg(F.map_from_entries(entries).alias("empty_counts"))


def grader_cost(asserts: Column) -> Column:
    """Sum of the assertions' costs (array of cost_microusd and more); null if none has one."""
    costs = F.filter(F.transform(asserts, lambda a: a["cost_microusd"]), lambda c: c.isNotNull())
    return F.when(F.size(costs) > 0, F.aggregate(costs, F.lit(0).cast("long"), lambda s, c: s + c))


def assert_labels(cases: DataFrame, *by: str) -> DataFrame:
    """Distinct labels of the assertions (an array asserts with label), in order."""
    return cases.select(*by, F.explode("asserts").alias("a")).groupBy(*by).agg(F.array_sort(F.collect_set("a.label")).alias("labels"))


def graded_fallbacks(cases: DataFrame, *by: str) -> DataFrame:
    """Graded cases, and how many of them a fallback answered."""
    graded = F.col("status") != "skip"
    return cases.groupBy(*by).agg(F.count_if(graded).alias("graded"), F.count_if(graded & F.coalesce(F.col("answered_by") != "", F.lit(False))).alias("fell_back"))


def backfilled(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """runs with empty_count and fallback_count filled from their cases where they are unknown."""
    counted = cases.groupBy("run_id").agg(F.count_if(F.coalesce(F.col("empty_reason") != "", F.lit(False))).alias("_empty"), F.count_if(F.coalesce(F.col("answered_by") != "", F.lit(False))).alias("_fallback"))
    both = runs.join(counted, "run_id", "left")
    fill = lambda c, own: F.coalesce(c, own, F.lit(0))
    return both.withColumns({"empty_count": fill("empty_count", "_empty"), "fallback_count": fill("fallback_count", "_fallback")}).drop("_empty", "_fallback")


def ci_summary(summary: DataFrame, regressed: DataFrame, *by: str) -> DataFrame:
    """One row for each group with the values that a CI job hands on as text: counts, rates in percent, costs in dollars."""
    percent = lambda n, d: F.format_string("%.1f", F.coalesce(F.try_divide(n * 100.0, d), F.lit(0.0)))
    usd_or_none = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.6f", F.col(c) / 1e6))
    out = summary.join(regressed, list(by), "left")
    n = lambda c: F.col(c).cast("string")
    return out.select(
        *by,
        n("n_pass").alias("passed"),
        n("n_fail").alias("failed"),
        n("n_error").alias("errored"),
        (F.col("n_fail") + F.col("n_error")).cast("string").alias("failed_or_errored"),
        n("total").alias("total"),
        percent(F.col("n_pass"), F.col("total")).alias("pass_rate"),
        percent(F.col("cache_hits"), F.col("cache_hits") + F.col("cache_misses")).alias("cache_hit_rate"),
        n("fallback_cases").alias("fallback_cases"),
        usd_or_none("cost_microusd").alias("cost_usd"),
        usd_or_none("cache_savings_microusd").alias("cache_savings_usd"),
        F.coalesce(F.col("regressed"), F.lit(0)).cast("string").alias("regressed"),
    )


def outputs_text(row: dict) -> str:
    """Lines name=value of one row of ci_summary(); line breaks in values become blanks."""
    return "".join(f"{k.replace('_', '-')}={str(v).translate({10: ' ', 13: ' '})}\n" for k, v in row.items())
