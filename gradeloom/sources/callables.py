"""Functions of a suite by name: providers, checkers and generators. They run in tasks, over batches of rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import templates
from gradeloom.sources import suite_files


class Registry:
    """Names and functions. A provider takes a request (dict) and returns a dict with output and, if it likes, stop_reason, usage
    and cost_usd; a checker takes (output, vars) and returns a bool or a dict with pass, score and reason; a generator takes
    nothing and returns a list of tests. Functions travel to the tasks, so they hold no connections."""

    def __init__(self):
        self.providers: dict[str, Callable] = {}
        self.checkers: dict[str, Callable] = {}
        self.generators: dict[str, Callable] = {}
        self.filters: dict[str, Callable] = dict(templates.FILTERS)

    def provider(self, name: str):
        return lambda f: self.providers.setdefault(name, f)

    def checker(self, name: str):
        return lambda f: self.checkers.setdefault(name, f)

    def generator(self, name: str):
        return lambda f: self.generators.setdefault(name, f)

    def filter(self, name: str):
        """Adds a function of columns that templates' pipelines can name."""
        return lambda f: self.filters.setdefault(name, f)

    def filtered(self, column, *steps: tuple):
        """A column through filters: ("truncate", 10), ("slugify",), ..."""
        for name, *given in steps:
            column = self.filters[name](column, *given)
        return column

    def answers(self, requests: DataFrame, provider: str) -> DataFrame:
        """requests (with a column request, JSON text) with output, stop_reason, cost_usd, error and error_class. A provider that
        raises an error gives the class exec_failed."""
        call = self.providers[provider]

        def one(text):
            try:
                got = call(json.loads(text))
                output = got.get("output")
                return output if output is None or isinstance(output, str) else json.dumps(output), got.get("stop_reason"), got.get("cost_usd"), None, None
            except Exception as e:  # whatever the function raises is its answer
                return None, None, None, str(e) or type(e).__name__, "exec_failed"

        @F.pandas_udf("output string, stop_reason string, cost_usd double, error string, error_class string")
        def called(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield pd.DataFrame([one(t) for t in texts], columns=["output", "stop_reason", "cost_usd", "error", "error_class"])

        return requests.withColumn("_answer", called("request")).select(*[f"`{c}`" for c in requests.columns], "_answer.*")

    def checks(self, cases: DataFrame, checker: str) -> DataFrame:
        """cases (output_text, vars as JSON text) with check_passed, check_score and check_reason; passed is null where the checker
        raised an error, which leaves the assertion without a verdict."""
        call = self.checkers[checker]

        def one(output, variables):
            try:
                got = call(output, json.loads(variables) if variables else {})
                got = got if isinstance(got, dict) else {"pass": bool(got)}
                return bool(got["pass"]), float(got.get("score", got["pass"])), got.get("reason")
            except Exception as e:  # whatever the function raises is its answer
                return None, None, str(e) or type(e).__name__

        @F.pandas_udf("check_passed boolean, check_score double, check_reason string")
        def called(outputs: pd.Series, variables: pd.Series) -> pd.DataFrame:
            rows = [one(o, v) for o, v in zip(outputs, variables, strict=True)]
            return pd.DataFrame(rows, columns=["check_passed", "check_score", "check_reason"]).astype({"check_passed": object})

        return cases.withColumn("_check", called("output_text", "vars")).select(*[f"`{c}`" for c in cases.columns], "_check.*")

    def tests(self, spark: SparkSession, generator: str, defaults: dict | None = None) -> DataFrame:
        """Tests that a generator makes, with the suite's defaults."""
        return suite_files.generated(spark, self.generators[generator], defaults)
