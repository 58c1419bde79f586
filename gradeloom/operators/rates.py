"""Rates of models from a table: a model's own row, then that of its name without a date, then the longest family that its name begins with.

Each distinct model is spread over the names that may have a row (its name, the dateless one, and each beginning of its name), which meet the table in an equi-join,
so thousands of families cost no comparison of every model with every family. What a model finds is kept as one list with the time each row holds for, and
calls meet that list by their model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import scalars


def candidates(models: DataFrame, rates: DataFrame, values: tuple[str, ...], prefixes: tuple[str, ...]) -> DataFrame:
    """Distinct models with `_found`: an array of what their names have in the table, the closest first, then what began to hold latest."""
    name = scalars.bare_model(F.col("_model"), prefixes)
    named = models.withColumn("_name", name)
    dateless = F.regexp_extract("_name", r"(?s)^(.*)-(?:[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})$", 1)
    lengths = F.when(F.length("_name") > 0, F.sequence(F.lit(1), F.length("_name"))).otherwise(F.array().cast("array<int>"))
    exact = F.array(F.struct(F.lit(False).alias("family"), F.col("_name").alias("name"), F.lit(-2).alias("rank")), F.struct(F.lit(False).alias("family"), dateless.alias("name"), F.lit(-1).alias("rank")))
    begun = F.transform(lengths, lambda n: F.struct(F.lit(True).alias("family"), F.substring("_name", F.lit(1), n).alias("name"), (F.lit(1_000_000) - n).alias("rank")))
    asked = named.select("_model", F.explode(F.concat(exact, begun)).alias("c")).select("_model", "c.*").where("name <> '' OR rank = -2")
    own = rates.select("name", F.coalesce("family", F.lit(False)).alias("family"), "valid_from", "valid_to", F.struct(*values).alias("_values"))
    met = asked.join(own, ["family", "name"])
    order = F.struct("rank", (-F.coalesce("valid_from", F.lit(-(1 << 62)))).alias("late"), F.col("valid_from").alias("begins"), F.col("valid_to").alias("ends"), F.col("_values").alias("values"))
    return met.groupBy("_model").agg(F.array_sort(F.collect_list(order)).alias("_found"))


def rated(calls: DataFrame, rates: DataFrame, model: str, at: Column | None = None, values: tuple[str, ...] = scalars.RATES, prefixes: tuple[str, ...] = scalars.VENDOR_PREFIXES) -> DataFrame:
    """calls with the columns `values` of the closest row of rates (name, family: whether all models that begin so have it, valid_from and valid_to in the
    unit of `at`: from is included, to is not, null is no bound, and values); null where there is none. Of rows equally close, the one
    that began to hold latest counts, among those that hold at the time of the call; without `at` all hold. A null model has no rate."""
    models = calls.select(F.col(model).alias("_model")).where("_model IS NOT NULL").distinct()
    found = candidates(models, rates, values, prefixes)
    met = calls.join(found, F.col(model) == F.col("_model"), "left")
    holds = F.lit(True) if at is None else None
    when = F.lit(None) if at is None else at

    def valid(x: Column) -> Column:
        if holds is not None:
            return holds
        return (x["begins"].isNull() | (x["begins"] <= when)) & (x["ends"].isNull() | (x["ends"] > when))

    taken = F.get(F.filter("_found", valid), F.lit(0))["values"]
    return met.select(*[f"`{c}`" for c in calls.columns], *[taken[v].alias(v) for v in values])
