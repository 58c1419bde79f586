"""Tests of a suite from files, and ingest of run documents that can be repeated safely."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a table of tests that are no variables.
RESERVED = ("id", "description", "threshold", "cache_salt", "expect_fail", "tags", "__assert", "__history")


def read_tests_table(spark: SparkSession, path: str, separator: str = ",", default_id: str | None = None) -> DataFrame:
    """Tests from CSV or TSV in the file's order (place): id, description, tags, threshold, cache_salt, expect_fail and its
    reason, asserts and history (JSON texts, or history's file:// path), vars (map of all other columns). With default_id, a test without an
    id column is called <default_id>/<place>."""
    raw = spark.read.csv(path, header=True, sep=separator, multiLine=True, escape='"')
    own = [c for c in raw.columns if c not in RESERVED]
    raw = raw.coalesce(1).withColumn("__place", F.monotonically_increasing_id().cast("int"))  # one file, whose order counts
    text = lambda name: F.col(f"`{name}`") if name in raw.columns else F.lit(None).cast("string")
    tags = F.filter(F.transform(F.split(text("tags"), ","), lambda x: F.trim(x)), lambda x: x != "")
    flag = F.coalesce(F.trim(text("expect_fail")), F.lit(""))
    plain = F.lower(flag).isin("", "true", "false")
    variables = F.map_from_arrays(F.array(*[F.lit(c) for c in own]), F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in own])) if own else F.create_map().cast("map<string,string>")
    place = F.col("__place")
    named = text("id") if default_id is None else F.coalesce(text("id"), F.concat(F.lit(f"{default_id}/"), place.cast("string")))
    return raw.select(
        named.alias("test_id"),
        text("description").alias("description"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        F.expr("try_cast(trim(threshold) as double)").alias("threshold") if "threshold" in raw.columns else F.lit(None).cast("double").alias("threshold"),
        text("cache_salt").alias("cache_salt"),
        (~F.lower(flag).isin("", "false")).alias("expect_fail"),
        F.when(~plain, flag).alias("expect_fail_reason"),
        F.nullif(F.trim(text("__assert")), F.lit("")).alias("asserts"),
        F.nullif(F.trim(text("__history")), F.lit("")).alias("history"),
        variables.alias("vars"),
        place.alias("place"),
    )


def read_tests_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Tests from an array, from an object with `tests`, or (lines) one a line; blank lines are skipped."""
    raw = spark.read.json(path, multiLine=not lines)
    return raw.select(F.explode("tests").alias("t")).select("t.*") if "tests" in raw.columns else raw


def judged_uploads(stored: DataFrame, uploads: DataFrame) -> DataFrame:
    """run_id and outcome of uploads (run_id, content_hash): created, existing (same content) or conflict. Repeated rows in
    one batch count once; of two contents for a new id, the lesser hash is created."""
    one = Window.partitionBy("run_id").orderBy("content_hash")
    fresh = uploads.select("run_id", "content_hash").distinct()
    there = stored.select("run_id", F.col("content_hash").alias("_stored")).distinct()
    both = fresh.join(there, "run_id", "left").withColumn("_nth", F.row_number().over(one))
    same = F.when(F.col("_stored").isNull() & (F.col("_nth") == 1), "created")
    return both.select("run_id", "content_hash", same.when(F.col("_stored") == F.col("content_hash"), "existing").otherwise("conflict").alias("outcome"))


def first_cases(cases: DataFrame) -> DataFrame:
    """The first row of each case of a run (by idx)."""
    order = Window.partitionBy("run_id", "case_key").orderBy("idx")
    return cases.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def run_tags(runs: DataFrame) -> DataFrame:
    """One row per run and distinct tag."""
    return runs.select("run_id", F.explode("tags").alias("tag")).distinct()
