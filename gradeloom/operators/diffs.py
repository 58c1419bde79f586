"""Differences of two runs beyond their statuses: assertions, configurations, JSON documents, lines of outputs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import json_checks, scalars
from gradeloom.functions import statistics as st


def document_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """Two run documents' cases side by side: the head's in its order, then those of the base alone in its order. Texts that are
    null and empty are alike."""
    side = lambda df, name: df.select("case_key", *[F.col(c).alias(f"{name}_{c}") for c in ("idx", "status", "score", "output_text")])
    both = side(base, "base").join(side(head, "head"), "case_key", "full_outer")
    delta = st.document_delta(F.col("base_status"), F.col("head_status"))
    joined = F.col("base_status").isNotNull() & F.col("head_status").isNotNull()
    text = lambda name: F.coalesce(f"{name}_output_text", F.lit(""))
    return both.withColumns({"delta": delta, "joined": joined, "output_changed": joined & (text("base") != text("head"))}).orderBy(F.col("head_idx").asc_nulls_last(), "base_idx")


def in_scope(scope: str) -> Column:
    """Which rows of document_diff() show their lines: regressions, changed, all or none."""
    return F.col("joined") & {"regressions": F.col("delta") == "newly_failing", "changed": F.col("output_changed"), "all": F.lit(True), "none": F.lit(False)}[scope]


def kept_deltas(compared: DataFrame, wanted: list[str], limit: int, *order: str) -> tuple[DataFrame, DataFrame]:
    """The first `limit` rows of the wanted deltas, and one row with how many rows that leaves out."""
    fits = F.coalesce(F.col("delta").isin(*wanted), F.lit(False))
    omitted = compared.agg((F.count(F.lit(1)) - F.least(F.count_if(fits), F.lit(max(0, limit)))).alias("omitted"))
    return compared.where(fits).orderBy(*order).limit(max(0, limit)), omitted


def assert_flips(base: Column, head: Column) -> Column:
    """Assertions (arrays of kind, passed, score) that passed on one side alone. They are paired by place if both sides have the
    same kinds in order, else by kinds that each side has once, in the base's order."""
    kinds = lambda side: F.transform(side, lambda a: a["kind"])
    once = lambda side, kind: F.size(F.filter(side, lambda a: a["kind"] == kind)) == 1
    pair = lambda b, h: F.struct(b["kind"].alias("kind"), b["passed"].alias("base_passed"), h["passed"].alias("head_passed"), b["score"].alias("base_score"), h["score"].alias("head_score"))
    by_place = F.zip_with(base, head, pair)
    alone = F.filter(base, lambda b: once(base, b["kind"]) & once(head, b["kind"]))
    by_kind = F.transform(alone, lambda b: pair(b, F.get(F.filter(head, lambda h: h["kind"] == b["kind"]), F.lit(0))))
    return F.filter(F.when(kinds(base) == kinds(head), by_place).otherwise(by_kind), lambda p: p["base_passed"] != p["head_passed"])


def config_drift(base: DataFrame, head: DataFrame, *by: str) -> DataFrame:
    """For each pair of runs (joined on `by`) and part of the configuration: both digests, and whether it changed (null:
    unknown). The whole configuration is the part `config`."""
    parts = ("config", *scalars.COMPONENTS)
    side = lambda df, name: df.select(*by, *[scalars.known(F.col(f"{p}_digest")).alias(f"{name}_{p}") for p in parts])
    both = side(base, "base").join(side(head, "head"), list(by))
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("component"), F.col(f"base_{p}").alias("base"), F.col(f"head_{p}").alias("head")) for p in parts]))
    return both.select(*by, rows.alias("r")).select(*by, "r.*").withColumn("changed", F.col("base") != F.col("head"))


def json_diff(before: DataFrame, after: DataFrame, key: str, document: str) -> DataFrame:
    """For each key the dotted paths whose leaves were added, removed or changed between two JSON documents."""
    side = lambda df, name: df.select(key, F.explode(json_checks.leaves(F.col(document))).alias("l")).select(key, "l.path", F.col("l.leaf").alias(name))
    both = side(before, "before").join(side(after, "after"), [key, "path"], "full_outer")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return both.withColumn("kind", kind).where("kind is not null")


def clamped(text: str, most_bytes: int, most_lines: int) -> str:
    short = text.encode()[:most_bytes].decode(errors="ignore") if len(text.encode()) > most_bytes else text
    lines = short.splitlines()
    return text if short == text and len(lines) <= most_lines else "\n".join(lines[:most_lines])


def line_diff(base: Column, head: Column, *, context: int = 3, most_bytes: int = 65_536, most_lines: int = 400) -> Column:
    """Unified diff of two texts as an array of lines (hunk heads included; null counts as empty), each side cut to the limits
    first. Only rows that show a diff should get here."""

    @F.pandas_udf("array<string>")
    def diff(bases: pd.Series, heads: pd.Series) -> pd.Series:
        out = []
        for b, h in zip(bases.fillna(""), heads.fillna(""), strict=True):
            b, h = (clamped(x, most_bytes, most_lines).splitlines() for x in (b, h))
            out.append([x for k, x in enumerate(difflib.unified_diff(b, h, lineterm="", n=context)) if k > 1])
        return pd.Series(out)

    return diff(base, head)


def attribution(base: DataFrame, head: DataFrame, *by: str) -> DataFrame:
    """Why each case changed between two sets of runs; cases of one side alone are unknown."""
    parts = ("prompt", "provider", "asserts", "grader")
    side = lambda df, name: df.select(*by, *[F.col(f"{p}_digest").alias(f"{name}_{p}") for p in parts], F.col("output_text").alias(f"{name}_text"), F.col("status").alias(f"{name}_status"))
    both = side(base, "b").join(side(head, "h"), list(by), "full_outer")
    digests = lambda n: {p: scalars.known(F.col(f"{n}_{p}")) for p in parts}
    moved = scalars.what_moved(digests("b"), digests("h"), ~F.col("b_text").eqNullSafe(F.col("h_text")), F.col("b_status") != F.col("h_status"))
    return both.select(*by, F.when(F.col("b_status").isNull() | F.col("h_status").isNull(), "unknown").otherwise(moved).alias("change"))


def newest_pairs(runs: DataFrame, base: int = 3, head: int = 2) -> tuple[DataFrame, DataFrame]:
    """Each suite's base-th and head-th newest run."""
    newest = Window.partitionBy("project", "suite").orderBy(F.desc("created_at"), F.desc("run_id"))
    ranked = runs.withColumn("_n", F.row_number().over(newest))
    return ranked.where(F.col("_n") == base).drop("_n"), ranked.where(F.col("_n") == head).drop("_n")
