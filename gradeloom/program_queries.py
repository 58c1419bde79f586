"""Registered queries whose rows go through an external program, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.plans import views as v
from gradeloom.queries import WITH
from gradeloom.sources import programs

#: A program of all three kinds. It crashes, says what is no JSON, or tells an error on some requests.
SOURCE = """
import json, os, sys
for line in sys.stdin:
    asked = json.loads(line)
    kind = asked["suite"]["kind"]
    if kind == "provider":
        n = asked["vars"]["n"]
        if n % 4999 == 0:
            sys.stderr.write("gone")
            os._exit(3)
        if n % 4001 == 0:
            print("oops", flush=True)
            continue
        told = {"output": asked["prompt"][::-1], "usage": {"input_tokens": len(asked["prompt"]), "output_tokens": n % 7}, "cost_usd": n / 8, "model": "reverse"}
        if n % 13 == 0:
            told = {"error": {"message": "busy", "class": "provider_rate_limit"}}
    elif kind == "assert":
        told = {"pass": (asked["output"] or "").endswith(asked["config"]["end"]), "reason": asked["vars"]["test"]}
        if asked["output"] is None:
            told = {"error": {"message": "nothing to check"}}
    else:
        told = {"tests": [{"id": "%s-%d" % (asked["config"]["id"], k), "vars": {"k": k}, "tags": ["even" if k % 2 == 0 else "odd"]} for k in range(asked["config"]["n"])]}
    print(json.dumps(told), flush=True)
"""
PROGRAM = programs.Program(("python:", "-c", SOURCE))


def program_answers(spark: SparkSession, d: str) -> DataFrame:
    """What a provider answers for each order."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    request = F.to_json(F.struct(F.col("o_orderpriority").alias("prompt"), F.struct(F.col("o_orderkey").alias("n")).alias("vars")))
    told = programs.answers(orders.select("o_orderkey", request.alias("request")), PROGRAM)
    return told.select("o_orderkey", "output", "model", "cost_usd", "input_tokens", "output_tokens", "error", "error_class")


PROGRAM_ANSWERS = """WITH a AS (SELECT *, CASE WHEN o_orderkey % 4999 = 0 THEN 'exec_failed' WHEN o_orderkey % 4001 = 0 THEN 'provider_protocol' WHEN o_orderkey % 13 = 0 THEN 'provider_rate_limit' END AS error_class FROM orders)
SELECT o_orderkey, error_class, CASE error_class WHEN 'exec_failed' THEN 'ended with 3: gone' WHEN 'provider_protocol' THEN 'no JSON: oops' WHEN 'provider_rate_limit' THEN 'busy' END AS error,
  CASE WHEN error_class IS NULL THEN reverse(o_orderpriority) END AS output, CASE WHEN error_class IS NULL THEN 'reverse' END AS model, CASE WHEN error_class IS NULL THEN o_orderkey / 8 END AS cost_usd,
  CASE WHEN error_class IS NULL THEN length(o_orderpriority) END::BIGINT AS input_tokens, CASE WHEN error_class IS NULL THEN o_orderkey % 7 END::BIGINT AS output_tokens FROM a"""


def program_checks(spark: SparkSession, d: str) -> DataFrame:
    """What a checker says of each case."""
    given = v.cases(spark, d).select("run_id", "case_key", "output_text", F.to_json(F.struct(F.col("test_id").alias("test"))).alias("vars"), F.lit('{"end": "3"}').alias("config"))
    return programs.checks(given, PROGRAM).select("run_id", "case_key", "check_passed", "check_score", "check_reason")


PROGRAM_CHECKS = f"""{WITH} SELECT run_id, case_key, ends_with(output_text, '3') AS check_passed, ends_with(output_text, '3')::INT::DOUBLE AS check_score,
  CASE WHEN output_text IS NULL THEN 'nothing to check' ELSE test_id END AS check_reason FROM cases"""


def program_tests(spark: SparkSession, d: str) -> DataFrame:
    """Tests that a generator makes for each part, where the part's row is."""
    parts = spark.read.parquet(f"{d}/part.parquet")
    given = F.to_json(F.struct(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 4).alias("n")))
    made = programs.tests_udtf(PROGRAM, {"tags": ["made"], "vars": {"size": 1}})
    return parts.select("p_partkey", given.alias("given")).lateralJoin(made(F.col("given").outer())).select("p_partkey", "test_id", "vars", F.array_join("tags", ",").alias("tags"))


PROGRAM_TESTS = """SELECT p_partkey, p_partkey || '-' || k AS test_id, '{"k": ' || k || ', "size": 1}' AS vars, 'made,' || CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END AS tags
FROM part, (VALUES (0), (1), (2)) t(k) WHERE k < p_partkey % 4"""

_Q = {
    "program_answers": (program_answers, PROGRAM_ANSWERS),
    "program_checks": (program_checks, PROGRAM_CHECKS),
    "program_tests": (program_tests, PROGRAM_TESTS),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _Q.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _Q.items()}
