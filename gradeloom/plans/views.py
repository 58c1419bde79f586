"""Runs, cases and cache entries derived from the star-schema tables, in SQL that several engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.plans.store import materialised

CASES = """
SELECT run_id, project, suite, created_at, case_key, idx, provider_id, prompt_id, test_id, repeat_idx, status, score, cost_microusd, latency_ms, output_text, cached, branch, ci, error_class,
  name, input_tokens, output_tokens, cache_read_tokens, stop_reason, empty_reason, answered_by, cache_key, attempts, tag_text, prompt_digest, provider_digest, assert_digest, grader_cost_microusd
FROM (
  SELECT concat(o_orderpriority, '|s', cast(o_custkey % 4 AS STRING), '|', cast(year(o_orderdate) AS STRING), 'q', cast(quarter(o_orderdate) AS STRING)) AS run_id,
    o_orderpriority AS project, concat('s', cast(o_custkey % 4 AS STRING)) AS suite,
    cast((year(o_orderdate) * 4 + quarter(o_orderdate)) AS BIGINT) * 7776000000 AS created_at,
    concat('p', cast(l_suppkey % 3 AS STRING), '/', l_linestatus, '/t', cast(l_partkey % 12 AS STRING), '#', l_returnflag) AS case_key,
    l_orderkey * 10 + l_linenumber AS idx,
    concat('p', cast(l_suppkey % 3 AS STRING)) AS provider_id, l_linestatus AS prompt_id, concat('t', cast(l_partkey % 12 AS STRING)) AS test_id,
    CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS repeat_idx,
    CASE WHEN (l_partkey + l_linenumber) % 20 < 13 THEN 'pass' WHEN (l_partkey + l_linenumber) % 20 < 16 THEN 'fail' WHEN (l_partkey + l_linenumber) % 20 = 16 THEN 'error'
         WHEN (l_partkey + l_linenumber) % 20 = 17 THEN 'skip' WHEN (l_partkey + l_linenumber) % 20 = 18 THEN 'xfail' ELSE 'xpass' END AS status,
    CASE WHEN (l_partkey + l_linenumber) % 20 = 17 THEN NULL ELSE 1 - l_discount END AS score,
    CASE WHEN l_quantity < 3 THEN NULL ELSE cast(round(l_extendedprice * 100) AS BIGINT) * 100 END AS cost_microusd,
    cast(l_quantity * 10 AS BIGINT) AS latency_ms,
    CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE concat('out ', cast(l_partkey % 5 AS STRING)) END AS output_text,
    CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_linenumber % 3 = 0 END AS cached,
    CASE WHEN quarter(o_orderdate) % 2 = 0 THEN 'main' WHEN year(o_orderdate) % 2 = 0 THEN NULL ELSE 'feature' END AS branch,
    CASE WHEN year(o_orderdate) % 3 = 0 THEN NULL ELSE 'ci' END AS ci,
    CASE WHEN (l_partkey + l_linenumber) % 20 <> 16 THEN NULL WHEN l_suppkey % 4 = 0 THEN '' WHEN l_suppkey % 4 = 1 THEN 'provider_timeout' WHEN l_suppkey % 4 = 2 THEN 'grader_failed' ELSE 'render_failed' END AS error_class,
    CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE concat('Case T', cast(l_partkey % 12 AS STRING), ' of ', l_linestatus) END AS name,
    CASE WHEN l_quantity < 2 THEN NULL ELSE cast(l_quantity AS BIGINT) * 3 END AS input_tokens, cast(l_linenumber AS BIGINT) * 5 AS output_tokens,
    CASE WHEN l_suppkey % 5 = 0 THEN cast(l_linenumber AS BIGINT) * 7 ELSE NULL END AS cache_read_tokens,
    CASE l_linenumber % 4 WHEN 0 THEN 'max_tokens' WHEN 1 THEN 'end_turn' WHEN 2 THEN 'refusal' ELSE NULL END AS stop_reason,
    CASE WHEN l_partkey % 17 <> 0 THEN '' WHEN l_suppkey % 2 = 0 THEN 'refusal' WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'blank' END AS empty_reason,
    CASE WHEN l_partkey % 23 <> 0 THEN '' WHEN l_suppkey % 7 = 0 THEN NULL ELSE concat('p', cast((l_suppkey + 1) % 3 AS STRING)) END AS answered_by,
    concat('k', cast(l_partkey % 500 AS STRING)) AS cache_key, cast(1 + l_linenumber % 3 AS BIGINT) AS attempts,
    concat('t', cast(l_suppkey % 4 AS STRING), ',', CASE WHEN l_partkey % 2 = 0 THEN 'even' ELSE 'odd' END) AS tag_text,
    CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE concat('a', cast(l_orderkey % 10 AS STRING)) END AS prompt_digest, concat('b', cast(l_suppkey % 3 AS STRING)) AS provider_digest,
    CASE WHEN l_partkey % 29 = 0 THEN '' ELSE concat('c', cast(l_partkey % 2 AS STRING)) END AS assert_digest,
    CASE WHEN l_partkey % 3 = 0 THEN cast(l_linenumber AS BIGINT) * 1000 ELSE NULL END AS grader_cost_microusd,
    row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 4, year(o_orderdate), quarter(o_orderdate), l_suppkey % 3, l_linestatus, l_partkey % 12, l_returnflag
      ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS lines
WHERE nth = 1
"""

RUNS = """
SELECT run_id, project, suite, created_at, branch, ci, case_count, pass_count, fail_count, error_count, xfail_count, xpass_count, cost_microusd,
  CASE WHEN slot % 11 = 0 THEN NULL ELSE cache_hits END AS cache_hits, CASE WHEN slot % 11 = 0 THEN NULL ELSE cache_misses END AS cache_misses,
  prompt_tokens, completion_tokens, empty_count, fallback_count, slot % 4 * 1000 + 500 AS duration_ms,
  CASE WHEN slot % 3 = 0 THEN NULL WHEN slot % 3 = 1 THEN 'mira' ELSE 'tove' END AS actor, CASE WHEN slot % 2 = 0 THEN 'tove' ELSE 'robot' END AS uploaded_by,
  CASE WHEN slot % 7 = 0 THEN NULL ELSE concat('c', cast(slot % 5 AS STRING)) END AS git_commit,
  CASE WHEN slot % 5 = 0 THEN '' WHEN slot % 6 = 0 THEN NULL ELSE concat('d', cast(slot % 2 AS STRING)) END AS config_digest,
  concat('e', cast(slot % 2 AS STRING)) AS prompts_digest, CASE WHEN slot % 4 = 0 THEN '' ELSE concat('f', cast(slot % 3 AS STRING)) END AS providers_digest, 'g' AS tests_digest,
  CASE WHEN slot % 6 = 0 THEN NULL ELSE concat('h', cast(slot % 3 AS STRING)) END AS asserts_digest, 'i' AS grader_digest,
  CASE WHEN slot % 3 = 0 THEN 'nightly,slow' WHEN slot % 3 = 1 THEN 'nightly' ELSE '' END AS tag_text
FROM (
  SELECT run_id, min(project) AS project, min(suite) AS suite, min(created_at) AS created_at, cast(min(created_at) / 7776000000 AS BIGINT) AS slot, min(branch) AS branch, min(ci) AS ci, count(*) AS case_count,
    sum(CASE WHEN status = 'pass' THEN 1 ELSE 0 END) AS pass_count, sum(CASE WHEN status = 'fail' THEN 1 ELSE 0 END) AS fail_count, sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS error_count,
    sum(CASE WHEN status = 'xfail' THEN 1 ELSE 0 END) AS xfail_count, sum(CASE WHEN status = 'xpass' THEN 1 ELSE 0 END) AS xpass_count, sum(cost_microusd) AS cost_microusd,
    sum(CASE WHEN cached THEN 1 ELSE 0 END) AS cache_hits, sum(CASE WHEN cached THEN 0 ELSE 1 END) AS cache_misses,
    sum(coalesce(input_tokens, 0) + coalesce(cache_read_tokens, 0)) AS prompt_tokens, sum(output_tokens) AS completion_tokens,
    sum(CASE WHEN empty_reason <> '' THEN 1 ELSE 0 END) AS empty_count, sum(CASE WHEN answered_by <> '' THEN 1 ELSE 0 END) AS fallback_count
  FROM cases GROUP BY run_id) AS sums
"""

CACHE = """
SELECT event_id AS entry_key, cast(floor(abs(value) * 100) AS BIGINT) + 1 AS size, event_id * 60000 AS created_at, (event_id * 7919 % 100003) * 60000 AS last_access_at, event_type AS kind,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE concat('m', cast(user_id % 12 AS STRING)) END AS model, CASE WHEN event_id % 9 = 0 THEN NULL ELSE cast(round(abs(value) * 100) AS BIGINT) * 100 END AS cost_microusd,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id % 50 END AS input_tokens, event_id % 40 AS output_tokens,
  CASE WHEN event_id % 10 = 0 THEN 'refusal' WHEN event_id % 10 = 1 THEN 'blank' ELSE '' END AS empty_reason,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE event_id * 60000 + 5 END AS indexed_at, event_id % 37 <> 0 AS index_ok,
  concat('POST ', event_type, ' u', cast(user_id % 20 AS STRING)) AS request_summary, concat('answer ', cast(event_id % 100 AS STRING)) AS output_preview
FROM events
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        tables(spark, sf_dir, "lineitem", "orders")
        return spark.sql(CASES)

    return materialised(spark, sf_dir, "cases", build)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        cases(spark, sf_dir).createOrReplaceTempView("cases")
        return spark.sql(RUNS)

    return materialised(spark, sf_dir, "runs", build)


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir, "events")
    return spark.sql(CACHE)


def tagged(df: DataFrame) -> DataFrame:
    """With tags, an array, in place of tag_text."""
    return df.withColumn("tags", F.filter(F.split("tag_text", ","), lambda t: t != "")).drop("tag_text")


#: Pins of suites to a run or a branch (project, suite, run_id, branch, set_at).
PINS = [
    ("1-URGENT", "s0", "1-URGENT|s0|1996q2", None, 1),
    ("1-URGENT", "s1", None, "main", 2),
    ("2-HIGH", "s0", "2-HIGH|s0|1995q1", None, 3),
    ("5-LOW", "s3", "no-such-run", None, 4),
]
PIN = "project string, suite string, run_id string, branch string, set_at long"


def pins(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PINS, PIN)


def pins_sql() -> str:
    quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"
    rows = ", ".join("(" + ", ".join(map(quoted, p)) + ")" for p in PINS)
    return f"SELECT * FROM (VALUES {rows}) AS p(project, suite, run_id, branch, set_at)"
