"""Registered queries on results: names, Spark callables and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import statistics as st
from gradeloom.operators import results as r
from gradeloom.plans import views as v

#: SQL that the oracle texts share.
WITH = f"WITH cases AS ({v.CASES}), runs AS ({v.RUNS}), pins AS ({v.pins_sql()})"
NOW = (2002 * 4) * 7776000000
WINDOW = 4 * 7776000000
GOOD, BAD = "('pass', 'xpass')", "('fail', 'error')"
NEWEST = "row_number() OVER (PARTITION BY project, suite ORDER BY created_at DESC, run_id DESC)"
HISTORY = "PARTITION BY project, suite, case_key ORDER BY created_at, run_id"
PAIR = f"""{WITH}, ranked AS (SELECT run_id, {NEWEST} AS nth FROM runs),
b AS (SELECT c.* FROM cases c JOIN ranked USING (run_id) WHERE nth = 3), h AS (SELECT c.* FROM cases c JOIN ranked USING (run_id) WHERE nth = 2),
cmp AS (SELECT coalesce(b.project, h.project) AS project, coalesce(b.suite, h.suite) AS suite, coalesce(b.case_key, h.case_key) AS case_key, b.status AS base_status, h.status AS head_status,
  CASE WHEN b.status IS NULL THEN 'added' WHEN h.status IS NULL THEN 'removed' WHEN b.status IN {GOOD} AND h.status IN {BAD} THEN 'newly_failing' WHEN b.status IN {BAD} AND h.status IN {GOOD} THEN 'newly_passing'
       WHEN b.status IN {BAD} AND h.status IN {BAD} THEN 'still_failing' WHEN b.status IN {GOOD} AND h.status IN {GOOD} THEN 'still_passing' ELSE 'unchanged' END AS delta,
  b.status IS NOT NULL AND h.status IS NOT NULL AND b.output_text IS DISTINCT FROM h.output_text AS output_changed, h.score - b.score AS score_delta
  FROM b FULL JOIN h ON b.project = h.project AND b.suite = h.suite AND b.case_key = h.case_key)"""
RUN_COLUMNS = (
    "run_id", "project", "suite", "created_at", "branch", "ci", "case_count", "pass_count", "fail_count", "error_count", "xfail_count", "xpass_count", "cost_microusd",
)


def wilson_sql(s: str, n: str) -> str:
    z = st.Z95
    mid = f"({s} / {n}::DOUBLE + {z * z} / (2 * {n})) / (1 + {z * z} / {n})"
    half = f"{z} * sqrt({s} / {n}::DOUBLE * (1 - {s} / {n}::DOUBLE) / {n} + {z * z} / (4.0 * {n} * {n})) / (1 + {z * z} / {n})"
    return f"CASE WHEN {n} > 0 THEN greatest(0.0, {mid} - {half}) ELSE 0.0 END AS wilson_low, CASE WHEN {n} > 0 THEN least(1.0, {mid} + {half}) ELSE 0.0 END AS wilson_high"


def pair(spark: SparkSession, d: str) -> DataFrame:
    return r.last_pairs(v.cases(spark, d), v.runs(spark, d))


MC = "CASE WHEN newly_failing + newly_passing > 0 THEN greatest(abs(newly_failing - newly_passing) - 1.0, 0.0) ^ 2 / (newly_failing + newly_passing) ELSE 0.0 END"
COUNTS = ", ".join(f"count(*) FILTER (WHERE delta = '{x}') AS {x}" for x in ("newly_failing", "newly_passing", "still_failing", "still_passing", "unchanged", "added", "removed"))
STATUS_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS n_{x}" for x in (*r.GRADED, "skip"))


def compare_cases(spark, d):
    return pair(spark, d).select("project", "suite", "case_key", "base_status", "head_status", "delta", "output_changed", F.round("score_delta", 6).alias("score_delta"))


COMPARE_CASES = f"""{PAIR}
SELECT project, suite, case_key, base_status, head_status, delta, output_changed, round(score_delta, 6) AS score_delta FROM cmp"""


def compare_latest_by_suite(spark, d):
    return r.compare_summary(pair(spark, d), "project", "suite")


COMPARE_SUMMARY = f"""{PAIR}, s AS (SELECT project, suite, {COUNTS}, count(*) FILTER (WHERE output_changed) AS output_changed, count(*) FILTER (WHERE head_status IN {GOOD}) AS head_pass,
count(*) FILTER (WHERE head_status IN ('pass', 'fail', 'error', 'xfail', 'xpass')) AS head_graded FROM cmp GROUP BY project, suite)
SELECT *, {wilson_sql("head_pass", "head_graded")}, {MC} AS mcnemar, {MC} > 3.841 AS significant FROM s"""


def document_delta_tally(spark, d):
    return pair(spark, d).groupBy(st.document_delta(F.col("base_status"), F.col("head_status")).alias("delta")).agg(F.count(F.lit(1)).alias("n"))


DOCUMENT_DELTA = f"""CASE WHEN base_status IS NULL THEN 'added' WHEN head_status IS NULL THEN 'removed' WHEN base_status IN {GOOD} AND head_status NOT IN {GOOD} THEN 'newly_failing'
  WHEN base_status NOT IN {GOOD} AND head_status IN {GOOD} THEN 'newly_passing' WHEN base_status NOT IN {GOOD} THEN 'still_failing' ELSE 'unchanged' END"""
DELTA_TALLY = f"{PAIR} SELECT {DOCUMENT_DELTA} AS delta, count(*) AS n FROM cmp GROUP BY 1"


def latest_runs(spark, d):
    return r.latest_runs(v.runs(spark, d)).select(*RUN_COLUMNS)


LATEST_RUNS = f"{WITH} SELECT {', '.join(RUN_COLUMNS)} FROM (SELECT *, {NEWEST} AS nth FROM runs) WHERE nth = 1"


def matrix_cells(spark, d):
    return r.matrix(v.cases(spark, d))


MATRIX_CELLS = f"""{WITH} SELECT run_id, test_id, provider_id, prompt_id, count(*) AS total, {STATUS_COUNTS}, avg(score) AS score_mean, avg(latency_ms) AS latency_mean,
  sum(cost_microusd)::BIGINT AS cost_microusd, count(DISTINCT output_text) AS distinct_outputs, count(*) FILTER (WHERE status = 'pass') / count(*) AS pass_fraction,
  count(*) FILTER (WHERE answered_by <> '' AND status <> 'skip') AS fallback_answered, string_agg(case_key, ',' ORDER BY repeat_idx, idx) AS case_keys FROM cases GROUP BY run_id, test_id, provider_id, prompt_id"""


def matrix_rows(spark, d):
    return r.matrix_rows(v.cases(spark, d))


MATRIX_ROWS = f"""{WITH}, m AS (SELECT run_id, test_id, min(idx) AS first_idx, arg_min(name, (idx, case_key)) FILTER (WHERE name IS NOT NULL) AS name FROM cases GROUP BY run_id, test_id)
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY first_idx, test_id) AS place FROM m"""
ONE_RUN = "1-URGENT|s0|1996q2"


def matrix_page(spark, d):
    return r.matrix_page(r.matrix_rows(v.cases(spark, d).where(F.col("run_id") == ONE_RUN)), 4, 100).select("test_id", "first_idx")


MATRIX_PAGE = f"""{WITH} SELECT test_id, first_idx FROM (SELECT test_id, min(idx) AS first_idx FROM cases WHERE run_id = '{ONE_RUN}' GROUP BY test_id)
WHERE first_idx > 100 ORDER BY first_idx, test_id LIMIT 5"""


def suite_rollup(spark, d):
    return r.suite_rollup(v.runs(spark, d))


SUITE_ROLLUP = f"""{WITH}, s AS (SELECT project, suite, count(*) AS run_count, max(created_at) AS last_run_at, sum(pass_count)::BIGINT AS passed, sum(case_count)::BIGINT AS n_cases,
  sum(cost_microusd)::BIGINT AS cost_microusd FROM runs GROUP BY project, suite) SELECT *, {wilson_sql("passed", "n_cases")} FROM s"""


def sparkline(spark, d):
    return r.sparkline(v.runs(spark, d))


SPARKLINE = f"""{WITH} SELECT project, suite, run_id, nth AS place, CASE WHEN case_count > 0 THEN pass_count / case_count ELSE 0.0 END AS pass_rate
FROM (SELECT *, {NEWEST} AS nth FROM runs) WHERE nth <= 20"""


def case_history(spark, d):
    return r.history(v.cases(spark, d))


CASE_HISTORY = f"""{WITH}, p AS (SELECT *, row_number() OVER w AS place FROM cases WINDOW w AS (PARTITION BY project, suite, case_key ORDER BY created_at DESC, run_id DESC))
SELECT project, suite, case_key, run_id, place, status, output_text <> lead(output_text) OVER (PARTITION BY project, suite, case_key ORDER BY place) AS output_changed FROM (SELECT * FROM p WHERE place <= 20)"""


def cached_islands(spark, d):
    return r.cached_islands(v.cases(spark, d))


CACHED_ISLANDS = f"""{WITH}, m AS (SELECT *, coalesce(cached, false) AS flag FROM cases),
i AS (SELECT *, row_number() OVER ({HISTORY}) AS nth, row_number() OVER ({HISTORY}) - row_number() OVER (PARTITION BY project, suite, case_key, flag ORDER BY created_at, run_id) AS island FROM m),
k AS (SELECT *, flag AND count(*) OVER (PARTITION BY project, suite, case_key, flag, island) >= 2 AS collapsed FROM i)
SELECT project, suite, case_key, collapsed, count(*) AS points, min(created_at) AS first_at, max(created_at) AS last_at FROM k
GROUP BY project, suite, case_key, collapsed, flag, island, CASE WHEN NOT collapsed THEN nth END"""


def provider_costs(spark, d):
    return r.provider_costs(v.cases(spark, d))


PROVIDER_COSTS = f"""{WITH} SELECT run_id, coalesce(nullif(answered_by, ''), provider_id) AS provider_id, count(*) AS n_cases, sum(cost_microusd)::BIGINT AS cost_microusd FROM cases GROUP BY 1, 2"""


def error_tally(spark, d):
    return r.error_tally(v.cases(spark, d))


ERROR_TALLY = f"""{WITH}, t AS (SELECT project, coalesce(nullif(error_class, ''), 'unknown') AS error_class, count(*) AS n FROM cases WHERE status = 'error' GROUP BY 1, 2)
SELECT *, n / sum(n) OVER (PARTITION BY project) AS share FROM t"""


def pass_at_2(spark, d):
    return r.pass_at_k(v.cases(spark, d), 2)


PASS_AT_2 = f"""{WITH}, g AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE status = 'pass') AS c FROM cases GROUP BY run_id, provider_id, prompt_id, test_id),
p AS (SELECT *, CASE WHEN n <= 2 THEN (c > 0)::INT::DOUBLE WHEN n - c < 2 THEN 1.0 ELSE 1 - (n - c) / n::DOUBLE * (n - c - 1) / (n - 1) END AS p FROM g)
SELECT run_id, count(*) AS n_groups, CASE WHEN max(n) > 1 THEN avg(p) END AS pass_at_k FROM p GROUP BY run_id"""


def branch_composite(spark, d):
    return r.composite(v.cases(spark, d), v.runs(spark, d)).select("project", "suite", "case_key", "run_id", "status", "rank")


MERGED = f"""near AS (SELECT run_id, {NEWEST} AS rank FROM runs WHERE branch = 'main'),
n AS (SELECT c.project, c.suite, case_key, c.run_id, status, rank, row_number() OVER (PARTITION BY c.project, c.suite, case_key ORDER BY rank, idx) AS nth FROM cases c JOIN near USING (run_id) WHERE rank <= 20)"""
COMPOSITE = f"{WITH}, {MERGED} SELECT * EXCLUDE (nth) FROM n WHERE nth = 1"


def composite_summaries(spark, d):
    runs = v.runs(spark, d)
    return r.composite_summary(r.composite(v.cases(spark, d), runs), runs)


COMPOSITE_SUMMARY = f"""{WITH}, {MERGED}, one AS (SELECT * FROM n WHERE nth = 1), who AS (SELECT DISTINCT project, suite, run_id, rank FROM one),
b AS (SELECT project, suite, count(*) AS on_branch FROM runs WHERE branch = 'main' GROUP BY project, suite),
w AS (SELECT project, suite, string_agg(run_id, ',' ORDER BY rank) AS contributors, arg_min(run_id, rank) AS skeleton, max(rank) AS last FROM who GROUP BY project, suite)
SELECT project, suite, count(*) AS case_count, count(*) FILTER (WHERE status = 'pass') AS pass_count, any_value(contributors) AS contributors, any_value(skeleton) AS skeleton, any_value(last = 20 AND on_branch > 20) AS truncated
FROM one JOIN w USING (project, suite) JOIN b USING (project, suite) GROUP BY project, suite"""


def expired_runs(spark, d):
    return r.expired_runs(v.runs(spark, d), NOW, WINDOW, v.pins(spark))


EXPIRED = f"""{WITH}, x AS (SELECT run_id, created_at, rank() OVER (PARTITION BY project, suite, branch ORDER BY created_at DESC) = 1 AS newest FROM runs),
e AS (SELECT run_id, newest OR run_id IN (SELECT run_id FROM pins WHERE run_id IS NOT NULL) AS kept FROM x WHERE created_at < {NOW - WINDOW})"""


def retention_counts(spark, d):
    return r.swept(expired_runs(spark, d))


def cases_after_retention(spark, d):
    kept = r.without_runs(v.cases(spark, d), expired_runs(spark, d).where("not kept"))
    return kept.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


def lru_eviction(spark, d):
    return r.evict_lru(v.cache_entries(spark, d), 20_000_00)


LRU = f"""WITH c AS ({v.CACHE}), e AS (SELECT *, sum(size) OVER () - (sum(size) OVER (ORDER BY last_access_at, entry_key ROWS UNBOUNDED PRECEDING) - size) AS left_ FROM c)
SELECT entry_key, size, last_access_at FROM e WHERE left_ > 2000000"""


def _facets(column: str):
    return lambda spark, d: r.facets(v.cache_entries(spark, d), column)


def _facets_sql(column: str) -> str:
    return f"WITH c AS ({v.CACHE}) SELECT {column} AS value, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, value LIMIT 100"


def cache_page_by_size(spark, d):
    return r.page(v.cache_entries(spark, d).select("entry_key", "size", "kind"), "size", "entry_key", 50, (5_000, 0))


CACHE_PAGE = f"WITH c AS ({v.CACHE}) SELECT entry_key, size, kind FROM c WHERE size < 5000 OR (size = 5000 AND entry_key < 0) ORDER BY size DESC, entry_key DESC LIMIT 51"


def runs_page(spark, d):
    return r.page(v.runs(spark, d).select("run_id", "created_at", "case_count"), "created_at", "run_id", 50)


RUNS_PAGE = f"{WITH} SELECT run_id, created_at, case_count FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 51"


def runs_not_cached(spark, d):
    runs = v.runs(spark, d)
    return runs.where(~r.hidden_by_cache(runs)).select("run_id")


NOT_CACHED = f"{WITH} SELECT run_id FROM runs WHERE (cache_misses = 0 AND cache_hits > 0) IS NOT TRUE"


def stale_suites(spark, d):
    return r.stale_suites(v.runs(spark, d), NOW)


STALE = f"""{WITH}, g AS (SELECT *, created_at - lag(created_at) OVER (PARTITION BY project, suite ORDER BY created_at, run_id) AS gap FROM runs WHERE ci IS NOT NULL),
b AS (SELECT project, suite, count(*) AS ci_runs, max(created_at) AS newest, median(gap) AS median_gap FROM g GROUP BY project, suite)
SELECT *, ci_runs >= 2 AND coalesce({NOW} - newest > greatest(3 * median_gap, 86400000.0), false) AS stale FROM b"""


def gate_exit_codes(spark, d):
    compared = pair(spark, d).withColumn("group", F.concat_ws("/", "project", "suite"))
    cases = v.cases(spark, d).join(r.latest_runs(v.runs(spark, d), 2).select("run_id"), "run_id", "left_semi")
    return r.gate(compared, cases.withColumn("group", F.concat_ws("/", "project", "suite")), by="group")


GATE = f"""{PAIR}, k AS (SELECT project, suite, max(CASE WHEN status <> 'error' THEN 0 WHEN error_class IN ('grader_missing', 'render_failed', 'assert_failed', 'checker_failed') THEN 2 ELSE 3 END) AS fault,
  count(*) FILTER (WHERE status IN ('fail', 'xpass')) AS failing, count(*) FILTER (WHERE status <> 'skip') AS graded, count(*) FILTER (WHERE status <> 'skip' AND answered_by <> '') AS fell_back FROM h GROUP BY project, suite),
g AS (SELECT project, suite, count(*) FILTER (WHERE base_status IN {GOOD} AND head_status NOT IN {GOOD}) AS regressed FROM cmp GROUP BY project, suite)
SELECT project || '/' || suite AS "group", CASE WHEN fault > 0 THEN fault WHEN graded = 0 OR fell_back = graded THEN 2 WHEN failing > 0 OR coalesce(regressed, 0) > 0 THEN 1 ELSE 0 END AS exit_code, failing, coalesce(regressed, 0) AS regressed
FROM k LEFT JOIN g USING (project, suite)"""


def similar_to_first(spark, d):
    vectors = spark.read.parquet(f"{d}/embeddings.parquet")
    first = F.broadcast(vectors.where("vec_id = 0").select(F.col("embedding").alias("q")))  # one row
    return vectors.join(first, F.lit(True)).select("vec_id", F.round(st.cosine(F.col("embedding"), F.col("q")), 5).alias("cosine"))


SIMILAR = """SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS cosine
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"""

_Q = {
    "compare_cases": (compare_cases, COMPARE_CASES),
    "compare_latest_by_suite": (compare_latest_by_suite, COMPARE_SUMMARY),
    "document_delta_tally": (document_delta_tally, DELTA_TALLY),
    "latest_runs": (latest_runs, LATEST_RUNS),
    "matrix_cells": (matrix_cells, MATRIX_CELLS),
    "matrix_rows": (matrix_rows, MATRIX_ROWS),
    "matrix_page": (matrix_page, MATRIX_PAGE),
    "suite_rollup": (suite_rollup, SUITE_ROLLUP),
    "sparkline": (sparkline, SPARKLINE),
    "case_history": (case_history, CASE_HISTORY),
    "cached_islands": (cached_islands, CACHED_ISLANDS),
    "provider_costs": (provider_costs, PROVIDER_COSTS),
    "error_tally": (error_tally, ERROR_TALLY),
    "pass_at_2": (pass_at_2, PASS_AT_2),
    "branch_composite": (branch_composite, COMPOSITE),
    "composite_summaries": (composite_summaries, COMPOSITE_SUMMARY),
    "expired_runs": (expired_runs, f"{EXPIRED} SELECT * FROM e"),
    "retention_counts": (retention_counts, f"{EXPIRED} SELECT count(*) FILTER (WHERE NOT kept) AS deleted, count(*) FILTER (WHERE kept) AS kept FROM e"),
    "cases_after_retention": (cases_after_retention, f"{EXPIRED} SELECT run_id, count(*) AS n FROM cases WHERE run_id NOT IN (SELECT run_id FROM e WHERE NOT kept) GROUP BY run_id"),
    "lru_eviction": (lru_eviction, LRU),
    "cache_facets_kind": (_facets("kind"), _facets_sql("kind")),
    "cache_facets_model": (_facets("model"), _facets_sql("model")),
    "cache_page_by_size": (cache_page_by_size, CACHE_PAGE),
    "runs_page": (runs_page, RUNS_PAGE),
    "runs_not_cached": (runs_not_cached, NOT_CACHED),
    "stale_suites": (stale_suites, STALE),
    "gate_exit_codes": (gate_exit_codes, GATE),
    "similar_to_first": (similar_to_first, SIMILAR),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _Q.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _Q.items()}
