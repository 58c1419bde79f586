"""Registered queries that start from run documents (JSON), on composites as runs, digests of components, JSON changes, pins and suggestions; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import json_checks as jc
from gradeloom.functions import scalars as sc
from gradeloom.list_queries import STATUS_COUNTS
from gradeloom.operators import baselines, diffs, suites, summaries
from gradeloom.operators import results as r
from gradeloom.plans import store
from gradeloom.plans import views as v
from gradeloom.queries import MERGED, WITH
from gradeloom.sources import documents as dc
from gradeloom.sources import ingest


def _written(spark: SparkSession, d: str, path: str) -> None:
    """Runs with their cases as JSON documents, one a line. Some have no project, and runs of different suites end at one moment."""
    c = F.col
    grader = c("grader_cost_microusd")
    asserts = F.array(
        F.struct(F.lit("contains").alias("kind"), c("status"), c("score"), (grader / 2_000_000).alias("cost_usd")),
        F.struct(F.when(c("idx") % 2 == 0, "cost").otherwise("latency").alias("kind"), F.lit("pass").alias("status"), F.lit(1.0).alias("score"), (grader / 2_000_000).alias("cost_usd")),
    )
    case = F.struct(
        c("idx").alias("_place"), "case_key", "name", F.struct("provider_id", "prompt_id", "test_id", c("repeat_idx").alias("repeat")).alias("cell"), "status", "score", c("output_text").alias("output"), asserts.alias("asserts"),
        F.struct("input_tokens", "output_tokens", "cache_read_tokens").alias("usage"), (c("cost_microusd") / 1_000_000).alias("cost_usd"), "latency_ms", "attempts", "stop_reason", "cached", "cache_key", "error_class",
        "empty_reason", c("answered_by").alias("answered_by_provider_id"), "prompt_digest", "provider_digest", "assert_digest", F.split("tag_text", ",").alias("tags"),
    )
    cases = v.cases(spark, d).select("run_id", case.alias("c")).groupBy("run_id").agg(F.array_sort(F.collect_list("c")).alias("cases"))
    runs = v.runs(spark, d).join(cases, "run_id")
    ended = F.timestamp_millis("created_at")
    run = runs.select(
        "run_id", F.lit(4).alias("schema_version"), F.when(c("project") != "4-NOT SPECIFIED", c("project")).alias("project"), "suite", F.timestamp_millis(c("created_at") - c("duration_ms")).alias("started_at"), ended.alias("finished_at"),
        "config_digest", F.struct(c("prompts_digest").alias("prompts"), c("providers_digest").alias("providers")).alias("digests"), F.struct(c("branch"), c("git_commit").alias("commit")).alias("git"),
        F.struct("actor", F.when(c("suite") == "s1", "  ").otherwise(c("run_id")).alias("note")).alias("origin"), F.struct(F.filter(F.split("tag_text", ","), lambda t: t != "").alias("tags")).alias("filters"), "cases",
    )
    run.select(F.to_json(F.struct(*run.columns)).alias("value")).write.text(path)


def run_documents(spark: SparkSession, d: str) -> DataFrame:
    path = store.written(spark, d, "run-documents", lambda path: _written(spark, d, path))
    return dc.accepted(spark.read.schema(dc.RUN).json(path))


def document_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = dc.case_rows(run_documents(spark, d))
    return rows.select(
        "run_id", "project", "created_at", "case_key", "idx", "name", "provider_id", "repeat_idx", "status", "score", "input_tokens", "cache_read_tokens", "cost_microusd", "grader_cost_microusd", "attempts", "cached", "empty_reason",
        "answered_by", "error_class", F.array_join("tags", "+").alias("tag_text"), F.coalesce(F.substring("output_hash", 1, 8), F.lit("")).alias("hash"),
    )


DOCUMENT_CASES = f"""{WITH} SELECT run_id, nullif(project, '4-NOT SPECIFIED') AS project, created_at, case_key, row_number() OVER (PARTITION BY run_id ORDER BY idx, case_key) - 1 AS idx, name, provider_id, repeat_idx, status, score, input_tokens,
  cache_read_tokens, cost_microusd, 2 * round(grader_cost_microusd / 2.0)::BIGINT AS grader_cost_microusd, attempts, cached, coalesce(empty_reason, '') AS empty_reason, coalesce(answered_by, '') AS answered_by, error_class,
  replace(tag_text, ',', '+') AS tag_text, coalesce(left(sha256(output_text), 8), '') AS hash FROM cases"""


def document_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = dc.run_rows(run_documents(spark, d))
    return rows.select("run_id", "project", "suite", "created_at", "duration_ms", "branch", "git_commit", "actor", "description", "config_digest", "prompts_digest", F.array_join("tags", ",").alias("tag_text"), "case_count")


DOCUMENT_RUNS = f"""{WITH} SELECT run_id, nullif(project, '4-NOT SPECIFIED') AS project, suite, created_at, duration_ms::BIGINT AS duration_ms, branch, git_commit, actor, CASE WHEN suite <> 's1' THEN run_id END AS description, config_digest,
  prompts_digest, tag_text, case_count FROM runs"""


def document_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Sums over the documents' cases, with the labels of their assertions and their empty answers."""
    rows = dc.case_rows(run_documents(spark, d))
    labels = summaries.assert_labels(rows, "run_id").select("run_id", F.array_join("labels", ",").alias("labels"))
    empty = summaries.empty_map(rows, "run_id").select("run_id", F.coalesce(F.element_at("empty_counts", "blank"), F.lit(0)).alias("blank"))
    return summaries.summarise(rows, "run_id").join(labels, "run_id").join(empty, "run_id", "left")


DOCUMENT_SUMMARIES = f"""{WITH}, e AS (SELECT run_id, count(*) FILTER (WHERE empty_reason = 'blank') AS blank FROM cases WHERE empty_reason <> '' GROUP BY run_id),
s AS (SELECT run_id, count(*) AS total, {STATUS_COUNTS}, sum(coalesce(input_tokens, 0) + coalesce(cache_read_tokens, 0))::BIGINT AS prompt_tokens, sum(output_tokens)::BIGINT AS completion_tokens,
  sum(coalesce(cache_read_tokens, 0))::BIGINT AS cache_read_tokens, sum(cost_microusd)::BIGINT AS cost_microusd, nullif(sum(cost_microusd) FILTER (WHERE cached), 0)::BIGINT AS cache_savings_microusd,
  sum(2 * round(grader_cost_microusd / 2.0))::BIGINT AS grader_cost_microusd, count(*) FILTER (WHERE cached) AS cache_hits, count(*) FILTER (WHERE cached IS NOT TRUE) AS cache_misses,
  count(*) FILTER (WHERE cached IS NOT TRUE AND attempts > 1) AS retried_cases, count(*) FILTER (WHERE status <> 'skip' AND answered_by <> '') AS fallback_cases,
  concat_ws(',', 'contains', CASE WHEN count(*) FILTER (WHERE idx % 2 = 0) > 0 THEN 'cost' END, CASE WHEN count(*) FILTER (WHERE idx % 2 = 1) > 0 THEN 'latency' END) AS labels FROM cases GROUP BY run_id)
SELECT s.*, e.blank FROM s LEFT JOIN e USING (run_id)"""


def document_reports(spark: SparkSession, d: str) -> DataFrame:
    rows = dc.case_rows(run_documents(spark, d))
    return dc.markdown(summaries.summarise(rows, "run_id"), rows)


DOCUMENT_REPORTS = rf"""{WITH}, f AS (SELECT run_id, string_agg('| ' || coalesce(name, case_key) || ' | ' || status || ' | ' || coalesce(printf('%.2f', score), '') || ' |', chr(10) ORDER BY idx, case_key) AS rows
  FROM cases WHERE status IN ('fail', 'error', 'xpass') GROUP BY run_id),
s AS (SELECT run_id, printf('%d passed · %d failed · %d errored · %d in all', count(*) FILTER (WHERE status = 'pass'), count(*) FILTER (WHERE status = 'fail'), count(*) FILTER (WHERE status = 'error'), count(*)) AS head FROM cases GROUP BY run_id)
SELECT run_id, head || coalesce(chr(10) || chr(10) || '| case | status | score |' || chr(10) || '|-|-|-|' || chr(10) || rows, '') AS markdown FROM s LEFT JOIN f USING (run_id)"""


def document_tags(spark: SparkSession, d: str) -> DataFrame:
    return ingest.run_tags(dc.run_rows(run_documents(spark, d)))


DOCUMENT_TAGS = f"{WITH} SELECT DISTINCT run_id, tag FROM runs, unnest(string_split(tag_text, ',')) t(tag) WHERE tag <> ''"


def composite_runs(spark: SparkSession, d: str) -> DataFrame:
    """Composites of the main branch as runs, without the newest run of one suite."""
    runs, cases, head = v.runs(spark, d), v.cases(spark, d), "1-URGENT|s0|1998q2"
    return r.composite_run(r.composite(cases, runs, exclude=head), runs, exclude=head).drop("cache_read_tokens", "skeleton", "actor", "tests_digest", "asserts_digest", "grader_digest", "git_commit")


_OTHERS = "1-URGENT|s0|1998q2"
COMPOSITE_RUNS = f"""{WITH}, all_runs AS (SELECT * FROM runs), {MERGED.replace("FROM runs WHERE", f"FROM runs WHERE run_id <> '{_OTHERS}' AND")}, one AS (SELECT * FROM n WHERE nth = 1),
c AS (SELECT k.*, o.rank FROM one o JOIN cases k ON k.run_id = o.run_id AND k.case_key = o.case_key),
b AS (SELECT project, suite, count(*) AS on_branch FROM runs WHERE branch = 'main' AND run_id <> '{_OTHERS}' GROUP BY project, suite),
w AS (SELECT project, suite, string_agg(run_id, ',' ORDER BY rank) AS contributors, arg_min(run_id, rank) AS skeleton, max(rank) AS last FROM (SELECT DISTINCT project, suite, run_id, rank FROM c) GROUP BY project, suite),
s AS (SELECT project, suite, count(*) AS total, {STATUS_COUNTS}, sum(coalesce(input_tokens, 0) + coalesce(cache_read_tokens, 0))::BIGINT AS prompt_tokens, sum(output_tokens)::BIGINT AS completion_tokens, sum(cost_microusd)::BIGINT AS cost_microusd,
  nullif(sum(cost_microusd) FILTER (WHERE cached), 0)::BIGINT AS cache_savings_microusd, sum(grader_cost_microusd)::BIGINT AS grader_cost_microusd, count(*) FILTER (WHERE cached) AS cache_hits, count(*) FILTER (WHERE cached IS NOT TRUE) AS cache_misses,
  count(*) FILTER (WHERE cached IS NOT TRUE AND attempts > 1) AS retried_cases, count(*) FILTER (WHERE status <> 'skip' AND answered_by <> '') AS fallback_cases FROM c GROUP BY project, suite)
SELECT s.*, w.contributors, w.last = 20 AND b.on_branch > 20 AS truncated, r.created_at, r.config_digest, r.prompts_digest, r.providers_digest, 'composite-main-' || skeleton AS run_id, 'main' AS branch
FROM s JOIN w USING (project, suite) JOIN b USING (project, suite) JOIN runs r ON r.run_id = skeleton"""


def component_digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of requests and of suites' parts, for each part of the star schema."""
    part = spark.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey")
    request = F.format_string('{"vars": {"b": %d.0, "a": "%s"}, "prompt": "p\\u00e9", "params": {"t": 1e-7}}', k, F.col("p_brand"))
    suite = F.format_string('{"providers": [{"model": "m%d", "id": "x"}], "prompts": ["%s"], "other": 1}', k % 5, F.col("p_brand"))
    tests = F.concat(F.format_string('[{"id": "t2", "vars": {"n": %d}, "assert": [], "expect_fail": ', k), F.when(k % 2 == 0, '"known"').otherwise("false"), F.lit('}, {"vars": {}}]'))
    own = jc.config_digests(suite, tests)
    return part.select("p_partkey", jc.prompt_digest(request).alias("prompt"), jc.cache_key(request, k % 3, F.when(k % 2 == 0, F.lit("s")), F.lit(None).cast("string")).alias("cache_key"), *[own[p].alias(p) for p in sc.COMPONENTS])


COMPONENT_DIGESTS = """WITH t AS (SELECT p_partkey, '{"params":{"t":1e-7},"prompt":"pé","vars":{"a":"' || p_brand || '","b":' || p_partkey || '.0}}' AS request,
  '"params":{"t":1e-7},"prompt":"pé","vars":{"a":"' || p_brand || '","b":' || p_partkey || '.0}}' AS body, p_brand FROM part)
SELECT p_partkey, 'sha256:' || sha256('{"case_salt":null,' || body) AS prompt,
  'sha256:' || sha256(CASE WHEN p_partkey % 2 = 0 THEN '{"provider_salt":"s","repeat":' ELSE '{"repeat":' END || (p_partkey % 3) || ',"request":' || request || '}') AS cache_key,
  'sha256:' || sha256('["' || p_brand || '"]') AS prompts, 'sha256:' || sha256('[{"id":"x","model":"m' || (p_partkey % 5) || '"}]') AS providers, 'sha256:' || sha256('null') AS grader,
  'sha256:' || sha256('[{"body":{"vars":{}},"id":""},{"body":{"id":"t2","vars":{"n":' || p_partkey || '}},"id":"t2"}]') AS tests,
  'sha256:' || sha256('[{"body":null,"id":""},{"body":' || CASE WHEN p_partkey % 2 = 0 THEN '{"assert":[],"expect_fail":true}' ELSE '[]' END || ',"id":"t2"}]') AS asserts FROM t"""


def json_changes(spark: SparkSession, d: str) -> DataFrame:
    """Leaves that differ between two documents of each event."""
    e = F.col("event_id")
    events = spark.read.parquet(f"{d}/events.parquet")
    before = events.select("event_id", F.format_string('{"a": {"b": %d, "c": [1, {"x": %d}]}, "k": "%s"}', e % 5, e % 3, F.col("event_type")).alias("doc"))
    after = events.select("event_id", F.concat(F.format_string('{"a": {"b": %d, "c": [1', e % 4), F.when(e % 2 == 0, F.format_string(', {"x": %d}', e % 3)).otherwise(""), F.lit(']}, "n": 1e20, "z": {}}')).alias("doc"))
    return diffs.json_diff(before, after, "event_id", "doc")


JSON_CHANGES = """SELECT event_id, 'a.b' AS path, (event_id % 5)::VARCHAR AS before, (event_id % 4)::VARCHAR AS after, 'changed' AS kind FROM events WHERE event_id % 5 <> event_id % 4
UNION ALL SELECT event_id, 'a.c.1.x', (event_id % 3)::VARCHAR, NULL, 'removed' FROM events WHERE event_id % 2 = 1 UNION ALL SELECT event_id, 'k', '"' || event_type || '"', NULL, 'removed' FROM events
UNION ALL SELECT event_id, 'n', NULL, '1e20', 'added' FROM events UNION ALL SELECT event_id, 'z', NULL, '{}', 'added' FROM events"""


def changed_pins(spark: SparkSession, d: str) -> DataFrame:
    """Pins after one is replaced, one is refused as its run is of another suite, one is set on a branch, and one is dropped."""
    runs, own = v.runs(spark, d), v.pins(spark)
    own = baselines.put_pin(own, runs, "1-URGENT", "s0", run_id="1-URGENT|s0|1995q3", set_at=9)
    own = baselines.put_pin(own, runs, "2-HIGH", "s0", run_id="1-URGENT|s0|1995q3", set_at=10)
    own = baselines.put_pin(own, runs, "5-LOW", "s2", branch="dev", set_at=11)
    return baselines.drop_pin(own, "5-LOW", "s3").join(runs.select("project", "suite").distinct(), ["project", "suite"], "left_semi")


CHANGED_PINS = f"""{WITH}, p AS ({v.pins_sql()}) SELECT * FROM (SELECT project, suite, CASE WHEN project = '1-URGENT' AND suite = 's0' THEN '1-URGENT|s0|1995q3' ELSE run_id END AS run_id, branch,
  (CASE WHEN project = '1-URGENT' AND suite = 's0' THEN 9 ELSE set_at END)::BIGINT AS set_at FROM p WHERE project <> '5-LOW' UNION ALL SELECT '5-LOW', 's2', NULL, 'dev', 11)
WHERE (project, suite) IN (SELECT (project, suite) FROM runs)"""


def suggested_cases(spark: SparkSession, d: str) -> DataFrame:
    return suites.suggestions(v.cases(spark, d), ["P1/O/T7x", "t11"], 4).select("run_id", "case_key", "score", "nth")


SUGGESTED_CASES = f"""{WITH}, q AS (SELECT unnest(['p1/o/t7x', 't11']) AS s), t AS (SELECT run_id, case_key, idx, unnest([lower(case_key), lower(test_id), lower(name)]) AS t FROM cases),
m AS (SELECT run_id, case_key, idx, coalesce(max(CASE WHEN t = s THEN 100 WHEN starts_with(t, s) THEN 80 WHEN contains(t, s) THEN 60 WHEN contains(s, t) THEN 40
  ELSE len(list_filter(range(1, length(s) + 1), lambda k: starts_with(t, s[1:k]))) END), 0) AS score FROM t, q GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, idx, case_key) AS nth FROM m)
SELECT run_id, case_key, score::INTEGER AS score, nth::INTEGER AS nth FROM k WHERE nth <= 4"""

_Q = {
    "document_cases": (document_cases, DOCUMENT_CASES),
    "document_runs": (document_runs, DOCUMENT_RUNS),
    "document_summaries": (document_summaries, DOCUMENT_SUMMARIES),
    "document_reports": (document_reports, DOCUMENT_REPORTS),
    "document_tags": (document_tags, DOCUMENT_TAGS),
    "composite_runs": (composite_runs, COMPOSITE_RUNS),
    "component_digests": (component_digests, COMPONENT_DIGESTS),
    "json_changes": (json_changes, JSON_CHANGES),
    "changed_pins": (changed_pins, CHANGED_PINS),
    "suggested_cases": (suggested_cases, SUGGESTED_CASES),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _Q.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _Q.items()}
