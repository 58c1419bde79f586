"""Registered queries on lists of runs and cases, access, baselines, summaries and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import scalars as sc
from gradeloom.operators import access, baselines, diffs, summaries
from gradeloom.operators import results as r
from gradeloom.operators import runs as ru
from gradeloom.operators import suites as su
from gradeloom.plans import views as v
from gradeloom.queries import DOCUMENT_DELTA, NEWEST, ONE_RUN, PAIR, WITH, pair
from gradeloom.suite_queries import ACCESS, GRANT, GRANTS, RULE, RULES, SERIES

SLOT = 7776000000


def _labelled(rows: dict[str, DataFrame]) -> DataFrame:
    out = None
    for label, df in rows.items():
        own = df.select(F.lit(label).alias("label"), *df.columns)
        out = own if out is None else out.union(own)
    return out


def _by_condition(rows: DataFrame, asked: dict) -> DataFrame:
    """rows with the label of each condition that they meet, by one scan."""
    fits = F.array(*[F.when(c, F.lit(label)) for label, c in asked.items()])
    return rows.withColumn("label", F.explode(F.array_compact(fits)))


def run_filters(spark: SparkSession, d: str) -> DataFrame:
    runs = v.runs(spark, d)
    asked = {
        "suite": ru.run_filter(project="2-HIGH", suite="s1"), "branch": ru.run_filter(branch="feature"), "window": ru.run_filter(since=SLOT * 7985, until=SLOT * 7990), "date": ru.run_filter(since="2460-01-01T00:00:00Z"),
        "ci": ru.run_filter(origin="ci", project="5-LOW"), "local": ru.run_filter(origin="local"), "actor": ru.run_filter(actor="tove"), "pass": ru.run_filter(status="pass"), "fail": ru.run_filter(status="fail", suite="s0"), "error": ru.run_filter(status="error"),
    }
    return _by_condition(runs, asked).select("label", "run_id")


RUN_FILTERS = f"""{WITH}, l AS (SELECT unnest(['suite', 'branch', 'window', 'date', 'ci', 'local', 'actor', 'pass', 'fail', 'error']) AS label)
SELECT label, run_id FROM l, runs WHERE CASE label WHEN 'suite' THEN project = '2-HIGH' AND suite = 's1' WHEN 'branch' THEN branch = 'feature' WHEN 'window' THEN created_at BETWEEN {SLOT} * 7985 AND {SLOT} * 7990
  WHEN 'date' THEN created_at >= epoch_ms(TIMESTAMP '2460-01-01 00:00:00') WHEN 'ci' THEN ci IS NOT NULL AND project = '5-LOW' WHEN 'local' THEN ci IS NULL WHEN 'actor' THEN actor = 'tove' OR uploaded_by = 'tove'
  WHEN 'pass' THEN fail_count = 0 AND error_count = 0 AND xpass_count = 0 WHEN 'fail' THEN (fail_count > 0 OR xpass_count > 0) AND suite = 's0' ELSE error_count > 0 END"""


def runs_by_tag_and_cache(spark: SparkSession, d: str) -> DataFrame:
    runs = v.tagged(v.runs(spark, d))
    of = {"tag": ru.with_tag(runs, "slow"), **{c: ru.by_cache(runs, c) for c in ("exclude", "only", "all")}}
    return _labelled({k: x.agg(F.count(F.lit(1)).alias("n")) for k, x in of.items()} | {"hidden": ru.cached_hidden(runs).select(F.col("cached_hidden").alias("n"))})


CACHED = "cache_misses = 0 AND cache_hits > 0"
BY_TAG = f"""{WITH} SELECT 'tag' AS label, count(*) AS n FROM runs WHERE list_contains(string_split(tag_text, ','), 'slow') UNION ALL SELECT 'exclude', count(*) FROM runs WHERE ({CACHED}) IS NOT TRUE
UNION ALL SELECT 'only', count(*) FROM runs WHERE {CACHED} UNION ALL SELECT 'all', count(*) FROM runs UNION ALL SELECT 'hidden', count(*) FROM runs WHERE {CACHED}"""


def case_filters(spark: SparkSession, d: str) -> DataFrame:
    cases = v.tagged(v.cases(spark, d))
    asked = {
        "status": ru.case_filter(status="xfail"), "cell": ru.case_filter(provider="p1", prompt="F", test="t4"), "stop": ru.case_filter(stop_reason="refusal"), "text": ru.case_filter(text="OUT 3"), "name": ru.case_filter(text="t1_ of"),
        "unknown": ru.case_filter(error_class="unknown"), "class": ru.case_filter(error_class="grader_failed"), "empty": ru.case_filter(empty_reason="refusal"), "none": ru.case_filter(empty_reason=""), "cached": ru.case_filter(cached=True), "fresh": ru.case_filter(cached=False),
    }
    return _by_condition(cases, asked | {"tag": F.array_contains("tags", "even")}).groupBy("label", "run_id").agg(F.count(F.lit(1)).alias("n"))


CASE_FILTERS = f"""{WITH}, l AS (SELECT unnest(['status', 'cell', 'stop', 'text', 'name', 'unknown', 'class', 'empty', 'cached', 'fresh', 'tag']) AS label)
SELECT label, run_id, count(*) AS n FROM l, cases WHERE CASE label WHEN 'status' THEN status = 'xfail' WHEN 'cell' THEN provider_id = 'p1' AND prompt_id = 'F' AND test_id = 't4' WHEN 'stop' THEN stop_reason = 'refusal'
  WHEN 'text' THEN lower(output_text) LIKE '%out 3%' OR lower(name) LIKE '%out 3%' WHEN 'name' THEN lower(output_text) LIKE '%t1_ of%' OR lower(name) LIKE '%t1_ of%' WHEN 'unknown' THEN status = 'error' AND coalesce(error_class, '') = ''
  WHEN 'class' THEN error_class = 'grader_failed' WHEN 'empty' THEN empty_reason = 'refusal' WHEN 'cached' THEN cached WHEN 'fresh' THEN NOT coalesce(cached, false) ELSE list_contains(string_split(tag_text, ','), 'even') END GROUP BY label, run_id"""


def case_pages(spark: SparkSession, d: str) -> DataFrame:
    cases = v.cases(spark, d)
    first = ru.case_page(cases, ONE_RUN, 7).select("case_key", "idx")
    return _labelled({"first": first, "later": ru.case_page(cases, ONE_RUN, 500, 20_000).select("case_key", "idx"), "one": ru.case_by_key(cases, ONE_RUN, "p0/F/t2#N").select("case_key", "idx")})


CASE_PAGES = f"""{WITH}, c AS (SELECT case_key, idx FROM cases WHERE run_id = '{ONE_RUN}') SELECT 'first' AS label, * FROM (SELECT * FROM c ORDER BY idx, case_key LIMIT 8)
UNION ALL SELECT 'later', * FROM (SELECT * FROM c WHERE idx > 20000 ORDER BY idx, case_key LIMIT 201) UNION ALL SELECT 'one', * FROM c WHERE case_key = 'p0/F/t2#N'"""


def project_suites(spark: SparkSession, d: str) -> DataFrame:
    return ru.suites_by_project(v.runs(spark, d))


def suite_details(spark: SparkSession, d: str) -> DataFrame:
    return ru.set_details(v.runs(spark, d), "project", "suite")


SUITE_DETAILS = f"""{WITH} SELECT project, suite, count(*) AS run_count, max(created_at) AS last_run_at, sum(pass_count)::BIGINT AS pass_count, sum(fail_count)::BIGINT AS fail_count, sum(error_count)::BIGINT AS error_count, sum(case_count)::BIGINT AS case_count,
  nullif(sum(empty_count)::BIGINT, 0) AS empty_count, arg_max(CASE WHEN case_count > 0 THEN pass_count / case_count ELSE 0.0 END, (created_at, run_id)) AS latest_pass_rate FROM runs GROUP BY project, suite"""


def suite_series(spark: SparkSession, d: str) -> DataFrame:
    listed = su.chart_series(su.suite_list(v.runs(spark, d), v.pins(spark)))
    ids = F.array_join(F.transform("series", lambda x: x["run_id"]), ",")
    return listed.select("project", "suite", "run_count", "last_run_at", "baseline_run_id", "baseline_branch", "last_run_id", ids.alias("series"), F.round(F.get("series", F.lit(0))["pass_rate"], 6).alias("oldest_rate"))


SUITE_SERIES = f"""{WITH}, n AS (SELECT *, {NEWEST} AS nth FROM runs), k AS (SELECT project, suite, count(*) AS run_count, max(created_at) AS last_run_at, arg_min(run_id, nth) AS last_run_id, string_agg(run_id, ',' ORDER BY nth DESC) AS series,
  round(arg_max(pass_count / case_count, nth), 6) AS oldest_rate FROM n WHERE nth <= 20 GROUP BY project, suite)
SELECT k.*, p.run_id AS baseline_run_id, p.branch AS baseline_branch FROM k LEFT JOIN pins p USING (project, suite)"""


def previous_runs(spark: SparkSession, d: str) -> DataFrame:
    return ru.previous_runs(v.runs(spark, d))


PREVIOUS = f"{WITH} SELECT run_id, lead(run_id) OVER (PARTITION BY project, suite ORDER BY created_at DESC, run_id DESC) AS previous_run_id FROM runs"


def run_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return ru.neighbours(v.runs(spark, d), "run_id", F.desc("created_at"), F.desc("run_id"), by=("project",))


NEIGHBOURS = f"""{WITH} SELECT project, run_id, lag(run_id) OVER w AS prev_key, lead(run_id) OVER w AS next_key, row_number() OVER w AS position, count(*) OVER (PARTITION BY project) AS total
FROM runs WINDOW w AS (PARTITION BY project ORDER BY created_at DESC, run_id DESC)"""


def canonical_delta(spark: SparkSession, d: str) -> DataFrame:
    return su.canonical_delta(v.runs(spark, d)).withColumn("delta_points", F.round("delta_points", 6))


CANONICAL_DELTA = f"{WITH}, {SERIES} SELECT project, suite, round(delta_points, 6) AS delta_points FROM l"


def local_actors(spark: SparkSession, d: str) -> DataFrame:
    return ru.actors_by_suite(v.runs(spark, d))


ACTORS = f"{WITH} SELECT project, suite, coalesce(string_agg(DISTINCT actor, ',' ORDER BY actor), '') AS actors, count(*) AS local_runs FROM runs WHERE ci IS NULL GROUP BY project, suite"


def sorted_run_heads(spark: SparkSession, d: str) -> DataFrame:
    """The first runs by some fields, in either direction."""
    runs = v.tagged(v.runs(spark, d))
    of = {"who": ru.sorted_runs(runs, "who").limit(30), "tokens": ru.sorted_runs(runs, "tokens", True).limit(30), "tags": ru.sorted_runs(runs, "tags", True).limit(400), "local": ru.local_runs(runs, "s2", 25)}
    return _labelled({k: x.select("run_id") for k, x in of.items()})


LAST = "created_at DESC, run_id DESC"
SORTED_RUNS = f"""{WITH} SELECT 'who' AS label, run_id FROM (SELECT run_id FROM runs ORDER BY coalesce(actor, uploaded_by) NULLS LAST, {LAST} LIMIT 30)
UNION ALL SELECT 'tokens', run_id FROM (SELECT run_id FROM runs ORDER BY prompt_tokens + completion_tokens DESC NULLS LAST, {LAST} LIMIT 30)
UNION ALL SELECT 'tags', run_id FROM (SELECT run_id FROM runs ORDER BY nullif(tag_text, '') DESC NULLS LAST, {LAST} LIMIT 400)
UNION ALL SELECT 'local', run_id FROM (SELECT run_id FROM runs WHERE suite = 's2' ORDER BY created_at - duration_ms DESC, run_id DESC LIMIT 25)"""


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return v.runs(spark, d).select("project", "suite").distinct()


def set_access(spark: SparkSession, d: str) -> DataFrame:
    rules, grants = spark.createDataFrame(RULES, RULE), spark.createDataFrame(GRANTS, GRANT)
    of = {f"{who}-{level}": access.set_access(_sets(spark, d), rules, grants, who, level) for who in ("mira", "bo", "none") for level in access.LEVELS}
    return _labelled(of)


SET_ACCESS = f"""{WITH}, {ACCESS}, s AS (SELECT DISTINCT project, suite FROM runs), w AS (SELECT unnest(['mira', 'bo', 'none']) AS who), l AS (SELECT unnest(['view', 'upload', 'manage']) AS level, unnest([1, 2, 3]) AS least),
m AS (SELECT s.*, who, level, least, EXISTS (SELECT 1 FROM rules x WHERE x.project = s.project AND (x.suite IS NULL OR x.suite = s.suite)) AS shut,
  (SELECT max(CASE g.level WHEN 'view' THEN 1 WHEN 'upload' THEN 2 ELSE 3 END) FROM grants g WHERE g.user_id = who AND g.project = s.project AND (g.suite IS NULL OR g.suite = s.suite)) AS held FROM s, w, l)
SELECT who || '-' || level AS label, project, suite, (least <= 2 AND NOT shut) OR coalesce(held >= least, false) AS allowed FROM m"""


def restricted_sets(spark: SparkSession, d: str) -> DataFrame:
    rules = access.unrestrict(access.restrict(spark.createDataFrame(RULES, RULE), "5-LOW", "s0"), "2-HIGH", "s1")
    return access.restricted(_sets(spark, d), rules)


RESTRICTED = f"""{WITH} SELECT DISTINCT project, suite, (project = '3-MEDIUM' AND suite = 's2') OR (project = '5-LOW' AND suite = 's0') AS exactly,
  project = '1-URGENT' OR (project = '3-MEDIUM' AND suite = 's2') OR (project = '5-LOW' AND suite = 's0') AS covered FROM runs"""


def pinned_baselines(spark: SparkSession, d: str) -> DataFrame:
    return baselines.pins_with_runs(v.pins(spark), v.runs(spark, d))


PINNED = f"{WITH} SELECT p.*, r.created_at AS run_created_at FROM pins p LEFT JOIN runs r ON r.run_id = p.run_id WHERE p.run_id IS NULL OR r.run_id IS NOT NULL"


def resolved_baselines(spark: SparkSession, d: str) -> DataFrame:
    runs = v.runs(spark, d)
    heads = r.latest_runs(runs)
    asked = ("latest", "branch:main", "server:branch:absent", "server:baseline", "server:oops", "branch:", ONE_RUN, "missing")
    return _labelled({ref: baselines.resolve(heads, runs, ref, v.pins(spark)) for ref in asked})


RESOLVED = f"""{WITH}, n AS (SELECT *, {NEWEST} AS nth FROM runs), h AS (SELECT * FROM n WHERE nth = 1), p AS (SELECT * FROM n WHERE nth = 2),
m AS (SELECT DISTINCT h.run_id FROM h JOIN runs r ON r.project = h.project AND r.suite = h.suite AND r.branch = 'main' AND r.run_id <> h.run_id)
SELECT 'latest' AS label, h.run_id AS head_id, CASE WHEN p.run_id IS NULL THEN 'absent' ELSE 'run' END AS kind, p.run_id AS base_run_id, NULL::VARCHAR AS branch FROM h LEFT JOIN p USING (project, suite)
UNION ALL SELECT 'branch:main', h.run_id, CASE WHEN m.run_id IS NULL THEN 'absent' ELSE 'branch' END, NULL, CASE WHEN m.run_id IS NOT NULL THEN 'main' END FROM h LEFT JOIN m USING (run_id)
UNION ALL SELECT 'server:branch:absent', run_id, 'absent', NULL, NULL FROM h
UNION ALL SELECT 'server:baseline', h.run_id, CASE WHEN q.branch IS NOT NULL THEN 'branch' WHEN r.run_id IS NOT NULL THEN 'run' ELSE 'absent' END, r.run_id, q.branch FROM h LEFT JOIN pins q USING (project, suite) LEFT JOIN runs r ON r.run_id = q.run_id
UNION ALL SELECT 'server:oops', run_id, 'failed', NULL, NULL FROM h UNION ALL SELECT 'branch:', run_id, 'failed', NULL, NULL FROM h UNION ALL SELECT 'missing', run_id, 'failed', NULL, NULL FROM h
UNION ALL SELECT '{ONE_RUN}', run_id, CASE WHEN project = '1-URGENT' AND suite = 's0' AND EXISTS (SELECT 1 FROM runs WHERE run_id = '{ONE_RUN}') THEN 'run' ELSE 'failed' END,
  CASE WHEN project = '1-URGENT' AND suite = 's0' THEN (SELECT run_id FROM runs WHERE run_id = '{ONE_RUN}') END, NULL FROM h"""


def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    return summaries.summarise(v.cases(spark, d), "run_id")


STATUS_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS n_{x}" for x in summaries.STATUSES)
SUMMED = f"""SELECT run_id, count(*) AS total, {STATUS_COUNTS}, sum(coalesce(input_tokens, 0) + coalesce(cache_read_tokens, 0))::BIGINT AS prompt_tokens, sum(output_tokens)::BIGINT AS completion_tokens, sum(coalesce(cache_read_tokens, 0))::BIGINT AS cache_read_tokens,
  sum(cost_microusd)::BIGINT AS cost_microusd, nullif(sum(cost_microusd) FILTER (WHERE cached), 0)::BIGINT AS cache_savings_microusd, sum(grader_cost_microusd)::BIGINT AS grader_cost_microusd, count(*) FILTER (WHERE cached) AS cache_hits,
  count(*) FILTER (WHERE cached IS NOT TRUE) AS cache_misses, count(*) FILTER (WHERE cached IS NOT TRUE AND attempts > 1) AS retried_cases, count(*) FILTER (WHERE status <> 'skip' AND answered_by <> '') AS fallback_cases FROM cases GROUP BY run_id"""


def empty_reasons(spark: SparkSession, d: str) -> DataFrame:
    return summaries.empty_counts(v.cases(spark, d), "run_id")


def graded_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    return summaries.graded_fallbacks(v.cases(spark, d), "project", "suite")


def backfilled_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = v.runs(spark, d).withColumns({c: F.when(F.col("case_count") % 2 == 0, F.col(c)) for c in ("empty_count", "fallback_count")})
    return summaries.backfilled(runs, v.cases(spark, d)).select("run_id", "empty_count", "fallback_count")


def ci_summaries(spark: SparkSession, d: str) -> DataFrame:
    regressed = pair(spark, d).groupBy("project", "suite").agg(F.count_if(F.col("delta") == "newly_failing").alias("regressed"))
    own = v.cases(spark, d).join(r.latest_runs(v.runs(spark, d), 2).select("run_id"), "run_id", "left_semi")
    return summaries.ci_summary(summaries.summarise(own, "project", "suite"), regressed, "project", "suite")


CI_SUMMARY = f"""{PAIR}, k AS (SELECT project, suite, count(*) FILTER (WHERE delta = 'newly_failing') AS regressed FROM cmp GROUP BY project, suite),
s AS (SELECT project, suite, count(*) AS total, {STATUS_COUNTS}, sum(cost_microusd)::BIGINT AS cost, nullif(sum(cost_microusd) FILTER (WHERE cached), 0)::BIGINT AS saved, count(*) FILTER (WHERE cached) AS hits, count(*) FILTER (WHERE status <> 'skip' AND answered_by <> '') AS fell FROM h GROUP BY project, suite)
SELECT project, suite, n_pass::VARCHAR AS passed, n_fail::VARCHAR AS failed, n_error::VARCHAR AS errored, (n_fail + n_error)::VARCHAR AS failed_or_errored, total::VARCHAR AS total, printf('%.1f', n_pass * 100.0::DOUBLE / total) AS pass_rate,
  printf('%.1f', hits * 100.0::DOUBLE / total) AS cache_hit_rate, fell::VARCHAR AS fallback_cases, coalesce(printf('%.6f', cost / 1e6::DOUBLE), '') AS cost_usd, coalesce(printf('%.6f', saved / 1e6::DOUBLE), '') AS cache_savings_usd,
  coalesce(regressed, 0)::VARCHAR AS regressed FROM s LEFT JOIN k USING (project, suite)"""


def config_drift(spark: SparkSession, d: str) -> DataFrame:
    base, head = diffs.newest_pairs(v.runs(spark, d))
    return diffs.config_drift(base, head, "project", "suite")


PARTS = ("config", *sc.COMPONENTS)
CONFIG_DRIFT = f"{WITH}, n AS (SELECT *, {NEWEST} AS nth FROM runs), " + "p AS (SELECT b.project, b.suite, " + ", ".join(f"nullif(b.{p}_digest, '') AS b_{p}, nullif(h.{p}_digest, '') AS h_{p}" for p in PARTS) + (
    " FROM n b JOIN n h USING (project, suite) WHERE b.nth = 3 AND h.nth = 2) "
) + " UNION ALL ".join(f"SELECT project, suite, '{p}' AS component, b_{p} AS base, h_{p} AS head, b_{p} <> h_{p} AS changed FROM p" for p in PARTS)


def changed_parts(spark: SparkSession, d: str) -> DataFrame:
    base, head = (x.select("project", "suite", *[F.col(f"{p}_digest").alias(f"{n}_{p}") for p in sc.COMPONENTS]) for n, x in zip("bh", diffs.newest_pairs(v.runs(spark, d)), strict=True))
    changed = {p: sc.drifted(F.col(f"b_{p}"), F.col(f"h_{p}")) for p in sc.COMPONENTS}
    return base.join(head, ["project", "suite"]).select("project", "suite", F.array_join(sc.changed_components(changed), ",").alias("changed"), sc.any_unknown(changed).alias("some_unknown"))


CHANGED_PARTS = f"{WITH}, n AS (SELECT *, {NEWEST} AS nth FROM runs) SELECT b.project, b.suite, concat_ws(',', " + ", ".join(
    f"CASE WHEN nullif(b.{p}_digest, '') <> nullif(h.{p}_digest, '') THEN '{p}' END" for p in sc.COMPONENTS
) + ") AS changed, " + " OR ".join(f"coalesce(b.{p}_digest, '') = '' OR coalesce(h.{p}_digest, '') = ''" for p in sc.COMPONENTS) + " AS some_unknown FROM n b JOIN n h USING (project, suite) WHERE b.nth = 3 AND h.nth = 2"


def _one_suite(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    runs = v.runs(spark, d).where("project = '2-HIGH' AND suite = 's1'")
    return tuple(v.cases(spark, d).join(x.select("run_id"), "run_id", "left_semi") for x in diffs.newest_pairs(runs))


def document_diff(spark: SparkSession, d: str) -> DataFrame:
    out = diffs.document_diff(*_one_suite(spark, d))
    scopes = [diffs.in_scope(s).alias(s) for s in ("regressions", "changed", "all", "none")]
    return out.select("case_key", "head_idx", "base_idx", "delta", "output_changed", *scopes)


DOCUMENT_DIFF = f"""{WITH}, n AS (SELECT run_id, {NEWEST} AS nth FROM runs WHERE project = '2-HIGH' AND suite = 's1'), b AS (SELECT c.* FROM cases c JOIN n USING (run_id) WHERE nth = 3), h AS (SELECT c.* FROM cases c JOIN n USING (run_id) WHERE nth = 2),
x AS (SELECT coalesce(b.case_key, h.case_key) AS case_key, h.idx AS head_idx, b.idx AS base_idx, b.status AS base_status, h.status AS head_status, b.status IS NOT NULL AND h.status IS NOT NULL AS joined,
  b.status IS NOT NULL AND h.status IS NOT NULL AND coalesce(b.output_text, '') <> coalesce(h.output_text, '') AS output_changed FROM b FULL JOIN h ON b.case_key = h.case_key),
y AS (SELECT *, {DOCUMENT_DELTA} AS delta FROM x)
SELECT case_key, head_idx, base_idx, delta, output_changed, joined AND delta = 'newly_failing' AS regressions, joined AND output_changed AS changed, joined AS "all", joined AND false AS "none" FROM y"""


def kept_deltas(spark: SparkSession, d: str) -> DataFrame:
    kept, omitted = diffs.kept_deltas(pair(spark, d), ["newly_failing", "newly_passing"], 5, "project", "suite", "case_key")
    return kept.select("project", "suite", "case_key", "delta", F.lit(None).cast("long").alias("omitted")).union(omitted.select(*[F.lit(None).cast("string")] * 4, "omitted"))


KEPT_DELTAS = f"""{PAIR}, f AS (SELECT * FROM cmp WHERE delta IN ('newly_failing', 'newly_passing')) SELECT project, suite, case_key, delta, NULL::BIGINT AS omitted FROM (SELECT * FROM f ORDER BY project, suite, case_key LIMIT 5)
UNION ALL SELECT NULL, NULL, NULL, NULL, (SELECT count(*) FROM cmp) - least((SELECT count(*) FROM f), 5)"""


def assert_flips(spark: SparkSession, d: str) -> DataFrame:
    runs, cases = v.runs(spark, d), v.cases(spark, d)
    one = lambda kind, passed: F.struct(F.lit(kind).alias("kind"), F.coalesce(passed, F.lit(False)).alias("passed"), F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    own = F.array(one("contains", F.col("status") == "pass"), one("latency", F.col("latency_ms") <= 250))
    with_cost = F.concat(own, F.array(one("cost", F.col("cost_microusd") <= 3_000_000_000)))
    told = cases.withColumn("asserts", F.when(F.col("idx") % 3 == 0, own).otherwise(with_cost)).select("run_id", "project", "suite", "case_key", "asserts")
    base, head = (told.join(x.select("run_id"), "run_id", "left_semi").drop("run_id") for x in diffs.newest_pairs(runs))
    both = base.withColumnRenamed("asserts", "b").join(head.withColumnRenamed("asserts", "h"), ["project", "suite", "case_key"])
    flips = both.select("project", "suite", F.explode(diffs.assert_flips(F.col("b"), F.col("h"))).alias("f"))
    return flips.groupBy("project", "suite", "f.kind", "f.base_passed").agg(F.count(F.lit(1)).alias("n"))


ASSERT_FLIPS = f"""{WITH}, n AS (SELECT run_id, {NEWEST} AS nth FROM runs), a AS (SELECT nth, project, suite, case_key, 'contains' AS kind, status = 'pass' AS passed FROM cases JOIN n USING (run_id)
UNION ALL SELECT nth, project, suite, case_key, 'latency', coalesce(latency_ms <= 250, false) FROM cases JOIN n USING (run_id) UNION ALL SELECT nth, project, suite, case_key, 'cost', coalesce(cost_microusd <= 3000000000, false) FROM cases JOIN n USING (run_id) WHERE idx % 3 <> 0)
SELECT b.project, b.suite, b.kind, b.passed AS base_passed, count(*) AS n FROM a b JOIN a h USING (project, suite, case_key, kind) WHERE b.nth = 3 AND h.nth = 2 AND b.passed <> h.passed GROUP BY 1, 2, 3, 4"""


def cell_buckets(spark: SparkSession, d: str) -> DataFrame:
    cells = r.matrix(v.cases(spark, d))
    status = F.when(F.col("total") == 1, sc.single_cell_status(F.col("n_error"), F.col("n_fail"), F.col("n_skip")))
    return cells.groupBy(sc.cell_bucket(F.col("pass_fraction"), F.col("n_error")).alias("bucket"), status.alias("single_status")).agg(F.count(F.lit(1)).alias("n"))


CELL_BUCKETS = f"""{WITH}, m AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'error') AS e, count(*) FILTER (WHERE status = 'fail') AS f, count(*) FILTER (WHERE status = 'skip') AS s, count(*) FILTER (WHERE status = 'pass') / count(*) AS p
FROM cases GROUP BY run_id, test_id, provider_id, prompt_id)
SELECT CASE WHEN e > 0 THEN 'error' WHEN p = 0 THEN 'empty' WHEN p < 0.5 THEN 'low' WHEN p = 0.5 THEN 'half' WHEN p < 1 THEN 'high' ELSE 'full' END AS bucket,
  CASE WHEN total = 1 THEN CASE WHEN e > 0 THEN 'error' WHEN f > 0 THEN 'fail' WHEN s > 0 THEN 'skip' ELSE 'pass' END END AS single_status, count(*) AS n FROM m GROUP BY 1, 2"""


def error_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Of each errored case its classes, the one that tells most, its label and tone."""
    other = F.when(F.col("idx") % 2 == 0, F.lit("grader_missing")).otherwise(F.lit("exec_failed"))
    classes = F.filter(F.array(other, F.col("error_class")), lambda c: c.isNotNull() & (c != ""))
    told = v.cases(spark, d).where("status = 'error'").select(F.array_join(sc.all_classes(F.col("error_class"), F.array(other)), ", ").alias("classes"), sc.most_specific_error(classes).alias("main"))
    return told.groupBy("classes", "main", sc.error_label(F.col("main")).alias("label"), sc.error_tone(F.col("main")).alias("tone")).agg(F.count(F.lit(1)).alias("n"))


ERROR_BREAKDOWN = f"""{WITH}, e AS (SELECT coalesce(nullif(error_class, ''), 'unknown') AS first, nullif(error_class, '') AS c, CASE WHEN idx % 2 = 0 THEN 'grader_missing' ELSE 'exec_failed' END AS o FROM cases WHERE status = 'error'),
m AS (SELECT first || CASE WHEN o <> first THEN ', ' || o ELSE '' END AS classes, CASE WHEN o = 'exec_failed' THEN CASE WHEN c = 'grader_failed' THEN 'grader_failed' ELSE 'exec_failed' END
  WHEN c IS NULL OR c = 'render_failed' THEN 'grader_missing' ELSE c END AS main FROM e)
SELECT classes, main, split_part(main, '_', 1) || ' \u00b7 ' || replace(substr(main, strpos(main, '_') + 1), '_', ' ') AS label, CASE WHEN main IN ('exec_failed', 'provider_timeout') THEN 'amber' ELSE 'error' END AS tone, count(*) AS n FROM m GROUP BY ALL"""


_Q = {
    "run_filters": (run_filters, RUN_FILTERS),
    "runs_by_tag_and_cache": (runs_by_tag_and_cache, BY_TAG),
    "case_filters": (case_filters, CASE_FILTERS),
    "case_pages": (case_pages, CASE_PAGES),
    "project_suites": (project_suites, f"{WITH} SELECT project, count(*) AS run_count, count(DISTINCT suite) AS suite_count FROM runs GROUP BY project"),
    "suite_details": (suite_details, SUITE_DETAILS),
    "suite_series": (suite_series, SUITE_SERIES),
    "previous_runs": (previous_runs, PREVIOUS),
    "run_neighbours": (run_neighbours, NEIGHBOURS),
    "canonical_delta": (canonical_delta, CANONICAL_DELTA),
    "local_actors": (local_actors, ACTORS),
    "sorted_run_heads": (sorted_run_heads, SORTED_RUNS),
    "set_access": (set_access, SET_ACCESS),
    "restricted_sets": (restricted_sets, RESTRICTED),
    "pinned_baselines": (pinned_baselines, PINNED),
    "resolved_baselines": (resolved_baselines, RESOLVED),
    "run_summaries": (run_summaries, f"{WITH} {SUMMED}"),
    "empty_reasons": (empty_reasons, f"{WITH} SELECT run_id, empty_reason, count(*) AS n FROM cases WHERE empty_reason <> '' GROUP BY run_id, empty_reason"),
    "graded_fallbacks": (graded_fallbacks, f"{WITH} SELECT project, suite, count(*) FILTER (WHERE status <> 'skip') AS graded, count(*) FILTER (WHERE status <> 'skip' AND answered_by <> '') AS fell_back FROM cases GROUP BY project, suite"),
    "backfilled_runs": (backfilled_runs, f"{WITH} SELECT run_id, empty_count::BIGINT AS empty_count, fallback_count::BIGINT AS fallback_count FROM runs"),
    "ci_summaries": (ci_summaries, CI_SUMMARY),
    "config_drift": (config_drift, CONFIG_DRIFT),
    "changed_parts": (changed_parts, CHANGED_PARTS),
    "document_diff": (document_diff, DOCUMENT_DIFF),
    "kept_deltas": (kept_deltas, KEPT_DELTAS),
    "assert_flips": (assert_flips, ASSERT_FLIPS),
    "cell_buckets": (cell_buckets, CELL_BUCKETS),
    "error_breakdown": (error_breakdown, ERROR_BREAKDOWN),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _Q.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _Q.items() if sql}
