"""Registered queries on suites: grading, expansion, pricing, attribution, health, visibility, selection, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import assertions as a
from gradeloom.functions import scalars as sc
from gradeloom.operators import diffs, rates
from gradeloom.operators import suites as su
from gradeloom.plans import views as v
from gradeloom.queries import NEWEST, NOW, WITH
from gradeloom.sources import ingest

PROVIDERS, PROMPTS = ["openlab", "northwind", "local"], ["plain", "listed"]
EXACT = {"Brand#11": 2_500_000, "Brand#22": 10_000_000}
FAMILIES = {"Brand#": 500_000, "Brand#1": 750_000, "Brand#13": 1_250_000, "Brand#3": 3_000_000}


def graded(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("output_text")
    no_three = a.negated(a.contains(text, "out 3"), text)
    outcomes = [(a.icontains_any(text, "OUT 1", "out 2"), 2.0), (no_three, 1.0), (a.length_between(text, 1, 5), 1.0), (a.at_most(F.col("latency_ms"), 400), 1.0), (a.at_most(F.col("cost_microusd"), 300_000_000), 1.0), (a.matches(text, r"^out \d$"), 2.0)]
    status = a.case_status(outcomes, threshold=0.6, expect_fail=F.col("suite") == "s3", reason=sc.empty_reason(F.lit("end_turn"), text), skip_on=("blank",))
    return v.cases(spark, d).select("run_id", "case_key", F.round(a.weighted_mean(outcomes), 6).alias("graded_score"), status.alias("graded_status"))


GRADED = f"""{WITH}, o AS (SELECT run_id, case_key, suite, output_text, CASE WHEN output_text IN ('out 1', 'out 2') THEN 1.0 ELSE 0.0 END AS a1,
  CASE WHEN output_text IS NULL OR output_text = 'out 3' THEN 0.0 ELSE 1.0 END AS a2, CASE WHEN length(output_text) BETWEEN 1 AND 5 THEN 1.0 ELSE 0.0 END AS a3,
  CASE WHEN coalesce(latency_ms, 0) <= 400 THEN 1.0 ELSE 0.0 END AS a4, CASE WHEN coalesce(cost_microusd, 0) <= 300000000 THEN 1.0 ELSE 0.0 END AS a5,
  CASE WHEN regexp_matches(output_text, '^out [0-9]$') THEN 1.0 ELSE 0.0 END AS a6 FROM cases),
m AS (SELECT *, (2 * a1 + a2 + a3 + a4 + a5 + 2 * a6)::DOUBLE / 8 AS score FROM o)
SELECT run_id, case_key, round(score, 6) AS graded_score, CASE WHEN output_text IS NULL THEN 'skip' WHEN suite = 's3' THEN CASE WHEN score >= 0.6 THEN 'xpass' ELSE 'xfail' END
  WHEN score >= 0.6 THEN 'pass' ELSE 'fail' END AS graded_status FROM m"""


def more_grades(spark: SparkSession, d: str) -> DataFrame:
    """Beginnings, token budgets, recorded verdicts, whether later assertions can matter, what couldn't be judged, and the gate."""
    c = F.col
    starts = a.starts_with(c("output_text"), "out 1")
    tokens = a.at_most(a.total_tokens({"input": c("input_tokens"), "output": c("output_tokens"), "cache_read": c("cache_read_tokens")}, billable=True), 150)
    judged = a.rubric(c("status") == "pass", c("score"), 0.95)
    broken = F.array(
        F.struct(F.lit("contains").alias("kind"), F.when(c("status") == "error", "error").otherwise("pass").alias("status"), c("error_class").alias("reason")),
        F.struct(F.lit("cost").alias("kind"), F.when((c("status") == "error") & (c("idx") % 2 == 0), "error").otherwise("pass").alias("status"), F.lit("").alias("reason")),
    )
    return v.cases(spark, d).select(
        "run_id", "case_key", starts["passed"].alias("starts"), tokens["passed"].alias("in_budget"), judged["passed"].alias("judged"), judged["unevaluable"].alias("unjudged"), a.can_change([(starts, 3.0)], 3.0, 0.5).alias("open"),
        a.error_message(broken).alias("message"), sc.gate_failing(c("status")).alias("fails"),
    )


MORE_GRADES = f"""{WITH} SELECT run_id, case_key, coalesce(starts_with(output_text, 'out 1'), false) AS starts,
  CASE WHEN input_tokens IS NULL AND output_tokens IS NULL THEN true ELSE coalesce(input_tokens, 0) + coalesce(output_tokens, 0) + coalesce(cache_read_tokens, 0) <= 150 END AS in_budget,
  coalesce(score >= 0.95, false) AS judged, score IS NULL AS unjudged, NOT coalesce(starts_with(output_text, 'out 1'), false) AS open,
  CASE WHEN status = 'error' THEN 'contains assertion errored' || CASE WHEN error_class <> '' THEN ': ' || error_class ELSE '' END || CASE WHEN idx % 2 = 0 THEN ' (and 1 more errored)' ELSE '' END END AS message,
  status IN ('fail', 'error', 'xpass') AS fails FROM cases"""


def suite_cells(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    tests = part.select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("test_id"), F.array("p_brand", "p_type").alias("tags"),
                        F.when(F.col("p_size") % 5 == 0, F.array(F.lit("local"))).alias("only_providers"), F.when(F.col("p_size") % 7 == 0, F.array(F.lit("northwind"))).alias("skip_providers"))
    tests = tests.where(sc.matches_test(F.col("test_id"), F.col("tags"), globs=("Brand#1*/*", "*#3?/*5")))
    return su.cells(tests, PROVIDERS, PROMPTS, 2).select("test_id", "provider_id", "prompt_id", "repeat_idx")


SUITE_CELLS = """SELECT p_brand || '/' || p_partkey::VARCHAR AS test_id, p.provider_id, q.prompt_id, n.repeat_idx FROM part,
  (VALUES ('openlab'), ('northwind'), ('local')) p(provider_id), (VALUES ('plain'), ('listed')) q(prompt_id), (VALUES (0), (1)) n(repeat_idx)
WHERE (p_brand LIKE 'Brand#1%' OR (p_brand LIKE 'Brand#3_' AND p_partkey % 10 = 5)) AND (p_size % 5 <> 0 OR provider_id = 'local') AND NOT (p_size % 7 = 0 AND provider_id = 'northwind')"""


def priced(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_quantity")
    used = lines.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("tokens"))
    model = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("hub."), "p_brand")).when(F.col("p_partkey") % 4 == 1, F.concat("p_brand", F.lit("@v2"))).otherwise(F.col("p_brand"))
    rate = sc.family_rate(model, EXACT, FAMILIES, ("hub.",))
    return used.join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "tokens", rate.alias("rate"), sc.component_cost(F.col("tokens"), rate).alias("cost_microusd"))


PRICED = """WITH u AS (SELECT l_partkey, sum(l_quantity::BIGINT)::BIGINT AS tokens FROM lineitem GROUP BY 1),
p AS (SELECT p_partkey, tokens, CASE WHEN p_brand = 'Brand#11' THEN 2500000 WHEN p_brand = 'Brand#22' THEN 10000000 WHEN p_brand LIKE 'Brand#13%' THEN 1250000 WHEN p_brand LIKE 'Brand#1%' THEN 750000
  WHEN p_brand LIKE 'Brand#3%' THEN 3000000 WHEN p_brand LIKE 'Brand#%' THEN 500000 END AS rate FROM u JOIN part ON l_partkey = p_partkey)
SELECT *, (tokens * rate + 999999) // 1000000 AS cost_microusd FROM p"""


def rated_usage(spark: SparkSession, d: str) -> DataFrame:
    """Costs of lines by a table of as many families as there are parts, of which some hold until a day only."""
    part = spark.read.parquet(f"{d}/part.parquet")
    text = F.concat_ws("-", "p_brand", "p_type", "p_partkey")
    family = part.select(F.substring(text, F.lit(1), 3 + F.col("p_partkey") % 31).alias("name"), F.lit(True).alias("family"), "p_partkey")
    exact = part.where("p_partkey % 9 = 0").select(text.alias("name"), F.lit(False).alias("family"), "p_partkey")
    day = F.when(F.col("p_partkey") % 2 == 0, F.to_date(F.lit("1996-01-01")))
    made = family.union(exact).groupBy("name", "family").agg(F.max("p_partkey").alias("p_partkey"))
    table = made.select("name", "family", F.lit(None).cast("long").alias("valid_from"), F.unix_date(day).cast("long").alias("valid_to"), (F.col("p_partkey") * 1000 + 7).alias("input"))
    lines = spark.read.parquet(f"{d}/lineitem.parquet").join(part, F.col("l_partkey") == F.col("p_partkey"))
    dated = F.when(F.col("l_linenumber") % 2 == 0, F.concat(text, F.lit("-20240131"))).otherwise(F.concat(F.lit("hub."), text, F.lit("@v1")))
    calls = lines.select("l_partkey", dated.alias("model"), F.unix_date(F.to_date("l_shipdate")).cast("long").alias("day"), F.col("l_quantity").cast("long").alias("tokens"))
    priced_calls = rates.rated(calls, table, "model", F.col("day"), ("input",), ("hub.",))
    cost = sc.component_cost(F.col("tokens"), F.col("input"))
    return priced_calls.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("calls"), F.count("input").alias("priced"), F.sum(cost).alias("cost_microusd"))


RATED_USAGE = """WITH p AS (SELECT p_partkey, concat_ws('-', p_brand, p_type, p_partkey) AS t FROM part),
made AS (SELECT name, family, max(k) AS k FROM (SELECT substr(t, 1, 3 + p_partkey % 31) AS name, true AS family, p_partkey AS k FROM p UNION ALL SELECT t, false, p_partkey FROM p WHERE p_partkey % 9 = 0) GROUP BY ALL),
rates AS (SELECT name, family, CASE WHEN k % 2 = 0 THEN DATE '1996-01-01' END AS until, k * 1000 + 7 AS input FROM made),
models AS (SELECT p_partkey, even, t || CASE WHEN even THEN '-20240131' ELSE '' END AS model, t FROM p, (VALUES (true), (false)) e(even)),
found AS (SELECT m.p_partkey, m.even, r.until, r.input, CASE WHEN NOT family THEN 1000 ELSE length(r.name) END AS close FROM models m JOIN rates r ON CASE WHEN family THEN starts_with(m.model, r.name) ELSE m.t = r.name END),
calls AS (SELECT row_number() OVER () AS i, l_partkey, l_linenumber % 2 = 0 AS even, l_shipdate::DATE AS day, l_quantity::BIGINT AS tokens FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part)),
rated AS (SELECT i, any_value(c.l_partkey) AS l_partkey, any_value(tokens) AS tokens, max_by(f.input, close) AS input FROM calls c LEFT JOIN found f ON f.p_partkey = c.l_partkey AND f.even = c.even AND (until IS NULL OR until > day) GROUP BY i)
SELECT l_partkey, count(*) AS calls, count(input) AS priced, sum((tokens * input + 999999) // 1000000)::BIGINT AS cost_microusd FROM rated GROUP BY 1"""


def attribution(spark: SparkSession, d: str) -> DataFrame:
    runs, cases = v.runs(spark, d), v.cases(spark, d)
    base, head = (cases.join(x.select("run_id"), "run_id", "left_semi") for x in diffs.newest_pairs(runs))
    named = lambda df: df.withColumns({"asserts_digest": F.col("assert_digest"), "grader_digest": F.when(F.col("idx") % 7 != 0, F.floor(F.col("idx") % 1000 / 900).cast("string"))})
    return diffs.attribution(named(base), named(head), "project", "suite", "case_key")


ATTRIBUTION = f"""{WITH}, ranked AS (SELECT run_id, {NEWEST} AS nth FROM runs),
c AS (SELECT c.*, nth, nullif(prompt_digest, '') AS prompt, nullif(provider_digest, '') AS provider, nullif(assert_digest, '') AS asserts, CASE WHEN idx % 7 <> 0 THEN floor(idx % 1000 / 900)::INT::VARCHAR END AS grader
  FROM cases c JOIN ranked USING (run_id)), b AS (SELECT * FROM c WHERE nth = 3), h AS (SELECT * FROM c WHERE nth = 2)
SELECT coalesce(b.project, h.project) AS project, coalesce(b.suite, h.suite) AS suite, coalesce(b.case_key, h.case_key) AS case_key, CASE WHEN b.status IS NULL OR h.status IS NULL THEN 'unknown'
  WHEN b.prompt <> h.prompt THEN 'prompt_changed' WHEN b.provider <> h.provider THEN 'provider_changed' WHEN b.asserts <> h.asserts THEN 'asserts_changed' WHEN b.grader <> h.grader THEN 'grader_changed'
  WHEN b.prompt IS NULL OR h.prompt IS NULL OR b.provider IS NULL OR h.provider IS NULL OR b.asserts IS NULL OR h.asserts IS NULL OR b.grader IS NULL OR h.grader IS NULL THEN 'unknown'
  WHEN b.output_text IS DISTINCT FROM h.output_text AND b.status <> h.status THEN 'model_drift' WHEN b.output_text IS DISTINCT FROM h.output_text THEN 'output_drift' WHEN b.status <> h.status THEN 'unstable_grader' ELSE 'stable' END AS change
FROM b FULL JOIN h ON b.project = h.project AND b.suite = h.suite AND b.case_key = h.case_key"""

SERIES = f"""ci AS (SELECT * FROM runs WHERE ci IS NOT NULL), canon AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project, suite ORDER BY coalesce(branch = 'main', false) DESC, created_at DESC, run_id DESC) AS nth FROM ci) WHERE nth = 1),
s AS (SELECT ci.project, ci.suite, ci.run_id, ci.pass_count / (ci.pass_count + ci.fail_count + ci.error_count) AS rate,
  row_number() OVER (PARTITION BY ci.project, ci.suite ORDER BY ci.created_at DESC, ci.run_id DESC) AS nth FROM ci JOIN canon ON ci.project = canon.project AND ci.suite = canon.suite AND ci.branch IS NOT DISTINCT FROM canon.branch
  WHERE ci.pass_count + ci.fail_count + ci.error_count > 0),
l AS (SELECT project, suite, (max(rate) FILTER (WHERE nth = 1) - max(rate) FILTER (WHERE nth = 2)) * 100 AS delta_points FROM s GROUP BY project, suite)"""
SEVERITY = f"""{WITH}, {SERIES}, g AS (SELECT *, created_at - lag(created_at) OVER (PARTITION BY project, suite ORDER BY created_at, run_id) AS gap FROM ci),
b AS (SELECT project, suite, count(*) >= 2 AND {NOW} - max(created_at) > greatest(3 * median(gap), 86400000.0) AS stale FROM g GROUP BY project, suite),
x AS (SELECT project, suite, CASE WHEN canon.run_id IS NULL THEN 'unknown' WHEN canon.fail_count + canon.error_count > 0 THEN 'failing' WHEN stale THEN 'stale' WHEN delta_points < 0 THEN 'drifting' ELSE 'healthy' END AS severity
FROM (SELECT DISTINCT project, suite FROM runs) LEFT JOIN canon USING (project, suite) LEFT JOIN b USING (project, suite) LEFT JOIN l USING (project, suite))
SELECT *, list_position(['failing', 'stale', 'drifting', 'unknown', 'healthy'], severity)::INT - 1 AS severity_rank FROM x"""

RULES = [("1-URGENT", None), ("2-HIGH", "s1"), ("3-MEDIUM", "s2")]
GRANTS = [("1-URGENT", "s0", "mira", "view"), ("2-HIGH", None, "mira", "upload"), ("3-MEDIUM", "s2", "bo", "manage"), ("2-HIGH", "s1", "mira", "manage")]
RULE, GRANT = "project string, suite string", "project string, suite string, user_id string, level string"


def _values(rows: list, names: str) -> str:
    quoted = lambda x: "NULL::VARCHAR" if x is None else f"'{x}'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS t({names})"


ACCESS = f"rules AS ({_values(RULES, 'project, suite')}), grants AS ({_values(GRANTS, 'project, suite, user_id, level')})"


def visible(spark: SparkSession, d: str) -> DataFrame:
    return su.visible_runs(v.runs(spark, d), spark.createDataFrame(RULES, RULE), spark.createDataFrame(GRANTS, GRANT), "mira").select("run_id")


VISIBLE = f"""{WITH}, {ACCESS} SELECT run_id FROM runs r WHERE NOT EXISTS (SELECT 1 FROM rules x WHERE x.project = r.project AND (x.suite IS NULL OR x.suite = r.suite))
  OR EXISTS (SELECT 1 FROM grants g WHERE g.user_id = 'mira' AND g.project = r.project AND (g.suite IS NULL OR g.suite = r.suite))"""


def changes(spark: SparkSession, d: str) -> DataFrame:
    runs = v.runs(spark, d).withColumn("config_digest", F.nullif("config_digest", F.lit("")))
    return su.change_points(runs, "config_digest", "git_commit").select("run_id", "config_digest_changed", "git_commit_changed")


def selected(spark: SparkSession, d: str) -> DataFrame:
    """One selector for each way to name cases."""
    cases, out = v.cases(spark, d), None
    for selector in SELECTORS:
        own = su.select_cases(cases, selector).select(F.lit(selector).alias("selector"), "run_id", "case_key", "tier")
        out = own if out is None else out.union(own)
    return out


SELECTORS = ["p1/F/t3#N", "p1/F/", "t7", "t1 OF o", ""]
SELECTED = f"""{WITH}, s AS (SELECT unnest(['p1/F/t3#N', 'p1/F/', 't7', 't1 OF o', '']) AS selector),
t AS (SELECT selector, run_id, case_key, CASE WHEN selector = '' THEN NULL WHEN case_key = selector THEN 1 WHEN length(selector) >= 4 AND starts_with(case_key, selector) THEN 2 WHEN test_id = selector THEN 3
  WHEN contains(lower(name), lower(selector)) THEN 4 END AS tier FROM cases, s)
SELECT selector, run_id, case_key, tier FROM (SELECT *, min(tier) OVER (PARTITION BY selector, run_id) AS best FROM t) WHERE tier = best"""


def offered(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    return su.typeahead(part.groupBy(F.concat_ws("_", "p_name", "p_type").alias("project")).agg(F.count(F.lit(1)).alias("run_count")), " SMALL", 40)


OFFERED = r"""WITH p AS (SELECT p_name || '_' || p_type AS project, count(*) AS run_count, trim(regexp_replace(lower(p_name || '_' || p_type), '[-_\s]+', ' ', 'g')) AS n FROM part GROUP BY p_name, p_type),
k AS (SELECT *, CASE WHEN n = 'small' THEN 0 WHEN starts_with(n, 'small') THEN 1 WHEN contains(n, ' small') THEN 2 WHEN contains(n, 'small') THEN 3 END AS rank FROM p)
SELECT project, run_count, rank FROM k WHERE rank IS NOT NULL ORDER BY rank, run_count DESC, project LIMIT 40"""


def uploads(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 1000).alias("run_id"), (F.col("user_id") % 3).cast("string").alias("content_hash"), "event_id")
    return ingest.judged_uploads(events.where("event_id < 500").select("run_id", "content_hash"), events.where("event_id >= 500").select("run_id", "content_hash"))


UPLOADS = """WITH e AS (SELECT event_id, event_id % 1000 AS run_id, (user_id % 3)::VARCHAR AS content_hash FROM events), s AS (SELECT DISTINCT run_id, content_hash AS old FROM e WHERE event_id < 500),
f AS (SELECT DISTINCT run_id, content_hash FROM e WHERE event_id >= 500)
SELECT run_id, content_hash, CASE WHEN old = content_hash THEN 'existing' WHEN old IS NOT NULL THEN 'conflict' WHEN row_number() OVER (PARTITION BY run_id ORDER BY content_hash) = 1 THEN 'created' ELSE 'conflict' END AS outcome FROM f LEFT JOIN s USING (run_id)"""

def sweep(spark: SparkSession, d: str) -> DataFrame:
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("test_id"))
    return su.sweep(nations, {"region": ["north", "south", "west"], "length": ["5", "40"]})


SWEEP = """SELECT n_name || '[length=' || length || ',region=' || region || ']' AS test_id, length, region
FROM nation, (VALUES ('5'), ('40')) l(length), (VALUES ('north'), ('south'), ('west')) r(region)"""


def severity(spark: SparkSession, d: str) -> DataFrame:
    return su.suite_severity(v.runs(spark, d), NOW)


def matrix_columns(spark: SparkSession, d: str) -> DataFrame:
    return su.matrix_columns(v.cases(spark, d))


MATRIX_COLUMNS = f"""{WITH}, m AS (SELECT run_id, provider_id, prompt_id, min(idx) AS first_idx FROM cases GROUP BY run_id, provider_id, prompt_id)
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY first_idx, provider_id, prompt_id) AS place FROM m"""
CHANGES = f"""{WITH}, c AS (SELECT *, nullif(config_digest, '') AS k FROM runs)
SELECT run_id, coalesce(k <> lag(k) OVER (PARTITION BY project, suite ORDER BY created_at, run_id), false) AS config_digest_changed,
  coalesce(git_commit <> lag(git_commit) OVER (PARTITION BY project, suite ORDER BY created_at, run_id), false) AS git_commit_changed FROM c"""


def history_summary(spark: SparkSession, d: str) -> DataFrame:
    return su.history_summary(v.cases(spark, d))


HISTORY_SUMMARY = f"""{WITH}, c AS (SELECT *, output_text <> lag(output_text) OVER (PARTITION BY project, suite, case_key ORDER BY created_at, run_id) AS changed FROM cases)
SELECT project, suite, case_key, count(*) AS points, count(*) FILTER (WHERE changed) AS output_changes,
  CASE WHEN count(score) >= 2 THEN arg_min(score, (created_at, run_id)) FILTER (WHERE score IS NOT NULL) END AS first_score,
  CASE WHEN count(score) >= 2 THEN arg_max(score, (created_at, run_id)) FILTER (WHERE score IS NOT NULL) END AS last_score FROM c GROUP BY project, suite, case_key"""


def status_ranks(spark: SparkSession, d: str) -> DataFrame:
    return su.with_status_rank(v.cases(spark, d)).groupBy("status", "status_rank").agg(F.count(F.lit(1)).alias("n"))


STATUS_RANKS = f"""{WITH} SELECT status, CASE status WHEN 'fail' THEN 5 WHEN 'xpass' THEN 4 WHEN 'error' THEN 3 WHEN 'pass' THEN 2 WHEN 'xfail' THEN 1 ELSE 0 END AS status_rank, count(*) AS n FROM cases GROUP BY 1, 2"""


_Q = {
    "graded_cases": (graded, GRADED),
    "more_grades": (more_grades, MORE_GRADES),
    "suite_cells": (suite_cells, SUITE_CELLS),
    "nation_sweep": (sweep, SWEEP),
    "priced_usage": (priced, PRICED),
    "rated_usage": (rated_usage, RATED_USAGE),
    "change_attribution": (attribution, ATTRIBUTION),
    "suite_severity": (severity, SEVERITY),
    "matrix_columns": (matrix_columns, MATRIX_COLUMNS),
    "config_changes": (changes, CHANGES),
    "history_summary": (history_summary, HISTORY_SUMMARY),
    "visible_runs": (visible, VISIBLE),
    "selected_cases": (selected, SELECTED),
    "project_typeahead": (offered, OFFERED),
    "status_ranks": (status_ranks, STATUS_RANKS),
    "judged_uploads": (uploads, UPLOADS),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _Q.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _Q.items()}
