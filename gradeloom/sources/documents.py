"""Run documents: nested JSON to rows of runs, cases and tags, the local store, backfill, and what is written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import scalars
from gradeloom.sources.ingest import first_cases

ASSERT = "struct<kind: string, status: string, score: double, weight: double, reason: string, cost_usd: double, error_class: string, criteria: string>"
CASE = f"""struct<case_key: string, name: string, cell: struct<provider_id: string, prompt_id: string, test_id: string, repeat: int>, status: string, score: double, output: string, output_is_json: boolean,
  asserts: array<{ASSERT}>, usage: struct<input_tokens: long, output_tokens: long, cache_read_tokens: long, cache_write_tokens: long>, cost_usd: double, latency_ms: long, attempts: long, stop_reason: string, cached: boolean,
  cache_key: string, error: string, error_class: string, empty_reason: string, answered_by_provider_id: string, prompt_digest: string, provider_digest: string, assert_digest: string, tags: array<string>>"""
#: Schema of a run document, as far as it is queried.
RUN = f"""run_id string, schema_version int, project string, suite string, started_at timestamp, finished_at timestamp, config_digest string, description string,
  digests struct<prompts: string, providers: string, tests: string, asserts: string, grader: string>, git struct<branch: string, commit: string, dirty: boolean>, ci struct<provider: string, run_url: string>,
  origin struct<actor: string, host: string, version: string, note: string>, filters struct<tags: array<string>>, cases array<{CASE}>"""
VERSIONS = (3, 4)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run documents (one in a file) below a path; files that can't be read are left out."""
    raw = spark.read.schema(f"{RUN}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path, multiLine=True)
    return raw.where("_corrupt_record is null and run_id is not null").drop("_corrupt_record")


def local_store(spark: SparkSession, folder: str) -> DataFrame:
    """Documents <folder>/<run>/result.json, the newest first by when they finished."""
    return read_runs(spark, f"{folder}/*/result.json").orderBy(F.desc("finished_at"), F.desc("run_id"))


def accepted(documents: DataFrame) -> DataFrame:
    """Documents of the versions that uploads may have."""
    return documents.where(F.col("schema_version").isin(*VERSIONS))


def case_rows(documents: DataFrame) -> DataFrame:
    """One row for each case of each document, in its order, the first of a key. Unlike a run's sum, input_tokens are those that
    were not read from a cache. Empty texts stand for known absence."""
    c = lambda name: F.col(f"c.{name}")
    lean = F.transform(c("asserts"), lambda a: F.struct(a["kind"].alias("label"), a["kind"].alias("kind"), (a["status"] == "pass").alias("passed"), a["score"].alias("score")))
    costs = F.filter(F.transform(c("asserts"), lambda a: a["cost_usd"]), lambda x: x.isNotNull())
    grader = F.when(F.size(costs) > 0, F.aggregate(costs, F.lit(0).cast("long"), lambda s, x: s + scalars.micro_usd(F.greatest(x, F.lit(0.0)))))
    rows = documents.select("run_id", "project", "suite", F.unix_millis("finished_at").alias("created_at"), F.posexplode("cases").alias("idx", "c"))
    out = rows.select(
        "run_id", "project", "suite", "created_at", c("case_key").alias("case_key"), F.col("idx").cast("long").alias("idx"), c("name").alias("name"), c("cell.provider_id").alias("provider_id"), c("cell.prompt_id").alias("prompt_id"),
        c("cell.test_id").alias("test_id"), c("cell.repeat").alias("repeat_idx"), c("status").alias("status"), c("score").alias("score"), F.substring(c("output"), 1, 300).alias("output_preview"), c("output").alias("output_text"),
        F.sha2(c("output"), 256).alias("output_hash"), lean.alias("asserts"), c("usage.input_tokens").alias("input_tokens"), c("usage.output_tokens").alias("output_tokens"), c("usage.cache_read_tokens").alias("cache_read_tokens"),
        scalars.micro_usd(c("cost_usd")).alias("cost_microusd"), grader.alias("grader_cost_microusd"), c("latency_ms").alias("latency_ms"), F.coalesce(c("attempts"), F.lit(1)).alias("attempts"), c("stop_reason").alias("stop_reason"),
        c("cached").alias("cached"), c("cache_key").alias("cache_key"), c("error").alias("error"), c("error_class").alias("error_class"), F.coalesce(c("empty_reason"), F.lit("")).alias("empty_reason"),
        F.coalesce(c("answered_by_provider_id"), F.lit("")).alias("answered_by"), c("prompt_digest").alias("prompt_digest"), c("provider_digest").alias("provider_digest"), c("assert_digest").alias("assert_digest"), c("tags").alias("tags"),
    )
    return first_cases(out)


def run_rows(documents: DataFrame) -> DataFrame:
    """One row for each document with what lists and comparisons need; sums of cases are those of summaries.summarise()."""
    note = F.coalesce(F.col("origin.note"), F.col("description"))
    return documents.select(
        "run_id", "project", "suite", "schema_version", F.unix_millis("finished_at").alias("created_at"), F.greatest(F.unix_millis("finished_at") - F.unix_millis("started_at"), F.lit(0)).alias("duration_ms"),
        F.col("git.branch").alias("branch"), F.col("git.commit").alias("git_commit"), F.col("ci.provider").alias("ci"), F.col("ci.run_url").alias("ci_run_url"), F.col("origin.actor").alias("actor"), F.col("origin.host").alias("host"),
        F.when(F.trim(note) != "", note).alias("description"), "config_digest", *[F.col(f"digests.{p}").alias(f"{p}_digest") for p in scalars.COMPONENTS], F.coalesce("filters.tags", F.array().cast("array<string>")).alias("tags"),
        F.size("cases").cast("long").alias("case_count"), content_hash(documents).alias("content_hash"),
    )


def content_hash(documents: DataFrame) -> Column:
    """Tells whether an upload says something new under an old id."""
    return F.sha2(F.to_json(F.struct(*documents.columns)), 256)


def persisted(documents: DataFrame, folder: str) -> str:
    """Appends documents as JSON to the folder's store, and names the newest in its `latest` file; that id."""
    documents.write.mode("append").json(f"{folder}/documents")
    newest = documents.agg(F.max_by("run_id", F.struct("finished_at", "run_id")).alias("run_id"))
    newest.coalesce(1).write.mode("overwrite").text(f"{folder}/latest")
    return newest.first()[0]


def report_rows(cases: DataFrame, failed_only: bool = False) -> DataFrame:
    """Cases of a report: all, or those that fail the gate."""
    return cases.where(scalars.gate_failing(F.col("status"))) if failed_only else cases


def write_json_lines(cases: DataFrame, path: str, failed_only: bool = False) -> None:
    report_rows(cases, failed_only).write.mode("overwrite").json(path)


def _xml(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def junit(cases: DataFrame, failed_only: bool = False, by: str = "run_id") -> DataFrame:
    """One JUnit document for each run: unexpected passes are failures, expected failures are skipped. The counts are those of all
    cases. A run's report is meant to fit a row."""
    label = _xml(F.coalesce("name", "case_key"))
    message = lambda tag, text: F.concat(F.lit(f'<{tag} message="'), text, F.lit(f'"></{tag}>'))
    status = F.col("status")
    told = (
        F.when(status == "fail", message("failure", F.format_string("score %.2f", F.coalesce("score", F.lit(0.0))))).when(status == "error", message("error", _xml(F.coalesce("error_class", F.lit("error")))))
        .when(status == "skip", F.lit("<skipped></skipped>")).when(status == "xfail", message("skipped", F.lit("expected failure"))).when(status == "xpass", message("failure", F.lit("passed against expectation"))).otherwise("")
    )
    line = F.concat(F.lit('  <testcase classname="'), _xml(F.col("provider_id")), F.lit('" name="'), label, F.format_string('" time="%.3f">', F.coalesce("latency_ms", F.lit(0)) / 1000), told, F.lit("</testcase>"))
    shown = F.when(scalars.gate_failing(status), F.struct("idx", line.alias("line"))) if failed_only else F.struct("idx", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["line"])
    n = lambda *s: F.count_if(status.isin(*s)).cast("string")
    head = F.concat(F.lit('<testsuite name="'), _xml(F.coalesce(F.first("suite"), F.lit("suite"))), F.lit('" tests="'), F.count(F.lit(1)).cast("string"), F.lit('" failures="'), n("fail", "xpass"), F.lit('" errors="'), n("error"), F.lit('">'))
    return cases.groupBy(by).agg(F.concat_ws("\n", F.lit('<?xml version="1.0" encoding="UTF-8"?>'), head, lines, F.lit("</testsuite>")).alias("junit"))


def markdown(summary: DataFrame, cases: DataFrame, by: str = "run_id") -> DataFrame:
    """A short report of each run: its counts, then a table of the cases that fail the gate."""
    failing = report_rows(cases, True)
    cell = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", cell(F.coalesce("name", "case_key")), F.col("status"), F.coalesce(F.format_string("%.2f", "score"), F.lit(""))), F.lit(" |"))
    table = failing.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", row.alias("line")))), lambda x: x["line"]), "\n").alias("rows"))
    head = F.concat_ws(" \u00b7 ", F.format_string("%d passed", "n_pass"), F.format_string("%d failed", "n_fail"), F.format_string("%d errored", "n_error"), F.format_string("%d in all", "total"))
    body = F.when(F.col("rows").isNotNull(), F.concat(F.lit("\n\n| case | status | score |\n|-|-|-|\n"), F.col("rows"))).otherwise("")
    return summary.join(table, by, "left").select(by, F.concat(head, body).alias("markdown"))


def text_table(cases: DataFrame, failed_only: bool = False) -> DataFrame:
    """Columns of a report as texts, in the run's order."""
    shown = report_rows(cases, failed_only).orderBy("run_id", "idx")
    score = F.coalesce(F.format_string("%.2f", "score"), F.lit("-"))
    return shown.select("run_id", F.coalesce("name", "case_key").alias("case"), "status", score.alias("score"), scalars.human_latency(F.col("latency_ms")).alias("latency"), scalars.human_cost(F.col("cost_microusd") / 1_000_000).alias("cost"))
