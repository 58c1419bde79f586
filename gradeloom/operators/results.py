"""Operators on runs and cases: comparison, pivots, series, selection, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import scalars
from gradeloom.functions import statistics as st

GRADED = ("pass", "fail", "error", "xfail", "xpass")


def of_suites(runs: DataFrame) -> DataFrame:
    """Runs that belong to a project and a suite."""
    return runs.where(F.col("project").isNotNull() & F.col("suite").isNotNull())


def latest_runs(runs: DataFrame, nth: int = 1) -> DataFrame:
    """The nth newest run of each project and suite (ties by id)."""
    newest = Window.partitionBy("project", "suite").orderBy(F.desc("created_at"), F.desc("run_id"))
    return of_suites(runs).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == nth).drop("_n")


def last_pairs(cases: DataFrame, runs: DataFrame, base: int = 3, head: int = 2) -> DataFrame:
    """Cases of each suite's base-th and head-th newest run side by side, as compare() gives them; runs are ranked once and
    read once."""
    newest = Window.partitionBy("project", "suite").orderBy(F.desc("created_at"), F.desc("run_id"))
    ranked = of_suites(runs).select("run_id", F.row_number().over(newest).alias("nth")).where(F.col("nth").isin(base, head))
    own = cases.join(ranked, "run_id")
    return compare(own.where(F.col("nth") == base), own.where(F.col("nth") == head))


def compare(base: DataFrame, head: DataFrame, by: tuple[str, ...] = ("project", "suite")) -> DataFrame:
    """Cases of two sets of runs side by side (full outer), with their delta and whether the output changed."""
    side = lambda df, name: df.select(*by, "case_key", *[F.col(c).alias(f"{name}_{c}") for c in ("status", "score", "output_text")])
    both = side(base, "base").join(side(head, "head"), [*by, "case_key"], "full_outer")
    changed = F.col("base_status").isNotNull() & F.col("head_status").isNotNull() & ~F.col("base_output_text").eqNullSafe(F.col("head_output_text"))
    return both.withColumns({"delta": st.delta(F.col("base_status"), F.col("head_status")), "output_changed": changed, "score_delta": F.col("head_score") - F.col("base_score")})


def compare_summary(compared: DataFrame, *by: str) -> DataFrame:
    count = lambda name: F.count_if(F.col("delta") == name).alias(name)
    out = compared.groupBy(*by).agg(*[count(d) for d in ("newly_failing", "newly_passing", "still_failing", "still_passing", "unchanged", "added", "removed")], F.count_if("output_changed").alias("output_changed"),
                                    F.count_if(F.col("head_status").isin("pass", "xpass")).alias("head_pass"), F.count_if(F.col("head_status").isin(*GRADED)).alias("head_graded"))
    low, high = st.wilson(F.col("head_pass"), F.col("head_graded"))
    test = st.mcnemar(F.col("newly_failing"), F.col("newly_passing"))
    return out.withColumns({"wilson_low": low, "wilson_high": high, "mcnemar": test, "significant": test > 3.841})


def matrix(cases: DataFrame) -> DataFrame:
    """One cell per test, provider and prompt. Unknown scores, latencies and costs are left out of their means and sums; a cell
    counts repeats that a fallback answered, but skipped ones."""
    n = F.count(F.lit(1))
    fell_back = F.coalesce(F.col("answered_by") != "", F.lit(False)) & (F.col("status") != "skip")
    outputs = F.count_distinct(F.when(F.col("output_text").isNotNull(), F.xxhash64("output_text")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("repeat_idx", "idx", "case_key"))), lambda x: x["case_key"])
    return cases.groupBy("run_id", "test_id", "provider_id", "prompt_id").agg(
        n.alias("total"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in (*GRADED, "skip")],
        F.avg("score").alias("score_mean"),
        F.avg("latency_ms").alias("latency_mean"),
        F.sum("cost_microusd").alias("cost_microusd"),
        outputs.alias("distinct_outputs"),
        (F.count_if(F.col("status") == "pass") / n).alias("pass_fraction"),
        F.count_if(fell_back).alias("fallback_answered"),
        F.array_join(ordered, ",").alias("case_keys"),
    )


def matrix_rows(cases: DataFrame) -> DataFrame:
    """Tests of each run, placed by where they were first seen, with the first name that is known."""
    named = F.when(F.col("name").isNotNull(), F.struct("idx", "case_key"))
    seen = cases.groupBy("run_id", "test_id").agg(F.min("idx").alias("first_idx"), F.min_by("name", named).alias("name"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("first_idx", "test_id")))


def matrix_page(rows: DataFrame, limit: int, after: int | None = None) -> DataFrame:
    """limit + 1 rows of one run's matrix_rows() behind a first_idx, so the caller sees whether more follow."""
    later = rows if after is None else rows.where(F.col("first_idx") > after)
    return later.orderBy("first_idx", "test_id").limit(limit + 1)


def suite_rollup(runs: DataFrame) -> DataFrame:
    low, high = st.wilson(F.col("passed"), F.col("n_cases"))
    return runs.groupBy("project", "suite").agg(F.count(F.lit(1)).alias("run_count"), F.max("created_at").alias("last_run_at"), F.sum("pass_count").alias("passed"), F.sum("case_count").alias("n_cases"), F.sum("cost_microusd").alias("cost_microusd")).withColumns({"wilson_low": low, "wilson_high": high})


def sparkline(runs: DataFrame, points: int = 20) -> DataFrame:
    """The last runs of each suite with their place (1: newest) and pass rate: passed cases of all, 0 without cases."""
    newest = Window.partitionBy("project", "suite").orderBy(F.desc("created_at"), F.desc("run_id"))
    placed = of_suites(runs).withColumn("place", F.row_number().over(newest)).where(F.col("place") <= points)
    return placed.select("project", "suite", "run_id", "place", scalars.pass_share(F.col("pass_count"), F.col("case_count")).alias("pass_rate"))


def history(cases: DataFrame, limit: int = 20) -> DataFrame:
    """The newest points of each case, and whether the output differs from the next older one in the page."""
    newest = Window.partitionBy("project", "suite", "case_key").orderBy(F.desc("created_at"), F.desc("run_id"))
    page = cases.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= limit)
    older = F.lead("output_text").over(newest)
    return page.select("project", "suite", "case_key", "run_id", "place", "status", (F.col("output_text") != older).alias("output_changed"))


def cached_islands(cases: DataFrame, least: int = 2) -> DataFrame:
    """Segments of each case's history: least or more cached points in a row make one collapsed segment, every other point is
    one of its own."""
    order = Window.partitionBy("project", "suite", "case_key").orderBy("created_at", "run_id")
    by_flag = Window.partitionBy("project", "suite", "case_key", "flag").orderBy("created_at", "run_id")
    marked = cases.withColumn("flag", F.coalesce(F.col("cached"), F.lit(False)))
    marked = marked.withColumns({"nth": F.row_number().over(order), "island": F.row_number().over(order) - F.row_number().over(by_flag)})
    size = F.count(F.lit(1)).over(Window.partitionBy("project", "suite", "case_key", "flag", "island"))
    marked = marked.withColumn("collapsed", F.col("flag") & (size >= least))
    single = F.when(~F.col("collapsed"), F.col("nth"))
    segments = marked.groupBy("project", "suite", "case_key", "collapsed", "flag", "island", single.alias("alone"))
    out = segments.agg(F.count(F.lit(1)).alias("points"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    return out.drop("flag", "island", "alone")


def provider_costs(cases: DataFrame) -> DataFrame:
    """Cases and cost of each run by the provider that answered, the configured one if none is recorded; skipped ones too."""
    answering = F.coalesce(F.nullif("answered_by", F.lit("")), F.col("provider_id"))
    return cases.groupBy("run_id", answering.alias("provider_id")).agg(F.count(F.lit(1)).alias("n_cases"), F.sum("cost_microusd").alias("cost_microusd"))


def error_tally(cases: DataFrame) -> DataFrame:
    """Errored cases by class ('' and null: unknown), with their share in the project."""
    tally = cases.where("status = 'error'").groupBy("project", F.coalesce(F.nullif("error_class", F.lit("")), F.lit("unknown")).alias("error_class")).agg(F.count(F.lit(1)).alias("n"))
    return tally.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("project")))


def pass_at_k(cases: DataFrame, k: int = 1) -> DataFrame:
    """Macro average of pass@k over tests by provider and prompt; null if no test of a run was repeated."""
    groups = cases.groupBy("run_id", "provider_id", "prompt_id", "test_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "pass").alias("c"))
    repeated = F.max("n") > 1
    return groups.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_groups"), F.when(repeated, F.avg(st.pass_at_k(F.col("n"), F.col("c"), k))).alias("pass_at_k"))


def composite(cases: DataFrame, runs: DataFrame, branch: str = "main", lookback: int = 20, exclude: str | None = None) -> DataFrame:
    """Each case's newest result among the branch's newest runs of its suite; exclude: a run that is left out before they are counted, as the one
    that is compared with its own branch."""
    runs = runs if exclude is None else runs.where(F.col("run_id") != exclude)
    newest = Window.partitionBy("project", "suite").orderBy(F.desc("created_at"), F.desc("run_id"))
    near = runs.where(F.col("branch") == branch).withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= lookback).select("run_id", "rank")
    first = Window.partitionBy("project", "suite", "case_key").orderBy("rank", "idx")
    return cases.join(near, "run_id").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def composite_run(merged: DataFrame, runs: DataFrame, branch: str = "main", lookback: int = 20, exclude: str | None = None) -> DataFrame:
    """A run for each suite of composite(): all of summarise() over the merged cases, with the id, time and digests of the run that stands for it, no commit,
    the contributing runs and whether older runs may hold more."""
    from gradeloom.operators import summaries

    told = composite_summary(merged, runs, branch, lookback, exclude).drop("case_count", "pass_count")
    kept = [c for c in ("created_at", "actor", "config_digest", "prompts_digest", "providers_digest", "tests_digest", "asserts_digest", "grader_digest") if c in runs.columns]
    newest = runs.select(F.col("run_id").alias("skeleton"), *kept)
    out = summaries.summarise(merged, "project", "suite").join(told, ["project", "suite"]).join(newest, "skeleton")
    named = F.concat(F.lit(f"composite-{branch}-"), F.col("skeleton"))
    return out.withColumns({"run_id": named, "branch": F.lit(branch), "git_commit": F.lit(None).cast("string")})


def composite_summary(merged: DataFrame, runs: DataFrame, branch: str = "main", lookback: int = 20, exclude: str | None = None) -> DataFrame:
    """For each suite of composite(): its case and pass counts anew, the runs that contributed, newest first, the run whose
    configuration stands for it, and whether older runs of the branch may hold more (the last one looked at contributed)."""
    runs = runs if exclude is None else runs.where(F.col("run_id") != exclude)
    one = merged.groupBy("project", "suite").agg(
        F.count(F.lit(1)).alias("case_count"),
        F.count_if(F.col("status") == "pass").alias("pass_count"),
        F.array_sort(F.collect_set(F.struct("rank", "run_id"))).alias("by_rank"),
    )
    there = runs.where(F.col("branch") == branch).groupBy("project", "suite").agg(F.count(F.lit(1)).alias("on_branch"))
    ids = F.transform("by_rank", lambda x: x["run_id"])
    cut = (F.element_at("by_rank", -1)["rank"] == lookback) & (F.col("on_branch") > lookback)
    out = one.join(there, ["project", "suite"])
    return out.select("project", "suite", "case_count", "pass_count", F.array_join(ids, ",").alias("contributors"), F.get(ids, F.lit(0)).alias("skeleton"), cut.alias("truncated"))


def expired_runs(runs: DataFrame, now: int, window_ms: int, pins: DataFrame | None = None) -> DataFrame:
    """Runs older than the window, and whether they are kept: the newest (ties too) of their project, suite and branch, and
    runs that are pinned as a baseline. A pin of a branch keeps no run."""
    newest = Window.partitionBy("project", "suite", "branch").orderBy(F.desc("created_at"))
    marked = runs.withColumn("kept", F.rank().over(newest) == 1).where(F.col("created_at") < now - window_ms)
    if pins is not None:
        held = pins.where("run_id is not null").select("run_id", F.lit(True).alias("_held")).distinct()
        marked = marked.join(held, "run_id", "left").withColumn("kept", F.col("kept") | F.coalesce("_held", F.lit(False)))
    return marked.select("run_id", "kept")


def swept(expired: DataFrame) -> DataFrame:
    """One row: how many expired runs go and how many are kept."""
    return expired.agg(F.count_if(~F.col("kept")).alias("deleted"), F.count_if("kept").alias("kept"))


def without_runs(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of runs, cases, tags or search texts but those of the runs that go; each table is rewritten with it."""
    return rows.join(gone.select("run_id").distinct(), "run_id", "left_anti")


def evict_lru(entries: DataFrame, target: int, spans: int = 128) -> DataFrame:
    """Entries to evict, least recently used first (those without an access before all), until the rest fits the target. Running
    sums are taken in spans of last access with about equal numbers of entries, after one sum per span, so no task orders the
    whole table; entries of one moment stay together."""
    at = F.coalesce(F.col("last_access_at"), F.lit(-(1 << 62)))
    bounds = entries.agg(F.percentile_approx(at, [k / spans for k in range(1, spans)], 10_000)).first()[0] or []
    bounds = sorted(set(bounds))
    span = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b < at)) if bounds else F.lit(0)
    placed = entries.withColumns({"_at": at, "_span": span})
    sums = placed.groupBy("_span").agg(F.sum("size").alias("in_span"))
    before = F.coalesce(F.sum("in_span").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("_span", F.sum("in_span").over(Window.partitionBy()).alias("_total"), before.alias("_before"))  # `spans` rows
    order = Window.partitionBy("_span").orderBy("_at", "entry_key").rowsBetween(Window.unboundedPreceding, 0)
    earlier = F.col("_before") + F.sum("size").over(order) - F.col("size")
    out = placed.join(F.broadcast(starts), "_span").withColumn("_earlier", earlier)
    return out.where(F.col("_total") - F.col("_earlier") > target).select("entry_key", "size", "last_access_at")


def facets(entries: DataFrame, column: str, most: int = 100) -> DataFrame:
    return entries.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most)


def page(df: DataFrame, sort: str, key: str, size: int, after: tuple | None = None) -> DataFrame:
    """Keyset page: descending by sort, then key; size + 1 rows, so the caller sees whether more follow."""
    if after is not None:
        df = df.where((F.col(sort) < after[0]) | ((F.col(sort) == after[0]) & (F.col(key) < after[1])))
    return df.orderBy(F.desc(sort), F.desc(key)).limit(size + 1)


def hidden_by_cache(runs: DataFrame) -> Column:
    """True for runs answered from the cache alone; null counters never hide a run."""
    return F.coalesce((F.col("cache_misses") == 0) & (F.col("cache_hits") > 0), F.lit(False))


def stale_suites(runs: DataFrame, now: int, day_ms: int = 86_400_000) -> DataFrame:
    """Suites whose newest CI run is older than three median gaps (a day at least); fewer than two CI runs are never stale."""
    order = Window.partitionBy("project", "suite").orderBy("created_at", "run_id")
    gaps = runs.where(F.col("ci").isNotNull()).withColumn("gap", F.col("created_at") - F.lag("created_at").over(order))
    by = gaps.groupBy("project", "suite").agg(F.count(F.lit(1)).alias("ci_runs"), F.max("created_at").alias("newest"), F.median("gap").alias("median_gap"))
    return by.withColumn("stale", (F.col("ci_runs") >= 2) & F.coalesce(F.lit(now) - F.col("newest") > F.greatest(3 * F.col("median_gap"), F.lit(float(day_ms))), F.lit(False)))


def gate(compared: DataFrame, cases: DataFrame, *, share_failed: bool = False, baseline_unresolved: bool = False, by: str = "project") -> DataFrame:
    """Exit code for each group: 3 a fault of the harness or a failed upload; 2 a fault of the suite, an unresolved baseline, nothing
    graded, or fallbacks alone having answered; 1 failing, unexpectedly passing or regressed; else 0. A regression is a case
    that passed and doesn't any more, whatever it does instead."""
    errored = F.col("status") == "error"
    suite_fault = F.coalesce(F.col("error_class").isin(*scalars.SUITE_FAULTS), F.lit(False))
    graded = F.col("status") != "skip"
    by_case = cases.groupBy(by).agg(
        F.max(F.when(errored, F.when(suite_fault, 2).otherwise(3)).otherwise(0)).alias("fault"),
        F.count_if(F.col("status").isin("fail", "xpass")).alias("failing"),
        F.count_if(graded).alias("graded"),
        F.count_if(graded & F.coalesce(F.col("answered_by") != "", F.lit(False))).alias("fell_back"),
    )
    moved = st.document_delta(F.col("base_status"), F.col("head_status"))
    regressed = compared.groupBy(by).agg(F.count_if(moved == "newly_failing").alias("regressed"))
    both = by_case.join(regressed, by, "left").withColumn("regressed", F.coalesce("regressed", F.lit(0)))
    code = (
        F.when(F.lit(share_failed) | (F.col("fault") == 3), 3).when(F.col("fault") == 2, 2).when(F.lit(baseline_unresolved), 2)
        .when(F.col("graded") == 0, 2).when(F.col("fell_back") == F.col("graded"), 2).when((F.col("failing") > 0) | (F.col("regressed") > 0), 1).otherwise(0)
    )
    return both.select(by, code.alias("exit_code"), "failing", "regressed")
