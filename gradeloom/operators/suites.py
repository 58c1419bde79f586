"""Expansion of suites into cells, series and health of suites, visibility, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import scalars
from gradeloom.operators.results import of_suites, stale_suites


def _options(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def cells(tests: DataFrame, providers: list[str], prompts: list[str], repeat: int = 1, only_prompts: list[str] | None = None) -> DataFrame:
    """Each test with each provider it allows, each prompt (of only_prompts, if given) and each repeat. tests has test_id and,
    if wanted, only_providers and skip_providers (arrays; null or empty: no limit)."""
    out = tests.withColumn("provider_id", F.explode(_options(providers)))
    if "only_providers" in tests.columns:
        out = out.where(F.coalesce(F.size("only_providers") <= 0, F.lit(True)) | F.array_contains("only_providers", F.col("provider_id")))
    if "skip_providers" in tests.columns:
        out = out.where(~F.coalesce(F.array_contains("skip_providers", F.col("provider_id")), F.lit(False)))
    out = out.withColumn("prompt_id", F.explode(_options([p for p in prompts if only_prompts is None or p in only_prompts])))
    return out.withColumn("repeat_idx", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))


def sweep(tests: DataFrame, axes: dict[str, list[str]]) -> DataFrame:
    """Each test with every combination of the axes' values, in the order of their names; test_id becomes id[k=v,...]."""
    if any(not values for values in axes.values()):
        raise ValueError("an axis has no values")
    names, out = sorted(axes), tests
    for name in names:
        out = out.withColumn(name, F.explode(_options(axes[name])))
    label = F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col(n)) for n in names])
    return out.withColumn("test_id", F.concat("test_id", F.lit("["), label, F.lit("]"))) if names else out


def matrix_columns(cases: DataFrame) -> DataFrame:
    """Provider and prompt of each run's cells, placed by where they were first seen."""
    seen = cases.groupBy("run_id", "provider_id", "prompt_id").agg(F.min("idx").alias("first_idx"))
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("first_idx", "provider_id", "prompt_id")))


def change_points(runs: DataFrame, *digests: str) -> DataFrame:
    """For each digest, whether it differs from the suite's previous run; unknown counts as unchanged."""
    order = Window.partitionBy("project", "suite").orderBy("created_at", "run_id")
    return runs.withColumns({f"{d}_changed": F.coalesce(F.col(d) != F.lag(d).over(order), F.lit(False)) for d in digests})


def history_summary(cases: DataFrame) -> DataFrame:
    """Points of each case, how often its output changed, and its first and last known score where at least two are known."""
    order = Window.partitionBy("project", "suite", "case_key").orderBy("created_at", "run_id")
    changed = F.col("output_text") != F.lag("output_text").over(order)
    at = F.when(F.col("score").isNotNull(), F.struct("created_at", "run_id"))
    several = F.count("score") >= 2
    return cases.withColumn("_changed", changed).groupBy("project", "suite", "case_key").agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if("_changed").alias("output_changes"),
        F.when(several, F.min_by("score", at)).alias("first_score"),
        F.when(several, F.max_by("score", at)).alias("last_score"),
    )


def canonical_runs(runs: DataFrame, default_branch: str = "main") -> DataFrame:
    """The run that tells each suite's state: the newest CI run on the default branch, else the newest CI run."""
    on_main = F.coalesce(F.col("branch") == default_branch, F.lit(False))
    newest = Window.partitionBy("project", "suite").orderBy(F.desc(on_main), F.desc("created_at"), F.desc("run_id"))
    return runs.where(F.col("ci").isNotNull()).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def canonical_series(runs: DataFrame, default_branch: str = "main") -> DataFrame:
    """Pass rates of each suite's CI runs on the branch of its canonical run, numbered from the newest; runs that graded
    nothing are left out."""
    branch = canonical_runs(runs, default_branch).select("project", "suite", F.col("branch").alias("_branch"))
    rate = scalars.graded_share(F.col("pass_count"), F.col("fail_count"), F.col("error_count"))
    own = runs.where(F.col("ci").isNotNull()).join(branch, ["project", "suite"]).where(F.col("branch").eqNullSafe(F.col("_branch")))
    newest = Window.partitionBy("project", "suite").orderBy(F.desc("created_at"), F.desc("run_id"))
    return own.withColumn("rate", rate).where("rate is not null").select("project", "suite", "run_id", "rate", F.row_number().over(newest).alias("nth"))


def canonical_delta(runs: DataFrame, default_branch: str = "main") -> DataFrame:
    """Change of each suite's pass rate against the canonical run before, in points; null where there is none."""
    of = lambda n: F.max(F.when(F.col("nth") == n, F.col("rate")))
    return canonical_series(runs, default_branch).groupBy("project", "suite").agg(((of(1) - of(2)) * 100).alias("delta_points"))


#: Severities, the loudest first.
SEVERITIES = ("failing", "stale", "drifting", "unknown", "healthy")


def suite_severity(runs: DataFrame, now: int, default_branch: str = "main") -> DataFrame:
    """failing, stale, drifting, healthy or unknown, and the rank that suites are listed by. The canonical run decides; drifting:
    the pass rate fell between the last two runs of its series."""
    by = ["project", "suite"]
    canonical = canonical_runs(runs, default_branch).select(*by, (F.col("fail_count") + F.col("error_count")).alias("bad"))
    last = canonical_delta(runs, default_branch)
    stale = stale_suites(runs, now).select(*by, "stale")
    all_of = of_suites(runs).select(*by).distinct().join(canonical, by, "left").join(stale, by, "left").join(last, by, "left")
    level = F.when(F.col("bad").isNull(), "unknown").when(F.col("bad") > 0, "failing").when(F.col("stale"), "stale").when(F.col("delta_points") < 0, "drifting").otherwise("healthy")
    out = all_of.select(*by, level.alias("severity"))
    return out.withColumn("severity_rank", F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), F.col("severity")).cast("int") - 1)


def suite_list(runs: DataFrame, pins: DataFrame, points: int = 20) -> DataFrame:
    """Suites with their newest runs, newest first: how many of those there are (at most `points`), the time of the last one,
    their pass rates, and the pin."""
    newest = Window.partitionBy("project", "suite").orderBy(F.desc("created_at"), F.desc("run_id"))
    rate = scalars.pass_share(F.col("pass_count"), F.col("case_count"))
    near = of_suites(runs).withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= points)
    series = F.transform(F.array_sort(F.collect_list(F.struct("nth", "run_id", rate.alias("rate")))), lambda x: F.struct(x["run_id"].alias("run_id"), x["rate"].alias("pass_rate")))
    out = near.groupBy("project", "suite").agg(F.count(F.lit(1)).alias("run_count"), F.max("created_at").alias("last_run_at"), series.alias("series"))
    pinned = pins.select("project", "suite", F.col("run_id").alias("baseline_run_id"), F.col("branch").alias("baseline_branch"))
    return out.join(pinned, ["project", "suite"], "left")


def chart_series(listed: DataFrame) -> DataFrame:
    """suite_list() with its series from the oldest on, and the newest run's id."""
    return listed.withColumns({"last_run_id": F.get("series", F.lit(0))["run_id"], "series": F.reverse("series")})


def visible_runs(runs: DataFrame, restrictions: DataFrame, grants: DataFrame | None = None, user: str | None = None) -> DataFrame:
    """Runs that no restriction (project, suite; null suite: the whole project) covers, or that a grant of the user (project,
    suite, user_id) opens. Runs without a project are always visible."""
    def covered(rules: DataFrame, flag: str) -> DataFrame:
        keys = rules.select("project", "suite").distinct()
        whole = keys.where("suite is null").select("project", F.lit(True).alias(f"{flag}_project"))
        return runs_now.join(whole, "project", "left").join(keys.where("suite is not null").withColumn(f"{flag}_suite", F.lit(True)), ["project", "suite"], "left")

    runs_now = runs
    runs_now = covered(restrictions, "_shut")
    ok = F.coalesce("_shut_project", "_shut_suite").isNull()
    if grants is not None and user is not None:
        runs_now = covered(grants.where(F.col("user_id") == user), "_open")
        ok = ok | F.coalesce("_open_project", "_open_suite").isNotNull()
    return runs_now.where(ok | F.col("project").isNull()).select(*runs.columns)


def select_cases(cases: DataFrame, selector: str) -> DataFrame:
    """Cases that a selector names: by key, else by the beginning of the key (four characters at least), else by test id,
    else by a part of the name in any case. The first way that finds any in a run counts; an empty selector names none."""
    if not selector:
        return cases.withColumn("tier", F.lit(None).cast("int")).where(F.lit(False))
    key = F.col("case_key")
    tier = F.when(key == selector, 1)
    if len(selector) >= 4:
        tier = tier.when(key.startswith(selector), 2)
    tier = tier.when(F.col("test_id") == selector, 3).when(F.contains(F.lower("name"), F.lit(selector.lower())), 4)
    found = cases.withColumn("tier", tier).where("tier is not null")
    return found.withColumn("_best", F.min("tier").over(Window.partitionBy("run_id"))).where("tier = _best").drop("_best")


def select_any(cases: DataFrame, selectors: list[str]) -> DataFrame:
    """Cases that any of the selectors names, each once, in the run's order."""
    if not selectors:
        return cases.where(F.lit(False))
    keys = None
    for s in selectors:
        own = select_cases(cases, s).select("run_id", "case_key")
        keys = own if keys is None else keys.union(own)
    return cases.join(keys.distinct(), ["run_id", "case_key"], "left_semi").orderBy("run_id", "idx")


def suggestions(cases: DataFrame, selectors: list[str], most: int = 5) -> DataFrame:
    """The cases of each run that come closest to selectors which named none: equal 100, beginning 80, part 60, a part of the
    selector 40, else the length of the common beginning; ties in the run's order."""

    def score(text, selector: str):
        t, s = F.lower(text), selector.lower()
        common = F.lit(0)
        for k in range(1, len(s) + 1):
            common = F.when(t.startswith(s[:k]), k).otherwise(common)
        inside = F.contains(F.lit(s), t)
        best = F.when(t == s, 100).when(t.startswith(s), 80).when(F.contains(t, F.lit(s)), 60).when(inside, 40).otherwise(common)
        return F.coalesce(F.when(F.lit(bool(s)), best), F.lit(0))

    own = F.greatest(F.lit(0), F.lit(0), *[score(F.col(c), s) for c in ("case_key", "test_id", "name") for s in selectors])
    closest = Window.partitionBy("run_id").orderBy(F.desc("score"), "idx", "case_key")
    return cases.select("run_id", "case_key", "idx", own.alias("score")).withColumn("nth", F.row_number().over(closest)).where(F.col("nth") <= most)


def typeahead(projects: DataFrame, typed: str, most: int = 10) -> DataFrame:
    """Projects (project, run_count) whose name fits what was typed: equal, then beginning, then a word's beginning, then
    anywhere; more runs first. Dashes, underscores and blanks are alike; where nothing was typed nothing fits."""
    fold = lambda c: F.btrim(F.regexp_replace(F.lower(c), r"[-_\s]+", " "))
    name, q = fold(F.col("project")), " ".join(typed.lower().replace("-", " ").replace("_", " ").split())
    if not q:
        return projects.select("project", "run_count", F.lit(None).cast("int").alias("rank")).where(F.lit(False))
    rank = F.when(name == q, 0).when(name.startswith(q), 1).when(F.contains(name, F.lit(f" {q}")), 2).when(F.contains(name, F.lit(q)), 3)
    return projects.select("project", "run_count", rank.alias("rank")).where("rank is not null").orderBy("rank", F.desc("run_count"), "project").limit(most)


def missing_last(df: DataFrame, column: str, key: str, descending: bool = False) -> DataFrame:
    """Sorted by a column, missing values last in both directions, ties by key."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), key)


def with_status_rank(cases: DataFrame) -> DataFrame:
    return cases.withColumn("status_rank", scalars.status_rank(F.col("status")))
