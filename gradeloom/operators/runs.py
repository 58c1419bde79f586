"""Lists of runs and cases: filters, pages, neighbours, look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import scalars
from gradeloom.operators.results import hidden_by_cache, of_suites, page

#: Default and largest page sizes.
PAGE_SIZES = {"list": (50, 200), "history": (20, 100), "matrix": (100, 500)}


def page_size(asked: int | None, kind: str = "list") -> int:
    """The page size that is given for the one asked for."""
    default, most = PAGE_SIZES[kind]
    return default if asked is None else max(1, min(asked, most))


def at_ms(moment: int | str) -> Column:
    """Milliseconds since the epoch, from such a number or a date and time text with its zone."""
    return F.lit(moment).cast("long") if isinstance(moment, int) or moment.lstrip("-").isdigit() else F.unix_millis(F.to_timestamp(F.lit(moment)))


def run_filter(
    *, project: str | None = None, suite: str | None = None, branch: str | None = None, since: int | str | None = None, until: int | str | None = None, origin: str | None = None, actor: str | None = None, status: str | None = None
) -> Column:
    """The condition of a list of runs. since and until are included; origin: ci or local; actor: who ran or who uploaded it;
    status: pass, fail (unexpected passes are failures) or error."""
    out = F.lit(True)
    for name, wanted in (("project", project), ("suite", suite), ("branch", branch)):
        out = out if wanted is None else out & (F.col(name) == wanted)
    if since is not None:
        out = out & (F.col("created_at") >= at_ms(since))
    if until is not None:
        out = out & (F.col("created_at") <= at_ms(until))
    if origin is not None:
        out = out & {"ci": F.col("ci").isNotNull(), "local": F.col("ci").isNull()}[origin]
    if actor is not None:
        out = out & ((F.col("actor") == actor) | (F.col("uploaded_by") == actor))
    if status is not None:
        unexpected = F.coalesce(F.col("xpass_count"), F.lit(0)) > 0
        failing, errored = (F.col("fail_count") > 0) | unexpected, F.col("error_count") > 0
        out = out & {"fail": failing, "error": errored, "pass": (F.col("fail_count") == 0) & (F.col("error_count") == 0) & ~unexpected}[status]
    return out


def with_tag(rows: DataFrame, tag: str) -> DataFrame:
    """Rows whose tags (an array) hold the tag."""
    return rows.where(F.array_contains("tags", tag))


def by_cache(runs: DataFrame, cached: str = "exclude") -> DataFrame:
    """Runs that were not answered from the cache alone (exclude), only those (only), or all."""
    hidden = hidden_by_cache(runs)
    return {"exclude": runs.where(~hidden), "only": runs.where(hidden), "all": runs}[cached]


def cached_hidden(runs: DataFrame) -> DataFrame:
    """One row: how many of the (otherwise filtered) runs are hidden as answered from the cache alone."""
    return runs.agg(F.count_if(hidden_by_cache(runs)).alias("cached_hidden"))


def run_page(runs: DataFrame, size: int | None = None, after: tuple | None = None) -> DataFrame:
    """Newest first with their pass rates and tokens; one row more than the page holds, if there is one."""
    rate = scalars.pass_share(F.col("pass_count"), F.col("case_count"))
    return page(runs.withColumn("pass_rate", rate), "created_at", "run_id", page_size(size), after)


def like_pattern(typed: str) -> str:
    """A pattern for LIKE that finds what was typed anywhere. % and _ stay wildcards, a backslash is one."""
    return "%" + typed.lower().replace("\\", "\\\\") + "%"


def case_filter(
    *, status: str | None = None, text: str | None = None, provider: str | None = None, prompt: str | None = None, test: str | None = None, stop_reason: str | None = None, error_class: str | None = None, empty_reason: str | None = None, cached: bool | None = None
) -> Column:
    """The condition of a list of cases. text: in the output or the name, in any case; error_class `unknown`: errored without
    a class; cached False: all that isn't known to be cached."""
    out = F.lit(True)
    for name, wanted in (("status", status), ("provider_id", provider), ("prompt_id", prompt), ("test_id", test), ("stop_reason", stop_reason)):
        out = out if wanted is None else out & (F.col(name) == wanted)
    if text is not None:
        like = like_pattern(text)
        out = out & (F.lower("output_text").like(like) | F.lower("name").like(like))
    if error_class is not None:
        unclassed = (F.col("status") == "error") & F.coalesce(F.col("error_class") == "", F.lit(True))
        out = out & (unclassed if error_class == "unknown" else F.col("error_class") == error_class)
    if empty_reason is not None:
        out = out & (F.col("empty_reason") == empty_reason) & (F.col("empty_reason") != "")
    if cached is not None:
        hit = F.coalesce(F.col("cached"), F.lit(False))
        out = out & (hit if cached else ~hit)
    return out


def case_page(cases: DataFrame, run_id: str, size: int | None = None, after: int | None = None) -> DataFrame:
    """A run's cases in its order behind a place, one more than the page holds."""
    own = cases.where(F.col("run_id") == run_id)
    own = own if after is None else own.where(F.col("idx") > after)
    return own.orderBy("idx", "case_key").limit(page_size(size) + 1)


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    """The run of that id, if it is among the (visible) runs."""
    return runs.where(F.col("run_id") == run_id)


def case_by_key(cases: DataFrame, run_id: str, case_key: str) -> DataFrame:
    return cases.where((F.col("run_id") == run_id) & (F.col("case_key") == case_key))


def local_runs(runs: DataFrame, suite: str | None = None, limit: int = 0) -> DataFrame:
    """Runs by when they started, newest first; of one suite if given; limit 0 is no limit."""
    own = runs if suite is None else runs.where(F.col("suite") == suite)
    own = own.orderBy(F.desc(F.col("created_at") - F.col("duration_ms")), F.desc("run_id"))
    return own.limit(limit) if limit else own


#: What lists of runs can be sorted by; nulls stand last in either direction (see suites.missing_last).
RUN_SORT_FIELDS = {
    "run": lambda: F.col("run_id"),
    "when": lambda: F.col("created_at"),
    "who": lambda: F.coalesce("actor", "uploaded_by"),
    "branch": lambda: F.col("branch"),
    "pass_rate": lambda: scalars.pass_share(F.col("pass_count"), F.col("case_count")),
    "cases": lambda: F.col("case_count"),
    "tokens": lambda: F.col("prompt_tokens") + F.col("completion_tokens"),
    "cost": lambda: F.col("cost_microusd"),
    "duration": lambda: F.col("duration_ms"),
    "tags": lambda: F.when(F.size("tags") > 0, F.array_join("tags", ",")),
}


def sorted_runs(runs: DataFrame, field: str, descending: bool = False) -> DataFrame:
    by = RUN_SORT_FIELDS[field]()
    return runs.orderBy(by.desc_nulls_last() if descending else by.asc_nulls_last(), F.desc("created_at"), F.desc("run_id"))


def previous_runs(runs: DataFrame) -> DataFrame:
    """run_id and the run before it in its suite, null for the first."""
    newest = Window.partitionBy("project", "suite").orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.select("run_id", F.lead("run_id").over(newest).alias("previous_run_id"))


def neighbours(rows: DataFrame, key: str, *order: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """For each row its key, the keys before and after it, its place and how many there are."""
    window = Window.partitionBy(*by).orderBy(*order)
    total = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return rows.select(*by, key, F.lag(key).over(window).alias("prev_key"), F.lead(key).over(window).alias("next_key"), F.row_number().over(window).alias("position"), total.alias("total"))


def suites_by_project(runs: DataFrame) -> DataFrame:
    """Each project's runs and distinct suites."""
    return runs.where(F.col("project").isNotNull()).groupBy("project").agg(F.count(F.lit(1)).alias("run_count"), F.count_distinct("suite").alias("suite_count"))


def set_details(runs: DataFrame, *by: str) -> DataFrame:
    """Counts of each suite's runs (by project and suite), or of each project's; empty_count is null where it is 0."""
    sums = [F.sum(c).alias(c) for c in ("pass_count", "fail_count", "error_count", "case_count")]
    latest = F.max_by(scalars.pass_share(F.col("pass_count"), F.col("case_count")), F.struct("created_at", "run_id"))
    own = of_suites(runs).groupBy(*by)
    return own.agg(F.count(F.lit(1)).alias("run_count"), F.max("created_at").alias("last_run_at"), *sums, F.nullif(F.sum("empty_count"), F.lit(0)).alias("empty_count"), latest.alias("latest_pass_rate"))


def actors_by_suite(runs: DataFrame) -> DataFrame:
    """People (not CI) who ran each suite, in order, and how many local runs it has."""
    local = of_suites(runs).where(F.col("ci").isNull())
    return local.groupBy("project", "suite").agg(F.array_join(F.array_sort(F.collect_set("actor")), ",").alias("actors"), F.count(F.lit(1)).alias("local_runs"))
