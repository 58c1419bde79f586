"""Chains of providers that take over from each other, and modes of the cache, over recorded attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Error classes on which a provider hands over, and the empty reasons on which it does by default.
HAND_OVER_ERRORS = ("provider_auth", "provider_unavailable", "provider_timeout", "provider_protocol", "provider_rate_limit", "exec_failed")
HAND_OVER_REASONS = ("refusal", "content_filter")


def hands_over(reason: Column, error_class: Column, reasons: tuple[str, ...] = HAND_OVER_REASONS) -> Column:
    """Whether an attempt makes the next provider try."""
    by_error = F.coalesce(error_class.isin(*HAND_OVER_ERRORS), F.lit(False))
    return F.when(error_class.isNotNull(), by_error).otherwise(F.coalesce(reason.isin(*reasons), F.lit(False)))


def chain_of(primary: Column, links: Column, only: Column, skip: Column, built: Column) -> Column:
    """The providers that a test's chain may use (arrays of ids; null or empty `only` is no limit): in order, each once,
    neither the primary, nor excluded by the test, nor one that could not be built."""
    allowed = lambda p: (p != primary) & ((F.coalesce(F.size(only), F.lit(0)) <= 0) | F.array_contains(only, p))
    kept = lambda p: allowed(p) & ~F.coalesce(F.array_contains(skip, p), F.lit(False)) & F.array_contains(built, p)
    return F.filter(F.array_distinct(links), kept)


def settled(attempts: DataFrame, *cell: str, reasons: tuple[str, ...] = HAND_OVER_REASONS, walks: Column | bool = True, aborted_at: Column | None = None) -> DataFrame:
    """The attempt that answers each cell, of attempts (cell, link: 0 is the primary, provider_id, empty_reason, error_class): the
    first that doesn't hand over, if it is the primary or has no error; else the primary, and then nothing counts as passed
    over. passed_over: the providers that handed over before. walks: whether a cell's chain is walked at all; where it isn't (fallbacks are
    off, the cache is read only, or the cell has a latency assertion), the primary's attempt stands alone. aborted_at: the link
    before which the run was aborted, if it was; that one and later ones are never called."""
    own = F.lit(walks) if isinstance(walks, bool) else F.coalesce(walks, F.lit(True))
    called = own if aborted_at is None else own & F.coalesce(F.col("link") < aborted_at, F.lit(True))
    attempts = attempts.where((F.col("link") == 0) | called)
    marked = attempts.withColumn("_over", hands_over(F.col("empty_reason"), F.col("error_class"), reasons))
    by = [F.col(c) for c in cell]
    stop = marked.groupBy(*by).agg(
        F.min(F.when(~F.col("_over"), F.col("link"))).alias("_stop"),
        F.array_sort(F.collect_list(F.struct("link", "provider_id", "empty_reason", "error_class"))).alias("_all"),
    )
    at = F.get(F.filter("_all", lambda a: a["link"] == F.col("_stop")), F.lit(0))
    improved = F.col("_stop").isNotNull() & ((F.col("_stop") == 0) | at["error_class"].isNull())
    chosen = F.when(improved, at).otherwise(F.get("_all", F.lit(0)))
    over = F.when(improved, F.transform(F.filter("_all", lambda a: a["link"] < F.col("_stop")), lambda a: a["provider_id"])).otherwise(F.array().cast("array<string>"))
    out = stop.select(*by, chosen.alias("a"), over.alias("passed_over"))
    return out.select(*by, F.col("a.provider_id").alias("provider_id"), "a.empty_reason", "a.error_class", "passed_over", F.when(F.col("a.link") > 0, F.col("a.provider_id")).alias("answered_by"))


def under_mode(requests: DataFrame, stored: DataFrame, mode: str = "read_write") -> DataFrame:
    """What becomes of each request (cache_key): answered from the cache (hit), by a call (call), or an error, and whether the
    answer is stored. Modes: read_write; disabled neither reads nor writes; read_only_strict takes a miss for the error
    cache_miss. Of calls with one key, the first is stored."""
    there = stored.select("cache_key", F.lit(True).alias("_there")).distinct()
    hit = F.col("_there").isNotNull() if mode != "disabled" else F.lit(False)
    miss = F.when(F.lit(mode == "read_only_strict"), "cache_miss").otherwise("call")
    out = requests.join(there, "cache_key", "left").withColumn("outcome", F.when(hit, "hit").otherwise(miss)).drop("_there")
    first = F.row_number().over(Window.partitionBy("cache_key").orderBy("request_id")) == 1
    return out.withColumn("stored", first & (F.col("outcome") == "call") & F.lit(mode == "read_write"))


def empty_run(requested: list[str], providers: list[dict], test_ids: list[str], matched: int) -> dict | None:
    """Why a run would have no cells, or less than was asked for; null if it has what was asked for. providers: dicts of id and, if
    so, fallback_only or embeddings."""
    able = [p["id"] for p in providers if not p.get("fallback_only") and not p.get("embeddings")]
    known = {p["id"]: p for p in providers}
    unknown = [r for r in requested if r not in known]
    if unknown:
        return {"why": "unknown_providers", "ids": unknown, "available": able}
    for flag in ("fallback_only", "embeddings"):
        held = [r for r in requested if known[r].get(flag)]
        if held:
            return {"why": flag, "ids": held, "available": able}
    if not able:
        return {"why": "no_providers", "ids": [], "available": []}
    if not test_ids:
        return {"why": "no_tests", "ids": [], "available": able}
    return None if matched else {"why": "filtered_out", "ids": test_ids[:5], "available": able}
