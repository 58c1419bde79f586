"""Cache entries: first write wins, lookups with counters, tiers, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions import scalars
from gradeloom.operators import search
from gradeloom.operators.results import evict_lru


def put(stored: DataFrame, offered: DataFrame) -> DataFrame:
    """Offered entries to append: those whose key isn't stored, the earliest (created_at, then size) of each key."""
    first = Window.partitionBy("entry_key").orderBy("created_at", "size")
    fresh = offered.join(stored.select("entry_key"), "entry_key", "left_anti")
    return fresh.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def lookups(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Each requested key (entry_key, ts) with its hits, misses and, if it is stored, when it was last asked for."""
    there = stored.select("entry_key", F.lit(True).alias("_there")).distinct()
    by_key = requests.groupBy("entry_key").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    known = F.coalesce("_there", F.lit(False))
    both = by_key.join(there, "entry_key", "left")
    zero = F.lit(0).cast("long")
    return both.select("entry_key", F.when(known, F.col("n")).otherwise(zero).alias("hits"), F.when(known, zero).otherwise(F.col("n")).alias("misses"), F.when(known, F.col("last")).alias("last_access_at"))


def layered(near: DataFrame, far: DataFrame) -> DataFrame:
    """Entries of the near tier, and those of the far tier that it lacks."""
    return near.unionByName(far.join(near.select("entry_key"), "entry_key", "left_anti"))


def holds(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests (entry_key and more) whose key is stored. A probe counts neither as hit nor as miss."""
    return requests.join(stored.select("entry_key"), "entry_key", "left_semi")


def touched(stored: DataFrame, probes: DataFrame) -> DataFrame:
    """stored with the last access moved on to each key's newest probe (entry_key, ts)."""
    newest = probes.groupBy("entry_key").agg(F.max("ts").alias("_ts"))
    return stored.join(newest, "entry_key", "left").withColumn("last_access_at", F.greatest("last_access_at", "_ts")).drop("_ts")


def without(stored: DataFrame, entry_key) -> DataFrame:
    """stored without that entry."""
    return stored.where(F.col("entry_key") != entry_key)


def entry_filter(
    *, kind: str | None = None, model: str | None = None, empty_reason: str | None = None, since: int | None = None, until: int | None = None, min_cost: int | None = None, max_cost: int | None = None, text: str | None = None, by_words: bool = True
) -> Column:
    """The condition of a list of entries. kind can be `unindexed` or `unparseable`; bounds are included; text: words that stand
    in request_summary or output_preview (or, not by words, a part of them in any case). A text without words finds nothing."""
    out = F.lit(True)
    if kind is not None:
        out = out & {"unindexed": F.col("indexed_at").isNull(), "unparseable": ~F.col("index_ok")}.get(kind, F.col("kind") == kind)
    for name, wanted in (("model", model), ("empty_reason", empty_reason)):
        out = out if wanted is None else out & (F.col(name) == wanted)
    for bound, c in ((since, F.col("created_at") >= F.lit(since)), (until, F.col("created_at") <= F.lit(until)), (min_cost, F.col("cost_microusd") >= F.lit(min_cost)), (max_cost, F.col("cost_microusd") <= F.lit(max_cost))):
        out = out if bound is None else out & c
    if text is not None:
        shown = F.concat_ws(" ", "request_summary", "output_preview")
        if not by_words:
            return out & F.contains(F.lower(shown), F.lit(text.lower()))
        words = search.terms_of(text)
        own = search.tokens(shown)
        found = F.lit(bool(words))
        for w in words:
            found = found & F.array_contains(own, w)
        out = out & found
    return out


#: What lists of entries can be sorted by; entries without a value are left out of the last four.
SORTS = {"created": "created_at", "last_access": "last_access_at", "size": "size", "key": "entry_key", "cost": "cost_microusd", "kind": "kind", "model": "model", "tokens": "input_tokens + output_tokens"}
KNOWN_ONLY = ("cost", "kind", "model", "tokens")


def entry_page(entries: DataFrame, sort: str = "created", descending: bool = True, size: int = 50, after: tuple | None = None) -> DataFrame:
    """A page of entries with sort_value, in either direction, ties by key; size + 1 rows, so the caller sees whether more
    follow. after: the last row's sort_value and key."""
    own = entries.withColumn("sort_value", F.expr(SORTS[sort]))
    if sort in KNOWN_ONLY:
        own = own.where("sort_value is not null")
    value, key = F.col("sort_value"), F.col("entry_key")
    if after is not None:
        behind = (lambda c, x: c < x) if descending else (lambda c, x: c > x)
        own = own.where(behind(value, F.lit(after[0])) | ((value == F.lit(after[0])) & behind(key, F.lit(after[1]))))
    return own.orderBy(*([value.desc_nulls_last(), key.desc()] if descending else [value.asc_nulls_first(), key.asc()])).limit(size + 1)


def cursor_of(value, key: str) -> str:
    """sort_value and key as one text; texts are written in hex, as they may hold colons."""
    return f"{value}:{key}" if isinstance(value, int) else f"t:{str(value).encode().hex()}:{key}"


def from_cursor(cursor: str) -> tuple | None:
    """The pair that cursor_of() wrote; null for anything else."""
    first, cut, rest = cursor.partition(":")
    try:
        if first == "t":
            text, cut, rest = rest.partition(":")
            return (bytes.fromhex(text).decode(), rest) if cut else None
        return (int(first), rest) if cut else None
    except ValueError:
        return None


def stats(entries: DataFrame, counted: DataFrame) -> DataFrame:
    """One row: entries, their bytes, the oldest, those not indexed yet, and the hits and misses of lookups()."""
    own = entries.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.min("created_at").alias("oldest_at"), F.count_if(F.col("indexed_at").isNull()).alias("unindexed"))
    asked = counted.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("misses"), F.lit(0)).alias("misses"))
    return own.join(F.broadcast(asked), F.lit(True))  # one row each


def entry_detail(entries: DataFrame, entry_key) -> DataFrame:
    """The entry of that key, with whether it is indexed and could be read."""
    return entries.where(F.col("entry_key") == entry_key).withColumns({"indexed": F.col("indexed_at").isNotNull(), "parseable": F.col("index_ok")})


def entry_runs(cases: DataFrame, runs: DataFrame, cache_key: str, size: int = 50, after: tuple | None = None) -> DataFrame:
    """Cases that an entry answered, by their runs, newest first; size + 1 rows. after: the last row's created_at, run_id and case_key, so that
    a run's cases can go over several pages."""
    own = cases.where(F.col("cache_key") == cache_key).select("run_id", "case_key", "name", "status", F.coalesce("cached", F.lit(False)).alias("cached"))
    met = own.join(runs.select("run_id", "project", "suite", "created_at"), "run_id")
    if after is not None:
        at, run_id, case_key = after
        later = (F.col("run_id") < run_id) | ((F.col("run_id") == run_id) & (F.col("case_key") > case_key))
        met = met.where((F.col("created_at") < at) | ((F.col("created_at") == at) & later))
    return met.orderBy(F.desc("created_at"), F.desc("run_id"), "case_key").limit(size + 1)


#: Kinds of entries by what a stored verdict calls itself.
VERDICT_KINDS = {"rubric": "judge", "exec": "exec_assert", "similarity": "similar_verdict"}


def inferred_kind(kind: Column, verdict: Column, request: Column, output: Column, attempts: Column, latency: Column) -> Column:
    """An entry's kind: the one it states, else by its verdict's (JSON with kind), its exec request's envelope, an output of nothing
    but `dims`, or by what only providers record; null where nothing tells."""
    of = lambda c, path: F.get_json_object(c, path)
    named = F.create_map(*[F.lit(x) for pair in VERDICT_KINDS.items() for x in pair])[of(verdict, "$.kind")]
    envelope = F.when(of(request, "$.transport") == "exec", F.regexp_extract(of(request, "$.stdin"), r'"kind"\s*:\s*"(provider|assert)"', 1))
    by_request = F.when(envelope == "provider", "provider").when(envelope == "assert", "exec_assert")
    dims = F.when(F.json_object_keys(output) == F.array(F.lit("dims")), "embedding")
    return F.coalesce(kind, named, by_request, dims, F.when(attempts.isNotNull() | latency.isNotNull(), "provider"))


def indexed(bodies: DataFrame, now: int) -> DataFrame:
    """What lists show of entries, derived from their bodies (entry_key, body as JSON) in one pass: kind, model, tokens, cost,
    where the request went, the beginning of the output, the empty reason, and whether the body could be read."""
    # Each body is parsed once; get_json_object would parse it for each field.
    read = bodies.select("entry_key", F.try_parse_json("body").alias("_v"))
    of = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    told = read.select(
        "entry_key", F.col("_v").isNotNull().alias("index_ok"), of("$.cost_usd", "double").alias("usd"), F.coalesce(of("$.request.body.model"), of("$.model")).alias("model"), of("$.kind").alias("kind"), of("$.verdict").alias("verdict"),
        of("$.request").alias("request"), of("$.output").alias("output"), of("$.attempts").alias("attempts"), of("$.provider_latency_ms").alias("latency"), of("$.usage.input_tokens", "long").alias("input_tokens"),
        of("$.usage.output_tokens", "long").alias("output_tokens"), of("$.empty_reason").alias("reason"),
    )
    c = F.col
    return told.select(
        "entry_key",
        "index_ok",
        F.lit(now).cast("long").alias("indexed_at"),
        inferred_kind(c("kind"), c("verdict"), c("request"), c("output"), c("attempts"), c("latency")).alias("kind"),
        "model",
        F.round(c("usd") * 1_000_000).cast("long").alias("cost_microusd"),
        "input_tokens",
        "output_tokens",
        scalars.request_summary(c("request")).alias("request_summary"),
        F.substring("output", 1, 300).alias("output_preview"),
        F.coalesce(scalars.clamped_reason(c("reason")), F.lit("")).alias("empty_reason"),
    )


def reindexed(entries: DataFrame, bodies: DataFrame, now: int, size: int | None = None) -> DataFrame:
    """entries in which those not indexed yet (the `size` oldest of them, if given) have their columns derived anew."""
    open_ = entries.where("indexed_at is null")
    open_ = open_ if size is None else open_.orderBy("created_at", "entry_key").limit(size)
    fresh = indexed(bodies.join(open_.select("entry_key"), "entry_key", "left_semi"), now)
    return overlaid(entries, fresh)


def overlaid(entries: DataFrame, fresh: DataFrame) -> DataFrame:
    """entries with the columns that fresh (entry_key and some of them) has for an entry."""
    names = [c for c in fresh.columns if c != "entry_key" and c in entries.columns]
    new = fresh.select("entry_key", F.struct(*names).alias("_new"))
    both = entries.join(new, "entry_key", "left")
    return both.withColumns({c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in names}).drop("_new")


def to_prune(
    entries: DataFrame, *, created_before: int | None = None, created_from: int | None = None, accessed_before: int | None = None, kinds: tuple[str, ...] = (), models: tuple[str, ...] = (), empty_reasons: tuple[str, ...] = (), target: int | None = None
) -> DataFrame:
    """Keys to delete: entries that all the given conditions fit, and of the rest the least recently used until it fits the
    target. Without a condition or a target nothing goes."""
    asked = [
        (created_before, lambda x: F.col("created_at") < x), (created_from, lambda x: F.col("created_at") >= x), (accessed_before, lambda x: F.col("last_access_at") < x),
        (kinds or None, lambda x: F.col("kind").isin(*x)), (models or None, lambda x: F.col("model").isin(*x)), (empty_reasons or None, lambda x: F.col("empty_reason").isin(*x)),
    ]
    conditions = [of(x) for x, of in asked if x is not None]
    fits = F.lit(bool(conditions))
    for c in conditions:
        fits = fits & F.coalesce(c, F.lit(False))
    gone = entries.where(fits).select("entry_key")
    return gone if target is None else gone.union(evict_lru(entries.where(~fits), target).select("entry_key"))


def maintained(entries: DataFrame, now: int, *, max_age: int | None = None, target: int | None = None, empty_reasons: tuple[str, ...] = ()) -> DataFrame:
    """entries after the regular upkeep, which are two prunes: by age and size, and of empty answers of any age."""
    first = to_prune(entries, created_before=None if max_age is None else now - max_age, target=target)
    left = entries.join(first, "entry_key", "left_anti")
    return left.join(to_prune(left, empty_reasons=empty_reasons), "entry_key", "left_anti")


def disk_entries(spark: SparkSession, folder: str, limit: int = 20_000) -> DataFrame:
    """Files of a cache folder (any depth), newest first, at most `limit`: path, size, modified_at."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"))
    return files.orderBy(F.desc("modified_at"), "path").limit(limit)


def disk_stats(spark: SparkSession, folder: str) -> DataFrame:
    """One row: how many files there are and their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))


def disk_purge(spark: SparkSession, folder: str, modified_before: int | None = None) -> int:
    """Deletes the folder's files (older ones only, if a moment is given); how many. One call of the file system each, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    gone = files if modified_before is None else files.where(F.unix_millis("modificationTime") < modified_before)
    n = 0
    for row in gone.select("path").toLocalIterator():
        at = spark._jvm.org.apache.hadoop.fs.Path(row["path"])
        n += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False))
    return n
