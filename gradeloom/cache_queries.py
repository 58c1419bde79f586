"""Registered queries on cache entries, fallbacks, scalars and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import assertions as a
from gradeloom.functions import blake3
from gradeloom.functions import json_checks as jc
from gradeloom.functions import scalars as sc
from gradeloom.functions import templates as tp
from gradeloom.operators import cache, fallbacks
from gradeloom.plans import views as v
from gradeloom.queries import WITH

C = f"WITH c AS ({v.CACHE})"


def cache_sorts(spark: SparkSession, d: str) -> DataFrame:
    """The first page by each field in each direction, and one page behind a cursor."""
    entries, out = v.cache_entries(spark, d), None
    for sort in cache.SORTS:
        for down in (True, False):
            own = cache.entry_page(entries, sort, down, 20).select(F.lit(f"{sort}-{'desc' if down else 'asc'}").alias("label"), "entry_key")
            out = own if out is None else out.union(own)
    return out.union(cache.entry_page(entries, "model", False, 20, ("m3", 100)).select(F.lit("model-after"), "entry_key"))


def _sorts_sql() -> str:
    parts = []
    for sort, value in cache.SORTS.items():
        for way in ("DESC", "ASC"):
            known = f"WHERE {value} IS NOT NULL" if sort in cache.KNOWN_ONLY else ""
            nulls = "NULLS LAST" if way == "DESC" else "NULLS FIRST"
            parts.append(f"SELECT '{sort}-{way.lower()}' AS label, entry_key FROM (SELECT entry_key FROM c {known} ORDER BY {value} {way} {nulls}, entry_key {way} LIMIT 21)")
    parts.append("SELECT 'model-after', entry_key FROM (SELECT entry_key FROM c WHERE model > 'm3' OR (model = 'm3' AND entry_key > 100) ORDER BY model, entry_key LIMIT 21)")
    return f"{C} " + " UNION ALL ".join(parts)


def cache_filters(spark: SparkSession, d: str) -> DataFrame:
    entries, out = v.cache_entries(spark, d), None
    asked = {
        "kind": cache.entry_filter(kind="click"), "unindexed": cache.entry_filter(kind="unindexed"), "unparseable": cache.entry_filter(kind="unparseable"), "model": cache.entry_filter(model="m5", empty_reason="refusal"),
        "window": cache.entry_filter(since=60_000 * 50, until=60_000 * 90), "cost": cache.entry_filter(min_cost=100_000, max_cost=900_000), "words": cache.entry_filter(text="answer-7"), "part": cache.entry_filter(text="WER 7", by_words=False), "nothing": cache.entry_filter(text="*"),
    }
    for label, condition in asked.items():
        own = entries.where(condition).select(F.lit(label).alias("label"), "entry_key")
        out = own if out is None else out.union(own)
    return out


CACHE_FILTERS = f"""{C}, l AS (SELECT unnest(['kind', 'unindexed', 'unparseable', 'model', 'window', 'cost', 'words', 'part']) AS label)
SELECT label, entry_key FROM c, l WHERE CASE label WHEN 'kind' THEN kind = 'click' WHEN 'unindexed' THEN indexed_at IS NULL WHEN 'unparseable' THEN NOT index_ok WHEN 'model' THEN model = 'm5' AND empty_reason = 'refusal'
  WHEN 'window' THEN created_at BETWEEN 3000000 AND 5400000 WHEN 'cost' THEN cost_microusd BETWEEN 100000 AND 900000 WHEN 'words' THEN output_preview = 'answer 7' ELSE contains(lower(request_summary || ' ' || output_preview), 'wer 7') END"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select((F.col("event_id") * 3 % 15_000).alias("entry_key"), (F.col("event_id") * 1_000).alias("ts"))


REQUESTS = "q AS (SELECT event_id * 3 % 15000 AS entry_key, event_id * 1000 AS ts FROM events)"


def cache_lookups(spark: SparkSession, d: str) -> DataFrame:
    return cache.lookups(_requests(spark, d), v.cache_entries(spark, d).select("entry_key"))


LOOKUPS = f"""{C}, {REQUESTS}, k AS (SELECT entry_key, count(*) AS n, max(ts) AS last FROM q GROUP BY entry_key), m AS (SELECT k.*, c.entry_key IS NOT NULL AS there FROM k LEFT JOIN c USING (entry_key))
SELECT entry_key, CASE WHEN there THEN n ELSE 0 END AS hits, CASE WHEN there THEN 0 ELSE n END AS misses, CASE WHEN there THEN last END AS last_access_at FROM m"""


def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return cache.stats(v.cache_entries(spark, d), cache_lookups(spark, d))


CACHE_STATS = f"""{C}, {REQUESTS} SELECT count(*) AS entries, sum(size)::BIGINT AS total_bytes, min(created_at) AS oldest_at, count(*) FILTER (WHERE indexed_at IS NULL) AS unindexed,
  (SELECT count(*) FROM q WHERE entry_key IN (SELECT entry_key FROM c)) AS hits, (SELECT count(*) FROM q WHERE entry_key NOT IN (SELECT entry_key FROM c)) AS misses FROM c"""


def cache_put(spark: SparkSession, d: str) -> DataFrame:
    entries = v.cache_entries(spark, d).select("entry_key", "size", "created_at")
    stored = entries.where("entry_key % 3 = 0")
    offered = entries.union(entries.select("entry_key", F.col("size") + 1, "created_at")).union(entries.select("entry_key", "size", F.col("created_at") - 1))
    return cache.put(stored, offered)


PUT = f"{C} SELECT entry_key, size, created_at - 1 AS created_at FROM c WHERE entry_key % 3 <> 0"


def cache_layers(spark: SparkSession, d: str) -> DataFrame:
    entries = v.cache_entries(spark, d).select("entry_key", "size")
    near, far = entries.where("entry_key % 2 = 0"), entries.where("entry_key % 5 <> 1").withColumn("size", -F.col("size"))
    return cache.without(cache.layered(near, far), 4)


LAYERS = f"{C} SELECT entry_key, CASE WHEN entry_key % 2 = 0 THEN size ELSE -size END AS size FROM c WHERE (entry_key % 2 = 0 OR entry_key % 5 <> 1) AND entry_key <> 4"


def cache_probes(spark: SparkSession, d: str) -> DataFrame:
    entries, probes = v.cache_entries(spark, d).select("entry_key", "last_access_at"), _requests(spark, d)
    return cache.touched(entries, cache.holds(probes, entries))


PROBES = f"{C}, {REQUESTS}, k AS (SELECT entry_key, max(ts) AS ts FROM q GROUP BY entry_key) SELECT entry_key, greatest(last_access_at, coalesce(ts, last_access_at)) AS last_access_at FROM c LEFT JOIN k USING (entry_key)"


def cache_pruned(spark: SparkSession, d: str) -> DataFrame:
    return cache.to_prune(v.cache_entries(spark, d), created_before=60_000 * 8_000, models=("m1", "m2"), empty_reasons=("refusal", "blank"), target=25_000_00)


PRUNED = f"""{C}, g AS (SELECT entry_key FROM c WHERE created_at < 480000000 AND model IN ('m1', 'm2') AND empty_reason IN ('refusal', 'blank')), r AS (SELECT * FROM c WHERE entry_key NOT IN (SELECT entry_key FROM g)),
l AS (SELECT entry_key, sum(size) OVER () - (sum(size) OVER (ORDER BY last_access_at, entry_key ROWS UNBOUNDED PRECEDING) - size) AS left_ FROM r)
SELECT entry_key FROM g UNION ALL SELECT entry_key FROM l WHERE left_ > 2500000"""


def cache_kept(spark: SparkSession, d: str) -> DataFrame:
    return cache.maintained(v.cache_entries(spark, d), 60_000 * 1_000, max_age=60_000 * 600, empty_reasons=("blank",)).select("entry_key")


KEPT = f"{C} SELECT entry_key FROM c WHERE created_at >= 24000000 AND empty_reason <> 'blank'"


def cache_entry_runs(spark: SparkSession, d: str) -> DataFrame:
    cases, runs = v.cases(spark, d), v.runs(spark, d)
    first = cache.entry_runs(cases, runs, "k77", 12)
    return first.select("run_id", "case_key", "cached", "created_at")


ENTRY_RUNS = f"""{WITH} SELECT run_id, case_key, coalesce(cached, false) AS cached, created_at FROM cases WHERE cache_key = 'k77' ORDER BY created_at DESC, run_id DESC, case_key LIMIT 13"""


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    i = F.col("event_id")
    request = F.when(i % 3 == 0, F.concat(F.lit('{"transport": "http", "url": "https://h.example/v1?key='), i, F.lit('", "body": {"model": "m'), i % 5, F.lit('"}}'))).when(i % 3 == 1, F.lit('{"transport": "exec", "command": "run", "args": ["-x", "1"], "stdin": {"kind": "assert"}}')).otherwise("null")
    kind = F.when(i % 7 == 0, F.lit(', "kind": "judge"')).otherwise("")
    more = F.when(i % 2 == 0, F.lit(', "attempts": 2, "cost_usd": 0.25, "usage": {"input_tokens": 5, "output_tokens": 6}')).otherwise("")
    tail = F.when(i % 11 == 0, "").otherwise("}")
    return events.select(i.alias("entry_key"), F.concat(F.lit('{"output": "text '), i, F.lit('", "empty_reason": "refusal", "request": '), request, kind, more, tail).alias("body"))


def cache_index(spark: SparkSession, d: str) -> DataFrame:
    out = cache.indexed(_bodies(spark, d), 1).where("index_ok")
    return out.select("entry_key", "kind", "model", "cost_microusd", "input_tokens", "request_summary", "output_preview", "empty_reason")


CACHE_INDEX = """SELECT event_id AS entry_key, CASE WHEN event_id % 7 = 0 THEN 'judge' WHEN event_id % 3 = 1 THEN 'exec_assert' WHEN event_id % 2 = 0 THEN 'provider' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'm' || (event_id % 5) END AS model,
  CASE WHEN event_id % 2 = 0 THEN 250000 END::BIGINT AS cost_microusd, CASE WHEN event_id % 2 = 0 THEN 5 END::BIGINT AS input_tokens, CASE event_id % 3 WHEN 0 THEN 'POST https://h.example/v1' WHEN 1 THEN 'exec run -x 1' END AS request_summary,
  'text ' || event_id AS output_preview, 'refusal' AS empty_reason FROM events WHERE event_id % 11 <> 0"""


def settled_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains of three providers over the lines of orders."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    cell = lines.groupBy("l_orderkey").agg(F.max("l_partkey").alias("k"))
    links = cell.select("l_orderkey", "k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("link"))
    state = (F.col("k") + F.col("link") * 7) % 6
    attempts = links.select("l_orderkey", "link", F.concat(F.lit("p"), "link").alias("provider_id"), F.when(state == 1, "refusal").when(state == 2, "blank").alias("empty_reason"), F.when(state == 3, "provider_timeout").when(state == 4, "provider_request").alias("error_class"))
    flags = cell.select("l_orderkey", (F.col("k") % 7 != 0).alias("walks"), F.when(F.col("k") % 5 == 0, F.lit(2)).alias("aborted_at"))
    out = fallbacks.settled(attempts.join(flags, "l_orderkey"), "l_orderkey", walks=F.col("walks"), aborted_at=F.col("aborted_at"))
    return out.withColumn("passed_over", F.array_join("passed_over", ","))


CHAINS = """WITH k AS (SELECT l_orderkey, max(l_partkey) AS k FROM lineitem GROUP BY 1), a AS (SELECT l_orderkey, link, (k + link * 7) % 6 AS s FROM k, (VALUES (0), (1), (2)) t(link)
  WHERE link = 0 OR (k % 7 <> 0 AND NOT (k % 5 = 0 AND link = 2))),
w AS (SELECT l_orderkey, min(link) FILTER (WHERE s NOT IN (1, 3)) AS stop FROM a GROUP BY 1), i AS (SELECT w.*, a.s, stop IS NOT NULL AND (stop = 0 OR s <> 4) AS ok FROM w LEFT JOIN a ON a.l_orderkey = w.l_orderkey AND a.link = w.stop),
c AS (SELECT i.l_orderkey, ok, stop, a.link, a.s FROM i JOIN a ON a.l_orderkey = i.l_orderkey AND a.link = CASE WHEN ok THEN stop ELSE 0 END)
SELECT l_orderkey, 'p' || link AS provider_id, CASE s WHEN 1 THEN 'refusal' WHEN 2 THEN 'blank' END AS empty_reason, CASE s WHEN 3 THEN 'provider_timeout' WHEN 4 THEN 'provider_request' END AS error_class,
  CASE WHEN ok AND stop = 1 THEN 'p0' WHEN ok AND stop = 2 THEN 'p0,p1' ELSE '' END AS passed_over, CASE WHEN link > 0 THEN 'p' || link END AS answered_by FROM c"""


def cache_modes(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("request_id"), (F.col("user_id") * 13 + F.col("event_id") % 4).alias("cache_key"))
    stored, out = events.where("request_id < 100").select("cache_key"), None
    for mode in ("read_write", "disabled", "read_only_strict"):
        own = fallbacks.under_mode(events.where("request_id >= 100"), stored, mode).select(F.lit(mode).alias("mode"), "request_id", "outcome", "stored")
        out = own if out is None else out.union(own)
    return out


MODES = """WITH e AS (SELECT event_id AS request_id, user_id * 13 + event_id % 4 AS cache_key FROM events), s AS (SELECT DISTINCT cache_key FROM e WHERE request_id < 100), m AS (SELECT unnest(['read_write', 'disabled', 'read_only_strict']) AS mode),
o AS (SELECT mode, request_id, e.cache_key, CASE WHEN s.cache_key IS NOT NULL AND mode <> 'disabled' THEN 'hit' WHEN mode = 'read_only_strict' THEN 'cache_miss' ELSE 'call' END AS outcome FROM m, e LEFT JOIN s USING (cache_key) WHERE request_id >= 100)
SELECT mode, request_id, outcome, mode = 'read_write' AND outcome = 'call' AND row_number() OVER (PARTITION BY mode, cache_key ORDER BY request_id) = 1 AS stored FROM o"""


def human_texts(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("x")).distinct()
    n = F.floor("x").cast("long") * 100 + 7  # no value lies halfway between two texts
    return lines.select(
        "k", "x", sc.human_seconds((n % 5_000) / 10).alias("seconds"), sc.human_count(n).alias("count"), sc.human_tokens(n).alias("tokens"), sc.human_cost((n % 500) / 4_096).alias("cost"), sc.human_latency((n % 900 * 10).cast("double")).alias("latency"),
        sc.human_bytes(n * 64).alias("bytes"), sc.human_percent((n % 50) / 50).alias("percent"),
    )


HUMAN = """WITH v AS (SELECT DISTINCT l_orderkey AS k, l_extendedprice AS x, floor(l_extendedprice)::BIGINT * 100 + 7 AS n FROM lineitem), w AS (SELECT *, (n % 5000) / 10 AS s, (n % 500) / 4096 AS u, n % 900 * 10 AS ms, n * 64 AS b FROM v)
SELECT k, x, CASE WHEN s < 60 THEN printf('%.1fs', s) ELSE printf('%dm %02ds', round(s)::BIGINT // 60, round(s)::BIGINT % 60) END AS seconds,
  CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1e6::DOUBLE) WHEN n >= 1000 THEN printf('%.1fk', n / 1e3::DOUBLE) ELSE n::VARCHAR END AS count, CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 1000000 THEN printf('%.1fk', n / 1e3::DOUBLE) ELSE printf('%.2fM', n / 1e6::DOUBLE) END AS tokens,
  CASE WHEN u = 0 THEN '$0.00' WHEN u < 0.01 THEN printf('$%.4f', u) ELSE printf('$%.2f', u) END AS cost, CASE WHEN ms < 1000 THEN ms || 'ms' ELSE printf('%.2fs', ms / 1000::DOUBLE) END AS latency,
  CASE WHEN b < 1024 THEN printf('%.0f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024::DOUBLE) WHEN b < 1073741824 THEN printf('%.1f MB', b / 1048576::DOUBLE) ELSE printf('%.1f GB', b / 1073741824::DOUBLE) END AS bytes, printf('%.1f%%', (n % 50) / 50 * 100) AS percent FROM w"""


def scalar_texts(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    url = F.col("url")
    return pages.select(
        "page_id", sc.slugify(url).alias("slug"), tp.FILTERS["b64encode"](url).alias("b64"), tp.FILTERS["b64decode"](tp.FILTERS["b64encode"](url)).alias("back"), tp.FILTERS["sha256"](url).alias("sha"), tp.FILTERS["md5"](url).alias("md5"),
        tp.FILTERS["regex_replace"](url, r"^(\w+)://", "$1+").alias("replaced"), tp.FILTERS["regex_match"](url, r"\d{2}").alias("matched"), sc.truncated(url, 12).alias("cut"), sc.clamped_reason(F.concat(url, F.lit("\n"), url)).alias("clamped"),
        sc.case_key(url, F.lit(None).cast("string"), F.lit("t"), F.col("page_id") % 3).alias("case_key"),
    )


SCALARS = r"""SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug, to_base64(encode(url)) AS b64, url AS back, sha256(url) AS sha, md5(url) AS md5, regexp_replace(url, '^(\w+)://', '\1+') AS replaced,
  regexp_matches(url, '[0-9]{2}') AS matched, left(url, 12) AS cut, left(url || url, 64) AS clamped,
  left(sha256(encode(url) || '\x00'::BLOB || '\x00'::BLOB || encode('t') || '\x00'::BLOB || (['\x00', '\x01', '\x02'][page_id % 3 + 1])::BLOB || '\x00\x00\x00'::BLOB), 16) AS case_key FROM pages"""


def seeded_values(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", tp.seeded_uuid(F.col("event_id")).alias("uuid"), F.round(tp.seeded_rand(F.col("event_id")), 9).alias("rand"), tp.seeded_randint(-3, 12, F.col("event_id")).alias("randint"))


def _seeded_sql() -> str:
    """BLAKE3 of a message of one block in SQL, half a step of a round for each table, and what is taken from its digest."""
    size, mask = "length(t)", 4294967295
    word = lambda k: " + ".join(f"(coalesce(ascii(nullif(substr(t, {4 * k + j + 1}, 1), '')), 0)::BIGINT << {8 * j})" for j in range(4))
    turned = lambda x, n: f"((xor({x}) >> {n}) | ((xor({x}) << {32 - n}) & {mask}))"
    state = [*blake3.IV, *blake3.IV[:4], 0, 0, size, blake3.CHUNK_START + blake3.CHUNK_END + blake3.ROOT]
    tables = ["s AS (SELECT event_id, event_id::VARCHAR AS t FROM events)"]
    tables.append("h0 AS (SELECT event_id, " + ", ".join([f"{word(k)} AS m{k}" for k in range(16)] + [f"{x}::BIGINT AS v{k}" for k, x in enumerate(state)]) + " FROM s)")
    order, n = list(range(16)), 0
    for _ in range(blake3.ROUNDS):
        for half, places in enumerate(blake3.STEPS):
            for other, (one, two) in enumerate(((16, 12), (8, 7))):
                now = []
                for k, (a, b, c, d) in enumerate(places):
                    m = order[8 * half + 2 * k + other]
                    now += [f"(v{a} + v{b} + m{m}) & {mask} AS a{k}", f"{turned(f'v{d}, a{k}', one)} AS d{k}", f"(v{c} + d{k}) & {mask} AS c{k}", f"{turned(f'v{b}, c{k}', two)} AS b{k}"]
                named = {v: f"{x}{k} AS v{v}" for k, own in enumerate(places) for v, x in zip(own, "abcd", strict=True)}
                tables.append(f"g{n} AS (SELECT *, {', '.join(now)} FROM h{n})")
                tables.append(f"h{n + 1} AS (SELECT event_id, {', '.join(f'm{k}' for k in range(16))}, {', '.join(named[v] for v in range(16))} FROM g{n})")
                n += 1
        order = [order[k] for k in blake3.ORDER]
    tables.append("w AS (SELECT event_id, " + ", ".join(f"xor(v{k}, v{k + 8}) AS w{k}" for k in range(4)) + f" FROM h{n})")
    # Words are written with the least byte first.
    tables.append("x AS (SELECT *, " + ", ".join(f"printf('%02x%02x%02x%02x', w{k} & 255, (w{k} >> 8) & 255, (w{k} >> 16) & 255, w{k} >> 24) AS x{k}" for k in range(4)) + " FROM w)")
    return f"""WITH {", ".join(tables)}
SELECT event_id, concat_ws('-', x0, x1[1:4], '4' || x1[6:8], substr('89ab', ('0x' || x2[1:1])::INT % 4 + 1, 1) || x2[2:4], x2[5:8] || x3) AS uuid,
  round((w1 * 2097152 + (w0 >> 11)) / 9007199254740992, 9) AS rand, ((w1::HUGEINT * 4294967296 + w0) % 16)::BIGINT - 3 AS randint FROM x"""


SEEDED = _seeded_sql()


def priced_calls(spark: SparkSession, d: str) -> DataFrame:
    """Costs of calls with all components, by a configured rate sheet over a built-in one."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q")).distinct()
    q, p = F.col("q"), F.col("l_partkey")
    usage = {"input": q * 100, "output": q * 7, "cache_read": F.when(p % 2 == 0, q * 50), "cache_write": F.when(p % 3 == 0, q * 20), "cache_write_1h": F.when(p % 6 == 0, q * 30)}
    built_in = {"input": F.when(p % 5 != 0, F.lit(3_000_000)), "output": F.lit(15_000_000), "cache_read": F.lit(300_000), "cache_write_5m": F.lit(3_750_000)}
    own = {"input": F.when(p % 10 == 0, F.lit(1_000_001)), "cache_write_1h": F.when(p % 4 == 0, F.lit(6_000_000))}
    cost = sc.call_cost(usage, sc.merged_rates(own, built_in))
    return lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("calls"), F.count(cost).alias("priced"), F.sum(cost).alias("cost_microusd"))


CALLS = """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey AS p, l_suppkey, l_quantity::BIGINT AS q FROM lineitem),
u AS (SELECT *, CASE WHEN p % 10 = 0 THEN 1000001 WHEN p % 5 <> 0 THEN 3000000 END AS ri, CASE WHEN p % 3 = 0 THEN q * 20 ELSE 0 END AS w, CASE WHEN p % 6 = 0 THEN least(q * 30, q * 20) ELSE 0 END AS lw FROM l),
c AS (SELECT l_orderkey, CASE WHEN ri IS NULL OR (lw > 0 AND p % 4 <> 0) THEN NULL ELSE (q * 100 * ri + 999999) // 1000000 + (q * 7 * 15000000 + 999999) // 1000000 + CASE WHEN p % 2 = 0 THEN (q * 50 * 300000 + 999999) // 1000000 ELSE 0 END
  + ((w - lw) * 3750000 + 999999) // 1000000 + (lw * 6000000 + 999999) // 1000000 END AS cost FROM u)
SELECT l_orderkey, count(*) AS calls, count(cost) AS priced, sum(cost)::BIGINT AS cost_microusd FROM c GROUP BY l_orderkey"""


def json_texts(spark: SparkSession, d: str) -> DataFrame:
    """Strict syntax, embedded values, equality and schemas over the events' properties, some of them spoilt."""
    events = spark.read.parquet(f"{d}/events.parquet")
    i = F.col("event_id")
    text = F.when(i % 5 == 0, F.concat(F.lit("so: "), "props", F.lit(" end"))).when(i % 5 == 1, F.concat("props", F.lit("x"))).when(i % 5 == 2, F.lit("[1, NaN]")).otherwise(F.col("props"))
    verdict = jc.contains_json(F.col("t"), {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 49}}})
    told = events.select("event_id", text.alias("t")).select("event_id", jc.is_json(F.col("t")).alias("is_json"), verdict.alias("v"), jc.equals_json(F.col("t"), {"k": 7})["passed"].alias("is_seven"))
    return told.select("event_id", "is_json", F.col("v.passed").alias("fits"), "v.n_errors", "is_seven")


JSON = """WITH e AS (SELECT event_id, event_id % 5 AS m, (props->>'$.k')::INT AS k FROM events)
SELECT event_id, m >= 3 AS is_json, CASE WHEN m = 2 THEN false ELSE k <= 49 END AS fits, CASE WHEN m = 2 THEN 1 WHEN k <= 49 THEN 0 ELSE 1 END AS n_errors, m >= 3 AND k = 7 AS is_seven FROM e"""


def empty_answers(spark: SparkSession, d: str) -> DataFrame:
    """Why outputs are empty, which of them a cache keeps, and negated assertions on them."""
    cases = v.cases(spark, d)
    text = F.when(F.col("idx") % 9 == 0, "null").when(F.col("idx") % 9 == 1, " { } ").otherwise(F.col("output_text"))
    reason = sc.empty_reason(F.lit("end_turn"), F.col("t"), F.col("j"))
    own = cases.select("run_id", "case_key", text.alias("t"), (F.col("idx") % 9 <= 1).alias("j")).withColumn("reason", F.coalesce(reason, F.when(sc.refused(F.col("t"), ("3$",)), "refusal")))
    no = a.negated(a.contains(F.col("t"), "4"), F.col("t"), is_json=F.col("j"), reason=F.col("reason"))["passed"]
    return own.groupBy("run_id").agg(F.count_if(F.col("reason") == "blank").alias("blank"), F.count_if(F.col("reason") == "refusal").alias("refused"), F.count_if(sc.stored_in_cache(F.col("reason"))).alias("kept"), F.count_if(no).alias("without_four"))


EMPTY = f"""{WITH}, t AS (SELECT run_id, idx % 9 <= 1 OR output_text IS NULL AS blank, idx % 9 > 1 AND coalesce(output_text, '') = 'out 3' AS refused, idx % 9 > 1 AND coalesce(output_text, '') = 'out 4' AS four FROM cases)
SELECT run_id, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE refused) AS refused, count(*) FILTER (WHERE NOT blank AND NOT refused) AS kept, count(*) FILTER (WHERE NOT blank AND NOT four) AS without_four FROM t GROUP BY run_id"""


def flat_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Each conversation's turns as one text, and with a history put behind its system turns."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    calls = F.lit(None).cast("array<struct<name: string, arguments: string>>")
    flat = sc.flat_prompt(F.transform("m", lambda x: F.struct(x["text"].alias("text"), calls.alias("calls"))))
    plain = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    own = sc.spliced(plain, F.array(F.struct(F.lit("user").alias("role"), F.lit("before").alias("text"))), F.lit(None).cast("int"))
    return turns.select("conv_id", F.md5(flat).alias("flat_md5"), F.array_position(F.transform(own, lambda x: x["text"]), F.lit("before")).alias("spliced_at"), F.size(own).alias("n"))


CONVERSATIONS = """WITH c AS (SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS flat_md5, count(*) AS k, count(*) FILTER (WHERE NOT later) AS s FROM
  (SELECT *, max(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) = 1 AS later FROM conversations) GROUP BY conv_id)
SELECT conv_id, flat_md5, s + 1 AS spliced_at, (k + 1)::INT AS n FROM c"""

_Q = {
    "cache_sorts": (cache_sorts, _sorts_sql()),
    "cache_filters": (cache_filters, CACHE_FILTERS),
    "cache_lookups": (cache_lookups, LOOKUPS),
    "cache_stats": (cache_stats, CACHE_STATS),
    "cache_put": (cache_put, PUT),
    "cache_layers": (cache_layers, LAYERS),
    "cache_probes": (cache_probes, PROBES),
    "cache_pruned": (cache_pruned, PRUNED),
    "cache_kept": (cache_kept, KEPT),
    "cache_entry_runs": (cache_entry_runs, ENTRY_RUNS),
    "cache_index": (cache_index, CACHE_INDEX),
    "settled_chains": (settled_chains, CHAINS),
    "cache_modes": (cache_modes, MODES),
    "human_texts": (human_texts, HUMAN),
    "scalar_texts": (scalar_texts, SCALARS),
    "seeded_values": (seeded_values, SEEDED),
    "priced_calls": (priced_calls, CALLS),
    "json_texts": (json_texts, JSON),
    "empty_answers": (empty_answers, EMPTY),
    "flat_conversations": (flat_conversations, CONVERSATIONS),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _Q.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _Q.items()}
