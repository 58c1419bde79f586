"""The queries of this subpackage, with production parameters over whole tables, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import dimension_scan, factor_machine, flow_mix, impact_index, line_frequency, pack_swap, prefix_hash, recurrent_lm, shared, sort_count, token_planes, url_trie, weighted_minhash, window_index


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_folder(spark, "token-planes")
    token_planes.write_planes(_table(spark, sf_dir, "documents"), path, _vocabulary_path("byte_bpe_50k.json"), style="space")
    return token_planes.read_documents(spark, path)


def op2_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = recurrent_lm.score(docs, shared.in_folds("doc_id", 10) != 0)
    return out.select("doc_id", (shared.in_folds("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The rules that op3 applies.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op3_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_trie.judge_urls(pages, URL_RULES).select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


def op4_pack_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_swap.pack_documents(_table(spark, sf_dir, "documents"), _vocabulary_path("word_bpe_49k.json"), style="bare")


def op5_window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_index.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    machine = factor_machine.train(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (shared.in_folds("doc_id", 5) == 0).alias("held_out"), factor_machine.scores(docs, machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.fingerprints(_table(spark, sf_dir, "documents"))


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judge_lines(_table(spark, sf_dir, "documents"))


def op9_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = flow_mix.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).cast("long").alias("taken")
    )


def op10_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("row_no")


def op11_impact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = impact_index.build(_table(spark, sf_dir, "documents"), shared.new_folder(spark, "impact-index"))
    return impact_index.search(index, _table(spark, sf_dir, "benchmark"))


def op12_sort_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_count.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension_scan.nearest(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    own = (
        op1_token_planes, op2_recurrent_lm, op3_url_trie, op4_pack_swap, op5_window_index, op6_factor_machine, op7_prefix_hash, op8_line_frequency,
        op9_flow_mix, op10_weighted_minhash, op11_impact_index, op12_sort_count, op13_dimension_scan,
    )
    return {f.__name__: f for f in own} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_trie": OP3_SQL, "op5_window_index": OP5_SQL, "op8_line_frequency": OP8_SQL, "op11_impact_index": OP11_SQL, "op12_sort_count": OP12_SQL}


OP3_SQL = r"""
WITH rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN LATERAL (
  SELECT r.host || r.path AS rule, r.verdict FROM rules r
  WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC LIMIT 1) best ON true
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS k FROM d, unnest(range(1, len(w) - 33)) AS t(i) WHERE len(w) >= 35),
twice AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, i FROM win SEMI JOIN twice USING (k)), unnest(range(i, i + 35)) AS t(j)),
kept AS (SELECT d.doc_id, string_agg(d.w[j], ' ' ORDER BY j) AS s, count(*) AS n FROM d, unnest(range(1, len(d.w) + 1)) AS t(j) ANTI JOIN gone g ON g.doc_id = d.doc_id AND g.j = t.j GROUP BY d.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM d, unnest(range(1, len(w) - 1)) AS t(i) WHERE len(w) >= 3),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, i FROM win SEMI JOIN twice USING (doc_id, k)), unnest(range(i, i + 3)) AS t(j) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, host, lines, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
each AS (
  SELECT doc_id, host, array_to_string(ws, ' ') AS line, sum(len(ws)) AS n
  FROM (SELECT doc_id, host, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^\x20\x09-\x0D]+') AS ws FROM base, unnest(lines) AS t(x))
  GROUP BY ALL),
hosts AS (SELECT host, count(*) AS host_docs FROM base GROUP BY host),
above AS (SELECT e.host, e.line FROM each e JOIN hosts h ON e.host IS NOT DISTINCT FROM h.host GROUP BY e.host, e.line, h.host_docs HAVING count(*) > 20 AND count(*) > 0.005 * h.host_docs),
removed AS (SELECT e.doc_id, sum(e.n)::BIGINT AS n FROM each e JOIN above a ON e.host IS NOT DISTINCT FROM a.host AND e.line = a.line GROUP BY e.doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       coalesce(r.n, 0)::BIGINT AS removed_words, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - coalesce(r.n, 0) >= 0.3 * n_words AS kept
FROM base b LEFT JOIN removed r USING (doc_id)
"""

#: A-Z alone are lower-cased before terms are cut.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT row_number() OVER () AS j, item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT j, item_id, term, count(*) AS times FROM items GROUP BY ALL),
whole AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0),
tf AS (SELECT i, doc_id, term, len(w)::BIGINT AS n, count(*) AS tf FROM d, unnest(w) AS t(term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, whole),
scored AS (
  SELECT j, item_id, i, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term), whole GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id NULLS FIRST) AS r FROM scored WHERE score > 0)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= 20
"""

#: crc32 byte by byte: the table follows from its polynomial, bytes from hexadecimal digits.
OP12_SQL = rf"""
WITH RECURSIVE steps(b, c, n) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE n = 8),
texts AS (
  SELECT row_number() OVER () AS i, true AS own, doc_id, text FROM documents UNION ALL SELECT row_number() OVER () AS i, false, item_id, text FROM benchmark),
cut AS (SELECT i, own, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (SELECT i, own, unnest(w || [w[k] || ' ' || w[k + 1] for k in range(1, len(w))]) AS f FROM cut),
codes AS (
  SELECT f, xor(list_reduce([4294967295] || [('0x' || substr(hex(encode(f)), 2 * k - 1, 2))::BIGINT for k in range(1, strlen(f) + 1)], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b
  FROM (SELECT DISTINCT f FROM features), crc),
counted AS (SELECT own, i, b, count(*) AS n FROM features JOIN codes USING (f) GROUP BY ALL),
sums AS (SELECT b, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM counted GROUP BY b),
whole AS (SELECT sum(s) AS ss, sum(t) AS tt FROM sums),
gains AS (SELECT b, floor(1000 * ln(((t + 1) * (ss + 10000)) / ((s + 1) * (tt + 10000)))) AS g FROM sums, whole),
weights AS (SELECT i, sum(n)::BIGINT AS n_features, floor(sum(n * g) / sum(n))::BIGINT AS weight FROM counted JOIN gains USING (b) WHERE own GROUP BY i),
scored AS (
  SELECT c.i, c.doc_id, len(c.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(c.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM cut c LEFT JOIN weights USING (i) WHERE c.own),
drawn AS (
  SELECT i, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS r, (25 * count(*) OVER ()) // 100 AS quota FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= quota THEN r END::BIGINT AS rank FROM scored LEFT JOIN drawn USING (i)
"""
