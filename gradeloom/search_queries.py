"""Registered queries that search by an index, and their SQL, which reads every text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import cache, search, text_index, trigrams
from gradeloom.operators import runs as ru
from gradeloom.plans import store
from gradeloom.plans import views as v
from gradeloom.queries import WITH

#: Runs that were answered from the cache alone.
CACHED = "coalesce(cache_hits, -1) > 0 AND coalesce(cache_misses, -1) = 0"


def _index(spark: SparkSession, d: str, name: str, rows: DataFrame, key: tuple[str, ...], columns: tuple[str, ...]) -> text_index.TextIndex:
    """The index of a table, built once for a session."""
    path = store.written(spark, d, name, lambda path: text_index.build(rows, path, key=key, columns=columns))
    return text_index.TextIndex(spark, path, key)


def documents_index(spark: SparkSession, d: str) -> text_index.TextIndex:
    return _index(spark, d, "documents-index", spark.read.parquet(f"{d}/documents.parquet"), ("doc_id",), ("text",))


def runs_index(spark: SparkSession, d: str) -> text_index.TextIndex:
    runs = v.runs(spark, d)
    return _index(spark, d, "runs-index", runs, ("run_id",), search.texts_of(runs, search.RUN_TEXTS))


def cases_index(spark: SparkSession, d: str) -> text_index.TextIndex:
    cases = v.cases(spark, d)
    return _index(spark, d, "cases-index", cases, ("run_id", "case_key"), search.texts_of(cases, search.CASE_TEXTS))


def document_search(spark: SparkSession, d: str) -> DataFrame:
    return text_index.hits(documents_index(spark, d), "ta re").withColumn("score", F.round("score", 6))


DOCUMENT_SEARCH = r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: starts_with(x, 'ta'))) AS t0, len(list_filter(w, lambda x: starts_with(x, 're'))) AS t1 FROM t),
o AS (SELECT count(*) AS d, avg(n) AS m, count(*) FILTER (WHERE t0 > 0) AS f0, count(*) FILTER (WHERE t1 > 0) AS f1 FROM c)
SELECT doc_id, round(ln(1 + (d - f0 + 0.5) / (f0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (d - f1 + 0.5) / (f1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / m)), 6) AS score
FROM c, o WHERE t0 > 0 AND t1 > 0"""

#: Words of a text, as the index cuts them; terms of several columns with how often each phrase stands there.
_WORDS = r"regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+')"


def _scored(columns: tuple[str, ...], phrases: list[list[str]], table: str, keys: str) -> str:
    """SQL for rows of a table that hold all phrases, with their score over all columns: view `scored`."""
    cut = ", ".join(_WORDS.format(c=c) for c in columns)
    hit = lambda p: " AND ".join([f"w[i + {k}] = '{x}'" for k, x in enumerate(p[:-1])] + [f"starts_with(w[i + {len(p) - 1}], '{p[-1]}')"])
    counts = ", ".join(f"list_sum(list_transform(cols, lambda w: len(list_filter(range(1, len(w) + 1), lambda i: coalesce({hit(p)}, false)))))::BIGINT AS h{n}" for n, p in enumerate(phrases))
    df = ", ".join(f"count(*) FILTER (WHERE h{n} > 0) AS f{n}" for n in range(len(phrases)))
    score = " + ".join(f"ln(1 + (d - f{n} + 0.5) / (f{n} + 0.5)) * h{n} * 2.2 / (h{n} + 1.2 * (0.25 + 0.75 * n / m))" for n in range(len(phrases)))
    held = " AND ".join(f"h{n} > 0" for n in range(len(phrases)))
    return f"""cut AS (SELECT {keys}, [{cut}] AS cols FROM {table}),
counted AS (SELECT {keys}, list_sum(list_transform(cols, lambda w: len(w))) AS n, {counts} FROM cut), overall AS (SELECT count(*) AS d, avg(n) AS m, {df} FROM counted),
scored AS (SELECT {keys}, {score} AS score FROM counted, overall WHERE {held})"""


def found_runs(spark: SparkSession, d: str) -> DataFrame:
    found = search.search_runs(runs_index(spark, d), v.runs(spark, d), "high main c", 40)
    return found.withColumn("score", F.round("score", 6)).withColumn("snippet", _plain_marks(F.col("snippet")))


def _plain_marks(text):
    return F.translate(text, search.OPENS + search.CLOSES, "[]")


FOUND_RUNS = f"""{WITH}, {_scored(("project", "suite", "branch", "git_commit", "tag_text"), [["high"], ["main"], ["c"]], "runs", "run_id")},
ranked AS (SELECT run_id, project, suite, created_at, git_commit, cache_hits, cache_misses, score, row_number() OVER (ORDER BY round(score, 9) DESC, created_at DESC, run_id DESC) AS rank FROM scored JOIN runs USING (run_id))
SELECT run_id, project, suite, created_at, '2 [HIGH]' AS snippet,
  CASE WHEN cache_hits IS NULL OR cache_misses IS NULL THEN NULL ELSE cache_misses = 0 AND cache_hits > 0 END AS cached, rank::INTEGER AS rank, round(score, 6) AS score
FROM ranked WHERE rank <= 40"""


def found_cases(spark: SparkSession, d: str) -> DataFrame:
    runs = ru.by_cache(v.runs(spark, d).where("project = '3-MEDIUM' OR project = '1-URGENT'"))
    found = search.search_cases(cases_index(spark, d), v.cases(spark, d), runs, "t1/of f odd", 25)
    return found.withColumn("score", F.round("score", 6)).withColumn("snippet", _plain_marks(F.col("snippet")))


FOUND_CASES = f"""{WITH}, {_scored(("name", "output_text", "error_class", "tag_text", "test_id"), [["t1", "of"], ["f"], ["odd"]], "cases", "run_id, case_key")},
ranked AS (SELECT s.*, r.project, r.suite, row_number() OVER (ORDER BY round(score, 9) DESC, r.created_at DESC, run_id DESC, case_key) AS rank
  FROM scored s JOIN runs r USING (run_id) WHERE r.project IN ('3-MEDIUM', '1-URGENT') AND NOT ({CACHED}))
SELECT run_id, case_key, c.name, c.status, k.project, k.suite, 'Case [T1] [of] [' || c.prompt_id || ']' AS snippet, c.cached, rank::INTEGER AS rank, round(k.score, 6) AS score
FROM ranked k JOIN cases c USING (run_id, case_key) WHERE rank <= 25"""

PHRASES = ("t5/of", "out/3 even", "rend", "*", "OUT t1")


def found_phrases(spark: SparkSession, d: str) -> DataFrame:
    """How many cases of each project hold the words of a query."""
    index, cases, out = cases_index(spark, d), v.cases(spark, d).select("run_id", "case_key", "project"), None
    for asked in PHRASES:
        own = text_index.hits(index, asked).select(F.lit(asked).alias("label"), "run_id", "case_key")
        out = own if out is None else out.union(own)
    return out.join(cases, ["run_id", "case_key"]).groupBy("label", "project").agg(F.count(F.lit(1)).alias("n"))


FOUND_PHRASES = rf"""{WITH}, t AS (
  SELECT project, lower(coalesce(name, '')) AS name, coalesce(output_text, '') AS o, coalesce(error_class, '') AS e, tag_text, lower(test_id) AS t FROM cases),
q AS (SELECT unnest(['t5/of', 'out/3 even', 'rend', 'OUT t1']) AS label)
SELECT label, project, count(*) AS n FROM t, q
WHERE CASE label WHEN 't5/of' THEN name LIKE '%t5 of%' WHEN 'out/3 even' THEN o LIKE '%out 3%' AND tag_text LIKE '%even%' WHEN 'rend' THEN e LIKE 'rend%'
  ELSE o LIKE 'out%' AND (regexp_matches(name, '(^| )t1') OR t LIKE 't1%' OR tag_text LIKE 't1%') END GROUP BY 1, 2"""

TYPED = ("OUT 3", "t1_ of", "case t7%f", "nowhere", "t", "%")


def cases_with_text(spark: SparkSession, d: str) -> DataFrame:
    """How many cases of each run hold what was typed in their output or name; files without its trigrams aren't read."""
    v.cases(spark, d)
    table, columns = store.folder_of(spark, d, "cases"), ("output_text", "name")
    path = store.written(spark, d, "cases-trigrams", lambda path: trigrams.build(spark, table, path, columns))
    index, out = trigrams.TrigramIndex(spark, table, path, columns), None
    for typed in TYPED:
        own = trigrams.rows_with(index, ru.case_filter(text=typed), trigrams.literals(typed))
        own = own.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(typed).alias("typed"), "run_id", "n")
        out = own if out is None else out.union(own)
    return out


CASES_WITH_TEXT = f"""{WITH}, q AS (SELECT unnest({list(TYPED)}) AS typed)
SELECT typed, run_id, count(*) AS n FROM q, cases WHERE lower(output_text) LIKE '%' || lower(typed) || '%' OR lower(name) LIKE '%' || lower(typed) || '%' GROUP BY 1, 2"""


def entries_with_text(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the local tier whose request or output holds a text in any case."""
    v.cache_entries(spark, d)
    table, columns = store.written(spark, d, "entries", v.cache_entries(spark, d).write.parquet), ("request_summary", "output_preview")
    path = store.written(spark, d, "entries-trigrams", lambda path: trigrams.build(spark, table, path, columns))
    index, out = trigrams.TrigramIndex(spark, table, path, columns), None
    for typed in ("Answer 42", "U7", "u1 a"):
        # A hit can go over both texts, which are shown with a blank between them.
        parts = [] if " " in typed else [typed.lower()]
        own = trigrams.rows_with(index, cache.entry_filter(text=typed, by_words=False), parts).select(F.lit(typed).alias("typed"), "entry_key")
        out = own if out is None else out.union(own)
    return out


ENTRIES_WITH_TEXT = f"""WITH c AS ({v.CACHE}), q AS (SELECT unnest(['Answer 42', 'U7', 'u1 a']) AS typed)
SELECT typed, entry_key FROM q, c WHERE contains(lower(request_summary || ' ' || output_preview), lower(typed))"""

_Q = {
    "cases_with_text": (cases_with_text, CASES_WITH_TEXT),
    "entries_with_text": (entries_with_text, ENTRIES_WITH_TEXT),
    "document_search": (document_search, DOCUMENT_SEARCH),
    "found_runs": (found_runs, FOUND_RUNS),
    "found_cases": (found_cases, FOUND_CASES),
    "found_phrases": (found_phrases, FOUND_PHRASES),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _Q.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _Q.items() if sql}
