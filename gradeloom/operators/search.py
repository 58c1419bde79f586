"""Word search: every term is the beginning of a word; hits are ranked by BM25. matches() reads every text; text_index finds the same rows by
ranges of an index."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms_of(query: str) -> list[str]:
    """Words of a query; what holds neither letter nor digit is left out."""
    kept = "".join(c.lower() if c.isalnum() else " " for c in query)
    return list(dict.fromkeys(kept.split()))


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _beginning(words: Column, term: str) -> Column:
    """How many words begin with the term."""
    return F.size(F.filter(words, lambda x: x.startswith(term)))


def search(docs: DataFrame, query: str, *, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Rows that hold all terms, with their BM25 score. One pass counts rows, words and rows by term, a second one scores;
    only the one row of counts is broadcast. A query without terms finds nothing."""
    terms = terms_of(query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    held = docs.select(key, tokens(F.col(text)).alias("_words"))
    tf = {f"_tf{i}": _beginning(F.col("_words"), t) for i, t in enumerate(terms)}
    counted = held.select(key, F.size("_words").alias("_n"), *[c.alias(n) for n, c in tf.items()])
    overall = counted.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_mean"), *[F.count_if(F.col(n) > 0).alias(f"{n}_df") for n in tf])
    every = F.lit(True)
    for n in tf:
        every = every & (F.col(n) > 0)
    score = F.lit(0.0)
    for n in tf:
        idf = F.log(1 + (F.col("_docs") - F.col(f"{n}_df") + 0.5) / (F.col(f"{n}_df") + 0.5))
        score = score + idf * F.col(n) * (k1 + 1) / (F.col(n) + k1 * (1 - b + b * F.col("_n") / F.col("_mean")))
    return counted.where(every).join(F.broadcast(overall), F.lit(True)).select(key, score.alias("score"))


def snippet(text: Column, query: str, width: int = 12, opens: str = "", closes: str = "") -> Column:
    """Up to `width` words around the first hit of any term, joined by blanks, hits between the marks; null without one."""
    words = tokens(text)
    hit = lambda x: F.exists(F.array(*[F.lit(t) for t in terms_of(query)]), lambda t: x.startswith(t))
    at = F.array_position(F.transform(words, hit), F.lit(True)).cast("int")
    shown = F.slice(words, F.greatest(F.lit(1), at - width // 2), F.lit(width))
    marked = F.transform(shown, lambda x: F.when(hit(x), F.concat(F.lit(opens), x, F.lit(closes))).otherwise(x)) if opens or closes else shown
    return F.when(at > 0, F.array_join(marked, " "))


def phrases_of(query: str) -> list[list[str]]:
    """The terms of a query as it is typed: blanks part them, and a term with other signs inside is a phrase of several words."""
    found = (terms_in_order(t) for t in query.replace('"', "").split())
    return [p for p in found if p]


def terms_in_order(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def matches(columns: list[Column], query: str) -> Column:
    """Whether every phrase of the query stands in one of the columns: its words one after the other, the last one as a word's
    beginning. A query without words matches nothing."""
    phrases = phrases_of(query)

    def stands(own: Column, phrase: list[str]) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(own) - len(phrase), F.lit(0)))

        def here(i):
            fits = F.get(own, i + len(phrase) - 1).startswith(phrase[-1])
            for k, word in enumerate(phrase[:-1]):
                fits = fits & (F.get(own, i + k) == word)
            return F.coalesce(fits, F.lit(False))

        return F.exists(places, here)

    out = F.lit(bool(phrases))
    for phrase in phrases:
        found = F.lit(False)
        for c in columns:
            found = found | stands(tokens(c), phrase)
        out = out & found
    return out


#: Searched texts of a run and of a case, in this order; those that a table lacks are left out.
RUN_TEXTS = ("project", "suite", "branch", "git_commit", "description", "tag_text")
CASE_TEXTS = ("name", "prompt_text", "output_text", "error_class", "tag_text", "test_id")
#: The marks of a hit and the sign for what is left out, and the words that a snippet shows.
OPENS, CLOSES, LEFT_OUT, SHOWN = "\ue000", "\ue001", "\u2026", 12


def texts_of(df: DataFrame, names: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(c for c in names if c in df.columns)


def best_window(texts: tuple[str | None, ...], phrases: list[list[str]], width: int) -> tuple[list[str], int, set[int]] | None:
    """Words of the text that holds the best window, where that begins, and which of its words belong to hits."""
    best = None
    for column, text in enumerate(texts):
        words = WORD_RUNS.findall(text or "")
        lower = [w.lower() for w in words]
        hits = [(i, n) for i in range(len(words)) for n, p in enumerate(phrases) if lower[i : i + len(p) - 1] == p[:-1] and i + len(p) <= len(words) and lower[i + len(p) - 1].startswith(p[-1])]
        first, last = 0, max(len(words) - width, 0)
        for begin in sorted({min(i, last) for i, _ in hits}):
            while first < len(hits) and hits[first][0] < begin:
                first += 1
            inside = hits[first : next((k for k in range(first, len(hits)) if hits[k][0] >= begin + width), len(hits))]
            rank = (len({n for _, n in inside}), len(inside), -column, -begin)
            if best is None or rank > best[0]:
                best = (rank, words, begin, inside)
    return best and (best[1], best[2], {i + k for i, n in best[3] for k in range(len(phrases[n]))})


#: Runs of letters and digits, in Python as in tokens().
WORD_RUNS = regex.compile(r"[\p{L}\p{N}]+")


def best_snippet(columns: list[Column], query: str, width: int = SHOWN, opens: str = OPENS, closes: str = CLOSES, left_out: str = LEFT_OUT) -> Column:
    """The `width` words of one column that hold most different phrases of the query, joined by blanks, their words between marks. A window begins
    with a phrase or ends with the text; of windows that hold equally many phrases the one with more hits, then the first one of the first
    column. Null without a hit in any column. It is made for the hits that are shown, so in Python, by batches."""
    phrases = phrases_of(query)

    @F.pandas_udf("string")
    def shown(*batch: pd.Series) -> pd.Series:
        out = []
        for texts in zip(*batch, strict=True):
            found = best_window(texts, phrases, width)
            if found is None:
                out.append(None)
                continue
            words, begin, marked = found
            text = " ".join(f"{opens}{w}{closes}" if i in marked else w for i, w in enumerate(words[begin : begin + width], begin))
            out.append((left_out if begin else "") + text + (left_out if begin + width < len(words) else ""))
        return pd.Series(out, dtype=object)

    return shown(*columns)


def search_runs(index, runs: DataFrame, query: str, most: int = 50) -> DataFrame:
    """The given (visible, filtered) runs whose texts match, by rank, newer runs first among equals: run_id, project, suite, created_at, snippet,
    cached (whether the whole run was replayed; null where its counts are unknown), rank and score."""
    from gradeloom.operators import text_index

    names = texts_of(runs, RUN_TEXTS)
    known = (F.coalesce(F.col("cache_hits"), F.lit(-1)) >= 0) & (F.coalesce(F.col("cache_misses"), F.lit(-1)) >= 0)
    cached = F.when(known, (F.col("cache_misses") == 0) & (F.col("cache_hits") > 0))
    found = text_index.cut_to(text_index.hits(index, query).join(runs, "run_id"), most, F.desc(F.round("score", 9)), F.desc("created_at"), F.desc("run_id"))
    shown = best_snippet([F.col(c) for c in names], query)
    return found.select("run_id", "project", "suite", "created_at", shown.alias("snippet"), cached.alias("cached"), "rank", "score")


def search_cases(index, cases: DataFrame, runs: DataFrame, query: str, most: int = 50) -> DataFrame:
    """Cases of the given (visible, filtered) runs whose texts match, by rank, newer runs first among equals: their keys, name, status, project and
    suite of the run, snippet, cached (null where it isn't known), rank and score. Filters on runs are about the owning run, cached is the case's own."""
    from gradeloom.operators import text_index

    names = texts_of(cases, CASE_TEXTS)
    own = runs.select("run_id", F.col("project").alias("_project"), F.col("suite").alias("_suite"), F.col("created_at").alias("_created"))
    met = text_index.hits(index, query).join(own, "run_id")
    # The first `most` are cut before texts are fetched; what the join with cases drops (a case deleted since) was cut by remove().
    first = text_index.cut_to(met, most, F.desc(F.round("score", 9)), F.desc("_created"), F.desc("run_id"), F.col("case_key"))
    found = F.broadcast(first).join(cases.select("run_id", "case_key", *dict.fromkeys((*names, "name", "status", "cached"))), ["run_id", "case_key"])
    shown = best_snippet([F.col(c) for c in names], query)
    return found.select("run_id", "case_key", "name", "status", F.col("_project").alias("project"), F.col("_suite").alias("suite"), shown.alias("snippet"), "cached", "rank", "score")
