"""Searches by an index against searches that read every text, and snippets against a plain choice of windows."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import runs, search, text_index, trigrams
from gradeloom.plans import store

WORDS = ["ab", "abc", "b", "ba", "bab", "Cb", "É", "éa", "42", "421", "東京"]
QUERIES = ["ab", "ab/b", "b/ab ba", "4", "É", "b-b", "ab ab", "東", "* --", "", "cb/42/a", "zzz", "ab zzz"]


def folder(spark):
    return f"{store.shared_folder(spark)}/{uuid.uuid4().hex}"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", ",", "/", " -- "]) for _ in range(rng.randrange(n)))
    data = [(i, f"k{i % 3}", text(30), text(4)) for i in range(200)] + [(300, "k0", None, None), (301, "k1", "", "ab b"), (None, "k0", "ab b", "ab"), (302, "k2", "b ab " * 2000, "ba")]
    return spark.createDataFrame(data, "n int, k string, text string, more string").cache()


def scanned(rows, query):
    """Keys of rows that match, and the score of each, from their words."""
    phrases = search.phrases_of(query)
    docs = [(r.n, r.k, [re.findall(r"[^\W_]+", (x or "").lower()) for x in (r.text, r.more)]) for r in rows.where("n IS NOT NULL").collect()]
    import math

    def count(phrase, columns):
        return sum(w[i : i + len(phrase) - 1] == phrase[:-1] and w[i + len(phrase) - 1].startswith(phrase[-1]) for w in columns for i in range(len(w) - len(phrase) + 1))

    counts = [(n, k, sum(map(len, c)), [count(p, c) for p in phrases]) for n, k, c in docs]
    mean = sum(c[2] for c in counts) / max(1, len(counts))
    df = [sum(c[3][j] > 0 for c in counts) for j in range(len(phrases))]
    idf = [math.log(1 + (len(counts) - f + 0.5) / (f + 0.5)) for f in df]
    return {(n, k): sum(i * h * 2.2 / (h + 1.2 * (0.25 + 0.75 * size / mean)) for i, h in zip(idf, hits, strict=True)) for n, k, size, hits in counts if phrases and all(hits)}


def indexed(index, query):
    return {(r.n, r.k): r.score for r in text_index.hits(index, query).collect()}


def test_index_finds_what_a_scan_finds(spark, rows):
    index = text_index.build(rows, folder(spark), key=("n", "k"), columns=("text", "more"))
    for query in QUERIES:
        want = scanned(rows, query)
        assert indexed(index, query) == pytest.approx(want), query
        read = rows.where("n IS NOT NULL").where(search.matches([F.col("text"), F.col("more")], query))
        assert {(r.n, r.k) for r in read.collect()} == set(want)


def test_generations_and_removal(spark, rows):
    path = folder(spark)
    index = text_index.build(rows.where("n < 80"), path, key=("n", "k"), columns=("text", "more"))
    text_index.remove(index, rows.where("n < 40").select("n", "k"))
    text_index.add(index, rows.where("n >= 80 OR n < 20"), ("text", "more"))
    text_index.remove(index, rows.where("n = 90").select("n", "k"))
    left = rows.where("n >= 40 AND n <> 90 OR n < 20")
    for query in ("ab", "ab/b", "b/ab ba"):
        assert indexed(text_index.TextIndex(spark, path, ("n", "k")), query) == pytest.approx(scanned(left, query))
    # A generation whose writer was lost before its stats is written over.
    rows.limit(0).select("n", "k", F.lit(0).alias("n_words")).write.parquet(f"{path}/rows/generation=2")
    text_index.add(index, rows.where("n = 90"), ("text", "more"))
    assert indexed(index, "ab") == pytest.approx(scanned(rows.where("n >= 40 OR n < 20"), "ab"))
    empty = text_index.build(rows.limit(0), folder(spark), key=("n", "k"), columns=("text",))
    assert indexed(empty, "ab") == {}


def test_words_are_ranges_of_files(spark, rows):
    index = text_index.build(rows, folder(spark), key=("n", "k"), columns=("text",))
    plan = text_index.ranges(index, "ab/b")._jdf.queryExecution().toString()
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan)[1]
    assert "EqualTo(term,ab)" in pushed and "StringStartsWith(term,b)" in pushed


def best(columns, query, width):
    phrases, found = search.phrases_of(query), None
    for c, text in enumerate(columns):
        words = re.findall(r"[^\W_]+", text or "")
        lower = [w.lower() for w in words]
        hits = [(i, n) for i in range(len(words)) for n, p in enumerate(phrases) if lower[i : i + len(p) - 1] == p[:-1] and i + len(p) <= len(words) and lower[i + len(p) - 1].startswith(p[-1])]
        for begin in {min(i, max(len(words) - width, 0)) for i, _ in hits}:
            inside = [(i, n) for i, n in hits if begin <= i < begin + width]
            rank = (len({n for _, n in inside}), len(inside), -c, -begin)
            if found is None or rank > found[0]:
                found = (rank, words, inside, begin)
    if found is None:
        return None
    _, words, inside, begin = found
    marked = {i + k for i, n in inside for k in range(len(phrases[n]))}
    text = " ".join(f"[{w}]" if i in marked else w for i, w in enumerate(words) if begin <= i < begin + width)
    return ("…" if begin else "") + text + ("…" if begin + width < len(words) else "")


@pytest.mark.parametrize("width", [2, 5, 12])
def test_snippet_is_the_best_window(rows, width):
    own = rows.where("n < 60 OR n >= 300")
    for query in ("ab", "ab/b", "b/ab ba", "4 É cb", ""):
        shown = own.select("text", "more", search.best_snippet([F.col("text"), F.col("more")], query, width, "[", "]").alias("s")).collect()
        assert [r.s for r in shown] == [best((r.text, r.more), query, width) for r in shown]


def test_hits_join_runs_and_cases(spark):
    runs = spark.createDataFrame([("r1", "p", "s", 1, "main", "c1", 2, 0, "nightly"), ("r2", "p2", "s", 2, "dev", None, None, 0, "nightly slow"), ("r3", "p", "s", 3, "main", "c2", 0, 5, "")],
                                 "run_id string, project string, suite string, created_at long, branch string, git_commit string, cache_hits long, cache_misses long, tag_text string")
    cases = spark.createDataFrame([("r1", "a", "Zorb Blatt", "pass", True, "out one"), ("r2", "a", "zorb", "fail", None, "out two"), ("r2", "b", None, "error", False, "zorblatt out")], "run_id string, case_key string, name string, status string, cached boolean, output_text string")
    of_runs = text_index.build(runs, folder(spark), key=("run_id",), columns=search.texts_of(runs, search.RUN_TEXTS))
    of_cases = text_index.build(cases, folder(spark), key=("run_id", "case_key"), columns=search.texts_of(cases, search.CASE_TEXTS))
    found = search.search_runs(of_runs, runs, "night").orderBy("rank").collect()
    assert [(r.run_id, r.cached) for r in found] == [("r2", None), ("r1", True)] and found[1].snippet == f"{search.OPENS}nightly{search.CLOSES}"
    assert search.search_runs(of_runs, runs.where("project = 'p'"), "slow").count() == 0
    hits = search.search_cases(of_cases, cases, runs.where("run_id <> 'r1'"), "zorb", 1).collect()
    assert [(r.run_id, r.case_key, r.status, r.project, r.cached) for r in hits] in ([("r2", "a", "fail", "p2", None)], [("r2", "b", "error", "p2", False)])
    for junk in ("AND", '"((', "a OR NOT (", "--", "*", "  "):
        assert search.search_cases(of_cases, cases, runs, junk).count() == 0


def test_trigrams_skip_files(spark):
    table, columns = folder(spark), ("output_text", "name")
    words = ["alpha", "Bravo", "čarli", "delta", "echo_x", "fox%trot", None, "ab"]
    data = [(i, f"{words[i % 8]} {i}" if words[i % 8] else None, words[(i + 3) % 8]) for i in range(400)]
    df = spark.createDataFrame(data, "i int, output_text string, name string")
    df.repartitionByRange(20, "i").write.parquet(table)
    index = trigrams.build(spark, table, folder(spark), columns)
    rows = spark.read.parquet(table)
    for typed in ("BRAVO 1", "ČAR", "echo_x", "alpha 8%", "l_ha", "ab", "zzz", "", "delta 35", "%", "a%o_x"):
        condition, parts = runs.case_filter(text=typed), trigrams.literals(typed)
        got = trigrams.rows_with(index, condition, parts)
        assert sorted(r.i for r in got.collect()) == sorted(r.i for r in rows.where(condition).collect()), typed
    assert len(trigrams.files_for(index, ["delta 355"])) < 5 and trigrams.files_for(index, ["zzz"]) == [] and len(trigrams.files_for(index, ["ab"])) == 20
    # Files that came later are read until they are indexed.
    df.where("i = 355").write.mode("append").parquet(table)
    found = lambda: trigrams.rows_with(index, runs.case_filter(text="bravo 1"), ["bravo 1"])
    before = len(trigrams.files_for(index, ["bravo 1"]))
    assert trigrams.extend(index) >= 1 and trigrams.extend(index) == 0 and len(trigrams.files_for(index, ["bravo 1"])) < before
    assert found().count() == rows.where(runs.case_filter(text="bravo 1")).count()
