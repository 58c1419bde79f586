"""Ranked search, importance resampling and nearest neighbours against brute force and edge cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from gradeloom.llm import dimension_scan, impact_index, queries, shared, sort_count

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, item long, score double, terms string, rank int, v string, node long"
LONG = " ".join(f"w{i % 977}" for i in range(1_000_000))
ROWS = [
    (1, "Alpha beta alpha GAMMA"), (2, "alpha beta"), (3, None), (4, ""), (5, " \n--"), (6, "beta-beta 12 x"), (6, "beta-beta 12 x"), (None, "alpha ÄÖ ß 東京"), (7, "İstanbul ÄÖ"), (8, "alpha " * 300), (9, "alpha beta"),
]
ITEMS = [(1, "ALPHA beta beta"), (2, "nothing here"), (3, None), (4, ""), (1, "12"), (5, "äö ÄÖ"), (None, "gamma x")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 0.5, "t", 2, "v", 3) for i, t in ROWS], SCHEMA)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def cut(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_search(docs, items, k):
    docs = [(i, n, collections.Counter(w)) for i, t in docs if (n := len(w := cut(t)))]
    total, df = sum(n for _, n, _ in docs), collections.Counter(w for _, _, c in docs for w in c)
    out = []
    for item, text in items:
        asked, found = collections.Counter(cut(text)), []
        for i, n, c in docs:
            m = 75 + (25 * n * len(docs)) // total
            one = lambda w: math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))  # noqa: B023, E731
            if (score := sum(times * one(w) for w, times in asked.items() if w in c)) > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return out


def as_set(rows):
    return collections.Counter(map(tuple, rows))


@pytest.mark.parametrize(("words", "places", "at_once", "block"), [(200_000, 4096, 1_000_000, 100_000), (5, 4096, 3, 2), (200_000, 2, 1, 1)])
def test_search_equals_plain_search(spark, docs, monkeypatch, words, places, at_once, block):
    monkeypatch.setattr(impact_index, "SEGMENT_WORDS", words)
    monkeypatch.setattr(impact_index, "SEGMENT_DOCS", places)
    monkeypatch.setattr(impact_index, "AT_ONCE", at_once)
    index = impact_index.build(docs, shared.new_folder(spark, "t"))
    again = impact_index.open_index(spark, index.path)
    assert (again.n_docs, again.n_words) == (index.n_docs, index.n_words) == (8, sum(len(cut(t)) for _, t in ROWS))
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank int")
    for k in (1, 2, 20):
        assert as_set(impact_index.search(again, items, k=k, block_terms=block).collect()) == as_set(plain_search(ROWS, ITEMS, k))


def test_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    nothing = impact_index.build(empty, shared.new_folder(spark, "t"))
    assert impact_index.search(nothing, items).count() == 0
    index = impact_index.build(docs, shared.new_folder(spark, "t"))
    assert impact_index.search(index, items.limit(0)).count() == 0


def test_search_of_very_long_text(spark):
    rows = [(1, LONG), (2, "w5 w6"), (3, "w5 " + LONG)]
    index = impact_index.build(spark.createDataFrame(rows, "doc_id long, text string"), shared.new_folder(spark, "t"))
    items = [(1, "w5 w6 w6"), (2, LONG[:400_000])]
    assert as_set(impact_index.search(index, spark.createDataFrame(items, "item_id long, text string")).collect()) == as_set(plain_search(rows, items, 20))


def test_bounds_hold_and_spare_documents():
    rng = np.random.default_rng(3)
    docs = [(i, [b"t%d" % x for x in rng.zipf(1.3, rng.integers(5, 60)) % 300]) for i in range(3000)]
    batch = impact_index._segment([i for i, _ in docs], [w for _, w in docs])
    total = sum(len(w) for _, w in docs)
    batch = next(impact_index._rounded_up(len(docs), total)(iter([batch])))
    df = collections.Counter(w for _, ws in docs for w in set(ws))
    asked = [(0, b"t5", 1), (0, b"t17", 2), (0, b"t40", 1), (1, b"t2", 1)]
    block = impact_index.Block(asked, df, len(docs), 10)
    bounds = next(block.lower_bounds(iter([batch]))).to_pylist()
    thresholds = np.array([min(r["bound"] for r in bounds if r["item"] == i) for i in (0, 1)])
    told = []
    got = next(block.best_scores(thresholds, lambda n: impact_index.length_factors(n, len(docs), total), told)(iter([batch]))).to_pylist()
    texts = [(i, b" ".join(w).decode()) for i, w in docs]
    want = plain_search(texts, [(0, "t5 t17 t17 t40"), (1, "t2")], 10)
    assert [(r["item"], r["doc_id"], r["score"]) for r in got] == [(i, d, s) for i, _, d, s in want]
    assert all(t <= s for t, s in zip(thresholds.tolist(), (min(s for i, _, _, s in want if i == k) for k in (0, 1)), strict=True))
    assert sum(told) < 0.1 * 2 * len(docs)


def plain_resampling(docs, items, buckets, percent, least):
    def features(text):
        w = cut(text)
        return [zlib.crc32(x.encode()) % buckets for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    docs = [(i, features(t)) for i, t in docs]
    s, t = (collections.Counter(x for f in own for x in f) for own in ([f for _, f in docs], [features(x) for _, x in items]))
    ss, tt, rows = sum(s.values()), sum(t.values()), []
    for i, f in docs:
        gain = [math.floor(1000 * math.log((t[x] + 1) * (ss + buckets) / ((s[x] + 1) * (tt + buckets)))) for x in f]
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain) // len(gain) if gain else 0
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if (r[1] + 1) // 2 >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = collections.defaultdict(list)
    for k, r in enumerate(able[: percent * len(able) // 100]):
        drawn[r].append(k + 1)
    return collections.Counter((*r, drawn[r].pop() if drawn[r] else None) for r in rows)


@pytest.mark.parametrize(("buckets", "percent", "least", "words"), [(10_000, 25, 20, 200_000), (7, 60, 2, 3), (65_536, 100, 0, 200_000)])
def test_resampling_equals_plain(spark, docs, empty, monkeypatch, buckets, percent, least, words):
    monkeypatch.setattr(sort_count, "STREAM_WORDS", words)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    more = [*ROWS, (20, "x" * 300 + " " + "y" * 700 + " z"), *((100 + i, f"alpha b{i % 3} " * 12) for i in range(40))]
    table = spark.createDataFrame([(i, t, 1, 0.5, "t", 2, "v", 3) for i, t in more], SCHEMA)
    got = sort_count.resample(table, items, buckets=buckets, percent=percent, min_words=least)
    assert as_set(got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain_resampling(more, ITEMS, buckets, percent, least)
    assert sort_count.resample(empty, items).count() == 0
    assert as_set(sort_count.resample(docs, items.limit(0)).select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain_resampling(ROWS, [], 10_000, 25, 20)


def test_joined_crc_of_any_size():
    rng = np.random.default_rng(1)
    pairs = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(0, 40, (200, 2))] + [(b"abc", rng.bytes(255)), (b"abc", rng.bytes(256)), (b"", rng.bytes(5000))]
    crc = lambda of: np.array([zlib.crc32(x) for x in of], np.uint32)
    got = sort_count.joined_crc(crc(a for a, _ in pairs), crc(b for _, b in pairs), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_run_lengths_and_means():
    stream = np.array([5, 1, 5, 5, 0, 1], np.uint16)
    assert [x.tolist() for x in sort_count.run_lengths(stream)] == [[0, 1, 5], [1, 2, 3]]
    assert [x.tolist() for x in sort_count.run_lengths(stream[:0])] == [[], []]
    gain = np.array([-7, 1, 0, 0, 0, 2])
    assert sort_count.mean_gains(stream, np.array([0, 0, 2, 6, 6]), gain).tolist() == [0, 1, -1, 0]


def test_very_long_text_is_resampled_whole(spark):
    rows = [(1, LONG), (2, "w1 w2 " * 20)]
    got = {r.doc_id: r for r in sort_count.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")).collect()}
    assert got[1].n_features == 1_999_999 and as_set(got.values()) == plain_resampling(rows, [(1, "w1 w2")], 10_000, 25, 20)


def exact_neighbours(rows, k, every):
    """Distinct ids with vectors to query -> [(id, score)], in double precision."""
    ids, x = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)], float)
    out = {}
    for q in ids[ids % every == 0].tolist():
        score = x @ np.array(rows[q], float)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def by_query(df):
    out = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    assert set(got) == {q for q, own in want.items() if own} and all(len(got[q]) == len(want[q]) for q in got)
    for own in got.values():
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in got) / sum(map(len, want.values()))


@pytest.mark.parametrize("shape", ["spread", "clusters", "lengths"])
def test_neighbours_have_recall(spark, shape):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 40))
    if shape == "clusters":
        x = rng.normal(size=(30, 40))[rng.integers(0, 30, 3000)] + 0.3 * x
    if shape == "lengths":
        x *= rng.lognormal(size=(3000, 1))
    x = x.astype(np.float32)
    # A third of the rows are one vector.
    x[rng.choice(3000, 1000, replace=False)] = x[0]
    rows = {i: v.tolist() for i, v in enumerate(x)}
    df = spark.createDataFrame([(i, v, i % 3) for i, v in rows.items()], "vec_id long, embedding array<float>, list int").repartition(5)
    got, want = by_query(dimension_scan.nearest(df)), exact_neighbours(rows, 20, 20)
    assert recall(got, want) >= 0.9
    for q, own in got.items():
        assert np.allclose([s for _, s in own], [np.dot(x[q].astype(float), x[i].astype(float)) for i, _ in own], rtol=1e-12, atol=1e-12)
    hot = next(q for q in got if q and (x[q] == x[0]).all()) if shape == "spread" else None
    if hot:
        same = [i for i in range(3000) if i != hot and (x[i] == x[0]).all()]
        assert [i for i, _ in got[hot]] == same[:20]


def test_neighbours_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (40, [0.0, 0.0]), (60, None), (80, [nan, 1.0]), (1, [inf, 1.0]), (2, [1.0, None]), (3, [1.0]), (4, []), (None, [9.0, 9.0]), (5, [-1.0, 0.0]), (6, [1.0, 0.0]), (6, [1.0, 0.0]), (-20, [2.0, 1.0]), (7, [3.0, 0.0]), (7, [2.0, 9.0])]
    df = spark.createDataFrame([(i, v, 1, 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, node int, score double, list int")
    kept = {0: [1, 0], 20: [0.5, 0.5], 5: [-1, 0], 6: [1, 0], -20: [2, 1], 7: [2, 9]}
    for k in (1, 2, 20):
        assert by_query(dimension_scan.nearest(df, k=k)) == exact_neighbours(kept, k, 20)
    assert dimension_scan.nearest(df.limit(0)).count() == 0 and dimension_scan.nearest(df.where("vec_id = 0")).count() == 0


def test_scan_gives_candidates_up_early():
    rng = np.random.default_rng(2)
    x = 2 * rng.normal(size=(20, 128))[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 128))
    q = x[:50] + 0.5 * rng.normal(size=(50, 128))
    turn = dimension_scan.rotation(128, 1)
    planes = [np.ascontiguousarray((x @ turn)[:, a : a + 16].astype(np.float32)) for a in range(0, 128, 16)]
    told = []
    i, score, node = dimension_scan.scan((q @ turn).astype(np.float32), q, np.full(50, -np.inf), np.arange(2000), x, planes, 10, 2.1, told)
    want = np.argsort(-(q @ x.T), axis=1)[:, :10]
    hits = sum(len(set(node[i == k]) & set(want[k])) for k in range(50))
    assert hits >= 0.97 * 500 and np.allclose(score, (q @ x.T)[i, node]) and sum(told) < 0.4 * 50 * 2000 * 128


@pytest.mark.parametrize("name", ["op11_impact_index", "op12_sort_count"])
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = queries.queries()[name](spark, SF)
    assert as_set(got.collect()) == as_set(db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_nearest_query_has_recall(spark):
    got = by_query(queries.queries()["op13_dimension_scan"](spark, SF))
    rows = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert recall(got, exact_neighbours(rows, 20, 20)) >= 0.9
