"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set: each run of five words (a shorter text is one shingle), weighted by its count times its
idf, 1 + ln(N / df), where df is the number of texts that hold the shingle, taken as at least idf_floor of all N. Texts that
more than copies_share of all rows have count once together (each row for its part), so that copies weigh nothing down; rarer
ones count by row. So only shingles in more than the share idf_floor weigh less than the rest; these few are counted exactly.

Equal word sequences form one class first, and one of each goes on. Improved consistent weighted sampling draws `bands` x
`rows` samples, alike for two documents with the probability of their weighted Jaccard similarity. Documents that agree in
all rows of a band share a bucket. First its members meet one pivot, the member whose bands lie in the most crowded buckets
(the middle of a group of near copies): the sketches, then (if these agree in enough samples) the whole texts, whose exact
weighted Jaccard similarity decides. This makes one class of most groups of near copies. A pivot's members are salted into
groups of bounded size. Buckets that still hold several classes are dealt into blocks, and every pair of blocks is one group of
a task, in which all pairs of different classes meet: first the sketches of blocks of `block` members, then, of the
members of pairs that agree, the texts of blocks of about `block_shingles` shingles, until a pair is in one class or its texts
were compared. Pairs become no rows. A pair of several buckets meets in its first band alone. Classes are the connected
components of all links, so every pair that shares a band and agrees is linked, connected or not similar.

Null and empty texts, and texts of white space alone, are one class. Repeated rows are in one class by their equal texts; each returns a row.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gradeloom.llm import shared

C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(31))


def _gamma_quantiles(bits: int = 12) -> np.ndarray:
    """Gamma(2, 1) at the middles of 2^bits equal shares of probability: F(x) = 1 - (1 + x) e^-x, inverted by halving."""
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    low, high = np.zeros_like(p), np.full_like(p, 50.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def hashed(counts: np.ndarray, h: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every shingle of documents with counts[i] words of hashes h."""
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    at = shared.runs(np.cumsum(counts) - counts, n)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    short = np.flatnonzero(counts[doc] < size)
    left = counts[doc[short]]
    x = np.zeros(len(at), np.uint64)
    for k in range(size):
        y = padded[at + k]
        y[short] = np.where(k < left, y[short], np.uint64(k + 1))
        x = x * np.uint64(0x9E3779B97F4A7C15) + y
        x ^= x >> np.uint64(29)
    return doc, mixed(x)


def shingles(counts: np.ndarray, h: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of each distinct shingle, by document."""
    return _distinct(*hashed(counts, h, size))


def _distinct(doc: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((x, doc))
    doc, x = doc[order], x[order]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (x[1:] != x[:-1])]) if len(x) else np.empty(0, np.int64)
    return doc[cut], x[cut], np.diff(np.r_[cut, len(x)]) if len(x) else cut


def _document_counts(doc: np.ndarray, x: np.ndarray, keys: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Sums of the parts of the documents that hold each of the sorted keys."""
    if not len(keys) or not len(x):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    hit = keys[at] == x
    pair = np.unique(at[hit] * (int(doc[-1]) + 1) + doc[hit])
    return np.bincount(pair // (int(doc[-1]) + 1), part[pair % (int(doc[-1]) + 1)], minlength=len(keys))


class Weigher:
    """Weights of shingles: count times idf, the latter of 1 for all that are not in the table of frequent ones."""

    def __init__(self, table: tuple[np.ndarray, np.ndarray]):
        self.keys, self.idf = table

    def __call__(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = n.astype(np.float64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
            out = np.where(self.keys[at] == x, out * self.idf[at], out)
        return out


class Sampler:
    def __init__(self, samples: int, seed: int = 41):
        self.r, self.seeds = _gamma_quantiles(), mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))
        self.r = self.r.astype(np.float32)
        self.log_c = np.log(self.r)

    def sketch(self, doc: np.ndarray, x: np.ndarray, w: np.ndarray, n_docs: int) -> np.ndarray:
        """n_docs x samples numbers of 32 bits (documents without shingles: zeros). For each sample, r and c are
        Gamma(2, 1), b uniform, t = floor(ln w / r + b); the shingle with the least ln c - r (t - b + 1) is drawn."""
        out = np.zeros((n_docs, len(self.seeds)), np.uint32)
        if not len(x):
            return out
        begun = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        size, who = np.diff(np.r_[begun, len(doc)]), doc[begun]
        log_w = np.log(w).astype(np.float32)
        plain = not log_w.any()
        one = np.float32(1)
        for k, seed in enumerate(self.seeds):
            y = x ^ seed
            y *= C1
            y ^= y >> np.uint64(31)
            y *= C2
            low, high = y.view(np.uint32)[0::2], y.view(np.uint32)[1::2]
            r = self.r.take(high >> np.uint32(20), mode="clip")
            b = (low >> np.uint32(8)).view(np.int32).astype(np.float32)
            b *= np.float32(2**-24)
            t = np.float32(0) if plain else np.floor(log_w / r + b)
            a = self.log_c.take((high >> np.uint32(8)) & np.uint32(0xFFF), mode="clip") - r * (t - b + one)
            least = np.repeat(np.minimum.reduceat(a, begun), size)
            hit = np.flatnonzero(a == least)
            # The first of equals, in the order of the shingles' hashes.
            hit = hit[np.r_[True, doc[hit][1:] != doc[hit][:-1]]]
            drawn = x[hit] if plain else x[hit] + t[hit].astype(np.int64).astype(np.uint64) * C1
            out[who, k] = (mixed(drawn) >> np.uint64(32)).astype(np.uint32)
        return out


def _chunks(batches, most_words: int):
    """Rows (without their text), their word counts and joined word hashes, in bounded chunks."""
    memo = shared.WordHash()
    rows, found = [], []
    n = 0
    for batch in batches:
        for row in shared.rows_of(batch):
            own = shared.words(row[-1])
            rows.append(row[:-1])
            found.append(memo.all(own))
            n += len(own)
            if n >= most_words:
                yield rows, np.array([len(f) for f in found], np.int64), np.concatenate(found)
                rows, found, n = [], [], 0
    if rows:
        yield rows, np.array([len(f) for f in found], np.int64), np.concatenate(found)


LIKELY = "shingle long, excess double, rows double"


def _likely(share: float, size: int):
    def likely(batches):
        """Shingles that more than `share` of a chunk's documents hold, with what they have above that share; for each chunk also a
        row without shingle: its documents. A document counts for its part of all copies."""
        for rows, counts, h in _chunks(batches, 200_000):
            part = np.array([r[0] for r in rows])
            doc, x = hashed(counts, h, size)
            most = share * part.sum()
            keys, repeats = np.unique(x, return_counts=True)
            # No part is above 1, so fewer places than `most` can't be enough.
            keys = keys[repeats > most]
            df = _document_counts(doc, x, keys, part)
            keys, df = keys[df > most], df[df > most]
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *keys.view(np.int64).tolist()], pa.int64()), pa.array(np.r_[0.0, df - most]), pa.array(np.r_[part.sum(), np.zeros(len(keys))])], names=["shingle", "excess", "rows"]
            )

    return likely


def _counted(keys: np.ndarray, size: int):
    def counted(batches):
        total = np.zeros(len(keys))
        for rows, counts, h in _chunks(batches, 200_000):
            total += _document_counts(*hashed(counts, h, size), keys, np.array([r[0] for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(total)], names=["shingle", "df"])

    return counted


def _all_counted(size: int):
    def counted(batches):
        for rows, counts, h in _chunks(batches, 200_000):
            doc, x, _ = shingles(counts, h, size)
            keys, at = np.unique(x, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, np.array([r[0] for r in rows])[doc], len(keys)))], names=["shingle", "df"])

    return counted


def idf_table(docs: DataFrame, *, size: int = 5, idf_floor: float = 0.02, copies_share: float = 0.001, most_sent: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles in more than idf_floor of docs, and their idf relative to that of all others. There
    are at most (mean number of shingles) / idf_floor of them. Shingles that may be among them stay in Spark; only up to
    most_sent of them are sent to the tasks that count, more meet the counts of all shingles in a join."""
    texts = shared.texts_of(docs)
    key = F.xxhash64("text")
    # At most 1 / copies_share texts are that frequent.
    counts = texts.groupBy(key.alias("copy")).agg(F.count(F.lit(1)).alias("copies"))
    copied = counts.where(F.col("copies") > F.greatest(F.lit(1.0), F.lit(copies_share * docs.count())))
    texts = texts.withColumn("copy", key).join(F.broadcast(copied), "copy", "left").select((1 / F.coalesce("copies", F.lit(1))).alias("part"), "text")
    # A chunk that doesn't tell a shingle holds it in at most half of idf_floor of its documents.
    likely = shared.stored(texts.mapInArrow(_likely(idf_floor / 2, size), LIKELY).groupBy("shingle").agg(F.sum("excess").alias("excess"), F.sum("rows").alias("rows")), "likely")
    n = (likely.where("shingle is null").select("rows").first() or (0,))[0]
    keys = likely.where(F.col("shingle").isNotNull() & (F.col("excess") > idf_floor / 2 * n)).select("shingle")
    n_keys = keys.count()
    if not n_keys:
        return np.empty(0, np.uint64), np.empty(0)
    if n_keys <= most_sent:
        sent = np.sort(np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64))
        parts = texts.mapInArrow(_counted(sent, size), "shingle long, df double")
    else:
        parts = texts.mapInArrow(_all_counted(size), "shingle long, df double").join(keys, "shingle", "left_semi")
    got = parts.groupBy("shingle").agg(F.sum("df").alias("df")).where(F.col("df") > idf_floor * n).collect()
    got = sorted((np.int64(r["shingle"]).view(np.uint64), r["df"]) for r in got)
    most = 1 + math.log(1 / idf_floor)
    # Rounded, as sums of parts depend on their order in the last digits.
    return np.array([g[0] for g in got], np.uint64), np.array([round((1 + math.log(max(1.0, n / g[1]))) / most, 9) for g in got])


PAIR = "node long, pivot long"
SKETCH = "doc_id long, row_no long, same_a long, same_b long, n_shingles int, sketch binary"


def _sketches(table, samples: int, size: int):
    def sketches(batches):
        weigh, sampler = Weigher(table), Sampler(samples)
        order = np.uint64(0x9E3779B97F4A7C15)
        for rows, counts, h in _chunks(batches, 40_000):
            doc, x, n = shingles(counts, h, size)
            sketch = sampler.sketch(doc, x, weigh(x, n), len(rows))
            # Two 64-bit hashes of the whole word sequence.
            begun, same = np.minimum(np.cumsum(counts) - counts, max(0, len(h) - 1)), []
            for base in (order, C2 | np.uint64(1)):
                power = np.cumprod(np.full(max(1, int(counts.max())), base, np.uint64))
                place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
                sums = np.add.reduceat(mixed(h + base) * power[place], begun) if len(h) else np.zeros(len(rows), np.uint64)
                same.append(mixed(np.where(counts > 0, sums, np.uint64(0)) + counts.astype(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(same[0]), pa.array(same[1]), pa.array(np.bincount(doc, minlength=len(rows)).astype(np.int32)), pa.array([s.tobytes() for s in sketch], pa.binary())],
                names=["doc_id", "row_no", "same_a", "same_b", "n_shingles", "sketch"],
            )

    return sketches


def _bands(bands: int, rows: int):
    def banded(batches):
        for batch in batches:
            data = batch.column("sketch").to_pylist()
            s = np.frombuffer(b"".join(data), np.uint32).reshape(len(data), bands, rows)
            x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * C2, s.shape[:2])
            for k in range(rows):
                x = mixed(x + s[:, :, k])
            node, band = np.repeat(batch.column("node").to_numpy(), bands), np.tile(np.arange(bands, dtype=np.int32), len(data))
            yield pa.RecordBatch.from_arrays([pa.array(x.reshape(-1).view(np.int64)), pa.array(band), pa.array(node)], names=["bucket", "band", "node"])

    return banded


def _agreeing(least: float):
    def agreeing(batches):
        for batch in batches:
            a, b = batch.column("sketch").to_pylist(), batch.column("pivot_sketch").to_pylist()
            if not a:
                continue
            same = (np.frombuffer(b"".join(a), np.uint32).reshape(len(a), -1) == np.frombuffer(b"".join(b), np.uint32).reshape(len(a), -1)).mean(axis=1)
            keep = pa.array(same >= least)
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(keep), batch.column("pivot").filter(keep)], names=["node", "pivot"])

    return agreeing


def similarity(x: np.ndarray, w: np.ndarray, y: np.ndarray, v: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted sets of shingles with weights."""
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = y[at] == x if len(y) else np.zeros(len(x), bool)
    shared_weight = float(np.minimum(w[both], v[at[both]]).sum())
    total = float(w.sum() + v.sum()) - shared_weight
    return shared_weight / total if total else 1.0


def _verified(table, least: float, size: int):
    def verified(batches):
        weigh, memo = Weigher(table), shared.WordHash()

        def weighted(text):
            h = memo.all(shared.words(text))
            _, x, n = shingles(np.array([len(h)], np.int64), h, size)
            return x, weigh(x, n)

        pivot = own = None
        for batch in batches:
            out = []
            for node, p, text, pivot_text in shared.rows_of(batch, "node", "pivot", "text", "pivot_text", at_once=128):
                if p != pivot:
                    pivot, own = p, weighted(pivot_text)
                if similarity(*weighted(text), *own) >= least:
                    out.append((node, p))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["node", "pivot"])

    return verified


BLOCKED = ("bucket", "lo", "hi")


def _blocked(members: DataFrame) -> DataFrame:
    """members (bucket, node, blocks and more), each in the groups (lo, hi) of its own block with every block of its bucket."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    met = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = met.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).withColumn("side", (F.col("own") > F.col("lo")).cast("int")).drop("own", "other", "blocks")
    return dealt.repartition(*BLOCKED).sortWithinPartitions(*BLOCKED, "side", "root", "node")


def _groups(batches, most: int, weight=None):
    """Columns of whole groups, in buffers of about `most` rows (or sums of the column weight) at least."""
    held, size, names = [], 0, None
    for batch in batches:
        names = batch.schema.names
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows if weight is None else int(np.sum(batch.column(weight).to_numpy()))
        if size < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        key = np.stack([table[c].to_numpy() for c in BLOCKED])
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
        if not len(cut):
            continue
        cut = int(cut[-1]) + 1
        yield table.slice(0, cut)
        held = pa.Table.from_batches(table.slice(cut).to_batches()).to_batches()
        size = sum(b.num_rows if weight is None else int(np.sum(b.column(weight).to_numpy())) for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidates(table, bands: int, least: float, at_once: int = 400_000):
    """first, second, agreement: the pairs of a group's rows of different classes whose sketches agree in enough samples and
    in this band first. Rows come by group, side and class."""
    key, side = np.stack([table[c].to_numpy() for c in BLOCKED]), table["side"].to_numpy()
    roots, band, m = table["root"].to_numpy(), table["band"].to_numpy(), table.num_rows
    if not m:
        return
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint32).reshape(m, -1)
    samples = np.ascontiguousarray(sketch.T)
    enough = math.ceil(least * len(samples) - 1e-9)
    starts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
    class_ends = np.r_[np.flatnonzero((roots[1:] != roots[:-1]) | (side[1:] != side[:-1])) + 1, m]
    for a, z in zip(starts.tolist(), np.r_[starts[1:], m].tolist(), strict=True):
        within = key[1, a] == key[2, a]
        # In its own block a row meets those of the classes behind it; of two blocks, the first one's rows meet the second one's.
        middle = z if within else a + int(np.searchsorted(side[a:z], 1))
        i = a
        while i < middle:
            end = min(int(class_ends[np.searchsorted(class_ends, i, side="right")]), middle)
            if z == (end if within else middle):
                break  # nothing of another class follows
            if not within:
                begin, stop = middle, min(middle, i + max(1, at_once // (z - middle)))
            elif end - i >= 64:  # rows of a large class meet what is behind it
                begin, stop = end, min(end, i + max(1, at_once // (z - end)))
            else:
                begin, stop = i + 1, min(middle, i + max(1, at_once // (z - i)))
            equal = np.zeros((stop - i, z - begin), np.uint16 if len(samples) > 255 else np.uint8)
            for s in samples:
                equal += s[i:stop, None] == s[None, begin:z]
            x, y = np.nonzero(equal >= enough)
            agreement = equal[x, y] / len(samples)
            x, y = x + i, y + begin
            keep = (roots[x] != roots[y]) & (y > x)
            x, y, agreement = x[keep], y[keep], agreement[keep]
            for k in range(0, len(x), 16_384):
                left, right = x[k : k + 16_384], y[k : k + 16_384]
                same = (sketch[left] == sketch[right]).reshape(len(left), bands, -1).all(axis=2)
                mine = same.argmax(axis=1) == band[left]
                if mine.any():
                    yield left[mine], right[mine], agreement[k : k + 16_384][mine]
            i = stop


def _some(found, group: np.ndarray, most: int = 250_000):
    """The candidates in pieces of one group each and about `most` pairs."""
    held, size = [], 0
    for piece in found:
        if held and (size >= most or group[piece[0][0]] != group[held[0][0][0]]):
            yield tuple(np.concatenate(p) for p in zip(*held, strict=True))
            held, size = [], 0
        held.append(piece)
        size += len(piece[0])
    if held:
        yield tuple(np.concatenate(p) for p in zip(*held, strict=True))


def _meeting(bands: int, least: float):
    def meeting(batches):
        """The members of pairs that agree, once for each group."""
        for table in _groups(batches, 10_000):
            found = np.zeros(table.num_rows, bool)
            for x, y, _ in _candidates(table, bands, least):
                found[x] = found[y] = True
            if found.any():
                got = table.select(["bucket", "band", "node", "root"]).take(pa.array(np.flatnonzero(found)))
                yield from got.combine_chunks().to_batches()

    return meeting


def _linked(weights_of, bands: int, least: float, similar: float, size: int):
    def linked(batches):
        """Links that connect the classes of each group: pairs, some at a time, meet by falling agreement until one class holds both."""
        weigh, memo = Weigher(weights_of), shared.WordHash()
        for table in _groups(batches, 400_000, "n_shingles"):
            key = np.stack([table[c].to_numpy() for c in BLOCKED])
            group = np.cumsum(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
            roots, nodes, texts, held, up = table["root"].to_numpy(), table["node"].to_numpy(), table["text"], {}, {}

            def top(k, up=up):
                while k in up:
                    if up[k] in up:
                        up[k] = up[up[k]]
                    k = up[k]
                return k

            def weighted(k, held=held, texts=texts):
                if k not in held:
                    h = memo.all(shared.words(texts[k].as_py()))
                    _, s, n = shingles(np.array([len(h)], np.int64), h, size)
                    held[k] = s, weigh(s, n)
                return held[k]

            out, now = [], None
            for x, y, agreement in _some(_candidates(table, bands, least), group):
                if group[x[0]] != now:
                    now = group[x[0]]
                    held.clear(), up.clear()
                if up:  # pairs that are in one class by now drop out
                    own, at = np.unique(np.concatenate([roots[x], roots[y]]), return_inverse=True)
                    tops = np.array([top(r) for r in own.tolist()], np.int64)[at]
                    apart = tops[: len(x)] != tops[len(x) :]
                    x, y, agreement = x[apart], y[apart], agreement[apart]
                for k in np.argsort(-agreement, kind="stable").tolist():
                    i, j = int(x[k]), int(y[k])
                    a, b = top(int(roots[i])), top(int(roots[j]))
                    if a != b and similarity(*weighted(i), *weighted(j)) >= similar:
                        up[a] = b
                        out.append((nodes[i], nodes[j]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["node", "pivot"])

    return linked


def components(edges: DataFrame, scratch: shared.Scratch) -> DataFrame:
    """node, root: the least node of each connected component of edges (node, pivot). Each round points the larger neighbours of
    a node to its least one, then the smaller ones; it ends when no edge changes."""
    sides = edges.where("node <> pivot").select(F.greatest("node", "pivot").alias("v"), F.least("node", "pivot").alias("u")).distinct()
    before = None
    while True:
        both = sides.union(sides.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        small_least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(small_least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").union(small_least.select("v", F.col("m").alias("u")))
        seen = Observation()
        changed = small.where("v <> u").distinct()
        sides = scratch.stored(changed.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("sum")), "edges")
        now = (seen.get["n"], seen.get["sum"])
        if now == before:
            return sides.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, *, similar: float = 0.8, size: int = 5, bands: int = 16, rows: int = 4, idf_floor: float = 0.02, group: int = 500, block: int = 16_000, block_shingles: int = 400_000) -> DataFrame:
    """doc_id, row_no (hash of id and text), class_id (the least doc_id of the document's class), n_links (verified links of its text's class), kept (true for
    one row of each class)."""
    spark = docs.sparkSession
    scratch = shared.Scratch(spark)
    table = idf_table(docs, size=size, idf_floor=idf_floor)
    texts = shared.texts_of(docs)
    key = F.xxhash64("doc_id", "text")
    sketched = shared.stored(texts.select("doc_id", key.alias("row_no"), "text").mapInArrow(_sketches(table, bands * rows, size), SKETCH), "sketches")
    # One node per word sequence: the least row (by id, then hash) of those with equal sequences.
    first = sketched.groupBy("same_a", "same_b").agg(F.min(F.struct("doc_id", "row_no", "n_shingles", "sketch")).alias("f"))
    nodes = shared.stored(
        first.select(F.xxhash64("same_a", "same_b").alias("node"), "same_a", "same_b", "f.doc_id", "f.row_no", "f.n_shingles", "f.sketch"),
        "nodes",
    )
    members = nodes.where("n_shingles > 0").select("node", "sketch").mapInArrow(_bands(bands, rows), "bucket long, band int, node long")
    # Buckets of one member pair nobody.
    crowd = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = scratch.stored(members.join(crowd, "bucket"), "buckets")
    # The same member is the pivot of most buckets of a group, as its bands lie in the most crowded ones.
    central = members.groupBy("node").agg(F.round(F.sum(F.log("n")), 6).alias("crowd"))
    ranked = members.join(central, "node").select("bucket", "node", F.struct("crowd", F.xxhash64(F.lit(1), "node"), "node").alias("rank"))
    pivot = ranked.groupBy("bucket").agg(F.max("rank").alias("p")).select("bucket", F.col("p.node").alias("pivot"))
    pairs = members.join(pivot, "bucket").where("node <> pivot").select("node", "pivot").distinct()
    sketch = nodes.select("node", "sketch")
    both = pairs.join(sketch, "node").join(sketch.select(F.col("node").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "pivot")
    agree, links_at = similar - 0.25, shared.new_folder(spark, "links")
    asked = scratch.stored(both.select("node", "pivot", "sketch", "pivot_sketch").mapInArrow(_agreeing(agree), PAIR), "asked")
    roots = components(shared.stored(_verify(asked, nodes, texts, table, similar, size, group, scratch), "links", f"{links_at}/1"), scratch)
    # Then all pairs of a bucket's classes.
    now = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = now.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("a <> z").select("bucket", "blocks")
    dealt = _blocked(now.drop("n").join(open_, "bucket").join(sketch, "node").select("bucket", "band", "node", "root", "sketch", "blocks"))
    meeting = scratch.stored(dealt.mapInArrow(_meeting(bands, agree), "bucket long, band int, node long, root long").distinct(), "meeting")
    own = _texts_at(meeting.select("node").distinct(), nodes, texts, scratch).join(nodes.select("node", "sketch", "n_shingles"), "node")
    own = scratch.stored(own, "meeting-texts")
    large = meeting.join(own.select("node", "n_shingles"), "node").groupBy("bucket").agg(F.ceil(F.sum("n_shingles") / block_shingles).cast("int").alias("blocks"))
    dealt = _blocked(meeting.join(large, "bucket").join(own, "node"))
    found = shared.stored(dealt.mapInArrow(_linked(table, bands, agree, similar, size), PAIR), "links", f"{links_at}/2")
    # Links between classes so far.
    of = roots.withColumnRenamed("root", "r")
    ends = found.join(of, "node", "left").select(F.coalesce("r", "node").alias("node"), "pivot")
    ends = ends.join(of.withColumnRenamed("node", "pivot"), "pivot", "left").select("node", F.coalesce("r", "pivot").alias("pivot"))
    joined = components(ends, scratch)
    to = joined.select(F.col("node").alias("root"), F.col("root").alias("to"))
    roots = roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")).union(joined.select("node", "root")).groupBy("node").agg(F.min("root").alias("root"))
    links = spark.read.schema(PAIR).parquet(f"{links_at}/1", f"{links_at}/2")
    degree = links.select("node").union(links.select(F.col("pivot").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    placed = nodes.select("node", "same_a", "same_b", "doc_id", "row_no").join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = shared.stored(placed, "placed")
    scratch.drop()
    heads = placed.groupBy("root").agg(F.min(F.struct("doc_id", "row_no")).alias("h")).select("root", F.col("h.doc_id").alias("class_id"), F.col("h.row_no").alias("head"))
    classes = placed.join(heads, "root").select("same_a", "same_b", "class_id", "head", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = sketched.select("doc_id", "row_no", "same_a", "same_b").join(classes, ["same_a", "same_b"])
    return out.select("doc_id", "row_no", "class_id", "n_links", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("row_no") == F.col("head"))).alias("kept"))


def _texts_at(asked: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: shared.Scratch, most_sent: int = 200_000) -> DataFrame:
    """node, text of the nodes of asked. Up to most_sent keys of texts are broadcast."""
    place = nodes.select("node", F.col("doc_id").alias("d"), "row_no")
    needed = scratch.stored(asked.join(place, "node"), "needed")
    if needed.count() <= most_sent:  # else the texts are shuffled
        needed = F.broadcast(needed)
    keyed = texts.select(F.col("doc_id").alias("doc"), F.xxhash64("doc_id", "text").alias("key"), "text")
    return keyed.join(needed, F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("row_no"))).select("node", "text").dropDuplicates(["node"])


def _verify(asked: DataFrame, nodes: DataFrame, texts: DataFrame, table, similar: float, size: int, group: int, scratch: shared.Scratch) -> DataFrame:
    """The pairs of asked whose whole texts are similar."""
    own = scratch.stored(_texts_at(asked.select("node").union(asked.select("pivot")).distinct(), nodes, texts, scratch), "asked-texts")
    # Each pivot's pairs are dealt to salted groups of about `group`; its text goes to each of them.
    salts = asked.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("salts"))
    left = asked.join(salts, "pivot").select("node", "pivot", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    right = salts.join(own.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text")), "pivot").select("pivot", "pivot_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    met = left.join(own, "node").join(right, ["pivot", "salt"]).select("node", "pivot", "text", "pivot_text")
    return met.mapInArrow(_verified(table, similar, size), "node long, pivot long")
