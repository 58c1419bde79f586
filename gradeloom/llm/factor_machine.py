"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise term is taken in linear time as half of
(sum_i v_i x_i)^2 - sum_i v_i^2 x_i^2. Features: each distinct word (case kept) hashed to one of 2^bits, weighted by its
share's square root; statistics of the whole text (lengths, shares of capitals, digits, symbols, distinct words, repeated
lines), standardised over the fitting sample; and the table's n_chars. Labels, lang, source and doc_id are no features.

It is fitted on a bounded sample of labelled rows: the most_rows rows of the training folds with the smallest hash of
their id; their features, not their texts, reach the driver. Scoring is a map over all rows. A null or empty text is
scored by its statistics alone; a null n_chars counts as the text's length. Repeated rows get equal scores; of labelled rows
with one id and several texts one is learnt, always the same one, and of several labels of an id the highest. Without labels
of both kinds the score is the share of label 1 (0.5 without labels). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm import shared

N_STATS = 12


@dataclass
class Machine:
    bits: int
    w0: float
    w: np.ndarray  # of hashed words, then statistics
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def _statistics(text: str, found: list[bytes], distinct: int, n_chars: float) -> list[float]:
    n, m = max(1, len(found)), max(1, len(text))
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    kinds = np.bincount(_KIND[data], minlength=5) / max(1, len(data)) if len(data) else np.zeros(5)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        np.log1p(len(found)), np.log1p(n_chars), len(text) / n, distinct / n, np.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        kinds[1], kinds[2], kinds[3], kinds[4], len(data) / m, n / max(1, len(lines)) / 100,
    ]


#: Kind of each byte: 1 capitals, 2 digits, 3 symbols, 4 other punctuation, else 0.
_KIND = np.zeros(256, dtype=np.int64)
_KIND[65:91], _KIND[48:58] = 1, 2
_KIND[[ord(c) for c in "#*$%&|<>!@^~_=+{}[]\\/"]] = 3
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 4


def featurise(texts: list[str], n_chars: list, bits: int, memo: shared.WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row number, bucket and value of each hashed word, row by row; and the rows' statistics."""
    counts, buckets, stats = [], [], np.zeros((len(texts), N_STATS))
    for k, text in enumerate(texts):
        found = shared.words(text)
        counts.append(len(found))
        own = memo.all(found) >> np.uint64(64 - bits)
        buckets.append(own)
        stats[k] = _statistics(text, found, len(set(found)), len(text) if n_chars[k] is None or n_chars[k] != n_chars[k] else float(n_chars[k]))
    counts = np.array(counts, dtype=np.int64)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), counts)
    key, times = np.unique((row << np.uint64(bits)) | (np.concatenate(buckets) if buckets else np.empty(0, np.uint64)), return_counts=True)
    row, bucket = (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    value = np.sqrt(times / counts[row])
    return row, bucket, value.astype(np.float32), stats


def _sums(row: np.ndarray, parts: np.ndarray, n: int) -> np.ndarray:
    """Sums of parts by row (rows ascending)."""
    out = np.zeros((n, *parts.shape[1:]), dtype=parts.dtype)
    if len(row):
        begun = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        out[row[begun]] = np.add.reduceat(parts, begun, axis=0)
    return out


def raw_scores(m: Machine, row, bucket, value, stats) -> np.ndarray:
    z = ((stats - m.mean) / m.scale).clip(-5, 5).astype(np.float32)
    ws, vs = m.w[1 << m.bits :], m.v[1 << m.bits :]
    vx = m.v[bucket] * value[:, None]
    first = _sums(row, vx, len(stats)) + z @ vs
    second = _sums(row, vx * vx, len(stats)) + (z * z) @ (vs * vs)
    return m.w0 + _sums(row, m.w[bucket] * value, len(stats)) + z @ ws + 0.5 * (first * first - second).sum(axis=1)


def fit(features: list[tuple], labels: np.ndarray, bits: int, rank: int = 8, epochs: int = 8, batch: int = 64, rate: float = 0.05, decay: float = 1e-5, seed: int = 5) -> Machine:
    """Adagrad on the logistic loss. features: (buckets, values, statistics) of each row."""
    rng = np.random.default_rng(seed)
    size = (1 << bits) + N_STATS
    stats = np.array([f[2] for f in features]).reshape(-1, N_STATS)
    share = float(labels.mean()) if len(labels) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3) if 0 < share < 1 else share
    m = Machine(bits, 0.0, np.zeros(size, np.float32), (rng.normal(size=(size, rank)) * 0.02).astype(np.float32), np.zeros(N_STATS), np.ones(N_STATS))
    if share in (0.0, 1.0) or not len(labels):
        m.w0, m.v[:] = float(np.clip((share - 0.5) * 100, -30, 30)), 0
        return m
    m.mean, m.scale, m.w0 = stats.mean(axis=0), stats.std(axis=0) + 1e-6, float(np.log(share / (1 - share)))
    z = ((stats - m.mean) / m.scale).clip(-5, 5).astype(np.float32)
    at = np.arange(1 << bits, size)
    gw, gv, g0 = np.full(size, 1e-4, np.float32), np.full((size, rank), 1e-4, np.float32), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for begun in range(0, len(order), batch):
            own = order[begun : begun + batch]
            row = np.concatenate([np.full(len(features[i][0]) + N_STATS, k) for k, i in enumerate(own)])
            col = np.concatenate([np.concatenate([features[i][0], at]) for i in own])
            x = np.concatenate([np.concatenate([features[i][1], z[i]]) for i in own])
            vx = m.v[col] * x[:, None]
            s = _sums(row, vx, len(own))
            y = m.w0 + _sums(row, m.w[col] * x, len(own)) + 0.5 * (s * s - _sums(row, vx * vx, len(own))).sum(axis=1)
            d = (1 / (1 + np.exp(-y.clip(-30, 30))) - labels[own]).astype(np.float32) / len(own)
            dx = d[row] * x
            uniq, back = np.unique(col, return_inverse=True)
            grad_w = np.bincount(back, dx, len(uniq)).astype(np.float32) + decay * m.w[uniq]
            dv = dx[:, None] * (s[row] - vx)
            grad_v = np.stack([np.bincount(back, dv[:, f], len(uniq)) for f in range(dv.shape[1])], axis=1).astype(np.float32) + decay * m.v[uniq]
            gw[uniq] += grad_w**2
            gv[uniq] += grad_v**2
            g0 += float(d.sum()) ** 2
            m.w[uniq] -= rate * grad_w / np.sqrt(gw[uniq])
            m.v[uniq] -= rate * grad_v / np.sqrt(gv[uniq])
            m.w0 -= rate * float(d.sum()) / np.sqrt(g0)
    return m


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: int = 5, held_out: int = 0, most_rows: int = 8_000, bits: int = 17, rank: int = 8) -> Machine:
    """A machine from the labelled rows of docs outside the fold held_out, at most most_rows of them."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
        .where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (shared.in_folds("doc_id", folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id")
        .limit(most_rows)
    )
    rows = shared.texts_of(docs, _n_chars(docs)).join(F.broadcast(chosen), "doc_id")  # at most most_rows ids
    got = rows.mapInPandas(_features(bits), "doc_id long, y double, buckets binary, x binary, stats array<double>").collect()
    # Of repeated rows with one id, the one with the greatest features is learnt.
    got = sorted(got, key=lambda r: (r["doc_id"], bytes(r["buckets"]), bytes(r["x"]), r["stats"]))
    got = sorted({r["doc_id"]: r for r in got}.values(), key=lambda r: r["doc_id"])
    features = [(np.frombuffer(r["buckets"], np.int64), np.frombuffer(r["x"], np.float32), np.array(r["stats"])) for r in got]
    return fit(features, np.array([r["y"] for r in got]), bits, rank)


def _n_chars(docs: DataFrame):
    return (F.col("n_chars") if "n_chars" in docs.columns else F.length("text")).cast("double").alias("n_chars")


def _features(bits: int):
    def made(batches):
        memo = shared.WordHash()
        for pdf in batches:
            row, bucket, value, stats = featurise(pdf["text"].tolist(), pdf["n_chars"].tolist(), bits, memo)
            cuts = np.searchsorted(row, np.arange(len(pdf) + 1))
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "y": pdf["y"], "buckets": [bucket[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)],
                "x": [value[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)], "stats": stats.tolist(),
            })

    return made


def scores(docs: DataFrame, machine: Machine):
    """A column: the machine's score of each whole text, from 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        memo, m = shared.WordHash(), sent.value
        for texts, n_chars in batches:
            parts = [np.empty(0)]
            for k in range(0, len(texts), 256):
                y = raw_scores(m, *featurise(texts[k : k + 256].tolist(), n_chars[k : k + 256].tolist(), m.bits, memo))
                parts.append(1 / (1 + np.exp(-y.astype(np.float64).clip(-30, 30))))
            yield pd.Series(np.concatenate(parts))

    return score(F.coalesce(F.col("text"), F.lit("")), _n_chars(docs))
