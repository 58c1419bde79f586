"""Ranked lexical search over a quantised index of two levels.

Terms are runs of ASCII letters, digits and characters beyond ASCII, of which A-Z alone are lower-cased. A document's impact for
a term is an integer of its frequency and the document's length; a score sums weight times impact over an item's terms:

    w = floor(1000 ln((2N + 2) / (2 df + 1)))      impact = (10^9 tf) div (1000 tf + 12 m)      m = 75 + (25 n N) div L

N: documents with a term, L: all their terms, n: one document's terms, df: documents that hold the term, tf: its occurrences there.

The index is a table of segments. A segment holds the postings of a bounded number of documents and words: its own dictionary, for each
term the documents' places, on the first level each impact as a byte, rounded up to a multiple of `STEP`, on the second the
frequency from which the exact impact follows. As a segment is one row, a search shuffles no postings, and a term that all
documents hold is spread over all segments. A search of a block of items goes over the segments twice:

1. Bytes alone, one level below, bound each score from below. Each task keeps the k best bounds of an item; the k-th best of
   all tasks' is the item's threshold: k documents reach it for certain.
2. Bytes alone bound each score from above. Every document whose bound reaches the threshold is scored by exact integers in the
   same task, however many there are; each task keeps the k best of an item, and a window takes the k best of all tasks.

Nothing is lost by the bounds, so the result is that of scoring every document. Only items and thresholds are broadcast, in blocks of at most
`block_terms` item terms or one item.

Null and empty texts have no terms: as documents they aren't counted, as items they find nothing. Repeated rows are documents (or
items) of their own. Equal scores go by ascending doc_id, a null id first. Scores of 0 aren't returned. Columns other than the id and the
text are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm import shared

#: Impacts lie below the first; 255 steps of the second reach it.
MOST_IMPACT, STEP = 1_000_000, 3922
#: A segment ends at so many words or documents; places are 16 bits wide.
SEGMENT_WORDS, SEGMENT_DOCS = 200_000, 4096
#: Postings of several items that are expanded at once.
AT_ONCE = 1_000_000

POSTINGS = "doc_ids array<bigint>, n_docs bigint, n_words bigint, lengths binary, terms array<binary>, dfs array<int>, places binary, tfs binary"


@dataclass
class Index:
    """A written index: its folder, N and L."""

    spark: SparkSession
    path: str
    n_docs: int
    n_words: int

    def segments(self) -> DataFrame:
        return self.spark.read.schema(f"{POSTINGS}, impacts binary").parquet(f"{self.path}/segments")


def _segment(ids: list, found: list[list[bytes]]) -> pa.RecordBatch:
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    lengths = np.array([len(x) for x in found], np.int64)
    codes = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), np.int64, int(lengths.sum()))
    keys, tfs = np.unique(codes * len(ids) + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    codes, places = np.divmod(keys, len(ids))
    row = {
        "doc_ids": ids, "n_docs": len(ids), "n_words": int(lengths.sum()), "lengths": lengths.astype("<u4").tobytes(), "terms": list(number),
        "dfs": np.bincount(codes, minlength=len(number)).tolist(), "places": places.astype("<u2").tobytes(), "tfs": tfs.astype("<u4").tobytes(),
    }
    kinds = (pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row.values(), kinds, strict=True)], list(row))


def _cut(batches):
    ids, found, n = [], [], 0
    for batch in batches:
        for doc_id, text in shared.rows_of(batch):
            if own := shared.terms(text):
                ids.append(doc_id)
                found.append(own)
                n += len(own)
            if n >= SEGMENT_WORDS or len(ids) >= SEGMENT_DOCS:
                yield _segment(ids, found)
                ids, found, n = [], [], 0
    if ids:
        yield _segment(ids, found)


def exact_impacts(tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tfs) // (1000 * tfs + 12 * m)


def length_factors(lengths: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """m of each length; by Python's integers, as 25 n N may need more than 64 bits on the way."""
    return np.array([75 + (25 * n * n_docs) // n_words for n in lengths.tolist()], np.int64)


def _rounded_up(n_docs: int, n_words: int):
    def impacts(batches):
        for batch in batches:
            out = []
            for lengths, places, tfs in shared.rows_of(batch, "lengths", "places", "tfs", at_once=16):
                m = length_factors(np.frombuffer(lengths, "<u4"), n_docs, n_words)
                exact = exact_impacts(np.frombuffer(tfs, "<u4").astype(np.int64), m[np.frombuffer(places, "<u2")])
                out.append((-(-exact // STEP)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "impacts"])

    return impacts


def build(docs: DataFrame, path: str) -> Index:
    """Writes the index of all rows of docs (doc_id, text) to path. Texts are read once; the bytes need N and L, so they come in a second
    step over the postings."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # Segments are large rows: small row groups keep what a reader holds at once small.
    small = {"compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "4", "parquet.block.size.row.check.min": "4"}
    rows.mapInArrow(_cut, POSTINGS).write.options(**small).parquet(f"{path}/postings")
    plain = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    n_docs, n_words = plain.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    plain.mapInArrow(_rounded_up(n_docs, n_words), f"{POSTINGS}, impacts binary").write.options(**small).parquet(f"{path}/segments")
    shared.dropped(spark, f"{path}/postings")
    return Index(spark, path, n_docs, n_words)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that an earlier session wrote."""
    own = Index(spark, path, 0, 0)
    own.n_docs, own.n_words = own.segments().agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    return own


def _item_terms(batches):
    for batch in batches:
        for item, text in shared.rows_of(batch):
            terms, counts = np.unique(np.array(shared.terms(text), object), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(terms), pa.int64()), pa.array(terms.tolist(), pa.binary()), pa.array(counts, pa.int64())], ["item", "term", "times"])


class Block:
    """A block of items against segments. Entries are pairs of item and term in the order of items, with weight times repeats."""

    def __init__(self, rows: list[tuple[int, bytes, int]], dfs: dict[bytes, int], n_docs: int, k: int):
        weights = {term: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for term, df in dfs.items()}
        rows = sorted(r for r in rows if weights.get(r[1], 0) > 0)
        self.k, self.items = k, sorted({r[0] for r in rows})
        place, terms = {x: i for i, x in enumerate(self.items)}, sorted({r[1] for r in rows})
        number = {x: i for i, x in enumerate(terms)}
        self.terms = pa.array(terms, pa.binary())
        self.item = np.array([place[r[0]] for r in rows], np.int64)
        self.term = np.array([number[r[1]] for r in rows], np.int64)
        self.weight = np.array([weights[r[1]] * r[2] for r in rows], np.int64)

    def expanded(self, terms: pa.Array, dfs: np.ndarray, n_docs: int):
        """Groups of items: first and last+1 item, for each posting of their terms its cell (item, document), place and weight."""
        at = pc.index_in(self.terms, value_set=terms)
        there = np.asarray(at.is_valid())[self.term]
        entry = np.flatnonzero(there)
        at = np.asarray(at.fill_null(0)).astype(np.int64)[self.term[entry]]
        begin, counts, item = (np.cumsum(dfs) - dfs)[at], dfs[at], self.item[entry]
        ends = np.searchsorted(item, np.arange(len(self.items)), side="right")
        sums = np.r_[0, np.cumsum(counts)]
        first = 0
        while first < len(self.items):
            base = ends[first - 1] if first else 0
            room = np.searchsorted(sums[ends], sums[base] + max(AT_ONCE, 0), side="right")
            last = max(first + 1, min(int(room), first + max(1, AT_ONCE // n_docs)))
            own = slice(base, ends[last - 1])
            index = shared.runs(begin[own], counts[own])
            yield first, last, np.repeat((item[own] - first) * n_docs, counts[own]), index, np.repeat(self.weight[entry[own]], counts[own])
            first = last

    def lower_bounds(self, batches):
        """The k best lower bounds of each item in all segments of the task."""
        best = np.zeros((len(self.items), self.k), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                terms, dfs, n_docs, places, impacts = _parts(batch, i, "places", "impacts")
                least = np.maximum((impacts.astype(np.int64) - 1) * STEP + 1, 0)
                for first, last, cells, index, weights in self.expanded(terms, dfs, n_docs):
                    sums = np.zeros((last - first) * n_docs, np.int64)
                    np.add.at(sums, cells + places[index], weights * least[index])
                    both = np.concatenate([best[first:last], sums.reshape(last - first, n_docs)], axis=1)
                    best[first:last] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
            pa.default_memory_pool().release_unused()
        item, place = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(self.items, np.int64)[item]), pa.array(best[item, place])], ["item", "bound"])

    def best_scores(self, thresholds: np.ndarray, factors, told=None):
        """The k best documents of each item in all segments of the task, by exact scores of those whose upper bound reaches the threshold."""

        def scored(batches):
            kept = Best(self.k)
            for batch in batches:
                for i in range(batch.num_rows):
                    terms, dfs, n_docs, places, impacts, tfs, lengths = _parts(batch, i, "places", "impacts", "tfs", "lengths")
                    ids = batch.column("doc_ids")[i].values
                    none, ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(np.iinfo(np.int64).min))
                    m, most = factors(lengths), impacts.astype(np.int64) * STEP
                    for first, last, cells, index, weights in self.expanded(terms, dfs, n_docs):
                        cells = cells + places[index]
                        sums = np.zeros((last - first) * n_docs, np.int64)
                        np.add.at(sums, cells, weights * most[index])
                        reach = (sums >= np.repeat(thresholds[first:last], n_docs)) & (sums > 0)
                        chosen = np.flatnonzero(reach[cells])
                        exact = np.zeros_like(sums)
                        np.add.at(exact, cells[chosen], weights[chosen] * exact_impacts(tfs[index[chosen]].astype(np.int64), m[places[index[chosen]]]))
                        found = np.flatnonzero(exact)
                        if told is not None:
                            told.append(int(reach.sum()))
                        kept.add(first + found // n_docs, exact[found], ids[found % n_docs], none[found % n_docs])
                pa.default_memory_pool().release_unused()
            item, score, ids, none = kept.rows()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(self.items, np.int64)[item]), pa.array(score), pa.array(ids, mask=none)], ["item", "score", "doc_id"])

        return scored


class Best:
    """The k highest scores of each item, equal ones by null ids, then ascending ids."""

    def __init__(self, k: int, most: int = 200_000):
        self.k, self.most, self.parts, self.n = k, most, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.n += len(columns[0])
        if self.n >= self.most:
            self.parts = [own := self.rows()]
            self.n = len(own[0])
            self.most = max(self.most, 2 * self.n)

    def rows(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        item, score, ids, none = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, ~none, -score, item))
        item = item[order]
        keep = np.arange(len(item)) - np.searchsorted(item, item) < self.k
        order = order[keep]
        return item[keep], score[order], ids[order], none[order]


def _parts(batch: pa.RecordBatch, i: int, *columns: str):
    kinds = {"places": "<u2", "impacts": "u1", "tfs": "<u4", "lengths": "<u4"}
    dfs = np.asarray(batch.column("dfs")[i].values).astype(np.int64)
    return batch.column("terms")[i].values, dfs, batch.column("n_docs")[i].as_py(), *(np.frombuffer(batch.column(c)[i].as_buffer(), kinds[c]) for c in columns)


def search(index: Index, items: DataFrame, *, k: int = 20, item_id: str = "item_id", block_terms: int = 100_000) -> DataFrame:
    """The k best documents of each row of items (its id and text): item_id, rank from 1, doc_id, score."""
    spark = index.spark
    given = shared.stored(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col("text").cast("binary").alias("text")), "items")
    terms = shared.stored(given.select("item", "text").mapInArrow(_item_terms, "item bigint, term binary, times bigint"), "item-terms")
    blocks = max(1, -(-terms.count() // block_terms))
    parts = [_searched(index, terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k) for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(given.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _searched(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """Each task's best documents for one block of items."""
    spark, segments = index.spark, index.segments()
    rows = [(r.item, bytes(r.term), r.times) for r in terms.collect()]  # bounded by block_terms, or one item
    asked = F.broadcast(terms.select("term").distinct())
    dfs = segments.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("dfs").alias("df")))).join(asked, "term").groupBy("term").agg(F.sum("df").alias("df"))
    block = Block(rows, {bytes(r.term): r.df for r in dfs.collect()}, index.n_docs, k)
    sent = spark.sparkContext.broadcast(block)
    bounds = segments.select("terms", "dfs", "n_docs", "places", "impacts").mapInArrow(lambda batches: sent.value.lower_bounds(batches), "item bigint, bound bigint")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound")))
    reached = {r.item: r.bound for r in bounds.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).collect()}
    thresholds = np.array([reached.get(x, 1) for x in block.items], np.int64)
    n_docs, n_words = index.n_docs, index.n_words

    def scored(batches):
        return sent.value.best_scores(thresholds, lambda lengths: length_factors(lengths, n_docs, n_words))(batches)

    return segments.select("terms", "dfs", "n_docs", "places", "impacts", "tfs", "lengths", "doc_ids").mapInArrow(scored, "item bigint, score bigint, doc_id bigint")
