"""Importance resampling towards a target: documents are drawn by how much likelier their words are in a target's texts than in their own table.

Features are all runs of 1 to 2 consecutive words (runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased), joined by one
space; a feature's bucket is its unsigned crc32 modulo `buckets`. The work goes over streams on disk:

1. Each task writes its documents' buckets as packed streams of 16-bit numbers with the documents' offsets, a bounded number of features to a row.
   The crc32 of a pair of words follows from those of its words, so only distinct words are hashed byte by byte.
2. Each stream is sorted and its runs are measured; a task adds the runs of its streams, Spark those of the tasks. At most `buckets`
   sums reach the driver.
3. Gains of the buckets are broadcast (8 bytes each); a task gathers them along its streams and sums them between offsets with np.add.reduceat.
4. A document's weight, its floored mean gain, gets a Gumbel number seeded by its id. The draw sorts all documents by range and takes a row's place in its
   range plus the rows of the ranges before it, so no task holds more than a range.

    gain = floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))     score = weight + floor(-1000 ln(-ln((h + 0.5) / 2^32)))

s of S features of the table lie in the bucket, t of T of the target; h: the first 8 hex digits of sha256("<seed>:<doc_id>").

Null and empty texts have no features and weight 0. A null doc_id counts as an empty one in h and comes first among equal scores. Repeated rows are documents of
their own. Equal scores go by ascending doc_id. Other columns are ignored. An empty table gives no rows, an empty target counts 0 everywhere.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import shared

STREAMS = "doc_ids array<bigint>, offsets binary, buckets binary"
#: A stream ends at so many words or documents.
STREAM_WORDS, STREAM_DOCS = 200_000, 8192


@functools.cache
def _one_byte() -> np.ndarray:
    """What a byte of zeros after it makes of a crc32's last byte (the reversed polynomial of crc32 is fixed)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


@functools.cache
def _zeros(n: int) -> np.ndarray:
    """What n bytes of zeros after it make of each byte of a crc32: four tables of 256."""
    moved = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(n):
        moved = (moved >> 8) ^ _one_byte()[moved & 255]
    return moved


def joined_crc(first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings, one after the other, from theirs and the sizes of the second."""
    out = second.copy()
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        c, table = first[own], _zeros(n) if n < 256 else None
        if table is None:
            out[own] ^= np.array([zlib.crc32(bytes(n), x) ^ zlib.crc32(bytes(n)) for x in c.tolist()], np.uint32)
        else:
            out[own] ^= table[0][c & 255] ^ table[1][(c >> 8) & 255] ^ table[2][(c >> 16) & 255] ^ table[3][c >> 24]
    return out


def _stream(ids: list, found: list[list[bytes]], buckets: int) -> pa.RecordBatch:
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    n = np.array([len(x) for x in found], np.int64)
    codes = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), np.int64, int(n.sum()))
    words = list(number)
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    spaced = np.fromiter((zlib.crc32(b" ", c) for c in crc.tolist()), np.uint32, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    offsets = np.r_[0, np.cumsum(np.maximum(2 * n - 1, 0))]
    # A document's words come first, then its pairs: pair j starts at word j, and a document has one pair less than words.
    begun, rank = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    place = np.arange(len(codes)) - begun[rank]
    out = np.empty(int(offsets[-1]), np.uint16)
    out[offsets[rank] + place] = (crc % np.uint32(buckets))[codes]
    pairs = np.flatnonzero(place < n[rank] - 1)
    left, right = codes[pairs], codes[pairs + 1]
    out[offsets[rank[pairs]] + n[rank[pairs]] + place[pairs]] = joined_crc(spaced[left], crc[right], sizes[right]) % np.uint32(buckets)
    kind = {"doc_ids": pa.list_(pa.int64()), "offsets": pa.binary(), "buckets": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((ids, offsets.astype("<i8").tobytes(), out.astype("<u2").tobytes()), kind.values(), strict=True)], list(kind))


def _streams(buckets: int):
    def streams(batches):
        ids, found, n = [], [], 0
        for batch in batches:
            for doc_id, text in shared.rows_of(batch):
                ids.append(doc_id)
                found.append(shared.terms(text))
                n += len(found[-1])
                if n >= STREAM_WORDS or len(ids) >= STREAM_DOCS:
                    yield _stream(ids, found, buckets)
                    ids, found, n = [], [], 0
        if ids:
            yield _stream(ids, found, buckets)

    return streams


def write_streams(docs: DataFrame, path: str, *, id_column: str = "doc_id", buckets: int = 10_000) -> DataFrame:
    """The packed streams of docs, written to path."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are 16-bit numbers")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # Streams are large rows: small row groups keep what a reader holds at once small.
    small = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "4", "parquet.block.size.row.check.min": "4"}
    rows.mapInArrow(_streams(buckets), STREAMS).write.options(**small).parquet(path)
    return docs.sparkSession.read.schema(STREAMS).parquet(path)


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of a stream and their counts, by sorting."""
    ordered = np.sort(stream)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
    return ordered[starts], np.diff(np.r_[starts, len(ordered)])


def count(streams: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Features in each bucket, over all streams."""

    def counted(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column("buckets"):
                values, lengths = run_lengths(np.frombuffer(x.as_buffer(), "<u2"))
                total[values] += lengths
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in streams.select("buckets").mapInArrow(counted, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of how much likelier each bucket is in the target, rounded down."""
    s, t, n = own.astype(np.float64), target.astype(np.float64), len(own)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + n)) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def mean_gains(buckets: np.ndarray, offsets: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The floored mean of gains between each two offsets, 0 where nothing lies between them."""
    n = np.diff(offsets)
    out, there = np.zeros(len(n), np.int64), np.flatnonzero(n)
    if len(there):
        out[there] = np.add.reduceat(gain[buckets], offsets[:-1][there]) // n[there]
    return out


def weights(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features and weight of each document of the streams."""
    sent = streams.sparkSession.sparkContext.broadcast(gain)

    def weighed(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                offsets = np.frombuffer(batch.column("offsets")[i].as_buffer(), "<i8")
                weight = mean_gains(np.frombuffer(batch.column("buckets")[i].as_buffer(), "<u2"), offsets, sent.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values.cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(weight)], ["doc_id", "n_features", "weight"])
            pa.default_memory_pool().release_unused()

    return streams.mapInArrow(weighed, "doc_id bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) for u from the hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weighed: DataFrame, *, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank: floor(percent N / 100) of the N documents with min_words words have a rank, by descending score."""
    able = F.col("n_features") >= 2 * min_words - 1 if min_words > 0 else F.lit(True)
    scored = shared.stored(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"), able.alias("able"), F.rand(seed).alias("mixed")), "scored")
    quota = percent * scored.where("able").count() // 100
    # Rows equal in score and id are told apart by a number of their own, so that they spread over ranges.
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("mixed")]
    ranged = scored.repartitionByRange(shared.partitions(weighed.sparkSession), *order).sortWithinPartitions(*order)
    placed = shared.stored(ranged.select("doc_id", "n_features", "weight", "score", "able", F.monotonically_increasing_id().alias("place")), "placed")
    part = F.shiftright("place", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())  # one row for each range
    before, starts = 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    first = F.broadcast(weighed.sparkSession.createDataFrame(starts, "part bigint, first bigint"))
    rank = F.col("first") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("part", part).join(first, "part").select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (rank <= quota), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, target_id: str = "item_id", buckets: int = 10_000, percent: int = 25, min_words: int = 20, seed: int = 7) -> DataFrame:
    """draw() over docs, weighed towards the texts of target."""
    spark = docs.sparkSession
    own = write_streams(docs, shared.new_folder(spark, "streams"), buckets=buckets)
    other = write_streams(target, shared.new_folder(spark, "target-streams"), id_column=target_id, buckets=buckets)
    return draw(weights(own, gains(count(own, buckets), count(other, buckets))), percent=percent, min_words=min_words, seed=seed)
