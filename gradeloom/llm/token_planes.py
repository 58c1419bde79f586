"""Token ids in a binary format of transposed, compressed planes.

A token file is a folder of two Parquet tables. `chunks` holds one row per block of at most block_ids ids: the block's
ids transposed into byte planes (all first bytes, all second bytes, ...) or bit planes (all lowest bits, ...), each
plane compressed with zstandard, and which documents lie in it. `index` holds one small row per chunk: the global
position of its first id, its number of ids, its planes' sizes and its crc32. Ids stand in ascending doc_id order
(null ids first, equal ids by text), each document closed by end_id.

Parts of consecutive documents are encoded independently, so a block never crosses a part; the last block of a part
may be shorter. A null or empty text is a document of one id, end_id. Repeated rows are documents of their own.
An empty table gives empty tables. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm import shared
from gradeloom.llm.tokens import encoder

CHUNK = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("block", T.LongType()), T.StructField("from_id", T.LongType()),
    T.StructField("n_ids", T.LongType()), T.StructField("mode", T.StringType()), T.StructField("planes", T.ArrayType(T.BinaryType())),
    T.StructField("crc32", T.LongType()), T.StructField("doc_no", T.ArrayType(T.LongType())), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("doc_from", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
])
PIECE = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("doc_no", T.LongType()), T.StructField("doc_id", T.LongType()),
    T.StructField("at", T.LongType()), T.StructField("doc_from", T.LongType()), T.StructField("n", T.LongType()), T.StructField("crc", T.LongType()),
])


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """The planes of unsigned 32-bit ids, lowest first; planes above the highest set bit or byte are left out."""
    import zstandard

    if mode == "byte":
        rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4).T
    else:
        rows = np.packbits(np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").T, axis=1, bitorder="little")
    used = max((k + 1 for k in range(len(rows)) if rows[k].any()), default=0)
    pack = zstandard.ZstdCompressor(level=1)
    return [pack.compress(np.ascontiguousarray(rows[k]).tobytes()) for k in range(used)]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    if mode == "byte":
        out = np.zeros((n, 4), dtype=np.uint8)
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(unpack.decompress(p), dtype=np.uint8)
        return out.reshape(-1).view("<u4")
    bits = np.zeros((n, 32), dtype=np.uint8)
    for k, p in enumerate(planes):
        bits[:, k] = np.unpackbits(np.frombuffer(unpack.decompress(p), dtype=np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2), modulo that of crc32, in its reflected bit order."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """crc32 of two joined byte strings, from theirs and the second one's length."""
    shift, square, n = 1 << 31, 1 << 30, 8 * second_bytes
    while n:
        if n & 1:
            shift = _times(shift, square)
        square, n = _times(square, square), n >> 1
    return _times(shift, first) ^ second


def _encode(path: str, style: str, end_id: int, block_ids: int, mode: str):
    def chunks(batches):
        ids_of, shard, held = encoder(path, style).ids, None, None

        def put(ids: np.ndarray, docs: list) -> pa.RecordBatch:
            nonlocal block, past
            row = {
                "shard": [shard], "block": [block], "from_id": [past], "n_ids": [len(ids)], "mode": [mode], "planes": [to_planes(ids, mode)],
                "crc32": [zlib.crc32(ids.tobytes())], "doc_no": [[d[0] for d in docs]], "doc_ids": [[d[1] for d in docs]],
                "doc_from": [[d[2] for d in docs]], "lengths": [[d[3] for d in docs]],
            }
            block, past = block + 1, past + len(ids)
            return shared.batch_of(CHUNK, row)

        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for part, doc_id, text in shared.rows_of(batch, "part", "doc_id", "text"):
                if part != shard:
                    if held:
                        yield put(np.frombuffer(b"".join(held), dtype="<u4"), docs)
                    shard, block, past, held, docs, room, number = part, 0, 0, [], [], block_ids, 0
                ids, begun = ids_of(text) + end, 0
                while begun < len(ids) // 4:
                    n = min(room, len(ids) // 4 - begun)
                    held.append(ids[4 * begun : 4 * (begun + n)])
                    docs.append((number, doc_id, begun, n))
                    begun, room = begun + n, room - n
                    if not room:
                        yield put(np.frombuffer(b"".join(held), dtype="<u4"), docs)
                        held, docs, room = [], [], block_ids
                number += 1
        if held:
            yield put(np.frombuffer(b"".join(held), dtype="<u4"), docs)

    return chunks


def write_planes(docs: DataFrame, path: str, tokenizer: str, *, style: str = "whole", end_id: int = 0, block_ids: int = 65_536, mode: str = "byte", rows_per_part: int = 2_048) -> None:
    """Encodes every whole text of docs (doc_id, text) and writes the token file to the folder path."""
    spark = docs.sparkSession
    bounds = shared.part_bounds(docs, rows_per_part)
    rows = shared.in_order(shared.texts_of(docs, shared.part_of(bounds).alias("part")), "doc_id", "text")
    rows.mapInArrow(_encode(tokenizer, style, end_id, block_ids, mode), CHUNK).write.option("compression", "none").parquet(f"{path}/chunks")
    parts = spark.read.schema(CHUNK).parquet(f"{path}/chunks").select("shard", "block", "from_id", "n_ids", F.transform("planes", F.octet_length).alias("plane_bytes"), "crc32")
    # One row per part, of which part_bounds() makes 100,000 at most.
    begun, starts = 0, []
    for shard, n in parts.groupBy("shard").agg(F.sum("n_ids")).orderBy("shard").collect():
        starts.append((shard, begun))
        begun += n
    starts = spark.createDataFrame(starts, "shard long, shard_start long")
    index = parts.join(F.broadcast(starts), "shard").select("shard", "block", (F.col("shard_start") + F.col("from_id")).alias("start"), "n_ids", "plane_bytes", "crc32")
    index.coalesce(max(1, shared.partitions(spark) // 8)).write.parquet(f"{path}/index")


INDEX = "shard long, block long, start long, n_ids long, plane_bytes array<int>, crc32 long"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def _checked(planes: list[bytes], n: int, mode: str, crc: int) -> np.ndarray:
    ids = from_planes(planes, n, mode)
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a chunk's ids differ from those that were written")
    return ids


def _pieces(batches):
    for batch in batches:
        for c in batch.to_pylist():
            data, at, out = _checked(c["planes"], c["n_ids"], c["mode"], c["crc32"]).tobytes(), 0, {f.name: [] for f in PIECE}
            for number, doc_id, begun, n in zip(c["doc_no"], c["doc_ids"], c["doc_from"], c["lengths"], strict=True):
                row = (c["shard"], number, doc_id, c["from_id"] + at, begun, n, zlib.crc32(data[4 * at : 4 * (at + n)]))
                for f, v in zip(PIECE, row, strict=True):
                    out[f.name].append(v)
                at += n
            yield shared.batch_of(PIECE, out)


def _whole_crc(batches):
    for batch in batches:
        pieces = batch.column("pieces").to_pylist()
        out = []
        for p in pieces:
            crc, *rest = sorted((x["doc_from"], x["n"], x["crc"]) for x in p)
            crc = crc[2]
            for _, n, more in rest:
                crc = joined_crc(crc, more, 4 * n)
            out.append(crc)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(out, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the chunks. Only a document's piece
    checksums (one per block that it touches) are gathered, never its ids."""
    chunks = spark.read.schema(CHUNK).parquet(f"{path}/chunks")
    # One row per part, of which there are 100,000 at most.
    starts = read_index(spark, path).groupBy("shard").agg(F.min("start").alias("shard_start"))
    pieces = chunks.mapInArrow(_pieces, PIECE).join(F.broadcast(starts), "shard")
    by_doc = pieces.groupBy("shard", "doc_no", "doc_id").agg(
        F.min(F.col("shard_start") + F.col("at")).alias("start"), F.sum("n").alias("n_tokens"), F.collect_list(F.struct("doc_from", "n", "crc")).alias("pieces")
    )
    return by_doc.select("doc_id", "start", "n_tokens", "pieces").mapInArrow(_whole_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _cut(start: int, stop: int):
    def cut(batches):
        for batch in batches:
            out = {"start": [], "ids": []}
            for c in batch.to_pylist():
                ids = _checked(c["planes"], c["n_ids"], c["mode"], c["crc32"])
                a, z = max(0, start - c["start"]), min(len(ids), stop - c["start"])
                out["start"].append(c["start"] + a)
                out["ids"].append(ids[a:z].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out["start"], pa.int64()), pa.array(out["ids"], pa.list_(pa.int64()))], names=["start", "ids"])

    return cut


def read_span(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """start, ids of the chunks' shares of the global positions start .. start+length-1; the index tells which to read."""
    there = read_index(spark, path).where((F.col("start") < start + length) & (F.col("start") + F.col("n_ids") > start)).select("shard", "block", "start")
    chunks = spark.read.schema(CHUNK).parquet(f"{path}/chunks").select("shard", "block", "n_ids", "mode", "planes", "crc32")
    return chunks.join(there, ["shard", "block"]).mapInArrow(_cut(start, start + length), "start long, ids array<long>")
