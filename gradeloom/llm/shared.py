"""What the operators of this subpackage share: the folder all executors see, word splitting, ordered parts."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


@functools.cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session that has none gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: its lineage ends in files that survive executors."""
    path = path or new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote, through the file system that holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables that only later steps of one operator read. drop() deletes those that were written so far, so it comes when
    all that is read later has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, tag: str) -> DataFrame:
        self.paths.append(path := new_folder(self.spark, tag))
        return stored(df, tag, path)

    def drop(self) -> None:
        for path in self.paths:
            dropped(self.spark, path)
        self.paths = []


def fresh_name(df: DataFrame, name: str) -> str:
    """name, or with more underscores, so that no column of df (in any case) has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_of(batch: pa.RecordBatch, *columns: str, at_once: int = 512):
    """Rows of a batch as tuples; only at_once of them are Python objects at a time."""
    names = columns or batch.schema.names
    for k in range(0, batch.num_rows, at_once):
        part = batch.slice(k, at_once)
        yield from zip(*(part.column(c).to_pylist() for c in names), strict=True)
    # Workers live from stage to stage; what Arrow holds of earlier batches goes back to the system.
    pa.default_memory_pool().release_unused()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: str | None) -> list[bytes]:
    """bytes.split() splits at exactly the white space that WORD leaves out."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


#: ASCII letters are lower-cased, digits stay, other ASCII characters become blanks; the bytes of all other characters stay.
_TERM_BYTES = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_TERM_BYTES).split() if text else []


def texts_of(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text alone, so that no other column's name can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def in_folds(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def part_bounds(docs: DataFrame, rows_per_part: int, most: int = 100_000) -> list[int]:
    """Ids that cut docs into parts of about rows_per_part rows in ascending doc_id; at most `most` parts."""
    rows = docs.count()
    parts = max(1, min(most, -(-rows // rows_per_part)))
    if parts == 1:
        return []
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], max(200_000, 10 * parts))).first()[0] or []
    return sorted({int(x) for x in cuts})


def part_of(bounds: list[int]):
    """The part of a doc_id: how many bounds lie below it. Null ids come first."""
    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf(T.LongType())
    def part(ids):
        filled = ids.fillna(np.iinfo(np.int64).min).astype("int64").to_numpy()
        return pd.Series(np.searchsorted(cuts, filled, side="left"))

    return part("doc_id") if bounds else F.lit(0).cast("long")


def in_order(df: DataFrame, *within: str) -> DataFrame:
    """Whole parts to single tasks, each part's rows in order; a task may hold several parts, one after the other."""
    return df.repartition(partitions(df.sparkSession), "part").sortWithinPartitions("part", *within)


def batch_of(schema: T.StructType, columns: dict) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each run, one after the other."""
    ends = np.cumsum(lengths)
    out = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    keep = lengths > 0
    if not len(out):
        return out
    s, n = starts[keep], lengths[keep]
    out[0] = s[0]
    at = np.cumsum(n)[:-1]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


class WordHash(dict):
    """64-bit hash of a word's bytes, remembered; at most `most` words are held."""

    def __init__(self, most: int = 100_000, seed: int = 0):
        super().__init__()
        import xxhash

        self.most, self.seed, self.digest = most, seed, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = self.digest(word, self.seed)
        return h

    def all(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=np.uint64, count=len(found))
