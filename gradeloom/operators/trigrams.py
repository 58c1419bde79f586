"""Substring search that skips files: each file of a table has a bit set of the trigrams of its texts.

A text that contains a needle holds all trigrams of the needle, so a file whose bits lack one of them has no such text. What is left is read and checked exactly,
with the same condition as without an index. Trigrams are of lower-cased code points and fall on BITS bits by a hash, so a bit may be set by
another trigram; that reads a file too much, never one too few. Needles under three characters skip nothing.

The bit sets are a table of their own beside the files (8 KB for a file, more if Spark reads a file in several parts: a row lies in one part, so
each part has its own). New files are indexed by extend(), files that are gone are simply not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 1 << 16
#: Odd multipliers of the three code points.
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)


def bits_of(text: str) -> np.ndarray:
    """The bits of a text's trigrams."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) < 3:
        return np.empty(0, np.int64)
    mixed = codes[:-2] * FACTORS[0] + codes[1:-1] * FACTORS[1] + codes[2:] * FACTORS[2]
    return np.unique((mixed ^ (mixed >> np.uint64(17))) & np.uint64(BITS - 1)).astype(np.int64)


@dataclass(frozen=True)
class TrigramIndex:
    """An index over a folder of Parquet files and some of their text columns."""

    spark: SparkSession
    table: str
    path: str
    columns: tuple[str, ...]


def _marked(batches):
    """One bit set for each file of the task, as 64-bit words."""
    files: dict[str, np.ndarray] = {}
    for batch in batches:
        for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = files.setdefault(file, np.zeros(BITS, bool))
            own[bits_of(text)] = True
    words = [np.packbits(x, bitorder="little").view("<i8").tolist() for x in files.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(files), pa.string()), pa.array(words, pa.list_(pa.int64()))], ["file", "words"])


def _indexed(index: TrigramIndex) -> set[str]:
    """Names of the files that have a bit set: as many as Spark lists itself to read the table."""
    return {r.file for r in index.spark.read.parquet(index.path).select("file").distinct().collect()}


def _write(index: TrigramIndex, rows: DataFrame, mode: str) -> None:
    texts = F.array(*(F.lower(F.col(c)) for c in index.columns))
    each = rows.select(F.input_file_name().alias("file"), texts.alias("texts")).select("file", F.explode(F.array_compact("texts")).alias("text"))
    each.mapInArrow(_marked, "file string, words array<bigint>").write.mode(mode).parquet(index.path)
    # Files without a text have an empty set.
    if bare := sorted(set(rows.inputFiles()) - _indexed(index)):
        index.spark.createDataFrame([(f, [0] * (BITS // 64)) for f in bare], "file string, words array<bigint>").write.mode("append").parquet(index.path)


def build(spark: SparkSession, table: str, path: str, columns: tuple[str, ...]) -> TrigramIndex:
    """Indexes all files of the folder `table`."""
    index = TrigramIndex(spark, table, path, tuple(columns))
    _write(index, spark.read.parquet(table), "overwrite")
    return index


def extend(index: TrigramIndex) -> int:
    """Indexes the files that came since; how many these are."""
    known = _indexed(index)
    fresh = [f for f in index.spark.read.parquet(index.table).inputFiles() if f not in known]
    if fresh:
        _write(index, index.spark.read.parquet(*fresh), "append")
    return len(fresh)


def files_for(index: TrigramIndex, parts: list[str]) -> list[str]:
    """Files that may hold all the parts (lower-cased literals)."""
    there = index.spark.read.parquet(index.table).inputFiles()
    bits = sorted({int(b) for part in parts for b in bits_of(part)})
    if not bits:
        return there
    fits = F.lit(True)
    masks: dict[int, int] = {}
    for b in bits:
        masks[b // 64] = masks.get(b // 64, 0) | 1 << b % 64
    for word, mask in masks.items():
        mask = F.lit(mask - (1 << 64) if mask >> 63 else mask)
        fits = fits & (F.get("words", F.lit(word)).bitwiseAND(mask) == mask)
    held = index.spark.read.parquet(index.path).where(fits).select("file").distinct()
    may = {r.file for r in held.collect()}
    known = _indexed(index)
    return [f for f in there if f in may or f not in known]


def literals(typed: str) -> list[str]:
    """What a pattern of LIKE holds for certain, between its wildcards."""
    return [x for x in typed.lower().replace("_", "%").split("%") if x]


def rows_with(index: TrigramIndex, condition: Column, parts: list[str]) -> DataFrame:
    """Rows of the table that meet a condition which only texts with all the parts, each within one text, can meet."""
    files = files_for(index, parts)
    rows = index.spark.read.schema(index.spark.read.parquet(index.table).schema)
    return (rows.parquet(*files) if files else index.spark.read.parquet(index.table).limit(0)).where(condition)
