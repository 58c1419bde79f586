"""Derived tables that are written once for a session and an input, in the folder that all executors see."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple[str, str, str], str] = {}


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


def materialised(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build() makes of sf_dir, written by the session's first query that needs it. Rows of a run lie together,
    so filters on run_id skip row groups."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path, df = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", build()
        (df.repartition("run_id").sortWithinPartitions("run_id") if "run_id" in df.columns else df).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def folder_of(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Where materialised() or written() has put something."""
    return _WRITTEN[(spark.sparkContext.applicationId, sf_dir, name)]


def written(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], object]) -> str:
    """The folder that write(path) fills for sf_dir, once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        write(path := f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
        _WRITTEN[key] = path
    return _WRITTEN[key]
