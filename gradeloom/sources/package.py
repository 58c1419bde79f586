"""Makes the library importable on executors that don't share the driver's folders."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]


@functools.cache
def _sent(application: str) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "gradeloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted([*ROOT.glob("gradeloom/**/*.py"), *ROOT.glob("corpus_pipeline.py")]):
            z.write(p, p.relative_to(ROOT))
    SparkSession.active().sparkContext.addPyFile(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors, unless their PYTHONPATH has it already."""
    if str(ROOT) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        _sent(spark.sparkContext.applicationId)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run
