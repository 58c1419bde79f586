"""Work on many rows in small batches that can stop anywhere: each takes the next rows behind the last committed one, and is committed when its
results are written.

The rows come from a layout by (sort key, id), so a batch reads the files of its own rows. Results are batch=N with the rows' key and id; an empty file
in _commits makes batch N count. The cursor is the last key and id of the last committed batch, so it can't disagree with the results; a batch whose
writer was lost comes again, from the same cursor, over what was left of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeloom.plans.layout import Layout, page


class Drain:
    def __init__(self, spark: SparkSession, source: Layout, path: str, *, size: int = 200):
        self.spark, self.source, self.path, self.size = spark, source, path, size
        self.files = self._at("_commits").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, below: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")

    def committed(self) -> int:
        """How many batches are committed."""
        at = self._at("_commits")
        return len(self.files.listStatus(at)) if self.files.exists(at) else 0

    def cursor(self) -> tuple | None:
        """Key and id of the last row that is done."""
        n = self.committed()
        if not n:
            return None
        last = self.spark.read.parquet(f"{self.path}/batch={n - 1}").agg(F.max(F.struct(self.source.key, self.source.row_id)).alias("at")).first()
        return tuple(last["at"])

    def step(self, work: Callable[[DataFrame], DataFrame]) -> int:
        """One batch; how many rows it took, 0 when nothing is left. work() gives a row for each row, with the key and the id."""
        n = self.committed()
        rows = page(self.source, self.size, self.cursor()).limit(self.size)
        at = f"{self.path}/batch={n}"
        work(rows).write.mode("overwrite").parquet(at)
        took = self.spark.read.parquet(at).count()
        if took:
            self.files.create(self._at(f"_commits/{n:09d}"), True).close()
        return took

    def results(self) -> DataFrame | None:
        """Rows of all committed batches; None before the first."""
        paths = [f"{self.path}/batch={n}" for n in range(self.committed())]
        return self.spark.read.parquet(*paths) if paths else None


def on_ticks(drain: Drain, work: Callable[[DataFrame], DataFrame], ticks: DataFrame, checkpoint: str) -> StreamingQuery:
    """One batch for each micro-batch of ticks, beside the queries that read on."""
    return ticks.writeStream.foreachBatch(lambda _, __: drain.step(work) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
