"""Rows that arrive once: a ledger of ids beside the table, and commits that make a batch whole or nothing.

A batch is judged against the ledger alone, in buckets by hash of the id, of which only those that the batch touches are read; the stored rows never are.
Then its new rows are written, then their ids, then an empty file commits the batch. What a lost writer left of a batch is written over when the batch
comes again, and a batch that is committed is left alone, so a replay at any point gives the same table. `fan_in` batches' ledgers are merged
into one, also behind a commit.

Folders: batch=N with rows (readers that don't ask the ledger see those of an uncommitted batch, too), _ledger/bN or cN (the merged ones up to N), _commits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.sources.ingest import judged_uploads


class Ledger:
    def __init__(self, spark: SparkSession, path: str, *, row_id: str = "run_id", buckets: int = 64, fan_in: int = 32):
        self.spark, self.path, self.row_id, self.buckets, self.fan_in = spark, path, row_id, buckets, fan_in
        self.files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, below: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def _names(self, below: str) -> list[str]:
        at = self._at(below)
        return sorted(s.getPath().getName() for s in self.files.listStatus(at)) if self.files.exists(at) else []

    def _commit(self, name: str) -> None:
        self.files.create(self._at(f"_commits/{name}"), True).close()

    def commits(self) -> tuple[set[int], int]:
        """Committed batches, and the last one whose ledger was merged (-1: none)."""
        names = self._names("_commits")
        return {int(n[1:]) for n in names if n[0] == "b"}, max((int(n[1:]) for n in names if n[0] == "c"), default=-1)

    def known(self, ids: DataFrame) -> DataFrame:
        """Ledger rows (id, content_hash) in the buckets of ids, of committed batches."""
        done, merged = self.commits()
        parts = [f"{self.path}/_ledger/b{n:09d}" for n in sorted(done) if n > merged] + ([f"{self.path}/_ledger/c{merged:09d}"] if merged >= 0 else [])
        touched = [r.bucket for r in ids.select(self._bucket().alias("bucket")).distinct().collect()]  # as many as there are buckets
        schema = f"{self.row_id} string, content_hash string, bucket int"
        out = self.spark.createDataFrame([], schema)
        for part in parts:
            out = out.union(self.spark.read.schema(schema).parquet(part).where(F.col("bucket").isin(touched)))
        return out.drop("bucket")

    def _bucket(self):
        return F.pmod(F.xxhash64(self.row_id), F.lit(self.buckets)).cast("int")

    def _write_ids(self, ids: DataFrame, name: str) -> None:
        own = ids.select(self.row_id, "content_hash", self._bucket().alias("bucket"))
        own.repartition("bucket").sortWithinPartitions("bucket", self.row_id).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/_ledger/{name}")

    def put(self, rows: DataFrame, number: int) -> bool:
        """Takes batch `number`, unless it is committed: of its rows (with content_hash) those of new ids are stored, the lesser hash of two."""
        if number in self.commits()[0]:
            return False
        rows = rows.dropDuplicates([self.row_id, "content_hash"])
        named = lambda df: df.withColumnRenamed(self.row_id, "run_id")
        judged = judged_uploads(named(self.known(rows)), named(rows)).where("outcome = 'created'").select(F.col("run_id").alias(self.row_id), "content_hash")
        rows.join(judged, [self.row_id, "content_hash"], "left_semi").write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        # The ids are those of the rows that were written.
        self._write_ids(self.spark.read.parquet(f"{self.path}/batch={number}"), f"b{number:09d}")
        self._commit(f"b{number:09d}")
        done, merged = self.commits()
        if len([n for n in done if n > merged]) >= self.fan_in:
            self.merge()
        return True

    def merge(self) -> None:
        """One ledger out of all committed ones; the old ones go once it is committed."""
        done, merged = self.commits()
        if not done or (last := max(done)) <= merged:
            return
        parts = [f"b{n:09d}" for n in sorted(done) if n > merged] + ([f"c{merged:09d}"] if merged >= 0 else [])
        schema, out = f"{self.row_id} string, content_hash string, bucket int", None
        for part in parts:
            own = self.spark.read.schema(schema).parquet(f"{self.path}/_ledger/{part}").drop("bucket")
            out = own if out is None else out.union(own)
        self._write_ids(out, f"c{last:09d}")
        self._commit(f"c{last:09d}")
        for part in parts:
            self.files.delete(self._at(f"_ledger/{part}"), True)

    def rows(self) -> DataFrame | None:
        """Rows of committed batches; None before the first."""
        done = self.commits()[0]
        paths = [f"{self.path}/batch={n}" for n in sorted(done)]
        return self.spark.read.option("basePath", self.path).parquet(*paths).drop("batch") if paths else None
