"""Run documents from a folder into a table, each run once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeloom.streaming.ledger import Ledger


def ingest_runs(spark: SparkSession, source: str, schema: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Reads new JSON documents in `source` and stores those whose run_id is new, each once, whatever a lost batch left (see Ledger); others of a
    stored run_id are left out. The stream keeps its checkpoint with the table: batches are told apart by their numbers."""
    stream = spark.readStream.schema(schema).json(source)

    def put(batch: DataFrame, number: int) -> None:
        hashed = batch.withColumn("content_hash", F.sha2(F.to_json(F.struct(*batch.columns)), 256))
        Ledger(batch.sparkSession, table_path).put(hashed, number)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
