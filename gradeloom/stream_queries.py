"""Registered queries on pages by layout, progress of runs, re-indexing in batches and uploads, each over whole tables; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.plans import layout, store
from gradeloom.plans import views as v
from gradeloom.queries import WITH
from gradeloom.streaming import progress as pr
from gradeloom.streaming.ledger import Ledger


def _folder(spark: SparkSession, name: str) -> str:
    return f"{store.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _pages(spark: SparkSession, own: layout.Layout, size: int, pages: int, descending: bool) -> DataFrame:
    """Rows of the first pages, each asked for by the last row of the one before."""
    out, after = None, None
    for n in range(pages):
        rows = layout.page(own, size, after, descending).limit(size)
        part = rows.select(F.lit(n).alias("page"), own.row_id, own.key)
        out = part if out is None else out.union(part)
        last = rows.agg((F.min if descending else F.max)(F.struct(own.key, own.row_id)).alias("at")).first()["at"]
        if last is None:
            break
        after = tuple(last)
    return out


def run_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of runs, newest first, out of files by time."""
    path = store.written(spark, d, "runs-by-time", lambda path: layout.lay_out(v.runs(spark, d), path, "created_at", "run_id", rows_per_file=100))
    return _pages(spark, layout.Layout(spark, path, "created_at", "run_id"), 20, 4, True)


RUN_PAGES = f"""{WITH}, k AS (SELECT run_id, created_at, row_number() OVER (ORDER BY created_at DESC, run_id DESC) - 1 AS n FROM runs)
SELECT (n // 20)::INTEGER AS page, run_id, created_at FROM k WHERE n < 80"""


def entry_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of cache entries, smallest first, out of files by size."""
    path = store.written(spark, d, "entries-by-size", lambda path: layout.lay_out(v.cache_entries(spark, d), path, "size", "entry_key", rows_per_file=20_000))
    return _pages(spark, layout.Layout(spark, path, "size", "entry_key"), 50, 3, False)


ENTRY_PAGES = f"""WITH c AS ({v.CACHE}), k AS (SELECT entry_key, size, row_number() OVER (ORDER BY size, entry_key) - 1 AS n FROM c)
SELECT (n // 50)::INTEGER AS page, entry_key, size FROM k WHERE n < 150"""

#: Events of runs out of the table events: of each user a run, of each two neighbouring ids a case.
CASE_EVENTS = """
SELECT concat('u', cast(user_id AS STRING)) AS run_id,
  CASE WHEN event_id % 20 = 0 THEN 'run_started' WHEN event_id % 20 = 19 AND user_id % 3 = 0 THEN 'run_finished' WHEN event_id % 2 = 0 THEN 'case_started' ELSE 'case_finished' END AS kind,
  CASE WHEN event_id % 20 = 0 OR event_id % 20 = 19 AND user_id % 3 = 0 THEN '' ELSE concat('c', cast(event_id % 400 AS STRING)) END AS case_key,
  CASE WHEN event_id % 20 = 0 THEN cast(100 + user_id AS BIGINT) ELSE NULL END AS total,
  CASE WHEN event_type IN ('click', 'view') THEN 'pass' WHEN event_type = 'purchase' THEN 'fail' ELSE 'error' END AS status,
  ts AS at
FROM events
"""


def run_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far each run came, by a stream over all events that ends when they are read."""
    table = spark.read.parquet(f"{d}/events.parquet")
    # Streams read folders; several files make several micro-batches.
    files = store.written(spark, d, "event-files", table.repartition(4).write.parquet)
    events = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(files)
    events.createOrReplaceTempView("event_stream")
    timed = spark.sql(CASE_EVENTS.replace("FROM events", "FROM event_stream")).withColumn("at", F.col("at").cast("timestamp"))
    told = pr.progress(timed, delay="20000 days", idle_seconds=10**9)
    out, at = _folder(spark, "progress"), _folder(spark, "progress-checkpoint")
    told.writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out).awaitTermination()
    schema = "run_id string, state string, total long, cases_started long, cases_finished long, passed long, failed long, errored long, last long"
    return pr.latest(spark.read.schema(schema).parquet(out)).drop("last")


# Within the delay a case counts once, with the status of whichever of its events comes first; statuses are therefore left out here.
RUN_PROGRESS = f"""WITH e AS ({CASE_EVENTS}), k AS (SELECT DISTINCT run_id, kind, case_key FROM e)
SELECT run_id, CASE WHEN count(*) FILTER (WHERE kind = 'run_finished') > 0 THEN 'finished' ELSE 'running' END AS state,
  CASE WHEN count(*) FILTER (WHERE kind = 'run_started') > 0 THEN 100 + substr(run_id, 2)::BIGINT END AS total,
  count(*) FILTER (WHERE kind = 'case_started') AS cases_started, count(*) FILTER (WHERE kind = 'case_finished') AS cases_finished FROM k GROUP BY run_id"""


def uploaded_once(spark: SparkSession, d: str) -> DataFrame:
    """Orders as uploads in three batches, of which the second comes twice and repeats ids of the first."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("o"), F.col("o_orderkey") % 5000).alias("run_id"), F.sha2(F.col("o_orderpriority"), 256).alias("content_hash"), (F.col("o_orderkey") % 3).alias("batch"))
    own = Ledger(spark, _folder(spark, "uploads"), fan_in=2)
    for n, rows in ((0, orders.where("batch = 0")), (1, orders.where("batch < 2")), (1, orders.where("batch < 2")), (2, orders)):
        own.put(rows.drop("batch"), n)
    return own.rows().select("run_id", "content_hash")


UPLOADED_ONCE = """WITH o AS (SELECT 'o' || (o_orderkey % 5000) AS run_id, sha256(o_orderpriority) AS content_hash, o_orderkey % 3 AS batch FROM orders),
f AS (SELECT run_id, min(batch) AS batch FROM o GROUP BY run_id) SELECT run_id, min(content_hash) AS content_hash FROM o JOIN f USING (run_id, batch) GROUP BY run_id"""

_Q = {
    "run_pages": (run_pages, RUN_PAGES),
    "entry_pages": (entry_pages, ENTRY_PAGES),
    "run_progress": (lambda spark, d: run_progress(spark, d).drop("passed", "failed", "errored"), RUN_PROGRESS),
    "uploaded_once": (uploaded_once, UPLOADED_ONCE),
}


def queries() -> dict:
    return {name: q for name, (q, _) in _Q.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _Q.items()}
