"""Pages that read few files, batches that crash at any step, progress of runs with repeated, late and missing events."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import cache
from gradeloom.plans import layout, store
from gradeloom.streaming import drain as dr
from gradeloom.streaming import progress as pr
from gradeloom.streaming.ledger import Ledger


def folder(spark):
    return f"{store.shared_folder(spark)}/{uuid.uuid4().hex}"


@pytest.mark.parametrize("descending", [False, True])
def test_pages_read_few_files(spark, descending):
    rows = [((i * 37) % 40 if i % 11 else None, f"id{i:03d}") for i in range(300)]
    own = layout.lay_out(spark.createDataFrame(rows, "k int, id string"), folder(spark), "k", "id", rows_per_file=30)
    want = sorted((r for r in rows if r[0] is not None), reverse=descending)
    got, after = [], None
    while True:
        files = layout.files_of_page(own, 8, after, descending)
        assert len(files) <= 2
        page = [tuple(r) for r in layout.page(own, 7, after, descending).collect()]
        got += page[:7]
        if len(page) <= 7:
            break
        after = page[6]
    assert got == want and len(own.files()) >= 8


def uploads(spark, *rows):
    return spark.createDataFrame(rows, "run_id string, content_hash string, n int")


def test_replayed_batches_are_exact(spark, monkeypatch):
    batches = [[("a", "1", 0), ("b", "1", 0), ("b", "0", 9)], [("b", "2", 1), ("c", "1", 1), ("c", "1", 1)], [("a", "1", 2), ("d", "1", 2)], [("e", "1", 3), ("c", "0", 3)]]
    want = [("a", "1", 0), ("b", "0", 9), ("c", "1", 1), ("d", "1", 2), ("e", "1", 3)]

    class Lost(Exception):
        pass

    def lose(*_):
        raise Lost

    for at in (None, "_write_ids", "_commit", "merge"):
        path = folder(spark)
        for n, rows in enumerate(batches):
            own = Ledger(spark, path, buckets=4, fan_in=2)
            if at and n in (1, 3):
                with monkeypatch.context() as m:
                    m.setattr(Ledger, at, lose)
                    try:
                        own.put(uploads(spark, *rows), n)
                    except Lost:
                        pass
            own = Ledger(spark, path, buckets=4, fan_in=2)
            own.put(uploads(spark, *rows), n)
            assert own.put(uploads(spark, *rows), n) is False
        assert sorted(map(tuple, own.rows().collect())) == want, at
        assert sorted(tuple(r)[:1] for r in own.known(uploads(spark, *[(x, "", 0) for x in "abcde"])).collect()) == [(x,) for x in "abcde"]
    assert Ledger(spark, folder(spark)).rows() is None


def test_a_batch_reads_no_stored_rows(spark):
    own = Ledger(spark, folder(spark), buckets=8, fan_in=100)
    own.put(uploads(spark, *[(f"r{i}", "1", i) for i in range(500)]), 0)
    read = own.known(uploads(spark, ("r7", "1", 0))).inputFiles()
    assert read and all("/_ledger/" in f for f in read)
    plan = own.known(uploads(spark, ("r7", "1", 0)))._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and own.known(uploads(spark, ("r7", "1", 0))).count() < 200


def test_drain_stops_and_goes_on(spark):
    entries = spark.createDataFrame([(f"e{i:03d}", i // 3, None if i % 4 else 5, False, None, "") for i in range(100)], "entry_key string, created_at long, indexed_at long, index_ok boolean, kind string, output_preview string")
    bodies = entries.select("entry_key", F.format_string('{"output": "text %s", "attempts": 1}', "entry_key").alias("body"))
    source = layout.lay_out(entries.where("indexed_at IS NULL"), folder(spark), "created_at", "entry_key", rows_per_file=20)

    def work(rows):
        fresh = cache.indexed(bodies.join(rows.select("entry_key"), "entry_key", "left_semi"), 9)
        return fresh.join(rows.select("entry_key", "created_at"), "entry_key")

    path = folder(spark)
    assert dr.Drain(spark, source, path).results() is None
    sizes = []
    for n in range(20):
        own = dr.Drain(spark, source, path, size=16)  # a new process each time
        if n == 2:  # a writer was lost between results and commit
            work(layout.page(source, 16, own.cursor()).limit(3)).write.parquet(f"{path}/batch=2")
        took = own.step(work)
        if not took:
            break
        sizes.append(took)
    assert sizes == [16, 16, 16, 16, 11] and own.step(work) == 0
    columns = ["entry_key", "created_at", "indexed_at", "index_ok", "kind", "output_preview"]
    got = cache.overlaid(entries, own.results().drop("created_at")).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, cache.reindexed(entries, bodies, 9).select(columns).collect()))


def event(run, kind, case, second, status=None, total=None):
    return run, kind, case, total, status, datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=second)


def test_progress_of_runs(spark, tmp_path):
    schema = "run_id string, kind string, case_key string, total long, status string, at timestamp"
    done = lambda run, case, s, status="pass": event(run, "case_finished", case, s, status)
    batches = [
        [event("a", "run_started", "", 0, total=3), event("a", "case_started", "1", 1), done("a", "1", 2), event("b", "run_started", "", 3, total=2)],
        [done("a", "1", 2), done("a", "2", 10, "fail"), event("a", "run_started", "", 0, total=3), done("b", "1", 12, "error")],  # repeated
        [done("a", "3", 11), event("a", "run_finished", "", 20), done("c", "1", 3600)],
        [done("c", "2", 3601), done("d", "1", 5)],  # an hour too late
        [done("c", "3", 9000)],
        [done("c", "4", 9001)],
    ]
    source, out, at = (tmp_path / x for x in ("in", "out", "at"))
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{source}/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{source}")
        told = pr.progress(stream, delay="60 seconds", idle_seconds=600)
        told.writeStream.format("parquet").option("checkpointLocation", f"file://{at}").trigger(availableNow=True).start(f"file://{out}").awaitTermination()
    rows = spark.read.parquet(f"file://{out}").collect()
    last = {r.run_id: r for r in pr.latest(spark.read.parquet(f"file://{out}")).collect()}
    told = lambda r: (r.state, r.total, r.cases_started, r.cases_finished, r.passed, r.failed, r.errored)
    assert told(last["a"]) == ("finished", 3, 1, 3, 2, 1, 0)
    # b fell silent: it is told once, with what it had.
    assert told(last["b"]) == ("stalled", 2, 0, 1, 0, 0, 1) and sum(r.run_id == "b" and r.state == "stalled" for r in rows) == 1
    assert "d" not in last and [r.state for r in rows if r.run_id == "a"].count("stalled") == 0
    # As a batch query over distinct events gives it.
    events = spark.createDataFrame([e for b in batches for e in b if e[0] in "a"], schema).dropDuplicates(["run_id", "kind", "case_key"])
    r = events.groupBy("run_id").agg(*pr.counts()).first()
    assert (r.total, r.cases_started, r.cases_finished, r.passed, r.failed, r.errored, r.last) == (*told(last["a"])[1:], last["a"].last)
