"""Progress of runs from their events, while they come: repeated and late ones, runs that end and runs that fall silent.

Events: run_id, kind (run_started with total, case_started, case_finished with status, run_finished), case_key ('' for events of a run), total, status, at
(timestamp). Each (run, kind, case) counts once within the delay that the watermark grants; what is later than that is left out. Repeats are dropped by Spark's
own keyed state, so that a run's state is its counts alone, however many cases it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "total long, cases_started long, cases_finished long, passed long, failed long, errored long, begun boolean, ended boolean, last long"
OUT = "run_id string, state string, total long, cases_started long, cases_finished long, passed long, failed long, errored long, last long"


def counts() -> list[Column]:
    """What a run's state counts, as aggregates of its distinct events."""
    of = lambda kind, status=None: F.count_if((F.col("kind") == kind) & (F.lit(True) if status is None else F.coalesce(F.col("status") == status, F.lit(False))))
    done = "case_finished"
    named = {"cases_started": of("case_started"), "cases_finished": of(done), "passed": of(done, "pass"), "failed": of(done, "fail"), "errored": of(done, "error")}
    return [F.max(F.when(F.col("kind") == "run_started", F.col("total"))).alias("total"), *(c.alias(n) for n, c in named.items()), F.max(F.unix_millis("at")).alias("last")]


def progress(events: DataFrame, *, delay: str = "5 minutes", idle_seconds: int = 600) -> DataFrame:
    """A row for each run and micro-batch with events of it: running or finished, what its run_started promised, and its counts so far. A run without a
    run_finished that has no event for idle_seconds (by the watermark) gets a last row, stalled; events that come later count anew."""
    once = events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["run_id", "kind", "case_key"])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        have = list(state.get) if state.exists else [None, 0, 0, 0, 0, 0, False, False, 0]
        if state.hasTimedOut:
            state.remove()
            if not have[7]:
                yield pd.DataFrame([[key[0], "stalled", *have[:6], have[8]]], columns=[f.split()[0] for f in OUT.split(", ")]).astype({"total": "Int64"})
            return
        for rows in batches:
            kinds, done = rows["kind"], rows["kind"] == "case_finished"
            totals = rows.loc[kinds == "run_started", "total"].dropna()
            if len(totals):
                have[0] = int(max(totals.max(), have[0] or 0))
            have[1] += int((kinds == "case_started").sum())
            have[2] += int(done.sum())
            for k, status in ((3, "pass"), (4, "fail"), (5, "error")):
                have[k] += int((done & (rows["status"] == status)).sum())
            have[6] = have[6] or bool((kinds == "run_started").any())
            have[7] = have[7] or bool((kinds == "run_finished").any())
            have[8] = max(have[8], int(rows["millis"].max()))
        state.update(tuple(have))
        state.setTimeoutTimestamp(max(have[8] + idle_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([[key[0], "finished" if have[7] else "running", *have[:6], have[8]]], columns=[f.split()[0] for f in OUT.split(", ")]).astype({"total": "Int64"})

    told = once.select("run_id", "kind", "total", "status", "at", F.unix_millis("at").alias("millis"))
    return told.groupBy("run_id").applyInPandasWithState(update, OUT, STATE, "append", "EventTimeTimeout")


def latest(told: DataFrame) -> DataFrame:
    """The furthest row of each run in what progress() has written."""
    rank = F.struct("cases_finished", "cases_started", F.coalesce("total", F.lit(-1)).alias("t"), F.when(F.col("state") == "finished", 2).when(F.col("state") == "stalled", 1).otherwise(0).alias("s"), "last")
    return told.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in told.columns if c != "run_id"]), rank).alias("r")).select("run_id", "r.*")
