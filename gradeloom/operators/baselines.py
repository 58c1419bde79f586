"""What a run is compared with: pins of suites, earlier runs, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Beginnings of references.
SERVER, SERVER_BRANCH, LOCAL_BRANCH, NONE = "server:baseline", "server:branch:", "branch:", "none"


def effective_reference(asked: str | None, suite_branch: str | None, server: bool) -> str | None:
    """The reference in force: the one asked for (`none` switches off), else the suite's branch, on the server if there is one."""
    if asked is not None:
        return None if asked == NONE else asked
    return None if suite_branch is None else f"{SERVER_BRANCH if server else LOCAL_BRANCH}{suite_branch}"


def put_pin(pins: DataFrame, runs: DataFrame, project: str, suite: str, *, run_id: str | None = None, branch: str | None = None, set_at: int) -> DataFrame:
    """pins with this one in place of the suite's earlier one. A pinned run has to be a (visible) run of the suite, else pins stay
    as they are; a pinned branch needs no run yet."""
    if (run_id is None) == (branch is None):
        raise ValueError("pin a run or a branch")
    spark = pins.sparkSession
    new = spark.createDataFrame([(project, suite, run_id, branch, set_at)], "project string, suite string, run_id string, branch string, set_at long")
    if run_id is not None:
        there = runs.select(F.col("run_id"), F.col("project").alias("_p"), F.col("suite").alias("_s")).distinct()
        new = new.join(there, "run_id").where(F.col("project").eqNullSafe(F.col("_p")) & F.col("suite").eqNullSafe(F.col("_s"))).select(*pins.columns)
    newest = Window.partitionBy("project", "suite").orderBy(F.desc("_new"), F.desc("set_at"))
    both = pins.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_new")


def drop_pin(pins: DataFrame, project: str, suite: str) -> DataFrame:
    return pins.where(~((F.col("project") == project) & (F.col("suite") == suite)))


def pins_with_runs(pins: DataFrame, visible: DataFrame) -> DataFrame:
    """Pins with when their run was made. A pinned run that isn't visible hides its pin; a pinned branch stays."""
    made = visible.select("run_id", F.col("created_at").alias("run_created_at"))
    return pins.join(made, "run_id", "left").where(F.col("run_id").isNull() | F.col("run_created_at").isNotNull()).select("project", "suite", "run_id", "branch", "set_at", "run_created_at")


def earlier_runs(heads: DataFrame, runs: DataFrame, branch: str | None = None, most: int = 1) -> DataFrame:
    """For each head run (run_id, project, suite) the `most` newest other runs of its suite (on the branch, if given), newest
    first: head_id, run_id, nth. Null projects and suites are alike."""
    own = runs if branch is None else runs.where(F.col("branch") == branch)
    h = heads.select(F.col("run_id").alias("head_id"), F.col("project").alias("_p"), F.col("suite").alias("_s"))
    met = own.join(h, F.col("project").eqNullSafe(F.col("_p")) & F.col("suite").eqNullSafe(F.col("_s"))).where("run_id <> head_id")
    newest = Window.partitionBy("head_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    return met.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= most).select("head_id", "run_id", "nth")


def resolve(heads: DataFrame, runs: DataFrame, reference: str, pins: DataFrame | None = None, lookback: int = 20) -> DataFrame:
    """For each head run: kind (run, branch, absent or failed), base_run_id (of a run), branch (of a composite of its runs).
    absent: nothing to compare with yet; failed: the reference can't be right, so a gate has to stop."""
    h = heads.select(F.col("run_id").alias("head_id"), "project", "suite")
    out = lambda df, kind, base=F.lit(None), on=F.lit(None): df.select("head_id", kind.alias("kind"), base.cast("string").alias("base_run_id"), on.cast("string").alias("branch"))
    failed = out(h, F.lit("failed"))
    if reference == "latest":
        found = earlier_runs(heads, runs)
        both = h.join(found, "head_id", "left")
        return out(both, F.when(F.col("run_id").isNull(), "absent").otherwise("run"), F.col("run_id"))
    for start in (SERVER_BRANCH, LOCAL_BRANCH):
        if reference.startswith(start):
            branch = reference[len(start) :]
            if not branch:
                return failed
            found = earlier_runs(heads, runs, branch, lookback).select("head_id").distinct().withColumn("_there", F.lit(True))
            there = F.col("_there").isNotNull()
            return out(h.join(found, "head_id", "left"), F.when(there, "branch").otherwise("absent"), on=F.when(there, F.lit(branch)))
    if reference == SERVER:
        if pins is None:
            raise ValueError("server:baseline needs the pins")
        own = pins.select("project", "suite", F.col("run_id").alias("pinned"), F.col("branch").alias("on"))
        both = h.join(own, ["project", "suite"], "left")
        made = runs.select(F.col("run_id").alias("pinned"), F.lit(True).alias("_there"))
        both = both.join(made, "pinned", "left")
        kind = F.when(F.col("on").isNotNull(), "branch").when(F.col("_there").isNotNull(), "run").otherwise("absent")
        return out(both, kind, F.when(F.col("_there").isNotNull(), F.col("pinned")), F.col("on"))
    if reference.startswith("server:"):
        return failed
    named = runs.where(F.col("run_id") == reference).select(F.col("run_id").alias("named"), F.col("project").alias("_p"), F.col("suite").alias("_s")).limit(1)
    met = h.join(F.broadcast(named), F.lit(True), "left")  # one row at most
    same = F.col("project").eqNullSafe(F.col("_p")) & F.col("suite").eqNullSafe(F.col("_s")) & F.col("named").isNotNull()
    return out(met, F.when(same, "run").otherwise("failed"), F.when(same, F.col("named")))
