"""Who may see and do what: restrictions and grants of projects and suites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("view", "upload", "manage")


def rank(level: Column) -> Column:
    """1 to 3; levels are words, so their order isn't that of their letters."""
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)


def covering(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Each set (project, suite) with each rule that covers it: of its project, for its suite or for all suites."""
    r = rules.withColumnsRenamed({"project": "_p", "suite": "_s"})
    return sets.join(r, (F.col("project") == F.col("_p")) & (F.col("_s").isNull() | (F.col("suite") == F.col("_s")))).drop("_p", "_s")


def covering_grant(sets: DataFrame, grants: DataFrame) -> DataFrame:
    """Each user's highest level for each set (project, suite)."""
    return covering(sets, grants).groupBy("project", "suite", "user_id").agg(F.max_by("level", rank(F.col("level"))).alias("level"))


def restricted(sets: DataFrame, restrictions: DataFrame) -> DataFrame:
    """sets with `exactly` (a restriction of just this set) and `covered` (that, or one of the whole project)."""
    own = restrictions.select("project", "suite").distinct()
    exact = own.select(F.col("project").alias("_p"), F.col("suite").alias("_s"), F.lit(True).alias("exactly"))
    out = sets.join(exact, (F.col("project") == F.col("_p")) & F.col("suite").eqNullSafe(F.col("_s")), "left").drop("_p", "_s")
    whole = own.where("suite is null").select("project", F.lit(True).alias("_whole"))
    out = out.join(whole, "project", "left")
    no = F.lit(False)
    return out.withColumn("covered", F.coalesce("exactly", "_whole", no)).withColumn("exactly", F.coalesce("exactly", no)).drop("_whole")


def set_access(sets: DataFrame, restrictions: DataFrame, grants: DataFrame, user: str | None, needed: str, *, full: bool = False) -> DataFrame:
    """sets with `allowed`. Open sets allow everyone to view and upload; managing, and everything in restricted sets, takes a
    grant of the user that covers the set. full: an administrator."""
    least = LEVELS.index(needed) + 1
    marked = restricted(sets, restrictions)
    if full:
        return marked.select("project", "suite", F.lit(True).alias("allowed"))
    held = covering_grant(sets, grants.where(F.col("user_id") == user)).select(F.col("project").alias("_p"), F.col("suite").alias("_s"), rank(F.col("level")).alias("held"))
    out = marked.join(held, F.col("project").eqNullSafe(F.col("_p")) & F.col("suite").eqNullSafe(F.col("_s")), "left")
    open_to_all = ~F.col("covered") if least <= 2 else F.lit(False)
    return out.select("project", "suite", (open_to_all | F.coalesce(F.col("held") >= least, F.lit(False))).alias("allowed"))


def restrict(restrictions: DataFrame, project: str, suite: str | None) -> DataFrame:
    """restrictions with that set, once."""
    one = restrictions.sparkSession.createDataFrame([(project, suite)], "project string, suite string")
    return restrictions.select("project", "suite").union(one).distinct()


def unrestrict(restrictions: DataFrame, project: str, suite: str | None) -> DataFrame:
    return restrictions.where(~((F.col("project") == project) & F.col("suite").eqNullSafe(F.lit(suite))))


def grant(grants: DataFrame, project: str, suite: str | None, user: str, level: str) -> DataFrame:
    """grants with that user's level for that set, in place of an earlier one."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level}")
    one = grants.sparkSession.createDataFrame([(project, suite, user, level)], "project string, suite string, user_id string, level string")
    return revoke(grants, project, suite, user).unionByName(one)


def revoke(grants: DataFrame, project: str, suite: str | None, user: str) -> DataFrame:
    return grants.where(~((F.col("project") == project) & F.col("suite").eqNullSafe(F.lit(suite)) & (F.col("user_id") == user)))


def listed(grants: DataFrame, project: str) -> DataFrame:
    """A project's grants: those of the whole project first, then by suite and user."""
    return grants.where(F.col("project") == project).orderBy(F.col("suite").asc_nulls_first(), "user_id")


def newest_rule(log: DataFrame) -> DataFrame:
    """Of a log of grants (project, suite, user_id, level, set_at), the ones in force: the newest of each set and user; a null
    level takes the grant away."""
    newest = Window.partitionBy("project", "suite", "user_id").orderBy(F.desc("set_at"))
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1 and level is not null").drop("_n", "set_at")
