"""Operators on results: worked numbers and truth tables."""

from pyspark.sql import functions as F

from gradeloom.functions import statistics as st


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_statistics(spark):
    low, high = st.wilson(F.lit(46), F.lit(50))
    row = one(spark, low, high, st.mcnemar(F.lit(12), F.lit(3)), st.mcnemar(F.lit(5), F.lit(4)), st.mcnemar(F.lit(0), F.lit(0)), *st.wilson(F.lit(0), F.lit(0)))
    assert [round(x, 4) for x in row] == [0.8116, 0.9685, 4.2667, 0.0, 0.0, 0.0, 0.0]
    ks = one(spark, st.pass_at_k(F.lit(10), F.lit(3), 5), st.pass_at_k(F.lit(5), F.lit(0), 1), st.pass_at_k(F.lit(4), F.lit(1), 1), st.pass_at_k(F.lit(4), F.lit(1), 4), st.pass_at_k(F.lit(3), F.lit(0), 5), st.pass_at_k(F.lit(3), F.lit(1), 5))
    assert [round(x, 4) for x in ks] == [0.9167, 0.0, 0.25, 1.0, 0.0, 1.0]


STATUS = ("pass", "fail", "error", "skip", "xfail", "xpass")
#: Document and stored delta of each base (row) and head (column).
TABLE = {
    "pass": ("U/SP", "NF/NF", "NF/NF", "NF/U", "NF/U", "U/SP"),
    "fail": ("NP/NP", "SF/SF", "SF/SF", "SF/U", "SF/U", "NP/NP"),
    "error": ("NP/NP", "SF/SF", "SF/SF", "SF/U", "SF/U", "NP/NP"),
    "skip": ("NP/U", "SF/U", "SF/U", "SF/U", "SF/U", "NP/U"),
    "xfail": ("NP/U", "SF/U", "SF/U", "SF/U", "SF/U", "NP/U"),
    "xpass": ("U/SP", "NF/NF", "NF/NF", "NF/U", "NF/U", "U/SP"),
}


def test_delta_truth_table(spark):
    short = {"unchanged": "U", "still_passing": "SP", "newly_failing": "NF", "newly_passing": "NP", "still_failing": "SF"}
    rows = spark.createDataFrame([(b, h) for b in STATUS for h in STATUS], "b string, h string")
    for r in rows.select("b", "h", st.document_delta(F.col("b"), F.col("h")).alias("d"), st.delta(F.col("b"), F.col("h")).alias("s")).collect():
        assert f"{short[r['d']]}/{short[r['s']]}" == TABLE[r["b"]][STATUS.index(r["h"])], r


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
