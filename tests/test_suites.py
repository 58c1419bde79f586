"""Suites, assertions, search and ingest: worked cases and agreement with DuckDB on the small tables."""

import json

import pytest
from pyspark.sql import functions as F

from gradeloom import suite_queries as q
from gradeloom.functions import assertions as a
from gradeloom.functions import scalars as sc
from gradeloom.operators import search as se
from gradeloom.operators import suites as su
from gradeloom.sources import ingest
from gradeloom.streaming.ingest import ingest_runs

SF = "/root/testdata/sf0.001"


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_scalars(spark):
    assert one(spark, sc.slugify(F.lit("  Ab c--D!ü9 ")), sc.truncated(F.lit("é😀ab"), 2), sc.micro_usd(F.lit(0.0000025))) == ["ab-c-d-9", "é😀", 3]
    reasons = [("max_tokens", "x"), (" Safety ", ""), ("end_turn", "  "), ("stop", "x"), (None, None)]
    rows = spark.createDataFrame(reasons, "s string, t string").select(sc.empty_reason(F.col("s"), F.col("t")))
    assert [r[0] for r in rows.collect()] == ["truncated", "content_filter", "blank", None, "blank"]
    rate = lambda m: sc.family_rate(F.lit(m), {"finch-4": 7}, {"finch": 1, "finch-4-tiny": 3})
    models = ("finch-4@v1", "finch-4-20240131", "finch-4-2023-02-28", "finch-4-tiny-x", "finch-9", "anthropic.finch-4", "wren")
    assert one(spark, *[rate(m) for m in models]) == [7, 7, 7, 3, 1, 7, None]
    assert one(spark, sc.component_cost(F.lit(1), F.lit(1)), sc.component_cost(F.lit(0), F.lit(None).cast("int")), sc.component_cost(F.lit(5), F.lit(None).cast("int"))) == [1, 0, None]
    fits = lambda i, **k: sc.matches_test(F.lit(i).cast("string"), F.array(F.lit("a")), **k)
    assert one(spark, fits("x/y", globs=("x*",)), fits(None, globs=("*",)), fits("x", any_tags=("b", "a")), fits("x", any_tags=("b",))) == [True, False, True, False]


def test_assertions(spark):
    blank, text = F.lit("  "), F.lit("Hello wörld 42")
    passed = lambda o: o["passed"]
    got = one(spark, passed(a.contains(text, "hello")), passed(a.icontains_any(text, "x", "WÖRLD")), passed(a.matches(text, r"w\w+ \d+")), a.matches(text, "(")["unevaluable"], a.matches(text, "(?=x)")["unevaluable"],
              passed(a.matches(text, r"\p{L}+ (?P<n>w)")), a.matches(text, r"(a)\1")["unevaluable"], a.matches(text, r"\\1")["unevaluable"])
    assert got == [False, True, True, True, True, True, True, False]
    no = lambda t, **k: a.negated(a.contains(t, "sorry"), t, **k)["passed"]
    assert one(spark, no(text), no(blank), no(blank, has_tool_calls=F.lit(True)), a.negated(a.matches(text, "("), text)["unevaluable"]) == [True, False, True, True]
    assert one(spark, passed(a.at_most(F.lit(None).cast("int"), 3)), a.weighted_mean([]), a.similar(F.array(F.lit(1.0)), F.array(F.lit(-1.0)))["score"]) == [True, 1.0, 0.0]
    yes, bad = (a.contains(text, "Hello"), 1.0), (a.contains(text, "no"), 1.0)
    assert one(spark, a.case_status([yes, bad]), a.case_status([yes, bad], threshold=0.5), a.case_status([bad], expect_fail=F.lit(True)), a.case_status([yes], expect_fail=F.lit(True)), a.case_status([yes, (a.matches(text, "["), 1.0)])) == ["fail", "pass", "xfail", "xpass", "error"]


def test_selection(spark):
    rows = [("r", "p::abc1", "t1", "First", 1), ("r", "p::abc2", "t2", "Second zz", 2), ("r", "q::zz", "p::a", None, 3), ("s", "q::zz", "t2", "zz", 1)]
    cases = spark.createDataFrame(rows, "run_id string, case_key string, test_id string, name string, idx int")
    names = lambda s: sorted((r["run_id"], r["case_key"], r["tier"]) for r in su.select_cases(cases, s).collect())
    assert names("p::abc1") == [("r", "p::abc1", 1)] and names("p::a") == [("r", "p::abc1", 2), ("r", "p::abc2", 2)] and names("t2") == [("r", "p::abc2", 3), ("s", "q::zz", 3)]
    assert names("ZZ") == [("r", "p::abc2", 4), ("s", "q::zz", 4)] and names("none") == [] and names("") == []
    assert [(r["run_id"], r["case_key"]) for r in su.select_any(cases, ["t2", "q::zz"]).collect()] == [("r", "p::abc2"), ("r", "q::zz"), ("s", "q::zz")]
    near = su.suggestions(cases, ["sec"]).where("nth = 1").collect()
    assert {(r["run_id"], r["case_key"], r["score"]) for r in near} == {("r", "p::abc2", 80), ("s", "q::zz", 0)}
    with pytest.raises(ValueError):
        su.sweep(cases, {"x": []})
    assert [r[0] for r in su.missing_last(spark.createDataFrame([(1, None), (2, 5), (3, 4)], "k int, x int"), "x", "k", True).collect()] == [2, 3, 1]
    projects = spark.createDataFrame([("a-b", 1)], "project string, run_count int")
    assert su.typeahead(projects, "  ").count() == 0 and su.typeahead(projects, "A b").first()["rank"] == 0


def test_search(spark):
    docs = spark.createDataFrame([(1, "the quillfern, drosk-mint"), (2, "Quill quill quills"), (3, None)], "doc_id long, text string")
    ids = lambda s: [r[0] for r in se.search(docs, s).orderBy(F.desc("score")).collect()]
    assert ids("qui") == [2, 1] and ids("qui dros") == [1] and ids('" *') == [] and ids("absent") == []
    assert docs.where("doc_id = 1").select(se.snippet(F.col("text"), "dros", 2)).first()[0] == "quillfern drosk"
    assert docs.where("doc_id = 1").select(se.snippet(F.col("text"), "dros", 2, "<", ">")).first()[0] == "quillfern <drosk>"
    hits = lambda q: [r[0] for r in docs.where(se.matches([F.col("text"), F.lit("other words")], q)).collect()]
    assert hits("drosk/min") == [1] and hits("drosk/mi qu") == [1] and hits("mint/drosk") == [] and hits("oth") == [1, 2, 3] and hits("?") == []


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,tags,expect_fail,user_input,__assert\na,"x, y,",known,hi,"[{""contains"": 1}]"\n,,FALSE,,\n')
    rows = ingest.read_tests_table(spark, f"file://{tmp_path}/t.csv").orderBy("place").collect()
    assert [r["expect_fail_reason"] for r in rows] == ["known", None]
    assert [(r["test_id"], r["tags"], r["asserts"], r["expect_fail"], r["vars"]) for r in rows] == [("a", ["x", "y"], '[{"contains": 1}]', True, {"user_input": "hi"}), (None, [], None, False, {"user_input": ""})]
    (tmp_path / "t.json").write_text(json.dumps({"tests": [{"id": "a"}, {"id": "b"}]}))
    (tmp_path / "t.jsonl").write_text('{"id": "c"}\n\n{"id": "d"}\n')
    assert sorted(r["id"] for r in ingest.read_tests_json(spark, f"file://{tmp_path}/t.json").union(ingest.read_tests_json(spark, f"file://{tmp_path}/t.jsonl", lines=True)).collect()) == ["a", "b", "c", "d"]


def test_streaming_ingest_stores_each_run_once(spark, tmp_path):
    source, table = tmp_path / "in", f"file://{tmp_path}/table"
    source.mkdir()
    for n, rows in enumerate([["a", "b"], ["b", "c"]]):
        (source / f"{n}.json").write_text("".join(json.dumps({"run_id": r, "cases": len(r)}) + "\n" for r in rows))
        ingest_runs(spark, f"file://{source}", "run_id string, cases long", table, f"file://{tmp_path}/at").awaitTermination()
    assert sorted(r["run_id"] for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]
