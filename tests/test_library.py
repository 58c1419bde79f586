"""Documents, suite files, templates, JSON, access, baselines, fallbacks and reports on small worked cases."""

import json
import re

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import assertions as a
from gradeloom.functions import json_checks as jc
from gradeloom.functions import scalars as sc
from gradeloom.functions import templates as tp
from gradeloom.operators import access, baselines, cache, diffs, fallbacks, results, runs, summaries
from gradeloom.sources import callables, documents, suite_files
from gradeloom.streaming import upkeep

RUN = "run_id string, project string, suite string, created_at long, branch string"


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_json(spark):
    texts = [' {"a": [1, {}]}', "{'a': 1}", "NaN", "x [1, 2] y", "{} {}", None, "say {\"k\": \"}\"}", "3"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", jc.is_json(F.col("t")).alias("j"), jc.embedded_json(F.col("t")).alias("e")).orderBy("i").collect()
    assert [r["j"] for r in got] == [True, False, False, False, False, False, False, True]
    assert [r["e"] for r in got] == ['{"a":[1,{}]}', None, None, "[1,2]", "{}", None, None, "3"]
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"$ref": "#/$defs/n"}, "b": {"enum": ["x", 1]}}, "additionalProperties": False, "$defs": {"n": {"type": "array", "items": {"type": ["integer", "object"]}, "maxItems": 2}}}
    errors = lambda v, s=schema: sorted(jc.schema_errors(v, s))
    assert errors({"a": [1, {}]}) == [] and errors({"a": [1], "b": 1.0}) == []
    assert [p for p, _ in errors({"a": ["x", 2, 3], "b": "y", "c": 0})] == ["/a", "/a/0", "/b", "/c"] and [p for p, _ in errors({})] == [""]
    assert errors(5, {"anyOf": [{"type": "string"}, {"minimum": 4}]}) == [] and errors("ab", {"oneOf": [{"minLength": 1}, {"maxLength": 3}]}) and errors([1, 1], {"uniqueItems": True}) and errors(4, {"not": {"multipleOf": 2}})
    broken = one(spark, jc.contains_json(F.lit("{}"), {"$ref": "http://x"}).alias("v"))[0]
    assert broken["unevaluable"] and not one(spark, a.negated(jc.as_outcome(jc.contains_json(F.lit("{}"), {"$ref": "http://x"})), F.lit("{}"))["passed"])[0]
    calls = F.from_json(F.lit(json.dumps([{"name": "find", "arguments": '{"city": "Oslo", "n": 2}'}, {"name": "find", "arguments": "{}"}])), "array<struct<name: string, arguments: string>>")
    held = lambda **k: jc.tool_call(calls, "find", **k)["passed"]
    assert one(spark, held(arguments={"n": 2}), held(arguments={"n": 3}), held(schema={"required": ["city"]}), jc.tool_call(calls, "find", schema={"type": 5})["unevaluable"], a.called(calls, "look")["passed"]) == [True, False, True, True, False]
    assert one(spark, jc.equals_json(F.lit('{"b": 1, "a": 2}'), {"a": 2, "b": 1})["passed"], jc.canonical_json(F.lit('{"b": 1.0, "a": "é"}')), jc.json_digest(F.lit("{ }")) == jc.json_digest(F.lit("{}"))) == [True, '{"a":"é","b":1.0}', True]
    keys = [jc.cache_key(F.lit('{"m": 1}'), F.lit(0), F.lit(p).cast("string"), F.lit(c).cast("string")) for p, c in ((None, None), ("", None), ("a", "b"), ("ab", None))]
    assert len(set(one(spark, *keys))) == 4
    members = [{"kind": "contains", "weight": 1, "criteria": "x"}, {"kind": "length", "weight": 2, "criteria": {"max": 3}}]
    digest = lambda m, t=None, e=False: jc.assert_digest(F.lit(json.dumps(m)), F.lit(t).cast("double"), F.lit(e))
    same, turned, other, flagged, none = one(spark, digest(members), digest(members[::-1]), digest(members, 0.5), digest(members, None, True), digest([{**members[0], "criteria": None}]))
    assert same == turned and len({same, other, flagged}) == 3 and none is None
    views = [tuple(r["v"]) for t in ('{"type": "regex", "value": "a+", "negate": true}', '{"min": 1, "max": 9}', "[1]", '"x"', '{"threshold": 0.5}', "null", '{"a": {}}') for r in spark.range(1).select(jc.criteria_view(F.lit(t)).alias("v")).collect()]
    assert views == [(None, True, "scalar", "a+"), (None, False, "pairs", "min: 1, max: 9"), (None, False, "json", "[1]"), (None, False, "scalar", "x"), (0.5, False, "none", None), (None, None, None, None), (None, False, "json", '{"a":{}}')]


def test_json_diff(spark):
    docs = lambda t: spark.createDataFrame([("k", t)], "k string, d string")
    got = diffs.json_diff(docs('{"a": {"b": [1, 2]}, "c": null, "d": []}'), docs('{"a": {"b": [1, "2", 3]}, "d": {}, "e": 1}'), "k", "d").orderBy("path").collect()
    assert [(r["path"], r["kind"]) for r in got] == [("a.b.1", "changed"), ("a.b.2", "added"), ("c", "removed"), ("d", "changed"), ("e", "added")]


def test_line_diff(spark):
    base, head = "\n".join("abcdefgh"), "\n".join("abcdXfgh")
    lines, none, cut = one(spark, diffs.line_diff(F.lit(base), F.lit(head), context=1), diffs.line_diff(F.lit("a"), F.lit("a")), diffs.line_diff(F.lit(None).cast("string"), F.lit("x\n" * 900)))
    assert lines == ["@@ -4,3 +4,3 @@", " d", "-e", "+X", " f"] and none == [] and len(cut) == 401


def test_templates(spark):
    holds = lambda e: tuple(one(spark, tp.expression_holds(F.lit('{"n": [1, 2]}'), F.lit('{"city": "Oslo", "k": 3}'), e))[0][1:])
    assert holds("output_json.n | length == 2 and vars.city in ['Oslo']") == (True, False) and holds("k > 5 or city | lower == 'x'") == (False, False)
    assert holds("missing is defined") == (False, False) and holds("missing == 1") == (False, True) and holds("import os") == (False, True) and holds("__import__('os')") == (False, True)
    text, error = one(spark, tp.rendered(F.lit("{{ city | upper }}-{{ k + 1 }} {{ none | default('z') }}"), F.lit('{"city": "Oslo", "k": 3}')))[0]
    assert (text, error) == ("OSLO-4 z", None) and one(spark, tp.rendered(F.lit("{{ nope }}"), F.lit("{}")))[0]["error"].startswith("render_failed")
    assert one(spark, tp.extracted(F.lit('{"choices": [{"text": "hi"}]}'), "response.choices[0].text"), tp.extracted(F.lit('{"a": {"b": 1}}'), "response.a"), tp.extracted(F.lit("{}"), "response.x")) == ["hi", '{"b":1}', None]
    assert tp.with_environment({"u": ["${env:HOST}/${env:NO:-x}"]}, {"HOST": "h"}) == {"u": ["h/x"]}
    with pytest.raises(KeyError):
        tp.with_environment("${env:NO}", {})
    clock = F.to_timestamp(F.lit("2030-02-03T04:05:06Z"))
    assert one(spark, tp.now(clock, "%Y/%m/%d at %H:%M"), tp.now(clock)) == ["2030/02/03 at 04:05", "2030-02-03T04:05:06+00:00"]
    with pytest.raises(ValueError):
        tp.date_pattern("%Q")
    assert re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", one(spark, tp.seeded_uuid(F.lit("s")))[0])


def test_assertion_rules(spark):
    yes, no = (a.contains(F.lit("ab"), "a"), 1.0), (a.contains(F.lit("ab"), "z"), 1.0)
    assert one(spark, a.can_change([yes], 1.0), a.can_change([no], 1.0), a.can_change([no], 1.0, 0.5), a.can_change([no, no], 1.0, 0.5), a.can_change([yes], 0.0)) == [True, False, True, False, False]
    results_ = lambda *s: F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(st).alias("status"), F.lit(r).cast("string").alias("reason")) for k, st, r in s])
    assert one(spark, a.error_message(results_(("regex", "error", " bad "), ("exec", "error", None))), a.error_message(results_(("exec", "error", ""))), a.error_message(results_(("exec", "pass", "x")))) == ["regex assertion errored: bad (and 1 more errored)", "exec assertion errored", None]
    assert a.desugared({"type": "not-regex", "value": "x"}) == {"type": "regex", "value": "x", "negate": True} and a.desugared({"type": "regex"}) == {"type": "regex"}
    usage = {"input": F.lit(5), "output": F.lit(None).cast("int"), "cache_read": F.lit(7)}
    assert one(spark, a.total_tokens(usage), a.total_tokens(usage, True), a.total_tokens({"input": F.lit(None), "output": F.lit(None)})) == [5, 12, None]
    assert one(spark, a.rubric(F.lit(False), F.lit(0.8), 0.7)["passed"], a.rubric(F.lit(None).cast("boolean"), F.lit(None).cast("double"))["unevaluable"], a.checked(F.lit(None).cast("boolean"))["unevaluable"]) == [True, True, True]
    blank = lambda **k: a.negated(a.contains(F.lit("{}"), "x"), F.lit("{}"), **k)["passed"]
    assert one(spark, blank(), blank(is_json=F.lit(True)), blank(is_json=F.lit(True), reason=F.lit(None).cast("string")), blank(is_json=F.lit(True), budget=True)) == [True, False, True, True]
    base, head = (F.from_json(F.lit(json.dumps([{"kind": k, "passed": p, "score": 1} for k, p in s])), "array<struct<kind: string, passed: boolean, score: double>>") for s in ([("a", True), ("b", True), ("b", True)], [("a", False), ("b", False)]))
    assert [f["kind"] for f in one(spark, diffs.assert_flips(base, head))[0]] == ["a"] and len(one(spark, diffs.assert_flips(base, base))[0]) == 0


def test_reasons_and_views(spark):
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    assert one(spark, sc.most_specific_reason(words("blank", "truncated")), sc.most_specific_reason(words("odd", "odder")), sc.most_specific_error(words("grader_missing", "exec_failed")), sc.most_specific_error(words("assert_failed", "grader_missing")), sc.most_specific_error(F.array().cast("array<string>"))) == ["truncated", "odd", "exec_failed", "grader_missing", None]
    assert one(spark, sc.stored_in_cache(F.lit("truncated"), "reproducible"), sc.stored_in_cache(F.lit("blank"), "reproducible"), sc.stored_in_cache(F.lit("blank"), "always"), sc.stored_in_cache(F.lit(None).cast("string"))) == [True, False, True, True]
    assert one(spark, sc.is_infrastructure(F.lit("provider_x")), sc.is_infrastructure(F.lit("exec_failed")), sc.is_infrastructure(F.lit("grader_failed")), sc.is_infrastructure(F.lit(None).cast("string"))) == [True, True, False, False]
    view = lambda t: tuple(one(spark, sc.request_view(F.lit(t)))[0])
    assert view('{"transport": "http", "url": "https://h/x", "body": {"model": "m"}}') == ("http", "POST https://h/x", "m") and view('{"transport": "exec", "command": "go", "args": ["-a", "b"]}') == ("exec", "go -a b", None) and view('{"transport": "http"}')[0] == "other"
    blocks = F.from_json(F.lit('[{"type": "thinking", "text": "x"}, {"type": "text", "text": "a"}, {"type": "text", "text": "b"}]'), "array<struct<type: string, text: string>>")
    turns = F.from_json(F.lit('[{"text": "q", "calls": []}, {"text": "", "calls": [{"name": "f", "arguments": "{}"}]}]'), "array<struct<text: string, calls: array<struct<name: string, arguments: string>>>>")
    assert one(spark, sc.message_text(blocks), sc.flat_prompt(turns), sc.case_key(F.lit("openai"), F.lit("p-a"), F.lit("t1"), F.lit(1))) == ["ab", "q\nf {}", "ab2c90477b3b9800"]
    roles = lambda *r: F.array(*[F.struct(F.lit(x).alias("role"), F.lit(x).alias("text")) for x in r])
    order = lambda c: [m["role"] for m in one(spark, c)[0]]
    none = F.lit(None).cast("int")
    assert order(sc.spliced(roles("system", "user"), roles("h"), none)) == ["system", "h", "user"] and order(sc.spliced(roles("system"), roles("h"), none)) == ["system", "h"] and order(sc.spliced(roles("user", "user"), roles("h"), F.lit(2))) == ["user", "user", "h"]


def test_access_of_null_projects_and_levels(spark):
    sets = spark.createDataFrame([("p", "a"), ("p", "b"), (None, None)], "project string, suite string")
    grants = spark.createDataFrame([("p", "a", "u", "manage"), ("p", None, "u", "view")], "project string, suite string, user_id string, level string")
    rules = spark.createDataFrame([("p", None)], "project string, suite string")
    assert {(r["suite"], r["level"]) for r in access.covering_grant(sets, grants).collect()} == {("a", "manage"), ("b", "view")}
    allowed = lambda user, level, **k: {r["suite"] for r in access.set_access(sets, rules, grants, user, level, **k).where("allowed").collect()}
    assert allowed("u", "upload") == {"a", None} and allowed("u", "view") == {"a", "b", None} and allowed("x", "view") == {None} and allowed("x", "manage") == set() and allowed(None, "manage", full=True) == {"a", "b", None}
    again = access.grant(grants, "p", "a", "u", "view")
    assert again.count() == 2 and {r["level"] for r in again.collect()} == {"view"} and access.listed(again, "p").first()["suite"] is None and access.revoke(again, "p", None, "u").count() == 1
    log = spark.createDataFrame([("p", None, "u", "view", 1), ("p", None, "u", None, 2), ("p", "a", "u", "upload", 1)], "project string, suite string, user_id string, level string, set_at long")
    assert [r["suite"] for r in access.newest_rule(log).collect()] == ["a"]


def test_baselines_of_runs_without_a_project(spark):
    all_runs = spark.createDataFrame([("r1", None, None, 1, "main"), ("r2", None, None, 2, None), ("r3", "p", "a", 2, "main"), ("r4", "p", "a", 2, "main")], RUN)
    heads = all_runs.where("run_id in ('r2', 'r4')")
    assert {(r[0], r[1]) for r in baselines.earlier_runs(heads, all_runs).collect()} == {("r2", "r1"), ("r4", "r3")}
    pins = spark.createDataFrame([], "project string, suite string, run_id string, branch string, set_at long")
    pins = baselines.put_pin(pins, all_runs, "p", "a", run_id="r3", set_at=1)
    assert [r["run_id"] for r in baselines.put_pin(pins, all_runs, "p", "a", run_id="r1", set_at=2).collect()] == ["r3"]
    pins = baselines.put_pin(pins, all_runs, "p", "a", branch="main", set_at=2)
    assert [(r["run_id"], r["branch"]) for r in pins.collect()] == [(None, "main")] and baselines.drop_pin(pins, "p", "a").count() == 0
    kinds = {r["head_id"]: r["kind"] for r in baselines.resolve(heads, all_runs, "server:baseline", pins).collect()}
    assert kinds == {"r2": "absent", "r4": "branch"}
    assert baselines.effective_reference("none", "main", True) is None and baselines.effective_reference(None, "main", False) == "branch:main" and baselines.effective_reference("x", None, True) == "x"
    marked = results.expired_runs(all_runs, 10, 1, pins).where("not kept").collect()
    assert marked == [] and results.latest_runs(all_runs).count() == 1


def test_gate_codes(spark):
    kinds = "g string, status string, error_class string, answered_by string"
    rows = [("ok", "pass", None, ""), ("ok", "xfail", None, ""), ("skips", "skip", None, "p"), ("fell", "pass", None, "p"), ("fell", "skip", None, ""), ("red", "xpass", None, ""), ("suite", "error", "render_failed", ""), ("harness", "error", None, ""), ("harness", "error", "render_failed", ""), ("moved", "skip", None, ""), ("moved", "pass", None, "")]
    compared = spark.createDataFrame([("moved", "pass", "skip"), ("ok", "fail", "pass")], "g string, base_status string, head_status string")
    codes = lambda **k: {r["g"]: r["exit_code"] for r in results.gate(compared, spark.createDataFrame(rows, kinds), by="g", **k).collect()}
    assert codes() == {"ok": 0, "skips": 2, "fell": 2, "red": 1, "suite": 2, "harness": 3, "moved": 1}
    assert codes(baseline_unresolved=True)["ok"] == 2 and set(codes(share_failed=True).values()) == {3}


def test_fallback_chains(spark):
    words = lambda *w: F.array(*[F.lit(x) for x in w]).cast("array<string>")
    assert one(spark, fallbacks.chain_of(F.lit("a"), words("b", "a", "b", "c", "d"), words(), words("c"), words("a", "b", "c"))) == [["b"]]
    attempts = spark.createDataFrame([("x", 0, "a", "refusal", None), ("x", 1, "b", None, "provider_request"), ("x", 2, "c", None, None), ("y", 0, "a", "refusal", None), ("y", 1, "b", None, None), ("z", 0, "a", "refusal", None)], "cell string, link int, provider_id string, empty_reason string, error_class string")
    got = {r["cell"]: (r["provider_id"], r["passed_over"], r["answered_by"]) for r in fallbacks.settled(attempts, "cell").collect()}
    assert got == {"x": ("a", [], None), "y": ("b", ["a"], "b"), "z": ("a", [], None)}
    providers = [{"id": "a"}, {"id": "f", "fallback_only": True}, {"id": "e", "embeddings": True}]
    why = lambda asked, matched=1: (fallbacks.empty_run(asked, providers, ["t1"], matched) or {}).get("why")
    assert why(["a"]) is None and why(["q"]) == "unknown_providers" and why(["a", "f"]) == "fallback_only" and why(["e"]) == "embeddings" and why([], 0) == "filtered_out"


DOCUMENT = {
    "run_id": "r1", "schema_version": 4, "project": "p", "suite": "s", "started_at": "2030-01-01T00:00:00Z", "finished_at": "2030-01-01T00:00:30Z", "git": {"branch": "main"}, "filters": {"tags": ["nightly"]}, "origin": {"note": " "}, "description": "d",
    "cases": [
        {"case_key": "k1", "cell": {"provider_id": "a", "test_id": "t", "repeat": 0}, "status": "pass", "score": 1.0, "output": "é" * 400, "usage": {"input_tokens": 5, "output_tokens": 2, "cache_read_tokens": 7}, "cost_usd": 0.0000025, "cached": True, "asserts": [{"kind": "contains", "status": "pass", "cost_usd": 0.001}]},
        {"case_key": "k1", "cell": {"provider_id": "a", "test_id": "t", "repeat": 0}, "status": "fail"},
        {"case_key": "k2", "name": "a<b", "cell": {"provider_id": "a", "test_id": "u", "repeat": 0}, "status": "xpass", "cached": False, "attempts": 2, "empty_reason": "blank", "answered_by_provider_id": "b"},
        {"case_key": "k3", "cell": {"provider_id": "a", "test_id": "v", "repeat": 0}, "status": "skip", "answered_by_provider_id": "b", "cost_usd": -1.0},
    ],
}


def test_documents(spark, tmp_path):
    for name, text in (("one", json.dumps(DOCUMENT)), ("two", json.dumps({**DOCUMENT, "run_id": "r2", "schema_version": 1, "finished_at": "2031-01-01T00:00:00Z"})), ("bad", "{nope")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(text)
    store = documents.local_store(spark, f"file://{tmp_path}")
    assert [r["run_id"] for r in store.collect()] == ["r2", "r1"] and [r["run_id"] for r in documents.accepted(store).collect()] == ["r1"]
    own = documents.accepted(store)
    cases = documents.case_rows(own).orderBy("idx").collect()
    assert [(r["case_key"], r["idx"], r["status"]) for r in cases] == [("k1", 0, "pass"), ("k2", 2, "xpass"), ("k3", 3, "skip")]
    assert len(cases[0]["output_preview"]) == 300 and (cases[0]["cost_microusd"], cases[0]["grader_cost_microusd"], cases[1]["empty_reason"], cases[0]["empty_reason"]) == (3, 1000, "blank", "") and cases[0]["asserts"][0]["passed"]
    run = documents.run_rows(own).first()
    assert (run["duration_ms"], run["description"], run["tags"], run["branch"]) == (30_000, None, ["nightly"], "main")
    s = summaries.summarise(documents.case_rows(own), "run_id").first()
    assert (s["total"], s["n_pass"], s["n_xpass"], s["n_skip"], s["prompt_tokens"], s["cost_microusd"], s["cache_savings_microusd"], s["grader_cost_microusd"], s["cache_hits"], s["cache_misses"], s["retried_cases"], s["fallback_cases"]) == (3, 1, 1, 1, 12, 3, 3, 1000, 1, 2, 1, 1)
    assert summaries.empty_map(documents.case_rows(own), "run_id").first()["empty_counts"] == {"blank": 1} and summaries.assert_labels(documents.case_rows(own), "run_id").first()["labels"] == ["contains"]
    xml = documents.junit(documents.case_rows(own)).first()["junit"]
    assert 'tests="3" failures="1" errors="0"' in xml and 'name="a&lt;b"' in xml and "<skipped></skipped>" in xml and documents.junit(documents.case_rows(own), True).first()["junit"].count("<testcase") == 1
    text = documents.markdown(summaries.summarise(documents.case_rows(own), "run_id"), documents.case_rows(own)).first()["markdown"]
    assert "| a<b | xpass |" in text and documents.text_table(documents.case_rows(own), True).count() == 1
    documents.write_json_lines(documents.case_rows(own), f"file://{tmp_path}/out", True)
    assert spark.read.json(f"file://{tmp_path}/out").count() == 1 and documents.persisted(own, f"file://{tmp_path}/kept") == "r1" and spark.read.text(f"file://{tmp_path}/kept/latest").first()[0] == "r1"
    line = summaries.outputs_text({"pass_rate": "50.0", "note": "a\nb"})
    assert line == "pass-rate=50.0\nnote=a b\n"


def test_suite_files(spark, tmp_path):
    (tmp_path / "tests").mkdir()
    (tmp_path / "tests/b.csv").write_text("id,tags,question,threshold,expect_fail\nx,\"m, n\",why,0.5,known\n,,how,bad,\n")
    (tmp_path / "tests/a.yaml").write_text("tests:\n  - id: one\n    vars: {q: !file data.txt, n: 3}\n    matrix: {tone: [dry, loud], len: [1]}\n    assert: [{type: is-json}]\n  - tags: [t]\n")
    (tmp_path / "tests/c.jsonl").write_text('{"vars": {"q": "z"}}\n\n')
    (tmp_path / "data.txt").write_text("content")
    (tmp_path / "base.yaml").write_text("defaults: {assert: [{type: latency}], vars: {q: d, z: 1}}\nname: low\n")
    (tmp_path / "suite.yaml").write_text("extends: base.yaml\nname: high\ndefaults: {tags: [all], assert: [{type: cost}], threshold: 0.9}\ntests: ['file://tests/*', {vars: {q: inline}}]\n")
    suite = suite_files.load(str(tmp_path / "suite.yaml"))
    assert suite["name"] == "high" and [x["type"] for x in suite["defaults"]["assert"]] == ["latency", "cost"]
    rows = {r["test_id"]: r for r in suite_files.expanded(spark, suite, str(tmp_path), {}).collect()}
    assert set(rows) == {"inline/0", "one[len=1,tone=dry]", "one[len=1,tone=loud]", "a/1", "x", "b/1", "c/0"}
    r = rows["one[len=1,tone=dry]"]
    assert r["vars"] == {"z": "1", "q": '{"$file": "data.txt"}', "n": "3", "len": "1", "tone": "dry"} and [x["type"] for x in json.loads(r["asserts"])] == ["latency", "cost", "is-json"]
    assert (rows["x"]["tags"], rows["x"]["threshold"], rows["x"]["expect_fail_reason"], rows["b/1"]["threshold"], rows["b/1"]["vars"]) == (["m", "n", "all"], 0.5, "known", 0.9, {"z": "1", "q": "d", "question": "how"})
    assert suite_files.with_files({"v": {"$file": "data.txt"}}, str(tmp_path)) == {"v": "content"}
    salt = lambda: suite_files.digest_salt("digest:tests/{{ f }}", {"f": "*.csv"}, str(tmp_path))
    before = salt()
    (tmp_path / "tests/b.csv").rename(tmp_path / "tests/b2.csv")
    assert before != salt() and suite_files.digest_salt("plain", {}, "") == "plain"
    for bad in ("file://../*", "../*"):
        (tmp_path.parent / "outside.txt").write_text("")
        with pytest.raises(ValueError):
            suite_files.within(bad, str(tmp_path))
    (tmp_path / "loop.yaml").write_text("extends: loop.yaml\n")
    with pytest.raises(ValueError):
        suite_files.load(str(tmp_path / "loop.yaml"))
    with pytest.raises(Exception, match="an axis has no values"):
        suite_files.swept(suite_files.inline_tests(spark, [{"matrix": {"a": []}}])).collect()
    assert suite_files.imported({"prompts": ["p {{x}}"], "providers": ["m"], "tests": [{"assert": [{"type": "contains", "value": "y"}]}]})["tests"][0]["id"] == "inline/0"
    assert suite_files.provenance(str(tmp_path), {}, "off") == {} and suite_files.provenance(str(tmp_path), {"GITHUB_ACTIONS": "true"}, "anonymous")["ci"]["provider"] == "github"


def test_callables(spark):
    own = callables.Registry()
    own.provider("echo")(lambda request: {"output": request["q"].upper()} if request.get("q") else 1 / 0)
    own.checker("short")(lambda output, variables: {"pass": len(output) < variables["n"], "score": 0.5, "reason": "len"})
    own.generator("two")(lambda: [{"id": "g1"}, {"vars": {"a": "b"}}])
    got = own.answers(spark.createDataFrame([(1, '{"q": "hi"}'), (2, "{}")], "k int, request string"), "echo").orderBy("k").collect()
    assert [(r["output"], r["error_class"]) for r in got] == [("HI", None), (None, "exec_failed")]
    checked = own.checks(spark.createDataFrame([(1, "abc", '{"n": 5}'), (2, "abc", "{}")], "k int, output_text string, vars string"), "short").orderBy("k").collect()
    assert [(r["check_passed"], r["check_score"]) for r in checked] == [(True, 0.5), (None, None)]
    tests = own.tests(spark, "two", {"tags": ["x"]}).orderBy("test_id").collect()
    assert [(r["test_id"], r["tags"]) for r in tests] == [("g1", ["x"]), ("inline/1", ["x"])]
    assert one(spark, own.filtered(F.lit("Ab c!"), ("slugify",), ("truncate", 2))) == ["ab"]


def test_cache_files_and_cursors(spark, tmp_path):
    (tmp_path / "c/d").mkdir(parents=True)
    for name, text in (("c/x", "12"), ("c/d/y", "345")):
        (tmp_path / name).write_text(text)
    folder = f"file://{tmp_path}/c"
    assert cache.disk_entries(spark, folder, 1).count() == 1 and tuple(cache.disk_stats(spark, folder).first()) == (2, 5) and cache.disk_purge(spark, folder, 1) == 0 and cache.disk_purge(spark, folder) == 2
    assert cache.from_cursor(cache.cursor_of("a:b", "sha256:x")) == ("a:b", "sha256:x") and cache.from_cursor(cache.cursor_of(5, "k:1")) == (5, "k:1") and cache.from_cursor("t:zz:k") is None and cache.from_cursor("no") is None
    entry = "entry_key long, size long, last_access_at long"
    gone = results.evict_lru(spark.createDataFrame([(1, 5, None), (2, 5, 9), (3, 5, 9), (4, 5, 12)], entry), 9)
    assert {r["entry_key"] for r in gone.collect()} == {1, 2, 3} and results.evict_lru(spark.createDataFrame([(1, 5, None)], entry), 0).count() == 1


def test_indexing_again(spark):
    entries = spark.createDataFrame([("a", None, None, 1), ("b", 7, "old", 2)], "entry_key string, indexed_at long, kind string, created_at long")
    bodies = spark.createDataFrame([("a", '{"kind": "judge"}'), ("b", '{"kind": "new"}')], "entry_key string, body string")
    assert {(r["entry_key"], r["indexed_at"], r["kind"]) for r in cache.reindexed(entries, bodies, 99).collect()} == {("a", 99, "judge"), ("b", 7, "old")}
    kind = lambda *c: one(spark, cache.inferred_kind(*[F.lit(x).cast("string") for x in c]))[0]
    assert [kind("x", None, None, None, None, None), kind(None, '{"kind": "rubric"}', None, None, None, None), kind(None, None, None, '{"dims": 3}', None, None), kind(None, None, None, "hi", "1", None), kind(None, None, None, "hi", None, None)] == ["x", "judge", "embedding", "provider", None]


def test_upkeep_and_snapshots(spark, tmp_path):
    entry = "entry_key long, size long, created_at long, last_access_at long, kind string, model string, empty_reason string"
    entries = spark.createDataFrame([(1, 1, 5, 5, "a", "m", ""), (2, 1, 95, 95, "a", "m", "blank"), (3, 1, 95, 95, "a", "m", "")], entry)
    (tmp_path / "ticks").mkdir()
    (tmp_path / "ticks/0.json").write_text('{"now": 100}\n')
    ticks, kept = spark.readStream.schema("now long").json(f"file://{tmp_path}/ticks"), []
    upkeep.upkeep(spark, ticks, lambda: entries, lambda df: kept.append([r["entry_key"] for r in df.collect()]), f"file://{tmp_path}/at", max_age=50, empty_reasons=("blank",)).awaitTermination()
    assert kept == [[3]]
    moment, reads = [0.0], []
    snapshot = upkeep.Snapshot(lambda: reads.append(1) or spark.range(3), 30, lambda: moment[0])
    assert snapshot.get().count() == snapshot.get().count() == 3 and len(reads) == 1
    moment[0] = 31.0
    assert snapshot.get().count() == 3 and len(reads) == 2


def test_page_sizes_and_wildcards(spark):
    assert [runs.page_size(x) for x in (None, 0, 7, 999)] == [50, 1, 7, 200] and runs.page_size(None, "history") == 20 and runs.page_size(999, "matrix") == 500
    texts = spark.createDataFrame([("a\\b",), ("axb",)], "output_text string").withColumn("name", F.lit(None).cast("string"))
    assert [r[0] for r in texts.where(runs.case_filter(text="A\\B")).select("output_text").collect()] == ["a\\b"] and texts.where(runs.case_filter(text="a_b")).count() == 2
