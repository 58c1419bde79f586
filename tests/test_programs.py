"""Programs that crash, hang, say too much or what is no JSON, and answers that stay with their requests."""

import json

import pytest

from gradeloom.sources import programs

SOURCE = """
import json, os, sys, time
for line in sys.stdin:
    asked = json.loads(line)
    do = asked.get("prompt") or asked.get("config", {}).get("do")
    if do == "crash":
        sys.stderr.write("x" * 5000 + "bang")
        os._exit(7)
    if do == "hang":
        time.sleep(60)
    if do == "late":
        print("{}")
    if do == "long":
        print("z" * 100000, flush=True)
    elif do == "garbage":
        print("[1, 2", flush=True)
    elif do == "list":
        print("[1, 2]", flush=True)
    elif do == "bare":
        print("{}", flush=True)
    elif do == "big":
        print(json.dumps({"output": len(asked["vars"])}), flush=True)
    elif do == "close":
        sys.stdout.close()
        os.close(1)
        time.sleep(0.1)
        os._exit(0)
    elif do == "odd":
        print(json.dumps({"output": {"a": 1}, "usage": 3, "cost_usd": True, "stop_reason": 5, "tool_calls": [{"name": "t"}], "pass": 1}), flush=True)
    else:
        print(json.dumps({"output": do, "pass": do == "yes", "score": 0.25 if do == "yes" else None, "usage": {"input_tokens": os.getpid()}, "tests": [{"vars": {"x": 1}}] * 2}), flush=True)
"""


@pytest.fixture
def program():
    return programs.Program(("python:", "-u", "-c", SOURCE), seconds=2.0, most_bytes=50_000)


def asked(child, do, **more):
    return programs.answered(child, json.dumps({"prompt": do} | more))


def test_each_request_has_its_own_answer(program):
    child = programs.Child(program)
    try:
        first = asked(child, "a")
        assert first[0] == "a" and asked(child, "b")[0] == "b" and child.starts == 1
        errors = {do: asked(child, do)[-2:] for do in ("crash", "hang", "long", "garbage", "list", "late", "close", "bare")}
        assert [kind for _, kind in errors.values()] == ["exec_failed", "provider_timeout", "provider_protocol", "provider_protocol", "provider_protocol", "provider_protocol", "exec_failed", "provider_protocol"]
        assert errors["crash"][0].startswith("ended with 7: xxx") and errors["crash"][0].endswith("bang") and len(errors["crash"][0]) < 2100
        assert errors["hang"][0] == "no answer within 2 s" and errors["garbage"][0] == "no JSON: [1, 2"
        # The next answer belongs to the next request.
        assert asked(child, "c")[0] == "c" and child.starts == 8
        assert asked(child, "odd") == ('{"a":1}', "5", None, None, None, None, None, '[{"name":"t"}]', None, None)
        # More than a pipe holds, in one request.
        assert asked(child, "big", vars="v" * 1_000_000)[0] == "1000000"
        assert programs.answered(child, "[1]")[-2:] == ("the request is no JSON object", "exec_failed") and programs.answered(child, "{")[-2:] == ("the request is no JSON", "exec_failed")
        assert programs.checked(child, "o", None, '{"do": "yes"}') == (True, 0.25, None) and programs.checked(child, "o", None, '{"do": "no"}') == (False, 0.0, None)
        assert programs.checked(child, "o", None, '{"do": "odd"}') == (None, None, "a verdict without pass") and programs.checked(child, None, "{", None)[2] == "vars is no JSON"
    finally:
        child.end()
    assert child.process is None


def test_program_that_is_not_there():
    child = programs.Child(programs.Program(("/no/such/program",)))
    assert asked(child, "a")[-2:] == ("/no/such/program can't be started: No such file or directory", "exec_failed")


def test_one_child_for_a_task(spark, program):
    rows = spark.createDataFrame([(k, json.dumps({"prompt": "crash" if k == 50 else f"p{k}"}), 1) for k in range(200)], "k int, request string, output int").repartition(3)
    got = programs.answers(rows, program).collect()
    assert len(got) == 200 and all(r.output == f"p{r.k}" for r in got if r.k != 50) and [r.error_class for r in got if r.k == 50] == ["exec_failed"]
    assert len({r.input_tokens for r in got if r.k != 50}) <= 4
    assert programs.answers(rows.limit(0), program).count() == 0


def test_generator_fails_by_row(spark, program):
    made = programs.tests_udtf(program, {"tags": ["t"], "id": None})
    rows = spark.createDataFrame([(1, '{"do": "x"}'), (2, '{"do": "crash"}'), (3, None)], "k int, given string")
    from pyspark.sql import functions as F

    got = sorted((r.k, r.test_id, r.vars, (r.error or "")[:12]) for r in rows.lateralJoin(made(F.col("given").outer())).collect())
    assert got == [(1, "test-1", '{"x": 1}', ""), (1, "test-2", '{"x": 1}', ""), (2, None, None, "ended with 7"), (3, "test-1", '{"x": 1}', ""), (3, "test-2", '{"x": 1}', "")]
