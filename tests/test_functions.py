"""Digests, seeded values, numbers of canonical JSON, templates, schemas and patterns: published vectors and odd input."""

import base64
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from gradeloom import cache_queries
from gradeloom.functions import assertions, blake3, json_checks, templates
from gradeloom.operators import cache

#: Published test vectors: sizes of inputs that count up to 250 again and again, and their digests.
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a", 3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2",
    31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47", 102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}


def test_blake3_vectors(spark, monkeypatch):
    messages = [bytes(i % 251 for i in range(n)) for n in VECTORS]
    assert [h.hex() for h in blake3.digests(messages)] == list(VECTORS.values()) and blake3.digests([]) == []
    monkeypatch.setattr(blake3, "AT_ONCE", 3000)
    assert blake3.in_groups([None, *messages, None]) == [None, *(bytes.fromhex(h) for h in VECTORS.values()), None]
    rows = spark.createDataFrame([("abc",), ("",), (None,)], "t string").select(templates.FILTERS["blake3"](F.col("t"))).collect()
    assert [r[0] for r in rows] == ["6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85", VECTORS[0], None]


def test_seeds_are_told_apart_by_kind(spark):
    df = spark.createDataFrame([(42, "42", 1.0, True), (None, None, None, None)], "i long, s string, d double, b boolean")
    first, nothing = df.select(*[f(F.col(c)) for c in "isdb" for f in (templates.seeded_uuid, templates.seeded_rand, lambda c: templates.seeded_randint(5, 9, c))]).collect()
    for k, seed in enumerate(("42", '"42"', "1.0", "true")):
        h = blake3.digests([seed.encode()])[0]
        n, u = int.from_bytes(h[:8], "little"), h.hex()
        assert tuple(first[3 * k : 3 * k + 3]) == (f"{u[:8]}-{u[8:12]}-4{u[13:16]}-{'89ab'[int(u[16], 16) % 4]}{u[17:20]}-{u[20:32]}", (n >> 11) / 2**53, 5 + n % 5)
    assert set(nothing) == {None}


@pytest.mark.parametrize(
    ("x", "text"),
    [(1.0, "1.0"), (0.1, "0.1"), (1e15, "1000000000000000.0"), (1e16, "1e16"), (1.25e17, "1.25e17"), (1e-5, "0.00001"), (1e-6, "1e-6"), (1.5e-7, "1.5e-7"), (-0.0, "-0.0"), (123.456, "123.456"), (-2.5e300, "-2.5e300"), (2**70, "1.1805916207174113e21"), (2**64 - 1, "18446744073709551615")],
)
def test_numbers_of_canonical_json(x, text):
    assert json_checks.canonical({"b": [x, None, True], "a": "é\n"}) == '{"a":"é\\n","b":[' + text + ",null,true]}"
    assert json.loads(text) == x


def test_schemas_give_a_verdict_on_any_text(spark):
    def judged(text, schema):
        r = spark.range(1).select(json_checks.contains_json(F.lit(text), schema).alias("v")).first().v
        return r.passed, r.unevaluable

    assert json_checks.parsed("1e999") == (False, None) and judged("1e999", {"type": "integer"}) == (False, False)
    for schema in ({"multipleOf": 0}, {"$ref": "#"}, {"propertyNames": {}}, {"dependentRequired": {}}, {"unevaluatedProperties": False}):
        assert judged("3", schema) == (False, True), schema
    assert judged("3", {"title": "n", "type": "integer", "$defs": {}}) == (True, False)


@pytest.mark.parametrize(
    ("template", "text"),
    [("{{ name or 'anon' }}", "anon"), ("{{ x and name }}|{{ x or name }}", "|7"), ("{{ 'a' + 'b' | upper }}", "aB"), ("{{ ('a' + 'b') | upper }}", "AB"), ("{{ 1 + 2 * x | string | int }}", "15"), ("a{# no #}b", "ab"), ("{{ 'é' + ('x' + 'y')|upper }}", "éXY")],
)
def test_templates(template, text):
    assert templates.render(template, {"name": "", "x": 7}) == text


def test_templates_that_fail_say_so(spark):
    df = spark.createDataFrame([("{% if x %}a{% endif %}",), ("{{ 1e999 | int }}",), ("{{ 1 / 0 }}",), ("ok",)], "t string")
    rows = df.select(templates.rendered(F.col("t"), F.lit("{}")).alias("r")).collect()
    assert [r.r.text for r in rows] == [None, None, None, "ok"] and all(r.r.error for r in rows[:3])


def test_json_encode_of_any_type(spark):
    df = spark.sql("""SELECT 'a"b' AS s, 3 AS i, array(1, 2) AS l, named_struct('k', 'v') AS o, CAST(NULL AS STRING) AS n, true AS b""")
    assert list(df.select(*[templates.FILTERS["json_encode"](F.col(c)) for c in df.columns]).first()) == ['"a\\"b"', "3", "[1,2]", '{"k":"v"}', "null", "true"]


def test_patterns_with_brackets_are_judged(spark):
    judged = lambda p: assertions.java_pattern(p) is not None
    assert [judged(p) for p in ("[(?=]x", r"[\](?!]+", r"\(?=x", "(?=x)", r"(a)\1", r"\\1", "[^](?<=]a", "(?<!a)[b]")] == [True, True, True, False, False, True, True, False]
    assert spark.range(1).select(assertions.matches(F.lit("a?x"), "[(?=]x")["passed"]).first()[0]


def test_pages_of_an_entry_split_runs(spark):
    cases = spark.createDataFrame([("r1", f"c{k}", "n", "pass", True, "k") for k in range(3)] + [("r0", "c9", "n", "pass", None, "k")], "run_id string, case_key string, name string, status string, cached boolean, cache_key string")
    runs = spark.createDataFrame([("r0", "p", "s", 5), ("r1", "p", "s", 5)], "run_id string, project string, suite string, created_at long")
    after, seen = None, []
    while True:
        rows = cache.entry_runs(cases, runs, "k", 2, after).collect()
        seen += [(r.run_id, r.case_key) for r in rows[:2]]
        if len(rows) <= 2:
            break
        after = (rows[1].created_at, rows[1].run_id, rows[1].case_key)
    assert seen == [("r1", "c0"), ("r1", "c1"), ("r1", "c2"), ("r0", "c9")]


@pytest.mark.parametrize("broken", ["true", "false"])
def test_base64_is_one_line(spark, broken):
    texts = ["", "a" * 57, "a" * 58, "é\r\n" * 200, None]
    key = "spark.sql.chunkBase64String.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, broken)
    try:
        encoded = templates.FILTERS["b64encode"](F.col("t"))
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", encoded.alias("b64"), templates.FILTERS["b64decode"](encoded).alias("back")).collect()
    finally:
        spark.conf.set(key, before)
    assert [(r.t, r.b64, r.back) for r in got] == [(t, t and base64.b64encode(t.encode()).decode(), t) for t in texts]


def test_scalar_texts_of_long_and_missing_urls(spark, tmp_path):
    urls = ["https://h.example/" + "x" * n for n in (39, 40, 100, 2000)] + ["", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = cache_queries.scalar_texts(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(db.execute(f"SELECT {', '.join(got.columns)} FROM ({cache_queries.SCALARS})").fetchall())
