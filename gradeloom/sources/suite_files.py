"""Suites on the driver: files of tests, composition, defaults, variables from files. A suite's own text is small; its tests become
a DataFrame before they are expanded."""

from __future__ import annotations

import glob as files
import hashlib
import json
import os
import subprocess
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions import templates
from gradeloom.sources import ingest

#: A test as a row; values of vars, and asserts and history, are JSON texts.
TEST = """test_id string, description string, tags array<string>, threshold double, cache_salt string, expect_fail boolean, expect_fail_reason string, asserts string, history string, vars map<string, string>,
  matrix map<string, array<string>>, only_providers array<string>, skip_providers array<string>"""


def within(spec: str, base: str) -> list[str]:
    """Files that a file:// glob names, by path; one outside the base folder raises an error."""
    root = Path(base).resolve()
    found = sorted(os.path.realpath(p) for p in files.glob(str(root / spec.removeprefix("file://")), recursive=True))
    for p in found:
        if not Path(p).is_relative_to(root):
            raise ValueError(f"{p} lies outside {root}")
    return [p for p in found if os.path.isfile(p)]


def _yaml(text: str):
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("!file", lambda loader, node: {"$file": loader.construct_scalar(node)})
    return yaml.load(text, Loader)


def tests_of(document) -> list[dict]:
    """The tests of a document: a list, or an object with the list `tests`."""
    own = document.get("tests") if isinstance(document, dict) else document
    if not isinstance(own, list):
        raise ValueError("expected a list of tests, or an object with the list tests")
    return own


def test_row(test: dict, default_id: str) -> tuple:
    """A test as a row of TEST."""
    expected = test.get("expect_fail")
    texts = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in (test.get("vars") or {}).items()}
    axes = {k: [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in v] for k, v in (test.get("matrix") or {}).items()}
    as_json = lambda v: None if v is None else json.dumps(v, ensure_ascii=False)
    return (
        test.get("id") or default_id, test.get("description"), list(test.get("tags") or []), test.get("threshold"), test.get("cache_salt"), bool(expected), expected if isinstance(expected, str) else None,
        as_json(test.get("assert")), as_json(test.get("history")), texts, axes, list(test.get("only_providers") or []), list(test.get("skip_providers") or []),
    )


def read_tests(spark: SparkSession, spec: str, base: str) -> DataFrame:
    """Tests of all files that a glob names, in order of path and place (file_no, place): YAML, JSON, JSON lines, CSV and TSV.
    A test without id is called <file's stem>/<place>."""
    out = None
    for k, path in enumerate(within(spec, base)):
        stem, kind = Path(path).stem, Path(path).suffix[1:]
        if kind in ("csv", "tsv"):
            own = ingest.read_tests_table(spark, f"file://{path}", "\t" if kind == "tsv" else ",", default_id=stem)
        elif kind in ("yaml", "yml", "json", "jsonl", "ndjson"):
            text = Path(path).read_text()
            found = [json.loads(x) for x in text.splitlines() if x.strip()] if kind in ("jsonl", "ndjson") else tests_of(_yaml(text) if kind.startswith("y") else json.loads(text))
            own = spark.createDataFrame([(*test_row(t, f"{stem}/{i}"), i) for i, t in enumerate(found)], f"{TEST}, place int")
        else:
            raise ValueError(f"unknown kind of test file: {path}")
        own = own.withColumn("file_no", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return spark.createDataFrame([], f"{TEST}, place int, file_no int") if out is None else out


def inline_tests(spark: SparkSession, tests: list[dict]) -> DataFrame:
    """Tests that stand in the suite itself; one without id is called inline/<place>."""
    return spark.createDataFrame([(*test_row(t, f"inline/{i}"), i) for i, t in enumerate(tests)], f"{TEST}, place int")


def swept(tests: DataFrame) -> DataFrame:
    """Each test with every combination of its matrix's values, by the names of the axes in order; they become variables, and
    the id gets [axis=value,...]. A test without a matrix stays as it is; an axis without values raises an error."""
    axes = F.array_sort(F.map_keys("matrix"))
    empty = F.array(F.create_map().cast("map<string,string>"))
    grown = F.aggregate(
        axes,
        empty,
        lambda got, axis: F.flatten(F.transform(got, lambda m: F.transform(F.try_element_at("matrix", axis), lambda v: F.map_concat(m, F.create_map(axis, v))))),
    )
    none = F.exists(F.map_values("matrix"), lambda v: F.size(v) == 0)
    checked = tests.withColumn("_fits", F.when(none, F.raise_error(F.lit("an axis has no values"))).otherwise(F.lit(True)).cast("boolean")).where("_fits").drop("_fits")
    combos = F.when(F.coalesce(F.size("matrix"), F.lit(0)) <= 0, empty).otherwise(grown)
    made = checked.withColumn("combo", F.explode(combos))
    pairs = F.array_join(F.transform(F.array_sort(F.map_keys("combo")), lambda a: F.concat(a, F.lit("="), F.try_element_at("combo", a))), ",")
    named = F.when(F.size("combo") > 0, F.concat("test_id", F.lit("["), pairs, F.lit("]"))).otherwise(F.col("test_id"))
    kept = F.map_filter("vars", lambda k, _: ~F.map_contains_key("combo", k))
    return made.withColumns({"test_id": named, "vars": F.map_concat(kept, F.col("combo"))}).drop("combo", "matrix")


def with_defaults(tests: DataFrame, defaults: dict) -> DataFrame:
    """Defaults of a suite in each test: variables and threshold, salt and history fill gaps, assertions come first, tags are
    united."""
    given = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in (defaults.get("vars") or {}).items()}
    own = F.create_map(*[F.lit(x) for pair in given.items() for x in pair]) if given else F.create_map().cast("map<string,string>")
    gaps = F.map_filter(own, lambda k, _: ~F.map_contains_key("vars", k))
    tags = F.array(*[F.lit(t) for t in defaults.get("tags") or []]).cast("array<string>")
    first = json.dumps(defaults["assert"], ensure_ascii=False)[1:-1] if defaults.get("assert") else ""
    inner = F.regexp_replace(F.coalesce("asserts", F.lit("[]")), r"(?s)^\s*\[\s*|\s*\]\s*$", "")
    both = F.concat(F.lit("["), F.concat_ws(", ", F.lit(first or None), F.nullif(inner, F.lit(""))), F.lit("]"))
    fill = lambda name, kind: F.coalesce(F.col(name), F.lit(defaults.get(name)).cast(kind))
    history = F.coalesce("history", F.lit(json.dumps(defaults["history"]) if defaults.get("history") is not None else None))
    asserts = both if first else F.col("asserts")
    return tests.withColumns({"vars": F.map_concat(gaps, F.col("vars")), "asserts": asserts, "tags": F.array_union("tags", tags), "threshold": fill("threshold", "double"), "cache_salt": fill("cache_salt", "string"), "history": history})


def file_value(spec: str, base: str):
    """What a variable {$file: path} holds: JSON and YAML files as values, others as text."""
    found = within(spec, base)
    if len(found) != 1:
        raise ValueError(f"{spec} names {len(found)} files")
    text = Path(found[0]).read_text()
    kind = Path(found[0]).suffix
    return json.loads(text) if kind == ".json" else _yaml(text) if kind in (".yaml", ".yml") else text


def with_files(value, base: str):
    """A document with each {$file: path} in it replaced by the file's content."""
    if isinstance(value, dict):
        return file_value(value["$file"], base) if set(value) == {"$file"} else {k: with_files(v, base) for k, v in value.items()}
    return [with_files(v, base) for v in value] if isinstance(value, list) else value


def digest_salt(salt: str, variables: dict, base: str) -> str:
    """A salt `digest:<glob>` as the digest of the files' paths and contents (the glob is a template); others stay as they are."""
    if not salt.startswith("digest:"):
        return salt
    h = hashlib.sha256()
    for path in within(templates.render(salt.removeprefix("digest:"), variables), base):
        for part in (os.path.relpath(path, Path(base).resolve()).encode(), Path(path).read_bytes()):
            h.update(len(part).to_bytes(8, "little") + part)
    return "sha256:" + h.hexdigest()


def merged(base, over):
    """Two configurations: objects merge, lists named assert are joined, all else is replaced."""
    if not isinstance(base, dict) or not isinstance(over, dict):
        return over
    out = dict(base)
    for k, v in over.items():
        lists = k == "assert" and isinstance(base.get(k), list) and isinstance(v, list)
        out[k] = [*base[k], *v] if lists else merged(base[k], v) if k in base else v
    return out


def load(path: str, above: tuple[str, ...] = ()) -> dict:
    """A suite's file over what it extends and imports; a file that leads back to itself raises an error."""
    own = os.path.realpath(path)
    if own in above:
        raise ValueError(f"{path} leads back to itself")
    value = _yaml(Path(path).read_text()) or {}
    out: dict = {}
    for spec in [*filter(None, [value.pop("extends", None)]), *(value.pop("imports", None) or [])]:
        out = merged(out, load(os.path.join(os.path.dirname(own), spec), (*above, own)))
    return merged(out, value)


def expanded(spark: SparkSession, suite: dict, base: str, environment: dict[str, str] | None = None) -> DataFrame:
    """All tests of a suite (`tests`: objects, and file:// globs): read, swept, with defaults."""
    suite = with_files(templates.with_environment(suite, dict(os.environ) if environment is None else environment), base)
    out, inline = None, [t for t in suite.get("tests", []) if isinstance(t, dict) and "generator" not in t]
    for own in [*([inline_tests(spark, inline)] if inline else []), *(read_tests(spark, t, base) for t in suite.get("tests", []) if isinstance(t, str))]:
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        out = inline_tests(spark, [])
    tests = swept(out)
    return with_defaults(tests, suite["defaults"]) if suite.get("defaults") else tests


def provenance(folder: str, environment: dict[str, str] | None = None, mode: str = "full") -> dict:
    """Where a run comes from: git's branch, commit and whether files are changed, the CI job, and (mode full) who and where. Mode
    anonymous leaves people out, off records nothing."""
    if mode == "off":
        return {}
    env = dict(os.environ) if environment is None else environment

    def git(*args: str) -> str | None:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=False)
        return done.stdout.strip() if done.returncode == 0 else None

    commit = git("rev-parse", "HEAD")
    out = {"git": {"branch": git("rev-parse", "--abbrev-ref", "HEAD"), "commit": commit, "dirty": bool(git("status", "--porcelain"))} if commit else None}
    names = (("github", "GITHUB_ACTIONS"), ("gitlab", "GITLAB_CI"), ("ci", "CI"))
    provider = next((name for name, flag in names if env.get(flag)), None)
    url = env.get("CI_JOB_URL") or (f"{env.get('GITHUB_SERVER_URL')}/{env.get('GITHUB_REPOSITORY')}/actions/runs/{env['GITHUB_RUN_ID']}" if env.get("GITHUB_RUN_ID") else None)
    out["ci"] = {"provider": provider, "run_url": url} if provider else None
    if mode == "full":
        out["origin"] = {"actor": env.get("GITHUB_ACTOR") or env.get("USER"), "host": os.uname().nodename}
    return out


def imported(config: dict) -> dict:
    """A suite from another tool's file of prompts, providers and tests (each assertion a type and a value)."""
    prompts = [{"id": f"prompt-{i}", "template": p} if isinstance(p, str) else p for i, p in enumerate(config.get("prompts", []))]
    providers = [{"id": p} if isinstance(p, str) else p for p in config.get("providers", [])]
    tests = [{"id": t.get("description") or f"inline/{i}", "vars": t.get("vars", {}), "assert": [{"type": a["type"], **({"value": a["value"]} if "value" in a else {})} for a in t.get("assert", [])]} for i, t in enumerate(config.get("tests", []))]
    return {"prompts": prompts, "providers": providers, "tests": tests}


def generated(spark: SparkSession, make: Callable[[], list[dict]], defaults: dict | None = None) -> DataFrame:
    """Tests that a function makes; they aren't swept, and get the defaults afterwards."""
    tests = inline_tests(spark, make()).drop("matrix")
    return with_defaults(tests, defaults) if defaults else tests


def numbered(tests: DataFrame) -> DataFrame:
    """Tests with their place among all, by file and place."""
    return tests.withColumn("nth", F.row_number().over(Window.orderBy("file_no", "place")))
