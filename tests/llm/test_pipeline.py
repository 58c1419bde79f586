"""Each stage of the pipeline on its own input against a plain version, and odd input through all of them."""

import collections
import math

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_training_data import _classes_by_all_pairs
from tokenizers import Tokenizer

import corpus_pipeline
from gradeloom.llm import factor_machine, flow_mix

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def rows(df):
    return sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=repr)


def test_quality_keeps_what_the_machine_accepts(spark, docs):
    machine = factor_machine.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = docs.withColumn("s", factor_machine.scores(docs, machine)).where("s >= 0.3").drop("s")
    got = rows(STAGES["quality"](spark, docs, SF))
    assert got == rows(want) and 0 < len(got) < docs.count()


def test_near_dedup_keeps_one_of_each_class(spark, docs):
    classes = _classes_by_all_pairs([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = STAGES["near_dedup"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(classes.values()))


def test_substring_dedup_takes_repeated_windows_out(spark, docs):
    found = {r["doc_id"]: (r["text"] or "").encode().split() for r in docs.collect()}
    count = collections.Counter(tuple(w[k : k + 35]) for w in found.values() for k in range(len(w) - 34))
    got = {r["doc_id"]: r["text"] for r in STAGES["substring_dedup"](spark, docs, SF).collect()}
    changed = 0
    for i, w in found.items():
        gone = {j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        assert got[i].encode().split() == [x for j, x in enumerate(w) if j not in gone]
        changed += bool(gone)
    assert changed and len(got) == len(found)


def test_mixture_meets_its_targets(spark, docs):
    size, text = collections.Counter(), {}
    for r in docs.collect():
        size[r["source"]] += len((r["text"] or "").split())
        text[r["doc_id"]] = len((r["text"] or "").split())
    got, most = collections.Counter(), collections.Counter()
    for r in STAGES["mixture"](spark, docs, SF).collect():
        got[r["source"]] += text[r["doc_id"]]
        most[r["doc_id"]] += 1
    targets = flow_mix.target_words(size)
    assert max(most.values()) <= 3 and all(abs(got[s] - targets[s]) <= max(text.values()) for s in size)


def test_packing_places_every_token(spark, docs):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got, fill = collections.Counter(), collections.defaultdict(list)
    for r in STAGES["packing"](spark, docs, SF).collect():
        got[r["doc_id"]] += r["length"]
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for own in fill.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 2048
    assert len(fill) <= math.ceil(sum(want.values()) / 2048) + 1


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_input(spark, name):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _score double, _key long, _copy int, label int, s string"
    texts = [None, "", "  ", "a b c", "a b c", "x " * 40_000, "one two three four five six"]
    some = spark.createDataFrame([(i if i else None, t, None, "s" if i % 2 else None, None, 0.5, 1, 1, 1, "s") for i, t in enumerate(texts)], kinds)
    some = some.union(some.where("text = 'a b c'"))
    labels = "/root/testdata/sf0.001"
    out = STAGES[name](spark, some, labels)
    assert out.count() >= 0 and STAGES[name](spark, some.limit(0), labels).count() == 0
    if name != "packing":
        assert out.columns == list(corpus_pipeline.COLUMNS)


def test_stages_run_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "mixture", "packing"] and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).where(F.col("length") > 2048).count() == 0
