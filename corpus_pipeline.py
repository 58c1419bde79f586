"""A corpus pipeline of five stages over documents: quality, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Part of the subpackage of training-data operators.

Every stage reads the columns of documents alone, whatever else docs holds, and gives no rows for an empty table. A null text
counts as empty, and a stage that keeps such a row keeps the null, but for substring_dedup, which gives it an empty text. A null
doc_id is an id like others. Repeated rows are judged alike: near_dedup keeps one row of each class, even of rows equal
in all columns; the others treat each row for itself. Ties (two documents of one class, of one size) go to the
least doc_id, then to a hash of the text, so reruns agree.

SQL cannot express the classifier, the sketches, the seeded mix or the search for a packing; ORACLE_SQL is None, and
the stages are tested one by one against plain versions in tests/llm/test_pipeline.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm import factor_machine, flow_mix, pack_swap, shared, weighted_minhash, window_index
from gradeloom.llm.queries import _vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the training folds of the labels, doesn't reject."""
    docs = docs.select(*COLUMNS)
    machine = factor_machine.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn("_score", factor_machine.scores(docs, machine)).where("_score >= 0.3").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates. Of repeated rows of that document, one stays."""
    docs = docs.select(*COLUMNS)
    kept = weighted_minhash.near_duplicates(docs).where("kept").select(F.col("row_no").alias("_kept")).distinct()
    keyed = docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    return keyed.join(kept, F.col("_key") == F.col("_kept"), "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated windows, the rest joined by blanks; untouched texts stay as they are."""
    return window_index.remove_repeats(docs.select(*COLUMNS), keep_text=True, carry=("lang", "source", "n_chars")).select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars")).cast("long").alias("n_chars")
    )


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most three times."""
    mixed = flow_mix.mix(docs.select(*COLUMNS)).where("mix_copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return pack_swap.pack_documents(docs, _vocabulary_path("word_bpe_49k.json"), style="bare")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixture", mixture), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
