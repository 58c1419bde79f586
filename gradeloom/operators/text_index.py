"""An inverted index over text columns: postings in files sorted by term, so that a word or a beginning is a range of rows and of row groups.

A folder holds generations that never change: `postings` (term, the row's key, its number of words, and the places of the term as
column and position), `rows` (key, number of words) and `stats` (rows and words of the generation). add() writes one more generation, remove() notes
keys whose rows of all generations so far are gone. A search reads the ranges of its own words alone, merges the places of phrases and ranks by
BM25 over all columns; it finds what search.matches() finds by reading every text.

A row's key is what `key` names, unique among the rows of the index; a row with a null in it is left out. Null texts hold no words. A term of
very many rows is a range of many row groups and files, as files are cut by term and key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.operators import search

PLACE = "struct<column:int,position:int>"


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    path: str
    key: tuple[str, ...]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def generations(self) -> int:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/stats")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sum(s.getPath().getName().startswith("generation=") for s in files.listStatus(folder)) if files.exists(folder) else 0

    def removed(self) -> DataFrame | None:
        """key and last generation of removed rows; None if there are none."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/removed")
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.table("removed").groupBy(*self.key).agg(F.max("upto").alias("upto")) if there else None

    def without_removed(self, df: DataFrame) -> DataFrame:
        gone = self.removed()
        if gone is None:
            return df
        own = gone.select(*(F.col(k).alias(f"_{k}") for k in self.key), "upto")
        same = F.col("generation") <= F.col("upto")
        for k in self.key:
            same = same & (F.col(k) == F.col(f"_{k}"))
        return df.join(own, same, "left_anti")


def build(rows: DataFrame, path: str, *, key: tuple[str, ...], columns: tuple[str, ...]) -> TextIndex:
    """The index of rows in a new folder."""
    index = TextIndex(rows.sparkSession, path, tuple(key))
    if index.generations():
        raise ValueError(f"{path} holds an index")
    add(index, rows, columns)
    return index


def _placed(text: Column, at: int) -> Column:
    return F.transform(search.tokens(text), lambda x, i: F.struct(x.alias("term"), F.lit(at).alias("column"), i.alias("position")))


def add(index: TextIndex, rows: DataFrame, columns: tuple[str, ...]) -> None:
    """One more generation. Its stats are written last; a generation without them (its writer was lost) is written over."""
    n = index.generations()
    known = F.lit(True)
    for k in index.key:
        known = known & F.col(k).isNotNull()
    found = [_placed(F.col(c), at) for at, c in enumerate(columns)]
    told = rows.where(known).select(*index.key, F.concat(*found).alias("_all")).withColumn("n_words", F.size("_all"))
    told.select(*index.key, "n_words").write.mode("overwrite").parquet(f"{index.path}/rows/generation={n}")
    each = told.select(*index.key, "n_words", F.explode("_all").alias("w")).select(*index.key, "n_words", "w.term", F.struct("w.column", "w.position").alias("place"))
    postings = each.groupBy("term", *index.key, "n_words").agg(F.sort_array(F.collect_list("place")).cast(f"array<{PLACE}>").alias("places"))
    ordered = postings.repartitionByRange("term", *index.key).sortWithinPartitions("term", *index.key)
    # Small row groups, so that a range of terms is few of them.
    ordered.write.mode("overwrite").option("parquet.block.size", str(4 << 20)).parquet(f"{index.path}/postings/generation={n}")
    own = index.spark.read.parquet(f"{index.path}/rows/generation={n}")
    own.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).write.mode("overwrite").parquet(f"{index.path}/stats/generation={n}")


def remove(index: TextIndex, keys: DataFrame) -> None:
    """Rows of these keys in all generations so far are gone; a later generation may hold them anew."""
    keys.select(*index.key, F.lit(index.generations() - 1).alias("upto")).distinct().write.mode("append").parquet(f"{index.path}/removed")


def _fits(word: str, whole: bool) -> Column:
    return F.col("term") == word if whole else F.col("term").startswith(word)


def ranges(index: TextIndex, query: str) -> DataFrame:
    """Postings of the words of a query. The condition reaches the files as comparisons and beginnings of term."""
    wanted = None
    for phrase in search.phrases_of(query):
        for i, word in enumerate(phrase):
            one = _fits(word, i < len(phrase) - 1)
            wanted = one if wanted is None else wanted | one
    return index.without_removed(index.table("postings").where(F.lit(False) if wanted is None else wanted))


def phrase_hits(index: TextIndex, query: str) -> DataFrame:
    """key, n_words, phrase (its place in the query) and hits, for each phrase and row that holds it."""
    phrases, found = search.phrases_of(query), ranges(index, query)
    labels = [F.when(_fits(w, i < len(p) - 1), F.struct(F.lit(n).alias("phrase"), F.lit(i).alias("word"))) for n, p in enumerate(phrases) for i, w in enumerate(p)]
    if not labels:
        return found.select(*index.key, "n_words", F.lit(0).alias("phrase"), F.lit(0).cast("long").alias("hits"))
    told = found.select(*index.key, "n_words", "places", F.explode(F.filter(F.array(*labels), lambda x: x.isNotNull())).alias("at"))
    sizes = F.element_at(F.array(*(F.lit(len(p)) for p in phrases)), F.col("at.phrase") + 1)
    row = (*index.key, "n_words", "phrase")
    single = told.where(sizes == 1).groupBy(*index.key, "n_words", F.col("at.phrase").alias("phrase")).agg(F.sum(F.size("places")).alias("hits"))
    if all(len(p) == 1 for p in phrases):
        return single
    # A phrase begins where all its words stand one after the other.
    begins = told.where(sizes > 1).select(*index.key, "n_words", "at.phrase", "at.word", sizes.alias("size"), F.explode("places").alias("place"))
    begins = begins.groupBy(*row, "size", "place.column", (F.col("place.position") - F.col("word")).alias("begin")).agg(F.count(F.lit(1)).alias("words"))
    several = begins.where(F.col("words") == F.col("size")).groupBy(*row).agg(F.count(F.lit(1)).alias("hits"))
    return single.unionByName(several)


def size_of(index: TextIndex) -> DataFrame:
    """One row: how many rows the index holds and how many words these have."""
    stats = index.table("stats").agg(F.sum("rows").alias("_rows"), F.sum("words").alias("_words"))
    gone = index.removed()
    if gone is None:
        return stats
    left = index.without_removed(index.table("rows"))
    return left.agg(F.count(F.lit(1)).alias("_rows"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("_words"))


def hits(index: TextIndex, query: str, *, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key and BM25 score of the rows that hold every phrase of the query, over all columns. A query without words finds nothing."""
    each, n = phrase_hits(index, query), len(search.phrases_of(query))
    rarity = F.broadcast(each.groupBy("phrase").agg(F.count(F.lit(1)).alias("_df")))  # a row for each phrase
    size = F.broadcast(size_of(index))  # one row
    scored = each.join(rarity, "phrase").join(size, F.lit(True))
    idf = F.log(1 + (F.col("_rows") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = idf * F.col("hits") * (k1 + 1) / (F.col("hits") + k1 * (1 - b + b * F.col("n_words") * F.col("_rows") / F.col("_words")))
    return scored.groupBy(*index.key).agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("_held")).where(F.col("_held") == max(n, 1)).drop("_held")


def cut_to(df: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first rows in an order, with their rank from 1."""
    first = df.orderBy(*order).limit(most)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # `most` rows
