"""Quality rules on lines that many documents of a host share. DataFrame functions only.

Lines are normalised (ASCII letters lower-cased, white space runs to one blank, digits to 0) and hashed. A line is above the
limit of its host if more than most_docs documents there, and more than most_share of the host's documents, hold it.
Such lines are removed; a document that keeps less than least_kept of its words is depleted and rejected. Before that,
a document fails for too few words or too many repeated three-word windows.

A null text has no words; it fails. A null host is a host of its own. Every row counts as a document, whether its id is
repeated or null; a document counts once for a line however often it holds it. Other columns are ignored; an empty
table gives no rows.

Shuffled are one row per document and distinct line (host, hash, document) and one row per host and line; counts are
combined before the shuffle, so a line or host with a third of all rows does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import shared

BLANK = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    """The words of a text. Splitting at white space leaves an empty string at either end, which goes."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def _repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window found twice or more. A window's key is part of its hash, then its place (24 bits, or
    31 in texts of more words); sorted keys put equal windows side by side, and neighbours are compared word by word."""
    return F.when(F.size(w) < 4, F.lit(0)).when(F.size(w) < 1 << 24, _in_repeats(w, 24)).otherwise(_in_repeats(w, 31))


def _in_repeats(w: Column, place_bits: int) -> Column:
    bits = (1 << place_bits) - 1
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]).bitwiseAND(F.lit(~bits)).bitwiseOR(i.cast("long")),
    )
    keys = F.sort_array(windows)

    def same(a: Column, b: Column) -> Column:
        i, j = a.bitwiseAND(F.lit(bits)).cast("int"), b.bitwiseAND(F.lit(bits)).cast("int")
        return (a.bitwiseAND(F.lit(~bits)) == b.bitwiseAND(F.lit(~bits))) & (w[i] == w[j]) & (w[i + 1] == w[j + 1]) & (w[i + 2] == w[j + 2])

    def places(keys: Column) -> Column:
        found = F.filter(keys, lambda k, n: ((n > 0) & same(k, F.get(keys, n - 1))) | ((n < F.size(keys) - 1) & same(k, F.get(keys, n + 1))))
        return F.sort_array(F.transform(found, lambda k: k.bitwiseAND(F.lit(bits)).cast("int")))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"]
        )

    # A one-element transform() names an intermediate array, so that it is made once for each row.
    return F.transform(F.array(keys), lambda k: F.transform(F.array(places(k)), covered)[0])[0]


def _normal(line: Column) -> Column:
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    return F.array_join(_words(lower), " ")


def base_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    w = F.col("_w")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.withColumn("_w", _words(F.col("text"))).withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(shared.WORD)))
    return made.select(
        "doc_id",
        "host",
        "text",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    )


def judge_lines(docs: DataFrame, *, host: str = "source", most_docs: int = 20, most_share: float = 0.005, least_kept: float = 0.3, least_words: int = 50, most_repeated: float = 0.5) -> DataFrame:
    """doc_id, n_words and the other base counts, base_failed, removed_words (of lines above the limit), kept."""
    row_no = F.monotonically_increasing_id()
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    counted = shared.stored(
        base_counts(docs, host)
        .withColumn("base_failed", failed)
        .withColumn(
            "lines",
            F.filter(F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(_normal(x)).alias("line"), F.size(_words(x)).alias("n"))), lambda x: x["n"] > 0),
        )
        .select(row_no.alias("row_no"), "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lines"),
        "lines",
    )
    # One row per document and line: where a document repeats lines, their words are summed first.
    several = F.size(F.array_distinct(F.transform("lines", lambda x: x["line"]))) < F.size("lines")
    each = counted.select("row_no", "host", several.alias("several"), F.explode("lines").alias("l")).select("row_no", "host", "several", "l.line", F.col("l.n").cast("long").alias("n"))
    repeats = each.where("several").groupBy("row_no", "host", "line").agg(F.sum("n").alias("n"))
    held = each.where(~F.col("several")).select("row_no", "host", "line", "n").union(repeats.select("row_no", "host", "line", "n"))
    hosts = counted.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    frequent = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > most_docs)
    above = frequent.alias("f").join(hosts.alias("h"), F.col("f.host").eqNullSafe(F.col("h.host"))).where(F.col("docs") > most_share * F.col("host_docs")).select(F.col("f.host").alias("a_host"), F.col("line").alias("a_line"))
    removed = held.join(above, F.col("host").eqNullSafe(F.col("a_host")) & (F.col("line") == F.col("a_line")), "left_semi").groupBy("row_no").agg(F.sum("n").alias("removed_words"))
    out = counted.drop("lines", "host").join(removed, "row_no", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= least_kept * F.col("n_words"))
    return out.drop("row_no").withColumn("kept", kept)
