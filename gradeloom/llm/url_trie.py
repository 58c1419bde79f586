"""URL filter: allow and block rules in a trie over reversed host labels and path segments.

A rule is (verdict, host, path). It fits its host and all subdomains if the url's path starts with the rule's path.
Of the rules that fit, the longest (host and path together, then the longer host) decides; between an allow and a
block entry of the same host and path, block does. A url that no rule fits gets the default verdict.

Host: what follows the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: what follows up to "?", "#" or
the end. A null url, or one without "://", has an empty host and path. Repeated rows are judged one by one, other columns
are carried along (one with the name of a result column gives way to it), an empty table stays empty.

Up to most_rules rules travel as one broadcast trie. Beyond that, the rules stay a table: each distinct pair of host and path
meets them in a join on host suffix and path folder (the path up to one of its slashes), so that the rules of a large
domain are spread over its folders, and the best match is taken by pair; both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import shared

RULES = "verdict string, host string, path string"


class Trie:
    """Nodes are dicts. A label leads to the node below, "/" from a host to its paths, ("/", segment) along a path, and
    0 holds the rules that end here: {beginning of the next segment, or None for the bare host: rule}."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            if path and not path.startswith("/"):
                continue  # no url's path starts so
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            if path:
                *whole, last = path.split("/")[1:]
                node = node.setdefault("/", {})
                for segment in whole:
                    node = node.setdefault(("/", segment), {})
                ends = node.setdefault(0, {})
            else:
                ends, last = node.setdefault(0, {}), None
            old = ends.get(last)
            if old is None or old[1] != "block":
                ends[last] = (host + path, verdict, len(host))

    def find(self, host: str, path: str) -> tuple[str, str, int] | None:
        best, node = None, self.root
        if not host:
            return None
        segments = path.split("/")[1:] if path.startswith("/") else []

        def better(rule):
            return best is None or (len(rule[0]), rule[2]) > (len(best[0]), best[2])

        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            rule = node.get(0, {}).get(None)
            if rule and better(rule):
                best = rule
            walk = node.get("/") if segments else None
            for segment in segments:
                if walk is None:
                    break
                ends = walk.get(0)
                for n in range(len(segment) + 1) if ends else ():
                    rule = ends.get(segment[:n])
                    if rule and better(rule):
                        best = rule
                walk = walk.get(("/", segment))
        return best


def _host_path(urls: pd.Series) -> tuple[pd.Series, pd.Series]:
    parts = urls.fillna("").str.extract(r"(?s)\A.*?://([^/?#]*)([^?#]*)").fillna("")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return parts[0].map(lambda h: h.translate(lower)), parts[1]


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, *, default: str = "allow", most_rules: int = 200_000) -> DataFrame:
    """pages with url_host, url_path, url_rule (host and path of the rule that decided, or null) and url_verdict."""
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, RULES)
    listed = table.limit(most_rules + 1).collect()  # bounded by most_rules
    if len(listed) > most_rules:
        return _judge_by_join(pages, table, default)
    trie = spark.sparkContext.broadcast(Trie([tuple(r) for r in listed]))

    @F.pandas_udf("url_host string, url_path string, url_rule string, url_verdict string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = trie.value
        for urls in batches:
            host, path = _host_path(urls)
            found = [own.find(h, p) for h, p in zip(host, path, strict=True)]
            yield pd.DataFrame({"url_host": host, "url_path": path, "url_rule": [r and r[0] for r in found], "url_verdict": [r[1] if r else default for r in found]})

    judged = shared.fresh_name(pages, "judged")
    return pages.withColumn(judged, judge("url")).select(*_carried(pages), f"{judged}.*")


RESULTS = ("url_host", "url_path", "url_rule", "url_verdict")


def _carried(pages: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in pages.columns if c.lower() not in RESULTS]


def host_and_path(url):
    """The same host and path as columns."""
    there = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(there, r"(?s)\A.*?://([^/?#]*)([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(there, r"(?s)\A.*?://([^/?#]*)([^?#]*)", 2)


def _folders(path):
    """Beginnings of a path up to each of its slashes, and the empty one."""
    places = F.filter(F.sequence(F.lit(0), F.length(path)), lambda k: (k == 0) | (F.substring(path, k, F.lit(1)) == "/"))
    return F.transform(places, lambda k: F.substring(path, F.lit(1), k))


def _judge_by_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.struct(*_carried(pages)).alias("row"), host.alias("url_host"), path.alias("url_path"))
    labels = F.split("url_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    pairs = rows.select("url_host", "url_path").where("url_host <> ''").distinct()
    asked = pairs.withColumn("suffix", F.explode(suffixes)).withColumn("folder", F.explode(_folders(F.col("url_path"))))
    # Of equal rules, block stays; those of one host and folder are one row.
    own = rules.groupBy(F.col("host").alias("suffix"), "path").agg(F.max(F.col("verdict") == "block").alias("shut"))
    own = own.withColumn("folder", F.regexp_extract("path", r"(?s)\A(.*/)?", 0))
    own = own.groupBy("suffix", "folder").agg(F.collect_list(F.struct("path", "shut")).alias("rules"))
    met = asked.join(own, ["suffix", "folder"]).select("url_host", "url_path", "suffix", F.explode(F.filter("rules", lambda r: F.col("url_path").startswith(r["path"]))).alias("r"))
    rule = F.struct((F.length("suffix") + F.length("r.path")).alias("a"), F.length("suffix").alias("b"), F.concat("suffix", "r.path").alias("rule"), F.col("r.shut").alias("shut"))
    best = met.groupBy("url_host", "url_path").agg(F.max(rule).alias("best"))
    verdict = F.when(F.col("best").isNull(), F.lit(default)).otherwise(F.when(F.col("best.shut"), "block").otherwise("allow"))
    return rows.join(best, ["url_host", "url_path"], "left").select("row.*", "url_host", "url_path", F.col("best.rule").alias("url_rule"), verdict.alias("url_verdict"))
