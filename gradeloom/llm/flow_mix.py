"""Mixing overlapping sources to target weights by min-cost flow.

Each document belongs to one or more sources; the set of them is its membership pattern. Documents are aggregated by
pattern, and a flow routes the patterns' words to the sources' quotas: the first use of a pattern's words costs
nothing, each further one more (convex costs), up to most_repeats uses. The cheapest flow that fills the quotas says how
many words each pattern gives to each source. Documents are then selected in a seeded order: every document of the
pattern as many whole times as all can be taken, and the first ones of the order once more, until the quota is met.

Sources stand in code point order, null last. They weigh 1, 2, 3, repeating, unless weights are given, and share the
total size; a target above most_repeats times its source's size is cut to that, and the excess reshared by weight
until none is above. A null source (or a null array of sources) is a source of its own; a document with an empty array
belongs to none and is not taken. Repeated rows are documents of their own; rows equal in id and text stand at one place
of the order and are taken alike. A document of size 0 is taken 0 times. An empty table gives no rows. Other columns are
carried along; those with the name of a result column give way to it.
"""

from __future__ import annotations

import heapq
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm import shared


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def target_words(sizes: dict, weights: dict | None = None, most_repeats: int = 3) -> dict:
    """Target of each source, of the total of all sizes."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = weights or {s: k % 3 + 1 for k, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), list(order), dict.fromkeys(order, 0.0)
    while open_:
        total = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / total > most_repeats * sizes[s]]
        if not full:
            return out | {s: left * weights[s] / total for s in open_}
        for s in full:
            out[s] = float(most_repeats * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def min_cost_flow(supply: dict, quotas: dict, most_repeats: int = 3) -> dict:
    """Words that go from each pattern (a tuple of sources) to each source: {(pattern, source): words}. Successive
    cheapest paths over start -> pattern (one edge per use, of growing cost) -> source -> end; patterns and sources
    are few, documents do not appear."""
    edges: list[list] = []  # to, capacity left, cost
    out: dict = {}

    def edge(a, b, capacity, cost):
        for x, y, c, k in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out.setdefault(x, []).append(len(edges))
            edges.append([y, c, k])

    for pattern in sorted(supply, key=str):
        for use in range(most_repeats):
            edge("start", ("p", pattern), int(supply[pattern]), use * use)
        for source in pattern:
            if source in quotas:
                edge(("p", pattern), ("s", source), most_repeats * int(supply[pattern]), 0)
    for source, words in quotas.items():
        edge(("s", source), "end", round(words), 0)
    potential: dict = {}
    while True:
        best, back, heap, tie = {"start": 0}, {}, [(0, 0, "start")], itertools.count(1)
        while heap:
            d, _, at = heapq.heappop(heap)
            if d > best[at]:
                continue
            for e in out.get(at, ()):
                to, capacity, cost = edges[e]
                near = d + cost + potential.get(at, 0) - potential.get(to, 0)
                if capacity > 0 and near < best.get(to, float("inf")):
                    best[to], back[to] = near, e
                    heapq.heappush(heap, (near, next(tie), to))
        if "end" not in best:
            break
        most = max(best.values())
        for node in out:
            potential[node] = potential.get(node, 0) + best.get(node, most)
        path, at = [], "end"
        while at != "start":
            path.append(back[at])
            at = edges[back[at] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    return {(at[1], edges[e][0][1]): edges[e ^ 1][1] for at, own in out.items() if isinstance(at, tuple) and at[0] == "p" for e in own if isinstance(edges[e][0], tuple) and edges[e][0][0] == "s" and edges[e ^ 1][1] > 0}


RESULTS = ("mix_size", "mix_copies", "mix_source_size", "mix_target")


def mix(docs: DataFrame, *, sources: Column | None = None, weights: dict | None = None, seed: int = 17, most_repeats: int = 3, most_patterns: int = 100_000, bucket_rows: int = 20_000) -> DataFrame:
    """docs with mix_size, mix_copies (how often the mix takes the document) and, if each has one source, mix_source_size
    and mix_target. sources: an array of each document's sources; the column source if not given. The seeded order is cut
    into buckets of about bucket_rows documents (at least 4,096 buckets), so that one task orders one bucket at most. More than most_patterns membership patterns (their sums are what reaches
    the driver) raise a ValueError before anything is mixed."""
    spark = docs.sparkSession
    pattern = F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string"))))) if sources is not None else F.array(F.col("source"))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    bits = max(12, min(24, (docs.count() // bucket_rows).bit_length()))
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS])
    rows = docs.select(carried.alias("row"), pattern.alias("pattern"), order.alias("place"), n_words(F.col("text")).alias("words"))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("place", 64 - bits))
    # Sizes by pattern and bucket of the seeded order: at most patterns x buckets rows, combined before the shuffle.
    sums = shared.stored(rows.groupBy("pattern", "bucket").agg(F.sum("words").alias("words")), "mix-sums")
    found = sums.groupBy("pattern").agg(F.sum("words").alias("words")).limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    supply = {tuple(r["pattern"]): r["words"] for r in found}
    sizes: dict = {}
    for p, n in supply.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    targets = target_words(sizes, weights, most_repeats)
    taken: dict = {}
    for (p, _), n in min_cost_flow(supply, targets, most_repeats).items():
        taken[p] = taken.get(p, 0) + n
    plan = []
    for p, n in supply.items():
        whole, rest = divmod(min(taken.get(p, 0), most_repeats * n), n) if n else (0, 0)
        one = p[0] if len(p) == 1 else None
        plan.append((list(p), int(whole), int(rest), int(sizes[one]) if len(p) == 1 else None, float(targets[one]) if len(p) == 1 else None))
    plan = spark.createDataFrame(plan, "of array<string>, whole int, rest long, source_size long, target double")
    same = F.col("pattern").eqNullSafe(F.col("of"))
    # The bucket in which each pattern's order crosses its rest, and the words before it.
    upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    run = sums.withColumn("upto", upto).join(F.broadcast(plan.select("of", "rest")), same).where("upto > rest")
    cut = run.groupBy("pattern").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")), "bucket").alias("cut"))
    cut = spark.createDataFrame(cut.select("pattern", "cut.bucket", "cut.before").collect(), "cut_of array<string>, cut long, before long")  # one row a pattern
    plan = plan.join(cut, F.col("of").eqNullSafe(F.col("cut_of")), "left").drop("cut_of")
    planned = rows.join(F.broadcast(plan), same)
    # Only that bucket is put in order.
    inside = planned.where("bucket = cut").groupBy("pattern", "place").agg(F.sum("words").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("pattern").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("upto", upto).where("upto <= rest + n / 2").groupBy("pattern").agg(F.max("place").alias("last"))
    done = planned.join(F.broadcast(last.withColumnRenamed("pattern", "last_of")), F.col("pattern").eqNullSafe(F.col("last_of")), "left")
    more = (F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & F.coalesce(F.col("place") <= F.col("last"), F.lit(False)))
    copies = F.when(F.col("words") == 0, F.lit(0)).otherwise(F.col("whole") + F.when(more & (F.col("rest") > 0), F.lit(1)).otherwise(F.lit(0)))
    return done.select("row.*", F.col("words").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), copies.alias("mix_copies"))
