"""Approximate nearest neighbours by largest inner product: inverted lists whose vectors are scanned a few dimensions at a time.

Vectors are turned by one random rotation, so that any few of their dimensions tell about the rest, and dealt to lists by k-means. A list's
vectors lie in blocks of at most `BLOCK`; a block holds column blocks of `WIDTH` rotated dimensions, one after the other, and the original vectors.
A candidate x can enter the results of a query q only if its inner product reaches the k-th best so far, t, that is if its squared
distance stays within r = |q|^2 + |x|^2 - 2t. After each column block, with d of D dimensions seen, the hypothesis that it does is rejected if

    partial distance * D / d > r (1 + eps / sqrt(d))^2

and the candidate is abandoned. Those that pass all blocks are scored in double precision on the original vectors. A query's nearest lists are
scanned first, by themselves; their k-th best goes with the query to its other lists, so that most candidates there are given up after the first block.

Lists are fitted on about `sample` distinct vectors (32 MB at most), taken by hash. How many lists a query probes is measured: the neighbours of about
256 queries are found exactly, among all vectors, and as many lists are probed as hold the share `reach` of them, more where those hold fewer than
k + 1 rows. All vectors are indexed; equal vectors are one entry with their k + 1 smallest ids (no
other of them can be among k + 1 nearest), equal queries are searched once. Queries and blocks of a list meet in groups of one block and about
`GROUP` queries, so a list with a third of all vectors or queries is many groups.

Each query (an id divisible by `every`) gets its k nearest vectors found, its own id left out, all others if they are fewer: by descending score, equal
scores by ascending id. Vectors that are null, zero, or hold null or non-finite components take no part, nor do those with a null id or
of another size than most. Of rows that share an id, the one with the least vector takes part. Other columns are ignored; an empty table
gives no rows. Fitting and tests are seeded, so reruns on the same rows agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm import shared

BLOCK, WIDTH, GROUP = 1024, 16, 2048
#: Candidates of a block that are scanned at once: the k-th best follows after each.
STEP = 256
RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def taking_part(rows: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """One row for each id, (vec_id, v), and the number of dimensions."""
    own = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    sizes = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = sizes.d if sizes else 0
    return own.where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v")), d


def rotation(d: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def means(x: np.ndarray, n: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means; an empty cluster takes one of the vectors farthest from their centres."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        own, far = nearest_centre(x, centres)
        counts = np.bincount(own, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = sums / np.maximum(counts, 1).astype(x.dtype)[:, None]
        empty = np.flatnonzero(counts == 0)
        centres[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, far, half = np.empty(len(x), np.int64), np.empty(len(x), x.dtype), (centres**2).sum(1) / 2
    for k in range(0, len(x), 8192):
        short = half - x[k : k + 8192] @ centres.T
        own[k : k + 8192] = short.argmin(1)
        far[k : k + 8192] = 2 * short.min(1) + (x[k : k + 8192] ** 2).sum(1)
    return own, far


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """An Arrow column of lists of d numbers."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, d)


class Lists:
    """Rotation, centres of the lists and, once they are filled, their numbers of rows."""

    def __init__(self, sample: np.ndarray, n: int, seed: int):
        self.turn = rotation(sample.shape[1], seed)
        self.centres = means(sample @ self.turn.astype(np.float32), n, seed).astype(np.float64)
        self.rows = np.zeros(n, np.int64)

    def of(self, v: np.ndarray) -> np.ndarray:
        return nearest_centre(v @ self.turn, self.centres)[0]

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists of each query, the one whose centre has the largest inner product first."""
        return np.argsort(-((q @ self.turn) @ self.centres.T), axis=1, kind="stable")

    def probed(self, q: np.ndarray, probes: int, k: int) -> list[np.ndarray]:
        order = self.order(q)
        enough = 1 + np.argmax(np.cumsum(self.rows[order], axis=1) > min(k, self.rows.sum() - 1), axis=1)
        return [x[: max(probes, n)] for x, n in zip(order, enough.tolist(), strict=True)]


BLOCKS = "list int, block bigint, n int, nodes binary, vectors binary, planes array<binary>"


def _blocks(sent, d: int):
    """Blocks of rows that come in the order of lists."""

    def block(which: int, nodes: list[np.ndarray], vectors: list[np.ndarray]) -> pa.RecordBatch:
        node, v = np.concatenate(nodes), np.concatenate(vectors)
        turned = (v @ sent.value.turn).astype("<f4")
        planes = [np.ascontiguousarray(turned[:, a : a + WIDTH]).tobytes() for a in range(0, d, WIDTH)]
        columns = (which, int(node[0]), len(node), node.astype("<i8").tobytes(), v.astype("<f8").tobytes(), planes)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(columns, kinds, strict=True)], ["list", "block", "n", "nodes", "vectors", "planes"])

    def blocks(batches):
        which, nodes, vectors, n = -1, [], [], 0
        for batch in batches:
            own, node, v = np.asarray(batch.column("list")), np.asarray(batch.column("node")), matrix(batch.column("v"), d)
            at = 0
            while at < len(own):
                if n and (own[at] != which or n >= BLOCK):
                    yield block(which, nodes, vectors)
                    nodes, vectors, n = [], [], 0
                which = int(own[at])
                end = min(int(np.searchsorted(own, which, side="right")), at + BLOCK - n)
                nodes.append(node[at:end])
                vectors.append(v[at:end])
                n, at = n + end - at, end
        if n:
            yield block(which, nodes, vectors)

    return blocks


def opened(row: dict, d: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Nodes, original vectors and column blocks of a block."""
    n = row["n"]
    return np.frombuffer(row["nodes"], "<i8"), np.frombuffer(row["vectors"], "<f8").reshape(n, d), [np.frombuffer(p, "<f4").reshape(n, -1) for p in row["planes"]]


def scan(turned: np.ndarray, q: np.ndarray, least: np.ndarray, nodes: np.ndarray, vectors: np.ndarray, planes: list[np.ndarray], k: int, eps: float, told: list | None = None):
    """Query places, scores and nodes of what a block adds to the k best of each query; least: scores that queries have k of already."""
    d, least = q.shape[1], least.copy()
    q_own, x_own = (turned.astype(np.float64) ** 2).sum(1), (vectors**2).sum(1)
    best = np.full((len(q), k), -np.inf)
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(nodes), STEP):
        x = slice(a, a + STEP)
        both = q_own[:, None] + x_own[None, x]
        # Infinite as long as a query has no k candidates. Rounding of single precision must not abandon what just reaches.
        room = both - 2 * least[:, None]
        room = np.where(room < -1e-5 * both, -1.0, np.maximum(room, 0) + 1e-5 * both).astype(np.float32)
        alive = room >= 0
        seen, far, pairs = 0, None, None
        for plane in planes:
            p, own, width = plane[x], turned[:, seen : seen + plane.shape[1]], plane.shape[1]
            if pairs is None and far is not None and alive.sum() < 0.2 * alive.size:
                pairs = np.nonzero(alive)
                far, room_of = far[pairs], room[pairs]
            if pairs is None:
                near = (own**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * (own @ p.T)
                far = near if far is None else far + near
            else:
                far = far + ((own[pairs[0]] - p[pairs[1]]) ** 2).sum(1)
            seen += width
            if told is not None:
                told.append((alive.sum() if pairs is None else len(far)) * width)
            bound = (room if pairs is None else room_of) * ((1 + eps / seen**0.5) ** 2 if seen < d else 1.0)
            passed = far * (d / seen) <= bound
            if pairs is None:
                alive &= passed
            else:
                pairs, far, room_of = tuple(z[passed] for z in pairs), far[passed], room_of[passed]
        i, j = np.nonzero(alive) if pairs is None else pairs
        score = np.einsum("ij,ij->i", q[i], vectors[x][j])
        good = score >= least[i]
        i, j, score = i[good], j[good], score[good]
        out.append((i, score, nodes[x][j]))
        if len(i):
            scores = np.full((len(q), len(nodes[x])), -np.inf)
            scores[i, j] = score
            best = np.partition(np.concatenate([best, scores], axis=1), scores.shape[1], axis=1)[:, -k:]
            least = np.maximum(least, best[:, 0])
    i, score, node = (np.concatenate(z) for z in zip(*out, strict=True))
    good = score >= least[i]
    i, score, node = i[good], score[good], node[good]
    order = np.lexsort((node, -score, i))
    i = i[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], score[order][keep], node[order][keep]


def nearest(rows: DataFrame, *, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding", sample: int = 65_536, reach: float = 0.96, eps: float = 2.1, seed: int = 13) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest vectors of each query."""
    spark, keep = rows.sparkSession, shared.Scratch(rows.sparkSession)
    part, d = taking_part(rows, vec_id, vector)
    if not d:
        return spark.createDataFrame([], RESULT)
    part = keep.stored(part, "vectors")
    # Equal vectors: their k+1 smallest ids; the least is their node. The limit by group comes before the shuffle, too.
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    copies = part.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = keep.stored(copies.select(F.col("ids")[0].alias("node"), "ids", "v"), "entries")
    asked = keep.stored(part.where(F.pmod("vec_id", F.lit(every)) == 0).join(entries.select("node", "v"), "v").select("vec_id", "node"), "asked")
    queries = keep.stored(entries.select("node", "v").join(asked.select("node").distinct(), "node", "left_semi"), "queries")
    n = entries.count()
    fitted = drawn_by_hash(entries, d, n, max(1, min(sample, (32 << 20) // (4 * d))))  # about 32 MB at most
    lists = Lists(fitted, max(1, min(int(n**0.5), len(fitted) // 16)), seed)
    sent = spark.sparkContext.broadcast(lists)

    def dealt(batches):
        for batch in batches:
            own = sent.value.of(matrix(batch.column("v"), d))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(batch.column(c) for c in ("node", "rows", "v"))], ["list", "node", "rows", "v"])

    ordered = entries.select("node", F.size("ids").alias("rows"), "v").mapInArrow(dealt, "list int, node bigint, rows int, v array<double>")
    ordered = keep.stored(ordered, "dealt")
    counts = ordered.groupBy("list").agg(F.sum("rows").alias("rows")).collect()  # one row for each list
    lists.rows[[r.list for r in counts]] = [r.rows for r in counts]
    ranged = ordered.repartitionByRange(shared.partitions(spark), "list", "node").sortWithinPartitions("list", "node")
    blocks = keep.stored(ranged.select("list", "node", "v").mapInArrow(_blocks(sent, d), BLOCKS), "blocks")
    probes = measured_probes(blocks, queries, lists, d, k, reach)
    sent = spark.sparkContext.broadcast(lists)  # with the numbers of rows

    def probed(batches):
        for batch in batches:
            q = matrix(batch.column("v"), d)
            own = sent.value.probed(q, probes, k)
            at = np.repeat(np.arange(len(own)), [len(x) for x in own])
            rank = np.concatenate([np.arange(len(x)) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(at)), pa.array(np.concatenate(own).astype(np.int32)), pa.array(rank.astype(np.int32))], ["node", "list", "rank"])

    pairs = keep.stored(queries.mapInArrow(probed, "node bigint, list int, rank int"), "probes")
    asking = queries.withColumn("least", F.lit(float("-inf")))
    near = keep.stored(_scanned(blocks, asking, pairs.where(F.col("rank") < max(1, probes // 8)), sent, d, k, eps), "near")
    # A query that has k+1 candidates needs no others below the last of them.
    kth = near.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score")))).where(F.col("place") == k + 1).select("node", F.col("score").alias("least"))
    asking = queries.join(kth, "node", "left").select("node", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    rest = _scanned(blocks, asking, pairs.where(F.col("rank") >= max(1, probes // 8)), sent, d, k, eps)
    best = Window.partitionBy("node").orderBy(F.desc("score"), "found")
    chosen = near.unionByName(rest).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")
    many = entries.where(F.size("ids") > 1).select(F.col("node").alias("found"), "ids")
    every_id = chosen.join(many, "found", "left").select("node", "score", F.explode(F.coalesce("ids", F.array("found"))).alias("vec_id"))
    last = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "vec_id"))
    of_node = every_id.withColumn("place", last).where(F.col("place") <= k + 1).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("all"))
    # Written before it meets the queries, whose copies of one vector Spark can then split.
    of_node = keep.stored(of_node, "found")
    own = asked.withColumnRenamed("vec_id", "query_id").join(of_node, "node")
    others = F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = shared.stored(own.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score"), "nearest")
    keep.drop()
    return out


def drawn_by_hash(vectors: DataFrame, d: int, total: int, most: int) -> np.ndarray:
    """About `most` of `total` distinct vectors, those of the least hashes, in the order of these, in single precision. No sort, no task that holds more than others."""
    h = F.xxhash64("v")
    own = vectors.select(F.col("v").cast("array<float>").alias("v"), h.alias("h"))
    if total > most:
        own = own.where(h < F.lit(int(most / total * (1 << 64)) - (1 << 63)))
    got = own.toArrow()
    if not got.num_rows:
        return np.array([vectors.first()["v"]], np.float32) if total else np.empty((0, d), np.float32)
    x = np.asarray(got["v"].combine_chunks().flatten(), np.float32).reshape(-1, d)
    return x[np.argsort(np.asarray(got["h"].combine_chunks()), kind="stable")]


def measured_probes(blocks: DataFrame, queries: DataFrame, lists: Lists, d: int, k: int, reach: float, most: int = 256) -> int:
    """How many lists hold the share `reach` of the exact neighbours of up to `most` queries, taken by hash."""
    q = drawn_by_hash(queries, d, queries.count(), most).astype(np.float64)
    if not len(q):
        return 1
    sent = blocks.sparkSession.sparkContext.broadcast(q)

    def exact(batches):
        own, of = np.full((len(sent.value), k + 1), -np.inf), np.zeros((len(sent.value), k + 1), np.int64)
        for batch in batches:
            for which, n, vectors in shared.rows_of(batch, "list", "n", "vectors", at_once=16):
                score = np.concatenate([own, sent.value @ np.frombuffer(vectors, "<f8").reshape(n, d).T], axis=1)
                top = np.argpartition(score, n, axis=1)[:, n:]
                own, of = np.take_along_axis(score, top, 1), np.take_along_axis(np.concatenate([of, np.full((len(of), n), which)], axis=1), top, 1)
        i, j = np.nonzero(own > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(of[i, j]), pa.array(own[i, j])], ["query", "list", "score"])

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    found = blocks.select("list", "n", "vectors").mapInArrow(exact, "query bigint, list bigint, score double")
    found = found.withColumn("place", place).where(F.col("place") <= k + 1).select("query", "list").toPandas()  # most * (k + 1) rows
    rank = np.argsort(lists.order(q), axis=1)[found["query"].to_numpy(), found["list"].to_numpy()]
    return int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(reach * len(rank))))]) + 1 if len(rank) else 1


def _scanned(blocks: DataFrame, queries: DataFrame, pairs: DataFrame, sent, d: int, k: int, eps: float) -> DataFrame:
    """What each block of the probed lists adds to the k+1 best of its queries: node, found, score."""
    many = F.broadcast(pairs.groupBy("list").count().select("list", F.ceil(F.col("count") / GROUP).cast("int").alias("groups")))  # a row for each list
    left = blocks.join(many, "list").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    right = pairs.join(many, "list").withColumn("group", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int")).join(blocks.select("list", "block"), "list").join(queries, "node")

    def met(key, block: pa.Table, own: pa.Table) -> pa.Table:
        schema = pa.schema([("node", pa.int64()), ("found", pa.int64()), ("score", pa.float64())])
        if not block.num_rows or not own.num_rows:
            return schema.empty_table()
        q = matrix(own.column("v").combine_chunks(), d)
        turned = (q @ sent.value.turn).astype(np.float32)
        i, score, node = scan(turned, q, np.asarray(own.column("least")), *opened(block.to_pylist()[0], d), k + 1, eps)
        return pa.table([pa.array(np.asarray(own.column("node"))[i]), pa.array(node), pa.array(score)], schema=schema)

    keys = ("list", "block", "group")
    left, right = left.select(*keys, "n", "nodes", "vectors", "planes"), right.select(*(F.col(c).alias(f"to_{c}") for c in keys), "node", "v", "least")
    return left.groupBy(*keys).cogroup(right.groupBy(*(f"to_{c}" for c in keys))).applyInArrow(met, "node bigint, found bigint, score double")
