"""Substring deduplication with a log-structured index of window fingerprints.

A window is `window` consecutive words of one document. A word goes if a window that covers it starts, word for word,
anywhere else too. Of each window's `gram`-word spans the one with the smallest hash (the leftmost of equals) is its anchor;
equal windows have equal anchors at equal places, so a window whose anchor occurs once in all documents is unique.

The index keeps anchors' fingerprints with their counts, in immutable runs. A run is bucketed by fingerprint and sorted within its
buckets, alike for all runs of an index, so that runs meet in merge joins that neither shuffle nor sort them. A batch of
documents is reduced to a run of its own, merge-joined with the runs so far (which tells what history already holds), and
added; when `fanout` runs of one level stand, they are merged into one of the next, again without a shuffle. A manifest names the
runs; a later session opens the folder by it and goes on, and earlier texts are not needed. Removal then takes three
steps, each exact for what the one before leaves open, but for chance collisions of two 64-bit hashes (words are not compared):

1. Consecutive windows with one anchor make a stretch. Stretches whose anchor the index holds twice or more are
   candidates, all others are unique.
2. Candidates are verified by a second hash, over all words of the stretch. Stretches that are found twice are repeated.
3. What is left (edges of repeated passages, mostly) is verified window by window, by two independent 64-bit hashes, among
   itself and one witness of each repeated stretch with the same anchor.

Occurrences that one batch of rows shares are packed into one row per fingerprint before they are shuffled, so a
passage in a third of all documents is a few rows per task. A text is shuffled once to meet its marks, and once
more only if step 3 concerns it.

A null or empty text has no words. Repeated rows repeat each other's windows, and each keeps its own result; rows equal in id
and text share their marks, which are gathered once. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm import shared

#: Odd multipliers of the two polynomial hashes, modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Rolling:
    """Hashes of any span of a sequence of 64-bit word hashes, from prefix sums of h[i] / base^i (modulo 2^64)."""

    def __init__(self, h: np.ndarray, base: int):
        inverse = pow(base, -1, 1 << 64)
        self.up, down = _powers(base, len(h) + 1), _powers(inverse, len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * down[:-1], out=self.sums[1:])

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[begin]) * self.up[begin]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    own = _POWERS.get(base, np.ones(1, np.uint64))
    while len(own) < n:
        own = np.concatenate([own, own * np.uint64(pow(base, len(own), 1 << 64))])
    _POWERS[base] = own
    return own[:n]


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    out, have = values, 1
    while 2 * have <= width:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    return np.minimum(out[: len(values) - width + 1], out[width - have : len(values) - have + 1]) if width > have else out


def stretches(counts: np.ndarray, h: np.ndarray, window: int, gram: int):
    """For documents of counts[i] words, their hashes joined in h: document, first and last window start (in the document),
    anchor fingerprint and hash of all words of each stretch."""
    empty = np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - window + 1, 0))
    if not len(doc):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    begun = np.cumsum(counts) - counts
    at = shared.runs(begun, np.maximum(counts - window + 1, 0))  # of each window, among all words
    roll = Rolling(h, BASES[0])
    grams = roll.spans(np.arange(len(h) - gram + 1), np.arange(gram, len(h) + 1))
    ranked = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    place = (_smallest(ranked, window - gram + 1)[at] & np.uint64((1 << 32) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[cut[1:], len(at)] - 1
    whole = Rolling(h, BASES[1]).spans(at[cut], at[last] + window)
    return doc[cut], at[cut] - begun[doc[cut]], at[last] - begun[doc[cut]], grams[place[cut]], whole ^ (at[last] - at[cut]).astype(np.uint64)


def _batches(batches, most_words: int = 300_000):
    """(rows without their text, word counts, joined word hashes) of bounded size."""
    memo = shared.WordHash()
    rows, found, n = [], [], 0
    for batch in batches:
        for row in shared.rows_of(batch):
            own = memo.all(shared.words(row[-1]))
            rows.append(row[:-1])
            found.append(own)
            n += len(own)
            if n >= most_words:
                yield rows, np.array([len(x) for x in found], np.int64), np.concatenate(found)
                rows, found, n = [], [], 0
    if rows:
        yield rows, np.array([len(x) for x in found], np.int64), np.concatenate(found)


def _anchors(window: int, gram: int):
    def anchors(batches):
        for _, counts, h in _batches(batches):
            fp, n = np.unique(stretches(counts, h, window, gram)[3], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(n.astype(np.int64))], names=["fp", "n"])

    return anchors


RUN = "fp BIGINT, n BIGINT"


class WindowIndex:
    """Immutable runs of (fp, n), bucketed and sorted by fp, and the fp that each batch found repeated, in one folder. An index
    whose folder has a manifest goes on with its runs, window, gram and buckets."""

    def __init__(self, spark: SparkSession, folder: str | None = None, *, window: int = 35, gram: int = 8, fanout: int = 2, buckets: int | None = None):
        self.spark, self.folder, self.fanout = spark, folder or shared.new_folder(spark, "window-index"), fanout
        state = {"window": window, "gram": gram, "buckets": buckets or shared.partitions(spark), "written": 0, "runs": [], "again": []}
        self.state = self._manifest() or state
        self.window, self.gram = self.state["window"], self.state["gram"]
        self.tables: dict[str, str] = {}

    def _path(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _manifest(self) -> dict | None:
        """The newest manifest; an add() that didn't end leaves the one before it."""
        files, at = self._path("manifests")
        if not files.exists(at):
            return None
        newest = max((str(x.getPath()) for x in files.listStatus(at) if not x.getPath().getName().startswith(".")), default=None)
        return json.loads(self.spark.read.text(newest, wholetext=True).first()[0]) if newest else None

    def _commit(self) -> None:
        files, at = self._path(f"manifests/.{self.state['written']:06d}")
        out = files.create(at, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        files.rename(at, self._path(f"manifests/{self.state['written']:06d}")[1])

    @property
    def runs(self) -> list[str]:
        return [r["name"] for r in self.state["runs"]]

    def run(self, name: str) -> DataFrame:
        """A run as a bucketed table of the session."""
        if name not in self.tables:
            self.tables[name] = f"window_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.tables[name]} ({RUN}) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.state['buckets']} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(self.tables[name])

    def _merged(self, names: list[str]) -> DataFrame:
        """Sums over runs, whose buckets meet each other without a shuffle."""
        out = self.run(names[0])
        for name in names[1:]:
            more = self.run(name).withColumnRenamed("n", "more")
            out = out.hint("merge").join(more, "fp", "full").select("fp", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
        return out

    def _write(self, df: DataFrame) -> str:
        """df, one row for each fp, as a new run. One file for each bucket, so that files are sorted as a whole."""
        name = f"run-{self.state['written']:06d}-{uuid.uuid4().hex[:8]}"
        self.state["written"] += 1
        self.tables[name] = f"window_run_{uuid.uuid4().hex}"
        df.write.bucketBy(self.state["buckets"], "fp").sortBy("fp").format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(self.tables[name])
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(name)}")
        shared.dropped(self.spark, f"{self.folder}/{name}")

    def add(self, docs: DataFrame) -> DataFrame:
        """Indexes a batch of documents (doc_id, text). Returns the fp that are repeated now: those that the batch holds
        twice or more, and those that the merge join finds in the runs before it."""
        with self._sorted_scans():
            found = shared.texts_of(docs).select("text").mapInArrow(_anchors(self.window, self.gram), "fp long, n long")
            counted = found.groupBy("fp").agg(F.sum("n").alias("n"))
            if self.state["buckets"] != shared.partitions(self.spark):
                counted = counted.repartition(self.state["buckets"], "fp")
            before = self.runs
            run = self._write(counted)
            own = self.run(run)
            met = own.hint("merge").join(self._merged(before).select("fp", F.lit(True).alias("known")), "fp", "left") if before else own.withColumn("known", F.lit(None).cast("boolean"))
            name = f"again-{self.state['written']:06d}-{uuid.uuid4().hex[:8]}"
            again = shared.stored(met.where((F.col("n") > 1) | F.col("known")).select("fp"), "again", f"{self.folder}/{name}")
            self.state["runs"].append({"name": run, "level": 0})
            self.state["again"].append(name)
            old = self._compact()
            self._commit()
            for gone in old:
                self._drop(gone)
        return again

    def _compact(self) -> list[str]:
        """Merges the runs of each level that has `fanout` of them; returns the ones that are not needed any more."""
        old = []
        for level in range(64):
            own = [r for r in self.state["runs"] if r["level"] == level]
            if len(own) < self.fanout:
                continue
            merged = self._write(self._merged([r["name"] for r in own]))
            self.state["runs"] = [r for r in self.state["runs"] if r["level"] != level] + [{"name": merged, "level": level + 1}]
            old += [r["name"] for r in own]
        return old

    @contextlib.contextmanager
    def _sorted_scans(self):
        """Lets bucketed scans tell that their files are sorted."""
        key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        was = self.spark.conf.get(key, "false")
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            self.spark.conf.set(key, was)

    def repeated(self) -> DataFrame:
        """fp of the anchors that occur twice or more in all that was added."""
        paths = [f"{self.folder}/{name}" for name in self.state["again"]]
        return self.spark.read.schema("fp long").parquet(*paths).distinct() if paths else self.spark.createDataFrame([], "fp long")


STRETCH = "fp long, whole long, n int, rows binary"
_ROW = np.dtype([("row_no", "<i8"), ("text_key", "<i8"), ("a", "<i4"), ("b", "<i4")])


def _stretches(window: int, gram: int):
    def out(batches):
        for ids, counts, h in _batches(batches):
            doc, a, b, fp, whole = stretches(counts, h, window, gram)
            order = np.lexsort((whole, fp))
            doc, a, b, fp, whole = (x[order] for x in (doc, a, b, fp, whole))
            rows = np.empty(len(doc), _ROW)
            rows["row_no"], rows["text_key"] = np.array([i[0] for i in ids], np.int64)[doc], np.array([i[1] for i in ids], np.int64)[doc]
            rows["a"], rows["b"] = a, b
            cut = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (whole[1:] != whole[:-1])]) if len(doc) else np.empty(0, np.int64)
            ends = np.r_[cut[1:], len(doc)] if len(doc) else cut
            data, size = rows.tobytes(), _ROW.itemsize
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp[cut].view(np.int64)), pa.array(whole[cut].view(np.int64)), pa.array((ends - cut).astype(np.int32)), pa.array([data[size * x : size * z] for x, z in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary())],
                names=["fp", "whole", "n", "rows"],
            )

    return out


MARKS = "row_no long, text_key long, a int, b int, open boolean"


def _unpacked(batches):
    """A mark per occurrence: repeated stretches (open: false), and open ones or witnesses (open: true)."""
    for batch in batches:
        found, opens = [], []
        for data, repeated, witness in zip(*(batch.column(c).to_pylist() for c in ("rows", "repeated", "witness")), strict=True):
            own = np.frombuffer(data, _ROW)
            if repeated:
                found.append(own)
                opens.append(np.zeros(len(own), bool))
            if not repeated or witness:
                found.append(own[:1] if repeated else own)
                opens.append(np.ones(len(found[-1]), bool))
        rows = np.concatenate(found) if found else np.empty(0, _ROW)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[c])) for c in ("row_no", "text_key", "a", "b")), pa.array(np.concatenate(opens) if opens else np.empty(0, bool))], names=["row_no", "text_key", "a", "b", "open"])


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
CHECKED = f"row_no long, text_key long, {RESULT}, text string, gone binary, windows binary"
_WIN = np.dtype([("x", "<i8"), ("y", "<i8"), ("at", "<i4")])


def _kept(found: list[bytes], gone: np.ndarray) -> tuple[int, str, str]:
    left = [w for w, g in zip(found, gone.tolist(), strict=True) if not g] if gone.any() else found
    joined = b" ".join(left)
    return len(found) - len(left), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass")


def _cover(n: int, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the windows that start from first to last cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last + window, -1)
    return np.cumsum(step)[:n] > 0


def _marked(window: int, keep_text: bool):
    """Applies the marks. A row that has open windows left keeps its text and these windows' hashes for step 3."""

    def out(batches):
        memo = shared.WordHash()
        for batch in batches:
            rows = []
            for row_no, key, doc_id, text, marks in shared.rows_of(batch, "row_no", "text_key", "doc_id", "text", "marks"):
                found = shared.words(text)
                marks = marks or []
                done = [(m["a"], m["b"]) for m in marks if not m["open"]]
                gone = _cover(len(found), *np.array(done, np.int64).reshape(-1, 2).T, window)
                opens = [(m["a"], m["b"]) for m in marks if m["open"]]
                if not opens:
                    n, sha, kept = _kept(found, gone)
                    rows.append((row_no, key, doc_id, len(found), n, sha, (kept if n else text) if keep_text else None, None, None, None))
                    continue
                first, last = np.array(opens, np.int64).reshape(-1, 2).T
                at = np.unique(shared.runs(first, last - first + 1))
                h = memo.all(found)
                wins = np.empty(len(at), _WIN)
                for name, base in zip("xy", BASES, strict=True):
                    wins[name] = Rolling(h, base).spans(at, at + window).view(np.int64)
                wins["at"] = at
                rows.append((row_no, key, doc_id, len(found), None, None, None, text, np.packbits(gone).tobytes(), wins.tobytes()))
            kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [[]] * 10
            names = ["row_no", "text_key", "doc_id", "n_words", "n_removed", "kept_sha256", "kept", "text", "gone", "windows"]
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*made, batch.column("carried")], names=[*names, "carried"])

    return out


def _windows(batches):
    """x, y, n, rows: the open windows, those of one batch of rows packed by their hashes."""
    for batch in batches:
        parts = [np.frombuffer(data, _WIN) for data in batch.column("windows").to_pylist()]
        who = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        wins = np.concatenate([np.empty(0, _WIN), *parts])
        order = np.lexsort((wins["y"], wins["x"]))
        wins, who = wins[order], who[order]
        cut = np.flatnonzero(np.r_[True, (wins["x"][1:] != wins["x"][:-1]) | (wins["y"][1:] != wins["y"][:-1])]) if len(wins) else np.empty(0, np.int64)
        ends = np.r_[cut[1:], len(wins)] if len(wins) else cut
        rows = np.empty(len(wins), _ROW)
        rows["row_no"], rows["text_key"] = batch.column("row_no").to_numpy()[who], batch.column("text_key").to_numpy()[who]
        rows["a"], rows["b"] = wins["at"], wins["at"]
        data, size = rows.tobytes(), _ROW.itemsize
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(wins["x"][cut])), pa.array(np.ascontiguousarray(wins["y"][cut])), pa.array((ends - cut).astype(np.int32)), pa.array([data[size * a : size * z] for a, z in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary())],
            names=["x", "y", "n", "rows"],
        )


def _finished(window: int, keep_text: bool):
    def out(batches):
        for batch in batches:
            rows = []
            for doc_id, text, gone, at in shared.rows_of(batch, "doc_id", "text", "gone", "at"):
                found = shared.words(text)
                all_gone = np.unpackbits(np.frombuffer(gone, np.uint8), count=len(found)).astype(bool)
                at = np.array(at or [], np.int64)
                all_gone |= _cover(len(found), at, at, window)
                n, sha, kept = _kept(found, all_gone)
                rows.append((doc_id, len(found), n, sha, (kept if n else text) if keep_text else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (*[pa.int64()] * 3, pa.string(), pa.string())
            made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*made, batch.column("carried")], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "carried"])

    return out


def remove_repeats(docs: DataFrame, *, window: int = 35, gram: int = 8, batches: int = 2, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with keep_text, kept (the words that stay, joined by blanks; the text as it was
    if all stay) and the columns named in carry. A name that the result has itself (doc_id, n_words, n_removed, kept_sha256, kept) can't be carried.

    docs are indexed in `batches` batches. Rows are told apart by two 64-bit hashes of id and text: rows with the same id and
    text have the same words to lose."""
    if clash := {"doc_id", "n_words", "n_removed", "kept_sha256", "kept"} & {c.lower() for c in carry}:
        raise ValueError(f"{sorted(clash)} are columns of the result")
    spark = docs.sparkSession
    key = ["row_no", "text_key"]
    carried = F.struct(*carry) if carry else F.lit(None).cast("int")
    rows = shared.texts_of(docs, carried.alias("carried")).withColumns({"row_no": F.xxhash64("doc_id", "text"), "text_key": F.xxhash64(F.lit(35), "text", F.coalesce("doc_id", F.lit(-1)))}).select(*key, "doc_id", "text", "carried")
    index = WindowIndex(spark, window=window, gram=gram)
    for k in range(batches):
        index.add(rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)) == k))
    # Step 1: of all stretches, those with a repeated anchor. Both sides are one row per fingerprint and batch of rows.
    found = rows.select(*key, "text").mapInArrow(_stretches(window, gram), STRETCH).join(index.repeated(), "fp", "left_semi")
    # Step 2: counts over each stretch's hash, and whether its anchor has a stretch that occurs once.
    same = Window.partitionBy("fp", "whole")
    counted = found.withColumn("all", F.sum("n").over(same)).withColumn("nth", F.row_number().over(same.orderBy("rows")))
    counted = counted.withColumn("some_open", F.max(F.col("all") == 1).over(Window.partitionBy("fp")))
    told = counted.select("rows", (F.col("all") > 1).alias("repeated"), ((F.col("nth") == 1) & F.col("some_open")).alias("witness"))
    marks = told.mapInArrow(_unpacked, MARKS).groupBy(*key).agg(F.collect_set(F.struct("a", "b", "open")).alias("marks"))
    marked = rows.join(marks, key, "left").select(*key, "doc_id", "text", "marks", "carried")
    with_carried = lambda ddl: T.StructType([*T.StructType.fromDDL(ddl), rows.schema["carried"]])
    checked = shared.stored(marked.mapInArrow(_marked(window, keep_text), with_carried(CHECKED)), "checked")
    closed = checked.where("windows is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "kept", "carried")
    # Step 3.
    left = checked.where("windows is not null").select(*key, "doc_id", "text", "gone", "windows", "carried")
    pairs = left.select(*key, "windows").mapInArrow(_windows, "x long, y long, n int, rows binary")
    twice = pairs.withColumn("all", F.sum("n").over(Window.partitionBy("x", "y"))).where(F.col("all") > 1)
    last = twice.select("rows", F.lit(True).alias("repeated"), F.lit(False).alias("witness")).mapInArrow(_unpacked, MARKS).groupBy(*key).agg(F.collect_set("a").alias("at"))
    done = left.join(last, key, "left").select("doc_id", "text", "gone", "at", "carried").mapInArrow(_finished(window, keep_text), with_carried(RESULT))
    out = closed.unionByName(done)
    return out.select("*", "carried.*").drop("carried") if carry else out.drop("carried")
