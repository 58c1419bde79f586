"""Document fingerprints from prefix polynomial hashes.

A text's prefix array holds, for each position, the polynomial hash of everything before it, modulo the prime
2^31 - 1 and for two bases. Two spans are equal if their hashes, taken from the arrays by one subtraction and one
multiplication, are; the longest common extension of two positions is found by binary search over spans.

A fingerprint cuts the text into spans by its content and holds the spans' hashes (one subtraction in the prefix array, and a multiplication that
takes the place away) with their sizes, besides the length and the whole text's pair of hashes. Every place is a cut of level 0; a
cut whose four code points have a lesser hash than its neighbours' of the same level is one of the next level. So cuts come back behind an edit
at any offset, and a text takes the first level at which it has at most about SPANS spans: single code points in short texts. Equal texts have equal fingerprints. Likeness needs no
text: both fingerprints are brought to the coarser one's level (cuts tell theirs, and hashes of neighbouring spans add up), and their spans are
matched in order, by longest common extensions (binary search over prefix hashes of the spans) from one place where they are equal again to the
next. It is the share of the longer text that matched spans cover: 1 for equal texts (two empty ones too), 0 if only one is empty. Texts whose
levels lie more than ABOVE apart (one is over nine times longer) meet at cuts that are too fine for it, and count as less alike than they are.

Null texts count as empty. Rows follow each other by ascending doc_id (null ids first), repeated rows by text; the one
after the last is the first. With a single row, it follows itself. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import shared

P = np.uint64((1 << 31) - 1)
BASES = (911_382_323, 972_663_749)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^62."""
    out = x & P
    high = x >> np.uint64(31)
    out += high
    np.right_shift(out, np.uint64(31), out=high)
    out &= P
    out += high
    np.subtract(out, P, out=out, where=out >= P)
    return out


class Powers:
    """Powers of the bases, as far as they have been asked for."""

    def __init__(self):
        self.rows, self.back = [np.ones(1, dtype=np.uint64) for _ in BASES], np.ones(1, dtype=np.uint64)

    def __call__(self, n: int) -> list[np.ndarray]:
        while len(self.rows[0]) <= n:
            for k, base in enumerate(BASES):
                self.rows[k] = self._doubled(self.rows[k], base)
        return self.rows

    def inverse(self, n: int) -> np.ndarray:
        """Powers of the first base's inverse."""
        while len(self.back) <= n:
            self.back = self._doubled(self.back, pow(BASES[0], -1, int(P)))
        return self.back

    @staticmethod
    def _doubled(own: np.ndarray, base: int) -> np.ndarray:
        return np.concatenate([own, _mod(own * np.uint64(pow(base, len(own), int(P))))])


class Prefixes:
    """Prefix hashes of one text: at(i) is the sum over j < i of (code point j + 1) * base^j."""

    def __init__(self, codes: np.ndarray, powers: Powers, arrays: list[np.ndarray] | None = None, bases: int = len(BASES)):
        self.n, self.codes, self.powers = len(codes), codes, powers
        if arrays is None:
            wide, arrays = codes.astype(np.uint64) + np.uint64(1), []
            for row in powers(self.n)[:bases]:
                terms = np.zeros(self.n + 1, dtype=np.uint64)
                terms[1:] = _mod(wide * row[: self.n])
                # Sums of up to 2^33 terms below 2^31 fit.
                arrays.append(_mod(np.cumsum(terms, dtype=np.uint64)))
        self.arrays = arrays

    def replaced_from(self, keep: int, other: Prefixes, n: int) -> Prefixes:
        """The prefixes of this text's first keep code points followed by the other's first n, from both arrays."""
        rows = self.powers(keep)
        arrays = [np.concatenate([a[: keep + 1], _mod(a[keep] + _mod(o[1 : n + 1] * r[keep]))]) for a, o, r in zip(self.arrays, other.arrays, rows, strict=True)]
        return Prefixes(np.concatenate([self.codes[:keep], other.codes[:n]]), self.powers, arrays)

    def equal(self, i: int, other: Prefixes, j: int, n: int) -> bool:
        """Whether the spans of n code points from i here and from j there are equal."""
        rows = self.powers(max(i, j))
        p = int(P)
        return all(((int(a[i + n]) - int(a[i])) * int(r[j]) - (int(o[j + n]) - int(o[j])) * int(r[i])) % p == 0 for a, o, r in zip(self.arrays, other.arrays, rows, strict=False))

    def extension(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension from i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, other, j, mid) else (low, mid - 1)
        return low

    def extension_back(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension that ends before i here and before j there."""
        low, high = 0, min(i, j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i - mid, other, j - mid, mid) else (low, mid - 1)
        return low

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans from begin to end, each as if it stood at the beginning of a text."""
        own = self.arrays[0]
        return _mod(_mod(own[end] + (P - own[begin])) * self.powers.inverse(self.n)[begin])

    def fingerprint(self) -> str:
        places, levels = cuts(self.codes, level_of(self.n))
        begin = np.concatenate([[0], places])
        end = np.concatenate([places, [self.n]])
        sample = np.empty(len(begin) if self.n else 0, ENTRY)
        if self.n:
            sample["hash"], sample["size"], sample["level"] = self.spans(begin, end), end - begin, 255
            sample["level"][1:] = levels
        return f"{self.n:x}." + "".join(f"{int(a[self.n]):08x}" for a in self.arrays) + "." + base64.b64encode(sample.tobytes()).decode()


#: Spans of a fingerprint, at most about so many; levels above its own that a fingerprint tells of its cuts; the longest span.
SPANS, ABOVE, LONGEST = 1024, 2, (1 << 16) - 1
#: Equal spans, one after the other, by which two texts go on together after a difference.
AGAIN = 4
#: Odd multipliers of the four code points around a place, and of what they make.
HASH = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9], np.uint64)
ENTRY = np.dtype([("hash", ">u4"), ("size", ">u2"), ("level", "u1")])


def level_of(n: int) -> int:
    """The least level of which n holds at most SPANS spans: spans of a level are three times as long as those below it."""
    level = 0
    while n > SPANS * 3**level:
        level += 1
    return level


def cuts(codes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where spans begin, and the level of each (up to ABOVE over the given one). Every place is a cut of level 0, with a hash of the four
    code points around it; cuts whose hash is less than that of their neighbours of the same level are cuts of the next (of equal
    neighbours the left one counts as less)."""
    n = len(codes)
    wide = np.zeros(n + 3, np.uint64)
    wide[2:-1] = codes
    h = wide[:n] * HASH[0]
    for k in (1, 2, 3):
        h += wide[k : k + n] * HASH[k]
    h ^= h >> np.uint64(29)
    h *= HASH[4]
    levels, own = np.zeros(n, np.uint8), np.arange(1, n)
    for k in range(1, level + ABOVE + 1):
        v = h[own]
        less = np.ones(len(own), bool)
        less[1:] &= v[1:] < v[:-1]
        less[:-1] &= v[:-1] <= v[1:]
        own = own[less]
        levels[own] = k
    places = np.flatnonzero(levels[1:] >= level) + 1
    begun = np.concatenate([[0], places, [n]])
    longest = min(LONGEST, 16 * 3**level)
    if len(begun) and (np.diff(begun) > longest).any():  # such spans are cut by length, from where they begin
        more = np.concatenate([np.arange(x + longest, y, longest) for x, y in zip(begun[:-1], begun[1:], strict=True)])
        levels[more] = 254
        places = np.union1d(places, more)
    return places, levels[places]


def opened(fingerprint: str) -> tuple[int, np.ndarray]:
    """Length and spans of a fingerprint."""
    length, _, sample = fingerprint.split(".")
    return int(length, 16), np.frombuffer(base64.b64decode(sample), ENTRY)


def at_level(spans: np.ndarray, level: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and sizes of the spans between cuts of a level; the hash of joined spans follows from theirs."""
    first = np.flatnonzero(spans["level"] >= level)
    sizes = spans["size"].astype(np.int64)
    if len(first) == len(spans):
        return spans["hash"].astype(np.uint64), sizes
    total = np.cumsum(sizes)
    before = total - sizes
    of = np.searchsorted(first, np.arange(len(spans)), side="right") - 1
    shifted = _mod(spans["hash"].astype(np.uint64) * powers(int(total[-1]))[0][before - before[first[of]]])
    return _mod(np.add.reduceat(shifted, first)), np.add.reduceat(sizes, first)


def _runs_of(keys: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` keys, one after the other."""
    n = max(0, len(keys) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out + keys[k : k + n]) * HASH[k]
        out ^= out >> np.uint64(29)
    return out


def matched(mine: np.ndarray, other: np.ndarray, powers: Powers) -> list[tuple[int, int, int]]:
    """Stretches (place here, place there, length) of equal spans, in the order of both (but for the first): a longest common extension by binary search
    over the prefix hashes of the two sequences, then on to the nearest two places from which AGAIN spans are equal; single ones (of a code point,
    in short texts) would be chance. Spans that both end with are taken first."""
    most = min(len(mine), len(other))
    differ = np.flatnonzero(mine[len(mine) - most :] != other[len(other) - most :])
    tail = most - 1 - int(differ[-1]) if len(differ) else most
    out = [(len(mine) - tail, len(other) - tail, tail)] if tail else []
    mine, other = mine[: len(mine) - tail], other[: len(other) - tail]
    again, prefixes = max(1, min(AGAIN, len(mine), len(other))), []
    ours, its = (_runs_of(x, again) for x in (mine, other))
    # Where each run of ours begins among theirs, which are put in order once; most texts have few in common.
    order = np.argsort(its, kind="stable")
    ordered = its[order]
    low, high = np.searchsorted(ordered, ours, side="left"), np.searchsorted(ordered, ours, side="right")
    shared_runs = np.flatnonzero(high > low)
    at, low, high, order = shared_runs.tolist(), low[shared_runs].tolist(), high[shared_runs].tolist(), order.tolist()
    i = j = first = 0
    while i < len(mine) and j < len(other):
        if mine[i] == other[j]:
            n = 1
            if i + 1 < len(mine) and j + 1 < len(other) and mine[i + 1] == other[j + 1]:  # worth a search
                prefixes = prefixes or [Prefixes(x.astype(np.uint32), powers, bases=1) for x in (mine, other)]  # of hashes, so one base
                n = prefixes[0].extension(i, prefixes[1], j)
            out.append((i, j, n))
            i, j = i + n, j + n
            continue
        best = None
        first = bisect.bisect_left(at, i, first)
        for q in range(first, len(at)):
            if best is not None and at[q] - i >= best[0]:
                break
            k = bisect.bisect_left(order, j, low[q], high[q])
            if k < high[q] and (best is None or at[q] - i + order[k] - j < best[0]):
                best = (at[q] - i + order[k] - j, at[q], order[k])
        if best is None or not best[0]:
            break
        _, i, j = best
    return out


def likeness(fingerprint: str, other: str, powers: Powers | None = None) -> float:
    """The share of the longer text that equal spans cover, from the two fingerprints alone."""
    if fingerprint == other:
        return 1.0
    powers = powers or Powers()
    (n, own), (m, its) = opened(fingerprint), opened(other)
    if not n or not m:
        return 0.0
    level = max(level_of(n), level_of(m))
    (a, sizes), (b, other_sizes) = at_level(own, level, powers), at_level(its, level, powers)
    # The size is part of what must be equal.
    key = lambda h, size: _mod(h + _mod(size.astype(np.uint64) * np.uint64(0x2545F491)))
    covered = sum(int(sizes[i : i + k].sum()) for i, _, k in matched(key(a, sizes), key(b, other_sizes), powers))
    return min(covered, n, m) / max(n, m)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches):
    """Rows of each part in order, then copies of the row that follows the part, of which the first counts."""
    powers, held, part, done = Powers(), None, None, False

    def judged(row, after):
        (doc_id, text, own, mine), (_, next_text, next_own, nexts) = row, after
        n = own.n
        m = min(n // 4, next_own.n) if n // 4 else 0
        edited = own.replaced_from(n - n // 4, next_own, m)
        sha = hashlib.sha256((text[: n - n // 4] + next_text[:m]).encode("utf-8", "surrogatepass")).hexdigest()
        its = edited.fingerprint()
        return doc_id, n, sha, mine, its, likeness(mine, its, powers), likeness(mine, nexts, powers)

    for batch in batches:
        out = []
        for p, copy, doc_id, text in shared.rows_of(batch, "part", "copy", "doc_id", "text"):
            if p == part and done:
                continue
            if p != part:
                part, held, done = p, None, False
            own = Prefixes(codes_of(text), powers)
            row = (doc_id, text, own, own.fingerprint())
            if held is not None:
                out.append(judged(held, row))
            held, done = row, copy
        columns = list(zip(*out, strict=True)) or [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprints(docs: DataFrame, *, rows_per_part: int = 2_048) -> DataFrame:
    """Fingerprints of each text and of its edited text (the last quarter replaced by the next text's beginning)."""
    spark = docs.sparkSession
    bounds = shared.part_bounds(docs, rows_per_part)
    part = shared.part_of(bounds)
    # One row for each part: its first id, which the part before it needs too.
    firsts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part")).groupBy("part").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("has_null")).orderBy("part").collect()
    before = [(None if r["has_null"] else r["first"], firsts[k - 1]["part"]) for k, r in enumerate(firsts)]
    copies = spark.createDataFrame(before, "first_id long, part_before long")
    rows = shared.texts_of(docs, part.alias("part"))
    marked = rows.join(F.broadcast(copies), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    both = F.when(F.col("part_before").isNull(), F.array(F.struct("part", F.lit(False).alias("copy")))).otherwise(
        F.array(F.struct("part", F.lit(False).alias("copy")), F.struct(F.col("part_before").alias("part"), F.lit(True).alias("copy")))
    )
    dealt = marked.select("doc_id", "text", F.explode(both).alias("at")).select("at.part", "at.copy", "doc_id", "text")
    return shared.in_order(dealt, "copy", "doc_id", "text").mapInArrow(_pairs, RESULT)
