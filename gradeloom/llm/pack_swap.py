"""Packing documents into sequences: best fit, then swap-based local search.

Documents are encoded and closed by an end id; one longer than a sequence is cut into full pieces and a rest. Pieces
are dealt by a hash of document and piece into groups of about group_pieces, so one task holds one bounded group
whatever the size of the table, and a group loses at most a part of its last sequence. In a group, best fit places
pieces by falling length. Local search then takes the emptiest sequence and gives its pieces to fuller ones: by moving
one, by exchanging one for one, or two for one; every piece and every pair of pieces counts. Every step raises the sum of
squared fills; when a sequence is empty it is gone. It ends when no underfull sequence has a step left or the lower bound
(total length over capacity, rounded up) is met.

Pieces of equal length are placed by ascending doc_id, row and piece. Rows equal in id and text may change places with each other, as they
have the same pieces; which of them lies where is then a matter of the order of the input. A null or empty text is one end id. Repeated rows are packed each for itself. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import shared
from gradeloom.llm.tokens import encoder

PIECES = "doc_id long, row_no long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, style: str, end_id: int, capacity: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def pieces(batches):
        ids_of = encoder(path, style).ids
        for batch in batches:
            out = []
            for doc_id, row_no, text in shared.rows_of(batch, "doc_id", "row_no", "text"):
                ids = ids_of(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    out.append((doc_id, row_no, k, at // 4, len(own) // 4, zlib.crc32(own)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "row_no", "piece", "start", "length", "ids_crc32"])

    return pieces


def cut_pieces(docs: DataFrame, tokenizer: str, *, style: str = "whole", end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """One row per piece of a document: doc_id, row_no (tells repeated rows apart), piece, start, length, ids_crc32."""
    rows = shared.texts_of(docs, F.monotonically_increasing_id().alias("row_no"))
    return rows.mapInArrow(_cut(tokenizer, style, end_id, capacity), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers. Longest first, each into the fullest bin that has room; a bit per gap finds it at once."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = gaps >> n
        if n <= capacity and fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
            bins[b].append(i)
        elif n <= capacity:
            b, gap = len(bins), capacity
            bins.append([i])
        else:
            raise ValueError(f"an item of {n} exceeds the capacity of {capacity}")
        by_gap[gap - n].append(b)
        gaps |= 1 << (gap - n)
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empties bins into others by moves and exchanges that raise the sum of squared fills. It goes on until the lower bound
    is met or no underfull bin has a step left."""
    bin_of, fill = np.zeros(len(lengths), np.int64), np.zeros(len(bins), np.int64)
    for k, b in enumerate(bins):
        bin_of[b], fill[k] = k, int(lengths[b].sum())
    least, used, stuck = -(-int(lengths.sum()) // capacity), int((fill > 0).sum()), np.zeros(len(bins), bool)
    # Full bins have neither room nor need.
    items = np.flatnonzero(fill[bin_of] < capacity)
    while used > least:
        able = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if not len(able):
            break
        e = int(able[np.argmin(fill[able])])
        if _emptied(e, bin_of, fill, lengths, items, capacity):
            used -= 1
            stuck[:] = False
        else:
            stuck[e] = True
    order = np.argsort(bin_of, kind="stable")
    return [own.tolist() for own in np.split(order, np.flatnonzero(np.diff(bin_of[order])) + 1) if len(own)]


def _emptied(e: int, bin_of: np.ndarray, fill: np.ndarray, lengths: np.ndarray, items: np.ndarray, capacity: int) -> bool:
    """Takes the best steps from bin e until it is empty (true) or has none left. A bin holds fewer than sqrt(2 capacity)
    distinct lengths, so the sums that one or two of its items make are a small table, and the best gift for every
    item of other bins is looked up at once."""
    while fill[e]:
        own = items[bin_of[items] == e]
        others = items[(bin_of[items] != e) & (fill[bin_of[items]] < capacity)]
        open_ = np.unique(bin_of[others])
        if int((capacity - fill[open_]).sum()) < fill[e]:
            return False
        kinds, counts = np.unique(lengths[own], return_counts=True)
        one, two = np.zeros(2 * capacity + 1, np.int64), np.zeros(2 * capacity + 1, np.int64)
        one[kinds] = kinds
        two[kinds] = kinds
        pairs = (kinds[:, None] + kinds[None, :])[np.triu(np.ones((len(kinds),) * 2, bool), 1)]
        two[pairs] = pairs
        two[2 * kinds[counts > 1]] = 2 * kinds[counts > 1]
        # The largest gift of at most x tokens.
        one, two = np.maximum.accumulate(one), np.maximum.accumulate(two)
        # More tokens to the same bin gain more, so only the largest that fits counts. Moves bring nothing back.
        n = one[capacity - fill[open_]]
        gain = np.where(n > 0, n * (fill[open_] - fill[e] + n), 0)
        k = int(np.argmax(gain))
        best, step = int(gain[k]), (int(n[k]), None, int(open_[k]))
        room, size = capacity - fill[bin_of[others]], lengths[others]
        n = two[room + size]
        d = n - size
        gain = np.where(d > 0, d * (fill[bin_of[others]] - fill[e] + d), 0)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, step = int(gain[k]), (int(n[k]), int(others[k]), int(bin_of[others[k]]))
        if best <= 0:
            return False
        n, back, b = step
        for i in _making(n, own, lengths):
            bin_of[i] = b
        if back is not None:
            bin_of[back] = e
            n -= int(lengths[back])
        fill[b] += n
        fill[e] -= n
    return True


def _making(n: int, own: np.ndarray, lengths: np.ndarray) -> list[int]:
    """One or two of the items whose lengths sum to n."""
    at: dict[int, int] = {}
    for i in own.tolist():
        if int(lengths[i]) == n:
            return [i]
    for i in own.tolist():
        other = at.get(n - int(lengths[i]))
        if other is not None:
            return [other, i]
        at.setdefault(int(lengths[i]), i)
    raise ValueError("no such items")


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _pack(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "row_no", "piece"], kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        number, offset = np.empty(len(group), dtype=np.int64), np.empty(len(group), dtype=np.int64)
        for k, b in enumerate(bins):
            number[b] = k
            offset[b] = np.cumsum(lengths[b]) - lengths[b]
        group["sequence_id"] = (group["pack_group"].to_numpy() << 32) + number
        group["offset"] = offset
        return group[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return pack


def pack(pieces: DataFrame, *, capacity: int = 2048, group_pieces: int = 16_384) -> DataFrame:
    """pieces (as cut_pieces() makes them) with sequence_id and offset. The pieces are counted, so they should be stored."""
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "row_no", "piece"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(_pack(capacity), PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, *, style: str = "whole", end_id: int = 0, capacity: int = 2048, group_pieces: int = 16_384) -> DataFrame:
    pieces = shared.stored(cut_pieces(docs, tokenizer, style=style, end_id=end_id, capacity=capacity), "pieces")
    return pack(pieces, capacity=capacity, group_pieces=group_pieces)
