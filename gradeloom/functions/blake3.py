"""BLAKE3 over batches of byte strings: all chunks of a batch are compressed side by side, then all parents of a level."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the published specification: initial state, order of the words in the next round, sizes, flags.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK, BLOCK, ROUNDS = 1024, 64, 7
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
#: Places of the state that a step of a round mixes: columns, then diagonals.
STEPS = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15)), ((0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))
#: Bytes of messages that are hashed side by side.
AT_ONCE = 1 << 22


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _compressed(chaining: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values of n blocks: (n, 8) from (n, 8) and (n, 16)."""
    n, m = len(words), list(words.T)
    v = [*chaining.T, *(np.full(n, x, np.uint32) for x in IV[:4]), (counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)]
    for _ in range(ROUNDS):
        for half, places in enumerate(STEPS):
            for k, (a, b, c, d) in enumerate(places):
                for word, one, other in ((m[8 * half + 2 * k], 16, 12), (m[8 * half + 2 * k + 1], 8, 7)):
                    v[a] = v[a] + v[b] + word
                    v[d] = _turned(v[d] ^ v[a], one)
                    v[c] = v[c] + v[d]
                    v[b] = _turned(v[b] ^ v[c], other)
        m = [m[k] for k in ORDER]
    return np.stack([v[k] ^ v[k + 8] for k in range(8)], axis=1)


def _chunks(messages: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chaining values of all chunks, one message after the other, and the number of chunks of each; of a message of one chunk, its root."""
    sizes = np.array([len(x) for x in messages], np.int64)
    counts = np.maximum(1, -(-sizes // CHUNK))
    of = np.repeat(np.arange(len(messages)), counts)
    number = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    left = np.minimum(sizes[of] - number * CHUNK, CHUNK)
    padded = b"".join(x + bytes(int(n) * CHUNK - len(x)) for x, n in zip(messages, counts, strict=True))
    words = np.frombuffer(padded, "<u4").reshape(len(of), CHUNK // BLOCK, 16)
    blocks = np.maximum(1, -(-left // BLOCK))
    out = np.tile(np.array(IV, np.uint32), (len(of), 1))
    for b in range(int(blocks.max(initial=0))):
        own = np.flatnonzero(blocks > b)
        last = blocks[own] == b + 1
        flags = CHUNK_START * (b == 0) + CHUNK_END * last + ROOT * (last & (counts[of[own]] == 1))
        out[own] = _compressed(out[own], words[own, b], number[own], np.where(last, left[own] - b * BLOCK, BLOCK), flags)
    return out, counts


def digests(messages: Sequence[bytes]) -> list[bytes]:
    """32 bytes for each message. Neighbours of a level have a parent; one that is left over goes up as it is."""
    if not len(messages):
        return []
    nodes, counts = _chunks(messages)
    while (counts > 1).any():
        begun = np.cumsum(counts) - counts
        parents = counts // 2
        of = np.repeat(np.arange(len(counts)), parents)
        at = begun[of] + 2 * (np.arange(len(of)) - np.repeat(np.cumsum(parents) - parents, parents))
        flags = PARENT + ROOT * (counts[of] == 2)
        zero = np.zeros(len(of), np.int64)
        made = _compressed(np.tile(np.array(IV, np.uint32), (len(of), 1)), np.concatenate([nodes[at], nodes[at + 1]], axis=1), zero, zero + BLOCK, flags)
        above = parents + counts % 2
        fresh = np.empty((int(above.sum()), 8), np.uint32)
        first = np.cumsum(above) - above
        fresh[first[of] + (at - begun[of]) // 2] = made
        odd = np.flatnonzero(counts % 2)
        fresh[first[odd] + parents[odd]] = nodes[begun[odd] + counts[odd] - 1]
        nodes, counts = fresh, above
    return [x.tobytes() for x in nodes.astype("<u4")]


def in_groups(messages: Sequence[bytes | None]) -> list[bytes | None]:
    """Digests of a batch, a bounded number of bytes (or one message) at a time; null for null."""
    out: list[bytes | None] = [None] * len(messages)
    group: list[int] = []
    size = 0
    for i, x in enumerate(messages):
        if x is None:
            continue
        if group and size + len(x) > AT_ONCE:
            for k, h in zip(group, digests([messages[k] for k in group]), strict=True):
                out[k] = h
            group, size = [], 0
        group.append(i)
        size += max(len(x), CHUNK)
    for k, h in zip(group, digests([messages[k] for k in group]), strict=True):
        out[k] = h
    return out


@F.pandas_udf(T.BinaryType())
def _hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series(in_groups([None if x is None else bytes(x) for x in batch]), dtype=object)


def blake3(value: Column) -> Column:
    """The digest of a text (its UTF-8) or binary column in lower-case hexadecimal digits; null for null."""
    return F.lower(F.hex(_hashed(value.cast("binary"))))
