"""Language-model scoring: a gated recurrent network with a class-factored output, trained and run in numpy.

Words are counted over all training documents (every word, every document). The n_head most frequent ones (as many as
head_words() gives, which grows with the corpus) are head words, dealt by falling count into classes of equal sums of
root counts, so that frequent words lie in small classes; head words are among the most_sent words that are broadcast, so with the default of
200,000 they stop growing from 625 million training tokens on (raise most_sent with the memory of driver and executors: a head word takes some 150
bytes there), and the share of tokens beyond them, 1 - sum(word_counts) / total of a Vocabulary, is what the tails score. Every other word belongs to one of n_tail tail classes by its last
two bytes. Classes lie in groups, about as many as a group has classes. The network predicts the next token's group, P(group | state), its class
in there, P(class | group, state), then the word: by a softmax over the class's words, or
in a tail class by the smoothed count (c + 0.1) / (N_class + 0.1 * (V_class + 1)), where a word that training never saw has
c = 0; within a tail class the state decides nothing. So each document gets the log10 probability of its complete text and
end; its state runs through all its windows, however long it is.

Training is truncated backpropagation through windows of `steps` tokens with the state carried over; a window in which few documents are left
counts by its tokens. The weights are fitted
on all training documents at every size: in each round, replicas train on disjoint documents, and their weights are averaged.
Replicas follow the stored parts of the corpus, so their number grows with it; their weights are averaged in a tree. Words of equal counts are ordered by
their hash. The order of training follows the stored parts: scores of reruns agree where these are the same, else but for what another order does.

Texts are encoded once; training and scoring read the ids. Counts of words outside the most_sent most frequent are not
broadcast; they meet their documents in a join on the word's 64-bit hash. A null or empty text is its end alone. Repeated rows
are scored each for itself (and count as often in training). Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import shared

END = b" end"  # no word holds a blank
#: Rows of scores that are made at a time, so that they stay in a core's cache.
BLOCK = 256
BUFFER = 1 << 20


@dataclass
class Vocabulary:
    """What is sent to the tasks: hashes of the most frequent words (ascending), their counts, their head places."""

    hashes: np.ndarray
    counts: np.ndarray
    head: np.ndarray  # place among the head words, or -1
    tails: np.ndarray  # tail class (0 for the end, which is a head word)
    starts: np.ndarray  # the first place of each class of head words, and behind the last one
    n_tail: int
    total: int
    distinct: int
    tail_total: np.ndarray  # N of each tail class
    tail_distinct: np.ndarray
    word_counts: np.ndarray  # of the head words, by place

    def __post_init__(self):
        self.n_head, self.n_classes = int(self.starts[-1]), len(self.starts) - 1
        #: Class of each id: head words by place, then tail classes.
        self.class_of = np.concatenate([np.repeat(np.arange(self.n_classes), np.diff(self.starts)), self.n_classes + np.arange(self.n_tail)])
        #: Classes, tail classes last, lie in about as many groups as a group has classes.
        n = self.n_classes + self.n_tail
        groups = np.linspace(0, n, max(1, round(math.sqrt(n))) + 1).astype(np.int64)
        self.group_of = np.repeat(np.arange(len(groups) - 1), np.diff(groups))
        #: For each softmax of a level (groups, classes of a group, words of a class) its first row of weights, and the end.
        self.levels = {"wg": np.array([0, len(groups) - 1]), "wc": groups, "ww": np.asarray(self.starts)}

    @property
    def class_counts(self) -> np.ndarray:
        return np.concatenate([np.add.reduceat(self.word_counts, self.starts[:-1]), self.tail_total])


def head_words(total: int) -> int:
    """How many head words a corpus of so many tokens gets."""
    return max(2_048, 8 * math.isqrt(total))


def class_starts(word_counts: np.ndarray, n_classes: int | None = None) -> np.ndarray:
    """Cuts words of falling counts into classes of about equal sums of root counts."""
    n_classes = n_classes or max(1, round(0.6 * math.sqrt(len(word_counts))))
    mass = np.cumsum(np.sqrt(word_counts))
    which = np.minimum(((mass - np.sqrt(word_counts) / 2) / mass[-1] * n_classes).astype(np.int64), n_classes - 1)
    return np.r_[np.flatnonzero(np.r_[True, which[1:] != which[:-1]]), len(word_counts)]


def tail_class(word: bytes, n_tail: int) -> int:
    return (word[-1] * 31 + word[-2 if len(word) > 1 else -1]) % n_tail


def _split(batch: pa.RecordBatch, most_bytes: int = 8 << 20):
    """Parts of a batch with texts of about most_bytes (a longer text alone): the part, its different words, lower-cased, and for
    each token of its texts, one after the other, which of these it is; and how many tokens each text has."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    k = 0
    while k < batch.num_rows:
        end = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most_bytes, side="right")))
        part = batch.slice(k, end - k)
        # Splits at exactly the white space that WORD leaves out, with an empty word before the first or behind the last one.
        found = pc.ascii_split_whitespace(pc.ascii_lower(part.column("text")))
        flat, sizes = found.flatten(), pc.list_value_length(found).to_numpy(zero_copy_only=False).astype(np.int64)
        there = pc.greater(pc.binary_length(flat), 0)
        if not pc.all(there).as_py():
            kept = np.r_[0, np.cumsum(there.to_numpy(zero_copy_only=False), dtype=np.int64)]
            flat, at = flat.filter(there), np.cumsum(sizes)
            sizes = kept[at] - kept[at - sizes]
        coded = flat.dictionary_encode()
        yield part, coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), sizes
        k = end
    # Workers live from stage to stage; what Arrow holds of earlier batches goes back to the system.
    pa.default_memory_pool().release_unused()


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Lookup:
    """Words' rows in ids, base and tail: that of a sent word, or behind those one for each tail class (base and tail nan: its
    count isn't known here)."""

    def __init__(self, v: Vocabulary):
        self.sent, self.n_sent, self.n_tail = v.hashes, len(v.hashes), v.n_tail
        classes = np.arange(v.n_tail)
        log_c, unknown = np.log10(v.counts + 0.1), np.full(v.n_tail, np.nan)
        self.ids = np.concatenate([np.where(v.head >= 0, v.head, v.n_head + v.tails), v.n_head + classes]).astype(np.int32)
        self.base = np.concatenate([log_c - np.log10(v.total + 0.1 * (v.distinct + 1)), unknown])
        within = log_c - np.log10(v.tail_total + 0.1 * (v.tail_distinct + 1))[v.tails]
        self.tail = np.concatenate([np.where(v.head >= 0, 0.0, within), unknown])

    def rows(self, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.sent, hashes)
        there = at < self.n_sent
        there[there] = self.sent[at[there]] == hashes[there]
        for i in np.flatnonzero(~there).tolist():
            at[i] = self.n_sent + tail_class(words[i], self.n_tail)
        return at


class Weights:
    """Input projections x (one row per head word and tail class, and one for the start), recurrent u, outputs wg of groups, wc of
    classes and ww of words. The last column of outputs is the bias."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays

    @staticmethod
    def start(v: Vocabulary, hidden: int, seed: int = 11) -> Weights:
        rng = np.random.default_rng(seed)
        counts = v.word_counts + 0.1
        within = np.log(counts / np.add.reduceat(counts, v.starts[:-1])[v.class_of[: v.n_head]])
        p = (v.class_counts + 0.5) / (v.class_counts + 0.5).sum()
        of_group = np.add.reduceat(p, v.levels["wc"][:-1])
        a = {
            "x": rng.normal(size=(v.n_head + v.n_tail + 1, 3 * hidden)) * 0.1,
            "u": rng.normal(size=(hidden, 3 * hidden)) * (0.5 / np.sqrt(hidden)),
            "wg": np.c_[rng.normal(size=(len(of_group), hidden)) * 0.02, np.log(of_group)],
            "wc": np.c_[rng.normal(size=(len(p), hidden)) * 0.02, np.log(p / of_group[v.group_of])],
            "ww": np.c_[rng.normal(size=(v.n_head, hidden)) * 0.02, within],
        }
        return Weights({k: x.astype(np.float32) for k, x in a.items()})

    def dump(self) -> bytes:
        return b"".join(a.tobytes() for a in self.arrays.values())

    def like(self, data: bytes) -> Weights:
        out, at = {}, 0
        for k, a in self.arrays.items():
            out[k] = np.frombuffer(data, np.float32, a.size, at).reshape(a.shape).copy()
            at += a.nbytes
        return Weights(out)


class Lanes:
    """Documents dealt to lanes, longest first to the shortest lane, each document in one lane; longer lanes come first.
    targets[t, lane] (-1: none), inputs (the token before, or the start), keep (0 where a document begins), place[t, lane]:
    the token's place in the joined documents."""

    def __init__(self, docs: list[np.ndarray], n_lanes: int, start_id: int):
        n_lanes = max(1, min(n_lanes, len(docs)))
        load, own = [(0, k) for k in range(n_lanes)], [[] for _ in range(n_lanes)]
        self.begun = np.cumsum([0, *(len(d) for d in docs)])
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            n, k = heapq.heappop(load)
            own[k].append(i)
            heapq.heappush(load, (n + len(docs[i]), k))
        order = [k for _, k in sorted(load, reverse=True)]
        self.lengths = np.array([n for n, _ in sorted(load, reverse=True)])
        place = np.full((n_lanes, int(self.lengths[0])), -1, dtype=np.int32)
        for lane, k in enumerate(order):
            at = 0
            for i in own[k]:
                place[lane, at : at + len(docs[i])] = np.arange(self.begun[i], self.begun[i + 1])
                at += len(docs[i])
        self.place = np.ascontiguousarray(place.T)
        first = np.zeros(int(self.begun[-1]) + 1, bool)
        first[self.begun[:-1]] = True
        first[-1] = True  # where place is -1
        self.targets = np.where(self.place >= 0, np.concatenate(docs)[self.place], -1)
        before = np.vstack([np.full((1, n_lanes), start_id, self.targets.dtype), self.targets[:-1]])
        begins = first[self.place]
        self.inputs, self.keep = np.where(begins, start_id, before), np.where(begins, np.float32(0), np.float32(1))

    def windows(self, steps: int, least: int = 4_096):
        """Slices of `steps` steps, and how many lanes have tokens in each. Where few lanes are left, windows are longer (up to 16
        times), so that they hold about `least` tokens."""
        t, n = 0, len(self.targets)
        while t < n:
            active = int((self.lengths > t).sum())
            size = max(steps, min(16 * steps, least // active))
            yield slice(t, t + size), active
            t += size


def _tanh(y: np.ndarray) -> None:
    """tanh(y / 2) in place: 1 - 2 / (1 + exp(y)), as numpy's exp takes half of its tanh's time."""
    np.exp(y, out=y)
    y += np.float32(1)
    np.divide(np.float32(-2), y, out=y)
    y += np.float32(1)


def _states(w: dict, h: np.ndarray, inputs: np.ndarray, keep: np.ndarray, saved: bool = True):
    """States after each step with a last column of ones, and (if saved) what the way back needs."""
    steps, lanes = inputs.shape
    hidden = h.shape[1]
    # Sigmoids of y are 1 / (1 + exp(-y)), and tanh of y is _tanh of 2 y.
    sign = np.repeat(np.array([-1, -1, 2], np.float32), hidden)
    u = w["u"] * sign
    g = w["x"].take(inputs.reshape(-1), axis=0).reshape(steps, lanes, 3 * hidden)
    g *= sign
    out = np.ones((steps, lanes, hidden + 1), np.float32)
    before, gates, hn, new = (np.empty((steps if saved else 1, lanes, k * hidden), np.float32) for k in (1, 2, 1, 1))
    hu = np.empty((lanes, 3 * hidden), np.float32)
    one = np.float32(1)
    with np.errstate(over="ignore"):
        for t in range(steps):
            k = t if saved else 0
            hp, zr, n = before[k], gates[k], new[k]
            np.multiply(h, keep[t][:, None], out=hp)
            np.matmul(hp, u, out=hu)
            np.add(g[t, :, : 2 * hidden], hu[:, : 2 * hidden], out=zr)
            np.exp(zr, out=zr)
            zr += one
            np.divide(one, zr, out=zr)
            hn[k] = hu[:, 2 * hidden :]
            np.multiply(zr[:, hidden:], hn[k], out=n)
            n += g[t, :, 2 * hidden :]
            _tanh(n)
            h = hp - n
            h *= zr[:, :hidden]
            h += n
            out[t, :, :hidden] = h
    return h, out, (before, gates, hn, new) if saved else None


class Outputs:
    """Tokens in the order of their classes, and the softmaxes that they go through: over the groups, over the classes of their
    group and, for head words, over the words of their class."""

    def __init__(self, ids: np.ndarray, v: Vocabulary):
        cls = v.class_of[ids]
        self.order = np.argsort(cls.astype(np.int16) if len(v.class_of) and v.class_of[-1] < 32_000 else cls, kind="stable")
        cls, ids = cls[self.order], ids[self.order]
        group, m = v.group_of[cls], int(np.searchsorted(cls, v.n_classes))
        #: By level, a token's place among the scores of its block.
        self.places = []
        #: Level, its softmax, the block's tokens, the rows of weights, whether it is the softmax's first block.
        self.blocks = []
        for k, (starts, node, row) in enumerate(zip(v.levels.values(), (np.zeros_like(cls), group, cls[:m]), (group, cls, ids[:m]), strict=True)):
            cuts, sizes = np.searchsorted(node, np.arange(len(starts))), np.diff(starts)
            self.places.append((np.arange(len(node)) - cuts[node]) % BLOCK * sizes[node] + row - starts[node])
            for c in np.flatnonzero((np.diff(cuts) > 0) & (sizes > 1)).tolist():
                first, end, rows = int(cuts[c]), int(cuts[c + 1]), slice(int(starts[c]), int(starts[c + 1]))
                self.blocks += [(k, c, slice(a, min(a + BLOCK, end)), rows, a == first) for a in range(first, end, BLOCK)]


def large_scores(w: dict, v: Vocabulary) -> list[list[bool]]:
    """By level, for each softmax, whether exp of its scores might overflow. States lie between -1 and 1."""
    return [(np.maximum.reduceat(np.abs(w[k]) @ np.ones(w[k].shape[1], np.float32), starts[:-1]) > 60).tolist() for k, starts in v.levels.items()]


def _ones(v: Vocabulary) -> np.ndarray:
    return np.ones(max(int(np.diff(starts).max()) for starts in v.levels.values()), np.float32)


def _exp(s: np.ndarray, w: np.ndarray, large: bool, buffer: np.ndarray) -> np.ndarray:
    """exp of all scores s @ w.T, each row up to a common factor, in the buffer if that is large enough."""
    size = len(s) * len(w)
    y = np.matmul(s, w.T, out=buffer[:size].reshape(len(s), len(w)) if size <= len(buffer) else None)
    if large:
        y -= y.max(axis=1, keepdims=True)
    return np.exp(y, out=y)


def log_probabilities(w: dict, v: Vocabulary, states: np.ndarray, ids: np.ndarray, large: list | None = None) -> np.ndarray:
    """Natural log of P(group) and P(class | group) and, for head words, of P(word | class). states have a last column of ones."""
    o, ones, buffer = Outputs(ids, v), _ones(v), np.empty(BUFFER, np.float32)
    s, large, ws = states.take(o.order, axis=0), large or large_scores(w, v), [w[k] for k in v.levels]
    # Sums of exponentials, and the own one among them; where there are none, both are 1.
    sums, own = np.ones((2, len(ws), len(ids)), np.float32)
    for k, c, at, rows, _ in o.blocks:
        y = _exp(s[at], ws[k][rows], large[k][c], buffer)
        np.matmul(y, ones[: y.shape[1]], out=sums[k, at])
        y.reshape(-1).take(o.places[k][at], out=own[k, at], mode="clip")
    out = np.empty(len(ids), np.float32)
    out[o.order] = np.log(own / sums).sum(axis=0)
    return out


def score_ids(weights: Weights, v: Vocabulary, docs: list[np.ndarray], lanes: int = 512, steps: int = 32) -> np.ndarray:
    """Log10 probability of each document's ids; within-tail terms come on top."""
    w, hidden = weights.arrays, len(weights.arrays["u"])
    dealt, large = Lanes(docs, lanes, v.n_head + v.n_tail), large_scores(w, v)
    each = np.zeros(int(dealt.begun[-1]), np.float64)
    h = np.zeros((dealt.targets.shape[1], hidden), np.float32)
    for own, active in dealt.windows(steps, least=65_536):
        h, states, _ = _states(w, h[:active], dealt.inputs[own, :active], dealt.keep[own, :active], saved=False)
        place = dealt.place[own, :active]
        there = place >= 0
        each[place[there]] = log_probabilities(w, v, states[there], dealt.targets[own, :active][there], large)
    return np.add.reduceat(each, dealt.begun[:-1]) / np.log(10)


def _sums_by(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids and the sums of their rows of x."""
    keys = ids.astype(np.int64) << 32 | np.arange(len(ids))  # sorted as numbers, which takes a fifth of a stable argsort's time
    keys.sort()
    found, order = keys >> 32, keys & 0xFFFFFFFF
    cuts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
    sizes = np.diff(np.r_[cuts, len(ids)])
    out = x.take(order[cuts], axis=0)
    many = np.flatnonzero(sizes > 1)  # most ids occur once, and reduceat is slow on short runs
    if len(many):
        there = np.repeat(sizes > 1, sizes)
        out[many] = np.add.reduceat(x.take(order[there], axis=0), np.cumsum(sizes[many]) - sizes[many], axis=0)
    return found[cuts], out


class Trainer:
    """Adagrad over windows of backpropagation; a row of x, wc and ww has one rate."""

    def __init__(self, weights: Weights, v: Vocabulary, rate: float = 0.3):
        self.w, self.v, self.rate = {k: a.copy() for k, a in weights.arrays.items()}, v, np.float32(rate)
        self.seen = {k: np.full(len(a), 1e-7, np.float32) for k, a in self.w.items()}
        self.g = {k: np.empty_like(self.w[k]) for k in v.levels}
        self.buffer, self.ones, self.large, self.unchecked = np.empty(BUFFER, np.float32), _ones(v), [], 0
        self.share = np.float32(1)

    def _step(self, name: str, rows, g: np.ndarray, block: int = 1_024) -> None:
        """rows: different rows, or slice(None). g is used up."""
        w, seen, ones = self.w[name], self.seen[name], np.full(g.shape[1], self.share**2 / g.shape[1], np.float32)
        for k in range(0, len(g), block):
            at = slice(k, k + block) if isinstance(rows, slice) else rows[k : k + block]
            part = g[k : k + block]
            now = np.square(part) @ ones
            now += seen[at]
            seen[at] = now
            part *= (self.rate * self.share / np.sqrt(now))[:, None]
            w[at] -= part

    def gradients(self, states: np.ndarray, ids: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Mean loss's gradients: of the outputs (valid until the next call) and of the states; and the sum of losses. A block's
        exponentials become its gradients where the own one loses the sum; not they but the narrower states are divided by sums."""
        v, scale, ws, gs = self.v, np.float32(1 / max(1, len(ids))), [self.w[k] for k in self.v.levels], list(self.g.values())
        if self.unchecked <= 0:
            # A row's sum of sizes grows by at most rate * width in a step, and scores under 80 are safe.
            self.large, self.unchecked = large_scores(self.w, v), int(20 / (float(self.rate) * ws[0].shape[1]))
        self.unchecked -= 1
        o, width = Outputs(ids, v), ws[0].shape[1] - 1
        s = states.take(o.order, axis=0)
        sums, own = np.ones((2, len(ws), len(ids)), np.float32)
        ds = np.zeros((len(ws), len(ids), width), np.float32)
        for g in gs:
            g.fill(0)
        for k, c, at, rows, first in o.blocks:
            w, x, g = ws[k][rows], s[at], gs[k][rows]
            y = _exp(x, w, self.large[k][c], self.buffer)
            flat, places, total, mine = y.reshape(-1), o.places[k][at], sums[k, at], own[k, at]
            np.matmul(y, self.ones[: len(w)], out=total)
            flat.take(places, out=mine, mode="clip")
            flat[places] = mine - total
            np.matmul(y, w[:, :width], out=ds[k, at])
            x = x * (scale / total)[:, None]
            if first:
                np.matmul(y.T, x, out=g)
            else:
                g += y.T @ x
        ds *= (scale / sums)[:, :, None]
        back = np.empty(ds.shape[1:], np.float32)
        back[o.order] = ds.sum(axis=0)
        return self.g, back, float(np.log(sums / own).sum())

    def back(self, dstates: np.ndarray, keep: np.ndarray, saved) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of u and of the gathered rows of x."""
        before, gates, hn, new = saved
        steps, lanes, hidden = before.shape
        z, r = gates[:, :, :hidden], gates[:, :, hidden:]
        # The gradients of the columns of u are d[:, :, hidden:], those of x have that of the new state (first) for the last one.
        d = np.empty((steps, lanes, 4 * hidden), np.float32)
        to_n = 1 - z
        to_z = (before - new) * z * to_n
        to_n *= 1 - new * new
        to_r = hn * np.float32(0.5) * r * (1 - r)
        passed, back_u = z * keep[:, :, None], np.ascontiguousarray(self.w["u"].T)
        dh, more = np.zeros((lanes, hidden), np.float32), np.empty((lanes, hidden), np.float32)
        for t in range(steps - 1, -1, -1):
            dh += dstates[t]
            dn = d[t, :, :hidden]
            np.multiply(dh, to_n[t], out=dn)
            np.multiply(dh, to_z[t], out=d[t, :, hidden : 2 * hidden])
            np.multiply(dn, to_r[t], out=d[t, :, 2 * hidden : 3 * hidden])
            np.multiply(dn, r[t], out=d[t, :, 3 * hidden :])
            np.matmul(d[t, :, hidden:], back_u, out=more)
            more *= keep[t][:, None]
            dh *= passed[t]
            dh += more
        d = d.reshape(-1, 4 * hidden)
        return before.reshape(-1, hidden).T @ d[:, hidden:], d[:, : 3 * hidden]

    def fit(self, docs: list[np.ndarray], lanes: int | None = None, steps: int = 32) -> float:
        """One pass over docs; the mean loss of their tokens as they came by. Without a number of lanes there are up to 512, so many
        that each has about 64 windows."""
        lanes = lanes or min(512, max(16, sum(map(len, docs)) // (64 * steps)))
        w, v, hidden = self.w, self.v, len(self.w["u"])
        dealt, total = Lanes(docs, lanes, v.n_head + v.n_tail), 0.0
        h = np.zeros((dealt.targets.shape[1], hidden), np.float32)
        for own, active in dealt.windows(steps):
            inputs, keep = dealt.inputs[own, :active], dealt.keep[own, :active]
            h, states, saved = _states(w, h[:active], inputs, keep)
            there = dealt.place[own, :active] >= 0
            # Gradients are means of a window's tokens; a window of fewer tokens counts for less.
            self.share = np.float32(min(1, there.sum() / (lanes * steps)))
            if there.all():
                outputs, ds, loss = self.gradients(states.reshape(-1, hidden + 1), dealt.targets[own, :active].reshape(-1))
                dstates = ds.reshape(*there.shape, hidden)
            else:
                outputs, ds, loss = self.gradients(states[there], dealt.targets[own, :active][there])
                dstates = np.zeros((*there.shape, hidden), np.float32)
                dstates[there] = ds
            total += loss
            gu, dx = self.back(dstates, keep, saved)
            # The new state comes first in dx, and last in x.
            rows, gx = _sums_by(inputs.reshape(-1), dx)
            self._step("x", rows, np.roll(gx, -hidden, axis=1))
            for name, g in (("u", gu), *outputs.items()):
                self._step(name, slice(None), g)
        return total / max(1, int(dealt.begun[-1]))

    def weights(self) -> Weights:
        return Weights(self.w)


def _counts(n_tail: int, most: int = 400_000):
    def counts(batches):
        found: dict[bytes, int] = {}

        def out():
            words = list(found)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_hashes(words).view(np.int64)),
                    pa.array(np.array([-1 if x == END else tail_class(x, n_tail) for x in words], dtype=np.int32)),
                    pa.array(np.fromiter(found.values(), np.int64, len(found))),
                ],
                names=["word", "tail", "n"],
            )
            found.clear()

        for batch in batches:
            for part, words, which, _ in _split(batch):
                for word, n in zip(words, np.bincount(which, minlength=len(words)).tolist(), strict=True):
                    found[word] = found.get(word, 0) + n
                found[END] = found.get(END, 0) + part.num_rows
                if len(found) > most:
                    yield from out()
        if found:
            yield from out()

    return counts


def count_words(training: DataFrame, n_tail: int) -> DataFrame:
    """word (64-bit hash), tail (its tail class, -1 for the end), n: over every training document."""
    parts = training.select("text").mapInArrow(_counts(n_tail), "word long, tail int, n long")
    return parts.groupBy("word").agg(F.max("tail").alias("tail"), F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, *, n_head: int | None = None, n_classes: int | None = None, n_tail: int = 32, most_sent: int = 200_000) -> Vocabulary:
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("n"), "word").limit(most_sent).toArrow()  # at most most_sent rows; the head words are among them
    hashes, tails, n = top["word"].to_numpy().view(np.uint64), top["tail"].to_numpy(), top["n"].to_numpy()
    n_head = head_words(int(total or 0)) if n_head is None else n_head
    # The end of a text is always a head word.
    rank = np.lexsort((hashes, -n, tails >= 0))[: max(1, n_head)] if len(n) else np.empty(0, np.int64)
    rank = rank[np.argsort(-n[rank], kind="stable")]
    head = np.full(len(n), -1, np.int64)
    head[rank] = np.arange(len(rank))
    by_tail = {r["tail"]: (r["n"], r["d"]) for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).collect()}
    tail_n, tail_d = (np.array([by_tail.get(t, (0, 0))[k] for t in range(n_tail)], np.float64) for k in (0, 1))
    np.subtract.at(tail_n, tails[rank][tails[rank] >= 0], n[rank][tails[rank] >= 0])
    np.subtract.at(tail_d, tails[rank][tails[rank] >= 0], 1)
    word_counts = n[rank].astype(np.float64) if len(rank) else np.ones(1)
    order = np.argsort(hashes, kind="stable")
    return Vocabulary(hashes[order], n[order], head[order], np.maximum(tails, 0)[order].astype(np.int64), class_starts(word_counts, n_classes), n_tail, int(total or 0), int(distinct or 0), tail_n, tail_d, word_counts)


ENCODED = "doc_id long, row_no long, round int, n_tokens long, n_known long, base_score double, tail_score double, ids binary, rest array<struct<word: long, tail: int, n: long>>"


def _encoded(sent):
    """Each document's ids, the base score of its sent words, the within-tail terms of those, and the words that weren't sent."""
    names = ["doc_id", "row_no", "round", "n_tokens", "n_known", "base_score", "tail_score", "ids", "rest"]

    def encoded(batches):
        v = sent.value
        look = Lookup(v)
        for batch in batches:
            for part, words, which, sizes in _split(batch):
                words.append(END)
                hashes, n = _hashes(words), part.num_rows
                row = look.rows(words, hashes)
                ends = np.cumsum(sizes)
                seen = np.insert(row[which], ends, row[-1])
                ends += np.arange(1, n + 1)
                first, known = np.r_[0, ends[:-1]], seen < look.n_sent
                base, tail = (np.add.reduceat(np.where(known, x[seen], 0.0), first) for x in (look.base, look.tail))
                offsets = pa.py_buffer(np.r_[0, ends * 4].astype(np.int32))
                ids = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(look.ids[seen])])
                # The words that weren't sent, once for each text, with their number there.
                other = row[which] >= look.n_sent
                met, times = np.unique(np.repeat(np.arange(n), sizes)[other] * len(row) + which[other], return_counts=True)
                text, word = np.divmod(met, len(row))
                fields = [pa.array(hashes[word].view(np.int64)), pa.array((row[word] - look.n_sent).astype(np.int32)), pa.array(times.astype(np.int64))]
                rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays(fields, ["word", "tail", "n"]))
                made = [pa.array(ends - first), pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(base), pa.array(tail), ids, rest]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in names[:3]), *made], names=names)

    return encoded


def encode(docs: DataFrame, learn: Column, v: Vocabulary, rounds: int, seed: int = 23) -> DataFrame:
    """ENCODED of all docs; round: in which round a document is learnt from, -1 for none."""
    rows = shared.texts_of(docs, learn.alias("learn")).withColumn("row_no", F.monotonically_increasing_id())
    deal = F.when(F.col("learn"), F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(rounds)).cast("int")).otherwise(-1)
    made = rows.select("doc_id", "row_no", deal.alias("round"), "text").mapInArrow(_encoded(docs.sparkSession.sparkContext.broadcast(v)), ENCODED)
    return shared.stored(made, "lm-ids")


SLICES = "slice int, first long, tokens long, weights binary"


def _mean(table: pa.Table) -> pa.Table:
    """The token-weighted mean of one slice of some replicas' weights, as a row like theirs."""
    rows = sorted(table.to_pylist(), key=lambda x: (x["first"], x["tokens"]))
    total = sum(x["tokens"] for x in rows)
    mean = sum(np.float32(x["tokens"] / total) * np.frombuffer(x["weights"], np.float32) for x in rows)
    columns = (rows[0]["slice"], rows[0]["first"], total, mean.astype(np.float32).tobytes())
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array([x], kind) for x, kind in zip(columns, kinds, strict=True)], names=["slice", "first", "tokens", "weights"])


def _met(parts: DataFrame, replicas: int, fan_in: int = 32) -> DataFrame:
    """The mean of each slice over all replicas, about fan_in of them to a task, then the means of these."""
    while replicas > fan_in:
        replicas = -(-replicas // fan_in)
        group = F.pmod(F.xxhash64("first"), F.lit(replicas))
        parts = parts.groupBy("slice", group.alias("group")).applyInArrow(_mean, SLICES)
    return parts.groupBy("slice").applyInArrow(_mean, SLICES)


def _chunks(batches, columns: tuple[str, ...], most_tokens: int, long: int = 4_096):
    """Rows (ids last) in chunks of bounded size. Documents of over `long` tokens are held back for chunks of their own, so that
    many of them share their steps."""
    held, size = ([], []), [0, 0]
    for batch in batches:
        for row in shared.rows_of(batch, *columns, "ids"):
            ids = np.frombuffer(row[-1], np.int32)
            k = int(len(ids) > long)
            held[k].append((*row[:-1], ids))
            size[k] += len(ids)
            if size[k] >= most_tokens:
                yield held[k][:]
                held[k].clear()
                size[k] = 0
    for rows in held:
        if rows:
            yield rows


def _trained(sent, rate: float, chunk_tokens: int = 2_000_000, slice_bytes: int = 1 << 20):
    """The slices of the weights of the replica that learns from this part. Its documents stream by in chunks of bounded size."""

    def trained(batches):
        trainer, total, first = None, 0, None
        for held in _chunks(batches, ("row_no",), chunk_tokens):
            if trainer is None:
                v, start = sent.value
                trainer, first = Trainer(start, v, rate), held[0][0]
            trainer.fit([x[-1] for x in held])
            total += sum(len(x[-1]) for x in held)
        if trainer is not None:
            data = trainer.weights().dump()
            parts = [data[k : k + slice_bytes] for k in range(0, len(data), slice_bytes)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([first] * n, pa.int64()), pa.array([total] * n, pa.int64()), pa.array(parts, pa.binary())], names=["slice", "first", "tokens", "weights"])

    return trained


def train(encoded: DataFrame, v: Vocabulary, *, hidden: int, replica_tokens: int, rounds: int, rate: float) -> Weights:
    """Rounds of local training on disjoint documents, then the token-weighted mean of the replicas' weights. A replica reads
    at least replica_tokens tokens and as many as it has weights to send, where the corpus has them."""
    spark = encoded.sparkSession
    weights = Weights.start(v, hidden)
    least = max(replica_tokens, sum(a.size for a in weights.arrays.values()))
    replicas = max(1, v.total // (rounds * least))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((v, weights))
        own = encoded.where(F.col("round") == k).select("row_no", "ids").coalesce(replicas)
        # The replicas' weights meet in Spark; one set of weights reaches the driver.
        got = _met(own.mapInArrow(_trained(sent, rate), SLICES), replicas).collect()
        if got:
            weights = weights.like(b"".join(bytes(r["weights"]) for r in sorted(got, key=lambda r: r["slice"])))
        sent.unpersist()
    return weights


SCORED = "doc_id long, row_no long, n_tokens long, n_known long, base_score double, score double"


def _scored(sent, chunk_tokens: int = 2_000_000):
    names = ("doc_id", "row_no", "n_tokens", "n_known", "base_score", "tail_score")

    def scored(batches):
        v, weights = sent.value
        for held in _chunks(batches, names, chunk_tokens):
            *own, tail, ids = list(zip(*held, strict=True))
            score = score_ids(weights, v, list(ids)) + np.array(tail)
            kinds = (*[pa.int64()] * 4, pa.float64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(own, kinds, strict=True)), pa.array(score)], names=[*names[:-1], "score"])

    return scored


def score(docs: DataFrame, learn: Column | None = None, *, n_head: int | None = None, n_classes: int | None = None, n_tail: int = 32, hidden: int = 16, most_sent: int = 200_000, replica_tokens: int = 1_000_000, rounds: int = 2, rate: float = 0.3) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (smoothed counts), score (the network) of each document. learn says
    which rows are learnt from (null: not); all of them if not given."""
    spark = docs.sparkSession
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    counts = shared.stored(count_words(shared.texts_of(docs.where(learn)), n_tail), "lm-counts")
    v = vocabulary(counts, n_head=n_head, n_classes=n_classes, n_tail=n_tail, most_sent=most_sent)
    encoded = encode(docs, learn, v, rounds)
    weights = train(encoded, v, hidden=hidden, replica_tokens=replica_tokens, rounds=rounds, rate=rate)
    columns = ("doc_id", "row_no", "n_tokens", "n_known", "base_score", "tail_score", "ids")
    first = encoded.select(*columns).mapInArrow(_scored(spark.sparkContext.broadcast((v, weights))), SCORED)
    # Words that were not sent meet their counts here; a frequent word is always sent, so no key is hot.
    rest = encoded.where(F.size("rest") > 0).select("row_no", F.explode("rest").alias("r")).select("row_no", "r.word", "r.tail", F.col("r.n").alias("times"))
    log_c = F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.1))
    base = float(np.log10(v.total + 0.1 * (v.distinct + 1)))
    in_tail = F.element_at(F.array(*[F.lit(float(x)) for x in np.log10(v.tail_total + 0.1 * (v.tail_distinct + 1))]), F.col("tail") + 1)
    met = rest.join(counts.select("word", "n"), "word", "left")
    sums = met.groupBy("row_no").agg(
        F.sum(F.col("times") * F.col("n").isNotNull().cast("long")).alias("k"), F.sum(F.col("times") * (log_c - base)).alias("b"), F.sum(F.col("times") * (log_c - in_tail)).alias("s")
    )
    zero = F.lit(0.0)
    return first.join(sums, "row_no", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )
