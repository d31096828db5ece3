"""Document log-likelihood under a gated recurrent language model with a class-factored softmax.

A document's tokens are its words and one end. The TOP most frequent words are outputs of their
own, CLASS_WORDS to a class; all others fall into classes by their last byte, inside which a
word has its smoothed relative frequency, so that every word has a probability. Counts come from all
training documents. The recurrent weights are trained by truncated backpropagation on all of
them as well, in one pass: documents are dealt by hash into shards of about ``max_tokens`` tokens,
and the shards into ROUNDS rounds. A round trains each of its shards from the same weights, and the
means over the shards, by their tokens, are the next round's weights. State goes from window to
window, and a document is scored from its first token to its end.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from stratal.llm import textkernel as tk
from stratal.llm.langid import part
from stratal.llm.scratch import discard, materialize

TOP = 1024
CLASS_WORDS = 32
RARE = 16
HIDDEN = 24
#: Words whose counts every worker holds, most frequent first; counts of the others are joined.
HEAD = 1 << 18
#: Training tokens of one shard, and of what a task trains on at once: many, so that streams are long beside the longest documents
#: and few windows have few streams.
MAX_TOKENS = 2_400_000
ROUNDS = 8
#: Shards at most; more tokens make larger shards, which are trained on piece by piece.
MAX_SHARDS = 8 << 10
#: Sums of weights that the driver adds up.
SUMS = 32
STREAMS, STEPS = 256, 32
#: Few steps at once keep a window's numbers in a core's cache.
SLOTS, WINDOW = 512, 16
#: Symbols are scored in slices of so many bytes.
SCORE_BYTES = 8 << 20
RATE = 6e-3
SMOOTH = 0.1


def by_value(x: np.ndarray) -> np.ndarray:
    """Order of small numbers; two bytes are sorted by counting."""
    return np.argsort(x.astype(np.uint16) if x.size and x.max() < 1 << 16 else x, kind="stable")


class Gru:
    """Symbols: 0 the end, 1..RARE the classes of rare words, then the top words. Classes of the output: the
    same first 1 + RARE, then the groups of top words, each with a softmax of its own inside."""

    def __init__(self, n_top: int, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.n_top, self.hidden = n_top, hidden
        self.groups = -(-n_top // CLASS_WORDS)
        n = 1 + RARE + n_top
        draw = lambda *shape: (rng.normal(size=shape) / np.sqrt(hidden)).astype(np.float32)
        self.p = {
            "x": draw(n, 3 * hidden), "u": draw(hidden, 3 * hidden), "bu": np.zeros(3 * hidden, np.float32),
            "c": draw(hidden, 1 + RARE + self.groups) * 0.1, "bc": np.zeros(1 + RARE + self.groups, np.float32),
            "w": draw(self.groups, hidden, CLASS_WORDS) * 0.1, "bw": np.zeros((self.groups, CLASS_WORDS), np.float32),
        }

    def start_from(self, counts: np.ndarray) -> None:
        """Biases that give each symbol its share of ``counts``."""
        c = counts + 0.5
        top = np.full(self.groups * CLASS_WORDS, 1e-6)
        top[: self.n_top] = c[1 + RARE :]
        top = top.reshape(self.groups, CLASS_WORDS)
        every = np.concatenate([c[: 1 + RARE], top.sum(1)])
        self.p["bc"][:] = np.log(every / every.sum())
        self.p["bw"][:] = np.log(top / top.sum(1, keepdims=True))

    def states(self, inputs: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """States after each of the steps, (time, unit, stream), from those before, (unit, stream); where ``fresh``
        (time, stream) the state before is zero. Units come before streams, so that a gate's numbers lie side by side."""
        p, d = self.p, self.hidden
        table = p["x"].copy()
        table[:, : 2 * d] += p["bu"][: 2 * d]
        x = np.ascontiguousarray(table[inputs].transpose(0, 2, 1))
        bn, u = p["bu"][2 * d :, None], np.ascontiguousarray(p["u"].T)
        some, on = fresh.any(1), (~fresh).astype(x.dtype)
        steps, streams = inputs.shape
        out = np.empty((steps, d, streams), x.dtype)
        many = steps if keep else 1
        before, gates, new = np.empty((many, d, streams), x.dtype), np.empty((many, 3 * d, streams), x.dtype), np.empty((many, d, streams), x.dtype)
        for t in range(steps):
            k = t if keep else 0
            if some[t]:
                h = h * on[t]
            if keep:
                before[k] = h
            g, n, o = gates[k], new[k], out[t]
            np.matmul(u, h, out=g)
            zr, gn = g[: 2 * d], g[2 * d :]
            zr += x[t, : 2 * d]
            np.negative(zr, zr)
            np.exp(zr, zr)
            zr += 1
            np.reciprocal(zr, zr)
            gn += bn
            np.multiply(zr[d:], gn, out=n)
            n += x[t, 2 * d :]
            np.tanh(n, n)
            np.subtract(h, n, out=o)
            o *= zr[:d]
            o += n
            h = o
        return out, (before, gates, new) if keep else ()

    def classes(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols > RARE, 1 + RARE + (symbols - 1 - RARE) // CLASS_WORDS, symbols)

    def _inside(self, goal: np.ndarray, cls: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places among ``on`` of words with a class of their own, by class; where each class begins and ends; the classes."""
        rows = on[goal[on] > RARE]
        rows = rows[by_value(cls[rows])]
        edges = np.flatnonzero(np.diff(cls[rows], prepend=-1, append=-1))
        return rows, edges, cls[rows[edges[:-1]]] - 1 - RARE

    def _own(self, mine: np.ndarray, edges: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the logits inside each row's class, and their sums."""
        e = np.empty((len(mine), CLASS_WORDS), mine.dtype)
        for k, a, b in zip(groups.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            np.matmul(mine[a:b], self.p["w"][k], out=e[a:b])
            e[a:b] += self.p["bw"][k]
        np.exp(e, e)
        return e, e @ np.ones(CLASS_WORDS, e.dtype)

    def log_probs(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target symbol after the state (unit, place) in the same place. Logits are
        small, as biases are log-shares and gradients clipped."""
        p, cls = self.p, self.classes(targets)
        x = p["c"].T @ h
        x += p["bc"][:, None]
        out = x[cls, np.arange(len(cls))]
        np.exp(x, x)
        out -= np.log(x.sum(0))
        rows, edges, groups = self._inside(targets, cls, np.arange(len(targets)))
        e, total = self._own(np.ascontiguousarray(h[:, rows].T), edges, groups)
        out[rows] += np.log(e[np.arange(len(rows)), (targets[rows] - 1 - RARE) % CLASS_WORDS] / total)
        return out

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h0: np.ndarray, live: np.ndarray | None = None) -> tuple[dict, np.ndarray, float]:
        """Of the mean negative log-likelihood over the ``live`` places of one window; the state that goes on; the loss."""
        p, d = self.p, self.hidden
        steps, streams = inputs.shape
        hs, (before, gates, new) = self.states(inputs, fresh, h0, keep=True)
        flat, goal = hs.transpose(1, 0, 2).reshape(d, -1), targets.ravel()
        every = np.arange(len(goal))
        on = every if live is None else np.flatnonzero(live)
        n, cls = len(on), self.classes(goal)
        grad = {}
        e = p["c"].T @ flat
        e += p["bc"][:, None]
        np.exp(e, e)
        e /= e.sum(0)
        loss = -np.log(e[cls, every][on]).sum()
        e[cls, every] -= 1
        if n < len(goal):
            e[:, ~live.ravel()] = 0
        grad["c"], grad["bc"] = flat @ e.T, e.sum(1)
        dh = p["c"] @ e
        # words inside their classes
        rows, edges, groups = self._inside(goal, cls, on)
        mine = np.ascontiguousarray(flat[:, rows].T)
        e, total = self._own(mine, edges, groups)
        e /= total[:, None]
        at = np.arange(len(rows)), (goal[rows] - 1 - RARE) % CLASS_WORDS
        loss -= np.log(e[at]).sum()
        e[at] -= 1
        grad["w"], grad["bw"], back = np.zeros_like(p["w"]), np.zeros_like(p["bw"]), np.empty_like(mine)
        for k, a, b in zip(groups.tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            np.matmul(mine[a:b].T, e[a:b], out=grad["w"][k])
            grad["bw"][k] = e[a:b].sum(0)
            np.matmul(e[a:b], p["w"][k].T, out=back[a:b])
        dh[:, rows] += back.T
        # back through time, step by step: what a step needs stays in the cache
        dh = dh.reshape(d, steps, streams).transpose(1, 0, 2)
        some, keep = fresh.any(1), (~fresh).astype(hs.dtype)
        dx, dg = np.empty((steps, streams, 3 * d), hs.dtype), np.empty((3 * d, streams), hs.dtype)
        now, rest, slope, carried = (np.zeros((d, streams), hs.dtype) for _ in range(4))
        grad["u"], grad["bu"] = np.zeros_like(p["u"]), np.zeros_like(p["bu"])
        for t in range(steps - 1, -1, -1):
            z, r, gn, m, h = gates[t, :d], gates[t, d : 2 * d], gates[t, 2 * d :], new[t], before[t]
            np.add(dh[t], carried, out=now)
            np.subtract(1, z, out=rest)
            np.multiply(m, m, out=slope)
            np.subtract(1, slope, out=slope)
            slope *= rest
            slope *= now  # of the new state's own input, which the reset gate does not scale
            gz, gr, gm = dg[:d], dg[d : 2 * d], dg[2 * d :]
            np.subtract(h, m, out=gz)
            gz *= z
            gz *= rest
            gz *= now
            np.multiply(slope, r, out=gm)
            np.subtract(1, r, out=gr)
            gr *= gn
            gr *= gm
            now *= z
            np.matmul(p["u"], dg, out=carried)
            carried += now
            if some[t]:
                carried *= keep[t]
            grad["u"] += h @ dg.T
            grad["bu"] += dg.sum(1)
            dx[t, :, : 2 * d] = dg[: 2 * d].T
            dx[t, :, 2 * d :] = slope.T
        # the few symbols of the end and of rare words have most places: their rows are summed by a product
        dx, symbols = dx.reshape(-1, 3 * d), inputs.ravel()
        grad["x"] = np.zeros_like(p["x"])
        few = np.flatnonzero(symbols <= RARE)
        of = np.zeros((1 + RARE, len(few)), hs.dtype)
        of[symbols[few], np.arange(len(few))] = 1
        grad["x"][: 1 + RARE] = of @ dx[few]
        rows = np.flatnonzero(symbols > RARE)
        if len(rows):
            rows = rows[by_value(symbols[rows])]
            ranked = symbols[rows]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            grad["x"][ranked[first]] = np.add.reduceat(dx[rows], first, 0)
        return {k: grad[k] / n for k in p}, hs[-1], float(loss) / n

    def train(self, docs: list[np.ndarray], epochs: int = 1, rate: float = RATE, seed: int = 5) -> list[float]:
        """Passes over all tokens of ``docs``; losses by epoch."""
        adam = Adam.of(self)
        return [self.train_on(docs, adam, epoch / epochs, 1 / epochs, rate, seed + epoch) for epoch in range(epochs)]

    def train_on(self, docs: list[np.ndarray], adam: Adam, begin: float = 0.0, span: float = 1.0, rate: float = RATE, seed: int = 5) -> float:
        """One pass of Adam over windows of STEPS tokens of STREAMS streams of documents, to the end of the longest
        stream; the loss. Windows in which few streams are left add up until they have half the tokens of a full one.
        The rate falls from the share ``begin`` of the whole training to ``begin + span``."""
        rng = np.random.default_rng(seed)
        total = sum(map(len, docs))
        h, loss, done, held, tokens = np.zeros((self.hidden, min(STREAMS, len(docs))), np.float32), 0.0, 0, None, 0
        full = min(STREAMS * STEPS, total)
        for inputs, targets, fresh, live, _ in windows([docs[i] for i in rng.permutation(len(docs))], STREAMS, STEPS):
            grad, h, mean = self.gradients(inputs, targets, fresh, h[:, : inputs.shape[1]], live)
            n = int(live.sum())
            done, loss = done + n, loss + mean * n
            if held is not None or n < full // 2:
                held = {k: g * n + (held[k] if held else 0) for k, g in grad.items()}
                tokens += n
                if tokens < full // 2 and done < total:
                    continue
                grad, held, tokens = {k: (g / tokens).astype(np.float32) for k, g in held.items()}, None, 0
            adam.update(self, grad, rate * max(0.05, 1 - min(1.0, begin + span * done / total)))
        return loss / max(total, 1)

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of each whole document, window after window with the state carried on."""
        out = np.zeros(len(docs))
        if not docs:
            return out
        h = np.zeros((self.hidden, min(SLOTS, len(docs))), np.float32)
        for inputs, targets, fresh, live, owner in windows(docs, SLOTS, WINDOW, stretch=16):
            hs, _ = self.states(inputs, fresh, h[:, : inputs.shape[1]])
            h, on = hs[-1], np.flatnonzero(live)
            out += np.bincount(owner[live], self.log_probs(hs.transpose(1, 0, 2).reshape(self.hidden, -1)[:, on], targets.ravel()[on]), len(docs))
        return out


@dataclass
class Adam:
    """Running means of the gradients and of their squares, and the number of updates."""

    m: dict[str, np.ndarray]
    v: dict[str, np.ndarray]
    step: float = 0

    @classmethod
    def of(cls, gru: Gru) -> Adam:
        return cls(*({k: np.zeros_like(x) for k, x in gru.p.items()} for _ in range(2)))

    def update(self, gru: Gru, grad: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate *= min(1, self.step / 20)
        for k, g in grad.items():
            g = g * np.float32(min(1, 1 / (size + 1e-9)))
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.005 * (g * g - self.v[k])
            gru.p[k] -= (rate * (self.m[k] / (1 - 0.9**self.step)) / (np.sqrt(self.v[k] / (1 - 0.995**self.step)) + 1e-8)).astype(np.float32)


def pack(gru: Gru, adam: Adam) -> np.ndarray:
    """Weights, running means and number of updates in one vector."""
    return np.concatenate([*(x[k].ravel() for x in (gru.p, adam.m, adam.v) for k in x), [adam.step]]).astype(np.float64)


def unpack(vector: np.ndarray, gru: Gru, adam: Adam) -> None:
    at = 0
    for x in (gru.p, adam.m, adam.v):
        for k in x:
            x[k] = vector[at : at + x[k].size].reshape(x[k].shape).astype(np.float32)
            at += x[k].size
    adam.step = float(vector[at])


def deal(lengths: np.ndarray, slots: int) -> list[list[int]]:
    """Documents dealt to up to ``slots`` streams of like length, longest stream first."""
    slots = min(slots, len(lengths))
    heap, streams = [(0, i) for i in range(slots)], [[] for _ in range(slots)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        size, i = heapq.heappop(heap)
        streams[i].append(d)
        heapq.heappush(heap, (size + int(lengths[d]), i))
    return sorted(streams, key=lambda s: -sum(int(lengths[d]) for d in s))


def windows(docs: list[np.ndarray], slots: int, steps: int, stretch: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """(inputs, targets, fresh, live, owner), each (time, stream), of all tokens of documents laid out in streams: window
    after window, of the streams that still go on. The input before a document is the end. With ``stretch`` windows are up
    to so many times longer where fewer streams go on."""
    lengths = np.array([len(d) for d in docs])
    streams = deal(lengths, slots)
    if not streams:
        return
    order = np.array([d for s in streams for d in s])
    targets = np.concatenate([docs[d] for d in order])
    before = np.append(0, targets[:-1])  # a document's last symbol is the end, which is the input before the next
    owner = np.repeat(order, lengths[order]).astype(np.int32)
    fresh = np.zeros(len(targets), bool)
    fresh[np.append(0, np.cumsum(lengths[order])[:-1])] = True
    size = np.array([int(lengths[s].sum()) for s in streams])
    begin = np.cumsum(size) - size
    to = 0
    while to < int(size[0]):
        at, used = to, int(np.searchsorted(-size, -to, "left"))
        to = min(at + steps * max(1, min(stretch, slots // used)), int(size[0]))
        time = np.arange(at, to)[:, None]
        live = time < size[:used]
        place = np.where(live, begin[:used] + time, 0)
        yield before[place], np.where(live, targets[place], 0), fresh[place] & live, live, owner[place]


@dataclass
class Head:
    """Counts of the most frequent words, found by their hashes: sorted, with an index over the first bits."""

    hashes: np.ndarray  # rising
    counts: np.ndarray
    symbol: np.ndarray  # of top words; 0 for the others

    def __post_init__(self) -> None:
        self.bits = max(1, len(self.hashes).bit_length())
        self.begin = np.searchsorted(self.hashes, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.begin = np.append(self.begin, len(self.hashes))
        self.deepest = int(np.diff(self.begin).max()) if len(self.hashes) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if it is not here."""
        out = np.full(len(h), -1, np.int64)
        cell = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.begin[cell], self.begin[cell + 1]
        left = np.arange(len(h))
        for _ in range(self.deepest):
            on = at < end
            left, at, end = left[on], at[on], end[on]
            hit = self.hashes[at] == h[left]
            out[left[hit]] = at[hit]
            left, at, end = left[~hit], at[~hit] + 1, end[~hit]
        return out


def rare_class(last: np.ndarray) -> np.ndarray:
    """1..RARE by a word's last byte."""
    return (1 + (last.astype(np.int64) * 7 + (last >> 4)) % RARE).astype(np.int32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for lo, hi in tk.slices(batch.column(0), 16 << 20):
            w = tk.split_words(batch.column(0).slice(lo, hi - lo), lower=True)
            if len(w.starts):
                h, at, n = np.unique(w.hashes(), return_index=True, return_counts=True)
                found.append((h, rare_class(w.data[w.ends - 1])[at], n))
        for h, c, n in found:
            yield pa.record_batch([pa.array(tk.signed(h)), pa.array(c), pa.array(n, pa.int64())], ["h", "rare", "c"])


def symbols_of(words: tk.Words, head: Head) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place in the head and symbol of each word."""
    h = words.hashes()
    at = head.find(h)
    rare = rare_class(words.data[words.ends - 1]) if len(h) else np.zeros(0, np.int32)
    if not len(head.hashes):
        return h, at, rare
    s = np.where(at >= 0, head.symbol[np.maximum(at, 0)], 0)
    return h, at, np.where(s > 0, s, rare).astype(np.int32)


@dataclass
class Model:
    gru: Gru
    head: Head
    tokens: int  # N: training tokens, ends included
    distinct: int  # V, the end included
    ends: int  # training documents
    rare_tokens: np.ndarray  # by symbol 1..RARE
    rare_words: np.ndarray
    trained: int = 0  # tokens that the recurrent weights learned from in each pass

    def log_total(self) -> float:
        return float(np.log10(self.tokens + SMOOTH * (self.distinct + 1)))


#: Rows of ``encode``: the symbols and all that counts say of a text. ``round`` and ``shard`` are null for a text not to be learned from.
ENCODED = "row long, doc_id long, round int, shard int, n_tokens long, known long, base double, inside double, s binary, tail array<long>, times array<long>"


def _encode(model: Model, kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() << 40) if TaskContext.get() else 0
        head, total = model.head, model.log_total()
        logs = np.log10(head.counts + SMOOTH)
        share = np.log10(model.rare_tokens + SMOOTH * (model.rare_words + 1))
        end = np.log10(model.ends + SMOOTH)
        for batch in batches:
            for lo, hi in tk.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                w = tk.split_words(part.column("text"), lower=True)
                h, at, s = symbols_of(w, head)
                in_head = at >= 0
                # a word of the head adds its count; its class' total is taken off; the others' counts are joined
                mine = np.where(in_head, logs[np.maximum(at, 0)], 0.0) if len(logs) else np.zeros(len(h))
                mine_inside = np.where(s <= RARE, mine - share[np.minimum(s, RARE)], 0.0)
                n = len(part)
                doc = np.repeat(np.arange(n), np.diff(w.first))
                words = np.diff(w.first)
                base = np.bincount(doc, mine, n) + end - (words + 1) * total
                known = np.bincount(doc[in_head], minlength=n) + (model.ends > 0)
                # words beyond the head, each once for a text with its number of times
                rest = np.flatnonzero(~in_head)
                rest = rest[np.lexsort((h[rest], doc[rest]))]
                new = np.flatnonzero(np.concatenate([[True], (h[rest][1:] != h[rest][:-1]) | (doc[rest][1:] != doc[rest][:-1])])) if len(rest) else rest
                times = np.diff(np.append(new, len(rest)))
                ends = pa.array(np.append(0, np.cumsum(np.bincount(doc[rest[new]], minlength=n))).astype(np.int32))
                symbols = s.astype(kind)
                raw = [symbols[i:j].tobytes() + b"\0" * symbols.itemsize for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
                cols = [
                    pa.array(row + np.arange(n)), part.column("doc_id"), part.column("round"), part.column("shard"), pa.array(words + 1), pa.array(known), pa.array(base),
                    pa.array(np.bincount(doc, mine_inside, n)), pa.array(raw, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(tk.signed(h[rest[new]]))),
                    pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64))),
                ]
                yield pa.record_batch(cols, ["row", "doc_id", "round", "shard", "n_tokens", "known", "base", "inside", "s", "tail", "times"])
                row += n

    return run


def kind_of(model: Model) -> str:
    return "<u2" if 1 + RARE + model.gru.n_top <= 1 << 16 else "<i4"


def encode(docs: DataFrame, model: Model, learned: Column | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """A table of ENCODED for every row of ``docs`` (doc_id, text), in folders by round. Rows with ``learned`` are dealt to
    shards of about ``max_tokens`` tokens; without it no row is learned from."""
    shards = max(1, min(MAX_SHARDS, -(-model.tokens // max_tokens)))
    rounds = min(ROUNDS, shards)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), (F.lit(False) if learned is None else learned).alias("learned"))
    dealt = F.when(F.col("learned"), F.pmod(F.xxhash64("doc_id", "text", F.lit("lm")), F.lit(shards)))
    rows = rows.select("doc_id", "text", F.pmod(dealt, F.lit(rounds)).cast("int").alias("round"), F.floor(dealt / rounds).cast("int").alias("shard"))
    return materialize(rows.mapInArrow(_encode(model, kind_of(model)), ENCODED), "encoded", ["round"])


def pieces_of(batches: Iterator[pa.RecordBatch], kind: str, limit: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(shard, documents) of rows (shard, s) sorted by shard: a shard's documents piece by piece, each of about ``limit`` tokens."""
    docs, size, last = [], 0, None
    for batch in batches:
        for shard, s in zip(batch.column("shard").to_pylist(), batch.column("s"), strict=True):
            if docs and (shard != last or size >= limit):
                yield last, docs
                docs, size = [], 0
            docs.append(np.frombuffer(s.as_buffer(), kind).astype(np.int32))
            size, last = size + len(docs[-1]), shard
    if docs:
        yield last, docs


def _train(gru: Gru, adam: Adam, begin: float, span: float, expected: float, kind: str) -> Callable:
    """Tokens of a task's shards, and the sum of what they make of the weights, times their tokens. ``span`` is a
    round's share of the training and ``expected`` a shard's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sums, last, mine, state, done = 0, 0.0, None, None, None, 0
        for shard, docs in pieces_of(batches, kind, MAX_TOKENS):
            if shard != last:
                if done:
                    tokens, sums = tokens + done, sums + pack(mine, state) * done
                (mine, state), last, done = copy.deepcopy((gru, adam)), shard, 0
            n = sum(map(len, docs))
            mine.train_on(docs, state, begin + span * min(1.0, done / expected), span * min(1.0, n / expected), seed=done)
            done += n
        if done:
            tokens, sums = tokens + done, sums + pack(mine, state) * done
            yield pa.record_batch([pa.array([tokens], pa.int64()), pa.array([sums.astype("<f8").tobytes()], pa.binary())], ["tokens", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, sums = 0, 0.0
    for batch in batches:
        for n, s in zip(batch.column("tokens").to_pylist(), batch.column("sums"), strict=True):
            tokens, sums = tokens + n, sums + np.frombuffer(s.as_buffer(), "<f8")
    if tokens:
        yield pa.record_batch([pa.array([tokens], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["tokens", "sums"])


def fit(encoded: DataFrame, model: Model, max_tokens: int = MAX_TOKENS) -> None:
    """Train the model's weights on all rows of ``encoded`` that have a shard, each token once. The driver gets SUMS
    sums of weights a round."""
    shards = max(1, min(MAX_SHARDS, -(-model.tokens // max_tokens)))
    rounds = min(ROUNDS, shards)
    adam, kind = Adam.of(model.gru), kind_of(model)
    for r in range(rounds):
        rows = encoded.where(F.col("round") == r).select("shard", "s")
        dealt = rows.repartitionById(-(-(shards - r) // rounds), F.col("shard")).sortWithinPartitions("shard", F.xxhash64("s"), "s")
        step = _train(model.gru, adam, r / rounds, 1 / rounds, model.tokens / shards, kind)
        found = materialize(dealt.mapInArrow(step, "tokens long, sums binary"), "weights")
        tokens, sums = 0, 0.0
        for x in found.coalesce(SUMS).mapInArrow(_add, "tokens long, sums binary").toLocalIterator():
            tokens, sums = tokens + x["tokens"], sums + np.frombuffer(x["sums"], "<f8")
        discard(found)
        if tokens:
            unpack(sums / tokens, model.gru, adam)
            model.trained += tokens


def count_words(rows: DataFrame, top: int = TOP, head_words: int = HEAD) -> tuple[Model, DataFrame]:
    """(model not trained yet, counts: h, rare, c) from all ``rows`` (doc_id, text)."""
    counts = rows.select("text").mapInArrow(_count, "h long, rare int, c long").groupBy("h", "rare").agg(F.sum("c").alias("c"))
    counts = materialize(counts, "counts")
    best = counts.orderBy(F.desc("c"), "h").limit(head_words).toArrow()
    h, rare, c = (best.column(n).to_numpy() for n in ("h", "rare", "c"))
    symbol = np.where(np.arange(len(h)) < top, 1 + RARE + np.arange(len(h)), 0)
    n_top = min(top, len(h))
    order = np.argsort(h.view(np.uint64))
    head = Head(h.view(np.uint64)[order], c[order], symbol[order])
    tokens, words = np.zeros(RARE + 1), np.zeros(RARE + 1)
    for r in counts.groupBy("rare").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        tokens[r["rare"]], words[r["rare"]] = r["c"], r["n"]
    ends = rows.count()
    n, v = int(tokens.sum()) + ends, int(words.sum()) + (ends > 0)
    np.subtract.at(tokens, rare[:n_top], c[:n_top])
    np.subtract.at(words, rare[:n_top], 1)
    gru = Gru(max(n_top, 1))
    gru.start_from(np.concatenate([[ends], tokens[1:], c[:n_top] if n_top else [0]]))
    return Model(gru, head, n, v, ends, tokens, words), counts


def learn(rows: DataFrame, max_tokens: int = MAX_TOKENS, top: int = TOP, head_words: int = HEAD) -> tuple[Model, DataFrame]:
    """(model, counts: h, rare, c) from ``rows`` (doc_id, text). Counts are those of all rows, and the gated
    units learn from all of them too, in shards of about ``max_tokens`` tokens."""
    model, counts = count_words(rows, top, head_words)
    encoded = encode(rows, model, F.lit(True), max_tokens)
    fit(encoded, model, max_tokens)
    discard(encoded)
    return model, counts


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes in ``column``, or larger ones."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _score(gru: Gru, kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "s", SCORE_BYTES):
            for lo, hi in tk.slices(batch.column("s"), SCORE_BYTES):
                part = batch.slice(lo, hi - lo)
                lm = gru.score([np.frombuffer(x.as_buffer(), kind).astype(np.int32) for x in part.column("s")]) / np.log(10)
                cols = [part.column(c) for c in ("row", "doc_id", "n_tokens", "known", "base")]
                inside = part.column("inside").to_numpy()
                yield pa.record_batch([*cols, pa.array(lm + inside)], ["row", "doc_id", "n_tokens", "known", "base", "lm"])

    return run


def score_encoded(encoded: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    schema = "row long, doc_id long, n_tokens long, known long, base double, lm double"
    found = encoded.select("row", "doc_id", "n_tokens", "known", "base", "inside", "s").mapInArrow(_score(model.gru, kind_of(model)), schema)
    least = int(model.head.counts.min()) if len(model.head.counts) else 0
    tail = encoded.select("row", F.explode(F.arrays_zip(F.col("tail").alias("h"), F.col("times").alias("k"))).alias("t")).select("row", "t.h", "t.k")
    joined = tail.join(counts.where(F.col("c") <= least).select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = joined.groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.col("c") + F.lit(SMOOTH))).alias("rest"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more")
    )
    rest, more = F.coalesce("rest", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return found.join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + rest).alias("base_score"), (F.col("lm") + rest).alias("score"),
    )


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row, all tokens of its whole text.

    Null and empty texts have one token, the end. Equal rows are scored each. Without training
    text, base_score is that of N = V = 0 and the model is the one it starts from.
    """
    return score_encoded(encode(docs, model), model, counts)


def learn_and_score(docs: DataFrame, learned: Column) -> DataFrame:
    """``score`` of every row of ``docs`` under the model of the rows with ``learned``; texts are encoded once for both.
    Rows for which ``learned`` is null are not learned from."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"))
    model, counts = count_words(rows.where("learned").select("doc_id", "text"))
    encoded = encode(rows, model, F.col("learned"))
    fit(encoded, model)
    return score_encoded(encoded, model, counts)


def training(docs: DataFrame, of: int = 10) -> DataFrame:
    """The rows (doc_id, text) to learn from; a null doc_id is not held out of anything and not learned from."""
    return docs.where(part(docs["doc_id"], of) != 0).select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
