"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, weighted-shingle check.

Every benchmark item is compared with the windows of its own number of words. A similar window has the
share SIMILARITY of its weight in shingles of the items of its size; only windows that do are fingerprinted.

A fingerprint sums signs of shingles times the root of their weight, each occurrence for itself. So the cosine of two sums is the weight
they share over the root of the product of their weights, which is 0.889 or more wherever the weighted Jaccard is 0.8, however
weights are spread. A fingerprint has BITS bits in blocks of two bytes, and each block has a table of the items' values. Two
fingerprints within RADIUS bits agree in some block up to RADIUS // blocks bits, so looking up all values
so close to a window's, block by block, misses none; unrelated items are rarely met. At a cosine of 0.889 a pair is within the radius with
a probability of 0.92, so there are FAMILIES fingerprints of independent signs: one pair in 30,000 at the very limit is within
the radius in none, and fewer above it. What is found is judged by exact weighted Jaccard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratal.llm import textkernel as tk

SHINGLE = 5
SIMILARITY = 0.8
BITS = 256
BLOCKS = BITS // 16
FAMILIES = 4
#: A Jaccard of 0.8 makes 39 of 256 bits differ on average, with a deviation of six. A wider radius
#: would meet more of the unrelated items in some block: within two bits of sixteen are 3 % of them, within three 16 %.
RADIUS = 47
#: Benchmark text in one index. A larger benchmark is searched index by index, each over all documents.
INDEX_BYTES = 32 << 20

_VALUES = np.arange(1 << 16, dtype=np.uint16)
_ONES = np.bitwise_count(_VALUES)
#: What a block's value may differ by.
_MASKS = _VALUES[_ONES <= RADIUS // BLOCKS]
_LANES = [np.uint64(x) for x in range(BITS // 64)]


def signs(shingles: np.ndarray, family: int = 0) -> np.ndarray:
    """+1 and -1 for the BITS bits of each shingle's hash of a family."""
    raw = np.stack([tk.mix64(shingles ^ ((x + np.uint64(family * len(_LANES))) << np.uint64(56))) for x in _LANES], 1).astype("<u8").view(np.uint8)
    return np.unpackbits(raw.reshape(len(shingles), -1), axis=1).astype(np.float64) * 2 - 1


def prints(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, as BLOCKS numbers each, of summed weighted signs. Sums are rounded, so that their order is of no account."""
    return np.packbits(np.round(sums, 6) > 0, axis=1).view("<u2")


def occurrence(shingles: np.ndarray, times: np.ndarray) -> np.ndarray:
    """A shingle's first occurrence in a window is itself, each further one a shingle of its own."""
    return np.where(times > 0, tk.mix64(shingles + times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), shingles)


class Blocks:
    """Tables from a block's value to the fingerprints that have it."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.order = np.argsort(marks, axis=0, kind="stable")
        self.values = np.take_along_axis(marks, self.order, 0)

    def met(self, found: np.ndarray, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of ``found``, fingerprint) of all pairs that some block brings together, each once."""
        for at in range(0, len(found), step):
            part = found[at : at + step]
            pairs = []
            for b in range(BLOCKS):
                values = self.values[:, b]
                wanted = (part[:, b, None] ^ _MASKS).ravel()
                lo = np.searchsorted(values, wanted, "left")
                hit = np.flatnonzero(values[np.minimum(lo, len(values) - 1)] == wanted)
                many = np.searchsorted(values, wanted[hit], "right") - lo[hit]
                pairs.append(np.repeat(hit // len(_MASKS), many) * len(self.marks) + self.order[tk.ranges(lo[hit], many), b])
            each = np.unique(np.concatenate(pairs))
            yield at + each // len(self.marks), each % len(self.marks)

    def within(self, found: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row of ``found``, fingerprint) of all pairs within RADIUS bits."""
        for w, i in self.met(found):
            close = _ONES[found[w] ^ self.marks[i]].sum(1, dtype=np.int64) <= RADIUS
            yield from zip(w[close].tolist(), i[close].tolist(), strict=True)


def pieces(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Shingles of a run of words; a run of fewer than ``k`` is one."""
    return tk.runs_of(words, min(k, len(words))) if len(words) else np.zeros(0, np.uint64)


@dataclass
class Index:
    """Items of one index, grouped by their number of words."""

    known: np.ndarray  # sorted shingles of all items
    weighed: np.ndarray  # sorted shingles whose weight is not that of a rare one
    weight: np.ndarray  # log(1 + items / items with the shingle)
    rare: float  # weight of a shingle that no item has, or one
    groups: dict[int, tuple[list[int], list[Blocks], list[tuple[np.ndarray, np.ndarray]]]]  # words: ids, prints by family, counted shingles
    shingles: dict[int, np.ndarray]  # words: sorted shingles of the items of that size

    @classmethod
    def of(cls, items: list[tuple[int, str]], counted: tuple[np.ndarray, np.ndarray, int] | None = None) -> Index:
        """``counted``: sorted shingles that several items of the whole benchmark have, these items' numbers, and that of all items."""
        texts = pa.array([t for _, t in items], pa.string())
        words = tk.split_words(texts, lower=True)
        hashes = words.hashes()
        sets = []
        for (item, _), a, b in zip(items, words.first[:-1], words.first[1:], strict=True):
            if b > a:
                sets.append((item, int(b - a), *np.unique(pieces(hashes[a:b]), return_counts=True)))
        known, df = np.unique(np.concatenate([s[2] for s in sets]), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0))
        weighed, df, n_items = counted or (known, df, len(sets))
        out = cls(known, weighed, np.log1p(n_items / np.maximum(df, 1)), float(np.log1p(n_items)), {}, {})
        for item, n, shingles, counts in sorted(sets, key=lambda s: s[0]):
            ids, marks, kept = out.groups.setdefault(n, ([], [], []))
            ids.append(item)
            each = np.repeat(shingles, counts)
            times = tk.ranges(np.zeros(len(counts), np.int64), counts)
            marks.append(np.stack([out.print_of(each, times, f) for f in range(FAMILIES)]))
            kept.append((shingles, counts))
        out.groups = {n: (ids, [Blocks(np.stack(marks)[:, f]) for f in range(FAMILIES)], kept) for n, (ids, marks, kept) in out.groups.items()}
        out.shingles = {n: np.unique(np.concatenate([x[0] for x in kept])) for n, (_, _, kept) in out.groups.items()}
        return out

    def print_of(self, each: np.ndarray, times: np.ndarray, family: int) -> np.ndarray:
        """The fingerprint of a window's shingles; ``times``: how often each stands before."""
        return prints((signs(occurrence(each, times), family) * np.sqrt(self.weights(each))[:, None]).sum(0)[None])[0]

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(shingles), bool)
        place = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return self.known[place] == shingles

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.weighed):
            return np.full(len(shingles), self.rare)
        place = np.minimum(np.searchsorted(self.weighed, shingles), len(self.weighed) - 1)
        return np.where(self.weighed[place] == shingles, self.weight[place], self.rare)

    def similarity(self, window: np.ndarray, shingles: np.ndarray, counts: np.ndarray) -> float:
        """Weighted Jaccard: weights times the smaller counts over weights times the larger."""
        both, back = np.unique(np.concatenate([window, shingles]), return_inverse=True)
        mine = np.bincount(back[: len(window)], minlength=len(both))
        theirs = np.bincount(back[len(window) :], counts, len(both))
        w = self.weights(both)
        return float((w * np.minimum(mine, theirs)).sum() / (w * np.maximum(mine, theirs)).sum())

    def heavy(self, n: int, local: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        """Which windows of ``size`` shingles of ``local`` from ``at`` on have the share SIMILARITY of their weight in shingles of items of ``n`` words."""
        shingles, weight = self.shingles[n], self.weights(local)
        own = shingles[np.minimum(np.searchsorted(shingles, local), len(shingles) - 1)] == local
        whole, mine = (np.append(0, np.cumsum(x)) for x in (weight, weight * own))
        return np.flatnonzero(mine[at + size] - mine[at] >= SIMILARITY * (whole[at + size] - whole[at]) - 1e-6)

    def prints_of(self, local: np.ndarray, at: np.ndarray, size: int, family: int) -> np.ndarray:
        """Fingerprints of the windows, from running sums over each stretch of them; windows in which a shingle stands twice are summed for themselves."""
        out = np.empty((len(at), BLOCKS), np.uint16)
        parts = np.flatnonzero(np.concatenate([[True], np.diff(at) > size, [True]]))
        for a, b in zip(parts[:-1].tolist(), parts[1:].tolist(), strict=True):
            first = int(at[a])
            own = local[first : int(at[b - 1]) + size]
            sums = np.concatenate([np.zeros((1, BITS)), np.cumsum(signs(own, family) * np.sqrt(self.weights(own))[:, None], 0)])
            out[a:b] = prints(sums[at[a:b] - first + size] - sums[at[a:b] - first])
        order = np.argsort(local, kind="stable")
        same = local[order[1:]] == local[order[:-1]]
        before = np.full(len(local), -1)  # where the same shingle stood last
        before[order[1:][same]] = order[:-1][same]
        latest = -tk.sliding_min(-before, size)
        for w in np.flatnonzero(latest[at] >= at).tolist():
            window = local[at[w] : at[w] + size]
            by = np.argsort(window, kind="stable")
            starts = np.concatenate([[True], window[by][1:] != window[by][:-1]])
            times = np.empty(size, np.int64)
            times[by] = np.arange(size) - np.maximum.accumulate(np.where(starts, np.arange(size), 0))
            out[w] = self.print_of(window, times, family)
        return out

    def matches(self, words: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of a document's best window for each item it holds.
        ``hit``: places of known shingles of SHINGLE words."""
        for n, (ids, blocks, kept) in self.groups.items():
            size = min(n, len(words))  # a document shorter than the item is one window
            k = min(SHINGLE, n)
            if k < SHINGLE:
                runs = tk.runs_of(words, k)
                for item, (shingles, _) in zip(ids, kept, strict=True):
                    if len(at := np.flatnonzero(runs == shingles[0])):
                        yield item, int(at[0]), k, 1.0
                continue
            if not len(hit) or size < k:
                continue
            reach = size - k  # a window begins up to so many words before a shingle it holds
            lo, hi = np.maximum(hit - reach, 0), np.minimum(hit, len(words) - size)
            starts = np.unique(tk.ranges(lo, hi - lo + 1))
            first, last = starts[0], starts[-1] + reach + 1
            local = pieces(words[first : last + k - 1])
            at = starts - first
            at = at[self.heavy(n, local, at, reach + 1)]
            if not len(at):
                continue
            at = at[np.sort(np.unique(tk.runs_of(local, reach + 1)[at], return_index=True)[1])]  # equal windows: the first
            pairs = {p for f in range(FAMILIES) for p in blocks[f].within(self.prints_of(local, at, reach + 1, f))}
            best: dict[int, tuple[float, int]] = {}
            for x, y in sorted(pairs):
                x = int(at[x])
                s = self.similarity(local[x : x + reach + 1], *kept[y])
                if s >= SIMILARITY and s > best.get(y, (0.0, 0))[0]:
                    best[y] = s, x
            for y, (s, x) in best.items():
                yield ids[y], int(first + x), size, s


def found_in(column: pa.Array, index: Index) -> Iterator[tuple[int, tuple[int, int, int, float]]]:
    """(row, match) of a column of texts."""
    short = any(n < SHINGLE for n in index.groups)
    for lo, hi in tk.slices(column):
        words = tk.split_words(column.slice(lo, hi - lo), lower=True)
        hashes = words.hashes()
        places, _ = tk.valid_runs(words.first, SHINGLE)
        hit = places[index.hits(tk.runs_of(hashes, SHINGLE)[places])] if len(places) else places
        docs = np.searchsorted(words.first, hit, "right") - 1
        for d in range(hi - lo) if short else np.unique(docs).tolist():
            a, b = words.first[d], words.first[d + 1]
            mine = hit[np.searchsorted(docs, d) : np.searchsorted(docs, d, "right")] - a
            for m in index.matches(hashes[a:b], mine):
                yield lo + d, m


def _search(index: Index) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(found_in(batch.column("text"), index))
            ids = batch.column("doc_id").take(pa.array([r for r, _ in found], pa.int64()))
            cols = list(zip(*(m for _, m in found), strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.record_batch([ids, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "item_id", "word", "n_words", "similarity"])

    return run


def _without(index: Index) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, _ in found_in(batch.column("text"), index)]] = False
            yield batch.filter(pa.array(keep))

    return run


def usable(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"))


def item_blocks(benchmark: DataFrame, limit: int = INDEX_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about ``limit`` bytes, read one after the other."""
    block, size = [], 0
    for r in usable(benchmark).orderBy("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"].encode())
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's different shingles, and a null for the item itself if it has words."""
    for batch in batches:
        for lo, hi in tk.slices(batch.column(0)):
            words = tk.split_words(batch.column(0).slice(lo, hi - lo), lower=True)
            hashes = words.hashes()
            found = [np.unique(pieces(hashes[a:b])) for a, b in zip(words.first[:-1], words.first[1:], strict=True) if b > a]
            if found:
                yield pa.record_batch([pa.concat_arrays([pa.array(tk.signed(np.concatenate(found))), pa.nulls(len(found), pa.int64())])], ["h"])


def count_shingles(benchmark: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Over all items: shingles that several have, sorted, in how many, and the number of items with words.
    A shingle of one item weighs as much as one of none and needs no place here."""
    counts = usable(benchmark).select("text").mapInArrow(_item_shingles, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1 OR h IS NULL").toArrow()
    own = counts.filter(counts.column("h").is_null())
    counts = counts.filter(counts.column("h").is_valid())
    h, n = counts.column("h").to_numpy().view(np.uint64), counts.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order], own.column("n")[0].as_py() if own.num_rows else 0


def indexes(benchmark: DataFrame, limit: int = INDEX_BYTES) -> Iterator[Index]:
    """An index for each block of items; all have the weights of the whole benchmark."""
    counted, blocks = None, item_blocks(benchmark, limit)
    block = next(blocks, None)
    while block:
        after = next(blocks, None)
        if after and counted is None:
            counted = count_shingles(benchmark)
        yield Index.of(block, counted)
        block = after


def matches(docs: DataFrame, benchmark: DataFrame, limit: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, word, n_words, similarity: every item that a row of ``docs`` (doc_id, text) holds,
    at its best window (the first among equals).

    Words are runs of bytes other than white space, A-Z lower-cased. Null and wordless texts hold
    nothing; null items are left out; equal rows are each searched; rows without a doc_id are
    searched too. An item of fewer than five words is found where its words stand in a row.
    No row is shuffled; each index is of bounded size.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    schema = "doc_id long, item_id long, word long, n_words long, similarity double"
    out = None
    for index in indexes(benchmark, limit):
        found = rows.mapInArrow(_search(index), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, limit: int = INDEX_BYTES) -> DataFrame:
    """``docs`` without the rows whose text holds an item; all columns stay, and no row is shuffled."""
    for index in indexes(benchmark, limit):
        docs = docs.mapInArrow(_without(index), docs.schema)
    return docs
