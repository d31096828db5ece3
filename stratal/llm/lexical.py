"""Ranked lexical search: inverted shards, posting blocks of chosen lengths, and exact search that skips blocks.

A shard is a run of documents of one input partition, so texts are not shuffled: only term counts, and the posting lists of
the terms that are asked for. Terms are known by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from stratal.llm import textkernel as tk
from stratal.llm.scratch import discard, materialize

#: A shard ends after the document that brings it to so many bytes of text, or to so many documents.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: Postings of a block at most, and what one more block costs: as much as so many documents with a list's highest impact as error.
BLOCK, BLOCK_COST = 64, 8
#: Items that are searched together.
ITEMS = 1_024
#: Up to so many different terms of the items (8 bytes each) go to the tasks that read documents, which then leave out all others.
TERMS = 1 << 20

INDEX = "shard long, term long, df int, tokens long, docs binary, counts binary, many binary"


def _flush(shard: int, ids: list[pa.Array], h: np.ndarray, doc: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The shard's head (term null: document ids and lengths) and a row for each term."""
    own = pa.concat_arrays(ids)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    new_term = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    new = new_term.copy()
    new[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    tf = np.diff(at, append=len(h))
    first = np.flatnonzero(new_term[at])
    df = np.diff(first, append=len(at))
    known = np.asarray(own.is_valid()).astype(np.uint8)
    head = [shard, None, int((size > 0).sum()), int(size.sum()), np.asarray(own.fill_null(0)).tobytes(), size.astype("<u4").tobytes(), known.tobytes()]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 3]
    names = ["shard", "term", "df", "tokens", "docs", "counts", "many"]
    yield pa.record_batch([pa.array([v], k) for v, k in zip(head, kinds, strict=True)], names)
    if not len(first):
        return
    ends = np.append(first, len(at))
    large = tf >= 255
    many = np.concatenate([[0], np.cumsum(large)])[ends]
    data = [
        pa.array(np.full(len(first), shard)), pa.array(tk.signed(h[at[first]])), pa.array(df.astype(np.int32)), pa.nulls(len(first), pa.int64()),
        _slices(doc[at].astype("<u2"), ends), _slices(np.minimum(tf, 255).astype(np.uint8), ends), _slices(tf[large].astype("<u4"), many),
    ]
    whole = pa.record_batch(data, names)
    for a in range(0, len(first), 20_000):
        yield whole.slice(a, 20_000)


def _slices(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column: the bytes of ``values[ends[i]:ends[i + 1]]``."""
    offsets = (ends * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _invert(only: np.ndarray | None) -> Callable:
    def read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Of some documents: hash and document of each term that counts, terms a document has, bytes."""
        w = tk.split_terms(texts)
        h, length = w.hashes(), np.diff(w.first)
        doc = np.repeat(np.arange(len(length)), length)
        if only is not None:
            at = np.searchsorted(only, h)
            at[at == len(only)] = 0
            has = only[at] == h if len(only) else np.zeros(len(h), bool)
            h, doc = h[has], doc[has]
        return h, doc, length, len(w.data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, ids, size, docs = [], [], 0, 0
        for batch in batches:
            for a, b in tk.slices(batch.column("text"), 4 << 20):
                while a < b:
                    m = min(b - a, SHARD_DOCS - docs)
                    h, doc, length, n = read(batch.column("text").slice(a, m))
                    held.append((h, (doc + docs).astype(np.uint16), length))
                    ids.append(batch.column("doc_id").slice(a, m))
                    a, docs, size = a + m, docs + m, size + n
                    if size >= SHARD_BYTES or docs == SHARD_DOCS:
                        yield from _flush(number, ids, *(np.concatenate(x) for x in zip(*held, strict=True)))
                        number, held, ids, size, docs = number + 1, [], [], 0, 0
        if docs:
            yield from _flush(number, ids, *(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def index(docs: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """The inverted shards of ``docs`` (doc_id, text): ``INDEX`` rows, one for each shard and one for each of its terms, or of
    those whose hashes are in ``only`` (rising). The counts of a head are of all terms."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(_invert(only), INDEX)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        w = tk.split_terms(batch.column("text"))
        h = tk.signed(w.hashes())
        found = [np.unique(h[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        item = np.repeat(np.arange(len(found)), [len(x) for x in found])
        if len(item):
            yield pa.record_batch([batch.column("item").take(pa.array(item)), pa.array(np.concatenate(found))], ["item", "term"])


def block_ends(docs: np.ndarray, scores: np.ndarray, first: np.ndarray, most: int = BLOCK, cost: float = BLOCK_COST) -> tuple[np.ndarray, np.ndarray]:
    """Where the blocks of the lists ``docs[first[i]:first[i + 1]]`` end, and where each list's blocks begin among them: of all
    ways to cut a list into blocks of ``most`` postings at most, the one whose bounds are nearest.

    A block bounds all documents from its first to its last by its highest score; its error is the sum of what that is above the score of
    each, which is 0 for those without a posting. Each block costs ``cost`` times the list's highest score. The least total for the first j
    postings is found for j = 1, 2, ... from those before, for all lists side by side.
    """
    size = np.diff(first)
    lists = len(size)
    if not len(scores):
        return np.zeros(0, np.int64), np.zeros(lists + 1, np.int64)
    order = np.argsort(-size, kind="stable")
    start, sizes = first[:-1][order], size[order]
    price = cost * np.maximum(1e-9, np.maximum.reduceat(scores, first[:-1])[order])
    longest = int(sizes[0])
    live = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")  # lists with a j-th posting
    before = np.zeros((most + 1, lists))  # ring of the last ``most`` + 1 least totals; the sum of all scores is the same for every way
    high = np.zeros((most, lists))  # row b - 1: the highest of the b postings up to j
    low = np.zeros((most, lists))  # and the first document of these
    back = np.zeros(len(scores), np.int16)  # length of the last block of the best way to cut up to each posting
    for j in range(1, longest + 1):
        n, reach = int(live[j - 1]), min(j, most)
        new, here = scores[start[:n] + j - 1].astype(float), docs[start[:n] + j - 1].astype(float)
        low[1:reach, :n] = low[: reach - 1, :n]
        low[0, :n] = here
        high[1:reach, :n] = high[: reach - 1, :n]
        high[0, :n] = 0
        np.maximum(high[:reach, :n], new, out=high[:reach, :n])
        total = (here + 1 - low[:reach, :n]) * high[:reach, :n]
        total += before[np.arange(j - 1, j - reach - 1, -1) % (most + 1), :n]
        pick = np.argmin(total, 0)
        before[j % (most + 1), :n] = total[pick, np.arange(n)] + price[:n]
        back[start[:n] + j - 1] = pick + 1
    ends = np.zeros(len(scores), bool)
    at, begin = first[1:] - 1, first[:-1]
    while len(at):
        ends[at] = True
        at = at - back[at]
        go = at >= begin
        at, begin = at[go], begin[go]
    stops = np.flatnonzero(ends) + 1
    return stops, np.searchsorted(stops, first, "right")


@dataclass
class Shard:
    """Posting lists of a shard, one after the other, with their blocks. ``first``: where a term's postings begin, ``blocks``:
    where its blocks do. A posting's impact is its score but for the term's weight; ``top`` is a block's highest."""

    ids: np.ndarray
    known: np.ndarray
    terms: np.ndarray
    first: np.ndarray
    docs: np.ndarray
    impact: np.ndarray
    blocks: np.ndarray
    ends: np.ndarray
    top: np.ndarray

    @classmethod
    def of(cls, head: dict, rows: list[dict], documents: int, tokens: int) -> Shard:
        """From ``INDEX`` rows of one shard; ``documents``, ``tokens``: of the whole corpus."""
        length = np.frombuffer(head["counts"], "<u4").astype(np.int64)
        m = 50 + _scaled(length, documents, tokens)
        rows = sorted(rows, key=lambda r: r["term"])
        docs = np.frombuffer(b"".join(r["docs"] for r in rows), "<u2").astype(np.int64)
        tf = np.frombuffer(b"".join(r["counts"] for r in rows), np.uint8).astype(np.int64)
        tf[tf == 255] = np.frombuffer(b"".join(r["many"] for r in rows), "<u4")
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[docs])
        first = np.concatenate([[0], np.cumsum([r["df"] for r in rows])]).astype(np.int64)
        stops, blocks = block_ends(docs, impact, first)
        top = np.maximum.reduceat(impact, np.concatenate([[0], stops[:-1]])) if len(stops) else impact
        terms = np.array([r["term"] for r in rows], np.int64)
        return cls(np.frombuffer(head["docs"], np.int64), np.frombuffer(head["many"], bool), terms, first, docs, impact, blocks, stops, top)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of the ``k`` best with a score above 0, equal scores by rising id; those beside them may follow.

        The blocks of the terms cut the documents into stretches, whose bound is the sum of what the blocks over them allow. Stretches
        are looked into from the highest bound on; those whose bound is below the ``k``-th score, and
        blocks that lie in no other, are skipped.
        """
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        has = (self.terms[at] == terms) & (weights > 0) if len(self.terms) else np.zeros(len(terms), bool)
        at, weights = at[has], weights[has]
        none = np.zeros(0, np.int64)
        if not len(at):
            return none, none
        n = self.blocks[at + 1] - self.blocks[at]
        block, weight = tk.ranges(self.blocks[at], n), np.repeat(weights, n)
        start = np.where(block > 0, self.ends[block - 1], 0)
        low, high = self.docs[start], self.docs[self.ends[block] - 1] + 1
        step = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(step, low, weight * self.top[block])
        np.add.at(step, high, -weight * self.top[block])
        bound = np.cumsum(step)[:-1]  # of each document; the same over a stretch
        score, seen, least, share = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool), 1, 4 * k
        while True:
            left = np.flatnonzero(~seen & (bound >= least))
            if not len(left):
                break
            if len(left) > share:
                limit = np.partition(bound[left], len(left) - share)[len(left) - share]
                left = left[bound[left] >= limit]
            look = np.zeros(len(self.ids) + 1, np.int64)
            look[left + 1] = 1
            inside = np.cumsum(look)
            hit = inside[high] > inside[low]
            posting = tk.ranges(start[hit], self.ends[block[hit]] - start[hit])
            w = np.repeat(weight[hit], self.ends[block[hit]] - start[hit])
            doc = self.docs[posting]
            own = look[doc + 1] > 0
            np.add.at(score, doc[own], w[own] * self.impact[posting[own]])
            seen[left] = True
            done = np.flatnonzero(seen & (score > 0))
            if len(done) >= k:
                least = max(1, int(np.partition(score[done], len(done) - k)[len(done) - k]))
            share *= 4
        found = np.flatnonzero(score >= least)
        order = np.lexsort((self.ids[found], ~self.known[found], -score[found]))[:k]
        return found[order], score[found[order]]


def _scaled(length: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """(50 * length * documents) div tokens, exactly."""
    if len(length) and 50 * int(length.max()) * documents >= 1 << 63:
        return np.array([50 * int(n) * documents // tokens for n in length], np.int64)
    return 50 * length * documents // max(1, tokens)


SEALED = "shard long, ids binary, known binary, terms binary, first binary, docs binary, impact binary, blocks binary, ends binary, top binary"
_FIELDS = ("ids", "known", "terms", "first", "docs", "impact", "blocks", "ends", "top")


def _seal(documents: int, tokens: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["term"] is None)
        s = Shard.of(head, [r for r in rows if r["term"] is not None], documents, tokens)
        values = [pa.array([head["shard"]], pa.int64()), *(pa.array([getattr(s, c).tobytes()], pa.binary()) for c in _FIELDS)]
        return pa.table(values, ["shard", *_FIELDS])

    return run


def _search(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(*(np.frombuffer(row[c], bool if c == "known" else np.int64) for c in _FIELDS))
                item, term, weight = (np.array([w[c] for w in row["words"]], np.int64) for c in ("item", "term", "weight"))
                order = np.argsort(item, kind="stable")
                item, term, weight = item[order], term[order], weight[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(item)) + 1, [len(item)]])
                found = [(item[a], *s.search(term[a:b], weight[a:b], k)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
                if found:
                    doc = np.concatenate([f[1] for f in found])
                    items = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                    ids = pa.array(s.ids[doc], mask=~s.known[doc])
                    yield pa.record_batch([pa.array(items), ids, pa.array(np.concatenate([f[2] for f in found]))], ["item", "doc_id", "score"])

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` (item_id, text) the ``k`` documents (doc_id, text) of the highest
    score, equal scores by rising doc_id, null last.

    Each row counts, repeated ones too: a document that is there twice is found twice, an item that is there twice has two lists.
    Null and empty texts have no term: as documents they are in no count, as items they have no list, nor has an item
    of unknown terms only. Other columns are not read; empty tables give no row. Bytes that are no UTF-8 belong to terms.
    """
    asked = items.select(F.monotonically_increasing_id().alias("item"), items["item_id"].alias("item_id"), items["text"].cast("string").alias("text"))
    asked = materialize(asked, "items", compact=True)
    words = materialize(asked.select("item", "text").mapInArrow(_terms, "item long, term long"), "item-terms", compact=True)
    terms = words.select("term").distinct()
    few = terms.limit(TERMS + 1).count() <= TERMS
    only = np.sort(np.asarray(terms.toArrow().column("term")).view(np.uint64)) if few else None
    held = materialize(index(docs, only), "postings")
    total = held.where("term IS NULL").agg(F.sum("df").alias("n"), F.sum("tokens").alias("l")).first()
    n, tokens = int(total["n"] or 0), int(total["l"] or 0)
    df = held.where("term IS NOT NULL").select("term", "df").join(terms, "term", "left_semi")
    weight = F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.sum("df") + 1))).alias("weight")
    weights = materialize(df.groupBy("term").agg(weight), "weights", compact=True)
    blocks = -(-asked.count() // ITEMS)
    weighted = words.join(weights, "term").groupBy(F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))).cast("int").alias("block"))
    questions = materialize(weighted.agg(F.collect_list(F.struct("item", "term", "weight")).alias("words")), "questions", compact=True)  # about ITEMS items a row
    wanted = held.join(weights.select("term"), "term", "left_semi").unionByName(held.where("term IS NULL"))
    sealed = wanted.groupBy("shard").applyInArrow(_seal(n, tokens), SEALED)
    dealt = sealed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(1, blocks) - 1))))
    found = dealt.join(questions, "block").select(*_FIELDS, "words").mapInArrow(_search(k), "item long, doc_id long, score long")
    order = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = materialize(found.withColumn("rank", order).where(F.col("rank") <= k), "best", compact=True)
    out = materialize(best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"), "ranked", compact=True)
    for df in (held, asked, words, weights, questions, best):
        discard(df)
    return out
