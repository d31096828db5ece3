"""Substring de-duplication as a relative Lempel-Ziv parse against all earlier documents.

The reference is every document with a smaller doc_id, indexed by anchors: of the phrases of
ANCHOR words in a window, the one of least hash. Equal windows have equal anchors, so the
index can be dealt out by anchor: an entry is a run of windows that share an anchor, with the
first document that has this run and its place there. A document is factored from left to right:
a factor copies the run at hand from its entry, and goes on through the runs that follow as long as the
source goes on in step. Runs at which a factor may begin or end (their anchor is
known, their run is not) are checked window by window, which lengthens factors up to their last
common window. Factors of ``window`` words or more are duplicate spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratal.llm import textkernel as tk
from stratal.llm.scratch import discard, materialize

WINDOW = 50
ANCHOR = 10


def first_least(x: np.ndarray, k: int) -> np.ndarray:
    """Place of the first least of each ``k`` neighbours, by doubling."""
    place = np.arange(len(x), dtype=np.int64)
    size = 1
    while size < k:
        step = min(size, k - size)
        right = x[step:] < x[: len(x) - step]
        place = np.where(right, place[step:], place[: len(place) - step])
        x = np.minimum(x[step:], x[: len(x) - step])
        size += step
    return place


def steps(words: tk.Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Steps of every document: document, first window, windows, anchor's hash, run's hash."""
    w = words.hashes()
    places, counts = tk.valid_runs(words.first, window)
    if not len(places):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    grams, whole = tk.runs_of(w, anchor), tk.runs_of(w, window)
    at = first_least(grams, window - anchor + 1)[places]
    doc = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(places), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(places)) - 1
    # the first and the last window of a run overlap, as a run has window - anchor + 1 windows at most
    n = (end - begin + 1).astype(np.uint64)
    run = tk.mix64(whole[places[begin]] * np.uint64(3) + whole[places[end]] * np.uint64(0x9E3779B97F4A7C15) + n)
    doc = doc[begin]
    return doc, places[begin] - words.first[doc], end - begin + 1, grams[at[begin]], run


def _steps(window: int, anchor: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in tk.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                doc, at, n, key, same = steps(tk.split_words(part.column("text")), window, anchor)
                ids = [part.column(c).take(pa.array(doc)) for c in ("doc_id", "mark")]
                yield pa.record_batch([*ids, pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(tk.signed(key)), pa.array(tk.signed(same))], ["doc_id", "mark", "at", "n", "anchor", "run"])

    return run


def _windows(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in tk.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                words = tk.split_words(part.column("text"))
                whole = tk.runs_of(words.hashes(), window)
                asks = part.column("asks").to_pylist()
                doc = np.repeat(np.arange(len(asks)), [len(a) for a in asks])
                begin = np.array([x["at"] for a in asks for x in a], np.int64)
                n = np.array([x["n"] for a in asks for x in a], np.int64)
                at = tk.ranges(begin, n)
                doc = np.repeat(doc, n)
                ids = [part.column(c).take(pa.array(doc)) for c in ("doc_id", "mark")]
                yield pa.record_batch([*ids, pa.array(at, pa.int32()), pa.array(tk.signed(whole[words.first[doc] + at]))], ["doc_id", "mark", "at", "run"])

    return run


def later(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` (kept in a table) with ``lo``, the least doc_id of their key, and a place of the key there, where it has
    several documents. The keys' side is a table too, so that Spark can split a key that very many rows have."""
    least = rows.groupBy(*keys).agg(F.min("doc_id").alias("lo"), F.min_by("at", "doc_id").alias("lo_at"), F.max("doc_id").alias("hi")).where("lo < hi")
    return rows.join(materialize(least.drop("hi"), name), keys)


def spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Copied windows of each document that has any: doc_id, mark, spans (array of ``at``, ``n``: first window and how many;
    ``lo``, ``lo_at``: the source document and the first window there).

    Null texts have no windows. Rows without a doc_id have no place in the order: nothing is
    copied from them or to them. Rows with equal doc_ids never copy from each other.
    """
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "mark", "text")
    found = materialize(rows.mapInArrow(_steps(window, anchor), "doc_id long, mark int, at int, n int, anchor long, run long"), "steps")
    shared = found.groupBy("anchor").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("run") != F.max("run")).alias("mixed")
    ).where("lo < hi").select("anchor", "mixed")
    shared = materialize(shared, "anchors")
    known = all_known = materialize(found.join(shared, "anchor"), "known")
    discard(found)
    discard(shared)
    least = known.groupBy("anchor", "run").agg(F.min("doc_id").alias("lo"), F.min_by("at", "doc_id").alias("lo_at"))
    least = materialize(least, "least")
    known = known.join(least, ["anchor", "run"]).select("doc_id", "mark", "at", "n", "lo", "lo_at", "mixed")
    known = materialize(known.where("doc_id > lo OR mixed"), "judged")
    discard(all_known)
    discard(least)
    whole = known.where("doc_id > lo").select("doc_id", "mark", "at", "n", "lo", "lo_at")
    # a run's first document speaks for all: later ones have their windows already
    asks = known.where("doc_id = lo").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("at", "n")).alias("asks"))
    windows = rows.join(asks, ["doc_id", "mark"]).mapInArrow(_windows(window), "doc_id long, mark int, at int, run long")
    edges = later(materialize(windows, "edges"), ["run"], "edge-least").where("doc_id > lo").select("doc_id", "mark", "at", F.lit(1).alias("n"), "lo", "lo_at")
    return whole.unionByName(edges).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("at", "n", "lo", "lo_at")).alias("spans"))


def factored(found: list[dict], window: int) -> list[tuple[int, int, int, int]]:
    """(first word, words, source document, first word there) of a document's factors, from left to right: a factor goes on
    while the next copied windows have the same source in step."""
    out: list[list[int]] = []
    for x in sorted(found, key=lambda x: (x["at"], -x["n"])):
        at, n, source, place = x["at"], x["n"], x["lo"], x["lo_at"]
        if out and out[-1][2] == source and place - at == out[-1][3] - out[-1][0] and at <= out[-1][0] + out[-1][1] - window + 1:
            out[-1][1] = max(out[-1][1], at + n - 1 + window - out[-1][0])
        else:
            out.append([at, n - 1 + window, source, place])
    return [tuple(x) for x in out]


def covered(n_words: int, factors: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Which words lie in a factor."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, [at for at, *_ in factors], 1)
    np.add.at(change, [at + n for at, n, *_ in factors], -1)
    return np.cumsum(change[:-1]) > 0


def _factors(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *f) for d, found in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), strict=True) for f in factored(found, window)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "at", "n_words", "source_id", "source_at"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.withColumn("mark", F.hash("text"))


def factors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The factors of every document: doc_id, at, n_words, source_id, source_at (places in words). The words are those of the
    source, a document of smaller doc_id, from source_at on; null and short texts have none."""
    found = spans(keyed(docs), window, anchor).select("doc_id", "spans")
    return found.mapInArrow(_factors(window), "doc_id long, at long, n_words long, source_id long, source_at long")


def _remove(window: int, with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, gone, kept, digest = [], [], [], []
            for text, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if found:
                    drop = covered(len(words), factored(found, window))
                    gone.append(int(drop.sum()))
                    words = [words[i] for i in np.flatnonzero(~drop)]
                else:
                    gone.append(0)
                left = b" ".join(words)
                if with_text:
                    kept.append(left if gone[-1] else text)
                digest.append(hashlib.sha256(left).hexdigest())
            others = [c for c in batch.schema.names if c not in ("text", "spans", "mark")]
            columns = [batch.column(c) for c in others] + [pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            names = [*others, "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept_text")
            yield pa.record_batch(columns, names)

    return run


def remove_copies(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """Remove each word that lies in a window of ``window`` words which an earlier document has too.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by one space) and,
    if wanted, kept_text (the text itself where nothing was removed); rows as many as in ``docs``.
    Windows are judged on the input. Null texts have no words; rows without a doc_id stay as they
    are. Only doc_id and text are read, so other columns may have any name.
    """
    rows = keyed(docs)
    joined = rows.join(spans(rows, window, anchor), ["doc_id", "mark"], "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text binary" * with_text
    out = joined.mapInArrow(_remove(window, with_text), schema)
    return out.withColumn("kept_text", F.col("kept_text").cast("string")) if with_text else out


def rewrite(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` (doc_id, text, n_chars, any others) with the words of ``remove_copies`` gone from the texts that
    have such; their n_chars follows. A document of which nothing is left goes. Other columns stay."""
    rest = F.struct(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns)))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), rest.alias("rest"))
    rows = rows.withColumn("mark", F.hash("text"))
    joined = rows.join(spans(rows.drop("rest"), window, anchor), ["doc_id", "mark"], "left")
    kind = rows.schema["rest"].dataType.simpleString()
    schema = f"doc_id long, rest {kind}, n_words long, n_removed long, kept_sha256 string, kept_text binary"
    kept = joined.mapInArrow(_remove(window, True), schema).where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    text = F.col("kept_text").cast("string")
    new = {"text": text, "n_chars": F.char_length(text)}
    columns = []
    for i, (c, t) in enumerate(docs.dtypes):
        old = F.col(f"rest.c{i}")
        columns.append((F.when(changed, new[c].cast(t)).otherwise(old) if c in new else old).alias(c))
    return kept.select(*columns)
