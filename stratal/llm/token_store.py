"""Token ids in binary files: one concatenated id array, document boundaries in Elias-Fano code."""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from stratal.llm import textkernel as tk
from stratal.llm.scratch import materialize

#: Blocks are ranges of doc_id of about BLOCK_BYTES of text, sorted by a task each. There are MAX_BLOCKS at most, beyond which they
#: grow (the sort spills, all else takes a block in as it comes); the driver gets a number of each. A file ends with the
#: segment that brings it to FILE_BYTES.
MAX_BLOCKS = 10_000
BLOCK_BYTES = 24 << 20
FILE_BYTES = 32 << 20
SEGMENT_IDS = 1 << 20
#: Words whose ids a worker keeps, at about 25 bytes each.
CACHE_WORDS = 2_000_000
#: Texts are encoded in slices of so many bytes.
SLICE = 2 << 20
#: Characters that end a word as a piece of their own.
MARKS = ".,!;:?|%$&*#"
MAGIC = b"STK1"
_HEAD = struct.Struct("<4sQBQQqQQQ")  # magic, bytes of the segment, id width, documents, documents without an id, least doc_id, ids, bytes of two codes


class EliasFano:
    """A rising sequence of n numbers below u in about n * (2 + log2(u / n)) bits.

    Each number's low bits lie side by side; its high part is a one in a bit vector at
    place high + rank. ``select(i)`` finds the i-th one from a sampled directory.
    """

    SAMPLE = 256
    _FIXED = struct.Struct("<QBQQQ")

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        shifts = np.arange(width, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, width, low, np.packbits(bits, bitorder="little"), ones[:: cls.SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = self._FIXED.pack(self.n, self.width, len(self.low), len(self.high), len(self.samples))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes | memoryview) -> EliasFano:
        n, width, a, b, c = cls._FIXED.unpack_from(raw)
        at = cls._FIXED.size
        low = np.frombuffer(raw, np.uint8, a, at)
        high = np.frombuffer(raw, np.uint8, b, at + a)
        return cls(n, width, low, high, np.frombuffer(raw, "<u4", c, at + a + b))

    def _low(self, i: int) -> int:
        at = i * self.width
        raw = int.from_bytes(self.low[at // 8 : (at + self.width + 7) // 8].tobytes(), "little")
        return (raw >> (at % 8)) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """The i-th number, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // self.SAMPLE])
        to_go, byte = i % self.SAMPLE, place // 8
        bits = int(self.high[byte]) >> (place % 8) << (place % 8)
        while (ones := bits.bit_count()) <= to_go:
            to_go -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(to_go):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        return ((place - i) << self.width) | self._low(i)

    def to_array(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if self.width:
            bits = np.unpackbits(self.low, count=self.n * self.width, bitorder="little").reshape(self.n, self.width)
            out |= (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return out.astype(np.int64)


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    """One segment: header, codes of the boundaries and of the rising doc_ids (nulls come first), ids."""
    ends = np.cumsum([len(x) for x in ids])
    flat = np.concatenate(ids).astype("<u2" if width == 2 else "<u4")
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    bounds = EliasFano.of(np.concatenate([[0], ends])).to_bytes()
    names = EliasFano.of(np.array([d - least for d in known], np.uint64)).to_bytes()
    size = _HEAD.size + len(bounds) + len(names) + flat.nbytes
    head = _HEAD.pack(MAGIC, size, width, len(ids), len(ids) - len(known), least, len(flat), len(bounds), len(names))
    return head + bounds + names + flat.tobytes()


class Segment:
    """Reads one packed segment; ``document(i)`` touches only that document's bytes."""

    def __init__(self, raw: memoryview):
        magic, self.size, self.width, self.n_docs, self.n_null, self.least, self.n_ids, a, b = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size
        self.bounds = EliasFano.from_bytes(raw[at : at + a])
        self.names = EliasFano.from_bytes(raw[at + a : at + a + b])
        self.ids = np.frombuffer(raw, "<u2" if self.width == 2 else "<u4", self.n_ids, at + a + b)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + (self.names.to_array() + self.least).tolist()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def segments(raw: bytes) -> Iterator[Segment]:
    """Segments of a file; a line feed follows each."""
    view, at = memoryview(raw), 0
    while at < len(view):
        yield (s := Segment(view[at:]))
        at += s.size + 1


#: The normalizer and the pre-tokenizer under which a text's ids are those of its words one after the other.
BY_WORD = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder:
    """Ids of texts from a tokenizers file. Where its parts are those of BY_WORD, words are encoded once and the ids
    of those seen are kept, CACHE_WORDS at most; under any other file whole texts are encoded."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        parts = {"normalizer": "normalizers", "pre_tokenizer": "pretokenizers"}
        self.by_word = all((spec[k] or {}).get(name) == BY_WORD[k] for k, name in parts.items())
        # a special token of its own parts the words of one call, so that they need no call each
        self.between = next((t["content"] for t in spec["added_tokens"] if t["special"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and "<|" in t["content"]), None)
        self.by_word = self.by_word and self.between is not None
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = "<u2" if self.width == 2 else "<u4"
        self.end = end_id
        self._forget()
        if self.by_word:
            self.letters = Tokenizer.from_file(path)
            self.letters.normalizer = normalizers.Lowercase()
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            suffix = spec["model"]["end_of_word_suffix"]
            self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True

    def _forget(self) -> None:
        """Words known by their hashes, rising, with the place and number of their ids."""
        self.hashes, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.kind)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, ids: np.ndarray, edges: np.ndarray, skip: int) -> list[bytes]:
        """Ids between the places ``edges``, of which the first ``skip`` go."""
        raw, at = ids.tobytes(), (edges * self.width).tolist()
        return [raw[a + skip * self.width : b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _parted(self, words: list[str]) -> list[bytes]:
        """Ids of any words, with a special token between two."""
        ids = np.array(self.tokenizer.encode_batch_fast([self.between + self.between.join(words)], add_special_tokens=False)[0].ids, self.kind)
        return self._cut(ids, np.append(np.flatnonzero(ids == self.tokenizer.token_to_id(self.between)), len(ids)), 1)

    def _lettered(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters: each is one piece, which ends at its only id with the suffix."""
        text = " ".join(words)
        if unicodedata.is_normalized("NFC", text):
            ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            edges = np.flatnonzero(self.closes[ids]) + 1
            if len(edges) == len(words) and edges[-1] == len(ids):
                return self._cut(ids, np.append(0, edges), 0)
        return self._parted(words)

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of different words. Marks after letters are a piece of their own, so 'word,' is 'word' and ','."""
        stems = [w.rstrip(MARKS) for w in words]
        lettered = [t.isalpha() and t.lower().isalpha() for t in stems]
        special = ["<|" in w for w in words]
        pieces: dict[str, bytes] = {"": b""}
        letters = list({t for t, x in zip(stems, lettered, strict=True) if x})
        others = [w for w, x, y in zip(words, lettered, special, strict=True) if not x and not y]
        others += list({w[len(t) :] for w, t, x in zip(words, stems, lettered, strict=True) if x and len(t) < len(w)}.difference(others))
        for texts, encode in ((letters, self._lettered), (others, self._parted)):
            for at in range(0, len(texts), 1024):
                pieces.update(zip(texts[at : at + 1024], encode(texts[at : at + 1024]), strict=True))
        own = [w for w, x in zip(words, special, strict=True) if x]
        pieces.update(zip(own, self._whole(own), strict=True))
        return [pieces[t] + pieces[w[len(t) :]] if x else pieces[w] for w, t, x in zip(words, stems, lettered, strict=True)]

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Add words, whose hashes rise, to those known."""
        found = self.word_ids([w.decode("utf-8", "replace") for w in words])
        count = np.fromiter(map(len, found), np.int64, len(found)) // self.width
        at = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), self.kind)])
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.count = (np.insert(old, place, new) for old, new in ((self.hashes, hashes), (self.at, at), (self.count, count)))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (bytes) one after the other, each with the end, and the places where texts begin and end.
        Bytes that are no UTF-8 count as U+FFFD."""
        if not self.by_word:
            found = self._whole([(t or b"").decode("utf-8", "replace") for t in column.to_pylist()])
            ids, places = np.frombuffer(b"".join(found), self.kind), np.append(0, np.cumsum([len(x) // self.width for x in found])).astype(np.int64)
        else:
            ids, places = self._by_word(tk.split_words(column))
        # an end after each text
        n = len(places) - 1
        return np.insert(ids, places[1:], np.array(self.end).astype(self.kind)), places + np.arange(n + 1)

    def _by_word(self, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        if not len(w.starts):
            return np.zeros(0, self.kind), np.zeros(len(w.first), np.int64)
        # the tokenizer lower-cases, but finds its special tokens before; A-Z early makes more words alike
        data = tk.lowered(w.data)
        for i in np.unique(np.searchsorted(w.starts, np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))), "right") - 1).tolist():
            data[w.starts[i] : w.ends[i]] = w.data[w.starts[i] : w.ends[i]]
        w.data = data
        hashes, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        if len(self.hashes) > CACHE_WORDS:
            self._forget()
        new = np.flatnonzero(~self._known(hashes))
        if len(new):
            raw, places = w.data.tobytes(), first[new]
            self._learn(hashes[new], [raw[a:b] for a, b in zip(w.starts[places].tolist(), w.ends[places].tolist(), strict=True)])
        place = np.searchsorted(self.hashes, hashes)
        at, count = self.at[place][back], self.count[place][back]
        return self.ids[tk.ranges(at, count)], np.append(0, np.cumsum(count))[w.first]

    def _known(self, hashes: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.hashes, hashes)
        return np.append(self.hashes, np.uint64(0))[place] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder_for(path: str, end_id: int) -> WordEncoder:
    """One for each worker process, so that later tasks profit from words already seen."""
    key = (path, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(path, end_id)
    return _ENCODERS[key]


def _tokenize(path: str, end_id: int, cuts: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(path, end_id)
        places = np.array(cuts, np.int64)
        for batch in batches:
            for lo, hi in tk.slices(batch.column(1), SLICE):
                part = batch.slice(lo, hi - lo)
                flat, edges = enc.encode(part.column(1).cast(pa.binary()))
                raw, at = flat.tobytes(), (edges * enc.width).tolist()
                doc, ids = part.column(0), [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                block = np.searchsorted(places, np.asarray(doc.fill_null(-(2**63))), "left")
                yield pa.record_batch(
                    [pa.array(block, pa.int32()), doc, pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["block", "doc_id", "mark", "ids"],
                )

    return run


def _pack(width: int, segment_ids: int, file_bytes: int) -> Callable:
    """Segments with their block, part (file of the block) and place in the block."""
    kind = "<u2" if width == 2 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, held, block = [], [], 0, None
        last, part, place, size = None, 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal last, part, place, size
            blob = pack_segment(names, ids, width)
            if block != last:
                last, part, place, size = block, 0, 0, 0
            elif size >= file_bytes:
                part, size = part + 1, 0
            place, size = place + 1, size + len(blob)
            return pa.record_batch([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([place], pa.int64()), pa.array([blob], pa.binary())], ["block", "part", "place", "blob"])

        for batch in batches:
            for b, d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if ids and (b != block or held >= segment_ids):
                    yield flush()
                    names, ids, held = [], [], 0
                block = b
                names.append(d)
                ids.append(np.frombuffer(raw.as_buffer(), kind))
                held += len(ids[-1])
        if ids:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_bytes: int = BLOCK_BYTES, segment_ids: int = SEGMENT_IDS, file_bytes: int = FILE_BYTES) -> None:
    """Encode ``docs`` (doc_id, text) and write the ids in ascending doc_id order under ``path``.

    Null texts count as empty: their only id is ``end_id``. Null doc_ids come first; rows
    with equal doc_ids stand in order of their ids' checksum. An empty table writes no file.
    Blocks are ranges of doc_id, in folders block=0, block=1, ... whose folders part=0, part=1, ... have a file
    each; only ids are shuffled, not texts.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    stats = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()
    n = max(1, min(MAX_BLOCKS, -(-(stats["b"] or 0) // block_bytes)))
    cuts: list[int] = []
    if n > 1:
        found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0]
        cuts = sorted(set(found or []))
    width = encoder_for(tokenizer, end_id).width
    ids = rows.mapInArrow(_tokenize(tokenizer, end_id, cuts), "block int, doc_id long, mark long, ids binary")
    # a block goes to the task of its number: none has two
    dealt = ids.repartitionById(len(cuts) + 1, F.col("block")).sortWithinPartitions("block", F.asc_nulls_first("doc_id"), "mark", "ids")
    packed = dealt.select("block", "doc_id", "ids").mapInArrow(_pack(width, segment_ids, file_bytes), "block int, part int, place long, blob binary")
    # the order that the sink asks for and one more column, so that no sort of its own can exchange segments of a file
    packed = packed.sortWithinPartitions("block", "part", "place")
    # the text sink writes a string's bytes as they are: the blob and a line feed, by any file system Spark knows
    values = packed.select("block", "part", F.col("blob").cast("string").alias("value"))
    values.write.partitionBy("block", "part").text(path)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            block, part = (int(file.rpartition(f"{k}=")[2].split("/")[0]) for k in ("block", "part"))
            start = 0
            for s in segments(raw.as_buffer()):
                bounds = np.array([s.bounds.select(i) for i in range(s.n_docs + 1)], np.int64)
                ids = s.ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                n = len(crc)
                yield pa.record_batch(
                    [pa.array(np.full(n, block, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(s.doc_ids(), pa.int64()), pa.array(start + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    ["block", "part", "doc_id", "at", "n_tokens", "ids_crc32"],
                )
                start += s.n_ids


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files under ``path``: doc_id, start, n_tokens, ids_crc32.

    Places inside a file come from the select structures of its segments. The ids of a block's files are summed in the
    block, those of the blocks before on the driver.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    schema = "block int, part int, doc_id long, at long, n_tokens long, ids_crc32 long"
    found = materialize(files.select("path", "content").mapInArrow(_unpack, schema), "token-docs")
    sums = found.groupBy("block", "part").agg(F.sum("n_tokens").alias("n"))
    order = Window.partitionBy("block").orderBy("part")
    sums = materialize(sums.withColumn("earlier", F.sum("n").over(order) - F.col("n")), "token-files")
    totals = sorted((r["block"], r["n"]) for r in sums.groupBy("block").agg(F.sum("n").alias("n")).collect())
    before, so_far = [], 0
    for block, n in totals:  # MAX_BLOCKS numbers at most
        before.append((block, so_far))
        so_far += n
    blocks = F.broadcast(spark.createDataFrame(before or [(0, 0)], "b int, before long"))
    offsets = sums.join(blocks, F.col("block") == F.col("b")).select("block", "part", (F.col("earlier") + F.col("before")).alias("offset"))
    return found.join(offsets, ["block", "part"]).select("doc_id", (F.col("at") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents with this doc_id: the select structures give their places, the rest is not decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                for s in segments(raw.as_buffer()):
                    lo, hi = 0, s.names.n
                    while lo < hi:
                        mid = (lo + hi) // 2
                        lo, hi = (mid + 1, hi) if s.names.select(mid) + s.least < doc_id else (lo, mid)
                    while lo < s.names.n and s.names.select(lo) + s.least == doc_id:
                        yield pa.record_batch([pa.array([s.document(s.n_null + lo).astype(np.int64).tolist()], pa.list_(pa.int64()))], ["ids"])
                        lo += 1

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return [r["ids"] for r in files.select("content").mapInArrow(run, "ids array<long>").collect()]
