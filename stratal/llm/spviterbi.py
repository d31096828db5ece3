"""SentencePiece encoding by shared-prefix Viterbi, and decoding.

A text's spaces become marks, and words begin at a mark. The distinct words of a batch are
sorted, which is the depth-first order of their trie: the forward scores of a word's prefix
are those of the word before it as far as the two agree, so each node of the trie is scored once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratal.llm import textkernel as tk

MARK = "▁"
#: Stands for a mark that is in the text itself; no UTF-8 text has it.
_OWN_MARK = "\udc81"
CACHE_WORDS = 400_000


class Pieces:
    """Pieces of a model file and their log-probabilities. Files of the unigram kind have these; in files
    of the BPE kind the score is minus the rank, and the log-probability is Zipf's, -log(rank + 2.7)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        scores = [sp.get_score(i) for i in range(n)]
        ranks = all(float(s).is_integer() for s in scores)
        self.width = "<u2" if n <= 1 << 16 else "<u4"
        self.score: dict[str, tuple[float, int]] = {}
        self.raw: list[bytes] = []
        self.byte: list[int] = [sp.unk_id()] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.raw.append(bytes([int(piece[3:5], 16)]))
                self.byte[self.raw[-1][0]] = i
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.raw.append(piece.replace(MARK, " ").encode())
                if MARK not in piece[1:]:  # words begin at every mark, so no piece reaches over one
                    self.score[piece] = (-math.log(2.7 - scores[i]) if ranks else scores[i]), i
        # pieces, and None for what only ends one: a longer piece that ends here ends with each of its own ends
        self.ends: dict[str, tuple[float, int] | None] = {piece[i:]: None for piece in self.score for i in range(1, len(piece))}
        self.ends.update(self.score)
        self.worst = min(s for s, _ in self.score.values()) - 10

    def fallback(self, sign: str) -> list[int]:
        return [self.byte[b] for b in (MARK if sign == _OWN_MARK else sign).encode()]

    def viterbi(self, words: list[str]) -> Iterator[list[int]]:
        """Best ids of each of the sorted ``words``: the highest sum of scores; of equal sums the one with
        the longer last piece. Signs that are no piece are spelt in bytes."""
        best, back = [0.0], [(0, 0)]  # by length of the prefix; back: where its last piece begins, id or -1
        get, single, before = self.ends.get, self.score, ""
        for w in words:
            same = 0
            for x, y in zip(before, w, strict=False):
                if x != y:
                    break
                same += 1
            del best[same + 1 :], back[same + 1 :]
            for j in range(same + 1, len(w) + 1):
                top, link = best[j - 1] + self.worst * len(self.fallback(w[j - 1])) if w[j - 1] not in single else -math.inf, (j - 1, -1)
                for i in range(j - 1, -1, -1):
                    found = get(w[i:j], False)
                    if found:
                        score = best[i] + found[0]
                        if score >= top:
                            top, link = score, (i, found[1])
                    elif found is False:
                        break
                best.append(top)
                back.append(link)
            before, at, parts = w, len(w), []
            while at:
                begin, piece = back[at]
                parts.append([piece] if piece >= 0 else self.fallback(w[begin]))
                at = begin
            yield [i for p in reversed(parts) for i in p]


class Codec:
    """Encodes and decodes texts; ids of words seen are kept, CACHE_WORDS at most."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.known: dict[str, bytes] = {"": b""}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian numbers. A mark goes before the text, as SentencePiece puts it; null is empty."""
        split = []
        for t in texts:
            if t and MARK in t:
                t = t.replace(MARK, _OWN_MARK)
            # white space other than the space is in no piece but the bytes, so a line feed ends a word as well
            split.append((MARK + t.replace(" ", " " + MARK)).replace("\n", " \n ").split(" ") if t else [])
        if len(self.known) > CACHE_WORDS:
            self.known = {"": b""}
        new = sorted(set().union(*split).difference(self.known))
        for w, ids in zip(new, self.pieces.viterbi(new), strict=True):
            self.known[w] = np.array(ids, self.pieces.width).tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.pieces.raw.__getitem__, np.frombuffer(ids, self.pieces.width).tolist()))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _encode(path: str, digest: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        size = np.dtype(c.pieces.width).itemsize
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = list(tk.decoded(batch.column("text")))
                ids = c.encode(texts)
                n = pa.array([len(x) // size for x in ids], pa.int64())
                if digest:
                    back = [c.decode(x) for x in ids]
                    marks = pa.array([zlib.crc32(np.frombuffer(x, c.pieces.width).astype("<u4")) for x in ids], pa.int64())
                    shas = pa.array([sha256(b.encode()).hexdigest() for b in back], pa.string())
                    yield pa.record_batch([batch.column("doc_id"), n, marks, shas, pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)])], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "exact"])
                else:
                    flat = np.frombuffer(b"".join(ids), c.pieces.width).astype(np.int32)
                    ends = np.concatenate([[0], np.cumsum(n.to_numpy())]).astype(np.int32)
                    yield pa.record_batch([batch.column("doc_id"), n, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) of every row; null and empty texts have no ids. Bytes that are no UTF-8 count as U+FFFD."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(_encode(path, False), "doc_id long, n_tokens long, ids array<int>")


def _decode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n = len(c.pieces.raw)
            texts = [c.decode(np.array([x for x in i or [] if x is not None and 0 <= x < n], c.pieces.width).tobytes()) for i in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with ids; null ids give an empty text, and ids that the model does not have give nothing."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), decoded_sha256, exact (whether the
    decoded text is the text) of every row, one without a doc_id too; null and empty texts have no ids and are exact."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(_encode(path, True), "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, exact boolean")
