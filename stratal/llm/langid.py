"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from stratal.llm import textkernel as tk

#: N-grams in a profile, of a language or of a document.
PROFILE = 400
#: Training documents a language, as expected from a draw by hash; the only sample taken here.
MAX_TRAIN = 4000
UNKNOWN = "und"
#: A text in another language or of random letters is less near than this to every profile.
LEAST = 0.25
_PIECE = 1 << 20
_BITS = np.uint64(21)


@cache
def _letters() -> np.ndarray:
    """For each code point 1 + that of its lower-case letter, or 1 if it is no letter."""
    out = np.ones(0x110000, np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = 1 + (ord(low) if len(low) == 1 else i)
    return out


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of one to three signs within words, word ends marked.
    A long text is counted piece by piece. A piece ends at a sign that is no letter; where there is none, the next one begins with
    the last two letters, whose own n-grams have been counted."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at, again = 0, 0
    while at < len(text):
        to = min(len(text), at + _PIECE)
        if to < len(text):
            back = max(text.rfind(" ", at + 1, to), text.rfind("\n", at + 1, to))
            to = back if back > at + again else to
        c = _letters()[np.frombuffer(text[at:to].encode("utf-32-le", "surrogatepass"), np.uint32)]
        inside = to < len(text) and c[-1] > 1 and _letters()[ord(text[to])] > 1
        if inside and len(other := np.flatnonzero(c[again + 1 :] == 1)):
            c = c[: again + 1 + int(other[-1])]
            to, inside = at + len(c), False
        ends = [np.array([1], np.uint64)]
        c = np.concatenate([*(ends if not again else []), c, *(ends if not inside else [])])
        letter = c > 1
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[:-1] |= letter[1:]
        keep[1:] &= letter[1:] | letter[:-1] | ~keep[:-1]
        c = c[keep]
        c = c[np.concatenate([[True], (c[1:] > 1) | (c[:-1] > 1)])] if len(c) else c
        if len(c) > 2:
            two = (c[:-1] << _BITS) | c[1:]
            three = (two[:-1] << _BITS) | c[2:]
            one, three = c[again:], three[c[1:-1] > 1]
            found.append(np.unique(np.concatenate([one[one > 1], two[max(0, again - 1) :], three]), return_counts=True))
        again = 2 if inside else 0
        at = to - again
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(found) == 1:
        return found[0]
    codes, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
    return codes, np.bincount(back, np.concatenate([f[1] for f in found])).astype(np.int64)


def top(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties in order of their codes."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    """Rank of every profile n-gram in each language; ``size`` where it is not in the profile."""

    size: int
    languages: list[str] = field(default_factory=list)
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    ranks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))

    @classmethod
    def of(cls, grams: dict[str, list[int]], size: int) -> Profiles:
        languages = sorted(grams)
        codes = np.unique(np.array([g for l in languages for g in grams[l]], np.uint64))
        ranks = np.full((len(codes), len(languages)), size, np.int64)
        for i, l in enumerate(languages):
            ranks[np.searchsorted(codes, np.array(grams[l], np.uint64)), i] = np.arange(len(grams[l]))
        return cls(size, languages, codes, ranks)

    def distances(self, best: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's ranked n-grams to each language, as a share of the greatest."""
        place = np.minimum(np.searchsorted(self.codes, best), len(self.codes) - 1)
        known = self.codes[place] == best
        theirs = np.where(known[:, None], self.ranks[place], self.size)
        off = np.where(theirs < self.size, np.abs(theirs - np.arange(len(best))[:, None]), self.size)
        return off.sum(0) / (self.size * len(best))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and nearness (1 - distance). Score: the runner-up's share of the two least
        distances. Equal distances: the first language in alphabetical order."""
        if not text or not self.languages:
            return UNKNOWN, 0.0, 0.0
        best = top(*gram_counts(text), self.size)
        if not len(best):
            return UNKNOWN, 0.0, 0.0
        d = self.distances(best)
        first = int(np.argmin(d))
        rest = np.delete(d, first)
        second = float(rest.min()) if len(rest) else 1.0
        total = second + float(d[first])
        return self.languages[first], second / total if total else 0.5, 1.0 - float(d[first])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for lang, text in zip(tk.decoded(batch.column("lang")), tk.decoded(batch.column("text")), strict=True):
            codes, counts = gram_counts(text)
            if lang in sums:
                codes, back = np.unique(np.concatenate([sums[lang][0], codes]), return_inverse=True)
                counts = np.bincount(back, np.concatenate([sums[lang][1], counts])).astype(np.int64)
            sums[lang] = codes, counts
    for lang, (codes, counts) in sums.items():
        yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


def learn(docs: DataFrame, size: int = PROFILE, max_train: int = MAX_TRAIN) -> Profiles:
    """Profiles from the texts and languages of ``docs`` (doc_id, text, lang; null lang or text left out).
    A language with more than ``max_train`` documents is drawn from by hash at that expected number."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles(size)
    rate = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1.0, max_train / n))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("profile")), F.lit(1_000_000)) < rate[F.col("lang")] * 1_000_000
    grams = rows.where(drawn).select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    sums = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")).alias("rank")
    best = sums.select("lang", "gram", order).where(F.col("rank") <= size).collect()
    grams_of: dict[str, list[int]] = {}
    for r in sorted(best, key=lambda r: (r["lang"], r["rank"])):
        grams_of.setdefault(r["lang"], []).append(r["gram"])
    return Profiles.of(grams_of, size)


def _predict(profiles: Profiles) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in tk.decoded(batch.column("text"))]
            others = [c for c in batch.schema.names if c != "text"]
            lang, score, near = zip(*found, strict=True) if found else ((), (), ())
            columns = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(near, pa.float64())]
            yield pa.record_batch([batch.column(c) for c in others] + columns, [*others, "lang_pred", "score", "nearness"])

    return run


def part(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score, nearness of every row; the whole text counts.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if
    there are no profiles. Only doc_id and text are read.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(_predict(profiles), "doc_id long, lang_pred string, score double, nearness double")


def _keep(profiles: Profiles, column: str, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t) for t in tk.decoded(batch.column(column))]
            yield batch.filter(pa.array([lang != UNKNOWN and near >= least for lang, _, near in found], pa.bool_()))

    return run


def keep(docs: DataFrame, profiles: Profiles, least: float = LEAST) -> DataFrame:
    """``docs`` without the rows that no profile fits: those of ``und``, and those nearer than ``least`` to
    none. All columns stay as they are."""
    return docs.mapInArrow(_keep(profiles, "text", least), docs.schema)
