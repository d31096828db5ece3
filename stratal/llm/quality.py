"""Quality scores: random Fourier features of document statistics, ridge by normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratal.llm import textkernel as tk
from stratal.llm.langid import part
from stratal.llm.scratch import materialize

FEATURES = 192
RIDGE = 1e-3
SEED = 7
#: Calibration sees raw scores in so many steps between -0.5 and 1.5.
STEPS = 2000

_CLASSES = [bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:", b"!?", b"|", b"%$&*#@~^=+_", b"<>{}[]()/\\", b"\"'`-", b"\n\r", b" \t", bytes(range(128, 256))]
_CLASS = np.zeros((256, len(_CLASSES)))
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c), _i] = 1
N_STATS = len(_CLASSES) + 14


def statistics(column: pa.Array) -> Iterator[np.ndarray]:
    """N_STATS numbers for each text; those of an empty text are zeros."""
    for lo, hi in tk.slices(column):
        words = tk.split_words(column.slice(lo, hi - lo))
        hashes, sizes = words.hashes(), (words.ends - words.starts).astype(float)
        last = words.data[words.ends - 1] if len(sizes) else np.zeros(0, np.uint8)
        first = words.data[words.starts] if len(sizes) else last
        for d in range(len(words.offsets) - 1):
            out = np.zeros(N_STATS)
            raw = words.data[words.offsets[d] : words.offsets[d + 1]]
            a, b = words.first[d], words.first[d + 1]
            if len(raw):
                hist = np.bincount(raw, minlength=256)
                out[: len(_CLASSES)] = hist @ _CLASS / len(raw)
                p = hist[hist > 0] / len(raw)
                k = len(_CLASSES)
                out[k] = np.log1p(len(raw))
                out[k + 1] = -(p * np.log2(p)).sum()
                if b > a:
                    n, size, h = b - a, sizes[a:b], hashes[a:b]
                    _, counts = np.unique(h, return_counts=True)
                    two = h[1:] * np.uint64(3) + h[:-1]
                    out[k + 2 : k + 14] = (
                        np.log1p(n), min(size.mean(), 50), min(size.std(), 50), len(counts) / n, counts.max() / n,
                        (h[1:] == h[:-1]).mean() if n > 1 else 0, 1 - len(np.unique(two)) / max(1, n - 1), (size == 1).mean(), (size > 12).mean(),
                        (last[a:b] == 46).mean(), ((first[a:b] >= 65) & (first[a:b] <= 90)).mean(), np.log1p(hist[10]),
                    )
            yield out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            flat = np.concatenate(list(statistics(batch.column("text")))).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, N_STATS, dtype=np.int32)), pa.array(flat))
            yield pa.record_batch([batch.column("doc_id"), lists], ["doc_id", "stats"])


@dataclass
class Model:
    """Standardised statistics, their random features, ridge weights and the calibration's corners."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        phi = np.cos(z @ self.omega + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([phi, np.ones((len(phi), 1))], 1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated, with a trace of the raw score so that steps keep an order inside."""
        raw = self.raw(stats)
        level = np.interp(raw, self.knots, self.levels) if len(self.knots) else np.full(len(raw), 0.5)
        return np.round(0.998 * level + 0.002 * np.clip((raw + 0.5) / 2, 0, 1), 9)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy().astype(float).reshape(-1, N_STATS)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((N_STATS, 3))
    for batch in batches:
        x = _matrix(batch)
        total += np.stack([x.sum(0), (x * x).sum(0), np.full(N_STATS, len(x))], 1)
    yield pa.record_batch([pa.array(np.arange(N_STATS), pa.int32()), *(pa.array(total[:, i]) for i in range(3))], ["i", "s", "s2", "n"])


def _equations(model: Model) -> Callable:
    """A partition's share of the normal equations, a row of the matrix each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.phase) + 1
        total = np.zeros((size, size + 1))
        for batch in batches:
            if batch.num_rows:
                phi = model.features(_matrix(batch))
                total += phi.T @ np.concatenate([phi, batch.column("label").to_numpy().astype(float)[:, None]], 1)
        if total.any():
            yield pa.record_batch([pa.array(np.arange(size), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    return run


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[i] = sums.get(i, 0) + row.values.to_numpy()
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "row"])


def _bins(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, y = np.zeros(STEPS + 1), np.zeros(STEPS + 1)
        for batch in batches:
            if batch.num_rows:
                at = np.clip((model.raw(_matrix(batch)) + 0.5) / 2 * STEPS, 0, STEPS).round().astype(int)
                np.add.at(n, at, 1)
                np.add.at(y, at, batch.column("label").to_numpy().astype(float))
        used = np.flatnonzero(n)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(n[used]), pa.array(y[used])], ["bin", "n", "y"])

    return run


def isotonic(x: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: corners (x rising) and levels of the best rising step function."""
    pools: list[list[float]] = []  # first x, last x, weight, sum
    for a, w, s in zip(x, weight, y, strict=True):
        pools.append([a, a, w, s])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    knots, levels = [], []
    for a, b, w, s in pools:
        knots += [a, b] if b > a else [a]
        levels += [s / w] * (2 if b > a else 1)
    return np.array(knots), np.array(levels)


def describe(docs: DataFrame) -> DataFrame:
    """A table of doc_id and the statistics of its text, a row for each of ``docs``. Null and empty texts have zeros;
    rows without a doc_id are described too, but no label is theirs."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return materialize(rows.mapInArrow(_statistics, "doc_id long, stats array<float>"), "stats")


def fit(stats: DataFrame, labels: DataFrame, n_features: int = FEATURES, ridge: float = RIDGE) -> Model:
    """Fit on every row of ``labels`` (doc_id, label; nulls left out, several labels of a document are
    averaged). A quarter of them, drawn by hash, calibrates; the rest gives the normal equations,
    which are summed by partition and then by row, so that no table of rows reaches the driver."""
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.avg("label").alias("label"))
    rows = materialize(stats.join(known, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(4))), "labelled")
    first, second = rows.where("fold <> 0").select("stats", "label"), rows.where("fold = 0").select("stats", "label")
    sums = first.select("stats").mapInArrow(_moments, "i int, s double, s2 double, n double").groupBy("i").agg(*(F.sum(c).alias(c) for c in ("s", "s2", "n"))).collect()
    s = np.zeros((N_STATS, 3))
    for r in sums:
        s[r["i"]] = r["s"], r["s2"], r["n"]
    n = max(1.0, s[0, 2])
    mean = s[:, 0] / n
    scale = np.sqrt(np.maximum(s[:, 1] / n - mean**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(SEED)
    omega = rng.normal(size=(N_STATS, n_features)) / np.sqrt(N_STATS)
    none = np.zeros(0)
    model = Model(mean, scale, omega, rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), none, none)
    if not s[0, 2]:
        return model
    parts = first.mapInArrow(_equations(model), "i int, row array<double>").repartition("i")
    system = np.zeros((n_features + 1, n_features + 2))
    for r in parts.mapInArrow(_add_rows, "i int, row array<double>").collect():
        system[r["i"]] = r["row"]
    model.weights = np.linalg.solve(system[:, :-1] + ridge * n * np.eye(n_features + 1) / n_features, system[:, -1])
    bins = second.mapInArrow(_bins(model), "bin int, n double, y double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    if bins:
        x, w, y = (np.array([r[c] for r in bins], float) for c in ("bin", "n", "y"))
        model.knots, model.levels = isotonic(x / STEPS * 2 - 0.5, w, y)
    return model


def _score(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = model.score(_matrix(batch))
                yield pa.record_batch([batch.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every described row. Null and empty texts have statistics of zero and
    are scored like any other; without labels every score is about 0.5."""
    return stats.select("doc_id", "stats").mapInArrow(_score(model), "doc_id long, score double, predicted int")


def held_out(doc_id, of: int, remainder: int):
    """Whether crc32 of the id modulo ``of`` is ``remainder``; a null id is not held out."""
    return F.coalesce(part(doc_id, of) == remainder, F.lit(False))
