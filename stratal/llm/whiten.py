"""Whitening of vectors by the singular values of their centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from stratal.llm.scratch import discard, materialize
from stratal.llm.vectors import Form, finite, form, packed

#: Singular values below this share of the first are rounding of the inner products they come from, not variance.
NOISE = 1e-7
LONG = 1 << 63


def _sums(f: Form) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(f.dim, object)
        for batch in batches:
            x = f.unpack(batch.column("x"))
            total += x.astype(np.int64 if f.most * max(1, len(x)) < LONG else object).sum(0).astype(object)
        yield pa.record_batch([pa.array(range(f.dim), pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], ["i", "s"])

    return run


@dataclass(frozen=True)
class Centre:
    """``n`` different vectors and the sums of their components."""

    f: Form
    n: int
    sums: tuple[int, ...]

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: as int64, or as Python's integers where these do not do."""
        kind = np.int64 if 2 * self.n * self.f.most < LONG else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def deviation(self, apart: np.ndarray) -> np.ndarray:
        """The sum of squares of each row, exactly."""
        if self.f.dim * (2 * self.n * self.f.most) ** 2 >= LONG:
            apart = apart.astype(object)
        return (apart * apart).sum(1)

    def centred(self, apart: np.ndarray) -> np.ndarray:
        return (apart / self.n).astype(np.float64)


def _centred(c: Centre) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = c.apart(c.f.unpack(batch.column("x")))
            rows = c.centred(apart)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(c.f.dim))
            yield pa.record_batch([pa.ListArray.from_arrays(offsets, pa.array(rows.ravel())), _decimals(c.deviation(apart))], ["c", "deviation"])

    return run


def _decimals(whole: np.ndarray) -> pa.Array:
    if whole.dtype == np.int64:
        return pa.array(whole).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(int(v)) for v in whole], pa.decimal128(38, 0))


@dataclass(frozen=True)
class Whitening:
    """Unit eigenvectors (columns of ``directions``) and eigenvalues of the covariance, by falling eigenvalue, and its trace."""

    centre: Centre
    directions: np.ndarray
    values: np.ndarray
    trace: float

    def project(self, apart: np.ndarray) -> np.ndarray:
        return self.centre.centred(apart) @ self.directions / np.sqrt(self.values)


def fit(once: DataFrame, f: Form, k: int) -> Whitening | None:
    """The first ``k`` components of different vectors (column x); fewer where fewer have variance, None if none has.

    The covariance is that of the vectors' distribution: singular values of the centred rows, squared, over the number
    of rows. Its trace is not the sum of these, which ends at ``k``, but that of the exact deviations.
    """
    n = once.count()
    if not n or not f.dim:
        return None
    sums = {r["i"]: int(r["s"]) for r in once.mapInArrow(_sums(f), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}  # one row a component
    centre = Centre(f, n, tuple(sums[i] for i in range(f.dim)))
    rows = once.mapInArrow(_centred(centre), "c array<double>, deviation decimal(38,0)")
    total = int(rows.agg(F.sum("deviation").alias("t")).first()["t"])
    if not total:
        return None
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("c").alias("c")), "c")
    svd = RowMatrix(vectors, n, f.dim).computeSVD(f.dim)  # all of them: the local solver works to double precision
    s = svd.s.toArray()
    s = s[: min(k, int((s > NOISE * s[0]).sum()))]
    directions = svd.V.toArray()[:, : len(s)]
    signs = np.sign(directions[np.argmax(np.abs(directions), 0), np.arange(len(s))])
    return Whitening(centre, directions * signs, s * s / n, total / n / n / n)


def _components(w: Whitening) -> Callable:
    k = len(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = w.centre.apart(w.centre.f.unpack(batch.column("x")))
            rows = len(apart)
            at = pa.array(np.repeat(np.arange(rows), k))
            component = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows))
            columns = [batch.column("vec_id").take(at), component, _decimals(w.centre.deviation(apart)).take(at), pa.array(w.project(apart).ravel())]
            yield pa.record_batch(columns, ["vec_id", "component", "deviation_exact", "whitened"])

    return run


def _projected(w: Whitening) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = w.project(w.centre.apart(w.centre.f.unpack(batch.column("x"))))
            yield pa.record_batch([pa.array(p[:, i]) for i in range(p.shape[1])], [f"w{i}" for i in range(p.shape[1])])

    return run


def identity_error(once: DataFrame, w: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, measured on all of ``once``."""
    k = len(w.values)
    rows = once.mapInArrow(_projected(w), ", ".join(f"w{i} double" for i in range(k)))
    pairs = list(combinations_with_replacement(range(k), 2))
    found = rows.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened(vectors: DataFrame, k: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact of every row of ``vectors``
    (vec_id, embedding) whose vector is not null and holds neither null nor non-finite entries.

    Vectors are floor(256 * embedding). Equal ones count once for the ``n`` vectors that centre and covariance are of, and each
    has its rows here; a null vec_id stays null. ``deviation`` is null where it is beyond 64 bits, ``deviation_exact``
    (decimal) is not. There are no rows of a component without variance, so none at all if all vectors are equal or
    the table is empty. Shorter vectors are filled up with zeros. Other columns are not read.
    """
    rows = finite(vectors)
    f = form(rows)
    held = materialize(packed(rows, f), "whole")
    once = materialize(held.select("x").distinct(), "different", compact=True)
    w = fit(once, f, k)
    if w is None:
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(once, w)
    discard(once)
    explained = F.element_at(F.array(*(F.lit(float(e / w.trace)) for e in w.values)), F.col("component"))
    found = held.mapInArrow(_components(w), "vec_id long, component int, deviation_exact decimal(38,0), whitened double")
    return found.select(
        "vec_id", "component", F.lit(w.centre.n).cast("long").alias("n"), F.col("deviation_exact").try_cast("long").alias("deviation"),
        "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact",
    )
