"""Vectors as rows of whole numbers: floor(256 * c) of every component, packed into bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE = 256


@dataclass(frozen=True)
class Form:
    """Components of a vector and their greatest absolute value; ``dtype`` holds each of them."""

    dim: int
    most: int

    @property
    def dtype(self) -> np.dtype:
        return np.dtype("<i2" if self.most < 1 << 15 else "<i4" if self.most < 1 << 31 else "<i8")

    def unpack(self, column: pa.Array) -> np.ndarray:
        """The packed vectors of a binary column, one a row."""
        width = self.dim * self.dtype.itemsize
        data, at = column.buffers()[2], column.offset * width
        return np.frombuffer(data, self.dtype, len(column) * self.dim, at).reshape(-1, self.dim) if data is not None and width else np.zeros((len(column), self.dim), self.dtype)


def binary(rows: np.ndarray) -> pa.Array:
    """A binary column with the bytes of each row."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def finite(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows whose vector is not null and holds neither null nor non-finite entries."""
    v = vectors["embedding"].cast("array<double>")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), v.alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col("v").isNotNull() & ~odd)


def form(rows: DataFrame) -> Form:
    """The form that all vectors of ``rows`` (column v) fit: shorter ones are filled up with zeros."""
    low, high = (F.floor(f("v") * SCALE).cast("decimal(38,0)") for f in (F.array_min, F.array_max))
    r = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.greatest(F.abs(low), F.abs(high))).alias("most")).first()
    most = int(r["most"] or 0)
    if most >= 1 << 62:
        raise OverflowError("a component of a vector is beyond the whole numbers of 64 bits")
    return Form(r["dim"] or 0, most)


def whole(v: pa.Array, f: Form) -> np.ndarray:
    """floor(256 * c) of a column of lists, in the form ``f``."""
    offsets = np.asarray(v.offsets)
    x = np.floor(SCALE * np.asarray(v.values)[offsets[0] : offsets[-1]]).astype(f.dtype)
    size = np.diff(offsets)
    if (size == f.dim).all():
        return x.reshape(len(v), f.dim)
    out = np.zeros((len(v), f.dim), f.dtype)
    out[np.arange(f.dim) < size[:, None]] = x
    return out


def _pack(f: Form) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column("vec_id"), binary(whole(batch.column("v"), f))], ["vec_id", "x"])

    return run


def packed(rows: DataFrame, f: Form) -> DataFrame:
    """vec_id and x: the bytes of the vector in the form ``f``, so that equal vectors have equal bytes."""
    return rows.select("vec_id", "v").mapInArrow(_pack(f), "vec_id long, x binary")
