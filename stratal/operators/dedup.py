"""De-duplication with a total order, so that ties have one answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def row_order(df: DataFrame) -> list[Column]:
    """All columns, nulls last: the end of every order here. Rows equal in all of them are interchangeable."""
    return [F.col(f"`{c}`").asc_nulls_last() for c in df.columns]


def latest(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """One row a key: the first by ``by``, then by all columns."""
    order = Window.partitionBy(*keys).orderBy(*by, *row_order(df))
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def latest_by_first_of(df: DataFrame, keys: list[str], candidates: list[str]) -> DataFrame:
    """``latest`` by the first of the ``candidates`` that the frame has; by all columns if it has none."""
    found = next((c for c in candidates if c in df.columns), None)
    return latest(df, keys, [F.col(found).desc_nulls_last()] if found else [])


def unchanged(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``source`` without the rows that ``target`` has with equal ``columns``, compared null-safely."""
    t = target.select(*(F.col(c).alias(f"_t_{c}") for c in [*keys, *columns]))
    same = [source[c].eqNullSafe(F.col(f"_t_{c}")) for c in [*keys, *columns]]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return source.join(t, cond, "left_anti")
