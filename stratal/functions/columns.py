"""Small column expressions that the operators share."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

#: Key of the unknown member of every dimension, and of every fact key that finds none.
UNKNOWN_KEY = -1


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_key(c: Column | str) -> Column:
    """yyyyMMdd as an integer; the unknown key for null."""
    return F.coalesce(F.date_format(as_column(c), "yyyyMMdd").cast("int"), F.lit(UNKNOWN_KEY))


def known_key(c: Column | str) -> Column:
    """The key, or the unknown key for null."""
    return F.coalesce(as_column(c), F.lit(UNKNOWN_KEY))


def map_value(c: Column | str, mapping: dict[str, str]) -> Column:
    """The mapped code; other values in upper case, null stays null."""
    c = as_column(c)
    out = F.upper(c)
    for raw, code in reversed(mapping.items()):
        out = F.when(c == raw, code).otherwise(out)
    return out


def amount(c: Column | str) -> Column:
    """Money as DECIMAL(18, 2). Text that is no number is null."""
    return as_column(c).try_cast("decimal(18,2)")


def live_amount(c: Column | str, deleted: Column) -> Column:
    """0 for deleted rows and nulls, with the type of money kept."""
    zero = F.lit(Decimal("0.00"))
    return F.when(F.coalesce(deleted, F.lit(False)), zero).otherwise(F.coalesce(as_column(c), zero))


def divide(n: Column, d: Column, otherwise: float | None = None) -> Column:
    """n / d as a double; ``otherwise`` where d is null or 0, or n is null."""
    ok = d.isNotNull() & (d != 0) & n.isNotNull()
    return F.when(ok, n.cast("double") / F.when(d != 0, d.cast("double"))).otherwise(F.lit(otherwise).cast("double"))


def differs(a: Column, b: Column) -> Column:
    """Null-safe: null and '' differ, and null equals null."""
    return ~a.eqNullSafe(b)


def filled(c: Column | str) -> Column:
    """Neither null nor blank."""
    c = as_column(c)
    return c.isNotNull() & (F.trim(c.cast("string")) != "")
