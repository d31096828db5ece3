"""Upserts as plans: a target and a source in, the new target out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


class CardinalityError(ValueError):
    """Several source rows would change one target row."""


@dataclass
class Clause:
    """``when`` (over ``t.`` and ``s.`` columns; None: always) and what to ``set``; None sets all source columns."""

    when: str | None = None
    set: dict[str, str] | None = None


@dataclass
class Merge:
    keys: list[str]
    matched: list[Clause] = field(default_factory=lambda: [Clause()])
    insert: bool = True

    def apply(self, target: DataFrame, source: DataFrame) -> DataFrame:
        """The new target, with _action: KEPT, UPDATED or INSERTED. The first clause that holds wins.

        Keys are compared null-safely. Columns that only the source has are dropped; those that only
        the target has stay, and are null in inserted rows. Check ``check_source`` first.
        """
        t = target.withColumn("_in_t", F.lit(True)).alias("t")
        s = source.withColumn("_in_s", F.lit(True)).alias("s")
        cond = self._on()
        both = t.join(s, cond, "full_outer" if self.insert else "left")
        here, there = F.col("t._in_t").isNotNull(), F.col("s._in_s").isNotNull()
        action = F.lit("KEPT")
        values = {c: F.col(f"t.`{c}`") for c in target.columns}
        for clause in reversed(self.matched):
            hit = here & there & (F.coalesce(F.expr(clause.when), F.lit(False)) if clause.when else F.lit(True))
            action = F.when(hit, "UPDATED").otherwise(action)
            for c in target.columns:
                if clause.set is None:
                    new = F.col(f"s.`{c}`") if c in source.columns else None
                else:
                    new = F.expr(clause.set[c]) if c in clause.set else None
                # a later clause must not show through where this one holds
                values[c] = F.when(hit, F.col(f"t.`{c}`") if new is None else new).otherwise(values[c])
        types = dict(target.dtypes)
        for c in target.columns:
            new = F.col(f"s.`{c}`") if c in source.columns else F.lit(None)
            values[c] = F.when(here, values[c]).otherwise(new).cast(types[c])
        action = F.when(~here, "INSERTED").otherwise(action)
        return both.select(*(values[c].alias(c) for c in target.columns), action.alias("_action"))

    def _on(self) -> Column:
        cond = F.col(f"t.`{self.keys[0]}`").eqNullSafe(F.col(f"s.`{self.keys[0]}`"))
        for k in self.keys[1:]:
            cond = cond & F.col(f"t.`{k}`").eqNullSafe(F.col(f"s.`{k}`"))
        return cond

    def check_source(self, source: DataFrame) -> None:
        if source.groupBy(*self.keys).count().where("count > 1").take(1):
            raise CardinalityError(f"several source rows for one {', '.join(self.keys)}")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    merge = Merge(keys)
    if check:
        merge.check_source(source)
    return merge.apply(target, source)


def metrics(merged: DataFrame) -> dict[str, int]:
    """Exact numbers of rows kept, updated and inserted."""
    found = {r["_action"]: r["count"] for r in merged.groupBy("_action").count().collect()}
    return {k.lower(): found.get(k, 0) for k in ("KEPT", "UPDATED", "INSERTED")}


def overwrite_where(target: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE ... SET ... WHERE."""
    return target.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """DELETE ... WHERE; rows for which the condition is null stay."""
    return target.where(~F.coalesce(condition, F.lit(False)))
