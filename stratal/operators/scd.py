"""Slowly changing dimensions: type 1 overwrites, type 2 keeps versions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from stratal.functions.columns import UNKNOWN_KEY, differs, filled
from stratal.operators.dedup import latest
from stratal.operators.keys import assign_keys, max_key
from stratal.session import staged

OPEN_END = "9999-12-31 23:59:59"
FIRST_START = "1900-01-01 00:00:00"


def unknown_member(df: DataFrame, key: str, special: dict[str, object] | None = None) -> DataFrame:
    """The row of key -1: strings say Unknown, the rest is null unless ``special`` gives it."""

    def value(f) -> Column:
        if special and f.name in special:
            return F.lit(special[f.name]).cast(f.dataType)
        if f.name == key:
            return F.lit(UNKNOWN_KEY).cast(f.dataType)
        return F.lit("Unknown" if isinstance(f.dataType, StringType) else None).cast(f.dataType)

    return df.sparkSession.range(1).select(*(value(f).alias(f.name) for f in df.schema.fields))


def with_unknown(df: DataFrame, key: str, special: dict[str, object] | None = None) -> DataFrame:
    """``df`` with the unknown member once."""
    return df.where(F.col(key) != UNKNOWN_KEY).unionByName(unknown_member(df, key, special))


@dataclass(frozen=True)
class Type1:
    """A dimension by business key ``bk`` with ``attributes`` that are overwritten."""

    key: str
    bk: str
    attributes: tuple[str, ...] = ()
    order: tuple[str, ...] = ()

    def apply(self, target: DataFrame, batch: DataFrame, start: int | None = None, once: bool = False) -> DataFrame:
        """The new dimension with _action: KEPT, UPDATED or INSERTED. Blank business keys are left out;
        of several rows of one the first by ``order`` descending counts. ``once``: the batch has a business key once."""
        rows = batch.where(filled(self.bk))
        if once:
            rows = rows.select(self.bk, *self.attributes)
        elif self.attributes:
            rows = rows.select(self.bk, *self.attributes, *(c for c in self.order if c not in self.attributes))
            rows = latest(rows, [self.bk], [F.col(c).desc_nulls_last() for c in self.order]).select(self.bk, *self.attributes)
        else:  # codes of few values: no task gets all rows of one
            rows = rows.select(self.bk).distinct()
        s = rows.select(F.col(self.bk).alias("_bk"), *(F.col(a).alias(f"_s_{a}") for a in self.attributes))
        both = target.join(s, target[self.bk] == s["_bk"], "left")
        changed = F.lit(False)
        for a in self.attributes:
            changed = changed | differs(F.col(a), F.col(f"_s_{a}"))
        changed = F.col("_bk").isNotNull() & changed
        old = both.select(
            *(F.when(changed, F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in self.attributes else F.col(c) for c in target.columns),
            F.when(changed, "UPDATED").otherwise("KEPT").alias("_action"),
        )
        new = rows.join(target.select(F.col(self.bk).alias("_have")), F.col(self.bk) == F.col("_have"), "left_anti")
        first = max(0, max_key(target, self.key)) if start is None else start
        new = assign_keys(new, [self.bk], self.key, first).withColumn("_action", F.lit("INSERTED"))
        return old.unionByName(new.select(*(F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in target.dtypes), "_action"))


@dataclass(frozen=True)
class Type2:
    """A dimension by business key ``bk``; a change of ``tracked`` makes a version that holds from ``at``
    until the next one, the end excluded."""

    key: str
    bk: str
    tracked: tuple[str, ...]
    at: str

    def apply(self, target: DataFrame, batch: DataFrame, start: int | None = None) -> DataFrame:
        """The new dimension with _action: KEPT, EXPIRED or INSERTED, as one plan, so that it is
        published at once. The latest row of a key in the batch counts; an event that is no later
        than the version in force changes nothing."""
        rows = batch.where(filled(self.bk) & F.col(self.at).isNotNull()).select(self.bk, *self.tracked, F.col(self.at).alias("_at"))
        rows = latest(rows, [self.bk], [F.col("_at").desc()])
        now = target.where("is_current").select(F.col(self.bk).alias("_bk"), F.col("effective_from").alias("_from"), *(F.col(c).alias(f"_t_{c}") for c in self.tracked))
        both = rows.join(now, F.col(self.bk) == F.col("_bk"), "left")
        changed = F.lit(False)
        for c in self.tracked:
            changed = changed | differs(F.col(c), F.col(f"_t_{c}"))
        new = both.where(F.col("_bk").isNull() | (changed & (F.col("_at") > F.col("_from")))).select(self.bk, *self.tracked, "_at")
        ends = new.select(F.col(self.bk).alias("_bk"), F.col("_at").alias("_end"))
        old = target.join(ends, (F.col(self.bk) == F.col("_bk")) & F.col("is_current"), "left")
        hit = F.col("_end").isNotNull()
        old = old.withColumn("effective_to", F.when(hit, F.col("_end")).otherwise(F.col("effective_to")))
        old = old.withColumn("is_current", F.when(hit, F.lit(False)).otherwise(F.col("is_current")))
        old = old.withColumn("_action", F.when(hit, "EXPIRED").otherwise("KEPT")).select(*target.columns, "_action")
        first = max(0, max_key(target, self.key)) if start is None else start
        added = assign_keys(new, [self.bk], self.key, first)
        added = added.withColumn("effective_from", F.col("_at")).withColumn("effective_to", F.lit(OPEN_END).cast("timestamp"))
        added = added.withColumn("is_current", F.lit(True)).withColumn("_action", F.lit("INSERTED"))
        return old.unionByName(added.select(*(F.col(c) if c in added.columns else F.lit(None).cast(t).alias(c) for c, t in target.dtypes), "_action"))

    def unknown(self, target: DataFrame, special: dict[str, object] | None = None) -> DataFrame:
        limits = {"effective_from": FIRST_START, "effective_to": OPEN_END, "is_current": True}
        return with_unknown(target, self.key, limits | (special or {}))


@dataclass(frozen=True)
class History:
    """A type 2 dimension whose events come in any order.

    Beside its versions (is_version) it keeps the events that only confirmed one, since a late event between may make a version start
    at such an event. Of several events of a key at one instant the greatest in ``tracked`` counts, so that
    batches in any order and of any cut give the history of all events.
    """

    key: str
    bk: str
    tracked: tuple[str, ...]
    at: str

    def apply(self, stored: DataFrame, batch: DataFrame, start: int | None = None) -> DataFrame:
        """The new history of ``stored`` (key, bk, tracked, effective_from, effective_to, is_current, is_version) with _action: KEPT,
        UPDATED (its values or its time have changed), INSERTED, or RETIRED (leave these out: a late event has made the version
        part of an earlier one). Only keys of ``batch`` are worked out anew. A version keeps the surrogate key of the
        first stored version that begins in its time.
        """
        rows = batch.where(filled(self.bk) & F.col(self.at).isNotNull()).select(self.bk, *self.tracked, F.col(self.at).alias("effective_from"))
        met = rows.select(F.col(self.bk).alias("_met")).distinct()
        rest = stored.join(met, stored[self.bk] == met["_met"], "left_anti").withColumn("_action", F.lit("KEPT"))
        hit = stored.join(met, stored[self.bk] == met["_met"], "left_semi")
        value = F.struct(*self.tracked).alias("_v")
        known = hit.select(self.bk, "effective_from", value, F.when(F.col("is_version"), F.col(self.key)).alias("_k"))
        seen = known.unionByName(rows.select(self.bk, "effective_from", value, F.lit(None).cast("long").alias("_k")))
        moments = seen.groupBy(self.bk, "effective_from").agg(F.max("_v").alias("_v"), F.max("_k").alias("_k"))
        order = Window.partitionBy(self.bk).orderBy("effective_from")
        before, first = F.lag("_v").over(order), F.row_number().over(order) == 1
        moments = moments.withColumn("is_version", first | ~F.col("_v").eqNullSafe(before))
        moments = moments.withColumn("_run", F.sum(F.col("is_version").cast("int")).over(order))
        later = order.rowsBetween(1, Window.unboundedFollowing)
        ends = F.first(F.when(F.col("is_version"), F.col("effective_from")), ignorenulls=True).over(later)
        inherited = F.first("_k", ignorenulls=True).over(Window.partitionBy(self.bk, "_run").orderBy("effective_from").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        moments = moments.withColumns({"_end": ends, self.key: F.when(F.col("is_version"), inherited)}).select(self.bk, "_v.*", self.key, "effective_from", "_end", "is_version")
        moments = staged(moments, "history")
        whole = {
            "effective_to": F.when(F.col("is_version"), F.coalesce("_end", F.lit(OPEN_END).cast("timestamp"))),
            "is_current": F.col("is_version") & F.col("_end").isNull(),
        }
        shown = [F.col(c).cast(t).alias(c) for c, t in stored.dtypes]
        confirmed = moments.where("NOT is_version").withColumns(whole).select(*shown, F.lit("KEPT").alias("_action"))
        had = hit.where("is_version").select(F.struct(*stored.columns).alias("_had"))
        kept = moments.where(F.col("is_version") & F.col(self.key).isNotNull()).withColumns(whole).select(F.struct(*shown).alias("_now"))
        both = kept.join(had, F.col(f"_now.{self.key}") == F.col(f"_had.{self.key}"), "full_outer")
        action = F.when(F.col("_now").isNull(), "RETIRED").when(F.col("_now") == F.col("_had"), "KEPT").otherwise("UPDATED")
        kept = both.select(F.coalesce("_now", "_had").alias("_row"), action.alias("_action")).select("_row.*", "_action")
        new = moments.where(F.col("is_version") & F.col(self.key).isNull()).withColumns(whole).drop(self.key, "_end")
        keys = max(0, max_key(stored, self.key)) if start is None else start
        new = assign_keys(new, [self.bk, "effective_from"], self.key, keys).select(*shown, F.lit("INSERTED").alias("_action"))
        return rest.unionByName(confirmed).unionByName(kept).unionByName(new)


def versions(events: DataFrame, bk: str, tracked: list[str], at: str, ties: list[str]) -> DataFrame:
    """The whole history at once: a version starts where a tracked value changes, and ends where the next one
    starts. ``ties`` make the order of a key's events total."""
    order = Window.partitionBy(bk).orderBy(at, *ties)
    changed = F.row_number().over(order) == 1
    for c in tracked:
        changed = changed | differs(F.col(c), F.lag(c).over(order))
    starts = events.withColumn("_new", changed).where("_new").drop("_new")
    nxt = F.lead(at).over(order)
    out = starts.withColumn("effective_from", F.col(at)).withColumn("effective_to", F.coalesce(nxt, F.lit(OPEN_END).cast("timestamp")))
    return out.withColumn("is_current", nxt.isNull())

