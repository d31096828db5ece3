"""Nine reconciliation checks of a fact, most of them in one pass over the fact and its dimensions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, functions as F

from stratal.functions.columns import UNKNOWN_KEY

#: Share of bad rows that each severity allows, and how far sums may differ.
ALLOWED = {"critical": 0.0, "important": 0.01, "optional": 0.05}
RELATIVE, ABSOLUTE = 0.0001, 0.01


@dataclass(frozen=True)
class Key:
    """Foreign key ``column`` to ``dim``.``dim_key``, from business key ``bk``; ``date`` is compared with the
    version's start, if it has one."""

    column: str
    dim: str
    dim_key: str
    bk: str | None = None
    severity: str = "critical"
    date: str | None = None


@dataclass(frozen=True)
class Suite:
    grain: tuple[str, ...]
    business_keys: tuple[str, ...]
    keys: tuple[Key, ...] = ()
    dates: dict[str, str] = field(default_factory=dict)  # date key: severity
    deleted: str | None = None
    metrics: tuple[str, ...] = ()

    def counters(self, fact: DataFrame, dims: dict[str, DataFrame], dates: DataFrame | None, more: dict[str, Column] | None = None, apart: frozenset[str] = frozenset()) -> DataFrame:
        """One row of counters: each dimension and date role joined once, everything counted in one aggregation. Keys of the dimensions ``apart``
        are not joined here, and their orphans and times are 0."""
        rows, sums = fact, {"n": F.count("*"), **(more or {})}
        for b in self.business_keys:
            sums[f"null_bk|{b}"] = F.count_if(F.col(b).isNull() | (F.trim(F.col(b).cast("string")) == ""))
        for i, k in enumerate(self.keys):
            set_, joined = F.col(k.column) != UNKNOWN_KEY, k.dim not in apart
            if joined:
                d = dims[k.dim]
                side = d.select(F.col(k.dim_key).alias(f"_k{i}"), *([F.col("effective_from").alias(f"_f{i}")] if k.date else []))
                rows = rows.join(side, rows[k.column] == side[f"_k{i}"], "left")
            sums[f"orphan|{k.column}"] = F.count_if(set_ & F.col(f"_k{i}").isNull()) if joined else F.count_if(F.lit(False))
            if k.bk:
                b = F.trim(F.col(k.bk).cast("string"))
                sums[f"unresolved|{k.column}"] = F.count_if(~set_ & b.isNotNull() & (b != "") & (b != "Unknown"))
            if k.date:
                sums[f"temporal|{k.column}"] = F.count_if(set_ & (F.col(k.date).cast("date") < F.col(f"_f{i}").cast("date")) if joined else F.lit(False))
        for i, c in enumerate(self.dates):
            side = dates.select(F.col("date_key").alias(f"_d{i}"))
            rows = rows.join(side, rows[c] == side[f"_d{i}"], "left")
            sums[f"date|{c}"] = F.count_if((F.col(c) != UNKNOWN_KEY) & F.col(f"_d{i}").isNull())
        if self.deleted:
            bad: Column = F.col(self.deleted) & (F.col("deleted_at").isNull() | F.col("delete_batch_id").isNull())
            sums["soft_delete|is_deleted"] = F.count_if(bad)
        return rows.agg(*(v.alias(k) for k, v in sums.items()))

    def by_key(self, fact: DataFrame, k: Key, dim: DataFrame) -> dict[str, int]:
        """Orphans and early times of one key, counted by key before the dimension is joined: rows of a fact are dealt with these two columns alone.
        Rows are joined only if the least time of some key is early."""
        day = F.col(k.date).cast("date") if k.date else F.lit(None).cast("date")
        rows = fact.where(F.col(k.column) != UNKNOWN_KEY).select(F.col(k.column).alias("_c"), day.alias("_day"))
        side = dim.select(F.col(k.dim_key).alias("_k"), (F.col("effective_from").cast("date") if k.date else F.lit(None).cast("date")).alias("_from"))
        met = rows.groupBy("_c").agg(F.count("*").alias("_n"), F.min("_day").alias("_least")).join(side, F.col("_c") == F.col("_k"), "left")
        found = met.agg(F.coalesce(F.sum(F.when(F.col("_k").isNull(), F.col("_n"))), F.lit(0)).alias("orphans"), F.count_if(F.col("_least") < F.col("_from")).alias("early")).first()
        out = {f"orphan|{k.column}": found["orphans"]}
        if k.date:
            early = found["early"]
            out[f"temporal|{k.column}"] = rows.join(side, F.col("_c") == F.col("_k")).where(F.col("_day") < F.col("_from")).count() if early else 0
        return out

    def first_bad(self, fact: DataFrame, check: str, column: str, dims: dict[str, DataFrame], dates: DataFrame | None) -> str | None:
        """One row that fails a check, as JSON; the least by its grain."""
        bad = self.bad(fact, check, column, dims, dates)
        row = bad.select(F.to_json(F.struct(*fact.columns)).alias("r"), *self.grain).orderBy(*self.grain, "r").first() if bad is not None else None
        return row["r"] if row else None

    def bad(self, fact: DataFrame, check: str, column: str, dims: dict[str, DataFrame], dates: DataFrame | None) -> DataFrame | None:
        """The rows that fail a check; None if it is not one of rows."""
        key = next((k for k in self.keys if k.column == column), None)
        if check == "grain":
            many = fact.groupBy(*self.grain).agg(F.count("*").alias("_n")).where("_n > 1")
            bad = fact.join(many.select(*(F.col(g).alias(f"_{g}") for g in self.grain)), [fact[g].eqNullSafe(F.col(f"_{g}")) for g in self.grain], "left_semi")
        elif check == "null_bk":
            bad = fact.where(F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == ""))
        elif check == "orphan":
            bad = fact.where(F.col(column) != UNKNOWN_KEY).join(dims[key.dim].select(F.col(key.dim_key).alias("_k")), F.col(column) == F.col("_k"), "left_anti")
        elif check == "unresolved":
            b = F.trim(F.col(key.bk).cast("string"))
            bad = fact.where((F.col(column) == UNKNOWN_KEY) & b.isNotNull() & (b != "") & (b != "Unknown"))
        elif check == "temporal":
            side = dims[key.dim].select(F.col(key.dim_key).alias("_k"), F.col("effective_from").alias("_f"))
            bad = fact.where(F.col(column) != UNKNOWN_KEY).join(side, (F.col(column) == F.col("_k")) & (F.col(key.date).cast("date") < F.col("_f").cast("date"))).drop("_k", "_f")
        elif check == "date":
            bad = fact.where(F.col(column) != UNKNOWN_KEY).join(dates.select(F.col("date_key").alias("_k")), F.col(column) == F.col("_k"), "left_anti")
        elif check == "soft_delete":
            bad = fact.where(F.col(self.deleted) & (F.col("deleted_at").isNull() | F.col("delete_batch_id").isNull()))
        else:
            bad = None
        return bad

    def run(self, fact: DataFrame, source: DataFrame | None, dims: dict[str, DataFrame], dates: DataFrame | None = None, samples: bool | Callable[[Row], DataFrame] = False, apart: frozenset[str] = frozenset(), nth: str | None = None, agreed: dict | None = None) -> list[dict]:
        """Every check with its figure, its limit and whether it passed; ``samples``: of a failed one a row that fails it, from the fact's rows or
        from those that a function gives for a grain. ``source`` has one row a grain. Sums, counts and lookups of the fact are one aggregation, the grain
        another, and each dimension ``apart``, of many rows, one more. ``nth``: a column with the number of a row among those of its grain; then the source
        has each grain once, and neither side is grouped. ``agreed``, in place of a source: what is known of it where the fact has each grain once (``there``: its
        grains, ``sums``, ``unresolved``: for each key the number of rows and the least grain)."""
        sums = {f"metric|{m}": F.sum(m) for m in self.metrics} | ({"excess": F.count_if(F.col(nth) > 1)} if nth else {})
        c = self.counters(fact, dims, dates, sums, apart).first().asDict()
        for k in (k for k in self.keys if k.dim in apart):
            c |= self.by_key(fact, k, dims[k.dim])
        least = {}
        if agreed:
            c |= {"excess": 0} | {f"unresolved|{k}": bad for k, (bad, _) in agreed["unresolved"].items()}
            least = {k: grain for k, (_, grain) in agreed["unresolved"].items()}
        n, out = c.pop("n"), []
        fact_sums = {m: c.pop(f"metric|{m}") for m in self.metrics}

        def add(check: str, on: str, bad: float, limit: float, figure: float) -> None:
            out.append({"check": check, "column": on, "bad": float(bad), "figure": float(figure), "limit": float(limit), "passed": bool(figure <= limit)})

        excess = c.pop("excess") if nth or agreed else fact.groupBy(*self.grain).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
        add("grain", ",".join(self.grain), excess, 0, excess)
        severity = {k.column: ALLOWED[k.severity] for k in self.keys}
        for name, bad in c.items():
            check, on = name.split("|")
            if check in ("unresolved", "temporal"):
                add(check, on, bad, severity[on], bad / n if n else 0.0)
            elif check == "date":
                add(check, on, bad, 0.05 if self.dates[on] == "optional" else 0.0, bad / n if n else 0.0)
            else:
                add(check, on, bad, 0, bad)
        if agreed:
            a, there = agreed["sums"], agreed["there"]
        else:
            per_grain = source.withColumn("_one", F.lit(1)) if nth else source.groupBy(*self.grain).agg(*(F.sum(m).alias(m) for m in self.metrics), F.lit(1).alias("_one"))
            a = per_grain.agg(F.count("_one").alias("_there"), *(F.sum(m).alias(m) for m in self.metrics)).first()
            there = a["_there"]
        add("row_count", "", abs(there - n), 0, abs(there - n) / there if there else float(n > 0))
        if self.metrics:
            for m in self.metrics:
                x, y = float(a[m] or 0), float(fact_sums[m] or 0)
                off = abs(x - y)
                ratio = off / abs(x) if x else float(off > 0)
                out.append({"check": "metric", "column": m, "bad": off, "figure": ratio, "limit": RELATIVE, "passed": not (ratio > RELATIVE and off > ABSOLUTE)})
        if samples:
            for x in out:
                x["sample"] = None if x["passed"] else self._sample(fact, x["check"], x["column"].split(",")[0], dims, dates, samples, least.get(x["column"]) if x["check"] == "unresolved" else None)
        return out

    def _sample(self, fact: DataFrame, check: str, column: str, dims: dict[str, DataFrame], dates: DataFrame | None, samples: bool | Callable[[Row], DataFrame], least: Row | None = None) -> str | None:
        if samples is not True:
            bad = self.bad(fact, check, column, dims, dates) if least is None else None
            least = bad.select(*self.grain).orderBy(*self.grain).first() if bad is not None else least
            if least is None:
                return None
            fact = samples(least)
        return self.first_bad(fact, check, column, dims, dates)
