"""Measures: aggregates of facts, combined after grouping.

A fact is never joined to another row by row: each is aggregated to the group's fields on its own,
and the results are joined on these fields.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from stratal.functions.columns import divide


@dataclass(frozen=True)
class Base:
    """``name`` = ``sql`` aggregated over ``fact``. Names stand in formulas."""

    name: str
    fact: str
    sql: str


def names_in(sql: str) -> set[str]:
    """Identifiers of an expression, outside its string literals."""
    return set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", " ", sql)))


@dataclass(frozen=True)
class Dimension:
    """A relationship N:1: the fact's column ``key`` (its own or another dimension's attribute) to ``dim_key`` of ``frame``, which gives ``attributes``."""

    frame: DataFrame
    key: str
    dim_key: str
    attributes: tuple[str, ...]


@dataclass(frozen=True)
class Star:
    """A fact and its dimensions. A dimension is joined only where one of its attributes is asked for; facts without
    a member of it stay, with nulls."""

    fact: DataFrame
    dimensions: tuple[Dimension, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [*self.fact.columns, *(a for d in self.dimensions for a in d.attributes)]

    def with_columns(self, names: set[str]) -> DataFrame:
        """The fact with those of ``names`` that it reaches."""
        have, wanted = set(self.fact.columns), set(names)
        for d in reversed(self.dimensions):  # a key may be an attribute of a dimension before
            if wanted & set(d.attributes) - have:
                wanted.add(d.key)
        out = self.fact.select(*(c for c in self.fact.columns if c in wanted)) if wanted & have else self.fact.select(F.lit(1).alias("_one"))
        for i, d in enumerate(self.dimensions):
            use = [a for a in d.attributes if a in wanted and a not in have]
            if use:
                side = d.frame.select(F.col(d.dim_key).alias(f"_k{i}"), *use)
                out = out.join(side, F.col(d.key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        return out

    def join_semi(self, members: DataFrame, column: str) -> Star:
        """Rows whose ``column`` (the fact's, or an attribute) is in the one column of ``members``."""
        side = members.toDF("_mine").distinct()
        if column in self.fact.columns:
            return Star(self.fact.join(side, F.col(column) == F.col("_mine"), "left_semi"), self.dimensions)
        d = next(d for d in self.dimensions if column in d.attributes)
        keys = d.frame.join(side, F.col(column) == F.col("_mine"), "left_semi").select(d.dim_key)
        return self.join_semi(keys, d.key)


class AccessDenied(PermissionError):
    """The model's rows are those of its users, and none was named."""


@dataclass
class Model:
    """Facts (frames, or stars that reach their dimensions' attributes) along the active relationships.

    A measure in another date role has a fact of its own (``fact_policy@end``) which is the same frame under that role.
    ``bridges``: a fact's key, another fact and its key: a relationship that filters in both directions, through which a condition that
    reaches the other fact only leaves the fact's rows of the keys that are left there.
    ``secured``: members (user_id and a column) and that column's name; such a model answers nothing until ``as_user``
    says for whom.
    """

    facts: dict[str, DataFrame | Star]
    bases: dict[str, Base] = field(default_factory=dict)
    measures: dict[str, Callable[[dict[str, Column]], Column]] = field(default_factory=dict)
    needs: dict[str, tuple[str, ...]] = field(default_factory=dict)
    secured: tuple[DataFrame, str] | None = None
    bridges: dict[str, tuple[str, str, str]] = field(default_factory=dict)

    def as_user(self, user: str | None) -> Model:
        """The same model over the rows that ``user`` may see; none for no user or one that is not known."""
        if self.secured is None:
            raise ValueError("the model has no members to look users up in")
        return replace(self, facts=restrict(self.facts, *self.secured, user), secured=None)

    def base(self, name: str, fact: str, sql: str) -> None:
        self.bases[name] = Base(name, fact, sql)

    def measure(self, name: str, needs: str, f: Callable[..., Column]) -> None:
        """``f`` gets the columns of the bases named in ``needs``, in their order."""
        names = tuple(needs.split())
        self.needs[name] = names
        self.measures[name] = lambda c, f=f, names=names: f(*(c[n] for n in names))

    def filters(self, where: str | list[str] | None) -> list[tuple[str, set[str]]]:
        """Conditions with the fields they use; a condition on a field that no fact has is an error."""
        fields = {c for f in self.facts.values() for c in f.columns}
        out = [(w, names_in(w) & fields) for w in ([where] if isinstance(where, str) else where or [])]
        for w, used in out:
            if not used:
                raise ValueError(f"no fact has a field of the filter {w!r}")
        return out

    def frame(self, measures: list[str], by: list[str], where: str | list[str] | None = None) -> DataFrame:
        """The bases that ``measures`` need, by the fields ``by``. Each condition of ``where`` (several are slicers beside each
        other) reaches a fact if it has all its fields, or by a bridge, and leaves the others alone; a fact without a field of ``by`` is an error."""
        if self.secured is not None:
            raise AccessDenied("name a user first")
        wanted = list(dict.fromkeys(n for m in measures for n in self.needs[m]))
        conditions = self.filters(where)
        out = None
        for fact in dict.fromkeys(self.bases[n].fact for n in wanted):
            df = self.facts[fact]
            missing = [b for b in by if b not in df.columns]
            if missing:
                raise ValueError(f"{fact} has no {', '.join(missing)}")
            mine = [self.bases[n] for n in wanted if self.bases[n].fact == fact]
            reached = [(w, used) for w, used in conditions if used <= set(df.columns)]
            own, via, theirs = self.bridges.get(fact, (None, None, None))
            around = [(w, used) for w, used in conditions if via and not used <= set(df.columns) and used <= set(self.facts[via].columns)]
            if isinstance(df, Star):
                df = df.with_columns({*by, *([own] if around else []), *(x for b in mine for x in names_in(b.sql)), *(x for _, used in reached for x in used)})
            for w, _ in reached:
                df = df.where(w)
            if around:
                other = self.facts[via]
                other = other.with_columns({theirs, *(x for _, used in around for x in used)}) if isinstance(other, Star) else other
                for w, _ in around:
                    other = other.where(w)
                df = df.join(other.select(F.col(theirs).alias("_theirs")).distinct(), F.col(own) == F.col("_theirs"), "left_semi")
            one = df.groupBy(*by).agg(*(F.expr(b.sql).alias(b.name) for b in mine))
            if out is None:
                out = one
            elif not by:
                out = out.join(F.broadcast(one))  # one row each
            else:
                there = one.select(*(F.col(b).alias(f"_r_{b}") for b in by), *(b.name for b in mine))
                cond = [F.col(b).eqNullSafe(F.col(f"_r_{b}")) for b in by]
                out = out.join(there, cond, "full_outer").withColumns({b: F.coalesce(F.col(b), F.col(f"_r_{b}")) for b in by})
                out = out.drop(*(f"_r_{b}" for b in by))
        return out

    def evaluate(self, measures: list[str], by: list[str] = [], where: str | list[str] | None = None) -> DataFrame:
        """A row for each group of any fact, with the fields and the measures under ``column_name`` of their names."""
        df = self.frame(measures, by, where)
        columns = {c: F.col(c) for c in df.columns}
        return df.select(*by, *(self.measures[m](columns).alias(column_name(m)) for m in measures))


def column_name(measure: str) -> str:
    """Conversion Rate -> conversion_rate."""
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]+", "_", measure.lower().replace("%", " pct ").replace("≤", "le"))).strip("_")


def ratio(otherwise: float | None = 0.0, times: float = 1.0) -> Callable[[Column, Column], Column]:
    return lambda n, d: divide(n, d, otherwise) * F.lit(times)


def year_over_year(df: DataFrame, year: str, value: str, by: list[str] = [], otherwise: float | None = None, difference: bool = False) -> DataFrame:
    """``df`` (a row a year and group) with prior and growth: against the year before, not the row before, so a
    year without rows is a missing prior. ``difference``: the change itself instead of its share."""
    p = df.select((F.col(year) + 1).alias("_y"), *(F.col(b).alias(f"_b_{b}") for b in by), F.col(value).alias("prior"))
    cond = F.col(year) == F.col("_y")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    out = df.join(p, cond, "left").drop("_y", *(f"_b_{b}" for b in by))
    growth = F.col(value) - F.col("prior") if difference else divide(F.col(value) - F.col("prior"), F.col("prior"), otherwise)
    return out.withColumn("growth", growth)


def growth_label(growth: Column, prior: Column) -> Column:
    """New without a prior year or with one of zero, else the percentage with a sign."""
    text = F.concat(F.when(growth >= 0, "+").otherwise("-"), F.format_string("%.2f", F.abs(growth) * 100), F.lit("%"))
    return F.when(prior.isNull() | (prior == 0), F.lit("New")).otherwise(text)


def arrow_label(growth: Column, unit: str = "%", scale: float = 100) -> Column:
    text = F.concat(F.when(growth >= 0, "▲ ").otherwise("▼ "), F.format_string("%.2f", growth * scale), F.lit(f"{unit} vs PY"))
    return F.when(growth.isNotNull(), text)


def sign_color(growth: Column, good: str = "#27AE60", bad: str = "#E74C3C") -> Column:
    """A blank counts as 0."""
    return F.when(F.coalesce(growth, F.lit(0.0)) >= 0, good).otherwise(bad)


def restrict(facts: dict[str, DataFrame | Star], members: DataFrame, column: str, user: str | None) -> dict[str, DataFrame | Star]:
    """Row-level security: each fact's rows of the members that ``user`` may see. ``members`` has user_id and
    ``column``. No user, an unknown user or a fact without the column: no rows."""
    own = members.where(F.upper("user_id") == F.upper(F.lit(user))).select(column)
    out = {}
    for n, f in facts.items():
        star = f if isinstance(f, Star) else Star(f)
        star = star.join_semi(own, column) if column in star.columns else Star(star.fact.where("false"), star.dimensions)
        out[n] = star if isinstance(f, Star) else star.fact
    return out


def role_of(user_id: str) -> str:
    """CUS... is a customer, AG... an agent; anything else may see nothing."""
    u = user_id.upper()
    return "customer" if u.startswith("CUS") else "agent" if u.startswith("AG") else "none"


#: Aging buckets in order, with their first and last day; negative ages fall in the first.
AGING = (("0 - 7 days", None, 7), ("8 - 30 days", 8, 30), ("31 - 60 days", 31, 60), ("61 - 90 days", 61, 90), ("> 90 days", 91, None))


def aging_bucket(days: Column) -> Column:
    out = F.lit(AGING[-1][0])
    for name, _, last in reversed(AGING[:-1]):
        out = F.when(days <= last, name).otherwise(out)
    return F.when(days.isNotNull(), out)
