"""Measures as expressions over a filter context, evaluated from one scan of each fact.

An expression is an aggregate of a fact, a function of expressions, or one in a changed context: without the filters of some fields,
with a condition more, a year before, from the month's first day on, in another date role, or for each value of a field. What a set
of expressions needs of a fact (which aggregates, at which fields, under which filters) is gathered first and taken in one
aggregation with grouping sets, whose rows are as many as the groups. All that follows reads these.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from stratal.semantic.engine import AccessDenied, Model, Star, names_in
from stratal.session import staged

#: Fields of the date dimension.
DATES = ("full_date", "year_number", "month_number", "year_month")


class Expr:
    def __sub__(self, other: Expr) -> Expr:
        return Op(lambda a, b: a - b, (self, other))


@dataclass(frozen=True)
class Leaf(Expr):
    """An aggregate of a fact."""

    fact: str
    sql: str


@dataclass(frozen=True, eq=False)
class Op(Expr):
    f: Callable[..., Column]
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Remove(Expr):
    """Without the filters on ``fields``, those of the visual's groups too (ALL, REMOVEFILTERS; ALLEXCEPT names the dimension's other fields)."""

    inner: Expr
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Where(Expr):
    """With a condition more, which facts without its fields leave alone."""

    inner: Expr
    condition: str


@dataclass(frozen=True)
class Prior(Expr):
    """In the same period ``years`` before: the filters on dates go, the groups' years stay. A year without rows has none."""

    inner: Expr
    years: int = 1


@dataclass(frozen=True)
class ToDate(Expr):
    """From the first day of the month to the group's day, of aggregates that add up (DATESMTD)."""

    inner: Expr


@dataclass(frozen=True)
class Role(Expr):
    """With ``fact`` along another of its dates (USERELATIONSHIP), which the model has as ``fact@role``."""

    inner: Expr
    fact: str
    role: str


@dataclass(frozen=True)
class Each(Expr):
    """For each value of ``field``: the mean, the highest (``top``), or the names that have it (``names``, ties with a comma; ``last``: the last of these)."""

    inner: Expr
    field: str
    fold: str


@dataclass(frozen=True)
class Context:
    by: tuple[str, ...]
    removed: frozenset[str] = frozenset()
    more: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    to_date: bool = False


@dataclass
class Cube:
    """Expressions of a model under slicers (``where``: conditions, each on a field's values). Give all visuals to ``add`` before ``frame`` is called."""

    model: Model
    where: list[str] = field(default_factory=list)
    needed: dict[str, dict[tuple[str, str], str]] = field(default_factory=dict)  # fact: (aggregate, its filter): column
    grains: dict[str, list[tuple[str, ...]]] = field(default_factory=dict)
    taken: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.model.secured is not None:
            raise AccessDenied("name a user first")
        if self.model.bridges:
            raise ValueError("a cube does not filter in both directions; evaluate the model itself")
        self.conditions = self.model.filters(self.where)

    def _column(self, leaf: Leaf, c: Context) -> tuple[str, str]:
        """The fact and its column for an aggregate in a context."""
        role = dict(c.roles).get(leaf.fact)
        fact = f"{leaf.fact}@{role}" if role else leaf.fact
        have = set(self.model.facts[fact].columns)
        missing = [b for b in c.by if b not in have]
        if missing:
            raise ValueError(f"{fact} has no {', '.join(missing)}")
        kept = [w for w, used in self.conditions if used <= have and not used & c.removed] + [w for w in c.more if names_in(w) & have]
        key = leaf.sql, " AND ".join(f"({w})" for w in kept)
        columns = self.needed.setdefault(fact, {})
        if key not in columns:
            if fact in self.taken:
                raise ValueError("add all visuals before the first is evaluated")
            columns[key] = f"c{len(columns)}"
        grains = self.grains.setdefault(fact, [])
        if c.by not in grains:
            grains.append(c.by)
        return fact, columns[key]

    def _inside(self, e: Expr, c: Context) -> Context:
        if isinstance(e, Remove):
            return replace(c, by=tuple(b for b in c.by if b not in e.fields), removed=c.removed | {*e.fields})
        if isinstance(e, Where):
            return replace(c, more=(*c.more, e.condition))
        if isinstance(e, Prior):
            if "year_number" not in c.by:
                raise ValueError("the year before is that of a group of a year")
            return replace(c, removed=c.removed | {*DATES})
        if isinstance(e, ToDate):
            if "full_date" not in c.by:
                raise ValueError("the month to date is that of a group of a day")
            return replace(c, to_date=True)
        if isinstance(e, Role):
            return replace(c, roles=(*c.roles, (e.fact, e.role)))
        return replace(c, by=(*c.by, e.field)) if isinstance(e, Each) else c

    def add(self, e: Expr, by: tuple[str, ...] | Context) -> None:
        """Note what ``e`` needs at the fields ``by``."""
        c = by if isinstance(by, Context) else Context(tuple(by))
        if isinstance(e, Leaf):
            self._column(e, c)
            self._there(e, c)
            return
        for x in e.args if isinstance(e, Op) else [e.inner]:
            self.add(x, self._inside(e, c))
        if not isinstance(e, Op):
            self._there(_first(e), c)

    def _there(self, leaf: Leaf, c: Context) -> tuple[str, str]:
        """The fact and the column that counts its rows in a context: groups without any are not shown."""
        return self._column(Leaf(leaf.fact, "count(*)"), replace(c, more=()))

    def _take(self, fact: str) -> DataFrame:
        """Every aggregate of a fact at every grain, from one scan."""
        if fact not in self.taken:
            columns, grains = self.needed[fact], self.grains[fact]
            star = self.model.facts[fact]
            fields = list(dict.fromkeys(f for g in grains for f in g))
            if isinstance(star, Star):
                star = star.with_columns({*fields, *(x for sql, where in columns for t in (sql, where) for x in names_in(t))})
            shared = set.intersection(*({*_split(where)} for _, where in columns))
            for w in shared:
                star = star.where(w)
            left = lambda where: " AND ".join(f"({w})" for w in _split(where) if w not in shared)
            aggregates = [F.expr(f"{sql} FILTER (WHERE {left(where)})" if left(where) else sql).alias(name) for (sql, where), name in columns.items()]
            if len(grains) == 1:
                rows = star.groupBy(*fields).agg(*aggregates, F.lit(0).cast("long").alias("_grain"))
            else:
                rows = star.groupingSets([[F.col(f) for f in g] for g in grains], *(F.col(f) for f in fields)).agg(*aggregates, F.grouping_id().cast("long").alias("_grain"))
            self.taken[fact] = staged(rows, "cube")
        return self.taken[fact]

    def _at(self, fact: str, by: tuple[str, ...], columns: list[str], there: str) -> DataFrame:
        fields = list(dict.fromkeys(f for g in self.grains[fact] for f in g))
        number = 0 if len(self.grains[fact]) == 1 else sum(1 << i for i, f in enumerate(reversed(fields)) if f not in by)
        rows = self._take(fact).where(F.col("_grain") == number)
        rows = rows.where(F.col(there) > 0) if by else rows
        return rows.select(*by, *(F.col(c).alias(f"{_plain(fact)}_{c}") for c in columns))

    def frame(self, named: dict[str, Expr], by: tuple[str, ...] | Context) -> DataFrame:
        """A row for each group of any fact: the fields ``by`` and a column for each expression."""
        c = by if isinstance(by, Context) else Context(tuple(by))
        leaves: dict[str, list[str]] = {}
        there: dict[str, str] = {}
        beside: list[tuple[DataFrame, tuple[str, ...]]] = []

        def value(e: Expr, at: Context) -> Column:
            if isinstance(e, Leaf):
                fact, column = self._column(e, at)
                there[fact] = self._there(e, at)[1]
                if column not in leaves.setdefault(fact, []):
                    leaves[fact].append(column)
                found = F.col(f"{_plain(fact)}_{column}")
                if at.to_date:
                    month = [F.col(b) for b in at.by if b != "full_date"] + [F.date_format("full_date", "yyyy-MM")]
                    found = F.sum(found).over(Window.partitionBy(*month).orderBy("full_date"))
                return found
            if isinstance(e, Op):
                return e.f(*(value(x, at) for x in e.args))
            inside = self._inside(e, at)
            if isinstance(e, (Where, Role, ToDate)):
                return value(e.inner, inside)
            name = f"_x{len(beside)}_{len(at.by)}"
            rows = self.frame({name: e.inner}, inside)
            if isinstance(e, Prior):
                rows = rows.withColumn("year_number", F.col("year_number") + e.years)
            if isinstance(e, Each):
                rows = rows.where(F.col(e.field).isNotNull()).groupBy(*at.by).agg(_fold(e, name).alias(name))
            beside.append((rows, tuple(b for b in inside.by if b in at.by)))
            return F.col(name)

        columns = {n: value(e, c) for n, e in named.items()}
        if not leaves:
            fact, column = self._there(_first(next(iter(named.values()))), c)
            leaves[fact], there[fact] = [column], column
        out = None
        for fact, wanted in leaves.items():
            one = self._at(fact, c.by, wanted, there[fact])
            out = one if out is None else _joined(out, one, c.by, "full_outer")
        for rows, at in beside:
            out = _joined(out, rows, at, "left")
        return out.select(*c.by, *(x.alias(n) for n, x in columns.items()))


def _plain(fact: str) -> str:
    return fact.replace("@", "__")


def _split(where: str) -> list[str]:
    return where[1:-1].split(") AND (") if where else []


def _first(e: Expr) -> Leaf:
    while not isinstance(e, Leaf):
        e = e.args[0] if isinstance(e, Op) else e.inner
    return e


def _fold(e: Each, name: str) -> Column:
    if e.fold == "mean":
        return F.avg(name)
    if e.fold == "top":
        return F.max(name)
    pairs = F.filter(F.collect_list(F.struct(F.col(name).alias("v"), F.col(e.field).cast("string").alias("n"))), lambda p: p["v"].isNotNull())
    best = F.array_max(F.transform(pairs, lambda p: p["v"]))
    names = F.array_sort(F.transform(F.filter(pairs, lambda p: p["v"] == best), lambda p: p["n"]))
    return F.array_max(names) if e.fold == "last" else F.when(F.size(names) > 0, F.array_join(names, ", "))


def _joined(a: DataFrame, b: DataFrame, by: tuple[str, ...], how: str) -> DataFrame:
    if not by:
        return a.join(F.broadcast(b), F.lit(True), "left")  # one row each
    side = b.select(*(F.col(x).alias(f"_r_{x}") for x in by), *(c for c in b.columns if c not in by))
    on = [a[x].eqNullSafe(side[f"_r_{x}"]) for x in by]
    out = a.join(side, on, how)
    if how == "full_outer":
        out = out.withColumns({x: F.coalesce(F.col(x), F.col(f"_r_{x}")) for x in by})
    return out.drop(*(f"_r_{x}" for x in by))


def of(model: Model, name: str) -> Expr:
    """A measure of a model as an expression."""
    needs = model.needs[name]
    return Op(lambda *c: model.measures[name](dict(zip(needs, c, strict=True))), tuple(Leaf(model.bases[n].fact, model.bases[n].sql) for n in needs))


def running_distinct(rows: DataFrame, by: list[str], key: str, day: str = "full_date") -> DataFrame:
    """by, day and n: different values of ``key`` from the first day of the month to each day on which the group has rows.

    A key counts on the first day it appears in the group's month; these days' counts are summed up. So a key is looked at once
    a month, and no day looks back. Null keys do not count.
    """
    month = F.date_format(day, "yyyy-MM").alias("_month")
    daily = rows.select(*by, F.col(day), month, F.col(key).alias("_key")).groupBy(*by, "_month", "_key").agg(F.min(day).alias("_first"))
    new = daily.where("_key IS NOT NULL").groupBy(*by, "_month", F.col("_first").alias(day)).agg(F.count("*").alias("_new"))
    days = rows.select(*by, F.col(day), month).distinct()
    both = days.unionByName(new, allowMissingColumns=True).groupBy(*by, "_month", day).agg(F.coalesce(F.sum("_new"), F.lit(0)).alias("_new"))
    return both.select(*by, day, F.sum("_new").over(Window.partitionBy(*by, "_month").orderBy(day)).alias("n"))
