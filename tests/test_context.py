"""Filter contexts: what each change of context gives, and how often facts are read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stratal.queries.kpis import one, two
from stratal.semantic import context
from stratal.semantic.catalog import expressions
from stratal.semantic.context import Cube, Each, Leaf, Op, Prior, Remove, Role, ToDate, Where, running_distinct
from stratal.semantic.engine import AccessDenied, Model
from stratal.semantic.pages import PAGES, render, slicers, visuals
from tests.conftest import DATA

SALES = [
    # region, agent, year, day, amount
    ("N", "a", 2023, "2023-01-05", 10), ("N", "b", 2023, "2023-01-05", 30), ("N", "a", 2024, "2024-01-06", 20), ("S", "c", 2024, "2024-01-07", 40), ("S", "c", 2024, "2024-02-01", 5),
    ("S", "d", 2024, "2024-01-06", 45), (None, "e", 2024, "2024-01-06", 7),
]


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.createDataFrame(SALES, "region string, agent string, year_number int, day string, amount int").withColumn("full_date", F.to_date("day"))
    late = rows.withColumn("year_number", F.col("year_number") + 1)
    return Model({"sales": rows, "sales@late": late})


TOTAL = Leaf("sales", "sum(amount)")


def of(model, e, by=(), where=()):
    cube = Cube(model, list(where))
    cube.add(e, tuple(by))
    return {tuple(r)[:-1] if len(by) > 1 else tuple(r)[0] if by else (): r["x"] for r in cube.frame({"x": e}, tuple(by)).collect()}


def test_contexts(model):
    assert of(model, TOTAL) == {(): 157} and of(model, TOTAL, ["region"]) == {"N": 60, "S": 90, None: 7}
    assert of(model, Remove(TOTAL, ("agent",)), ["region", "agent"], ["agent IN ('a', 'c')"]) == {("N", "a"): 60, ("S", "c"): 90}
    assert of(model, Remove(TOTAL, ("region", "agent")), ["agent"], ["region = 'S'"]) == {"c": 157, "d": 157}
    assert of(model, Where(TOTAL, "amount > 20"), ["region"]) == {"N": 30, "S": 85, None: None}
    assert of(model, Prior(TOTAL), ["region", "year_number"], ["year_number = 2024"]) == {("N", 2024): 40, ("S", 2024): None, (None, 2024): None}
    assert of(model, Role(TOTAL, "sales", "late"), ["year_number"]) == {2024: 40, 2025: 117}
    assert of(model, Each(TOTAL, "agent", "names"), ["region"]) == {"N": "a, b", "S": "c, d", None: "e"} and of(model, Each(TOTAL, "agent", "last"), ["region"])["S"] == "d"
    assert of(model, Each(TOTAL, "agent", "mean")) == {(): 157 / 5} and of(model, Each(TOTAL, "agent", "top"), ["region"])["S"] == 45
    days = of(model, ToDate(TOTAL), ["region", "full_date"])
    assert {(r, str(d)): v for (r, d), v in days.items()} == {("N", "2023-01-05"): 40, ("N", "2024-01-06"): 20, ("S", "2024-01-06"): 45, ("S", "2024-01-07"): 85, ("S", "2024-02-01"): 5, (None, "2024-01-06"): 7}
    share = Op(lambda a, b: a / b, (TOTAL, Remove(TOTAL, ("region",))))
    assert of(model, share, ["region"], ["year_number = 2024"]) == {"N": 20 / 117, "S": 90 / 117, None: 7 / 117}
    assert of(model, TOTAL, ["region"], ["agent = 'nobody'"]) == {} and of(model, Leaf("sales", "count(*)"), [], ["agent = 'nobody'"]) == {(): 0}


def test_contexts_that_cannot_be(spark, model):
    for e, by in ((Prior(TOTAL), ["region"]), (ToDate(TOTAL), ["region"]), (TOTAL, ["city"])):
        with pytest.raises(ValueError):
            Cube(model).add(e, tuple(by))
    with pytest.raises(ValueError, match="filter"):
        Cube(model, ["city = 'x'"])
    cube = Cube(model)
    cube.add(TOTAL, ("region",))
    cube.frame({"x": TOTAL}, ("region",))
    with pytest.raises(ValueError, match="before the first"):
        cube.add(Leaf("sales", "max(amount)"), ("region",))
    secured = Model(model.facts, secured=(spark.createDataFrame([("AG1", "a")], "user_id string, agent string"), "agent"))
    with pytest.raises(AccessDenied):
        Cube(secured)
    assert of(secured.as_user("AG1"), TOTAL) == {(): 30}


def test_running_distinct(spark):
    rows = spark.sql("SELECT g, k, DATE(d) AS full_date FROM VALUES ('x', 1, '2024-01-01'), ('x', 1, '2024-01-03'), ('x', 2, '2024-01-03'), ('x', NULL, '2024-01-04'), ('x', 1, '2024-02-01'), ('y', 1, '2024-01-03') AS t(g, k, d)")
    got = {(r["g"], str(r["full_date"])): r["n"] for r in running_distinct(rows, ["g"], "k").collect()}
    assert got == {("x", "2024-01-01"): 1, ("x", "2024-01-03"): 2, ("x", "2024-01-04"): 2, ("x", "2024-02-01"): 1, ("y", "2024-01-03"): 1}


@pytest.mark.parametrize("page", ["overview", "policies"])
def test_a_page_reads_each_fact_once(spark, monkeypatch, page):
    plans = []
    keep = context.staged

    def spy(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(context, "staged", spy)
    model = (one if page == "overview" else two)(spark, DATA)
    known = expressions(model)
    facts = {leaf.fact for v in visuals(page) for m in v.measures for leaf in known[m].args}
    assert render(model, page, {"year_number": [1996]}).count() > 0
    assert len(plans) == len(facts)
    for p in plans:  # orders once, or line items once, beside dimensions
        assert p.count("l_linestatus") == 0 or p.count("Relation") <= 2


def test_every_page_has_known_measures(spark):
    m = {**expressions(one(spark, DATA)), **expressions(two(spark, DATA))}
    assert all(x in m for p in PAGES for v in visuals(p) for x in v.measures) and len(m) >= 130
    assert slicers({"a": ["x'y", "z"], "b": [1], "c": []}) == ["a IN ('x''y', 'z')", "b IN (1)"]
