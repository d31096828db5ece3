"""Every query of the catalogue against its SQL in DuckDB, and the driver's contract."""

from __future__ import annotations

import math

import pytest

from stratal import queries as catalogue
from tests.conftest import DATA

catalogue.load()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())


def test_contract(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_validation_suite_finds_each_defect(spark):
    found = {r["check"]: r["passed"] for r in catalogue.QUERIES["validation_suite"](spark, DATA).collect()}
    assert found["grain"] and not any(found[c] for c in ("null_bk", "orphan", "date", "soft_delete", "row_count"))


def test_dirty_json(spark):
    out = catalogue.QUERIES["dirty_json_reader"](spark, DATA).collect()
    assert len(out) == spark.read.parquet(f"{DATA}/customer.parquet").count() and any("\u2028" in (r["cancellation_reason"] or "") for r in out)


def test_month_to_date_of_a_leap_day(spark, duck, tmp_path):
    """29 February stands beside 28 February of the year before."""
    duck.execute("CREATE SCHEMA leap")
    for t in ("region", "nation", "customer", "supplier", "part", "lineitem"):
        duck.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    moved = "SELECT * REPLACE (CASE o_orderkey // 16 % 4 WHEN 0 THEN TIMESTAMP '1995-02-28' WHEN 1 THEN TIMESTAMP '1996-02-28' WHEN 2 THEN TIMESTAMP '1996-02-29' ELSE TIMESTAMP '1997-02-28' END AS o_orderdate) FROM main.orders"
    duck.execute(f"COPY ({moved}) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW leap.orders AS FROM '{tmp_path}/orders.parquet'")
    duck.execute("SET schema = 'leap'")
    try:
        got = duck.execute(catalogue.SQL["kpi_month_to_date_customers"])
        columns, want = [d[0] for d in got.description], got.fetchall()
    finally:
        duck.execute("SET schema = 'main'")
        duck.execute("DROP SCHEMA leap CASCADE")
    df = catalogue.QUERIES["kpi_month_to_date_customers"](spark, str(tmp_path))
    assert any(r[columns.index("full_date")] == "1996-02-29" and r[columns.index("last_year")] for r in want)
    assert rows(df.columns, df.collect()) == rows(columns, want)
