"""Reconciliation checks as queries over orders with planted defects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratal.operators.reconcile import Key, Suite
from stratal.queries import query
from stratal.queries.star import table


def defective(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Orders as a fact, a customer dimension without some members, and dates that end in 2000."""
    o = table(spark, sf_dir, "orders")
    fact = o.select(
        "o_orderkey", F.expr("CASE WHEN o_orderkey % 97 = 0 THEN ' ' ELSE CAST(o_custkey AS STRING) END").alias("customer_bk"),
        F.expr("CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE o_custkey END").alias("customer_key"), F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date_key_"),
        F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 40 == 0).alias("is_deleted"), F.expr("CASE WHEN o_orderkey % 80 = 0 THEN o_orderdate END").alias("deleted_at"),
        F.lit(1).alias("delete_batch_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("premium"),
    )
    dim = table(spark, sf_dir, "customer").where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("c_key"), F.lit("1996-01-01 00:00:00").cast("timestamp").alias("effective_from"))
    days = spark.sql("SELECT CAST(date_format(d, 'yyyyMMdd') AS INT) AS date_key FROM (SELECT explode(sequence(DATE'1995-01-01', DATE'2000-12-31')) AS d)")
    return fact, {"customer": dim}, days


_F = """
f AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN ' ' ELSE o_custkey::VARCHAR END AS customer_bk, CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE o_custkey END AS customer_key,
         o_orderdate AS moment, o_orderkey % 40 = 0 AS is_deleted, CASE WHEN o_orderkey % 80 = 0 THEN o_orderdate END AS deleted_at, o_totalprice::DECIMAL(18,2) AS premium FROM orders),
d AS (SELECT c_custkey AS c_key FROM customer WHERE c_custkey % 11 <> 0)"""
SUITE = Suite(("o_orderkey",), ("customer_bk",), (Key("customer_key", "customer", "c_key", "customer_bk", "important", "at"),), {"date_key_": "critical"}, "is_deleted")


def counter(spark: SparkSession, sf_dir: str, name: str, out: str) -> DataFrame:
    fact, dims, days = defective(spark, sf_dir)
    c = SUITE.counters(fact, dims, days)
    return c.select(F.col("n").alias("row_count"), F.col(f"`{name}`").alias(out))


@query(f"WITH {_F} SELECT count(*) AS row_count, count(*) FILTER (customer_bk IS NULL OR trim(customer_bk) = '') AS null_keys FROM f")
def val_null_bk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter(spark, sf_dir, "null_bk|customer_bk", "null_keys")


@query(f"WITH {_F} SELECT count(*) AS row_count, count(*) FILTER (customer_key <> -1 AND c_key IS NULL) AS orphans FROM f LEFT JOIN d ON customer_key = c_key")
def val_orphan_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter(spark, sf_dir, "orphan|customer_key", "orphans")


@query(f"WITH {_F} SELECT count(*) AS row_count, count(*) FILTER (customer_key = -1 AND trim(customer_bk) NOT IN ('', 'Unknown')) AS unresolved FROM f")
def val_unresolved_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter(spark, sf_dir, "unresolved|customer_key", "unresolved")


@query(f"WITH {_F} SELECT count(*) AS row_count, count(*) FILTER (customer_key <> -1 AND c_key IS NOT NULL AND moment::DATE < DATE '1996-01-01') AS too_early FROM f LEFT JOIN d ON customer_key = c_key")
def val_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter(spark, sf_dir, "temporal|customer_key", "too_early")


@query(f"WITH {_F} SELECT count(*) AS row_count, count(*) FILTER (moment::DATE > DATE '2000-12-31') AS without_date FROM f")
def val_date_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter(spark, sf_dir, "date|date_key_", "without_date")


@query(f"WITH {_F} SELECT count(*) AS row_count, count(*) FILTER (is_deleted AND deleted_at IS NULL) AS unexplained FROM f")
def val_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter(spark, sf_dir, "soft_delete|is_deleted", "unexplained")


@query("SELECT sum(n - 1)::BIGINT AS excess, count(*) AS grains FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def val_grain_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return g.agg(F.sum(F.col("n") - 1).alias("excess"), F.count("*").alias("grains"))


_CHECKS = "SELECT '{0}' AS \"check\", '{1}' AS \"column\", ({2})::DOUBLE AS bad, ({3})::DOUBLE AS figure, ({4})::DOUBLE AS \"limit\""


@query(f"""
WITH g AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS m FROM orders WHERE o_orderkey % 1000 <> 0),
n AS (SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM g) AS b, (SELECT sum(o_totalprice::DECIMAL(18,2))::DOUBLE FROM orders) AS x, (SELECT sum(m)::DOUBLE FROM g) AS y)
SELECT 'row_count' AS "check", (a - b)::DOUBLE AS bad, round((a - b) / a, 9) AS figure, a = b AS passed FROM n
UNION ALL SELECT 'metric', round(abs(x - y), 2), round(abs(x - y) / x, 9), abs(x - y) / x <= 0.0001 OR abs(x - y) <= 0.01 FROM n
""")
def val_rowcount_and_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and sums of a fact that misses some of its source, by the suite's own checks."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("m"))
    found = Suite(("o_orderkey",), (), metrics=("m",)).run(o.where("o_orderkey % 1000 <> 0"), o, {})
    rows = [(x["check"], round(x["bad"], 2), round(x["figure"], 9), x["passed"]) for x in found if x["check"] in ("row_count", "metric")]
    return spark.createDataFrame(rows, "check string, bad double, figure double, passed boolean")


@query(f"""
WITH {_F}, j AS (SELECT f.*, c_key FROM f LEFT JOIN d ON customer_key = c_key), s AS (SELECT * FROM f WHERE o_orderkey % 500 <> 0),
c AS (
  SELECT count(*)::DOUBLE AS n, count(*) FILTER (customer_bk IS NULL OR trim(customer_bk) = '') AS no_bk, count(*) FILTER (customer_key <> -1 AND c_key IS NULL) AS orphans,
         count(*) FILTER (customer_key = -1 AND trim(customer_bk) NOT IN ('', 'Unknown')) AS unresolved, count(*) FILTER (customer_key <> -1 AND c_key IS NOT NULL AND moment::DATE < DATE '1996-01-01') AS early,
         count(*) FILTER (moment::DATE > DATE '2000-12-31') AS dateless, count(*) FILTER (is_deleted AND deleted_at IS NULL) AS unexplained, count(*) - count(DISTINCT o_orderkey) AS excess, sum(premium)::DOUBLE AS y,
         (SELECT count(DISTINCT o_orderkey) FROM s) AS there, (SELECT sum(premium)::DOUBLE FROM s) AS x
  FROM j),
r AS (
  {" UNION ALL ".join(_CHECKS.format(*row) + " FROM c" for row in [
      ("grain", "o_orderkey", "excess", "excess", 0), ("null_bk", "customer_bk", "no_bk", "no_bk", 0), ("orphan", "customer_key", "orphans", "orphans", 0),
      ("unresolved", "customer_key", "unresolved", "unresolved / n", 0.01), ("temporal", "customer_key", "early", "early / n", 0.01), ("date", "date_key_", "dateless", "dateless / n", 0),
      ("soft_delete", "is_deleted", "unexplained", "unexplained", 0), ("row_count", "", "abs(there - n)", "abs(there - n) / there", 0), ("metric", "premium", "abs(x - y)", "abs(x - y) / x", 0.0001),
  ])})
SELECT "check", "column", round(bad, 2) AS bad, round(figure, 9) AS figure, "limit", figure <= "limit" OR ("check" = 'metric' AND bad <= 0.01) AS passed FROM r
""")  # fmt: skip
def validation_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine checks with their verdicts."""
    fact, dims, days = defective(spark, sf_dir)
    source = fact.where("o_orderkey % 500 <> 0")
    suite = Suite(SUITE.grain, SUITE.business_keys, SUITE.keys, SUITE.dates, SUITE.deleted, ("premium",))
    found = [x | {"bad": round(x["bad"], 2), "figure": round(x["figure"], 9)} for x in suite.run(fact, source, dims, days)]
    return spark.createDataFrame([tuple(x.values()) for x in found], "check string, column string, bad double, figure double, limit double, passed boolean")


_OF_CHECK = {"grain": "o_orderkey", "null_bk": "customer_bk", "orphan": "customer_key", "unresolved": "customer_key", "temporal": "customer_key", "date": "date_key_", "soft_delete": "is_deleted"}


@query(f"""
WITH {_F}, j AS (SELECT f.*, c_key FROM f LEFT JOIN d ON customer_key = c_key)
SELECT 'null_bk' AS "check", min(o_orderkey) FILTER (customer_bk IS NULL OR trim(customer_bk) = '') AS first_key FROM j
UNION ALL SELECT 'orphan', min(o_orderkey) FILTER (customer_key <> -1 AND c_key IS NULL) FROM j
UNION ALL SELECT 'unresolved', min(o_orderkey) FILTER (customer_key = -1 AND trim(customer_bk) NOT IN ('', 'Unknown')) FROM j
UNION ALL SELECT 'temporal', min(o_orderkey) FILTER (customer_key <> -1 AND c_key IS NOT NULL AND moment::DATE < DATE '1996-01-01') FROM j
UNION ALL SELECT 'date', min(o_orderkey) FILTER (moment::DATE > DATE '2000-12-31') FROM j
UNION ALL SELECT 'soft_delete', min(o_orderkey) FILTER (is_deleted AND deleted_at IS NULL) FROM j
UNION ALL SELECT 'grain', (SELECT min(o_orderkey) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))
""")
def val_first_offending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row that each check finds fault with."""
    fact, dims, days = defective(spark, sf_dir)
    found = [(c, SUITE.first_bad(fact, c, column, dims, days)) for c, column in _OF_CHECK.items()]
    rows = spark.createDataFrame(found, "check string, record string")
    return rows.select("check", F.get_json_object("record", "$.o_orderkey").cast("long").alias("first_key"))
