"""The insurance star over the driver's tables, as frames and as SQL.

Quotations are orders, policies those with status F, payments line items, cancellations returned
first lines. Agents are nations with their regions, providers five codes by order key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratal.semantic.engine import AGING, Dimension, Star, aging_bucket

#: Provider codes.
PROVIDERS = ("BV", "PVI", "PTI", "MIC", "LIB")
AS_OF = "1999-06-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


def with_date(df: DataFrame, c: str) -> DataFrame:
    """The date role: ``full_date`` and its parts."""
    d = F.col(c)
    return df.withColumns({"full_date": d, "year_number": F.year(d), "month_number": F.month(d), "year_month": F.date_format(d, "yyyy-MM")})


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_nationkey").alias("agent_id"), F.col("n_name").alias("agent_name"), F.col("r_name").alias("region")
    )


def provider(key: str):
    return F.element_at(F.array(*(F.lit(p) for p in PROVIDERS)), (F.col(key) % len(PROVIDERS) + 1).cast("int"))


def _customers(spark: SparkSession, sf_dir: str) -> tuple[Dimension, Dimension]:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("city"), F.col("c_nationkey").alias("agent_id"))
    a = agents(spark, sf_dir).withColumnRenamed("agent_id", "n_agent_id")
    return Dimension(c, "customer_key", "c_custkey", ("city", "agent_id")), Dimension(F.broadcast(a), "agent_id", "n_agent_id", ("agent_name", "region"))


def quotation_star(spark: SparkSession, sf_dir: str) -> Star:
    k = F.col("o_orderkey") % 3
    status = (
        F.when(F.col("o_orderstatus") == "F", "CONVERTED").when(F.col("o_orderstatus") == "P", "REJECTED")
        .when(k == 0, "QUOTED").when(k == 1, "ACCEPTED").otherwise("EXPIRED")
    )
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("quotation_id"), F.col("o_custkey").alias("customer_key"), provider("o_orderkey").alias("provider_code"), F.col("o_orderpriority").alias("package_code"),
        status.alias("status"), (F.col("o_orderstatus") == "F").alias("converted_flag"), money("o_totalprice").alias("premium_amount"), F.col("o_orderdate").cast("date").alias("quoted_date"),
    )
    return Star(rows, _customers(spark, sf_dir))


def policy_star(spark: SparkSession, sf_dir: str) -> Star:
    k = F.col("quotation_id") % 4
    status = F.when(k == 0, "ACTIVE").when(k == 1, "ISSUED").when(k == 2, "EXPIRED").otherwise("CANCELLED")
    q = quotation_star(spark, sf_dir)
    rows = q.fact.where("converted_flag").withColumn("status", status).withColumnRenamed("quotation_id", "policy_id")
    d = F.col("quoted_date")
    return Star(rows.drop("converted_flag").withColumns({"issued_date": d, "start_date": d, "end_date": F.add_months(d, 12)}).drop("quoted_date"), q.dimensions)


def payment_star(spark: SparkSession, sf_dir: str) -> Star:
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    status = F.when(flag == "A", "PAID").when(flag == "R", "REFUNDED").when(line == "O", "PENDING").otherwise("FAILED")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("policy_id"), provider("l_orderkey").alias("provider_code"), status.alias("status"),
        money("l_extendedprice").alias("payment_amount"), F.col("l_shipdate").cast("date").alias("payment_date"),
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("issued_date"))
    return Star(rows, (Dimension(o, "policy_id", "o_orderkey", ("issued_date",)),))


def quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns, every dimension joined."""
    s = quotation_star(spark, sf_dir)
    return s.with_columns(set(s.columns))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = policy_star(spark, sf_dir)
    return s.with_columns(set(s.columns))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = payment_star(spark, sf_dir)
    return s.with_columns(set(s.columns))


def cancellations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1")
    return li.select(
        F.col("l_orderkey").alias("policy_id"), provider("l_orderkey").alias("provider_code"),
        money("l_extendedprice").alias("refund_amount"), F.col("l_shipdate").cast("date").alias("cancelled_date"),
    )


def facts(spark: SparkSession, sf_dir: str, policy_role: str = "issued_date") -> dict[str, Star]:
    dated = lambda star, c: Star(with_date(star.fact, c), star.dimensions)
    aged = lambda star: Star(star.fact.withColumn("aging_bucket", aging_bucket(F.datediff(F.lit(AS_OF), "payment_date"))), star.dimensions)
    return {
        "fact_quotation": dated(quotation_star(spark, sf_dir), "quoted_date"), "fact_policy": dated(policy_star(spark, sf_dir), policy_role),
        "fact_payment": aged(dated(payment_star(spark, sf_dir), "payment_date")), "fact_cancellation": Star(with_date(cancellations(spark, sf_dir), "cancelled_date")),
    }


_BUCKET = "CASE " + " ".join(f"WHEN date_diff('day', payment_date, DATE '{AS_OF}') <= {last} THEN '{name}'" for name, _, last in AGING[:-1]) + f" ELSE '{AGING[-1][0]}' END"
_DATE = "year({0})::INTEGER AS year_number, month({0})::INTEGER AS month_number, strftime({0}, '%Y-%m') AS year_month"
STAR = f"""
fq AS (
  SELECT *, quoted_date AS full_date, {_DATE.format('quoted_date')} FROM (
    SELECT o_orderkey AS quotation_id, o_custkey AS customer_key, n_nationkey AS agent_id, n_name AS agent_name, r_name AS region,
           c_mktsegment AS city, {list(PROVIDERS)}[o_orderkey % 5 + 1] AS provider_code, o_orderpriority AS package_code,
           CASE WHEN o_orderstatus = 'F' THEN 'CONVERTED' WHEN o_orderstatus = 'P' THEN 'REJECTED'
                WHEN o_orderkey % 3 = 0 THEN 'QUOTED' WHEN o_orderkey % 3 = 1 THEN 'ACCEPTED' ELSE 'EXPIRED' END AS status,
           o_orderstatus = 'F' AS converted_flag, o_totalprice::DECIMAL(18,2) AS premium_amount, o_orderdate::DATE AS quoted_date
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)),
pol AS (
  SELECT quotation_id AS policy_id, customer_key, agent_id, agent_name, region, city, provider_code, package_code, premium_amount,
         CASE quotation_id % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'ISSUED' WHEN 2 THEN 'EXPIRED' ELSE 'CANCELLED' END AS status,
         quoted_date AS issued_date, quoted_date AS start_date, (quoted_date + INTERVAL 1 YEAR)::DATE AS end_date
  FROM fq WHERE converted_flag),
fp AS (SELECT *, {_DATE.format('issued_date')} FROM pol),
fpe AS (SELECT *, {_DATE.format('end_date')} FROM pol),
fpay AS (
  SELECT *, payment_date AS full_date, {_BUCKET} AS aging_bucket, {_DATE.format('payment_date')} FROM (
    SELECT l_orderkey AS policy_id, {list(PROVIDERS)}[l_orderkey % 5 + 1] AS provider_code,
           CASE WHEN l_returnflag = 'A' THEN 'PAID' WHEN l_returnflag = 'R' THEN 'REFUNDED' WHEN l_linestatus = 'O' THEN 'PENDING' ELSE 'FAILED' END AS status,
           l_extendedprice::DECIMAL(18,2) AS payment_amount, l_shipdate::DATE AS payment_date, o_orderdate::DATE AS issued_date
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
fcan AS (
  SELECT *, {_DATE.format('cancelled_date')} FROM (
    SELECT l_orderkey AS policy_id, {list(PROVIDERS)}[l_orderkey % 5 + 1] AS provider_code,
           l_extendedprice::DECIMAL(18,2) AS refund_amount, l_shipdate::DATE AS cancelled_date
    FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1))
"""
