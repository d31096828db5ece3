"""Dimensions, keys, upserts, point-in-time joins and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from stratal.operators.asof import last_before, version_at
from stratal.operators.calendar import calendar, extend_calendar
from stratal.operators.facts import Bridge, Fact, Lookup, Parent
from stratal.operators.keys import assign_keys
from stratal.operators.merge import Clause, Merge, upsert
from stratal.operators.scd import History, Type1, Type2, versions, with_unknown
from stratal.queries import query
from stratal.queries.star import table
from stratal.session import staged

_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def ts_text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("""
SELECT strftime(d, '%Y%m%d')::INTEGER AS date_key, strftime(d, '%Y-%m-%d') AS full_date, day(d)::INTEGER AS day_number, strftime(d, '%A') AS day_name, weekofyear(d)::INTEGER AS week_number,
       month(d)::INTEGER AS month_number, strftime(d, '%B') AS month_name, quarter(d)::INTEGER AS quarter_number, year(d)::INTEGER AS year_number, strftime(d, '%Y-%m') AS year_month, dayofweek(d) IN (0, 6) AS is_weekend
FROM (SELECT unnest(generate_series((SELECT min(o_orderdate)::DATE FROM orders), (SELECT max(l_shipdate)::DATE FROM lineitem), INTERVAL 1 DAY)) AS d)
UNION ALL SELECT -1, NULL, NULL, 'Unknown', NULL, NULL, 'Unknown', NULL, NULL, 'Unknown', false
""")
def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of the orders, then extended to those of their shipments."""
    o = table(spark, sf_dir, "orders").agg(F.min("o_orderdate").cast("date").cast("string").alias("a"), F.max("o_orderdate").cast("date").cast("string").alias("b")).first()
    last = table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").cast("date").cast("string")).first()[0]
    d = extend_calendar(calendar(spark, o["a"], o["b"]), calendar(spark, o["a"], last, unknown=False)).drop("_action")
    return d.withColumn("full_date", F.col("full_date").cast("string"))


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer UNION ALL SELECT -1, 'Unknown', NULL, 'Unknown'")
def unknown_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension with its unknown member, once also where it has one already."""
    return with_unknown(with_unknown(table(spark, sf_dir, "customer").drop("c_acctbal"), "c_custkey"), "c_custkey")


@query("SELECT p_type, row_number() OVER (ORDER BY p_type) + 100 AS type_key FROM (SELECT DISTINCT p_type FROM part)")
def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_keys(table(spark, sf_dir, "part").select("p_type").distinct(), ["p_type"], "type_key", 100)


@query("SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_name NULLS FIRST, p_partkey) AS k FROM part")
def surrogate_keys_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt to ranges: the same ranks without one task seeing all rows."""
    return assign_keys(table(spark, sf_dir, "part").select("p_name", "p_partkey"), ["p_name", "p_partkey"], "k", 0, range_rows=100)


@query("""
WITH s AS (SELECT c_custkey, c_name || '*' AS c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 5 = 0),
t AS (SELECT c_custkey, c_name, c_acctbal FROM customer)
SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN s.c_custkey IS NOT NULL THEN s.c_name ELSE t.c_name END AS c_name, coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal,
       CASE WHEN t.c_custkey IS NULL THEN 'INSERTED' WHEN s.c_custkey IS NULL THEN 'KEPT' ELSE 'UPDATED' END AS _action
FROM t FULL JOIN s ON t.c_custkey = s.c_custkey
""")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed = c.where("c_custkey % 2 = 0").withColumn("c_name", F.concat("c_name", F.lit("*")))
    new = c.where("c_custkey % 5 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return upsert(c, changed.unionByName(new), ["c_custkey"])


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 2 = 0 THEN 'DONE' WHEN o_orderkey % 2 = 0 THEN 'KEPT-F' ELSE o_orderstatus END AS o_orderstatus FROM orders
""")
def merge_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered clauses: the first that holds wins; no insert."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    s = o.where("o_orderkey % 2 = 0").select("o_orderkey").unionByName(o.agg((F.max("o_orderkey") + 1).alias("o_orderkey")))
    merge = Merge(["o_orderkey"], [Clause("t.o_orderstatus <> 'F'", {"o_orderstatus": "'DONE'"}), Clause(None, {"o_orderstatus": "'KEPT-F'"})], insert=False)
    return merge.apply(o, s).drop("_action")


@query("""
WITH t AS (SELECT row_number() OVER (ORDER BY p_brand) AS brand_key, p_brand, size FROM (SELECT p_brand, min(p_size) AS size FROM part WHERE p_size <= 25 GROUP BY 1)),
s AS (SELECT p_brand, max(p_size) AS size FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
SELECT brand_key, p_brand, coalesce(s.size, t.size) AS size, CASE WHEN s.size <> t.size THEN 'UPDATED' ELSE 'KEPT' END AS _action FROM t LEFT JOIN s USING (p_brand)
UNION ALL SELECT (SELECT coalesce(max(brand_key), 0) FROM t) + row_number() OVER (ORDER BY p_brand), p_brand, size, 'INSERTED' FROM s ANTI JOIN t USING (p_brand)
""")
def scd1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    t = assign_keys(p.where("p_size <= 25").groupBy("p_brand").agg(F.min("p_size").alias("size")), ["p_brand"], "brand_key", 0).select("brand_key", "p_brand", "size")
    batch = p.where("p_partkey % 3 = 0").select("p_brand", F.col("p_size").alias("size"))
    return Type1("brand_key", "p_brand", ("size",), ("size",)).apply(t, batch)


_VERSIONS = f"""
v AS (
  SELECT user_id, event_type, ts AS effective_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt
  FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type AS new FROM events) WHERE new),
d AS (SELECT user_id, event_type, effective_from, coalesce(nxt, TIMESTAMP '9999-12-31 23:59:59') AS effective_to, nxt IS NULL AS is_current FROM v)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return versions(e, "user_id", ["event_type"], "ts", ["event_id"])


@query(f"WITH {_VERSIONS} SELECT user_id, event_type, {_TS.format('effective_from')} AS effective_from, {_TS.format('effective_to')} AS effective_to, is_current FROM d")
def scd2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).select("user_id", "event_type", ts_text("effective_from").alias("effective_from"), ts_text("effective_to").alias("effective_to"), "is_current")


@query(f"WITH {_VERSIONS} SELECT user_id, event_type FROM d WHERE is_current")
def scd2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).where("is_current").select("user_id", "event_type")


_APPLY = f"""
t AS (
  SELECT row_number() OVER (ORDER BY user_id) AS user_key, user_id, event_type, ts AS effective_from FROM events WHERE ts < TIMESTAMP '2024-01-10' AND user_id % 3 <> 0
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id, event_type) = 1),
k AS (SELECT row_number() OVER (ORDER BY user_id) AS user_key, * EXCLUDE (user_key) FROM t),
s AS (SELECT user_id, event_type, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) = 1),
n AS (SELECT s.* FROM s LEFT JOIN k USING (user_id) WHERE k.user_id IS NULL OR k.event_type <> s.event_type)"""


@query(f"""
WITH {_APPLY}
SELECT user_key, k.user_id, k.event_type, n.user_id IS NULL AS is_current, CASE WHEN n.user_id IS NULL THEN '9999-12-31 23:59:59' ELSE {_TS.format('n.ts')} END AS effective_to,
       CASE WHEN n.user_id IS NULL THEN 'KEPT' ELSE 'EXPIRED' END AS _action FROM k LEFT JOIN n ON k.user_id = n.user_id
UNION ALL SELECT (SELECT max(user_key) FROM k) + row_number() OVER (ORDER BY user_id), user_id, event_type, true, '9999-12-31 23:59:59', 'INSERTED' FROM n
""")
def scd2_apply_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch on a dimension: versions expired and added in one plan."""
    from stratal.operators.dedup import latest

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    first = latest(e.where("ts < TIMESTAMP '2024-01-10' AND user_id % 3 <> 0"), ["user_id"], [F.col("ts").desc()])
    target = assign_keys(first, ["user_id"], "user_key", 0).select(
        "user_key", "user_id", "event_type", F.col("ts").alias("effective_from"), F.expr("TIMESTAMP '9999-12-31 23:59:59'").alias("effective_to"), F.lit(True).alias("is_current")
    )
    out = Type2("user_key", "user_id", ("event_type",), "ts").apply(target, e.where("ts >= TIMESTAMP '2024-01-10'").drop("event_id"))
    return out.select("user_key", "user_id", "event_type", "is_current", ts_text("effective_to").alias("effective_to"), "_action")


@query(f"""
WITH e AS (SELECT user_id, ts, max(event_type) AS event_type FROM events GROUP BY ALL),
v AS (
  SELECT user_id, event_type, ts AS effective_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt
  FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) IS DISTINCT FROM event_type AS new FROM e) WHERE new)
SELECT user_id, event_type, {_TS.format('effective_from')} AS effective_from, CASE WHEN nxt IS NULL THEN '9999-12-31 23:59:59' ELSE {_TS.format('nxt')} END AS effective_to, nxt IS NULL AS is_current,
       1::BIGINT AS versions_of_key FROM v
""")
def scd2_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt to three batches at random: late ones split versions, several of a key come at once, and the history is
    that of all events. Every version has a key of its own."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    kinds = "user_key long, user_id long, event_type string, effective_from timestamp, effective_to timestamp, is_current boolean, is_version boolean"
    stored, dim = spark.createDataFrame([], kinds), History("user_key", "user_id", ("event_type",), "ts")
    for i in range(3):
        batch = e.where(F.pmod(F.xxhash64("user_id", "ts", "event_type"), F.lit(3)) == i)
        stored = staged(dim.apply(stored, batch).where("_action <> 'RETIRED'").drop("_action"), "scd2-any-order")
    shared = F.count("*").over(Window.partitionBy("user_key")).alias("versions_of_key")
    out = stored.where("is_version").select("user_id", "event_type", "effective_from", "effective_to", "is_current", shared)
    return out.withColumns({c: ts_text(c) for c in ("effective_from", "effective_to")})


_ORDER_AT = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (o_orderkey % 720) HOUR"
_PIT = f"""
WITH {_VERSIONS}, o AS (SELECT o_orderkey, o_custkey % 150 AS user_id, {_ORDER_AT} AS moment FROM orders)
SELECT o.o_orderkey, coalesce(strftime(d.effective_from, '%Y%m%d%H%M%S')::BIGINT, -1) AS version_key
FROM o LEFT JOIN d ON o.user_id = d.user_id AND o.moment >= d.effective_from AND o.moment < d.effective_to"""


def events_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    at = F.expr("timestampadd(HOUR, CAST(o_orderkey % 720 AS INT), TIMESTAMP '2024-01-01 00:00:00')")
    return o.select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), at.alias("at"))


def keyed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.date_format("effective_from", "yyyyMMddHHmmss").cast("long")
    return history(spark, sf_dir).withColumn("version_key", key)


@query(_PIT)
def pit_join_event_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = version_at(events_at(spark, sf_dir), keyed_history(spark, sf_dir), "user_id", "user_id", "at", "version_key")
    return out.select("o_orderkey", "version_key")


@query(_PIT.replace("coalesce(strftime(d.effective_from, '%Y%m%d%H%M%S')::BIGINT, -1)", "strftime(d.effective_from, '%Y%m%d%H%M%S')::BIGINT"))
def pit_join_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by one window over events and versions; null where there is none."""
    v = keyed_history(spark, sf_dir).select("user_id", "effective_from", "version_key")
    return last_before(events_at(spark, sf_dir), v, "user_id", "at", "effective_from", "version_key", "version_key").select("o_orderkey", "version_key")


@query(f"SELECT count(*) AS n, count(*) FILTER (version_key = -1) AS unresolved FROM ({_PIT})")
def pit_unresolved_minus_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit_join_event_version(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("version_key") == -1).alias("unresolved"))


QUOTATION = Fact(
    grain=("quotation_id",), keep=("status",), bridges=(Bridge("vehicle", "customer_id", "v_customer", "vehicle_id", "vehicle_id"),),
    lookups=(Lookup("package", "package", "p_code", "package_key"), Lookup("customer", "customer_id", "c_custkey", "c_key", "customer_key")),
    dates={"quotation_date_key": "at"}, amounts=("premium",), flags={"converted_flag": ("policy", "policy_quotation", "quotation_id")},
)


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    o, c, li = (table(spark, sf_dir, x) for x in ("orders", "customer", "lineitem"))
    packages = assign_keys(o.select(F.col("o_orderpriority").alias("p_code")).distinct(), ["p_code"], "package_key", 0).where("p_code <> '5-LOW'")
    return {
        "package": packages, "customer": c.select("c_custkey", (F.col("c_custkey") + 1000).alias("c_key")),
        "vehicle": li.select(F.col("l_suppkey").alias("v_customer"), F.col("l_partkey").alias("vehicle_id")), "policy": o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("policy_quotation")),
        "quotation": o.select(F.col("o_orderkey").alias("q_id"), "o_custkey", "o_orderstatus").where("o_orderstatus <> 'P'"),
    }


@query("""
WITH pk AS (SELECT p_code, row_number() OVER (ORDER BY p_code) AS package_key FROM (SELECT DISTINCT o_orderpriority AS p_code FROM orders)),
v AS (SELECT l_suppkey AS v_customer, min(l_partkey) AS vehicle_id FROM lineitem GROUP BY 1)
SELECT o_orderkey AS quotation_id, coalesce(CASE WHEN p_code <> '5-LOW' THEN package_key END, -1) AS package_key, o_custkey + 1000 AS customer_key,
       strftime(o_orderdate, '%Y%m%d')::INTEGER AS quotation_date_key, o_orderstatus AS status, o_totalprice::DECIMAL(18,2)::DOUBLE AS premium, o_orderstatus = 'F' AS converted_flag
FROM orders LEFT JOIN pk ON p_code = o_orderpriority
""")
def fact_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("quotation_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("package"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("at"), F.col("o_totalprice").cast("decimal(18,2)").alias("premium"),
    )
    return QUOTATION.build(o, frames(spark, sf_dir)).withColumn("premium", F.col("premium").cast("double"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey AS customer_id, strftime(l_shipdate, '%Y%m%d')::INTEGER AS ship_date_key,
       CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_extendedprice::DECIMAL(18,2) END::DOUBLE AS amount, l_returnflag = 'R' AS is_deleted
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'
""")
def fact_quotation_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mandatory parent, and amounts of deleted rows set to zero."""
    fact = Fact(
        grain=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), keep=("customer_id",), parents=(Parent("quotation", "l_orderkey", "q_id", {"customer_id": "o_custkey"}, True),),
        dates={"ship_date_key": "l_shipdate"}, amounts=("amount",), deleted="is_deleted",
    )
    li = table(spark, sf_dir, "lineitem").withColumns({"amount": F.col("l_extendedprice").cast("decimal(18,2)"), "is_deleted": F.col("l_returnflag") == "R"})
    return fact.build(li, frames(spark, sf_dir)).withColumn("amount", F.col("amount").cast("double"))


@query(f"""
WITH {_VERSIONS}
SELECT o_orderkey AS policy_id, coalesce(strftime(d.effective_from, '%Y%m%d%H%M%S')::BIGINT, -1) AS customer_key, strftime(moment, '%Y%m%d')::INTEGER AS issued_date_key, premium::DOUBLE AS premium
FROM (SELECT o_orderkey, o_custkey % 150 AS user_id, {_ORDER_AT} AS moment, o_totalprice::DECIMAL(18,2) AS premium FROM orders WHERE o_orderstatus = 'F') AS o
LEFT JOIN d ON o.user_id = d.user_id AND o.moment >= d.effective_from AND o.moment < d.effective_to
""")
def fact_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point-in-time key inside a fact."""
    fact = Fact(grain=("policy_id",), keep=(), lookups=(Lookup("history", "user_id", "user_id", "version_key", "customer_key", "at"),), dates={"issued_date_key": "at"}, amounts=("premium",))
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("policy_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("premium"))
    rows = o.join(events_at(spark, sf_dir), F.col("policy_id") == F.col("o_orderkey")).drop("o_orderkey")
    history_ = keyed_history(spark, sf_dir).withColumnRenamed("user_id", "h_user").withColumnRenamed("h_user", "user_id")
    return fact.build(rows, {"history": history_}).withColumn("premium", F.col("premium").cast("double"))


@query("""
SELECT l_orderkey AS policy_id, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN 'BANK_TRANSFER' ELSE upper(l_linestatus) END AS method,
       coalesce(o_custkey, -1) AS customer_id, strftime(l_shipdate, '%Y%m%d')::INTEGER AS payment_date_key, l_extendedprice::DECIMAL(18,2)::DOUBLE AS amount
FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey
""")
def fact_payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An optional parent and a conformed code."""
    fact = Fact(
        grain=("policy_id", "l_linenumber", "l_partkey", "l_suppkey"), keep=("method", "customer_id"), parents=(Parent("quotation", "policy_id", "q_id", {"customer_id": "o_custkey"}),),
        dates={"payment_date_key": "l_shipdate"}, amounts=("amount",),
    )
    method = F.when(F.col("l_returnflag") == "A", "BANK_TRANSFER").otherwise(F.upper("l_linestatus"))
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "policy_id").withColumns({"amount": F.col("l_extendedprice").cast("decimal(18,2)"), "method": method})
    out = fact.build(li, frames(spark, sf_dir))
    return out.withColumns({"amount": F.col("amount").cast("double"), "customer_id": F.coalesce("customer_id", F.lit(-1))})


@query("""
SELECT l_orderkey AS policy_id, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')::INTEGER AS cancellation_date_key, l_extendedprice::DECIMAL(18,2)::DOUBLE AS refund
FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1
""")
def fact_cancellation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = Fact(grain=("policy_id", "l_partkey", "l_suppkey"), keep=(), dates={"cancellation_date_key": "l_shipdate"}, amounts=("refund",))
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").withColumnRenamed("l_orderkey", "policy_id")
    return fact.build(li.withColumn("refund", F.col("l_extendedprice").cast("decimal(18,2)")), {}).withColumn("refund", F.col("refund").cast("double"))
