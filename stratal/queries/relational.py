"""Scans, projections, joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from stratal.functions.columns import amount, date_key, divide, known_key, live_amount, map_value
from stratal.operators.dedup import latest, latest_by_first_of, unchanged
from stratal.operators.mapping import Mapping, conform, project
from stratal.queries import query
from stratal.queries.star import table
from stratal.sources.readers import batch_of, change_time, file_states, lookup_sources, new_files, next_watermark, recovery_files, recovery_sources, since


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


ORDER_MAPPING = {
    "source": "bronze.orders", "target": "silver.quotation",
    "columns": [
        {"name": "quotation_id", "source": "o_orderkey"}, {"name": "customer_id", "source": "o_custkey"},
        {"name": "status", "source": "CASE WHEN o_orderstatus = 'F' THEN 'CONVERTED' ELSE 'OPEN' END"},
        {"name": "premium", "source": "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)"}, {"name": "day", "source": "date_format(o_orderdate, 'yyyy-MM-dd')"}, {"name": "note"},
    ],
    "literals": {"_source_name": "orders"},
}


@query("""
SELECT o_orderkey AS quotation_id, o_custkey AS customer_id, CASE WHEN o_orderstatus = 'F' THEN 'CONVERTED' ELSE 'OPEN' END AS status,
       o_totalprice::DECIMAL(18,2)::DOUBLE AS premium, strftime(o_orderdate, '%Y-%m-%d') AS day, NULL::VARCHAR AS note, 'orders' AS _source_name FROM orders
""")
def mapping_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(t(spark, sf_dir, "orders"), Mapping.of(ORDER_MAPPING))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, NULL::VARCHAR AS c_phone, c_nationkey::BIGINT AS c_nationkey FROM customer")
def conform_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Casts, a missing column as nulls, extra columns dropped."""
    kinds = (("c_custkey", StringType()), ("c_name", StringType()), ("c_phone", StringType()), ("c_nationkey", LongType()))
    return conform(t(spark, sf_dir, "customer"), StructType([StructField(n, k) for n, k in kinds]))


@query("SELECT event_type, TRY_CAST(event_type AS DATE)::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL")
def conform_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that cannot be cast become null."""
    e = t(spark, sf_dir, "events").select("event_type", F.col("event_type").alias("day"))
    out = conform(e, StructType([StructField("event_type", StringType()), StructField("day", DateType())]), lenient=True)
    return out.groupBy("event_type", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def watermark_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return since(t(spark, sf_dir, "events"), "ts", "2024-01-15 00:00:00").select("event_id", "user_id", "event_type")


@query("SELECT o_orderkey, strftime(coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END, o_orderdate - INTERVAL 1 DAY), '%Y-%m-%d') AS changed FROM orders WHERE coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END, o_orderdate - INTERVAL 1 DAY) > TIMESTAMP '2000-01-01 00:00:00'")
def watermark_never_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that were never updated go by their creation time."""
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END").alias("updated"), F.expr("o_orderdate - INTERVAL 1 DAY").alias("created"))
    o = o.withColumn("at", change_time("updated", "created"))
    return since(o, "at", "2000-01-01 00:00:00").select("o_orderkey", F.date_format("at", "yyyy-MM-dd").alias("changed"))


@query("SELECT max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS watermark, count(*) AS row_count FROM events")
def watermark_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest time loaded, from the operator that a load calls when it has succeeded."""
    e = t(spark, sf_dir, "events")
    mark = next_watermark(e, "ts", "2000-01-01 00:00:00")
    return e.agg(F.count("*").alias("row_count")).select(F.date_format(F.lit(mark).cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("watermark"), "row_count")


@query("SELECT _batch_id, count(*) AS n, sum(user_id)::BIGINT AS users FROM (SELECT strftime(ts, '%Y%m%d') AS _batch_id, user_id FROM events) WHERE _batch_id = '20240110' GROUP BY 1")
def batch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").withColumn("_batch_id", F.date_format("ts", "yyyyMMdd"))
    return batch_of(e, 20240110).groupBy("_batch_id").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"))


@query("""
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'BANK_TRANSFER' WHEN 'MACHINERY' THEN 'CREDIT_CARD' ELSE upper(c_mktsegment) END AS code FROM customer
""")
def value_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = {"BUILDING": "BANK_TRANSFER", "MACHINERY": "CREDIT_CARD"}
    return t(spark, sf_dir, "customer").select("c_custkey", map_value("c_mktsegment", mapping).alias("code"))


@query("SELECT event_type, sum(CASE WHEN event_type = 'error' THEN 0 ELSE coalesce(value, 0)::DECIMAL(18,2) END)::DOUBLE AS live_value, count(*) FILTER (event_type = 'error') AS deleted FROM events GROUP BY 1")
def soft_delete_zeroing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted rows add nothing but are still counted."""
    gone = F.col("event_type") == "error"
    e = t(spark, sf_dir, "events").withColumn("v", live_amount(amount(F.col("value")), gone))
    return e.groupBy("event_type").agg(F.sum("v").cast("double").alias("live_value"), F.count_if(gone).alias("deleted"))


@query("SELECT o_orderkey, coalesce(strftime(CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END, '%Y%m%d')::INTEGER, -1) AS date_key, coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END, -1) AS customer_key FROM orders")
def default_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    day, cust = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey"))
    return o.select("o_orderkey", date_key(day).alias("date_key"), known_key(cust).alias("customer_key"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select("o_custkey")
    return t(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_customers_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey")
    return t(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS converted_flag FROM orders")
def exists_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct()
    return t(spark, sf_dir, "orders").join(have, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.col("l_orderkey").isNotNull().alias("converted_flag"))


@query("SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1")
def bridge_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a customer, the same in every run."""
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return latest(o, ["o_custkey"], [F.col("o_orderkey").asc()]).select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def dedup_latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return latest(e, ["user_id"], [F.col("ts").desc()]).select("user_id", "event_id", "event_type")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey) = 1
""")
def dedup_lineitem_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return latest_by_first_of(li, ["l_orderkey", "l_linenumber"], ["updated_at", "l_shipdate"]).drop("l_shipdate")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 OR c_acctbal < 0")
def unchanged_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the target has already, equal in every column, are left out."""
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    target = c.where("c_custkey % 3 = 0").withColumn("c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_name")))
    return unchanged(c, target, ["c_custkey"], ["c_name"]).select("c_custkey", "c_name")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, sum(l_quantity)::DOUBLE AS quantity, count(*) FILTER (l_discount > 0.05) AS discounted, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS price FROM lineitem GROUP BY ALL")
def conditional_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.sum("l_quantity").alias("quantity"),
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("price"),
    )


@query("SELECT l_orderkey, l_linenumber, count(*) AS row_count, count(*) - 1 AS excess FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def having_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratal.operators.checks import duplicates

    return duplicates(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1")
def latest_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(1).select("o_orderkey")


@query("""
WITH s AS (
  SELECT n_name, c_custkey, sum(o_totalprice::DECIMAL(18,2)) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_custkey)
SELECT n_name, c_custkey, total::DOUBLE AS total FROM s QUALIFY rank() OVER (PARTITION BY n_name ORDER BY s.total DESC) <= 3
""")
def top_n_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of three customers a nation; all of a tie are shown."""
    o, c, n = (t(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    sums = joined.groupBy("n_name", "c_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    rank = F.rank().over(Window.partitionBy("n_name").orderBy(F.desc("total")))
    return sums.withColumn("k", rank).where("k <= 3").select("n_name", "c_custkey", F.col("total").cast("double").alias("total"))


@query("SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stratal.plans.monitoring import row_counts

    return row_counts({x: t(spark, sf_dir, x) for x in ("orders", "customer", "lineitem")}).toDF("t", "n")


@query("SELECT c_nationkey::BIGINT AS k FROM customer EXCEPT SELECT s_nationkey::BIGINT FROM supplier WHERE s_suppkey % 3 = 0")
def except_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0")
    return t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k")).subtract(s.select(F.col("s_nationkey").cast("long")))


@query("""
SELECT event_id, upper(event_type) AS u, length(props) AS len, json_extract_string(props, '$.k')::INTEGER AS k, year(ts)::INTEGER AS y, strftime(ts, '%Y-%m') AS ym,
       (date_diff('day', DATE '2024-01-01', ts::DATE))::BIGINT AS d, weekofyear(ts)::INTEGER AS w, md5(event_type || '||' || user_id) AS h,
       floor(CASE WHEN user_id <> 0 THEN value / user_id END * 1000)::BIGINT AS per_user FROM events
""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String, date, JSON and arithmetic functions."""
    return t(spark, sf_dir, "events").select(
        "event_id", F.upper("event_type").alias("u"), F.length("props").cast("long").alias("len"), F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.year("ts").alias("y"), F.date_format("ts", "yyyy-MM").alias("ym"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("d"),
        F.weekofyear("ts").alias("w"), F.md5(F.concat_ws("||", "event_type", F.col("user_id").cast("string"))).alias("h"),
        F.floor(divide(F.col("value"), F.col("user_id")) * 1000).cast("long").alias("per_user"),
    )


_SOURCES = "SELECT n_nationkey AS source_id, n_name AS source_name, n_nationkey * 7 % 25 AS load_sequence, n_nationkey % 4 <> 0 AS is_active FROM nation"
_MARKS = "SELECT CAST(o_custkey % 25 AS INT) AS source_id, CAST(CAST(max(o_orderdate) AS DATE) AS STRING) AS watermark FROM orders WHERE o_custkey % 3 <> 0 AND o_custkey % 25 < 20 GROUP BY 1"
_LAST_RUN = "SELECT CAST(o_custkey % 25 AS INT) AS source_id, CASE WHEN o_orderkey % 25 < 3 AND o_custkey % 25 < 9 THEN 'FAILED' WHEN o_custkey % 25 = 15 THEN 'NOT_RUN' ELSE 'SUCCESS' END AS status FROM orders"
_FILE_LOG = """
SELECT o_custkey % 25 AS source_id, concat('f', o_orderkey % 300) AS file_name, o_orderkey % 5 AS batch_id,
       CASE o_orderkey % 7 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'NOT_RUN' ELSE 'SUCCESS' END AS status FROM orders WHERE o_orderkey % 11 < 3"""
_LISTED = "SELECT DISTINCT l_suppkey % 25 AS source_id, concat('f', l_orderkey % 400) AS file_name FROM lineitem"
_duck = lambda sql: sql.replace("AS STRING", "AS VARCHAR")


def rows_of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over the test tables, in words that Spark's SQL and the oracle's share."""
    names = [n for n in ("nation", "orders", "lineitem", "customer") if f"FROM {n}" in sql]
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(sql, **{n: t(spark, sf_dir, n) for n in names})


@query(f"WITH s AS ({_duck(_SOURCES)}), w AS ({_duck(_MARKS)}) SELECT source_id, source_name, load_sequence, watermark FROM s LEFT JOIN w USING (source_id) WHERE is_active")
def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_sources(rows_of(spark, sf_dir, _SOURCES), rows_of(spark, sf_dir, _MARKS)).select("source_id", "source_name", "load_sequence", "watermark")


@query(f"WITH s AS ({_SOURCES}), r AS ({_LAST_RUN}) SELECT source_id FROM s WHERE is_active AND source_id IN (SELECT source_id FROM r WHERE status IN ('FAILED', 'NOT_RUN'))")
def recovery_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery_sources(rows_of(spark, sf_dir, _SOURCES), rows_of(spark, sf_dir, _LAST_RUN)).select("source_id")


@query(f"""
WITH g AS ({_FILE_LOG}), l AS ({_LISTED})
SELECT 'new' AS plan, source_id, file_name, '' AS status FROM l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.source_id = l.source_id AND g.file_name = l.file_name AND g.status = 'SUCCESS')
UNION ALL SELECT DISTINCT 'recover', source_id, file_name, '' FROM g WHERE batch_id = 3 AND status <> 'SUCCESS'
UNION ALL SELECT 'state', l.source_id, l.file_name, coalesce(g.status, 'MISSING') FROM l LEFT JOIN g ON g.source_id = l.source_id AND g.file_name = l.file_name WHERE coalesce(g.status, 'MISSING') <> 'SUCCESS'
""")
def file_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new run reads, what a recovery reads, and what is missing or failed."""
    log, listed = rows_of(spark, sf_dir, _FILE_LOG), rows_of(spark, sf_dir, _LISTED)
    new = new_files(listed, log).select(F.lit("new").alias("plan"), "source_id", "file_name", F.lit("").alias("status"))
    again = recovery_files(log, 3).select(F.lit("recover"), "source_id", "file_name", F.lit(""))
    return new.union(again).union(file_states(listed, log).select(F.lit("state"), "source_id", "file_name", "status"))
