"""Audit state, gates and monitoring over a synthetic run log made from orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratal.plans.audit import RetryPolicy, append_details, carry_over, finish_sessions, gate, latest_attempts, next_attempt, only, record_files, record_layers, source_success, start_sessions
from stratal.plans.monitoring import captured_counts, file_sessions, investigation_queue, invalid_records, layer_monitor, retries, run_summary
from stratal.queries import query
from stratal.queries.star import table
from stratal.session import shared_dir
from stratal.sources.readers import dirty_json

# the log tables, in words that Spark's SQL and the oracle's share
_AT = "TIMESTAMP '2024-01-01 00:00:00'"
_STATE = "CASE o_custkey % 5 WHEN 1 THEN 'FAILED' WHEN 2 THEN 'NOT_RUN' WHEN 4 THEN 'SKIPPED' ELSE 'SUCCESS' END"
_LAYER = "CASE o_orderkey % 3 WHEN 0 THEN 'BRONZE' WHEN 1 THEN 'SILVER' ELSE 'GOLD' END"
SESSIONS = f"""
SELECT DISTINCT o_custkey % 20 AS id, o_custkey % 20 + 100 AS batch_id, 'insurance' AS pipeline_name, 'run-' || CAST(o_custkey % 20 AS STRING) AS pipeline_run_id,
       CASE WHEN o_custkey % 2 = 0 THEN 'NEW' ELSE 'RECOVERY' END AS run_mode, CASE WHEN o_custkey % 20 < 15 THEN 'SUCCESS' ELSE 'FAILED' END AS session_status,
       {_AT} AS session_started, {_AT} AS session_finished, 1000 * (o_custkey % 20) AS duration_ms, CASE WHEN o_custkey % 20 <> 4 THEN o_custkey % 20 = 3 END AS sla_breached
FROM orders WHERE o_custkey % 20 <> 19
UNION ALL SELECT 77, 177, 'insurance', 'run-77', 'NEW', 'RUNNING', {_AT}, CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN)"""
TABLES = f"""
SELECT DISTINCT o_custkey AS id, o_custkey % 20 AS session_id, o_custkey % 9 AS source_table_id, 'src-' || CAST(o_custkey % 9 AS STRING) AS source_table_name, {_STATE} AS table_session_status,
       CASE WHEN o_custkey % 17 = 0 THEN 'E17' END AS error_code, CASE WHEN o_custkey % 19 = 0 THEN 'broken' END AS error_message, {_STATE} AS bronze_status,
       CASE WHEN o_custkey % 4 = 0 THEN 'RUNNING' ELSE {_STATE} END AS silver_status, CASE WHEN o_custkey % 7 > 0 THEN {_STATE} END AS gold_status,
       {", ".join(f"{_AT} AS {x}_{y}_at" for x in ("bronze", "silver", "gold") for y in ("started", "ended"))}
FROM orders"""
DETAILS = f"""
SELECT o_orderkey AS detail_id, o_custkey AS table_session_id, {_LAYER} AS layer, o_orderkey % 4 AS attempt_no, o_orderdate AS created_at, {_STATE} AS detail_status,
       o_orderkey % 11 AS source_row_count, o_orderkey % 7 AS target_row_count, o_orderkey % 5 AS inserted_row, o_orderkey % 2 AS updated_row, CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS deleted_row,
       CASE WHEN o_orderkey % 31 = 0 THEN 2 END AS rejected_row, CASE WHEN o_orderkey % 13 = 0 THEN 'SYSTEM' END AS error_type, o_orderkey % 26 = 0 AS is_retryable,
       CASE WHEN o_orderkey % 13 = 0 THEN 'timeout' END AS error_message
FROM orders WHERE o_custkey % 10 <> 9"""
_FIGURES = ("source_row_count", "target_row_count", "inserted_row", "updated_row", "deleted_row", "rejected_row")
_LOG = f"""
s AS ({SESSIONS}), t AS ({TABLES}), a AS ({DETAILS}),
l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY table_session_id, layer ORDER BY attempt_no DESC, created_at DESC, detail_id) = 1),
m AS (
  SELECT s.id AS session_id, s.batch_id, s.pipeline_name, s.pipeline_run_id, s.run_mode, s.session_status, s.duration_ms AS pipeline_duration_ms, s.sla_breached AS pipeline_sla_breached,
         t.id AS table_session_id, t.source_table_id, t.source_table_name, t.table_session_status, t.error_code AS table_error_code, t.error_message AS table_error_message, l.layer,
         CASE l.layer WHEN 'BRONZE' THEN bronze_status WHEN 'SILVER' THEN silver_status WHEN 'GOLD' THEN gold_status ELSE table_session_status END AS layer_status,
         l.attempt_no, l.detail_status, {", ".join(f"l.{c}" for c in _FIGURES)}, l.error_type, l.is_retryable, l.error_message AS detail_error_message
  FROM s LEFT JOIN t ON s.id = t.session_id LEFT JOIN l ON t.id = l.table_session_id)""".replace("AS STRING", "AS VARCHAR")
_ODD = """coalesce(session_status = 'FAILED', false) OR coalesce(table_session_status = 'FAILED', false) OR coalesce(detail_status = 'FAILED', false) OR table_error_code IS NOT NULL
       OR table_error_message IS NOT NULL OR detail_error_message IS NOT NULL"""
_TIMES = ("session_started", "session_finished", "layer_started_at", "layer_ended_at", "detail_created_at")


def rows_of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(rows_of(spark, sf_dir, x) for x in (SESSIONS, TABLES, DETAILS))


@query(f"WITH {_LOG} SELECT * FROM m")
def mon_layer_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer_monitor(*log(spark, sf_dir)).drop(*_TIMES)


@query(f"""WITH {_LOG} SELECT session_id, batch_id, pipeline_name, pipeline_run_id, run_mode, session_status, pipeline_duration_ms, pipeline_sla_breached, count(DISTINCT table_session_id) AS table_session_count,
       count(*) FILTER (table_session_status = 'SUCCESS') AS success_table_count, count(*) FILTER (table_session_status = 'FAILED') AS failed_table_count,
       {", ".join(f"sum(coalesce({c}, 0))::BIGINT AS total_{c}" for c in _FIGURES)}, count(*) FILTER ({_ODD}) AS issue_count FROM m GROUP BY ALL""")
def mon_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_summary(layer_monitor(*log(spark, sf_dir))).drop(*_TIMES)


@query(f"WITH {_LOG} SELECT * FROM m WHERE {_ODD} OR coalesce(rejected_row, 0) > 0 OR coalesce(pipeline_sla_breached, false)")
def mon_investigation_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight conditions: run, table or layer failed, an error code or message, rejected rows, a run beyond its time."""
    return investigation_queue(layer_monitor(*log(spark, sf_dir))).drop(*_TIMES)


FILES = f"""
SELECT o_custkey % 25 AS session_id, o_custkey % 9 AS source_table_id, 'f' || CAST(o_orderkey AS STRING) AS source_file, {_STATE} AS file_status, o_orderkey % 100 AS file_row_count,
       o_orderkey % 90 AS processed_row_count, o_orderkey % 3 AS rejected_row_count, o_orderkey % 2 AS retry_count, CASE WHEN o_custkey % 5 = 1 THEN 'E1' END AS error_code,
       CASE WHEN o_custkey % 5 = 1 THEN 'bad file' END AS error_message, o_orderdate AS started_at, o_orderdate AS completed_at
FROM orders"""


@query(f"""WITH {_LOG}, f AS ({FILES.replace("AS STRING", "AS VARCHAR")}) SELECT s.batch_id, s.pipeline_name, s.pipeline_run_id, f.source_table_id, f.source_file, f.file_status, f.file_row_count, f.processed_row_count,
       f.rejected_row_count, f.retry_count, f.error_code, f.error_message FROM f LEFT JOIN s ON f.session_id = s.id""")
def mon_file_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of runs that the session log does not know stay in the list."""
    return file_sessions(rows_of(spark, sf_dir, FILES), log(spark, sf_dir)[0]).drop("started_at", "completed_at")


RETRIES = f"""
SELECT CAST(o_custkey AS STRING) AS table_session_id, CASE WHEN o_orderkey % 2 = 0 THEN 'f' || CAST(o_orderkey AS STRING) END AS file_session_id, {_LAYER} AS layer, o_orderkey % 4 AS attempt_no,
       'FAILED' AS status, 'LOAD_SYSTEM_ERROR' AS error_code, 'SYSTEM' AS error_type, TRUE AS is_retryable, 'timeout' AS error_message, o_orderdate AS started_at, o_orderdate AS ended_at
FROM orders WHERE o_orderkey % 13 = 0"""


@query(f"SELECT * EXCLUDE (started_at, ended_at) FROM ({RETRIES.replace('AS STRING', 'AS VARCHAR')})")
def mon_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retries(rows_of(spark, sf_dir, RETRIES)).drop("started_at", "ended_at")


INVALID = f"""
SELECT CAST(o_custkey AS STRING) AS table_session_id, CAST(NULL AS STRING) AS file_session_id, 'SILVER' AS layer, 'silver.quotation' AS target_table, CAST(o_orderkey AS STRING) AS record_key,
       'o_totalprice' AS error_column, 'premium must be greater than 0' AS error_reason, 'DQ_VALIDATION' AS error_type, FALSE AS is_retryable, o_orderdate AS created_at, 'x' AS raw_data
FROM orders WHERE o_orderkey % 31 = 0"""


@query(f"SELECT * EXCLUDE (created_at, raw_data) FROM ({INVALID.replace('AS STRING', 'AS VARCHAR')})")
def mon_invalid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_records(rows_of(spark, sf_dir, INVALID)).drop("created_at")


_WORDS = "CASE o_orderkey % 6 WHEN 0 THEN 'Table NOT FOUND: x' WHEN 1 THEN 'Batch column missing: _batch_id' WHEN 2 THEN 'Connection reset' WHEN 3 THEN 'Timeout' WHEN 4 THEN 'odd' END"


@query(f"""
WITH d AS (SELECT o_orderkey AS detail_id, o_orderkey % 7 AS source_row_count, {_WORDS} AS e FROM orders)
SELECT detail_id, CASE WHEN e IS NOT NULL OR source_row_count = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS detail_status,
       CASE WHEN e LIKE '%NOT FOUND%' THEN 'TABLE_NOT_FOUND' WHEN e LIKE 'Batch%' THEN 'BATCH_COLUMN_MISSING' WHEN e IN ('Timeout', 'Connection reset') THEN 'COUNT_SYSTEM_ERROR' WHEN e = 'odd' THEN 'COUNT_UNKNOWN_ERROR'
            WHEN source_row_count = 0 THEN 'RULE' END AS error_code,
       CASE WHEN e LIKE '%NOT FOUND%' OR e LIKE 'Batch%' THEN 'CONFIG' WHEN e IN ('Timeout', 'Connection reset') THEN 'SYSTEM' WHEN e = 'odd' THEN 'UNKNOWN' WHEN source_row_count = 0 THEN 'RULE' END AS error_type,
       CASE WHEN e IS NOT NULL THEN e IN ('Timeout', 'Connection reset') WHEN source_row_count = 0 THEN false END AS is_retryable,
       CASE WHEN e IS NOT NULL THEN e WHEN source_row_count = 0 THEN 'Source row count is zero' END AS error_message
FROM d
""")
def audit_row_count_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a failed row count's message means."""
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS detail_id", "o_orderkey % 7 AS source_row_count", f"{_WORDS} AS error_message")
    return captured_counts(d, fail_on_empty=True).drop("source_row_count")


POLICIES = """
SELECT o_custkey AS id, o_custkey % 7 = 3 AS is_active, o_custkey % 4 + 1 AS max_retry_count, 10 * (o_custkey % 3) AS retry_delay_seconds, CASE WHEN o_custkey % 2 = 0 THEN 'exponential' ELSE 'FIXED_DELAY' END AS backoff_strategy,
       ' timeout, CONNECTION ,,' AS retryable_error_types, 'RULE' AS non_retryable_error_types
FROM orders"""


@query(f"""
WITH p AS (SELECT * FROM ({POLICIES}) WHERE is_active ORDER BY id LIMIT 1), k AS (SELECT unnest(['TIMEOUT', 'CONNECTION', 'RULE', 'SYSTEM', 'UNKNOWN']) AS error_type), n AS (SELECT unnest([1, 2, 3]) AS attempt)
SELECT error_type, attempt, error_type IN ('TIMEOUT', 'CONNECTION', 'SYSTEM') AS retried, (retry_delay_seconds * CASE WHEN upper(backoff_strategy) = 'EXPONENTIAL' THEN 2 ** (attempt - 1) ELSE 1 END)::DOUBLE AS wait,
       max_retry_count::BIGINT AS max_retries FROM p, k, n
""")
def audit_retry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first active policy by id, and what it says of five error types."""
    policy = RetryPolicy.first_active(rows_of(spark, sf_dir, POLICIES))
    kinds = ("TIMEOUT", "CONNECTION", "RULE", "SYSTEM", "UNKNOWN")
    found = [(k, n, policy.retries(k), float(policy.wait(n)), policy.max_retries) for k in kinds for n in (1, 2, 3)]
    return spark.createDataFrame(found, "error_type string, attempt int, retried boolean, wait double, max_retries long")


@query(f"WITH {_LOG} SELECT session_id, count(*) AS tables, min(source_table_name) AS first_name FROM t WHERE session_id = 7 GROUP BY 1")
def audit_unique_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one session of a run's name; its tables."""
    sessions, tables, _ = log(spark, sf_dir)
    one = only(sessions, "id", pipeline_run_id="run-7")
    return tables.where(F.col("session_id") == one).groupBy("session_id").agg(F.count("*").alias("tables"), F.min("source_table_name").alias("first_name"))


@query(f"""WITH {_LOG}, n AS (SELECT table_session_id, layer, created_at, row_number() OVER (PARTITION BY table_session_id, layer ORDER BY created_at, detail_id) AS k FROM a WHERE detail_id % 2 = 1),
x AS (SELECT table_session_id, layer, max(attempt_no) AS top FROM a WHERE detail_id % 2 = 0 GROUP BY ALL)
SELECT table_session_id, layer, attempt_no FROM a WHERE detail_id % 2 = 0 UNION ALL SELECT n.table_session_id, n.layer, coalesce(top, 0) + k FROM n LEFT JOIN x ON n.table_session_id = x.table_session_id AND n.layer = x.layer""")
def audit_detail_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New layer details are numbered after those there are."""
    d = log(spark, sf_dir)[2].select("detail_id", "table_session_id", "layer", "attempt_no", "created_at")
    return append_details(d.where("detail_id % 2 = 0"), d.where("detail_id % 2 = 1").drop("attempt_no")).select("table_session_id", "layer", "attempt_no")


@query(f"""WITH {_LOG}, g AS (SELECT session_id AS run_id, count(*) FILTER (NOT coalesce(layer_status IN ('SUCCESS', 'SKIPPED'), false)) AS blocking, coalesce(sum(target_row_count), 0)::BIGINT AS target_rows FROM m WHERE layer = 'BRONZE' GROUP BY 1)
SELECT *, CASE WHEN blocking > 0 THEN 'RECOVERY' WHEN target_rows = 0 THEN 'NO_DATA' ELSE 'OPEN' END AS decision FROM g""")
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = layer_monitor(*log(spark, sf_dir)).select(F.col("session_id").alias("run_id"), "layer", F.col("layer_status").alias("status"), F.col("target_row_count").alias("target_rows"))
    return gate(m, "BRONZE")


@query(f"""WITH {_LOG}, b AS (SELECT DISTINCT source_table_id AS source_id, id % 50 AS target_id FROM t), x AS (SELECT id % 50 AS target_id, CASE WHEN id % 50 % 5 = 1 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM t GROUP BY ALL)
SELECT source_id, count(*) AS targets, CASE WHEN bool_and(status = 'SUCCESS') THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM b JOIN x USING (target_id) GROUP BY 1""")
def source_success_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tables, _ = log(spark, sf_dir)
    target = F.col("id") % 50
    bridge = tables.select(F.col("source_table_id").alias("source_id"), target.alias("target_id")).distinct()
    targets = tables.select(target.alias("target_id")).distinct().withColumn("status", F.when(F.col("target_id") % 5 == 1, "FAILED").otherwise("SUCCESS"))
    return source_success(bridge, targets)


@query(f"WITH {_LOG} SELECT detail_id, table_session_id, layer, attempt_no FROM l")
def mon_latest_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_attempts(log(spark, sf_dir)[2]).select("detail_id", "table_session_id", "layer", "attempt_no")


@query(f"WITH {_LOG} SELECT table_session_id, layer, max(attempt_no) + 1 AS attempt_no FROM a GROUP BY ALL")
def audit_next_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_attempt(log(spark, sf_dir)[2], ["table_session_id", "layer"])


@query(f"WITH {_LOG} SELECT detail_id, CASE WHEN detail_status = 'SUCCESS' THEN 'SKIPPED' ELSE 'NOT_RUN' END AS status FROM a")
def audit_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry_over(log(spark, sf_dir)[2].withColumnRenamed("detail_status", "status")).select("detail_id", "status")


_BEGAN = "TIMESTAMP '2024-01-01 00:00:00'"


@query(f"""
SELECT c_custkey AS run_id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 9 END::BIGINT AS batch_id, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 8 = 0 THEN 'SUCCESS' ELSE 'FAILED' END ELSE 'RUNNING' END AS status,
       CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 100) * 1000 END AS duration_ms, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 100) * 1000 <= 60000 END AS sla_met FROM customer
""")
def audit_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions are started once by run id, and finished with their duration."""
    c = table(spark, sf_dir, "customer")
    there = c.where("c_custkey % 3 = 0").selectExpr(
        "c_custkey AS run_id", "1L AS batch_id", "'NEW' AS run_mode", f"{_BEGAN} AS started_at", "'RUNNING' AS status", "CAST(NULL AS TIMESTAMP) AS ended_at", "CAST(NULL AS BIGINT) AS duration_ms", "CAST(NULL AS BOOLEAN) AS sla_met"
    )
    new = c.selectExpr("c_custkey AS run_id", "9L AS batch_id", "'NEW' AS run_mode", f"{_BEGAN} AS started_at")
    ended = c.where("c_custkey % 4 = 0").selectExpr("c_custkey AS run_id", "CASE WHEN c_custkey % 8 = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status", f"timestampadd(SECOND, c_custkey % 100, {_BEGAN}) AS ended_at")
    return finish_sessions(start_sessions(there, new), ended, 60_000).select("run_id", "batch_id", "status", "duration_ms", "sla_met")


@query("""
WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM orders WHERE o_orderkey % 3 <> 0),
s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'RUNNING' ELSE 'SUCCESS' END AS status FROM orders WHERE o_orderkey % 5 <> 0)
SELECT 'f' || coalesce(b.o_orderkey, s.o_orderkey) AS file_name, CASE WHEN b.status = 'SUCCESS' THEN b.status ELSE coalesce(s.status, b.status) END AS status FROM b FULL JOIN s ON b.o_orderkey = s.o_orderkey
""")
def audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished file is not touched again."""
    o, names = table(spark, sf_dir, "orders"), ("1 AS batch_id", "o_custkey AS source_id", "concat('f', o_orderkey) AS file_name")
    before = o.where("o_orderkey % 3 <> 0").selectExpr(*names, "CASE WHEN o_orderkey % 2 = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status")
    seen = o.where("o_orderkey % 5 <> 0").selectExpr(*names, "CASE WHEN o_orderkey % 7 = 0 THEN 'RUNNING' ELSE 'SUCCESS' END AS status")
    return record_files(before, seen).select("file_name", "status")


@query("""
WITH b AS (SELECT o_orderkey AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN 'FAILED' ELSE 'RUNNING' END AS status, o_orderkey % 4 + 1 AS attempt_no, 5::BIGINT AS target_rows FROM orders WHERE o_orderkey % 3 <> 0),
s AS (SELECT o_orderkey AS source_id, CASE WHEN o_orderkey % 5 = 0 THEN 'RUNNING' ELSE 'SUCCESS' END AS status, 1::BIGINT AS attempt_no, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 50 END AS target_rows FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(b.source_id, s.source_id) AS source_id, CASE WHEN s.status IS NOT NULL THEN s.status ELSE b.status END AS status,
       CASE WHEN b.source_id IS NULL THEN s.attempt_no WHEN s.status = 'RUNNING' THEN b.attempt_no + 1 ELSE b.attempt_no END AS attempt_no,
       CASE WHEN b.source_id IS NULL OR s.status = 'SUCCESS' THEN s.target_rows WHEN s.status = 'RUNNING' THEN NULL ELSE b.target_rows END AS target_rows
FROM b FULL JOIN s ON b.source_id = s.source_id
""")
def audit_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two clauses: one starts an attempt, one ends it."""
    o, names = table(spark, sf_dir, "orders"), ("'r' AS run_id", "o_orderkey AS source_id", "'GOLD' AS layer")
    before = o.where("o_orderkey % 3 <> 0").selectExpr(*names, "CASE WHEN o_orderkey % 2 = 0 THEN 'FAILED' ELSE 'RUNNING' END AS status", "o_orderkey % 4 + 1 AS attempt_no", "10L AS started_at", "11L AS ended_at", "5L AS target_rows")
    seen = o.where("o_orderkey % 7 <> 0").selectExpr(*names, "CASE WHEN o_orderkey % 5 = 0 THEN 'RUNNING' ELSE 'SUCCESS' END AS status", "1L AS attempt_no", "20L AS started_at", "30L AS ended_at", "CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 50 END AS target_rows")
    return record_layers(before, seen).select("source_id", "status", "attempt_no", "target_rows")


@query("""
SELECT 'C' || c_custkey AS cancellation_id, CASE c_custkey % 4 WHEN 0 THEN 'Vehicle Sold [' || c_mktsegment || ']' WHEN 1 THEN c_mktsegment WHEN 2 THEN 'a' || chr(8232) || 'b' END AS cancellation_reason FROM customer
""")
def dirty_json_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped files with a banner, as the feeds have them: customers by nation, a file each, read back."""
    from pyspark.sql.types import StringType, StructField, StructType

    c = table(spark, sf_dir, "customer")
    reason = "CASE c_custkey % 4 WHEN 0 THEN concat('Vehicle Sold [', c_mktsegment, ']') WHEN 1 THEN c_mktsegment WHEN 2 THEN concat('a', decode(unhex('E280A8'), 'UTF-8'), 'b') END"
    record = F.struct(F.expr("concat('C', c_custkey)").alias("cancellation_id"), F.expr(reason).alias("cancellation_reason"), F.col("c_acctbal").alias("extra"))
    files = c.groupBy("c_nationkey").agg(F.to_json(F.collect_list(record)).alias("body"))
    text = F.concat(F.lit("JSON_0001-BANNER\n"), F.regexp_replace("body", "(?s)(.{37})", "$1\n")).alias("value")
    path = f"{shared_dir(spark)}/stratal-feed-{uuid.uuid4().hex}"
    files.repartitionById(25, F.col("c_nationkey")).select(text).write.text(path)
    return dirty_json(spark, path, StructType([StructField("cancellation_id", StringType()), StructField("cancellation_reason", StringType())]))
