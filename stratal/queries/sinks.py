"""Sources and sinks over the driver's tables: files written and read back, published tables, streams."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratal.functions.rules import Rule
from stratal.operators.checks import judge, reject_log_of
from stratal.operators.mapping import Mapping, to_bronze
from stratal.operators.merge import delete_where, overwrite_where
from stratal.queries import query
from stratal.queries.rules import rows
from stratal.queries.star import table
from stratal.session import shared_dir
from stratal.sources.readers import list_files, read_source
from stratal.sources.snapshots import SnapshotTable
from stratal.streaming.ingest import living, stream_upsert, windowed_counts


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stratal-{name}-{uuid.uuid4().hex}"


@query("SELECT r_regionkey, r_name FROM region")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of type table, by its name in the catalog."""
    name = f"stratal_region_{uuid.uuid4().hex[:8]}"
    table(spark, sf_dir, "region").createOrReplaceTempView(name)
    return read_source(spark, {"type": "table", "location": name}).select("r_regionkey", "r_name")


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source of type file and format csv: a header, and all columns text."""
    path = place(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(path)
    return read_source(spark, {"type": "file", "format": "csv", "location": path})


@query("SELECT 'n' || n_regionkey || '.json' AS file_name FROM nation GROUP BY n_regionkey")
def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the files in a folder, without its folders."""
    path = place(spark, "list")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_regionkey").distinct().collect()]
    for k in keys:
        fs.create(fs_path(f"{path}/n{k}.json")).close()
    fs.mkdirs(fs_path(f"{path}/folder"))
    return spark.createDataFrame([(f,) for f in list_files(spark, path)], "file_name string")


_BRONZE = Mapping.of({
    "source": "dbo.customer", "target": "bronze.customer",
    "columns": [{"name": "customer_id", "source": "c_custkey"}, {"name": "full_name", "source": "c_name"}, {"name": "district"}, {"name": "_batch_id"}, {"name": "_loaded_at"}, {"name": "_source_system"}, {"name": "_source_name"}, {"name": "_source_file"}],
})


@query("SELECT c_custkey AS customer_id, c_name AS full_name, NULL::VARCHAR AS district, '7' AS _batch_id, true AS loaded, 'CRM' AS _source_system, 'customer' AS _source_name, 'a.json' AS _source_file FROM customer")
def bronze_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source columns and lineage: the batch, the load time, the source and its file."""
    out = to_bronze(table(spark, sf_dir, "customer"), _BRONZE, 7, "CRM", "customer", "a.json")
    now = F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("_loaded_at")) < 86_400
    return out.select("customer_id", "full_name", "district", "_batch_id", now.alias("loaded"), "_source_system", "_source_name", "_source_file")


@query("SELECT o_orderstatus, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1")
def append_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published and appended to twice; each append writes its own rows only."""
    t, o = SnapshotTable(spark, place(spark, "append")), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for i in range(3):
        t.append(o.where(F.col("o_orderkey") % 3 == i))
    return t.read().groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 10 = 5")
def merge_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert of a published table, which rewrites only the buckets that it meets."""
    t, o = SnapshotTable(spark, place(spark, "merge")), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    t.merge(o.where("o_orderkey % 2 = 0"), ["o_orderkey"], buckets=8)
    t.merge(o.where("o_orderkey % 10 IN (0, 5)").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus"))), ["o_orderkey"])
    return t.read()


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 4 = 1 GROUP BY 1")
def overwrite_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full load replaces all rows, from a frame that reads the table itself; a truncated table is empty."""
    t, o = SnapshotTable(spark, place(spark, "overwrite")), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    t.publish(o)
    t.publish(t.read().where("o_orderkey % 4 = 1"))
    kept = t.version().number
    t.truncate()
    return t.read().unionByName(t.read(kept)).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'closed' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE NOT coalesce(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 3 = 0 END, false)")
def update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UPDATE ... SET ... WHERE and DELETE ... WHERE; rows for which a condition is null stay as they are."""
    o = table(spark, sf_dir, "orders")
    o = overwrite_where(o, F.col("o_orderstatus") == "P", {"o_orderpriority": F.lit("closed")})
    return delete_where(o, F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 3 = 0 END")).select("o_orderkey", "o_orderpriority")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, upserted into a published table by user."""
    schema = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if folder else "events.parquet")
    stream = source.parquet(f"{sf_dir}/events.parquet" if folder else sf_dir)  # a stream reads folders
    t, at = SnapshotTable(spark, place(spark, "stream")), place(spark, "progress")
    stream_upsert(stream, t, ["user_id"], "event_id", at).awaitTermination()
    return t.read()


@query("SELECT user_id, event_id, event_type FROM (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1) WHERE event_type <> 'error'")
def stream_by_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in micro-batches, newest files first: an older row never replaces a newer one, and a user whose last event is
    an error stays away though older events come later."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("event_type") == "error").alias("gone"))
    files, t = place(spark, "batches"), SnapshotTable(spark, place(spark, "versions"))
    for i in range(3):
        e.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i).orderBy(F.desc("event_id")).coalesce(1).write.mode("append").parquet(files)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(files)
    stream_upsert(stream, t, ["user_id"], "event_id", place(spark, "progress"), buckets=4).awaitTermination()
    return living(t, "gone").drop("gone")


@query("SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE)::VARCHAR AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-04-15'")
def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table appended year by year, read between two days: only parts whose bounds meet the days are opened."""
    t = SnapshotTable(spark, place(spark, "bounds"), bounded=("day",))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"))
    years = o.agg(F.min(F.year("day")).alias("a"), F.max(F.year("day")).alias("b")).first()
    for y in range(years["a"], years["b"] + 1):
        t.append(o.where(F.year("day") == y))
    assert len(t.fitting("day", date(1995, 3, 1), date(1995, 4, 15))) == 1
    return t.between("day", date(1995, 3, 1), date(1995, 4, 15)).withColumn("day", F.col("day").cast("string"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps that append under a token and are done twice, after some of their parts were merged with others, leave their rows once."""
    t, o = SnapshotTable(spark, place(spark, "tokens")), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for step in (0, 1, 2, 1, 3, 0, 3):
        t.append(o.where(F.col("o_orderkey") % 4 == step), f"step {step}")
    return t.read().groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type; over a stream the same plan leaves out rows later than the watermark."""
    out = windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour", "2 hours")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


@query("SELECT count(*) AS valid, 0::BIGINT AS rejected FROM events")
def dq_no_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without rules every row is valid."""
    j = judge(table(spark, sf_dir, "events"), [])
    return j.valid.agg(F.count("*").alias("valid")).crossJoin(F.broadcast(j.rejected.agg(F.count("*").alias("rejected"))))  # one row each


@query("SELECT event_id::VARCHAR AS record_id, event_type AS in_record, user_id AS user_in_record, 'negative or small' AS reason FROM events WHERE value < 10")
def dq_reject_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logged record is the whole row, as JSON."""
    log = reject_log_of(table(spark, sf_dir, "events"), [Rule("min_value", "value", "negative or small", {"limit": 10})], F.lit(1), "silver.event", "event_id")
    return log.select("record_id", F.get_json_object("record", "$.event_type").alias("in_record"), F.get_json_object("record", "$.user_id").cast("long").alias("user_in_record"), "reason")


_TYPES = ("int", "long", "double", "float", "boolean", "string")
_DUCK = {"int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "string": "VARCHAR"}
_TEXT = "CASE l_partkey % 6 WHEN 0 THEN '9999999999' WHEN 1 THEN '12' WHEN 2 THEN 'true' WHEN 3 THEN '1.5e3' WHEN 4 THEN 'abc' END"


@query(f"WITH r AS (SELECT {_TEXT} AS t FROM lineitem) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER (t IS NOT NULL AND {'TRY_CAST(t AS ' + _DUCK[k] + ') IS NULL' if k not in ('int', 'long', 'boolean') else dict(int='t IN (' + repr('9999999999') + ', ' + repr('true') + ', ' + repr('1.5e3') + ', ' + repr('abc') + ')', long='t IN (' + repr('true') + ', ' + repr('1.5e3') + ', ' + repr('abc') + ')', boolean='t <> ' + repr('true'))[k]}) AS violations FROM r" for k in _TYPES))
def dq_data_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that is not of a type, type by type."""
    r = table(spark, sf_dir, "lineitem").select(F.expr(_TEXT).alias("t"))
    sums = r.agg(*(F.count_if(Rule("data_type", "t", "x", {"kind": k}).violated(r)).alias(k) for k in _TYPES))
    return sums.select(F.expr(f"stack({len(_TYPES)}, {', '.join(f'{chr(39)}{k}{chr(39)}, {k}' for k in _TYPES)}) AS (kind, violations)"))


@query("SELECT o_orderkey, printf('%08d', o_orderkey) AS padded, split_part(o_orderpriority, '-', 2) AS second, 36 AS uuid_length, upper(o_orderstatus) || '|' || lower(o_orderpriority) AS joined FROM orders")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatting, splitting, joining, and identifiers of 36 signs."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.format_string("%08d", "o_orderkey").alias("padded"), F.split("o_orderpriority", "-")[1].alias("second"), F.length(F.expr("uuid()")).alias("uuid_length"),
        F.concat_ws("|", F.upper("o_orderstatus"), F.lower("o_orderpriority")).alias("joined"),
    )
