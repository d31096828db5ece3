"""Batch readers and the choice of what to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType, TimestampType

#: A dirty JSON file is one value on one executor, so larger ones are refused.
MAX_JSON_BYTES = 50 * 1024 * 1024


def dirty_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Records of files that hold one JSON array among other text, wrapped at any place, inside values too.

    Line breaks go, then all before the first [ and after the last ]. A file without an array, or
    beyond MAX_JSON_BYTES, is an error. Fields missing in a record are null, others are dropped.
    """
    files = spark.read.text(path, wholetext=True).select(F.translate("value", "\r\n", "").alias("raw"), F.col("_metadata.file_path").alias("file"))
    first, last = F.instr("raw", "["), F.length("raw") - F.instr(F.reverse("raw"), "]") + 1
    body = F.when((first > 0) & F.contains("raw", F.lit("]")) & (last > first), F.substring("raw", first, last - first + 1)).otherwise("")
    fault = F.when(F.octet_length("raw") > MAX_JSON_BYTES, F.raise_error(F.concat(F.lit("file too large: "), "file"))).when(
        body == "", F.raise_error(F.concat(F.lit("no JSON array in "), "file"))
    )
    checked = files.select(F.coalesce(fault.cast("string"), body).alias("body"))
    kind = f"array<{schema.simpleString()}>"
    return checked.select(F.inline(F.from_json("body", kind, {"mode": "FAILFAST"})))


def read_file(spark: SparkSession, path: str, kind: str, schema: StructType | None = None) -> DataFrame:
    """csv (header, all strings), parquet, or json as ``dirty_json``; other kinds are a ValueError."""
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json" and schema is not None:
        return dirty_json(spark, path, schema)
    raise ValueError(f"unsupported file format {kind!r}")


def read_source(spark: SparkSession, source: dict) -> DataFrame:
    """By ``type``: table (``location``) or file (``location``, ``format``, ``schema``)."""
    if source["type"] == "table":
        return spark.read.table(source["location"])
    if source["type"] == "file":
        return read_file(spark, source["location"], source["format"], source.get("schema"))
    raise ValueError(f"unsupported source type {source['type']!r}")


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, sorted, on any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if not s.isDirectory())


def lookup_sources(sources: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Active sources in load order, each with its watermark if it has one."""
    w = watermarks.select(F.col("source_id").alias("_id"), "watermark")
    return sources.where("is_active").join(w, sources["source_id"] == w["_id"], "left").drop("_id").orderBy("load_sequence")


def recovery_sources(sources: DataFrame, last_run: DataFrame) -> DataFrame:
    """Active sources whose last run left them FAILED or NOT_RUN, in load order."""
    again = last_run.where(F.col("status").isin("FAILED", "NOT_RUN")).select("source_id")
    return sources.where("is_active").join(again, "source_id", "left_semi").orderBy("load_sequence")


def new_files(listed: DataFrame, log: DataFrame) -> DataFrame:
    """Files that no run has loaded: ``listed`` (source_id, file_name) without those ever SUCCESS in ``log``."""
    return listed.join(log.where("status = 'SUCCESS'"), ["source_id", "file_name"], "left_anti")


def recovery_files(log: DataFrame, batch_id: int) -> DataFrame:
    """Files of a batch that did not finish."""
    unfinished = F.col("status").isin("FAILED", "RUNNING", "NOT_RUN")
    return log.where((F.col("batch_id") == batch_id) & unfinished).select("source_id", "file_name").distinct()


def file_states(listed: DataFrame, log: DataFrame) -> DataFrame:
    """Listed files that are not loaded, each MISSING from the log or with its status there."""
    found = listed.join(log.select("source_id", "file_name", "status"), ["source_id", "file_name"], "left")
    return found.withColumn("status", F.coalesce("status", F.lit("MISSING"))).where("status <> 'SUCCESS'")


def since(df: DataFrame, column: str | None, watermark: str | None, incremental: bool = True) -> DataFrame:
    """Rows after the watermark, which itself and nulls are left out; all rows for a full load or without one."""
    if not incremental:
        return df
    if not column or column not in df.columns:
        raise ValueError("an incremental load needs a watermark column")
    if watermark is None:
        return df
    kind = df.schema[column].dataType
    value = F.col(column) if isinstance(kind, TimestampType) else F.col(column).try_cast("timestamp")
    return df.where(value > F.lit(watermark).cast("timestamp"))


def change_time(updated: str, created: str):
    """When a row last changed: rows never updated have their creation time."""
    return F.coalesce(F.col(updated), F.col(created))


def next_watermark(df: DataFrame, column: str, before: str | None) -> str | None:
    """The greatest time loaded; the old one if there were no rows; an error if all times are null."""
    n, top = df.agg(F.count("*"), F.max(F.col(column).try_cast("timestamp")).cast("string")).first()
    if n and top is None:
        raise ValueError(f"{column} is null in all rows")
    return top if n else before


def batch_of(df: DataFrame, batch_id: int | str, full: bool = False) -> DataFrame:
    return df if full else df.where(F.col("_batch_id") == F.lit(str(batch_id)))
