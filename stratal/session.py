"""Spark sessions as this engine wants them: UTC, ANSI arithmetic, adaptive execution."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str | None = None, name: str = "stratal", **more: str) -> SparkSession:
    """A session; ``more`` are settings with __ for dots (``spark__sql__shuffle__partitions="8"``)."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()


#: A frame of more rows is joined by sort and merge. Spark takes the size of files for that of rows, of which text that repeats is a hundredth, and
#: would send millions of rows through the driver to each executor.
BROADCAST_ROWS = 50_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many rows, joined as these ask for."""
    return df.hint("broadcast" if rows <= BROADCAST_ROWS else "merge")


#: Codec of the tables that are written: they take some two thirds of what Spark's default takes.
CODEC = "zstd"

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one if all threads are of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="stratal-")
    return _OWN[app]


#: Tables that were staged inside the innermost ``staging`` of this thread.
_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the shared folder and read back, so that what follows evaluates it no more. The table goes with the
    ``staging`` it was written in; without one the folder is the application's, and ``clear_staged`` deletes it."""
    path = f"{staging_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if (written := _STAGED.get()) is not None:
        written.append(path)
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stages inside are deleted at the end; what reads them must have been run by then."""
    token = _STAGED.set([])
    try:
        yield
    finally:
        written = _STAGED.get()
        _STAGED.reset(token)
        for path in written:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staging_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stratal-staged/{spark.sparkContext.applicationId}"


def clear_staged(spark: SparkSession) -> None:
    """Delete what ``staged`` has written in this application; results that read it end here."""
    _delete(spark, staging_dir(spark))
