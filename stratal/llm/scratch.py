"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Paths of the tables that were written inside the innermost ``temporary`` of this thread, in order.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one if all threads are of this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="stratal-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/stratal/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return path


def materialize(df: DataFrame, name: str, folders: list[str] | None = None, compact: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there,
    and a lost executor costs only the tasks that were running on it. ``folders``: columns to part the files by. ``compact``:
    files of the advisory partition size rather than as many as there are cores, for tables that little work makes."""
    path = new_path(df.sparkSession, name)
    write(df, path, folders, compact)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the table that ``materialize`` returned as ``df``; nothing may read it any more."""
    if df is not None:
        drop_path(df.sparkSession, df.scratch_path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that this thread writes inside go at the end, also after an error, but for those put into the list; what is lazy must have been
    run by then. An outer ``temporary`` has those that stay."""
    kept: list[DataFrame] = []
    token = _WRITTEN.set([])
    try:
        yield kept
    except BaseException:
        kept.clear()
        raise
    finally:
        written, keep = _WRITTEN.get(), {df.scratch_path for df in kept}
        _WRITTEN.reset(token)
        for path in written:
            if path not in keep:
                drop_path(spark, path)
        if (outer := _WRITTEN.get()) is not None:
            outer += keep


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """SQL settings for what is run inside; those before come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(df: DataFrame, path: str, folders: list[str] | None = None, compact: bool = False) -> None:
    """Write Parquet; the shuffle files of this one query go as soon as it has ended."""
    few = {"spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"} if compact else {}
    with settings(df.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **few}):
        df.write.partitionBy(*folders or ()).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results that read them end here."""
    drop_path(spark, f"{shared_dir(spark)}/stratal/{spark.sparkContext.applicationId}")
