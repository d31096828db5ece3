"""Batches of the insurance platform from its sources: files that no batch has loaded, and rows changed since the last one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from stratal.plans.audit import DONE
from stratal.plans.insurance import Platform
from stratal.sources.readers import change_time, list_files, new_files, next_watermark, read_file, read_source, recovery_files, since

FILE_LOG = "batch_id long, source_id string, file_name string, status string, row_count long, started_at timestamp, completed_at timestamp, error_message string"
FILE_KEYS = ["batch_id", "source_id", "file_name"]


@dataclass(frozen=True)
class Source:
    """Where a feed comes from: a folder of files (``format``), or a table. Of a table with ``changed`` (a time, and one that stands
    in for it where it is null) only what has changed since the last batch is loaded."""

    feed: str
    location: str
    format: str | None = None
    schema: StructType | None = None
    changed: tuple[str, str] | None = None


@dataclass
class Intake:
    """The platform's loads from ``sources``. ``audit/file`` has the state of each file, ``audit/watermark`` how far a table was read.

    A table is read up to the latest change there is when the batch begins, and the mark moves there once the feed has
    succeeded; a file counts as loaded then. So what a failed batch has read is read again in RECOVERY.
    """

    platform: Platform
    sources: tuple[Source, ...]

    def load(self, batch_id: int | None = None, mode: str = "NEW", **how: object) -> dict[str, dict[str, int]]:
        """A batch of everything new; ``how`` as ``Platform.load``. A feed without anything new is not part of it."""
        batch = self.platform.next_batch(mode, batch_id)
        bronze: dict[str, DataFrame | Callable[[], DataFrame]] = {}
        files: dict[str, list[str]] = {}
        marks: dict[str, str] = {}
        for s in self.sources:
            if s.format:
                files[s.feed] = self._files(s, batch, mode)
                if files[s.feed]:
                    bronze[s.feed] = partial(self._read, s, files[s.feed])  # a file that cannot be read is its feed's failure
            else:
                rows = read_source(self.platform.spark, {"type": "table", "location": s.location})
                if s.changed:
                    rows, marks[s.feed] = self._changed(s, rows)
                if rows.take(1):
                    bronze[s.feed] = rows
        began = datetime.now()
        self._state(batch, {f: (n, "RUNNING", None) for f, n in files.items() if n}, began)
        try:
            return self.platform.load(bronze, batch, mode=mode, **how)
        finally:
            ended = {x["source"]: x for x in self.platform.layers if x["layer"] == "SILVER"}
            states = {f: (n, "SUCCESS" if ended.get(f, {}).get("status") in DONE else "FAILED", ended.get(f, {}).get("error_message")) for f, n in files.items() if n}
            self._state(batch, states, began)
            done = [(f, m) for f, m in marks.items() if m is not None and (f not in bronze or ended.get(f, {}).get("status") in DONE)]
            if done:
                self.platform.table("audit", "watermark").merge(self.platform.spark.createDataFrame(done, "source_id string, watermark string"), ["source_id"])

    def _log(self, name: str, schema: str) -> DataFrame:
        table = self.platform.table("audit", name)
        return table.read() if table.exists() else self.platform.spark.createDataFrame([], schema)

    def _files(self, s: Source, batch: int, mode: str) -> list[str]:
        """Names of the files to load, as the listing has them."""
        spark, log = self.platform.spark, self._log("file", FILE_LOG).where(F.col("source_id") == s.feed)
        if mode == "RECOVERY":
            chosen = recovery_files(log, batch)
        else:
            chosen = new_files(spark.createDataFrame([(s.feed, n) for n in list_files(spark, s.location)], "source_id string, file_name string"), log)
        return sorted(r["file_name"] for r in chosen.select("file_name").collect())

    def _read(self, s: Source, names: list[str]) -> DataFrame:
        out = None
        for n in names:
            one = read_file(self.platform.spark, f"{s.location}/{n}", s.format, s.schema)
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def _changed(self, s: Source, rows: DataFrame) -> tuple[DataFrame, str | None]:
        """Rows after the mark, and the mark that they reach."""
        stored = self._log("watermark", "source_id string, watermark string").where(F.col("source_id") == s.feed).first()
        before = stored["watermark"] if stored else None
        timed = rows.withColumn("_changed", change_time(*s.changed).try_cast("timestamp"))
        upto = next_watermark(timed, "_changed", before)
        new = since(timed, "_changed", before)
        return (new if upto is None else new.where(F.col("_changed") <= F.lit(upto).cast("timestamp"))).drop("_changed"), upto

    def _state(self, batch: int, states: dict[str, tuple[list[str], str, str | None]], began: datetime) -> None:
        ended = None if all(s == "RUNNING" for _, s, _ in states.values()) else datetime.now()
        rows = [(batch, f, n, status, None, began, ended, why) for f, (names, status, why) in states.items() for n in names]
        if rows:
            self.platform.table("audit", "file").merge(self.platform.spark.createDataFrame(rows, FILE_LOG), FILE_KEYS)


def monitored(p: Platform, pipeline: str = "insurance") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The platform's audit as the monitoring views read it: sessions, table sessions (a feed, dimension or fact in a run) and layer details."""
    sessions = p.table("audit", "session").read().select(
        F.col("run_id").alias("id"), "batch_id", F.lit(pipeline).alias("pipeline_name"), F.col("run_id").alias("pipeline_run_id"), "run_mode", F.col("status").alias("session_status"),
        F.col("started_at").alias("session_started"), F.col("ended_at").alias("session_finished"), "duration_ms", (~F.col("sla_met")).alias("sla_breached"),
    )
    layers = p.table("audit", "layer").read().withColumn("t", F.concat_ws("/", "run_id", "source"))
    layers = layers.withColumn("layer", F.when(F.col("layer") == "REKEY", "GOLD").otherwise(F.col("layer")))
    rank = F.max_by("status", F.struct(F.col("status").isin("FAILED"), F.col("started_at")))  # a failure in any step is the table's
    state = lambda x: F.max_by(F.when(F.col("layer") == x, F.col("status")), F.when(F.col("layer") == x, F.col("started_at")))
    edge = lambda x, f, c: f(F.when(F.col("layer") == x, F.col(c)))
    tables = layers.groupBy(F.col("t").alias("id"), F.col("run_id").alias("session_id"), F.col("source").alias("source_table_name")).agg(
        F.min("source").alias("source_table_id"), rank.alias("table_session_status"), F.max("error_type").alias("error_code"), F.max("error_message").alias("error_message"),
        *(c for x in ("BRONZE", "SILVER", "GOLD") for c in (state(x).alias(f"{x.lower()}_status"), edge(x, F.min, "started_at").alias(f"{x.lower()}_started_at"), edge(x, F.max, "ended_at").alias(f"{x.lower()}_ended_at"))),
    )
    details = layers.select(
        F.concat_ws("/", "t", "layer", F.col("started_at").cast("string")).alias("detail_id"), F.col("t").alias("table_session_id"), "layer", F.coalesce("attempts", F.lit(0)).alias("attempt_no"), F.col("started_at").alias("created_at"),
        F.col("status").alias("detail_status"), F.col("source_rows").alias("source_row_count"), F.col("target_rows").alias("target_row_count"), F.col("inserted").alias("inserted_row"), F.col("updated").alias("updated_row"),
        F.lit(None).cast("long").alias("deleted_row"), F.col("rejected").alias("rejected_row"), "error_type", F.col("error_type").isin(*p.policy.retryable).alias("is_retryable"), "error_message",
    )
    return sessions, tables, details
