"""Monitoring views over the audit tables: sessions, table sessions, layer details, files, retries, invalid records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratal.plans.audit import latest_attempts

#: The columns of the run summary's key, and the layers with their states in a table session.
SUMMARY_KEYS = (
    "session_id", "batch_id", "pipeline_name", "pipeline_run_id", "run_mode", "session_status", "session_started", "session_finished", "pipeline_duration_ms", "pipeline_sla_breached",
)
LAYERS = ("BRONZE", "SILVER", "GOLD")
#: Figures of a layer detail.
FIGURES = ("source_row_count", "target_row_count", "inserted_row", "updated_row", "deleted_row", "rejected_row")


def layer_monitor(sessions: DataFrame, tables: DataFrame, details: DataFrame) -> DataFrame:
    """A row for each table and layer of a run with the layer's latest attempt; runs without tables, and tables
    without details, have one row too."""
    last = latest_attempts(details).select(
        F.col("table_session_id").alias("_t"), "layer", "attempt_no", "detail_status", *FIGURES, "error_type", "is_retryable", F.col("error_message").alias("detail_error_message"), F.col("created_at").alias("detail_created_at")
    )
    s = sessions.select(
        F.col("id").alias("session_id"), "batch_id", "pipeline_name", "pipeline_run_id", "run_mode", "session_status", "session_started", "session_finished",
        F.col("duration_ms").alias("pipeline_duration_ms"), F.col("sla_breached").alias("pipeline_sla_breached"),
    )
    t = tables.select(
        F.col("id").alias("table_session_id"), F.col("session_id").alias("_s"), "source_table_id", "source_table_name", "table_session_status", F.col("error_code").alias("table_error_code"),
        F.col("error_message").alias("table_error_message"), *(f"{x.lower()}_{c}" for x in LAYERS for c in ("status", "started_at", "ended_at")),
    )
    both = s.join(t, F.col("session_id") == F.col("_s"), "left").join(last, F.col("table_session_id") == F.col("_t"), "left")

    def by_layer(column: str, otherwise: Column | None = None) -> Column:
        out = F.lit(None) if otherwise is None else otherwise
        for x in LAYERS:
            out = F.when(F.col("layer") == x, F.col(f"{x.lower()}_{column}")).otherwise(out)
        return out

    own = [c for c in t.columns if c != "_s" and not any(c.startswith(f"{x.lower()}_") for x in LAYERS)]
    shown = [by_layer("status", F.col("table_session_status")).alias("layer_status"), by_layer("started_at").alias("layer_started_at"), by_layer("ended_at").alias("layer_ended_at")]
    return both.select(*s.columns, *own, "layer", *shown, *(c for c in last.columns if c not in ("_t", "layer")))


def run_summary(monitor: DataFrame) -> DataFrame:
    """Figures of a run over the rows of its layers: a table counts as succeeded or failed once for each of them."""
    is_ = lambda s: F.count_if(F.coalesce(F.col("table_session_status") == s, F.lit(False)))
    return monitor.groupBy(*SUMMARY_KEYS).agg(
        F.count_distinct("table_session_id").alias("table_session_count"), is_("SUCCESS").alias("success_table_count"), is_("FAILED").alias("failed_table_count"),
        *(F.sum(F.coalesce(c, F.lit(0))).alias(f"total_{c}") for c in FIGURES), F.count_if(failed()).alias("issue_count"),
    )


def failed() -> Column:
    """Something failed in the row's run, table or layer, or left an error."""
    states = F.coalesce((F.col("session_status") == "FAILED") | (F.col("table_session_status") == "FAILED") | (F.col("detail_status") == "FAILED"), F.lit(False))
    return states | F.col("table_error_code").isNotNull() | F.col("table_error_message").isNotNull() | F.col("detail_error_message").isNotNull()


def investigation_queue(monitor: DataFrame) -> DataFrame:
    """Rows of the monitor that someone should look at: failures, errors, rejected rows, runs beyond the agreed time."""
    return monitor.where(failed() | (F.coalesce("rejected_row", F.lit(0)) > 0) | F.coalesce("pipeline_sla_breached", F.lit(False)))


def file_sessions(files: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every file state with its run, the last started first."""
    s = sessions.select(F.col("id").alias("_s"), "batch_id", "pipeline_name", "pipeline_run_id")
    out = files.drop("batch_id").join(s, F.col("session_id") == F.col("_s"), "left")
    shown = (
        "batch_id", "pipeline_name", "pipeline_run_id", "source_table_id", "source_file", "file_status", "file_row_count", "processed_row_count", "rejected_row_count", "retry_count",
        "error_code", "error_message", "started_at", "completed_at",
    )
    return out.select(*shown).orderBy(F.desc("started_at"))


def retries(log: DataFrame) -> DataFrame:
    """Every logged attempt, the last first."""
    shown = ("table_session_id", "file_session_id", "layer", "attempt_no", "status", "error_code", "error_type", "is_retryable", "error_message", "started_at", "ended_at")
    return log.select(*shown).orderBy(F.desc("started_at"))


def invalid_records(log: DataFrame) -> DataFrame:
    """Every rejected record with its reason, the last first."""
    shown = ("table_session_id", "file_session_id", "layer", "target_table", "record_key", "error_column", "error_reason", "error_type", "is_retryable", "created_at")
    return log.select(*shown).orderBy(F.desc("created_at"))


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count of each frame."""
    out = None
    for name, df in sorted(frames.items()):
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


#: What the words of a failed count mean: error code, error type and whether it is worth a retry.
COUNT_ERRORS = (
    (("table not found", "not found"), ("TABLE_NOT_FOUND", "CONFIG", False)),
    (("batch column missing",), ("BATCH_COLUMN_MISSING", "CONFIG", False)),
    (("permission", "connection", "timeout"), ("COUNT_SYSTEM_ERROR", "SYSTEM", True)),
    ((), ("COUNT_UNKNOWN_ERROR", "UNKNOWN", False)),
)


def count_error(message: Column) -> Column:
    """struct(error_code, error_type, is_retryable) of a count's error message; the first kind whose words occur."""
    out, words = None, F.lower(F.coalesce(message, F.lit("")))
    for marks, (code, kind, again) in reversed(COUNT_ERRORS):
        value = F.struct(F.lit(code).alias("error_code"), F.lit(kind).alias("error_type"), F.lit(again).alias("is_retryable"))
        hit = F.lit(False)
        for m in marks:
            hit = hit | words.contains(m)
        out = value if out is None else F.when(hit, value).otherwise(out)
    return out


def captured_counts(details: DataFrame, fail_on_empty: bool = False) -> DataFrame:
    """Layer details (error_message null where the count was made) with the status, code and type that follow:
    a count that failed, or a source without rows where that counts as one, is FAILED."""
    e = count_error(F.col("error_message"))
    empty = F.lit(fail_on_empty) & F.coalesce(F.col("source_row_count") == 0, F.lit(False))
    broken = F.col("error_message").isNotNull()
    return details.withColumns({
        "detail_status": F.when(broken | empty, "FAILED").otherwise("SUCCESS"),
        "error_code": F.when(broken, e["error_code"]).when(empty, "RULE"),
        "error_type": F.when(broken, e["error_type"]).when(empty, "RULE"),
        "is_retryable": F.when(broken, e["is_retryable"]).when(empty, F.lit(False)),
        "error_message": F.when(broken, F.col("error_message")).when(empty, "Source row count is zero"),
    })
