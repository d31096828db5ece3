"""Audit state of runs as tables, and the decisions taken from it."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.window import Window

from stratal.operators.merge import CardinalityError, Clause, Merge

DONE = ("SUCCESS", "SKIPPED")
STATUSES = ("RUNNING", "SUCCESS", "FAILED", "SKIPPED", "NOT_RUN")


def duration_ms(start: Column, end: Column) -> Column:
    return ((F.unix_timestamp(end) - F.unix_timestamp(start)) * 1000).cast("long")


def start_sessions(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions of ``new`` (run_id, batch_id, run_mode, started_at) added; a run id that is there stays as it is."""
    rows = new.withColumn("status", F.lit("RUNNING"))
    return Merge(["run_id"], matched=[]).apply(sessions, rows).drop("_action")


def finish_sessions(sessions: DataFrame, ended: DataFrame, sla_ms: int) -> DataFrame:
    """Status, end, duration and whether the agreed time was kept, for the run ids of ``ended`` (run_id, status, ended_at)."""
    took = "(unix_timestamp(s.ended_at) - unix_timestamp(t.started_at)) * 1000"
    values = {"status": "s.status", "ended_at": "s.ended_at", "duration_ms": took, "sla_met": f"{took} <= {sla_ms}"}
    return Merge(["run_id"], [Clause(set=values)], insert=False).apply(sessions, ended).drop("_action")


def record_files(log: DataFrame, seen: DataFrame) -> DataFrame:
    """File states by (batch_id, source_id, file_name); what is SUCCESS stays."""
    return Merge(["batch_id", "source_id", "file_name"], [Clause("t.status <> 'SUCCESS'")]).apply(log, seen).drop("_action")


def record_layers(log: DataFrame, seen: DataFrame) -> DataFrame:
    """Layer states: a RUNNING report starts an attempt, any other ends the one that runs."""
    start = Clause("s.status = 'RUNNING'", {"status": "'RUNNING'", "attempt_no": "t.attempt_no + 1", "started_at": "s.started_at", "ended_at": "NULL", "target_rows": "NULL"})
    end = Clause("s.status <> 'RUNNING'", {"status": "s.status", "ended_at": "s.ended_at", "target_rows": "s.target_rows"})
    return Merge(["run_id", "source_id", "layer"], [start, end]).apply(log, seen).drop("_action")


def carry_over(last: DataFrame) -> DataFrame:
    """States that a recovery run starts from: what succeeded is skipped, the rest is still to be run."""
    return last.withColumn("status", F.when(F.col("status") == "SUCCESS", "SKIPPED").otherwise("NOT_RUN"))


def next_attempt(details: DataFrame, keys: list[str]) -> DataFrame:
    return details.groupBy(*keys).agg((F.coalesce(F.max("attempt_no"), F.lit(0)) + 1).alias("attempt_no"))


def append_details(details: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (no attempt_no) added; each gets the number after its table's and layer's greatest. Several new rows
    of one are numbered in order of ``created_at``."""
    keys = ["table_session_id", "layer"]
    last = details.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.max("attempt_no").alias("_last"))
    cond = [F.col(k) == F.col(f"_{k}") for k in keys]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("created_at"))
    numbered = new.withColumn("_rank", rank).join(last, cond, "left").withColumn("attempt_no", F.coalesce("_last", F.lit(0)) + F.col("_rank"))
    return details.unionByName(numbered.select(*(F.col(c).cast(t).alias(c) for c, t in details.dtypes)))


def only(df: DataFrame, column: str, **filters: object) -> object:
    """``column`` of the one row that the filters leave; none or several are an error."""
    for name, value in filters.items():
        df = df.where(F.col(name) == F.lit(value))
    rows = df.select(column).limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{'several rows' if rows else 'no row'} for {filters}")
    return rows[0][0]


@dataclass(frozen=True)
class RunContext:
    mode: str
    batch_id: int


def run_context(sessions: DataFrame, mode: str, stored_batch: int | None = None) -> RunContext:
    """NEW: the greatest batch and one; RECOVERY: the stored one, which must be there."""
    if mode == "NEW":
        return RunContext(mode, sessions.agg(F.coalesce(F.max("batch_id"), F.lit(0))).first()[0] + 1)
    if mode != "RECOVERY":
        raise ValueError(f"unknown run mode {mode!r}")
    if stored_batch is None:
        raise ValueError("a recovery run needs the batch that failed")
    return RunContext(mode, stored_batch)


def gate(layers: DataFrame, layer: str) -> DataFrame:
    """By run: whether the next layer may start. A null status is not done; no rows at all is NO_DATA."""
    done = F.coalesce(F.col("status").isin(*DONE), F.lit(False))
    sums = layers.where(F.col("layer") == layer).groupBy("run_id").agg(
        F.count_if(~done).alias("blocking"), F.coalesce(F.sum("target_rows"), F.lit(0)).alias("target_rows")
    )
    decision = F.when(F.col("blocking") > 0, "RECOVERY").when(F.col("target_rows") == 0, "NO_DATA").otherwise("OPEN")
    return sums.withColumn("decision", decision)


class GateClosed(RuntimeError):
    """Tables of a layer are not done; the next run must be a recovery."""


def pass_gate(layers: DataFrame, layer: str, run_id: str) -> bool:
    """Whether the next layer may start. Tables that are neither SUCCESS nor SKIPPED raise ``GateClosed``; a layer that
    is done but has brought no rows, or has no tables, gives False."""
    row = gate(layers.where(F.col("run_id") == run_id), layer).first()
    if row is None:
        return False
    if row["decision"] == "RECOVERY":
        raise GateClosed(f"{layer} gate: {row['blocking']} table(s) are not SUCCESS or SKIPPED")
    return row["decision"] == "OPEN"


def source_success(bridge: DataFrame, targets: DataFrame) -> DataFrame:
    """A source has succeeded if it feeds a target and all targets it feeds have succeeded."""
    t = targets.select(F.col("target_id").alias("_t"), "status")
    joined = bridge.join(t, bridge["target_id"] == t["_t"], "left")
    ok = F.bool_and(F.coalesce(F.col("status") == "SUCCESS", F.lit(False)))
    return joined.groupBy("source_id").agg(ok.alias("all_done"), F.count("target_id").alias("targets")).select(
        "source_id", "targets", F.when(F.col("all_done") & (F.col("targets") > 0), "SUCCESS").otherwise("FAILED").alias("status")
    )


def latest_attempts(details: DataFrame) -> DataFrame:
    order = Window.partitionBy("table_session_id", "layer").orderBy(F.desc("attempt_no"), F.desc("created_at"), "detail_id")
    return details.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def type_list(text: str | None) -> tuple[str, ...]:
    """Comma-separated error types, trimmed, in capitals."""
    return tuple(x.strip().upper() for x in (text or "").split(",") if x.strip())


@dataclass(frozen=True)
class RetryPolicy:
    """Which faults are tried again, how often and after how long. Types in neither list are tried again if they are SYSTEM."""

    max_retries: int = 3
    base_seconds: float = 5.0
    exponential: bool = True
    retryable: tuple[str, ...] = ("TIMEOUT", "CONNECTION", "THROTTLED")
    final: tuple[str, ...] = ("DQ_VALIDATION", "SCHEMA", "CONFIG", "PROGRAM")

    @classmethod
    def first_active(cls, policies: DataFrame) -> RetryPolicy:
        """The active row of least id in a table of policies; an error if there is none."""
        row = policies.where("is_active").orderBy("id").first()
        if row is None:
            raise LookupError("no active retry policy")
        return cls(
            int(row["max_retry_count"]), float(row["retry_delay_seconds"]), str(row["backoff_strategy"]).upper() == "EXPONENTIAL",
            type_list(row["retryable_error_types"]), type_list(row["non_retryable_error_types"]),
        )

    def retries(self, error_type: str) -> bool:
        return error_type in self.retryable or (error_type not in self.final and error_type == "SYSTEM")

    def wait(self, attempt: int) -> float:
        """Seconds after failed attempt 1, 2, ..."""
        return self.base_seconds * (2 ** (attempt - 1) if self.exponential else 1)


RETRY_LOG = (
    "table_session_id string, file_session_id string, layer string, attempt_no int, status string, error_code string, error_type string, is_retryable boolean, error_message string, "
    "started_at timestamp, ended_at timestamp"
)


@dataclass
class RetryLog:
    """Failed attempts of one piece of work, which the other fields name."""

    rows: list[dict] = field(default_factory=list)
    operation: str = "work"
    table_session_id: str | None = None
    file_session_id: str | None = None
    layer: str | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        """Attempts that were tried again, as rows of the retry log table."""
        named = [
            Row(
                table_session_id=self.table_session_id, file_session_id=self.file_session_id, layer=self.layer, attempt_no=r["attempt"], status="FAILED", error_code=r["error_code"],
                error_type=r["error_type"], is_retryable=True, error_message=r["message"], started_at=r["started_at"], ended_at=r["ended_at"],
            )
            for r in self.rows if r["retried"]
        ]
        return spark.createDataFrame(named, RETRY_LOG)


#: Errors of a program or of its declarations: the same attempt gives the same error.
PROGRAM_ERRORS = (KeyError, IndexError, AttributeError, TypeError, NameError, AssertionError, NotImplementedError, CardinalityError, AnalysisException, ParseException)


def error_type(e: BaseException) -> str:
    """An error's own ``error_type``, or one by its class and words."""
    if hasattr(e, "error_type"):
        return e.error_type
    if isinstance(e, PROGRAM_ERRORS):
        return "SCHEMA" if isinstance(e, AnalysisException) else "PROGRAM"
    words = f"{type(e).__name__} {e}".lower()
    for kind, marks in (("TIMEOUT", ("timeout", "timed out")), ("CONNECTION", ("connection", "unreachable")), ("THROTTLED", ("throttl", "too many requests")), ("SCHEMA", ("missing column", "schema")), ("CONFIG", ("valueerror", "unsupported"))):
        if any(m in words for m in marks):
            return kind
    return "SYSTEM"


def run_with_retry(work: Callable[[], object], policy: RetryPolicy, log: RetryLog | None = None, sleep: Callable[[float], None] = time.sleep) -> object:
    """``work()``, again while the policy allows; every failed attempt is logged, the last error is raised."""
    log, attempt = RetryLog() if log is None else log, 0
    while True:
        attempt += 1
        began = datetime.now()
        try:
            return work()
        except Exception as e:
            kind = error_type(e)
            again = policy.retries(kind) and attempt <= policy.max_retries
            code = getattr(e, "error_code", f"{log.operation.upper()}_{kind}_ERROR")
            log.rows.append({
                "attempt": attempt, "error_type": kind, "error_code": code, "message": str(e)[:1000], "retried": again, "wait": policy.wait(attempt) if again else 0.0,
                "started_at": began, "ended_at": datetime.now(),
            })
            if not again:
                raise
            sleep(policy.wait(attempt))
