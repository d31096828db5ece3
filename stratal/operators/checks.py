"""The data-quality engine: all rules in one projection, rows split into valid and rejected."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stratal.functions.rules import Rule

REASONS = "_reasons"


@dataclass
class Judged:
    """``valid`` has the input's columns; ``rejected`` also _reasons, an array of ``column::reason``."""

    valid: DataFrame
    rejected: DataFrame
    all: DataFrame


def judge(df: DataFrame, rules: list[Rule]) -> Judged:
    """Without rules every row is valid. Rows are parted by a disjunction, which stops at the first
    violation; reasons are gathered for rejected rows alone."""
    marks = [F.when(r.violated(df), F.lit(f"{r.column}::{r.reason}")) for r in rules]
    found: Column = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")
    bad = F.lit(False)
    for r in rules:
        bad = bad | r.violated(df)
    return Judged(df.where(~bad), df.where(bad).withColumn(REASONS, found), df.withColumn(REASONS, found))


@dataclass(frozen=True)
class SetRule:
    """A rule over several rows: ``columns`` are unique among the rows judged or, with ``other``, are found in its columns
    ``theirs``. Rows in which one of the columns is null break neither. ``reason`` goes to the log, under the first column."""

    columns: tuple[str, ...]
    reason: str
    other: DataFrame | None = None
    theirs: tuple[str, ...] = ()


def judge_sets(marked: DataFrame, rules: list[SetRule]) -> DataFrame:
    """``marked`` (as ``judge().all``) with the reasons of ``rules`` added, which judge all rows, rejected ones too.

    Keys that occur twice are counted before they are joined, and parents are made distinct, so no rule multiplies rows or gathers
    those of one key.
    """
    for i, r in enumerate(rules):
        known = [F.col(c).isNotNull() for c in r.columns]
        whole = known[0]
        for k in known[1:]:
            whole = whole & k
        theirs = [F.col(t).alias(f"_{i}_{j}") for j, t in enumerate(r.theirs if r.other is not None else r.columns)]
        side = (r.other.select(*theirs).distinct() if r.other is not None else marked.where(whole).groupBy(*theirs).count().where("count > 1").drop("count")).withColumn(f"_{i}", F.lit(True))
        on = F.lit(True)
        for j, c in enumerate(r.columns):
            on = on & (marked[c] == side[f"_{i}_{j}"])
        hit = F.col(f"_{i}").isNotNull()
        broken = whole & (~hit if r.other is not None else hit)
        added = F.when(broken, F.array_append(REASONS, F.lit(f"{r.columns[0]}::{r.reason}"))).otherwise(F.col(REASONS))
        marked = marked.join(side, on, "left").select(*(added.alias(c) if c == REASONS else F.col(c) for c in marked.columns))
    return marked


def joined_reasons(rejected: DataFrame, name: str = "reasons") -> DataFrame:
    return rejected.withColumn(name, F.array_join(REASONS, " | ")).drop(REASONS)


def reject_log(rejected: DataFrame, batch: Column, table: str, record_id: str) -> DataFrame:
    """One row for each record and failed rule, with the record as JSON; never worth a retry. (Rejected rows
    have reasons, so the outer explode gives the same rows, and Spark adds no filter that builds the array twice.)"""
    record = F.to_json(F.struct(*(c for c in rejected.columns if c != REASONS)))
    rows = rejected.select(F.col(record_id).cast("string").alias("record_id"), record.alias("record"), batch.alias("batch_id"), F.explode_outer(REASONS).alias("r"))
    return rows.select(
        "batch_id", F.lit(table).alias("table_name"), "record_id", F.substring_index("r", "::", 1).alias("column_name"),
        F.expr("substring(r, instr(r, '::') + 2)").alias("reason"), "record", F.lit("DQ_VALIDATION").alias("error_type"), F.lit(False).alias("retryable"),
    )


def reject_log_of(df: DataFrame, rules: list[Rule], batch: Column, table: str, record_id: str) -> DataFrame:
    """``reject_log`` of all rows of ``df``, each rule judged once for a row: reasons are exploded for every row, and
    rows without one are left out after that, where Spark cannot move the test back before it."""
    if not rules:
        return reject_log(judge(df, rules).rejected, batch, table, record_id)
    # no array function on the way: those are not compiled, and neither is what they are given
    marks = F.array(*(F.when(r.violated(df), F.lit(f"{r.column}::{r.reason}")) for r in rules))
    rows = df.select("*", F.explode_outer(marks).alias("_r")).where("_r IS NOT NULL")
    return rows.select(
        batch.alias("batch_id"), F.lit(table).alias("table_name"), F.col(record_id).cast("string").alias("record_id"), F.substring_index("_r", "::", 1).alias("column_name"),
        F.expr("substring(_r, instr(_r, '::') + 2)").alias("reason"), F.to_json(F.struct(*df.columns)).alias("record"), F.lit("DQ_VALIDATION").alias("error_type"), F.lit(False).alias("retryable"),
    )


def rule_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Violations of every rule in one pass: rule, column_name, violations."""
    sums = df.agg(*(F.count_if(r.violated(df)).alias(f"r{i}") for i, r in enumerate(rules)))
    stacked = ", ".join(f"'{r.name}', '{r.column}', r{i}" for i, r in enumerate(rules))
    return sums.select(F.expr(f"stack({len(rules)}, {stacked}) AS (rule, column_name, violations)"))


def missing_parents(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key is set and in no parent row."""
    keys = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return child.where(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("_parent"), "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their rows and the excess."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).where("row_count > 1").withColumn("excess", F.col("row_count") - 1)
