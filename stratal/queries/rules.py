"""The data-quality engine over line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratal.functions.rules import Rule
from stratal.operators.checks import SetRule, joined_reasons, judge, judge_sets, missing_parents, reject_log, reject_log_of, rule_counts
from stratal.queries import query
from stratal.queries.star import table

RULES = [
    Rule("not_null", "l_orderkey", "primary key is null"),
    Rule("min_value", "l_quantity", "quantity too small", {"limit": 5}),
    Rule("accepted", "l_returnflag", "unknown flag", {"values": ["A", "R"]}),
    Rule("iso_date", "shipped", "invalid date"),
    Rule("numeric", "code", "not a number"),
    Rule("less_than", "l_discount", "discount above tax", {"other": "l_tax"}),
    Rule("not_empty", "comment", "comment is empty"),
    Rule("max_length", "code", "code too long", {"limit": 5}),
    Rule("regex", "comment", "not a word", {"pattern": "^[a-z]+$"}),
    Rule("data_type", "code", "not an int", {"kind": "int"}),
]
# text columns with faults in known places
_CODE = "CASE WHEN l_partkey % 11 = 0 THEN 'x' || l_partkey WHEN l_partkey % 13 = 0 THEN NULL ELSE CAST(l_partkey AS STRING) END"
_SHIPPED = (
    "CASE l_suppkey % 17 WHEN 0 THEN '2025-13-01' WHEN 1 THEN NULL WHEN 2 THEN '2025-02-30T10:00:00Z' WHEN 3 THEN '2025-02-03 23:59:59.123456789+07:00' WHEN 4 THEN '2025-02-03 23:59:59.1234567890' "
    "WHEN 5 THEN '2025-02-03T24:00:00' WHEN 6 THEN '2025-02-03T10:00' WHEN 7 THEN '2025-02-03T10:00:00.' WHEN 8 THEN '2025-02-03T10:00:00-24:00' WHEN 9 THEN '2025-00-03' WHEN 10 THEN '2025-02-03T10:00:00.5Z' "
    "WHEN 11 THEN '2025-2-3' WHEN 12 THEN '2025-02-32' ELSE '2024-05-06' END"
)
_COMMENT = "CASE WHEN l_linenumber = 1 THEN '  ' WHEN l_linenumber = 2 THEN 'Bad 1' WHEN l_linenumber = 3 THEN NULL ELSE 'fine' END"
_DUCK = {"STRING": "VARCHAR"}

# a date's parts by their places: figures where figures belong, marks between them, each part in its range
_FIGURES = lambda at, n: f"translate(substr(shipped, {at}, {n}), '0123456789', '') = '' AND length(substr(shipped, {at}, {n})) = {n}"
_PART = lambda at, lo, hi: f"{_FIGURES(at, 2)} AND CAST(TRY_CAST(substr(shipped, {at}, 2) AS INTEGER) AS INTEGER) BETWEEN {lo} AND {hi}"
_MARK = lambda at, marks: f"substr(shipped, {at}, 1) IN ({marks})"
_REST = "substr(shipped, 20)"
_DIGITS = f"(length(regexp_extract({_REST}, '^[.]([0-9]*)', 1)))"
_ZONE = f"(CASE WHEN {_REST} LIKE '.%' THEN substr({_REST}, 2 + {_DIGITS}) ELSE {_REST} END)"
_ZONE_OK = (
    f"({_ZONE} IN ('', 'Z') OR (length({_ZONE}) = 6 AND substr({_ZONE}, 1, 1) IN ('+', '-') AND substr({_ZONE}, 4, 1) = ':' "
    f"AND coalesce(TRY_CAST(substr({_ZONE}, 2, 2) AS INTEGER) BETWEEN 0 AND 23, false) AND coalesce(TRY_CAST(substr({_ZONE}, 5, 2) AS INTEGER) BETWEEN 0 AND 59, false)))"
)
_ISO = (
    f"{_FIGURES(1, 4)} AND {_MARK(5, chr(39) + '-' + chr(39))} AND {_PART(6, 1, 12)} AND {_MARK(8, chr(39) + '-' + chr(39))} AND {_PART(9, 1, 31)} AND (length(shipped) = 10 OR ("
    f"{_MARK(11, chr(39) + 'T' + chr(39) + ', ' + chr(39) + ' ' + chr(39))} AND {_PART(12, 0, 23)} AND {_MARK(14, chr(39) + ':' + chr(39))} AND {_PART(15, 0, 59)} AND {_MARK(17, chr(39) + ':' + chr(39))} AND {_PART(18, 0, 59)} "
    f"AND ({_REST} NOT LIKE '.%' OR {_DIGITS} BETWEEN 1 AND 9) AND {_ZONE_OK}))"
)

_CASES = [
    ("not_null", "l_orderkey", "primary key is null", "l_orderkey IS NULL"), ("min_value", "l_quantity", "quantity too small", "l_quantity < 5"),
    ("accepted", "l_returnflag", "unknown flag", "l_returnflag NOT IN ('A', 'R')"),
    ("iso_date", "shipped", "invalid date", f"shipped IS NOT NULL AND NOT ({_ISO})"),
    ("numeric", "code", "not a number", "trim(code) <> '' AND TRY_CAST(code AS DOUBLE) IS NULL"), ("less_than", "l_discount", "discount above tax", "l_discount >= l_tax"),
    ("not_empty", "comment", "comment is empty", "comment IS NULL OR trim(comment) = ''"), ("max_length", "code", "code too long", "length(code) > 5"),
    ("regex", "comment", "not a word", "comment IS NULL OR NOT regexp_matches(comment, '^[a-z]+$')"), ("data_type", "code", "not an int", "code IS NOT NULL AND TRY_CAST(code AS INTEGER) IS NULL"),
]
_ROWS = f"r AS (SELECT *, {_CODE} AS code, {_SHIPPED} AS shipped, {_COMMENT} AS comment FROM lineitem)".replace("AS STRING", "AS VARCHAR")
_REASONS = "list_filter([" + ", ".join(f"CASE WHEN {w} THEN '{c}::{m}' END" for _, c, m, w in _CASES) + "], lambda x: x IS NOT NULL)"
_JUDGED = f"WITH {_ROWS}, j AS (SELECT *, {_REASONS} AS reasons FROM r)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns({"code": F.expr(_CODE), "shipped": F.expr(_SHIPPED), "comment": F.expr(_COMMENT)})


@query(f"{_JUDGED} SELECT l_orderkey, l_linenumber, l_partkey FROM j WHERE len(reasons) = 0")
def dq_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(rows(spark, sf_dir), RULES).valid.select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"{_JUDGED} SELECT array_to_string(reasons, ' | ') AS reasons, count(*) AS n FROM j WHERE len(reasons) > 0 GROUP BY 1")
def dq_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_reasons(judge(rows(spark, sf_dir), RULES).rejected).groupBy("reasons").agg(F.count("*").alias("n"))


@query(f"""{_JUDGED} SELECT 7::BIGINT AS batch_id, 'silver.item' AS table_name, l_orderkey::VARCHAR AS record_id, split_part(x, '::', 1) AS column_name, split_part(x, '::', 2) AS reason,
       'DQ_VALIDATION' AS error_type, false AS retryable, count(*) AS n FROM (SELECT l_orderkey, unnest(reasons) AS x FROM j) GROUP BY ALL""")
def dq_reject_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = reject_log_of(rows(spark, sf_dir), RULES, F.lit(7).cast("long"), "silver.item", "l_orderkey")
    return log.groupBy("batch_id", "table_name", "record_id", "column_name", "reason", "error_type", "retryable").agg(F.count("*").alias("n"))


@query(f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, '{c}' AS column_name, count(*) FILTER ({w}) AS violations FROM r" for n, c, _, w in _CASES))
def dq_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_counts(rows(spark, sf_dir), RULES)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def dq_missing_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_size > 25")
    return missing_parents(table(spark, sf_dir, "lineitem"), "l_partkey", part, "p_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT user_id, count(*) AS n FROM events WHERE NOT (value IS NOT NULL AND value < 0) GROUP BY 1")
def dq_no_rules_pass_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null verdict is no violation."""
    return judge(table(spark, sf_dir, "events"), [Rule("min_value", "value", "negative", {"limit": 0})]).valid.groupBy("user_id").agg(F.count("*").alias("n"))


@query("""
WITH r AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n,
         EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P') AS parent, EXISTS (SELECT 1 FROM part WHERE p_size = l_quantity) AS listed FROM lineitem)
SELECT l_orderkey::VARCHAR AS record_id, l_linenumber, column_name, reason FROM (
  SELECT *, 'l_quantity' AS column_name, 'quantity too small' AS reason FROM r WHERE l_quantity < 5
  UNION ALL SELECT *, 'l_partkey', 'part and supplier twice' FROM r WHERE n > 1
  UNION ALL SELECT *, 'l_orderkey', 'order is missing or open' FROM r WHERE NOT parent
  UNION ALL SELECT *, 'l_quantity', 'no such size' FROM r WHERE NOT listed)
""")
def dq_rules_over_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on rows, on uniqueness, on parents and on the values of another table, in one reject log."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    row_rules = [Rule("min_value", "l_quantity", "quantity too small", {"limit": 5})]
    sets = [
        SetRule(("l_partkey", "l_suppkey"), "part and supplier twice"),
        SetRule(("l_orderkey",), "order is missing or open", table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'"), ("o_orderkey",)),
        SetRule(("l_quantity",), "no such size", table(spark, sf_dir, "part"), ("p_size",)),
    ]
    bad = judge_sets(judge(li, row_rules).all, sets).where(F.size("_reasons") > 0)
    log = reject_log(bad, F.lit(1), "lineitem", "l_orderkey")
    return log.select("record_id", F.get_json_object("record", "$.l_linenumber").cast("int").alias("l_linenumber"), "column_name", "reason")
