"""Runs: retry, recovery, the way through the layers, streams, measures and security."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stratal.operators.mapping import Mapping
from stratal.plans.audit import GateClosed, RetryLog, RetryPolicy, carry_over, gate, only, pass_gate, run_context, run_with_retry, source_success
from stratal.plans.batches import load_silver
from stratal.semantic.engine import AccessDenied, Dimension, Model, Star, aging_bucket, growth_label, ratio, restrict, role_of, year_over_year
from stratal.sources.snapshots import SnapshotTable
from stratal.streaming.ingest import stream_upsert, windowed_counts


class Fault(Exception):
    def __init__(self, kind):
        super().__init__(kind)
        self.error_type = kind


def failing(times, kind):
    left = [times]

    def work():
        if left[0]:
            left[0] -= 1
            raise Fault(kind)
        return "done"

    return work


def test_retry():
    waits, log = [], RetryLog()
    assert run_with_retry(failing(2, "TIMEOUT"), RetryPolicy(3, 5), log, waits.append) == "done"
    assert waits == [5, 10] and [r["retried"] for r in log.rows] == [True, True]
    with pytest.raises(Fault):
        run_with_retry(failing(9, "TIMEOUT"), RetryPolicy(2, 5, exponential=False), log := RetryLog(), waits.append)
    assert len(log.rows) == 3 and not log.rows[-1]["retried"] and waits[2:] == [5, 5]
    with pytest.raises(Fault):
        run_with_retry(failing(1, "DQ_VALIDATION"), RetryPolicy(), log := RetryLog(), waits.append)
    assert len(log.rows) == 1


def test_run_context_and_recovery(spark):
    sessions = spark.createDataFrame([("r", 4)], "run_id string, batch_id int")
    assert run_context(sessions, "NEW").batch_id == 5 and run_context(sessions.where("false"), "NEW").batch_id == 1
    assert run_context(sessions, "RECOVERY", 4).batch_id == 4
    for mode in ("RECOVERY", "OTHER"):
        with pytest.raises(ValueError):
            run_context(sessions, mode)
    last = spark.createDataFrame([("BRONZE", "SUCCESS"), ("SILVER", "FAILED"), ("GOLD", None)], "layer string, status string")
    assert [r["status"] for r in carry_over(last).orderBy("layer").collect()] == ["SKIPPED", "NOT_RUN", "NOT_RUN"]


def test_gate_and_matrix(spark):
    rows = [("a", "B", "SUCCESS", 5), ("a", "B", "SKIPPED", 0), ("b", "B", None, 5), ("c", "B", "SUCCESS", 0)]
    got = {r["run_id"]: r["decision"] for r in gate(spark.createDataFrame(rows, "run_id string, layer string, status string, target_rows int"), "B").collect()}
    assert got == {"a": "OPEN", "b": "RECOVERY", "c": "NO_DATA"}
    bridge = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, None)], "source_id int, target_id int")
    targets = spark.createDataFrame([(10, "SUCCESS"), (11, "FAILED")], "target_id int, status string")
    assert {r["source_id"]: r["status"] for r in source_success(bridge, targets).collect()} == {1: "FAILED", 2: "SUCCESS", 3: "FAILED"}


def test_layers_two_batches(spark, tmp_path):
    spec = {"source": "b", "target": "s", "columns": [{"name": "id", "source": "raw_id", "rules": [{"rule": "not_null", "reason": "primary key is null"}]}, {"name": "v", "source": "upper(v)"}, {"name": "at", "source": "at"}]}
    mapping, table, rejects = Mapping.of(spec), SnapshotTable(spark, f"file://{tmp_path}/s"), SnapshotTable(spark, f"file://{tmp_path}/r")
    batch = lambda *r: spark.createDataFrame(r, "raw_id string, v string, at string")
    one = load_silver(batch(("1", "a", "2024"), ("1", "b", "2025"), (None, "x", "2024")), mapping, ["id"], "at", table, rejects, 1)
    assert (one.status, one.inserted, one.rejected) == ("SUCCESS", 1, 1) and rejects.read().count() == 1
    two = load_silver(batch(("1", "c", "2026"), ("2", "d", "2026")), mapping, ["id"], "at", table, rejects, 2)
    assert (two.inserted, two.updated) == (1, 1) and {(r["id"], r["v"]) for r in table.read().collect()} == {("1", "C"), ("2", "D")}
    assert load_silver(batch((None, "c", "2026")), mapping, ["id"], "at", table, rejects, 3).status == "SKIPPED" and len(table.versions()) == 2


def test_stream_upsert(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    for i, rows in enumerate(([(1, "a", 1)], [(1, "b", 2), (2, "c", 1)])):
        spark.createDataFrame(rows, "k int, v string, at int").coalesce(1).write.mode("append").parquet(src)
        stream_upsert(spark.readStream.schema("k int, v string, at int").parquet(src), table, ["k"], "at", f"file://{tmp_path}/c").awaitTermination()
    assert {(r["k"], r["v"]) for r in table.read().collect()} == {(1, "b"), (2, "c")}
    events = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:10' AS at, 'a' AS k UNION ALL SELECT TIMESTAMP '2024-01-01 00:00:50', 'a'")
    assert [r["n"] for r in windowed_counts(events, "at", "k", "1 minute", "1 hour").collect()] == [2]


def test_measures_over_two_facts(spark):
    q = spark.createDataFrame([("N", True), ("N", False), ("S", False), (None, True)], "region string, won boolean")
    p = spark.createDataFrame([("N", 5), ("W", 7)], "region string, premium int")
    m = Model({"q": q, "p": p})
    m.base("n", "q", "count(*)")
    m.base("won", "q", "count_if(won)")
    m.base("s", "p", "sum(premium)")
    m.measure("Rate", "won n", ratio(0.0))
    m.measure("Premium", "s", lambda s: s)
    got = {r["region"]: (r["rate"], r["premium"]) for r in m.evaluate(["Rate", "Premium"], ["region"]).collect()}
    assert got == {"N": (0.5, 5), "S": (0.0, None), "W": (0.0, 7), None: (1.0, None)}
    assert m.evaluate(["Rate", "Premium"]).first()[:] == (0.5, 12)
    with pytest.raises(ValueError):
        m.evaluate(["Rate"], ["city"])


def test_slicers_reach_the_facts_that_have_the_field(spark):
    q = spark.createDataFrame([("N", 1, True), ("S", 1, False), ("S", 2, True)], "region string, provider int, won boolean")
    p = spark.createDataFrame([(1, 5), (2, 7)], "provider int, paid int")
    m = Model({"q": q, "p": p})
    m.base("n", "q", "count(*)")
    m.base("s", "p", "sum(paid)")
    m.measure("N", "n", lambda c: c)
    m.measure("Paid", "s", lambda c: c)
    assert m.evaluate(["N", "Paid"], [], ["region IN ('S', 'provider')", "provider = 1"]).first()[:] == (1, 5)
    assert m.evaluate(["N", "Paid"], [], "region = 'N'").first()[:] == (1, 12)
    with pytest.raises(ValueError, match="no fact has a field"):
        m.evaluate(["N"], [], "city = 'x'")


def test_star_joins_what_is_asked_for(spark):
    c = spark.createDataFrame([(1, "x", 7), (2, "y", 8)], "ck int, city string, agent int")
    a = spark.createDataFrame([(7, "North")], "ak int, region string")
    s = Star(spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, customer int"), (Dimension(c, "customer", "ck", ("city", "agent")), Dimension(a, "agent", "ak", ("region",))))
    plan = lambda names: s.with_columns(names)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan({"id"}) and plan({"id", "city"}).count("Join") == 1 and plan({"region"}).count("Join") == 2
    assert sorted((r["id"], r["region"]) for r in s.with_columns({"id", "region"}).collect()) == [(10, "North"), (11, None), (12, None)]
    assert s.with_columns(set()).count() == 3
    members = spark.createDataFrame([("AG7", "North")], "user_id string, region string")
    m = Model({"f": s}, secured=(members, "region"))
    m.base("n", "f", "count(*)")
    m.measure("N", "n", lambda c: c)
    with pytest.raises(AccessDenied):
        m.evaluate(["N"])
    assert [m.as_user(u).evaluate(["N"]).first()[0] for u in ("ag7", "x", None)] == [1, 0, 0]


def test_retry_policy_of_a_table_and_unique_lookup(spark):
    rows = [(2, True, 1, 5, "fixed_delay", "A, b", "RULE"), (1, False, 9, 9, "x", "", ""), (3, True, 4, 1, "EXPONENTIAL", "", "")]
    table = spark.createDataFrame(rows, "id int, is_active boolean, max_retry_count int, retry_delay_seconds int, backoff_strategy string, retryable_error_types string, non_retryable_error_types string")
    p = RetryPolicy.first_active(table)
    assert (p.max_retries, p.wait(3), [p.retries(k) for k in ("A", "B", "RULE", "SYSTEM", "OTHER")]) == (1, 5.0, [True, True, False, True, False])
    for few in ("is_active AND id > 5", "false"):
        with pytest.raises(LookupError):
            RetryPolicy.first_active(table.where(few))
    assert only(table, "max_retry_count", id=3, is_active=True) == 4
    for bad in ({"is_active": True}, {"id": 99}):
        with pytest.raises(LookupError):
            only(table, "id", **bad)
    log = RetryLog(operation="load", table_session_id="t1", layer="SILVER")
    run_with_retry(failing(1, "A"), p, log, lambda _: None)
    assert [(r["table_session_id"], r["layer"], r["attempt_no"], r["error_code"], r["is_retryable"]) for r in log.frame(spark).collect()] == [("t1", "SILVER", 1, "LOAD_A_ERROR", True)]


def test_gate_that_stops(spark):
    rows = [("a", "B", "SUCCESS", 5), ("b", "B", "FAILED", 5), ("c", "B", "SKIPPED", 0)]
    layers = spark.createDataFrame(rows, "run_id string, layer string, status string, target_rows int")
    assert pass_gate(layers, "B", "a") and not pass_gate(layers, "B", "c") and not pass_gate(layers, "B", "none")
    with pytest.raises(GateClosed):
        pass_gate(layers, "B", "b")


def test_year_gap_and_labels(spark):
    df = spark.createDataFrame([(2020, 0), (2021, 5), (2023, 8), (2024, 4)], "year_number int, v int")
    out = year_over_year(df, "year_number", "v").withColumn("label", growth_label(F.col("growth"), F.col("prior"))).orderBy("year_number").collect()
    assert [(r["prior"], r["growth"], r["label"]) for r in out] == [(None, None, "New"), (0, None, "New"), (None, None, "New"), (8, -0.5, "-50.00%")]


def test_aging_and_security(spark):
    days = spark.createDataFrame([(d,) for d in (-3, 7, 8, 30, 31, 60, 61, 90, 91, None)], "d int").select(aging_bucket(F.col("d")).alias("b"))
    assert [r["b"] for r in days.collect()] == ["0 - 7 days"] * 2 + ["8 - 30 days"] * 2 + ["31 - 60 days"] * 2 + ["61 - 90 days"] * 2 + ["> 90 days", None]
    members = spark.createDataFrame([("CUS1", 1)], "user_id string, k int")
    facts = {"a": spark.createDataFrame([(1,), (2,)], "k int"), "b": spark.createDataFrame([(1,)], "other int")}
    mine = restrict(facts, members, "k", "cus1")
    assert mine["a"].count() == 1 and mine["b"].count() == 0
    assert all(f.count() == 0 for u in (None, "nobody") for f in restrict(facts, members, "k", u).values())
    assert [role_of(u) for u in ("cus9", "AG1", "x")] == ["customer", "agent", "none"]
