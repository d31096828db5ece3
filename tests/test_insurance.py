"""Two batches of the insurance platform from bronze to a reconciled star."""

from __future__ import annotations

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stratal.operators.reconcile import Key, Suite
from stratal.plans.audit import GateClosed, RetryPolicy
from stratal.plans.batches import load_silver
from stratal.plans.insurance import FEEDS, TYPE_2, Platform, ValidationFailed
from stratal.plans.monitoring import investigation_queue, layer_monitor, run_summary
from stratal.plans.sources import Intake, Source, monitored
from stratal.sources.snapshots import SnapshotTable

N = 40


def frame(spark, columns, rows):
    return spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"{c} string" for c in columns.split()))


def bronze(spark):
    day = lambda i: f"2024-01-{1 + i % 20:02d} 08:00:00"
    stamp = "created_date updated_date"
    return {
        "customer": frame(spark, f"customer_id full_name gender dob phone_number email city district {stamp}", [(f"CUS{i}", f"n{i}", "F", "1990-01-01", "1", "bad" if i == 3 else f"a{i}@b.vn", "Ha Noi", None, "2023-12-01 00:00:00", None) for i in range(N)]),
        "agent": frame(spark, f"agent_id agent_name region branch manager_name {stamp}", [(f"AG{i}", f"a{i}", "North", "b", "m", "2023-12-01 00:00:00", None) for i in range(4)]),
        "provider": frame(spark, f"provider_code provider_name provider_group active_flag {stamp}", [(p, p, "g", 1, "2023-12-01 00:00:00", None) for p in ("BV", "PVI")]),
        "vehicle": frame(spark, f"vehicle_id customer_id plate_number vehicle_brand vehicle_model manufacture_year vehicle_value {stamp}", [(f"V{i}", f"CUS{i % N}", f"p{i}", "b", "m", 2020, "1000.50", "2023-12-01 00:00:00", None) for i in range(N + 5)]),
        "quotation": frame(spark, f"quotation_id customer_id agent_id provider_code quotation_date quotation_status package_code premium_amount quotation_expiry_date {stamp}", [(f"Q{i}", f"CUS{i}", f"AG{i % 4}", "BV" if i % 2 else "PVI", day(i), "CONVERTED" if i < 10 else "QUOTED", "VIP" if i % 3 else "BASIC", 0 if i == 5 else 100 + i, "2024-06-01 00:00:00", day(i), None) for i in range(N)]),
        "quotation_item": frame(spark, f"quotation_item_id quotation_id coverage_type coverage_amount deductible_amount {stamp}", [(f"I{i}", f"Q{i}" if i < N else "Q_none", "Theft", 500, 5, day(i), None) for i in range(N + 1)]),
        "policy": frame(spark, "policy_id quotation_id customer_id provider_code policy_number policy_start_date policy_end_date policy_status premium_amount issued_date last_updated_at _operation_type", [(f"P{i}", f"Q{i}", f"CUS{i}", "BV", f"no{i}", "2024-02-01", "2025-02-01" if i != 7 else "2024-01-01", "ACTIVE", "200.00", "2024-01-25", "2024-01-25 00:00:00", "I") for i in range(10)]),
        "payment": frame(spark, "payment_id policy_id payment_date payment_method payment_status payment_amount transaction_reference last_updated_at _operation_type", [(f"PAY{i}", f"P{i}", "2024-02-02", "E-wallet" if i % 2 else "cash", "PAID", "50.25", "r", "2024-02-02 00:00:00", "I") for i in range(10)]),
        "cancellation": frame(spark, "cancellation_id policy_id cancellation_date cancellation_reason refund_amount last_updated_at _operation_type", [("C1", "P1", "2024-03-01", "Vehicle Sold", "10.00", "2024-03-01 00:00:00", "I")]),
    }


def test_rule_catalogue():
    assert sum(len(f.mapping(1, n).rules()) for n, f in FEEDS.items()) == 79


def test_two_batches(spark, tmp_path):
    p, first = Platform(spark, f"file://{tmp_path}"), bronze(spark)
    done = p.load(first, 1)
    assert {n: (r.valid, r.rejected) for n, r in p.loaded.items()} | {} == {
        "customer": (N - 1, 1), "agent": (4, 0), "provider": (2, 0), "vehicle": (N + 5, 0), "quotation": (N - 1, 1), "quotation_item": (N + 1, 0),
        "policy": (9, 1), "payment": (10, 0), "cancellation": (1, 0),
    }
    assert {f: d["inserted"] for f, d in done.items()} == {"quotation": N - 1, "quotation_item": N - 1, "policy": 9, "payment": 10, "cancellation": 1}
    q = p.table("gold", "fact_quotation").read()
    assert q.where("customer_key = -1").select("quotation_id").collect()[0][0] == "Q3" and q.where("customer_key = -1 OR vehicle_key = -1 OR agent_key = -1").count() == 1
    assert q.where("converted_flag").count() == 8  # Q5 and P7 were rejected
    dim = p.table("gold", "dim_payment_method").read()
    assert {r["payment_method"] for r in dim.collect()} == {"Unknown", "E_WALLET", "CASH"}

    second = {
        "customer": first["customer"].where("customer_id = 'CUS1'").withColumn("city", F.lit("Da Nang")).withColumn("updated_date", F.lit("2024-01-10 00:00:00")),
        "quotation": first["quotation"].where("quotation_id = 'Q1'").withColumn("quotation_id", F.lit("Q100")).withColumn("quotation_date", F.lit("2024-01-15 00:00:00")),
        "policy": first["policy"].where("policy_id = 'P1'").withColumn("_operation_type", F.lit("D")).withColumn("last_updated_at", F.lit("2024-04-01 00:00:00")),
    }
    again = p.load(second, 2)
    assert again == {"quotation": {"kept": N - 1, "updated": 0, "inserted": 1}, "policy": {"kept": 8, "updated": 1, "inserted": 0}}
    versions = p.table("gold", "dim_customer").read().where("customer_id = 'CUS1'").orderBy("effective_from").collect()
    assert [v["city"] for v in versions] == ["Ha Noi", "Da Nang"] and [v["is_current"] for v in versions] == [False, True]
    keys = {r["quotation_id"]: r["customer_key"] for r in p.table("gold", "fact_quotation").read().where("quotation_id IN ('Q1', 'Q100')").collect()}
    assert keys == {"Q1": versions[0]["customer_key"], "Q100": versions[1]["customer_key"]}
    gone = p.table("gold", "fact_policy").read().where("is_deleted").collect()
    assert [(r["policy_id"], r["premium_amount"], r["delete_batch_id"]) for r in gone] == [("P1", Decimal("0.00"), 2)] and gone[0]["deleted_at"]

    fact = p.table("gold", "fact_policy").read()
    suite = Suite(("policy_id",), ("policy_id", "quotation_id"), (Key("customer_key", "customer", "customer_key"), Key("policy_status_key", "status", "policy_status_key")), {"issued_date_key": "critical"}, "is_deleted")
    dims = {"customer": p.table("gold", "dim_customer").read(), "status": p.table("gold", "dim_policy_status").read()}
    checks = suite.run(fact, p.silver("policy"), dims, p.table("gold", "dim_date").read())
    assert [c for c in checks if not c["passed"]] == []


def test_batch_twice_changes_nothing(spark, tmp_path):
    p, data = Platform(spark, f"file://{tmp_path}"), bronze(spark)
    data = {k: data[k] for k in ("agent", "provider", "customer")}
    p.load(data, 1)
    before = {d: sorted(map(str, p.table("gold", f"dim_{d}").read().collect())) for d in data}
    with pytest.raises(ValueError, match="has been loaded"):
        p.load(data, 1)
    p.load(data, 1, mode="REPLAY")
    assert before == {d: sorted(map(str, p.table("gold", f"dim_{d}").read().collect())) for d in data}


def audit(p, name, *columns, **where):
    df = p.table("audit", name).read()
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_quotations_before_any_policy(spark, tmp_path):
    """Feeds that have not come yet are empty: keys are -1 and flags false; a policy that comes later turns the flag."""
    p, data = Platform(spark, f"file://{tmp_path}", buckets=3), bronze(spark)
    done = p.load({"quotation": data["quotation"]}, 1)
    assert done == {"quotation": {"kept": 0, "updated": 0, "inserted": N - 1}}
    q = p.table("gold", "fact_quotation").read()
    assert q.where("converted_flag OR customer_key <> -1 OR vehicle_key <> -1").count() == 0 and q.where("package_key > 0").count() == N - 1
    assert audit(p, "session", "status") == [("SUCCESS",)] and ("quotation", "SILVER", "SUCCESS") in audit(p, "layer", "source", "layer", "status")
    p.load({"policy": data["policy"]}, 2)
    assert p.table("gold", "fact_quotation").read().where("converted_flag").count() == 8
    assert p.table("gold", "fact_policy").read().where("customer_key = -1").count() == 9


def test_events_before_their_dimension_are_logged(spark, tmp_path):
    p, data = Platform(spark, f"file://{tmp_path}"), bronze(spark)
    late = data["provider"].withColumn("created_date", F.when(F.col("provider_code") == "BV", "2024-01-10 00:00:00").otherwise(F.col("created_date")))
    p.load({"provider": late, "quotation": data["quotation"]}, 1)
    q = p.table("gold", "fact_quotation").read()
    before = {f"Q{i}" for i in range(N) if i % 2 and 1 + i % 20 < 10 and i != 5}
    assert {r["quotation_id"] for r in q.where("provider_key = -1").collect()} == before
    log = p.table("audit", "invalid_record").read()
    assert {r["record_key"] for r in log.collect()} == before and {tuple(r) for r in log.select("layer", "target_table", "error_column", "error_type").collect()} == {("GOLD", "gold.fact_quotation", "provider_key", "TEMPORAL_MISMATCH_ERROR")}
    one = log.where("record_key = 'Q3'").first()
    assert one["error_reason"] == "Transaction date [2024-01-04] is prior to dimension registration date [2024-01-10] for business key [BV]" and '"quotation_id":"Q3"' in one["raw_data"]


def test_failed_layer_stops_the_next_and_recovery_goes_on(spark, tmp_path):
    p, data = Platform(spark, f"file://{tmp_path}", policy=RetryPolicy(1, 0.0, retryable=("SYSTEM",))), bronze(spark)
    feeds = {"agent": data["agent"], "customer": data["customer"].drop("email")}
    with pytest.raises(GateClosed, match="SILVER gate: 1 table"):
        p.load(feeds, 5)
    assert not p.table("gold", "dim_agent").exists()
    states = {(s, la): st for s, la, st in audit(p, "layer", "source", "layer", "status")}
    assert states == {("agent", "SILVER"): "SUCCESS", ("customer", "SILVER"): "FAILED", ("dim_customer", "GOLD"): "NOT_RUN", ("dim_agent", "GOLD"): "NOT_RUN"}
    assert audit(p, "session", "run_mode", "status") == [("NEW", "FAILED")]
    assert [x for x in audit(p, "layer", "attempts", source="customer")] == [(1,)] and not p.table("audit", "retry").exists()  # a missing column is not worth a retry
    p.load({"agent": data["agent"], "customer": data["customer"]}, 5, mode="RECOVERY")
    assert p.loaded.keys() == {"customer"} and p.table("gold", "dim_agent").read().count() == 5 and p.table("gold", "dim_customer").read().count() == N
    assert audit(p, "session", "run_mode", "status") == [("NEW", "FAILED"), ("RECOVERY", "SUCCESS")]
    assert len(p.table("silver", "agent").versions()) == 1


def test_nothing_valid_ends_the_batch(spark, tmp_path):
    p, data = Platform(spark, f"file://{tmp_path}"), bronze(spark)
    assert p.load({"agent": data["agent"].withColumn("agent_name", F.lit(""))}, 1) == {}
    assert audit(p, "layer", "source", "status") == [("agent", "SKIPPED")] and not p.table("gold", "dim_agent").exists()


def test_validation_is_recorded_with_an_offending_row(spark, tmp_path):
    p, data = Platform(spark, f"file://{tmp_path}"), bronze(spark)
    far = data["quotation"].withColumn("quotation_date", F.when(F.col("quotation_id") == "Q8", "2031-01-01 00:00:00").otherwise(F.col("quotation_date"))).withColumn("quotation_expiry_date", F.lit("2032-01-01 00:00:00"))
    with pytest.raises(ValidationFailed, match="date quotation_date_key"):
        p.load({"quotation": far}, 1, strict=True)
    bad = p.table("audit", "validation").read().where("NOT passed").collect()
    assert {(r["check"], r["column"]) for r in bad} == {("date", "quotation_date_key"), ("date", "expiry_date_key"), *(("unresolved", f"{d}_key") for d in ("customer", "agent", "provider"))}  # no dimension has come
    assert '"quotation_id":"Q8"' in next(r["sample"] for r in bad if r["column"] == "quotation_date_key")


def gold(p, name, *columns):
    return sorted((tuple(r) for r in p.table("gold", name).read().select(*columns).collect()), key=str)


def test_keys_are_put_right_when_a_dimension_comes_late(spark, tmp_path):
    """Facts before their dimensions, a parent after its children, and a change that is told late: in the end keys are as if all had come in order."""
    p, data = Platform(spark, f"file://{tmp_path}/late", buckets=8), bronze(spark)
    p.load({k: data[k] for k in ("quotation", "payment")}, 1)
    assert p.table("gold", "fact_quotation").read().where("customer_key <> -1 OR agent_key <> -1").count() == 0
    before = {f.path for f in p.table("gold", "fact_quotation").version().parts}
    p.load({"customer": data["customer"].where("customer_id IN ('CUS1', 'CUS2')")}, 2)
    done = p.rekeyed["quotation"]
    assert done["updated"] == 2 and done["inserted"] == 0 and p.rekeyed.keys() == {"quotation"}
    after = {f.path for f in p.table("gold", "fact_quotation").version().parts}
    assert 0 < len(after - before) <= 2  # only the buckets of the two rows were written
    log = p.table("audit", "unresolved").read().where("target_table = 'gold.fact_quotation' AND column = 'customer_key'")
    assert {r["bk"] for r in log.where("closed_batch = 2").collect()} == {"CUS1", "CUS2"} and log.where("closed_batch IS NULL").count() == N - 3
    p.load({k: data[k] for k in ("customer", "agent", "provider", "vehicle", "policy")}, 3)
    move = data["customer"].where("customer_id = 'CUS4'").withColumn("city", F.lit("Hue"))
    p.load({"customer": move.withColumn("updated_date", F.lit("2024-01-20 00:00:00"))}, 4)
    p.load({"customer": move.withColumn("city", F.lit("Vinh")).withColumn("updated_date", F.lit("2024-01-02 00:00:00"))}, 5)  # older, told later

    q = Platform(spark, f"file://{tmp_path}/ordered")
    q.load({k: data[k] for k in ("customer", "agent", "provider", "vehicle", "quotation", "policy")}, 1)
    q.load({"customer": move.withColumn("city", F.lit("Vinh")).withColumn("updated_date", F.lit("2024-01-02 00:00:00"))}, 2)
    q.load({"customer": move.withColumn("updated_date", F.lit("2024-01-20 00:00:00"))}, 3)
    q.load({"payment": data["payment"]}, 4)

    def star(x, fact, grain, dims):
        """The fact with business keys and starts of versions in place of surrogate keys."""
        rows = x.table("gold", fact).read()
        for d, (key, bk) in dims.items():
            side = x.dimension(d).select(F.col(key).alias("_k"), F.col(bk).alias(f"{d}_bk"), *([F.col("effective_from").alias(f"{d}_from")] if d in TYPE_2 else []))
            rows = rows.join(side, F.col(key) == F.col("_k")).drop("_k")
        return sorted(map(str, rows.select(grain, *(c for c in rows.columns if c.endswith(("_bk", "_from")))).collect()))

    dims = {d: (f"{d}_key", TYPE_2[d][0]) for d in ("customer", "provider", "vehicle")}
    for fact, grain in (("fact_quotation", "quotation_id"), ("fact_payment", "payment_id")):
        assert star(p, fact, grain, dims) == star(q, fact, grain, dims)
    assert [r["city"] for r in p.dimension("customer").where("customer_id = 'CUS4'").orderBy("effective_from").collect()] == ["Ha Noi", "Vinh", "Hue"]


def test_validation_finds_what_is_wrong(spark, tmp_path):
    """A row that is missing, an amount that is off, a key that was lost and a version that begins after its event, each by its check."""
    p, data = Platform(spark, f"file://{tmp_path}"), bronze(spark)
    data["vehicle"] = data["vehicle"].where("CAST(substr(vehicle_id, 2) AS INT) < 40")
    data["payment"] = data["payment"].where("payment_id NOT IN ('PAY7')")  # its policy is rejected
    data["customer"] = data["customer"].withColumn("email", F.lit("a@b.vn"))
    p.load(data, 1, strict=True)  # nothing fails
    checks = audit(p, "validation", "table_name", "check", "passed")
    assert {c for _, c, _ in checks} == {"grain", "null_bk", "orphan", "unresolved", "temporal", "date", "soft_delete", "row_count", "metric"} and all(ok for _, _, ok in checks)
    assert audit(p, "session", "failed_checks", "sla_met") == [(0, True)]
    table, whole = p.table("gold", "fact_policy"), p.table("gold", "fact_policy").read()
    failed = lambda: {(x["check"], x["column"], x["bad"]) for x in p.checks("policy", 1) if not x["passed"]}
    number = table.version().number
    older = p.dimension("provider").where("provider_code = 'BV'").first()["provider_key"]
    damage = {
        ("row_count", "", 1.0): whole.where("policy_id <> 'P3'"), ("metric", "premium_amount", 5.0): whole.withColumn("premium_amount", F.when(F.col("policy_id") == "P3", F.col("premium_amount") + 5).otherwise(F.col("premium_amount"))),
        ("unresolved", "customer_key", 1.0): whole.withColumn("customer_key", F.when(F.col("policy_id") == "P3", -1).otherwise(F.col("customer_key"))),
        ("orphan", "agent_key", 1.0): whole.withColumn("agent_key", F.when(F.col("policy_id") == "P3", 999).otherwise(F.col("agent_key"))),
        ("soft_delete", "is_deleted", 1.0): whole.withColumn("is_deleted", F.col("policy_id") == "P3"),
        ("date", "start_date_key", 1.0): whole.withColumn("start_date_key", F.when(F.col("policy_id") == "P3", 19000101).otherwise(F.col("start_date_key"))),
        ("grain", "policy_id", 1.0): whole.unionByName(whole.where("policy_id = 'P3'")),
    }
    for want, rows in damage.items():
        table.publish(rows.withColumns({c: F.col(c).cast(t) for c, t in whole.dtypes}))
        assert want in failed(), want
    table.publish(table.read(number))
    assert failed() == set()
    dim = p.table("gold", "dim_provider")
    dim.publish(dim.read().withColumn("effective_from", F.when(F.col("provider_key") == older, F.lit("2024-02-20 00:00:00").cast("timestamp")).otherwise(F.col("effective_from"))))
    assert {(c, k) for c, k, _ in failed()} == {("temporal", "provider_key")}


def test_totals_of_silver_and_facts_agree_without_a_scan(spark, tmp_path, monkeypatch):
    """Totals kept with the parts through two batches; damage shows in its bucket, and only that bucket is read to name the rows."""
    p, data = Platform(spark, f"file://{tmp_path}", buckets=4), bronze(spark)
    p.load(data, 1)
    later = {n: data[n].withColumn("last_updated_at", F.lit("2024-03-05 00:00:00")) for n in ("policy", "payment")}
    later["payment"] = later["payment"].withColumn("_operation_type", F.when(F.col("payment_id") == "PAY2", "D").otherwise("U")).withColumn("payment_amount", F.lit("75.50"))
    p.load(later, 2)
    log = {(t, m): (int(s), int(o), int(x), ok) for t, m, s, o, x, ok in audit(p, "balance", "table_name", "measure", "source", "outside", "target", "passed") if m == "rows"}
    assert log == {("gold.fact_quotation", "rows"): (N - 1, 0, N - 1, True), ("gold.fact_quotation_item", "rows"): (N + 1, 2, N - 1, True), ("gold.fact_policy", "rows"): (9, 0, 9, True), ("gold.fact_payment", "rows"): (10, 0, 10, True), ("gold.fact_cancellation", "rows"): (1, 0, 1, True)}
    with monkeypatch.context() as m:
        m.setattr(SnapshotTable, "_rows", lambda *a, **k: pytest.fail("rows were read"))
        found = p.balance("payment")
    assert all(x["passed"] for x in found) and {x["bucket"] for x in found} == {0, 1, 2, 3}
    assert sum(x["target"] for x in found if x["measure"] == "payment_amount") == Decimal("679.50")  # nine of 75.50, one deleted
    assert p.differences("payment").count() == 0

    table = p.table("gold", "fact_payment")
    v, whole = table.version(), table.read()
    spoilt = next(x.bucket for x in v.parts if x.rows > 1)
    rows = table.bucket_rows({spoilt})
    first, second = [r["payment_id"] for r in rows.orderBy("payment_id").limit(2).collect()]
    names = whole.columns
    bad = rows.where(F.col("payment_id") != first).withColumn("payment_amount", F.when(F.col("payment_id") == second, F.lit(Decimal("1.00"))).otherwise(F.col("payment_amount")).cast("decimal(18,2)"))
    table.replace_buckets(bad.select(names), {spoilt})
    assert {x["bucket"] for x in p.balance("payment") if not x["passed"]} == {spoilt}
    read, inner = [], SnapshotTable._rows
    monkeypatch.setattr(SnapshotTable, "_rows", lambda self, v, parts, token=False: read.extend(x.bucket for x in parts) or inner(self, v, parts, token))
    assert {(r["payment_id"], r["state"]) for r in p.differences("payment").collect()} == {(first, "missing"), (second, "amount")}
    assert set(read) == {spoilt}
    twice = table.read(v.number).unionByName(table.read(v.number).where(F.col("payment_id") == second))
    table.publish(twice.unionByName(whole.limit(1).withColumn("payment_id", F.lit("PAY99"))), ["payment_id"], 4)
    assert {(r["payment_id"], r["state"]) for r in p.differences("payment").collect()} >= {(second, "repeated"), ("PAY99", "surplus")}
    # a key in place of another leaves numbers and amounts as they are
    table.publish(table.read(v.number).withColumn("payment_id", F.when(F.col("payment_id") == first, "PAY98").otherwise(F.col("payment_id"))))
    assert {x["measure"] for x in p.balance("payment") if not x["passed"]} == {"keys"}
    with pytest.raises(ValidationFailed, match="balance"):
        p.load({"payment": later["payment"].where("payment_id = 'PAY3'")}, 3, strict=True)


def test_rows_outside_a_fact_come_in_with_their_parent(spark, tmp_path):
    p, data = Platform(spark, f"file://{tmp_path}"), bronze(spark)
    p.load({"quotation": data["quotation"].where("quotation_id <> 'Q7'"), "quotation_item": data["quotation_item"]}, 1)
    outside = lambda: {r[0] for r in p.table("audit", "outside_quotation_item").read().where("outside").select("quotation_item_id").collect()}
    assert outside() == {"I5", "I7", f"I{N}"}  # Q5 was rejected
    p.load({"quotation": data["quotation"].where("quotation_id = 'Q7'"), "quotation_item": data["quotation_item"].where("quotation_item_id = 'I7'")}, 2)
    assert outside() == {"I5", f"I{N}"} and all(x["passed"] for x in p.balance("quotation_item"))


def test_parts_of_other_totals_are_read(spark, tmp_path):
    """Tables written before totals were declared, in buckets or not, with nulls, and one without rows."""
    for buckets in (0, 3):
        bare = SnapshotTable(spark, f"file://{tmp_path}/{buckets}")
        rows = lambda a, b: spark.range(a, b).selectExpr("id", "IF(id % 5 = 0, NULL, CAST(id AS DECIMAL(18,2)) / 4) AS x")
        bare.publish(rows(0, 40), ["id"] if buckets else None, buckets)
        t = SnapshotTable(spark, f"file://{tmp_path}/{buckets}", totals={"x": "x", "n": "CAST(id AS BIGINT)"})
        t.append(rows(40, 60))
        want = [r.asDict() for r in rows(0, 60).selectExpr("count(*) AS rows", "sum(x) AS x", "sum(id) AS n").collect()][0]
        found = t.sums()
        assert {k: sum(x[k] for x in found.values()) for k in want} == want and set(found) == ({0, 1, 2} if buckets else {None})
        t.merge(rows(0, 60), ["id"])
        again = SnapshotTable(spark, f"file://{tmp_path}/{buckets}", totals=t.totals)
        assert all(x.totals for x in again.version().parts) and {k: sum(x[k] for x in again.sums().values()) for k in want} == want
    t = SnapshotTable(spark, f"file://{tmp_path}/none", totals={"x": "x"})
    t.publish(rows(0, 0))
    assert all(v == 0 for x in t.sums().values() for v in x.values())


def test_a_step_that_fails_anywhere_and_is_done_again_leaves_the_same(spark, tmp_path, monkeypatch):
    """Each publishing of a load fails once; what is in force after the retry is what an undisturbed load leaves."""
    data = bronze(spark)
    feeds = {k: data[k] for k in ("customer", "quotation")}
    content = lambda p: {n: sorted(map(str, p.table(*n.split("/")).read().drop("_loaded_at").collect())) for n in ("silver/customer", "silver/quotation", "rejected/customer", "rejected/quotation", "gold/dim_customer", "gold/dim_package", "gold/fact_quotation", "audit/invalid_record", "audit/unresolved") if p.table(*n.split("/")).exists()}
    calm = Platform(spark, f"file://{tmp_path}/calm", policy=RetryPolicy(0, 0.0))
    calm.load(feeds, 1, threads=1)
    want, publish, calls = content(calm), SnapshotTable._publish, []

    def counted(self, *args):
        calls.append(self.root)
        return publish(self, *args)

    monkeypatch.setattr(SnapshotTable, "_publish", counted)
    Platform(spark, f"file://{tmp_path}/count", policy=RetryPolicy(0, 0.0)).load(feeds, 1, threads=1)
    points = [i for i, r in enumerate(calls) if "/audit/" not in r or r.endswith(("unresolved", "invalid_record"))]
    for after in (False, True):
        for fail_at in points[2 if after else 0 :: 5]:
            seen = []

            def broken(self, *args, seen=seen, fail_at=fail_at, after=after):
                seen.append(self.root)
                if len(seen) - 1 == fail_at and not after:
                    raise TimeoutError("the store did not answer")
                out = publish(self, *args)
                if len(seen) - 1 == fail_at:
                    raise TimeoutError("the store did not answer in time")
                return out

            monkeypatch.setattr(SnapshotTable, "_publish", broken)
            p = Platform(spark, f"file://{tmp_path}/{after}-{fail_at}", policy=RetryPolicy(1, 0.0))
            p.load(feeds, 1, threads=1)
            assert content(p) == want, (fail_at, after)
            assert audit(p, "retry", "attempt_no", "error_type") == [(1, "TIMEOUT")]


def test_full_load_is_published_once(spark, tmp_path, monkeypatch):
    """A full load whose publishing fails leaves the old table in force."""
    mapping, table, rejects = FEEDS["agent"].mapping(1, "agent"), SnapshotTable(spark, f"file://{tmp_path}/s"), SnapshotTable(spark, f"file://{tmp_path}/r")
    rows = bronze(spark)["agent"]
    load_silver(rows, mapping, ["agent_id"], "updated_at", table, rejects, 1, full=True)
    publish = SnapshotTable._publish
    monkeypatch.setattr(SnapshotTable, "_publish", lambda *a: (_ for _ in ()).throw(TimeoutError()))
    with pytest.raises(TimeoutError):
        load_silver(rows.where("agent_id = 'AG1'"), mapping, ["agent_id"], "updated_at", table, rejects, 2, full=True)
    assert table.read().count() == 4 and len(table.versions()) == 1
    monkeypatch.setattr(SnapshotTable, "_publish", publish)
    load_silver(rows.where("agent_id = 'AG1'"), mapping, ["agent_id"], "updated_at", table, rejects, 2, full=True)
    assert table.read().count() == 1 and len(table.versions()) == 2


def test_batches_are_numbered(spark, tmp_path):
    p, data = Platform(spark, f"file://{tmp_path}"), bronze(spark)
    for _ in range(2):
        p.load({"agent": data["agent"]})
    assert audit(p, "session", "batch_id", "status") == [(1, "SUCCESS"), (2, "SUCCESS")]
    for mode in ("RECOVERY", "REPLAY", "other"):
        with pytest.raises(ValueError):
            p.load({"agent": data["agent"]}, mode=mode)


def test_two_batches_from_files_and_a_table(spark, tmp_path):
    """New files and changed rows only; a failed batch is done again in RECOVERY; the monitoring views read the platform's own audit."""
    p, data = Platform(spark, f"file://{tmp_path}/p", policy=RetryPolicy(0, 0.0)), bronze(spark)
    files = f"{tmp_path}/quotation"
    put = lambda name, where: data["quotation"].where(where).toPandas().to_csv(f"{files}/{name}", index=False)
    os.makedirs(files)
    put("a.csv", "quotation_id IN ('Q1', 'Q2')")
    customers = lambda rows: rows.createOrReplaceTempView("source_customers")
    customers(data["customer"].where("customer_id IN ('CUS1', 'CUS2')"))
    intake = Intake(p, (Source("quotation", f"file://{files}", "csv"), Source("customer", "source_customers", changed=("updated_date", "created_date"))))
    assert intake.load() == {"quotation": {"kept": 0, "updated": 0, "inserted": 2}}
    assert intake.load() == {}  # nothing new
    put("b.csv", "quotation_id = 'Q4'")
    moved = data["customer"].where("customer_id IN ('CUS1', 'CUS2', 'CUS4')")
    customers(moved.withColumn("updated_date", F.when(F.col("customer_id") == "CUS1", "2024-01-10 00:00:00").when(F.col("customer_id") == "CUS4", "2024-01-01 00:00:00")))
    (tmp_path / "quotation" / "c.csv").write_text("nothing\n1\n")
    good = Intake(p, (intake.sources[1],))
    with pytest.raises(GateClosed):
        Intake(p, (Source("quotation", f"file://{files}", "parquet"), intake.sources[1])).load()
    assert [r for r in audit(p, "file", "batch_id", "file_name", "status") if r[0] == 3] == [(3, "b.csv", "FAILED"), (3, "c.csv", "FAILED")]
    os.remove(f"{files}/c.csv")
    put("c.csv", "quotation_id = 'Q6'")
    assert intake.load(3, "RECOVERY") == {"quotation": {"kept": 2, "updated": 0, "inserted": 2}}
    assert {(n, s) for _, n, s in audit(p, "file", "batch_id", "file_name", "status")} == {("a.csv", "SUCCESS"), ("b.csv", "SUCCESS"), ("c.csv", "SUCCESS")}
    assert {r["customer_id"] for r in p.dimension("customer").collect()} == {"CUS1", "CUS2", "CUS4", "Unknown"} and good.load() == {}
    assert audit(p, "watermark", "source_id", "watermark") == [("customer", "2024-01-10 00:00:00")]
    monitor = layer_monitor(*monitored(p))
    summary = {r["batch_id"]: r for r in run_summary(monitor).orderBy("session_started").collect()}
    assert summary[1]["session_status"] == "SUCCESS" and summary[1]["failed_table_count"] == 0 and summary[1]["total_inserted_row"] >= 4
    failed = investigation_queue(monitor).where("batch_id = 3 AND run_mode = 'NEW'").collect()
    assert {r["source_table_name"] for r in failed if r["detail_status"] == "FAILED"} == {"quotation"}


def test_many_rows_are_not_sent_whole_to_each_executor(spark, tmp_path):
    """Rows that take little room in files: a table of many is joined by sort and merge, one of a few is broadcast."""
    from stratal.plans.batches import staged

    def plan(side):
        other = spark.range(200_000).select(F.col("id").alias("k"))
        return other.join(side.select("id"), F.col("k") == F.col("id"), "left_semi")._jdf.queryExecution().sparkPlan().toString()

    for rows, kind in ((60_000, "SortMergeJoin"), (100, "BroadcastHashJoin")):
        table = SnapshotTable(spark, f"file://{tmp_path}/{rows}")
        table.publish(spark.range(rows))
        for side in (table.read(), staged(spark.range(rows), f"file://{tmp_path}/{rows}")[0]):
            assert kind in plan(side)


def test_checks_are_the_same_whether_silver_is_joined_or_not(spark, tmp_path, monkeypatch):
    """Where fact and silver agree on rows and days, the checks do not join all rows of both; figures and samples are those of the join."""
    p, first = Platform(spark, f"file://{tmp_path}", days=("2023-01-01", "2026-12-31")), bronze(spark)
    p.load(first, 1)
    facts = ("quotation", "quotation_item", "payment", "cancellation")
    rows = {f: p.table("gold", f"fact_{f}").read() for f in facts}
    assert all(p._agreed(f, 1, rows[f]) for f in facts)
    short = {f: p.checks(f, 1) for f in facts}
    assert any(not x["passed"] and x["sample"] for x in short["quotation"])
    with monkeypatch.context() as m:
        m.setattr(Platform, "_agreed", lambda *_: None)
        assert all(sorted(map(str, p.checks(f, 1))) == sorted(map(str, short[f])) for f in facts)
    # a row that is gone from silver, one that is there twice, and another day: the rows are joined
    q = rows["quotation"]
    assert p._agreed("quotation", 1, q.union(q.limit(1))) is None
    assert p._agreed("quotation", 1, q.withColumn("quotation_date_key", F.lit(20240131))) is None
    assert p._agreed("payment", 1, rows["payment"].withColumn("payment_id", F.concat("payment_id", F.lit("x")))) is None
    assert p._agreed("quotation_item", 1, rows["quotation_item"].withColumn("quotation_id", F.lit("Q_none"))) is None


def test_rows_are_staged_without_what_can_be_made_anew(spark, tmp_path, monkeypatch):
    """Literals and columns with the source of an earlier one are neither staged nor dealt, and are in silver all the same."""
    import stratal.plans.batches as batches

    seen, write = [], batches.staged
    monkeypatch.setattr(batches, "staged", lambda df, root: seen.append(df.columns) or write(df, root))
    p = Platform(spark, f"file://{tmp_path}")
    p._silver("payment", bronze(spark)["payment"], 7)
    assert "updated_at" not in seen[0] and "_batch_id" not in seen[0]
    rows = p.table("silver", "payment").read()
    assert rows.columns == [*(t.name for t in FEEDS["payment"].mapping(7, "payment").columns), "_batch_id"]
    assert rows.count() == 10 and rows.where("updated_at = last_updated_at AND _batch_id = '7'").count() == 10
