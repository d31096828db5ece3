"""Small fixtures for what the test tables do not hold: ties, boundaries, nulls, defects."""

from __future__ import annotations

import random
from datetime import date, datetime, datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stratal.functions.columns import divide, live_amount
from stratal.functions.rules import RULES, Rule
from stratal.operators.asof import last_before, version_at
from stratal.operators.checks import SetRule, joined_reasons, judge, judge_sets, reject_log
from stratal.operators.dedup import latest, unchanged
from stratal.operators.keys import assign_keys
from stratal.operators.mapping import Mapping, conform, project, require
from stratal.operators.merge import CardinalityError, Clause, Merge, delete_where, metrics, overwrite_where, upsert
from stratal.operators.reconcile import Key, Suite
from stratal.operators.scd import Type1, Type2, with_unknown
from stratal.sources import snapshots
from stratal.sources.readers import dirty_json, list_files, next_watermark, read_file, read_source, since
from stratal.sources.snapshots import Conflict, SnapshotTable


def ids(df):
    return sorted(r["id"] for r in df.collect())


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize(
    ("name", "params", "bad", "good"),
    [
        ("not_null", {}, [None], ["", "x"]), ("not_empty", {}, [None, "", "  "], ["x"]), ("max_length", {"limit": 2}, ["abc"], [None, "ab"]),
        ("regex", {"pattern": r"^[^@\s]+@[^@\s]+$"}, [None, "bad"], ["a@b"]),
        ("iso_date", {}, ["2025-13-01", "x", "2025-01-32", "2025-01-01T25:00:00"], [None, "2025-02-30", "2025-01-01", "2025-01-01 10:00:00.5", "2025-01-01T10:00:00+07:00"]),
        ("numeric", {}, ["abc", "1x"], [None, "", " ", "1.5", "-2"]), ("min_value", {"limit": 0}, ["-1"], [None, "0", "abc"]),
        ("min_value", {"limit": 0, "inclusive": False}, ["-1", "0"], [None, "1"]), ("accepted", {"values": ["A", "B"]}, ["C"], [None, "A"]),
        ("data_type", {"kind": "int"}, ["x", "1.5e"], [None, "7"]), ("data_type", {"kind": "date"}, ["zzz"], ["2024-01-01", None]), ("data_type", {"kind": "string"}, [], ["x", None]),
    ],
)
def test_rules(spark, name, params, bad, good):
    df = spark.createDataFrame([(v, True) for v in bad] + [(v, False) for v in good], "c string, expected boolean")
    got = df.select("c", "expected", Rule(name, "c", "r", params).violated(df).alias("got")).collect()
    assert [r for r in got if r["got"] != r["expected"]] == []


def test_less_than_and_unknown_rules(spark):
    df = spark.createDataFrame([(1, 2), (2, 2), (3, 2), (None, 2), (1, None)], "a int, b int")
    assert [r[0] for r in df.select(Rule("less_than", "a", "r", {"other": "b"}).violated(df)).collect()] == [False, True, True, False, False]
    with pytest.raises(ValueError):
        Rule("nothing", "a", "r").violated(df)
    with pytest.raises(ValueError):
        Rule("not_null", "zz", "r").violated(df)
    with pytest.raises(ValueError):
        RULES["data_type"](F.col("a"), "blob")


def test_several_reasons_and_log(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "ok", "5")], "id int, name string, amount string")
    j = judge(df, [Rule("not_null", "name", "name is null"), Rule("numeric", "amount", "no number")])
    assert rows(j.valid, "id") == [(2,)]
    assert rows(joined_reasons(j.rejected), "reasons") == [("name::name is null | amount::no number",)]
    log = reject_log(j.rejected, F.lit(3), "t", "id").collect()
    assert {(r["column_name"], r["reason"], r["retryable"]) for r in log} == {("name", "name is null", False), ("amount", "no number", False)}
    assert judge(df, []).valid.count() == 2 and judge(df, []).rejected.count() == 0


def test_dedup_tie_is_stable(spark):
    data = [(1, dt(2024, 1, 1), "b"), (1, dt(2024, 1, 1), "a"), (1, None, "z")]
    for order in (data, data[::-1]):
        out = latest(spark.createDataFrame(order, "k int, at timestamp, v string"), ["k"], [F.col("at").desc_nulls_last()])
        assert rows(out, "v") == [("a",)]


def test_unchanged_is_null_safe(spark):
    s = spark.createDataFrame([(1, None), (2, ""), (3, "a||b")], "k int, v string")
    t = spark.createDataFrame([(1, None), (2, None), (3, "a")], "k int, v string")
    assert rows(unchanged(s, t, ["k"], ["v"]), "k") == [(2,), (3,)]


def test_watermark_boundary(spark):
    df = spark.createDataFrame([(1, dt(2024, 1, 1)), (2, dt(2024, 1, 1, 0, 0, 0, 1)), (3, None)], "id int, at timestamp")
    assert rows(since(df, "at", "2024-01-01 00:00:00"), "id") == [(2,)]
    assert since(df, "at", None).count() == since(df, None, None, incremental=False).count() == 3
    with pytest.raises(ValueError):
        since(df, "missing", "2024-01-01")
    assert next_watermark(df, "at", None).startswith("2024-01-01 00:00:00.000001")
    assert next_watermark(df.where("false"), "at", "old") == "old"
    with pytest.raises(ValueError):
        next_watermark(df.where("id = 3"), "at", None)


def test_merge(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (None, "n", 0)], "k int, v string, keep int")
    s = spark.createDataFrame([(2, "B"), (3, "c"), (None, "N")], "k int, v string")
    out = upsert(t, s, ["k"])
    assert rows(out, "k", "v", "keep", "_action") == sorted([(1, "a", 1, "KEPT"), (2, "B", 2, "UPDATED"), (3, "c", None, "INSERTED"), (None, "N", 0, "UPDATED")], key=repr)
    assert metrics(out) == {"kept": 1, "updated": 2, "inserted": 1}
    with pytest.raises(CardinalityError):
        upsert(t, s.unionByName(s), ["k"])
    one = Merge(["k"], [Clause("t.v = 'b'", {"v": "'first'"}), Clause(None, {"v": "'second'", "keep": "9"})], insert=False).apply(t, s)
    assert rows(one, "k", "v", "keep") == sorted([(1, "a", 1), (2, "first", 2), (None, "second", 9)], key=repr)
    assert rows(overwrite_where(t, F.col("k") == 1, {"v": F.lit("x")}), "v") == [("b",), ("n",), ("x",)]
    assert delete_where(t, F.col("k") == 1).count() == 2


def test_keys_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.concat(F.lit("b"), F.col("id")).alias("bk"))
    a = rows(assign_keys(df.repartition(1), ["bk"], "k", 10, range_rows=64), "bk", "k")
    assert a == rows(assign_keys(df.repartition(7), ["bk"], "k", 10, range_rows=64), "bk", "k")
    assert sorted(k for _, k in a) == list(range(11, 511))


def test_scd1(spark):
    target = with_unknown(spark.createDataFrame([(1, "A", "x"), (2, "B", None)], "k long, code string, name string"), "k")
    batch = spark.createDataFrame([("A", "x"), ("B", "new"), (" ", "blank"), (None, "null"), ("C", "c")], "code string, name string")
    out = Type1("k", "code", ("name",)).apply(target, batch)
    assert rows(out, "k", "code", "name", "_action") == sorted([(-1, "Unknown", "Unknown", "KEPT"), (1, "A", "x", "KEPT"), (2, "B", "new", "UPDATED"), (3, "C", "c", "INSERTED")], key=repr)


def test_scd2_chain_and_boundaries(spark):
    schema = "k long, id string, city string, effective_from timestamp, effective_to timestamp, is_current boolean"
    dim = Type2("k", "id", ("city",), "at")
    target = dim.unknown(spark.createDataFrame([], schema))
    batch = lambda *r: spark.createDataFrame(r, "id string, city string, at timestamp")
    one = dim.apply(target, batch(("a", "x", dt(2024, 1, 1)), ("b", None, dt(2024, 1, 1))))
    assert sorted(r[0] for r in one.select("_action").collect()) == ["INSERTED", "INSERTED", "KEPT"]
    two = dim.apply(one.drop("_action"), batch(("a", "x", dt(2024, 2, 1)), ("b", "", dt(2024, 2, 1)), ("c", "z", dt(2024, 2, 1))))
    assert sorted(r[0] for r in two.select("_action").collect()) == ["EXPIRED", "INSERTED", "INSERTED", "KEPT", "KEPT"]
    late = dim.apply(two.drop("_action"), batch(("b", "late", dt(2023, 1, 1))))
    assert {r[0] for r in late.select("_action").collect()} == {"KEPT"}
    history = two.where("id = 'b'").orderBy("effective_from").collect()
    assert history[0]["effective_to"] == history[1]["effective_from"] and [r["is_current"] for r in history] == [False, True]
    events = spark.createDataFrame([(1, "b", dt(2023, 12, 31)), (2, "b", dt(2024, 2, 1)), (3, "b", dt(2025, 1, 1)), (4, None, dt(2024, 1, 5))], "e int, bk string, at timestamp")
    got = dict(rows(version_at(events, two.drop("_action"), "bk", "id", "at", "k"), "e", "k"))
    assert got == {1: -1, 2: history[1]["k"], 3: history[1]["k"], 4: -1}
    v = two.select(F.col("id").alias("bk"), "effective_from", "k")
    assert dict(rows(last_before(events.where("e < 4"), v, "bk", "at", "effective_from", "k", "found"), "e", "found")) == {1: None, 2: got[2], 3: got[3]}


def test_money_keeps_its_type(spark):
    df = spark.createDataFrame([(Decimal("1.10"), True), (Decimal("2.20"), False), (None, None)], "m decimal(18,2), gone boolean")
    out = df.select(live_amount("m", F.col("gone")).alias("m"))
    assert out.schema["m"].dataType.simpleString() == "decimal(18,2)" and [r["m"] for r in out.collect()] == [Decimal("0.00"), Decimal("2.20"), Decimal("0.00")]
    assert [r[0] for r in spark.sql("SELECT 1 AS a, 0 AS b").select(divide(F.col("a"), F.col("b"), 0.0), divide(F.col("a"), F.col("b"))).collect()[0:1]] == [0.0]


def test_mapping(spark):
    df = spark.createDataFrame([("1", "D")], "id string, _operation_type string")
    m = Mapping.of({"source": "b", "target": "s", "columns": [{"name": "key", "source": "id"}, {"name": "is_deleted", "source": "_operation_type = 'D'"}, {"name": "none"}]})
    assert rows(project(df, m), "key", "is_deleted", "none") == [("1", True, None)]
    with pytest.raises(ValueError):
        require(df, ["id", "nope"])
    out = conform(df, StructType([StructField("id", StringType()), StructField("extra", StringType())]))
    assert out.columns == ["id", "extra"]


def test_reconcile_flags_exactly_the_defect(spark):
    fact = spark.createDataFrame([(1, "a", 10, Decimal("1.00")), (2, "b", -1, Decimal("2.00")), (3, "c", 99, Decimal("3.00"))], "id int, bk string, k int, m decimal(18,2)")
    dims = {"d": spark.createDataFrame([(10,)], "dk int")}
    suite = Suite(("id",), ("bk",), (Key("k", "d", "dk", "bk", "optional"),), metrics=("m",))
    got = {r["check"]: r for r in suite.run(fact, fact, dims)}
    assert {c for c, r in got.items() if not r["passed"]} == {"orphan", "unresolved"}
    assert got["orphan"]["bad"] == 1 and abs(got["unresolved"]["figure"] - 1 / 3) < 1e-9
    twice = {r["check"]: r["passed"] for r in suite.run(fact.unionByName(fact.where("id = 1")), fact, dims)}
    assert not twice["grain"] and not twice["row_count"] and not twice["metric"]


def test_dirty_json(spark, tmp_path):
    (tmp_path / "f.json").write_text('JSON_F5-BANNER\n[{"id":"1","reason":"Vehicle S\nold"},\n{"id":"2","x":1}]')
    schema = StructType([StructField("id", StringType()), StructField("reason", StringType())])
    assert rows(dirty_json(spark, f"file://{tmp_path}/f.json", schema), "id", "reason") == [("1", "Vehicle Sold"), ("2", None)]
    odd = "a\u2028b\u2029c\u0085[d]"
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "h.json").write_text('B\u0085\n[{"id":"1","reason":"%s"}]\u2028' % odd, encoding="utf-8")
    assert rows(dirty_json(spark, f"file://{tmp_path}/sub/h.json", schema), "id", "reason") == [("1", odd)]
    (tmp_path / "g.json").write_text("nothing here")
    with pytest.raises(Exception, match="no JSON array"):
        dirty_json(spark, f"file://{tmp_path}/g.json", schema).collect()
    assert list_files(spark, f"file://{tmp_path}") == ["f.json", "g.json"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    assert rows(read_file(spark, f"file://{tmp_path}/a.csv", "csv"), "x", "y") == [("1", "2")]
    spark.range(3).write.parquet(f"file://{tmp_path}/p")
    assert read_source(spark, {"type": "file", "format": "parquet", "location": f"file://{tmp_path}/p"}).count() == 3
    for bad in ({"type": "ftp"}, {"type": "file", "format": "xml", "location": "x"}):
        with pytest.raises(ValueError):
            read_source(spark, bad)


def test_snapshots(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    assert not t.exists()
    t.publish(spark.range(2))
    t.publish(t.read().where("id = 1"))  # reads what it replaces
    t.append(spark.range(5, 6))
    assert t.versions() == [1, 2, 3] and rows(t.read(), "id") == [(1,), (5,)] and t.read(1).count() == 2
    assert t.vacuum(1) == [1, 2] and t.versions() == [3] and rows(t.read(), "id") == [(1,), (5,)]
    t.truncate()
    assert t.read().count() == 0
    with pytest.raises(FileNotFoundError):
        t.read(1)


def test_two_publishers_of_one_version(spark, tmp_path, monkeypatch):
    """The first one's rows stay; the second is told, and its rows are in no version."""
    one, two = (SnapshotTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    one.publish(spark.range(3))
    write = SnapshotTable._write

    def slow(self, *args):
        out = write(self, *args)
        if self is two:
            one.publish(spark.range(3))  # while the other one writes
        return out

    monkeypatch.setattr(SnapshotTable, "_write", slow)
    with pytest.raises(Conflict):
        two.publish(spark.range(100, 105))
    assert rows(one.read(), "id") == [(0,), (1,), (2,)] and one.versions() == [1, 2]
    assert two.append(spark.range(9, 10)) == 4 and one.read().count() == 4  # appends go after what the other has published


def test_a_thousandth_append_reads_two_lists(spark, tmp_path, monkeypatch):
    """Many appends: few metadata files are read and few parts are left, whose rows are all there."""
    monkeypatch.setattr(snapshots, "SMALL_PARTS", 5)
    monkeypatch.setattr(snapshots, "RESTATE", 4)
    t, read = SnapshotTable(spark, f"file://{tmp_path}/t", bounded=("id",)), []
    stated = SnapshotTable._stated
    for i in range(23):
        t.append(spark.range(i, i + 1).coalesce(1))
    monkeypatch.setattr(SnapshotTable, "_stated", lambda self, name: read.append(name) or stated(self, name))
    assert ids(t.read()) == list(range(23)) and len(read) == 2
    assert len(t.version().parts) <= 6 and sum(p.rows for p in t.version().parts) == 23
    files = {f for f in t.between("id", 22, 30).inputFiles()}
    assert rows(t.between("id", 22, 30), "id") == [(22,)] and len(files) < len(t.read().inputFiles())
    assert t.read(11).count() == 11 and t.vacuum(1) == list(range(1, 23)) and t.read().count() == 23


def test_bounds_of_parts(spark, tmp_path):
    """Numbers, text, dates and times, in buckets or not; parts without a value are left out, unknown columns are not pruned by."""
    data = spark.sql("SELECT id, CAST(id * 1.5 AS DECIMAL(18,2)) AS m, date_add(DATE '2024-01-01', CAST(id AS INT)) AS d, timestamp_micros(1700000000000000 + id * 500000) AS t, concat('k', id) AS s, CAST(NULL AS INT) AS x FROM range(20)")
    for buckets in (0, 4):
        t = SnapshotTable(spark, f"file://{tmp_path}/t{buckets}", bounded=("id", "m", "d", "t", "s", "x"))
        t.publish(data, ["id"] if buckets else [], buckets)
        t.append(data.withColumns({"id": F.col("id") + 100, "s": F.lit("z")}))
        for c, low, high in (("id", 100, 200), ("m", Decimal("28.50"), Decimal("99")), ("d", date(2024, 1, 20), date(2024, 2, 1)), ("t", datetime(2023, 11, 14, 22, 13, 29, 500000), datetime(2023, 11, 14, 22, 13, 29, 500000)), ("s", "z", "zz")):
            got, want = t.between(c, low, high).count(), t.read().where(F.col(c).between(F.lit(low), F.lit(high))).count()
            assert got == want > 0
        assert len(t.fitting("id", 100, 200)) < len(t.version().parts) and t.fitting("x", 0, 9) == []
    bare = SnapshotTable(spark, f"file://{tmp_path}/bare")
    bare.publish(data)
    assert bare.between("id", 3, 4).count() == 2


def test_a_token_leaves_rows_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "SMALL_PARTS", 3)
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    for i in range(8):
        t.append(spark.range(i, i + 1), f"step{i}")
    t.append(spark.range(100, 102), "step2")  # is in a part with others by now
    assert ids(t.read()) == [0, 1, 3, 4, 5, 6, 7, 100, 101]
    t.append(spark.range(200, 201), "step2")
    t.take_back("step0")
    t.take_back("no such step")
    assert ids(t.read()) == [1, 3, 4, 5, 6, 7, 200] and t.read().columns == ["id"]


def test_merge_by_version(spark, tmp_path):
    """In whatever order rows come, the newest stays; null is before all, ties go to the greater row."""
    events = [("a", 20, "x"), ("a", 10, "y"), ("b", None, "p"), ("b", 1, "q"), ("c", 5, "m"), ("c", 5, "n"), ("d", None, "z")]
    want = {("a", 20, "x"), ("b", 1, "q"), ("c", 5, "n"), ("d", None, "z")}
    for seed in range(3):
        t = SnapshotTable(spark, f"file://{tmp_path}/t{seed}")
        for e in random.Random(seed).sample(events, len(events)):
            t.merge(spark.createDataFrame([e], "k string, at int, v string"), ["k"], 2, newest="at")
        assert {tuple(r) for r in t.read().collect()} == want


def test_append_and_merge_write_what_changes(spark, tmp_path):
    t, files = SnapshotTable(spark, f"file://{tmp_path}/t"), lambda: {p for p in tmp_path.rglob("*.parquet")}
    t.merge(spark.range(1000).selectExpr("id", "'a' AS v"), ["id"], buckets=8)
    before = files()
    t.append(spark.range(2000, 2001).selectExpr("'x' AS v", "id"))
    assert len(files() - before) == 1
    before = files()
    done = t.merge(spark.sql("SELECT 7L AS id, 'b' AS v UNION ALL SELECT 2000L, 'c'"), ["id"])
    new = files() - before
    assert len(new) <= 2 and done["updated"] == 2 and done["inserted"] == 0 and 1 <= done["kept"] < 500
    got = dict(rows(t.read(), "id", "v"))
    assert len(got) == 1001 and got[7] == "b" and got[2000] == "c" and got[8] == "a" and t.read().count() == 1001
    t.merge(spark.range(5000, 5001).selectExpr("id", "'n' AS v"), ["id"])
    assert t.read().count() == 1002 and t.read().columns == ["id", "v"]


def test_keys_where_the_first_column_is_constant(spark):
    """Ranges are cut by the whole order."""
    df = spark.range(400).selectExpr("'same' AS a", "pmod(id * 7919, 400) AS b")
    got = rows(assign_keys(df, ["a", "b"], "k", 0, range_rows=50), "b", "k")
    assert sorted(got) == [(i, i + 1) for i in range(400)]
    plan = assign_keys(df, ["a", "b"], "k", 0, range_rows=50)
    spread = [r[0] for r in plan.select(F.spark_partition_id().alias("p")).groupBy("p").count().select("count").collect()]
    assert max(spread) < 400 or len(spread) > 1


def test_rules_over_sets_of_rows(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'a', 10), (1, 'a', 20), (2, NULL, 30), (2, NULL, NULL), (3, 'b', 99) AS t(id, name, parent)")
    parents = spark.sql("SELECT * FROM VALUES (10), (10), (20), (30), (NULL) AS t(p)")
    sets = [SetRule(("id", "name"), "twice"), SetRule(("parent",), "no such parent", parents, ("p",))]
    judged = judge_sets(judge(df, [Rule("not_null", "name", "null")]).all, sets)
    got = {(r["id"], r["name"], r["parent"]): r["_reasons"] for r in judged.collect()}
    assert got == {(1, "a", 10): ["id::twice"], (1, "a", 20): ["id::twice"], (2, None, 30): ["name::null"], (2, None, None): ["name::null"], (3, "b", 99): ["parent::no such parent"]}
    assert judge_sets(judge(df.where("false"), []).all, sets).count() == 0


def test_keys_are_ranks_at_every_size(spark):
    df = spark.sql("SELECT concat('k', pmod(id * 7919, 500)) AS bk FROM range(500) UNION ALL SELECT NULL")
    one = rows(assign_keys(df, ["bk"], "k", 10), "bk", "k")
    assert one == rows(assign_keys(df, ["bk"], "k", 10, range_rows=13), "bk", "k")
    assert [k for _, k in sorted(one, key=lambda x: (x[0] is not None, x[0] or ""))] == list(range(11, 512))


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    """Rows of few buckets are not left to as few tasks."""
    from stratal.sources.snapshots import SnapshotTable

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200000")
    try:
        table = SnapshotTable(spark, str(tmp_path / "t"))
        table.publish(spark.range(0, 400_000, 1, 8).selectExpr("id", "uuid() AS v"), ["id"], 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert table.read().count() == 400_000 and len(table.read().inputFiles()) > 1


def test_keys_by_lists_of_versions_are_those_of_the_join(spark, monkeypatch):
    """A payment's customer and vehicle come by its policy: the versions of dimensions of many rows go with the policy, so that payments are dealt once."""
    from stratal.operators import facts
    from stratal.operators.facts import Bridge, Fact, Lookup, Parent

    f = Fact(
        ("id",), (), (Parent("policy", "policy", "policy", {"customer": "customer"}),), (Bridge("car", "customer", "customer", "vehicle", "vehicle"),),
        (Lookup("customer", "customer", "customer", "customer_key", None, "at"), Lookup("vehicle", "vehicle", "vehicle", "vehicle_key", None, "at")),
    )
    rows = spark.sql("SELECT id, concat('p', id % 5) AS policy, if(id % 11 = 0, NULL, timestamp_seconds(id)) AS at FROM range(100)")
    version = "SELECT concat('{0}', id % 3) AS {1}, id AS {1}_key, timestamp_seconds(10 + 20 * id) AS effective_from, timestamp_seconds(70 + 20 * id) AS effective_to FROM range(3, 6) UNION ALL SELECT '{0}0', 1, timestamp_seconds(0), timestamp_seconds(70)"
    frames = {
        "policy": spark.sql("SELECT concat('p', id) AS policy, concat('c', id) AS customer FROM range(4)"), "car": spark.sql("SELECT concat('c', id % 3) AS customer, concat('v', id) AS vehicle FROM range(5)"),
        "customer": spark.sql(version.format("c", "customer")), "vehicle": spark.sql(version.format("v", "vehicle")),
    }
    show = lambda df: sorted(map(str, df.collect()))
    joined = show(f.keyed(rows, frames))
    monkeypatch.setattr(facts, "BROADCAST_ROWS", 0)
    listed = f.keyed(rows, frames)
    assert show(listed) == joined and len({x.split("customer_key=")[1] for x in joined}) > 3
    assert "filter(" in listed._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_few_buckets_are_written_where_they_are(spark, tmp_path):
    """They are not dealt by bucket first: each task writes a file for each bucket."""
    from stratal.sources.snapshots import SnapshotTable

    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.publish(spark.range(0, 4_000, 1, 8).selectExpr("id"), ["id"], 2)
    assert len(table.read().inputFiles()) == 16 and table.read().count() == 4_000
    assert sum(table.bucket_rows({b}).count() for b in (0, 1)) == 4_000
