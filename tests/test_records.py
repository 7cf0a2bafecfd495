import pytest
from pyspark.sql import functions as F

from tagloom.operators import audit, contracts, monitor, payload, projection, summary
from tagloom.plans import build


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_first_given_takes_lists_and_single_tags(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, ["a"], "x"), (3, [], "x"), (4, None, None)], "id int, many array<string>, one string")
    field, tags = projection.first_given(df, ["gone", "many", "one"])
    assert rows(df.select("id", field.alias("f"), tags.alias("t"))) == [(1, "one", ["x"]), (2, "many", ["a"]), (3, "many", []), (4, None, [])]


def test_exclusive_negatives_and_multi_hot(spark):
    df = spark.createDataFrame([(1, [0]), (2, [0, 1]), (3, [9]), (4, None)], "id int, p array<int>")
    n = projection.exclusive_negatives(F.col("p"), {"g": [0, 1, 2], "h": [5], "i": [9, 8]})
    assert rows(df.select("id", n.alias("n"))) == [(1, [1, 2]), (2, [2]), (3, [8]), (4, [])]
    assert df.select(projection.exclusive_negatives(F.col("p"), {}).alias("n")).first().n == []
    f = spark.createDataFrame([(["a", "zz"], None), (None, ["bb"])], "x array<string>, y array<string>")
    v = projection.fields_to_vector([F.col("x"), F.col("y")], ["a", "b"], {"bb": "b"})
    assert [tuple(r.v) for r in f.select(v.alias("v")).collect()] == [(1, 0), (0, 1)]
    assert spark.range(1).select(projection.pad_vector(F.array(F.lit(1.0)), 2).alias("v")).first().v == [1.0, 0.0]


def test_computed_identity_sees_each_path_once(spark):
    df = spark.createDataFrame([("p", None), ("p", None), ("q", "s"), (None, None)], "path string, sha string").withColumn("n", F.lit(1))
    seen = []

    def compute(paths):
        seen.extend(r.path for r in paths.collect())
        return paths.select("path", F.upper("path").alias("sha"))

    assert rows(projection.with_computed(df, "path", ["sha"], compute).select("path", "sha")) == [("p", "P"), ("p", "P"), ("q", "s"), (None, None)]
    assert seen == ["p"]


def test_threshold_contract(spark):
    dim = spark.createDataFrame([(0, "pn"), (1, "pu"), (2, "unsupported"), (3, "pn")], "idx int, mode string")
    t = spark.createDataFrame([(0, "pn", 0.4, "calibrated"), (1, "pu", 0.4, "fallback_insufficient_support"), (2, "unsupported", None, "x"), (7, "pn", float("nan"), "x")], "label_idx int, mode string, threshold double, status string")
    assert rows(contracts.threshold_errors(t, dim)) == [(1, "not_the_fallback"), (3, "missing"), (7, "unknown_label")] or rows(contracts.threshold_errors(t, dim)) == [(1, "not_the_fallback"), (3, "missing"), (7, "not_a_share"), (7, "unknown_label")]


def test_payload_modes(spark):
    schema = "record_id int, label_idx int, tag string, mode string, category string, subcategory string, score double, final int"
    v = spark.createDataFrame([(1, 0, "a", "pn", "x", "s", 0.912, 1), (1, 1, "b", "unsupported", "y", "t", 0.3, 0), (2, 0, "a", "pn", "x", "s", 0.1, 0), (2, 1, "b", "unsupported", "y", "t", 0.3, 0)], schema)
    text = lambda m: dict(rows(payload.render(v, m, ["x", "y"])))
    assert text("all_scores") == {1: '{"a":"0.91","b":"0.00"}', 2: '{"a":"0.10","b":"0.00"}'}
    assert text("selected") == {1: '{"x":["a"],"y":[]}', 2: '{"x":[],"y":[]}'}
    assert text("confidence")[1] == '{"x":[{"name":"a","confidence":"0.91"}],"y":[]}'
    assert text("verification")[1] == '{"scores":[0.912,0.3]}'
    with pytest.raises(ValueError):
        payload.render(v, "other", ["x"])
    dim = v.select(F.col("label_idx").alias("idx"), "tag", "mode", "category", "subcategory").distinct()
    assert build.payload_errors(v, ["x", "y"], dim).count() == 0
    bad = spark.createDataFrame([(1, "not json"), (2, '{"a":"1"}')], "record_id int, output string")
    assert rows(payload.round_trips(bad, "map<string,string>")) == [(1, False), (2, True)]


def test_audits(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, f string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, None)], "k int, f string")
    assert rows(contracts.one_to_one(a, b, "k", ["f"])) == [(2, "other_f"), (3, "only_in_a"), (4, "only_in_b")]
    import hashlib

    assert audit.ordered_digest(a, ["k"], "k") == hashlib.sha256(b"1\n2\n3\n").hexdigest()
    assert audit.tagged_union({"v": a, "t": b.drop("f")}).where("split = 't' and f is null").count() == 3
    said = spark.createDataFrame([("p", "success"), ("q", "partial"), ("r", "fail")], "name string, status string")
    got = spark.createDataFrame([("p", "partial"), ("q", "success")], "name string, status string")
    assert rows(contracts.overclaims(said, got, "name", "status")) == [("p", "success", "partial")]
    totals = summary.grouping_totals(a.withColumn("g", F.lit("one")), "g", ["f"])
    assert {(r.dimension, r.value): r.n for r in totals.collect()} == {("rows", None): 3, ("groups", None): 1, ("merged", None): 2, ("f", "x"): 1, ("f", "y"): 1, ("f", None): 1}


def test_monitor_policies(spark):
    r = spark.range(1).select(monitor.thermal_title(F.lit("fair")).alias("a"), monitor.severity(F.lit("critical")).alias("b"), monitor.severity(F.lit("?")).alias("c"), monitor.display_mode(F.lit(False), F.lit(True)).alias("d"), monitor.visible(F.lit(True), F.lit(None).cast("string"), F.lit(1), 2).alias("e"), monitor.may_terminate(F.lit("x"), ["x"]).alias("f"), monitor.may_terminate(F.lit(None).cast("string"), ["x"]).alias("g"), monitor.may_terminate(F.lit("y"), ["x"]).alias("h")).first()
    assert tuple(r) == ("偏热", 3, None, "applications_only", False, False, False, True)


def test_build_records(spark):
    data = [("k1", "s1", 1, [0], [], [1]), ("k2", "s1", None, [], [2], []), ("k3", None, 3, [1], [], []), ("k4", "s4", 7 << 40, [0, 1], [], [0]), ("k4", "s4", 7 << 40, [0, 1], [], [0])]
    rows_ = spark.createDataFrame(data, "key string, sha string, ph long, p array<int>, u array<int>, n array<int>")
    dim = spark.createDataFrame([(0, "pn", "g"), (1, "pn", "g"), (2, "pu", None)], "idx int, mode string, excl_group string").withColumn("tag", F.lit("t"))
    b = build.build_records(rows_, {3: "p", 2: "u", 1: "n"}, dim, None, {"train": 0.8, "test": 0.2})
    assert rows(b.members) == [("k1", "k1"), ("k2", "k1"), ("k3", "k3"), ("k4", "k4")]
    comp = {r.record: r.component for r in b.records.collect()}
    assert comp == {"k1": "k1", "k3": "k1", "k4": "k4"}  # one bit apart
    assert {(r.record, r.label_idx): (r.label, r.known, r.pu) for r in b.states.collect()} == {("k1", 0): (1, 1, 0), ("k1", 1): (0, 1, 0), ("k1", 2): (1, 0, 1), ("k3", 1): (1, 1, 0)}
    assert b.leaks.count() == 0
    s = dict(rows(build.build_summary(rows_, b)))
    assert s["keys"] == 4 and s["records"] == 3 and s["merged"] == 1 and s["leaks"] == 0 and s["mutually_exclusive_positive_conflict"] == 1
    empty = build.build_records(rows_.limit(0), {3: "p", 2: "u", 1: "n"}, dim, None, {"train": 0.8, "test": 0.2})
    assert empty.records.count() == 0 and empty.states.count() == 0
