import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import audit, calibrate, cells, contracts, identity, monitor, predict, quality, resolve, sampling, splits, stratify
from tagloom.schema import LabelSchema, canonical_sha256

R = random.Random(11)


def cell_rows(n=120, labels=6, ties=True, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        for k in range(labels):
            mode = "pn" if k < 3 else "pu" if k < 5 else "unsupported"
            known = int(mode == "pn" and r.random() < 0.8)
            pu = int(mode == "pu" and r.random() < 0.3)
            label = int((known and r.random() < 0.4) or pu)
            s = r.randrange(11) / 10 if ties else r.random()
            out.append((i, k, f"t{k}", mode, "s0" if k < 3 else "s1", label, known, pu, s))
    return out


SCHEMA = "record_id long, label_idx int, tag string, mode string, subcategory string, label int, known int, pu int, score double"


def test_thresholds_against_brute_force(spark):
    data = cell_rows()
    df = spark.createDataFrame(data, SCHEMA)
    pn = {r.label_idx: r for r in calibrate.pn_thresholds(df).collect()}
    pu = {r.label_idx: r for r in calibrate.pu_thresholds(df).collect()}
    for k in range(5):
        mine = [x for x in data if x[1] == k]
        if k < 3:
            pos = [x[8] for x in mine if x[6] and x[5]]
            neg = [x[8] for x in mine if x[6] and not x[5]]
        else:
            pos = [x[8] for x in mine if x[7]]
            neg = [x[8] for x in mine if not x[6] and not x[7]]
        ge = lambda v, t: sum(s >= t for s in v)
        if k < 3:
            key = lambda t: (2 * ge(pos, t) / (ge(pos, t) + ge(neg, t) + len(pos)), -abs(t - 0.5), t)
        else:
            key = lambda t: (ge(pos, t) / len(pos) - ge(neg, t) / len(neg), ge(pos, t) / len(pos), -abs(t - 0.5), t)
        assert (pn if k < 3 else pu)[k].threshold == max({*pos, *neg, 0.5}, key=key)


def test_fallbacks(spark):
    one = [(1, 0, "t0", "pn", "s", 1, 1, 0, 0.9), (2, 0, "t0", "pn", "s", 1, 1, 0, 0.4), (1, 1, "t1", "pn", "s", 0, 0, 0, 0.4), (1, 2, "t2", "pu", "s", 1, 0, 1, 0.4), (1, 3, "t3", "unsupported", "s", 0, 0, 0, 0.4)]
    got = {r.label_idx: r for r in calibrate.all_thresholds(spark.createDataFrame(one, SCHEMA)).collect()}
    assert [got[i].threshold for i in range(4)] == [0.5, 0.5, 0.5, None]
    assert [got[i].status for i in range(4)] == ["fallback_insufficient_support"] * 3 + ["disabled_unsupported"]
    two = [(1, 0, "t0", "pn", "s", 1, 1, 0, 0.7), (2, 0, "t0", "pn", "s", 0, 1, 0, 0.3)]
    assert calibrate.pn_thresholds(spark.createDataFrame(two, SCHEMA)).first().threshold == 0.5  # of equals the nearest to 0.5


def test_concordance_and_hinge_against_all_pairs(spark):
    data = cell_rows(seed=4)
    df = spark.createDataFrame(data, SCHEMA)
    c = {r.label_idx: r.concordance for r in quality.concordance(df).collect()}
    h = {r.label_idx: r.loss for r in quality.pairwise_hinge(df, 0.3).collect()}
    for k in (3, 4):
        p = [x[8] for x in data if x[1] == k and x[7]]
        u = [x[8] for x in data if x[1] == k and not x[7]]
        assert c[k] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a in p for b in u) / len(p) / len(u))
        assert h[k] == pytest.approx(sum(max(0, 0.3 - a + b) for a in p for b in u) / len(p) / len(u))


def test_winner_of_equals_is_the_lowest_index(spark):
    data = [(1, k, f"t{k}", "pn", "s", 0, 0, 0, s) for k, s in enumerate([0.4, 0.8, 0.8, 0.7])]
    v = predict.views(spark.createDataFrame(data, SCHEMA))
    assert [(r.raw, r.final) for r in v.orderBy("label_idx").collect()] == [(0, 0), (1, 1), (1, 0), (1, 0)]


def test_macro_denominators(spark):
    # t0 has both classes, t1 only negatives, t2 no known cell
    data = [(1, 0, "t0", "pn", "a", 1, 1, 0, 0.9), (2, 0, "t0", "pn", "a", 0, 1, 0, 0.1), (1, 1, "t1", "pn", "b", 0, 1, 0, 0.1), (1, 2, "t2", "pn", "c", 0, 0, 0, 0.9)]
    r = quality.micro_macro(predict.views(spark.createDataFrame(data, SCHEMA)), "final").first()
    assert (r.labels_evaluated, r.labels_with_both_classes, r.labels_with_positives) == (2, 1, 1)
    assert (r.macro_f1, r.macro_f1_both_classes, r.macro_recall_with_positives, r.f1) == (0.5, 1.0, 1.0, 1.0)
    empty = quality.micro_macro(predict.views(spark.createDataFrame([], SCHEMA)), "final").first()
    assert empty.f1 == 0.0 and empty.macro_f1_both_classes == 0.0


def test_illegal_cells(spark):
    bad = [(1, 0, "t", "pn", "s", 1, 1, 1, 0.0), (2, 0, "t", "pu", "s", 0, 1, 0, 0.0), (3, 0, "t", "pu", "s", 0, 0, 1, 0.0), (4, 0, "t", "pn", "s", 1, 0, 0, 0.0), (5, 0, "t", "unsupported", "s", 0, 1, 0, 0.0), (6, 0, "t", "pn", "s", 1, 1, 0, 0.0)]
    got = collections.defaultdict(set)
    for r in cells.illegal(spark.createDataFrame(bad, SCHEMA)).collect():
        got[r.record_id].add(r.rule)
    assert got == {1: {"masks_overlap", "pu_outside_pu"}, 2: {"known_outside_pn"}, 3: {"pu_without_label"}, 4: {"unknown_not_neutral"}, 5: {"known_outside_pn", "unsupported_supervised"}}


def test_vectors_round_trip(spark):
    dim = spark.createDataFrame([(i, f"t{i}", "pn") for i in range(3)], "idx int, tag string, mode string")
    df = spark.createDataFrame([("r", [1, 0, 1], [1, 1, 0])], "record_id string, labels array<int>, known array<int>")
    long = cells.from_vectors(df, dim, ["record_id"], {"label": "labels", "known": "known"})
    assert long.count() == 3
    back = cells.to_vectors(long, ["record_id"], ["label", "known"]).first()
    assert (back.label, back.known) == ([1, 0, 1], [1, 1, 0])
    t = spark.createDataFrame([(["true", "0.0", "1"],), (["1", "0"],), (["2", "0", "1"],), (None,)], "a array<string>")
    assert [r[0] for r in t.select(cells.binary_vector(F.col("a"), 3)).collect()] == [[1, 0, 1], [1, 0, 0], None, None]


def test_components(spark):
    for seed in range(3):
        r = random.Random(seed)
        names = [f"n{i:03d}" for i in r.sample(range(999), 150)]
        pairs = list(itertools.pairwise(names[:70])) + [(names[80], x) for x in names[81:110]] + [(r.choice(names), r.choice(names)) for _ in range(30)]
        up = {}

        def find(x, up=up):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in pairs:
            if a != b:
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
        got = dict(map(tuple, identity.components(spark.createDataFrame(pairs, "a string, b string")).collect()))
        assert got == {x: find(x) for x in up}
    assert identity.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_near_pairs_and_exact_groups(spark):
    base = [R.getrandbits(64) for _ in range(60)]
    v = base + [x ^ (1 << R.randrange(64)) for x in base[:30]] + [x ^ 3 for x in base[:10]] + [x ^ 7 for x in base[:10]]
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(sign(x),) for x in v] + [(None,)], "h long")
    got = {frozenset((r.h_a, r.h_b)) for r in identity.near_pairs(df, "h", 2).collect()}
    s = sorted({*map(sign, v)})
    assert got == {frozenset(p) for p in itertools.combinations(s, 2) if bin((p[0] ^ p[1]) & (2**64 - 1)).count("1") <= 2}
    rows = spark.createDataFrame([("a", "1", None), ("b", "1", "x"), ("c", "2", "x"), ("d", None, None), ("e", None, None)], "key string, sha string, ph string")
    assert dict(map(tuple, identity.exact_groups(rows, "key", {"s": F.col("sha"), "p": F.col("ph")}).collect())) == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


def test_resolve(spark):
    dim = spark.createDataFrame([(0, "a", "pn", "g"), (1, "b", "pn", "g"), (2, "c", "pn", None), (3, "d", "pu", None), (4, "e", "unsupported", None)], "idx int, tag string, mode string, excl_group string")
    rows = spark.createDataFrame([("x", [0], [], []), ("x", [1], [], [2]), ("y", [2], [], [0]), ("y", [], [3], [2]), ("z", [4], [], [2])], "g string, pn array<int>, pu array<int>, ng array<int>")
    cl = resolve.claims(rows, "g", {3: "pn", 2: "pu", 1: "ng"})
    rules = spark.createDataFrame([("r1", 2, "known_present", 1), ("r2", 0, "known_absent", 3), ("r3", 2, "present", 0)], "rule string, if_idx int, if_state string, then_idx int")
    states, notes = resolve.resolve(cl, "g", dim, rules)
    got = {(r.g, r.label_idx): (r.label, r.known, r.pu) for r in states.collect()}
    assert got == {("x", 2): (0, 1, 0), ("y", 0): (0, 1, 0), ("y", 1): (0, 1, 0), ("y", 2): (1, 1, 0), ("y", 3): (1, 0, 1), ("z", 2): (0, 1, 0)}
    assert {(r.g, r.kind, r.label_idx) for r in notes.collect()} == {("x", "mutually_exclusive_positive_conflict", None), ("y", "positive_overrode_negative", 2), ("y", "positive_overrode_implication_negative", 3)}


def test_apportion_and_component_split(spark):
    shares = {"train": 0.8, "val": 0.1, "test": 0.1}
    assert splits.apportion(10, shares) == {"train": 8, "val": 1, "test": 1}
    assert splits.apportion(3, shares) == {"train": 1, "val": 1, "test": 1}
    assert splits.apportion(1, shares) == {"train": 1, "val": 0, "test": 0}
    r = random.Random(3)
    sizes = [r.choice([1, 1, 1, 2, 5]) for _ in range(400)] + [250]  # one component has a third of the rows
    labels = [sorted(r.sample(range(8), r.randrange(3))) for _ in sizes]
    df = spark.createDataFrame([(f"c{i}", ls) for i, (n, ls) in enumerate(zip(sizes, labels)) for _ in range(n)], "c string, l array<int>")
    put = {x.c: x.split for x in splits.split_components(df, "c", "l", shares, 1).collect()}
    assert set(put) == {f"c{i}" for i in range(401)}
    n = sum(sizes)
    for s, x in shares.items():
        assert abs(sum(k for i, k in enumerate(sizes) if put[f"c{i}"] == s) - n * x) <= 0.02 * n + 1
        for j in range(8):
            have = [i for i, ls in enumerate(labels) if j in ls]
            assert abs(sum(put[f"c{i}"] == s for i in have) - len(have) * x) <= max(2.5, 0.03 * len(have))
    assert put == {x.c: x.split for x in splits.split_components(df.repartition(7), "c", "l", shares, 1).collect()}
    assert splits.split_components(df.limit(0), "c", "l", shares).count() == 0
    for bad in ({"a": 0.5}, {"a": 1.2, "b": -0.2}, {}):
        with pytest.raises(ValueError):
            splits.check_shares(bad)


@pytest.mark.parametrize("n, weight", [(3, 1.0), (500, 1.0), (500, 3.0), (77, 0.5)])
def test_equal_groups_are_placed_as_if_one_by_one(n, weight):
    need, rows = np.array([400.0, 50.0, 49.5]), np.array([300.0, 60.0, 60.0])
    got = stratify.fill(need, rows, rows * 0 + 1e9, n, weight, 1.0)
    one = np.zeros(3, int)
    for _ in range(n):
        s = max(range(3), key=lambda i: (need[i] - one[i] * weight, rows[i] - one[i]))
        one[s] += 1
    assert got.sum() == n and (abs(got - one) <= 1).all()
    assert stratify.fill(need, rows, np.array([10.0, 1e9, 1e9]), n, weight, 1.0)[0] <= 10


def test_labels_go_by_what_is_left(spark):
    # b is rarer than c at first, but c is rarest once the groups of a are gone
    vec = lambda *ls: [(j, 1) for j in ls]
    groups = [(f"x{i}", 1, vec(0, 2)) for i in range(3)] + [(f"y{i}", 1, vec(1)) for i in range(4)] + [(f"z{i}", 1, vec(1, 2)) for i in range(2)]
    rounds = {(0, 0): 3, (0, 2): 3, (1, 1): 2, (1, 2): 2, (2, 1): 4}
    assert stratify.guess_order({0: 3, 1: 6, 2: 5}, [dict(v) for _, _, v in groups]) == [0, 2, 1]
    assert stratify.guess_order({0: 3, 1: 6, 2: 5}, [], [1]) == [1, 0, 2]
    assert stratify.confirm_order([0, 2, 1], 0, {0: 3, 1: 6, 2: 5}, rounds)[0] == 3
    assert stratify.confirm_order([0, 1, 2], 0, {0: 3, 1: 6, 2: 5}, {(0, 0): 3, (0, 2): 3, (1, 1): 6, (1, 2): 2})[0] == 1
    df = spark.createDataFrame(groups, "g string, size long, vec array<struct<label:int,n:long>>")
    put = collections.Counter(r.split for r in stratify.stratify(df, "g", {"a": 0.5, "b": 0.5}).collect())
    assert sum(put.values()) == 9 and abs(put["a"] - put["b"]) <= 1


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = splits.positions(df, ["k"], buckets=16).orderBy("k").collect()
    assert [r.position for r in got] == list(range(1000))
    assert splits.stride(df, ["k"], 3).where("rank = 2").count() == 333
    odd = spark.createDataFrame([(0.5,), (None,), (float("nan"),), (2.0,), (1.0,)], "k double")
    assert [r.position for r in splits.positions(odd, ["k"]).orderBy("k").collect()] == [0, 1, 2, 3, 4]
    assert {r.position for r in splits.positions(odd, ["k"]).where("isnan(k)").collect()} == {4}
    text = spark.createDataFrame([(f"s{i % 3}" if i % 5 else None, i) for i in range(60)], "s string, i int")
    got = splits.positions(text, ["s", "i"], buckets=8).orderBy("s", "i").collect()
    assert [r.position for r in got] == list(range(60))
    assert splits.positions(text.limit(0), ["s"]).count() == 0


def test_samples_do_not_depend_on_order(spark):
    df = spark.range(300).select("id", (F.col("id") % 5).alias("g"))
    strata = [F.col("g") == 4, F.col("g") == 4, F.col("g") == 9]
    a = sampling.stratified_sample(df, "id", strata, 10, 3).orderBy("pick").collect()
    b = sampling.stratified_sample(df.repartition(7), "id", strata, 10, 3).orderBy("pick").collect()
    assert a == b and [r.g for r in a[:2]] == [4, 4] and len(a) == 10
    assert len(sampling.stratified_sample(df, "id", strata, 1, 3).collect()) == 2  # strata may exceed the count
    assert sampling.stratified_sample(df.limit(0), "id", strata, 3, 3).count() == 0


def test_schedule(spark):
    cand = {0: {i: 1.0 for i in range(5)}, 1: {7: 2.0}, 2: {i: 1.0 + 8 * (i == 20) for i in range(20, 40)}}
    records = spark.range(40).select(F.col("id").cast("int").alias("record_index"))
    pairs = spark.createDataFrame([(j, i, w) for j, c in cand.items() for i, w in c.items()], "label int, record_index int, weight double")
    s = sampling.two_stream_schedule(records, pairs, 2, 3, 2, 5)
    rows = [tuple(r) for r in s.rows.orderBy("global_batch", "slot").collect()]
    again = sampling.two_stream_schedule(records.repartition(5), pairs.repartition(3), 2, 3, 2, 5).rows
    assert rows == [tuple(r) for r in again.orderBy("global_batch", "slot").collect()]
    assert sampling.schedule_digest(s.rows).collect() == sampling.schedule_digest(again).collect()
    assert s.batches == 7 and [r[:2] for r in rows] == [(b, i) for b in range(7) for i in range(10)]
    for b in range(7):
        batch = [r for r in rows if r[0] == b]
        assert len({r[2] for r in batch}) == 10 and [r[3] for r in batch] == 2 * (3 * ["uniform"] + 2 * ["balanced"])
    uni = [r for r in rows if r[3] == "uniform"]
    assert sorted(r[2] for r in uni if not r[5]) == list(range(40)) and sum(r[5] for r in uni) == 2
    bal = [r for r in rows if r[3] == "balanced"]
    assert all(r[2] in cand[r[4]] if not r[6] else r[4] is None for r in bal)
    turns = collections.Counter(r[4] for r in bal)
    assert turns[0] == 10 and turns[2] == 9 and turns[1] + turns[None] == 9 and turns[1] >= 5
    heavy = sum(r[2] == 20 for r in bal)
    assert heavy >= 2  # 9 of 28 parts of the weight
    alone = sampling.two_stream_schedule(records, pairs.limit(0), 2, 3, 1, 5).rows.where("stream = 'balanced'").collect()
    assert len(alone) == 14 and all(r.fallback for r in alone)
    with pytest.raises(ValueError):
        sampling.two_stream_schedule(records.limit(7), pairs, 2, 3, 1, 5)


def test_monitor(spark):
    ev = spark.createDataFrame([("p", 1, 90.0), ("p", 2, 91.0), ("p", 3, 10.0), ("p", 4, 81.0), ("q", 1, None), ("q", 2, 85.0)], "k string, t int, v double")
    got = {(r.k, r.t): (r.run, r.sustained) for r in monitor.breach_runs(ev, "k", ["t"], "v", 80.0).collect()}
    assert got == {("p", 1): (1, False), ("p", 2): (2, True), ("p", 3): (0, False), ("p", 4): (1, False), ("q", 1): (0, False), ("q", 2): (1, False)}
    at = spark.createDataFrame([("p", s) for s in (0, 599, 600, 1199, 1200)] + [("q", 5)], "k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r.k, r.s) for r in monitor.cooldown(at, "k", "ts", F.lit(True)).collect()) == [("p", 0), ("p", 600), ("p", 1200), ("q", 5)]
    beats = spark.createDataFrame([("p", 100.0), ("p", 114.9), ("p", 129.9)], "k string, s double").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.last_beat.timestamp() for r in monitor.heartbeat_gaps(beats, "k", "ts", 15.0).collect()) == [114.9, 129.9]
    cpu = spark.createDataFrame([("p", 0, 1.0), ("p", 10, 3.0), ("p", 20, 2.0), ("p", 20, 2.0)], "k string, s int, c double").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted((r.percent for r in monitor.delta_percent(cpu, "k", "ts", "c").collect()), key=str) == [0.0, 0.0, 20.0, None]
    paths = spark.createDataFrame([("/a/b.app/x", 1.0), ("/a/b.app", 2.0), ("/a/b.application", 4.0), (None, 8.0)], "path string, v double")
    b = spark.createDataFrame([("/a/b.app",), ("/a/b.app/",), ("/none",)], "bundle string")
    assert {r.bundle: (r.n, r.total) for r in monitor.prefix_rollup(paths, "path", "v", b, "bundle").collect()} == {"/a/b.app": (2, 3.0), "/a/b.app/": (2, 3.0), "/none": (0, 0.0)}


def test_contracts_and_audits(spark):
    df = spark.createDataFrame([("a", [0.1, 0.2]), ("b", [0.1, float("nan")]), ("c", [1.5]), ("d", None)], "id string, s array<double>")
    rules = contracts.score_constraints("s", 2)
    got = {(r.name, r.key) for r in contracts.violations(df, rules, "id").collect()}
    assert got == {("score_not_finite", "b"), ("score_width", "c"), ("score_out_of_range", "c"), ("score_width", "d"), ("score_out_of_range", "b")} or got == {("score_not_finite", "b"), ("score_width", "c"), ("score_out_of_range", "c"), ("score_width", "d")}
    with pytest.raises(contracts.ContractError, match="score_width: 2 rows"):
        contracts.require(df, rules, "id")
    assert contracts.require(df.where("id = 'a'"), rules, "id").count() == 1
    a = spark.createDataFrame([("m", 1.0), ("n", 2.0), ("o", None)], "metric string, value double").withColumn("k", F.lit(1))
    b = spark.createDataFrame([("m", 1.0 + 1e-13), ("n", 2.1), ("o", None), ("p", 1.0)], "metric string, value double").withColumn("k", F.lit(1))
    assert {r.metric for r in audit.crosscheck(a, b, ["k"]).collect()} == {"n", "p"}
    st = spark.createDataFrame([("success",), ("partial",)], "s string")
    assert audit.worst(st, "s").first().verdict == "partial" and audit.worst(st.limit(0), "s").first().verdict == "success"


def _schema():
    d = {"schema_version": "1", "num_labels": 3, "labels": ["a", "b", "c"], "label_training_modes": {"a": "pn", "b": "pu", "c": "unsupported"}, "unsupported_labels": ["c"], "semantic_categories": {"k": {"s": ["a", "b"]}, "m": {"t": ["c"]}}, "safe_mutual_exclusion_groups": {"g": ["a"]}}
    return d | {"schema_sha256": canonical_sha256(d)}


def test_schema(spark):
    s = LabelSchema.from_json(_schema())
    assert [tuple(r) for r in s.label_dim(spark).collect()] == [(0, "a", "pn", "k", "s", "g"), (1, "b", "pu", "k", "s", None), (2, "c", "unsupported", "m", "t", None)]
    for change in ({"labels": ["a", "a", "c"]}, {"num_labels": 4}, {"unsupported_labels": []}, {"semantic_categories": {"k": {"s": ["a"]}}}, {"schema_sha256": "0"}, {"safe_mutual_exclusion_groups": {"g": ["z"]}}):
        with pytest.raises(ValueError):
            LabelSchema.from_json(_schema() | change)
