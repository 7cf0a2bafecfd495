import collections
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from tagloom.llm import abuse, consensus, cooccur, crosssplit, fusion, groupsplit, matchgroups, mixture, quota, tokenizer
from tagloom.llm._common import spread_rank

rng = random.Random(5)
needs_vocabulary = pytest.mark.skipif(not os.path.exists(f"{tokenizer.TOKENIZERS}/byte_bpe_50k.json"), reason="no vocabulary files")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# shared ---------------------------------------------------------------------------------------------------------------


def test_spread_rank_matches_a_window_even_for_one_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("x").alias("g"), "id", F.lit(1).alias("_n"))
    got = spread_rank(df, ["g"], [F.xxhash64("id"), F.col("id")], "r", buckets=16)
    per = collections.defaultdict(list)
    for r in got.collect():
        per[r.g].append(r.r)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in per.values())
    weighted = spread_rank(df, ["g"], [F.xxhash64("id"), F.col("id")], "s", buckets=16, weight=F.col("_n") * 2).where("g = 'x'")
    assert sorted(r.s for r in weighted.collect()) == [2 * i for i in range(len(per["x"]))]


# 1 --------------------------------------------------------------------------------------------------------------------


def _brute(baskets):
    pairs, one = collections.Counter(), collections.Counter()
    for (kind, _), items in baskets.items():
        one.update((kind, i) for i in items)
        pairs.update((kind, *p) for p in itertools.combinations(sorted(items), 2))
    return pairs, one


@pytest.mark.parametrize("vocabulary", [60, None])
def test_pair_counts_against_brute_force(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(cooccur, "BLOCK_ITEMS", 100 if vocabulary else 7)  # unknown vocabulary: most baskets are cut into blocks
    monkeypatch.setattr(cooccur, "RUN_CODES", 50)
    baskets = {(k, b): {rng.randrange(40) for _ in range(rng.randrange(1, 30))} for k in (0, 1) for b in range(60)}
    data = [(k, b, i) for (k, b), s in baskets.items() for i in s for _ in range(rng.randrange(1, 3))]
    data += [(None, 1, 1), (0, None, 1), (0, 1, None)]
    df = spark.createDataFrame(data, "kind int, basket long, item int").withColumn("n", F.lit("clash")).repartition(5)
    counts = cooccur.pair_counts(df, vocabulary=vocabulary)
    pairs, one = _brute(baskets)
    got = {(r.kind, r.label_a, r.label_b): r.n for r in counts.collect()}
    assert {k: v for k, v in got.items() if k[1] is not None and k[1] < k[2]} == dict(pairs)
    assert {(k, a): v for (k, a, b), v in got.items() if a is not None and a == b} == dict(one)
    assert {k: v for (k, a, _), v in got.items() if a is None} == {0: 60, 1: 60}
    for r in cooccur.association(counts).limit(20).collect():
        a, b, n, x = r.n_a, r.n_b, r.n_baskets, r.n_ab
        assert r.lift == pytest.approx(x * n / (a * b))
        assert r.odds_ratio == pytest.approx((x + 0.5) * (n - a - b + x + 0.5) / ((a - x + 0.5) * (b - x + 0.5)))
    far = {(r.kind, r.label_a, r.label_b) for r in cooccur.beyond_chance(cooccur.association(counts), 5, 1).collect()}
    assert far == {(k, a, b) for (k, a, b), x in pairs.items() if x >= 5 and x * 60 >= one[k, a] * one[k, b]}


def test_pair_counts_of_nothing_and_of_bad_ids(spark):
    empty = spark.createDataFrame([], "kind int, basket long, item int")
    assert cooccur.association(cooccur.pair_counts(empty, vocabulary=5)).count() == 0
    assert cooccur.association(cooccur.pair_counts(empty)).count() == 0
    with pytest.raises(Exception, match="item ids"):
        cooccur.pair_counts(spark.createDataFrame([(0, 1, -4)], "kind int, basket long, item int"), vocabulary=5).collect()


# 2 --------------------------------------------------------------------------------------------------------------------


def test_unmet_quota_goes_to_siblings_then_cousins():
    leaf = lambda p, ppm, n, least=0: {"path": p, "ppm": ppm, "least": least, "rows": n}
    x = quota.allocate([leaf(("a", "1"), 250_000, 10), leaf(("a", "2"), 250_000, 1000), leaf(("b", "1"), 250_000, 1000), leaf(("b", "2"), 250_000, 1000)], 400)
    assert [i["quota"] for i in x] == [10, 190, 100, 100]
    x = quota.allocate([leaf(("a", "1"), 250_000, 10), leaf(("a", "2"), 250_000, 120), leaf(("b", "1"), 500_000, 1000)], 400)
    assert [i["quota"] for i in x] == [10, 120, 270]
    x = quota.allocate([leaf(("a", "1"), 0, 10, 5), leaf(("a", "2"), 1_000_000, 1000)], 100)
    assert [i["quota"] for i in x] == [5, 95]


def test_draw(spark):
    data = [(i, 1 if i < 3000 else 2 if i < 3040 else None if i < 3100 else 9, "c") for i in range(3200)]
    df = spark.createDataFrame(data, "id long, cat int, _quota string")
    targets = spark.createDataFrame([(1, 500_000, 3, "x"), (2, 500_000, 3, "x"), (3, 0, 5, None)], "cat int, target_ppm int, min_rows int, top string")
    got = quota.draw_to_targets(df, "cat", ["id"], targets, ["top"], one_in=10)
    report = {r.cat: r for r in got.report.collect()}
    assert (report[1].rows, report[2].rows, report[3].rows) == (3000, 40, 0)
    assert (report[1].below_share, report[2].below_share, report[3].below_min) == (False, True, True)
    s = got.sample.collect()
    assert collections.Counter(r.cat for r in s) == {1: report[1].quota, 2: 40} and len({r.id for r in s}) == len(s)
    assert sum(r.quota for r in report.values()) == 320
    assert s[0].asDict().keys() == {"id", "cat", "_quota"}
    none = quota.draw_to_targets(df.limit(0), "cat", ["id"], targets, ["top"])
    assert none.sample.count() == 0 and {r.quota for r in none.report.collect()} == {0}


# 3 --------------------------------------------------------------------------------------------------------------------


def _annotations(n_items=250, seed=3):
    r = random.Random(seed)
    good = {"a": 0.95, "b": 0.9, "c": 0.85, "spam": 0.5, "liar": 0.1}
    truth, out = {}, []
    for i in range(n_items):
        asked = r.sample(range(6), 3)
        for lab in asked:
            truth[i, lab] = r.random() < 0.3 + 0.08 * lab
        for who, p in good.items():
            said = {lab: truth[i, lab] if r.random() < p else not truth[i, lab] for lab in asked}
            out.append((f"i{i}", who, [x for x in asked if said[x]], [x for x in asked if not said[x]]))
    return truth, out


def test_consensus_beats_the_majority_and_finds_the_liar(spark):
    truth, data = _annotations()
    data += data[:40]  # delivered again
    df = spark.createDataFrame(data, "item string, who string, pos array<int>, neg array<int>").withColumn("label", F.lit("clash"))
    got = consensus.consensus(df, "item", "who", {"pos": (F.col("pos"), 1), "neg": (F.col("neg"), 2)}, {i: 0 for i in range(6)}, [F.lit("same")])
    lab = got.labels.collect()
    right = sum((r.probability > 0.5) == truth[int(r.item[1:]), r.label_idx] for r in lab) / len(lab)
    majority = sum((r.n_present > r.n_absent) == truth[int(r.item[1:]), r.label_idx] for r in lab) / len(lab)
    assert right > 0.95 and right > majority + 0.03
    rel = {r.annotator: r.reliability for r in got.annotators.where("mode = 'pn'").collect()}
    assert rel["liar"] < 0.25 and 0.35 < rel["spam"] < 0.65 and rel["a"] > 0.85
    assert {r.n_annotators for r in got.items.collect()} == {5}


def test_consensus_edges(spark):
    schema = "item string, who string, pos array<int>, neg array<int>"
    df = spark.createDataFrame([("x", "p", [1, 1], [1]), ("x", "q", None, None), (None, "q", [1], []), ("y", None, [1], [])], schema)
    run = lambda d: consensus.consensus(d, "item", "who", {"pos": (F.col("pos"), 1), "neg": (F.col("neg"), 2)}, {0: 0, 1: 0}, rounds=2)
    r = run(df).labels.collect()
    assert [(x.item, x.label_idx, x.n_present, x.n_absent, x.n_open) for x in r] == [("x", 1, 0, 0, 2)]  # said both ways: left open
    none = run(df.limit(0))
    assert none.labels.count() == none.items.count() == none.annotators.count() == 0


def test_a_label_that_its_namer_also_denies_is_found(spark, tmp_path):
    from tagloom.llm import queries

    data = [(f"s:r{i}:0", who, ["a"], ["a"] if who == "c" else []) for i in range(30) for who in "abc"] + [(f"s:z{i}:0", "c", ["a"], ["a"]) for i in range(10)]
    data += [("s:n:0", "c", [], ["a"])]
    df = spark.createDataFrame(data, "item_key string, annotator_id string, pn_positive array<string>, pn_negative array<string>").withColumn("pu_positive", F.array().cast("array<string>"))
    df.write.parquet(f"{tmp_path}/annotation.parquet")
    spark.createDataFrame([(0, "a", "pn", "x")], "idx int, tag string, mode string, category string").write.parquet(f"{tmp_path}/label_dim.parquet")
    spark.createDataFrame([], "alias string, tag string").write.parquet(f"{tmp_path}/tag_alias.parquet")
    assert {r.item_key for r in queries.p3_found(spark, str(tmp_path)).collect()} == {d[0] for d in data} - {"s:n:0"}


# 4 --------------------------------------------------------------------------------------------------------------------


def test_fusion_discounts_copied_false_values(spark):
    r = random.Random(1)
    data = []
    for i in range(400):
        t = f"v{i}"
        data += [(f"g{i}", f"k{i}a", "good1", t if r.random() < 0.9 else f"w{r.random()}"), (f"g{i}", f"k{i}b", "good2", t if r.random() < 0.9 else f"w{r.random()}")]
        bad = t if r.random() < 0.4 else f"bad{i}"
        data += [(f"g{i}", f"k{i}{s}", s, bad) for s in ("copy1", "copy2", "copy3")]
    df = spark.createDataFrame(data, "g string, key string, source string, value string").withColumn("at", F.timestamp_seconds(F.lit(0))).withColumn("best", F.lit(1))
    sources = spark.createDataFrame([("good1", 1), ("good2", 2), ("copy1", 3), ("copy2", 4), ("copy3", 5)], "source string, trust_rank int")
    fields = {"value": F.col("value")}
    best, model = fusion.best_records(df, "g", "key", "source", sources, "at", fields, fields)
    acc = dict(zip(model.names, model.accuracy))
    assert acc["good1"] > 0.8 and acc["copy1"] < 0.6
    out = fusion.fused_values(df, best, "g", fields).collect()
    assert sum(x.best_value == "v" + x.g[1:] for x in out) / len(out) > 0.9  # three copies never outvote two


def test_fusion_takes_more_sources_than_a_word_has_bits(spark):
    r = random.Random(7)
    names = [f"s{i:03d}" for i in range(150)]
    right = {n: 0.95 if i % 3 else 0.4 for i, n in enumerate(names)}
    data = [(f"g{g}", f"k{g}-{n}", n, "v" if r.random() < right[n] else f"w{r.randrange(9)}") for g in range(150) for n in r.sample(names, 12)]
    df = spark.createDataFrame(data, "g string, key string, source string, value string").withColumn("at", F.timestamp_seconds(F.lit(0)))
    sources = spark.createDataFrame([(n, 1) for n in names], "source string, trust_rank int")
    best, model = fusion.best_records(df, "g", "key", "source", sources, "at", {"value": F.col("value")}, {"value": F.col("value")})
    acc = dict(zip(model.names, model.accuracy))
    mean = lambda x: sum(acc[n] for n in names if right[n] == x) / sum(right[n] == x for n in names)
    assert mean(0.95) > 0.8 > 0.6 > mean(0.4) and acc["s149"] > 0.7
    out = fusion.fused_values(df, best, "g", {"value": F.col("value")})
    assert out.where("best_value = 'v'").count() >= 148


def test_survivor_is_the_dominating_key_or_none_is_clear(spark):
    r = random.Random(2)
    opts = [None, "x"]
    data = [(f"g{r.randrange(60)}", f"k{i}", r.choice(["a", "b", None]), r.choice(opts), r.choice(opts), r.choice([0, 0, 5, None])) for i in range(200)]
    data += data[:30] + [(None, "k", "a", "x", "x", 1), ("g1", None, "a", "x", "x", 1)]
    df = spark.createDataFrame(data, "g string, key string, source string, u string, v string, at long").withColumn("at", F.timestamp_seconds("at"))
    sources = spark.createDataFrame([("a", 1), ("b", 2)], "source string, trust_rank int")
    fields = {"u": F.col("u"), "v": F.col("v")}
    best, _ = fusion.best_records(df, "g", "key", "source", sources, "at", fields, fields | {"source": F.col("source")})
    got = {x.g: x.key for x in best.where("clear").collect()}
    groups = collections.defaultdict(dict)
    for g, k, s, u, v, at in data:
        if g and k:
            groups[g][k] = ((s is not None, u is not None, v is not None), {"a": 1, "b": 2}.get(s, 9), -1 if at is None else at)
    want = {}
    for g, ks in groups.items():
        for k, (p, t, at) in ks.items():
            others = [x for n, x in ks.items() if n != k]
            if others and all(all(a >= b for a, b in zip(p, q)) and t <= tt and at >= aa and (p != q or t < tt or at > aa) for q, tt, aa in others):
                want[g] = k
    assert got == want
    assert best.limit(0).count() == 0 and fusion.best_records(df.limit(0), "g", "key", "source", sources.limit(0), "at", fields, fields)[0].count() == 0


# 5 --------------------------------------------------------------------------------------------------------------------


def _components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "both"])
def test_groups_against_union_find(spark, shape):
    names = [f"n{rng.randrange(10**6):06d}" for _ in range(300)]
    chain = list(itertools.pairwise(names[:120]))
    star = [(names[150], x) for x in names[151:250]]
    wild = [(rng.choice(names), rng.choice(names)) for _ in range(150)]
    pairs = {"chain": chain, "star": star, "random": wild, "both": chain + star + wild}[shape]
    rng.shuffle(pairs)
    data = [p if rng.random() < 0.5 else p[::-1] for p in pairs] + pairs[:10] + [("self", "self"), (None, "x"), ("x", None)]
    df = spark.createDataFrame(data, "key_a string, key_b string").withColumn("v", F.lit(1))
    assert rows(matchgroups.group_links(df)) == sorted(_components([p for p in pairs if p[0] != p[1]]).items())


def test_a_hash_collision_is_seen_and_avoided(spark, monkeypatch):
    real = matchgroups._hash
    monkeypatch.setattr(matchgroups, "_hash", lambda name, seed: F.lit(1).cast("bigint") + F.length(name) if seed == 0 else real(name, seed))
    df = spark.createDataFrame([("a", "b"), ("c", "dd")], "key_a string, key_b string")
    assert rows(matchgroups.group_links(df)) == [("a", "a"), ("b", "a"), ("c", "c"), ("dd", "c")]


def test_no_links_and_star_links(spark):
    assert matchgroups.group_links(spark.createDataFrame([], "key_a string, key_b string")).count() == 0
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 1), ("c", 1), ("d", 2), ("e", None), (None, 1)], "key string, h long")
    assert rows(matchgroups.star_links(df, "key", "h")) == [("a", "b"), ("a", "c")]


# 6 --------------------------------------------------------------------------------------------------------------------


def _edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_segment_join_loses_no_pair(spark, k):
    base = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 14))) for _ in range(60)]

    def mutate(s):
        s = list(s)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(s) + 1)
            op = rng.randrange(3)
            s[i : i + (op != 1)] = rng.choice("abc") if op else ""
        return "".join(s)

    other = [mutate(s) for s in base]
    df = lambda v: spark.createDataFrame([(x,) for x in v] + [(None,)], "value string")
    got = set(map(tuple, crosssplit.near_values(df(base), df(other), k).collect()))
    assert got == {(a, b) for a in set(base) for b in set(other) if _edit(a, b) <= k}


def test_segments_of_fixed_length(spark):
    base = ["".join(rng.choice("01") for _ in range(16)) for _ in range(150)]
    other = ["".join(rng.choice("01") for _ in range(16)) for _ in range(150)]
    df = lambda v: spark.createDataFrame([(x,) for x in v], "value string")
    got = set(map(tuple, crosssplit.near_values(df(base), df(other), 2, length=16).collect()))
    assert got == {(a, b) for a in set(base) for b in set(other) if _edit(a, b) <= 2}


def test_aligned_segments_find_every_pair_of_substitutions(spark):
    base = [[rng.choice("0123456789abcdef") for _ in range(16)] for _ in range(80)]

    def mutate(v):
        v = list(v)
        for i in rng.sample(range(16), rng.randrange(4)):
            v[i] = rng.choice("0123456789abcdef")
        return "".join(v)

    other = [mutate(v) for v in base for _ in range(3)]
    base = ["".join(v) for v in base]
    df = lambda v: spark.createDataFrame([(x,) for x in v] + [(None,)], "value string")
    far = lambda a, b: sum(x != y for x, y in zip(a, b))
    for together in (1, 2, 3):
        got = set(map(tuple, crosssplit.near_values(df(base), df(other), 2, length=16, aligned=True, together=together).collect()))
        assert got >= {(a, b) for a in set(base) for b in set(other) if far(a, b) <= 2}
        assert all(_edit(a, b) <= 2 for a, b in got)
    with pytest.raises(ValueError):
        crosssplit.near_values(df(base), df(other), 2, aligned=True)


def test_overlaps(spark):
    data = [("t1", "train", "s1", "0" * 16), ("t2", "train", None, "f" * 16), ("v1", "eval", "s1", "0" * 15 + "3"), ("v2", "eval", None, "0" * 14 + "10"), ("v3", None, "s1", "0" * 16), (None, "train", "s1", None), ("v1", "eval", "s1", None), ("t3", "train", "s1", "1" * 16), ("t1", "train", "s1", "0" * 16)]
    df = spark.createDataFrame(data, "key string, side string, sha string, h string").withColumn("k", F.lit("clash")).withColumn("by", F.lit(0)).withColumn("train", F.lit(1))
    o = crosssplit.Overlaps(df, "key", "side", {"sha": F.col("sha")}, {"h": crosssplit.Near(F.col("h"), 2, 16)})
    assert rows(o.pairs()) == [("t1", "v1", "h"), ("t1", "v1", "sha"), ("t1", "v2", "h"), ("t3", "v1", "sha")]
    assert sorted((r.eval_key, r.by, r.links) for r in o.members().collect()) == [("v1", "h", 1), ("v1", "sha", 2), ("v2", "h", 1)]
    empty = crosssplit.Overlaps(df.limit(0), "key", "side", {"sha": F.col("sha")}, {})
    assert empty.pairs().count() == 0 and empty.members().count() == 0
    with pytest.raises(ValueError):
        crosssplit.Overlaps(df, "key", "side", {}, {})


def test_members_of_a_value_that_a_third_shares(spark):
    df = spark.range(60_000).select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") % 5 == 0, "eval").otherwise("train").alias("side"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("sha"), F.when(F.col("id") % 3 == 1, "a" * 16).alias("h"))
    m = crosssplit.Overlaps(df, "key", "side", {"sha": F.col("sha")}, {"h": crosssplit.Near(F.col("h"), 2, 16, aligned=True, together=2)}).members()
    got = {r.by: (r.n, r.links) for r in m.groupBy("by").agg(F.count("*").alias("n"), F.max("links").alias("links")).collect()}
    assert got == {"sha": (4000, 16000), "h": (4000, 16000)}


# 7 --------------------------------------------------------------------------------------------------------------------


def test_splits_keep_groups_and_shares(spark):
    r = random.Random(4)
    data = [(f"k{i}", None if i % 50 == 0 else "hot" if i % 3 == 0 and i < 900 else f"e{r.randrange(1500)}", sorted(r.sample(range(12), r.randrange(3)))) for i in range(6000)]
    data += data[:100] + [(None, "e1", [1])]
    df = spark.createDataFrame(data, "key string, ent string, labels array<int>").withColumn("size", F.lit("clash"))
    got = groupsplit.split_groups(df, "key", "ent", "labels", {"train": 80, "val": 10, "test": 10}).collect()
    assert len(got) == 6000
    share = collections.Counter(x.split for x in got)
    assert abs(share["train"] / 6000 - 0.8) < 0.02 and abs(share["val"] / 6000 - 0.1) < 0.02
    by = {x.key: x for x in got}
    per = collections.defaultdict(set)
    for k, e, _ in data:
        if k and e:
            per[e].add((by[k].split, by[k].entity_key))
    assert all(len(v) == 1 for v in per.values())
    assert all(by[k].group_size == 1 for k, e, _ in data if k and e is None)
    lab = collections.defaultdict(collections.Counter)
    for k, _, ls in data[:6000]:
        for j in ls:
            lab[j][by[k].split] += 1
    assert all(abs(c["val"] / sum(c.values()) - 0.1) < 0.05 for c in lab.values())


def test_a_record_of_two_entities_ties_them(spark):
    data = [(f"a{i}", "A", [0]) for i in range(20)] + [(f"b{i}", "B", [1]) for i in range(20)] + [("bridge", "A", [0]), ("bridge", "B", [0])]
    data += [(f"s{i}", None, [i % 3]) for i in range(300)] + [(f"c{i}", f"C{i // 2}", None) for i in range(60)]
    df = spark.createDataFrame(data, "key string, ent string, lab array<int>").withColumn("split", F.lit("clash"))
    got = {r.key: r for r in groupsplit.split_groups(df, "key", "ent", "lab", {"train": 80, "val": 10, "test": 10}).collect()}
    assert len(got) == 20 + 20 + 1 + 300 + 60
    tied = [got[k] for k in got if k[0] in "ab"]
    assert {r.entity_key for r in tied} == {"a0"} and {r.group_size for r in tied} == {41} and len({r.split for r in tied}) == 1
    assert all(got[f"c{2 * i}"].split == got[f"c{2 * i + 1}"].split for i in range(30))
    report = groupsplit.share_report(groupsplit.split_groups(df, "key", "ent", "lab", {"train": 80, "val": 10, "test": 10}), df, "key", "lab", {"train": 80, "val": 10, "test": 10}).collect()
    assert all(abs(r.deviation) <= 0.02 for r in report if r.label_idx is None)
    assert {(r.label_idx, r.records) for r in report if r.split == "train"} >= {(None, sum(x.split == "train" for x in got.values()))}


def test_splits_without_labels_or_rows(spark):
    df = spark.createDataFrame([("a", "e", None), ("b", "e", []), ("c", None, None)], "key string, ent string, labels array<int>")
    got = groupsplit.split_groups(df, "key", "ent", "labels", {"train": 1, "test": 1}).collect()
    assert {(x.key, x.entity_key, x.group_size) for x in got} == {("a", "a", 2), ("b", "a", 2), ("c", "c", 1)}
    assert groupsplit.split_groups(df.limit(0), "key", "ent", "labels", {"train": 1, "test": 1}).count() == 0


# 8 --------------------------------------------------------------------------------------------------------------------

TEXTS = [None, "", " ", "hello world", "it's  <|endoftext|> here\n\n ", "a" * 5000, " " * 3000 + "x", "羊毛 大衣 👍🏽", "naïve café  ", "123 4567 'll", "​﻿zero", "\x1c\x1d sep"]


@needs_vocabulary
def test_ids_equal_the_reference_encoder_and_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokenizer.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    alphabets = ["ab", "the and", "-= ", "0123", "人民 é", "aaaa", "\x1c \t\n"]
    texts = TEXTS + ["".join(rng.choice(a) for _ in range(rng.randrange(60))) for a in alphabets * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_value", F.lit(1))
    ids = tokenizer.encode_corpus(df)
    got = {r.doc_id: r.ids for r in ids.collect()}
    for i, x in enumerate(texts):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else []), repr(x)
    back = {r.doc_id: r.text for r in tokenizer.decode_corpus(ids).collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(texts))
    n = {r.doc_id: r.n_tokens for r in tokenizer.encode_corpus(df, counts_only=True).collect()}
    assert all(n[i] == len(got[i]) for i in got)
    assert tokenizer.encode_corpus(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tokenizer.encode_corpus(df.withColumn("ids", F.lit(1)), keep=("doc_id", "ids"))


@needs_vocabulary
def test_every_gadget_leaves_one_path_per_pair():
    """An arc exists exactly where encoding the two tokens' bytes gives the two tokens."""
    m = tokenizer.TokenAutomaton(tokenizer.load_vocabulary(f"{tokenizer.TOKENIZERS}/byte_bpe_50k.json"))
    r = random.Random(9)
    for _ in range(2000):
        p, t = r.randrange(2000), r.randrange(2000)
        assert m.arc(p, t) == (m.encode_word(m.label[p] + m.label[t]) == [m.out[p], m.out[t]])


# 9 --------------------------------------------------------------------------------------------------------------------


def test_mixture(spark):
    docs = [(i, "big" if i < 800 else "small" if i < 820 else "other" if i < 830 else None, 50) for i in range(840)] + [(900, "big", None), (901, "small", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").withColumn("place", F.lit("clash"))
    targets = spark.createDataFrame([("big", 500_000, 1), ("small", 500_000, 3), ("gone", 0, 1)], "source string, target_ppm int, max_repeats int")
    m = mixture.mix_sources(df, targets, block_tokens=100, seed=1)
    rep = {r.source: r for r in m.report.collect()}
    total = 830 * 50
    assert rep["big"].tokens == 40_000 and not rep["big"].short and rep["small"].short and not rep["gone"].short
    assert rep["small"].used_tokens == 3000 and rep["big"].used_tokens == total - 3000  # what small cannot give is asked of big
    assert rep["big"].asked_tokens == total / 2 and all(r.planned_tokens == r.used_tokens for r in rep.values())
    assert rep["big"].reached_ppm == pytest.approx(1e6 * (total - 3000) / total)
    s = m.schedule.orderBy("slot").collect()
    use = collections.Counter((r.source, r.block) for r in s)
    assert max(v for (src, _), v in use.items() if src == "small") == 3 and max(v for (src, _), v in use.items() if src == "big") == 1
    assert sum(r.source == "big" for r in s) == (total - 3000) // 100 and len(s) == 385 + 30
    first = [r.source for r in s if r.slot < 40]
    assert abs(first.count("big") - 40 * 385 / 415) <= 2  # every stretch has the shares
    b = m.blocks.collect()
    assert len(b) == 820 and {r.block for r in b if r.source == "small"} == set(range(10))
    none = mixture.mix_sources(df.limit(0), targets)
    assert none.schedule.count() == 0 and none.blocks.count() == 0 and {r.used_tokens for r in none.report.collect()} == {0.0}
    with pytest.raises(ValueError):
        mixture.mix_sources(df, targets.union(targets))


def test_mixture_reaches_in_tokens_what_it_reports(spark):
    # a repeated source whose last block is short, a document of many blocks, and a source of less than one block
    docs = [(0, "small", 5000), (1, "long", 50_000), (2, "tiny", 300)] + [(i, "rest", 37) for i in range(10, 1500)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    total = sum(d[2] for d in docs)
    asked = {"small": 280_000, "long": 300_000, "tiny": 20_000, "rest": 400_000}
    targets = spark.createDataFrame([(s, p, 8) for s, p in asked.items()], "source string, target_ppm int, max_repeats int")
    m = mixture.mix_sources(df, targets, block_tokens=4096)
    size = collections.Counter()
    for b in m.blocks.collect():
        size[b.source, b.block] += b.n_tokens
    assert all(n == 4096 for (s, b), n in size.items() if (s, b + 1) in size) and sum(size.values()) == total
    taken, used = collections.Counter(), collections.Counter()
    for r in m.schedule.collect():
        assert 0 < r.n_tokens <= size[r.source, r.block]
        taken[r.source] += r.n_tokens
        used[r.source, r.block] += 1
    assert max(used.values()) <= 8
    rep = {r.source: r for r in m.report.collect()}
    assert {s: r.used_tokens for s, r in rep.items()} == dict(taken)
    want = {s: min(-(-p * total // 1_000_000), 8 * {"small": 5000, "tiny": 300, "long": 50_000, "rest": 37 * 1490}[s]) for s, p in asked.items()}
    assert dict(taken) == want
    assert sum(r.reached_ppm for r in rep.values()) == pytest.approx(1e6)


@needs_vocabulary
def test_short_sources_are_taken_from_the_schedule(spark, monkeypatch):
    from tagloom.llm import queries

    d = "/root/testdata/sf0.001"
    m = queries._mixture(spark, d)
    want = {r.source for r in m.report.where("short").collect()}
    assert {r.source for r in queries.p9_found(spark, d).collect()} == want
    wrong = m._replace(report=m.report.withColumn("used_tokens", F.lit(0.0)))
    monkeypatch.setattr(queries, "_mixture", lambda *_: wrong)
    with pytest.raises(Exception, match="differ"):
        queries.p9_found(spark, d).collect()


# 10 -------------------------------------------------------------------------------------------------------------------

BAD = ["What an idiot you are", "you m0r0n", "WHAT A B i t c h", "such an i*iot", "you іdіоt!", "bitccch", "i​d​i​o​t", "𝓲𝓭𝓲𝓸𝓽", "go to hell!!", "写这个的人是脑.残吧", "滚 蛋", "今晚约pao加我", "du Arschloch", "eres un imbécil", "you d-u-m-b-a-s-s"]
FINE = [None, "", "   ", "an idiot-proof zip", "Removed 12 comments with the word bitch from the thread", "Rule 3: a post that calls someone a scumbag has to be reported", "moth vermin got into the wool", "this parka is garbage " * 40, "质量垃圾，退了", "规范第3条:骂人脑残的评论要上报", "昨天删了3条带“贱人”的留言", "Der Reißverschluss ist idiotensicher", "size S M L X", "7175 pieces, lot 58008", "se borraron 3 comentarios con la palabra idiota"]


def test_abuse(spark):
    texts = BAD + FINE + ["fine words " * 50_000, "fine words " * 50_000 + "you idiot"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "s")).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in abuse.score_documents(df).collect()}
    for i, x in enumerate(texts):
        assert got[i].abusive == (x in BAD or bool(x and x.endswith("you idiot"))), (x and x[:60], got[i])
    rate = {r.source: r for r in abuse.rates(abuse.score_documents(df)).collect()}
    assert rate["s"].n_docs + rate[None].n_docs == len(texts) and 0 < rate["s"].rate < 1
    assert abuse.score_documents(df.limit(0)).count() == 0


def _abusive(text):
    return abuse.lexicon().weigh(text)[1] >= abuse.THRESHOLD


def test_letters_behind_signs_and_set_apart():
    bad = ["f**k you", "you c**t", "you a**hole", "what an a**h*le", "f*** you all", "piece of sh**", "you m***n", "i will k*ll y*u", "t h e s e l l e r i s a n i d i o t", "w-h-o-e-v-e-r-w-r-o-t-e-i-t-i-s-a-b-a-s-t-a-r-d", "x y z w " * 60 + "y o u i d i o t"]
    fine = ["*it* fits, **its** seams hold", "#its a coat", "a 5*4 grid", "c u t t o s i z e", "g r a p e", "size s*m*l", "the s**e seam", ""]
    assert [x for x in bad if not _abusive(x)] == []
    assert [x for x in fine if _abusive(x)] == []


def test_a_cue_ends_with_its_sentence():
    bad = ["Put me on your block list, you idiot", "Enough posts about zips. You idiot.", "te voy a llamar idiota", "Enough comments about hems! Idiots.", "Steht auf der Sperrliste, du Idiot", "屏蔽词太多了。脑残", "屏蔽词太多了，你这个脑残"]
    fine = ["Our block list: idiot, moron, bitch and bastard", "Removed 3 posts with the word idiot. The hem is fine.", "屏蔽词：脑残、傻逼、贱人", "No se debe llamar idiota a nadie", "Comments about idiots were removed", "Sperrliste: z. B. Idiot"]
    assert [x for x in bad if not _abusive(x)] == []
    assert [x for x in fine if _abusive(x)] == []


def test_general_abuse_and_goods():
    bad = ["you are such a worthless loser", "i am going to strangle you", "refugees are cockroaches", "i hope you rot", "send me some nudes", "he wants to fuck her", "you niggers", "ihr seid widerlich", "die Flüchtlinge sind Ratten", "eres patético", "te vamos a matar", "难民都是害虫", "你真是垃圾", "see you stupid, ugly pig"]
    fine = ["this stupid ugly zip is garbage", "you are shipping garbage zips", "the seams are filthy and the hem is disgusting", "are these animals on the print", "you will find your size", "die Nähte sind hässlich", "los botones son basura", "这个拉链真是垃圾", "what a stupid pocket", "will hurt your shoulders", "naked seam, nude shade", "people are happy with it", "they are disgusting to the touch, these cuffs", "those are trash and should be thrown out"]
    assert [x for x in bad if not _abusive(x)] == []
    assert [x for x in fine if _abusive(x)] == []


def test_anchors_lose_no_match():
    lex = abuse.lexicon()
    texts = ["all refugees should be shot", "I am going to stab you", "black people are animals", "I will find out your address and beat you up", "Ich weiß wo du wohnst", "滚回你的国家", "他们这种人就该死", "see you in the shop", "Women belong in the kitchen", "suck my dick", "los gitanos son unos ladrones asquerosos"]
    for x in texts:
        whole = abuse.fold(x)
        may = lex.always.union(*[ids for _, ids in lex.anchors.iter(whole)])
        assert {i for i, (_, p) in enumerate(lex.patterns) if p.search(whole)} <= may
        assert (lex.weigh(x)[1] >= abuse.THRESHOLD) == (x != "see you in the shop")
    got = abuse.anchors("(?:ab|cd)e(?:lion|tiger) ?x*")
    assert got and all(any(a in x for a in got) for x in ("abelion", "cdelion ", "abetiger x", "cdetigerxx"))
    assert not abuse.anchors("(?:lion)?.*")


def test_weights_go_by_concept_and_length():
    lex = abuse.lexicon()
    score = lambda x: lex.weigh(x)[1]
    slur, insult, mild = score("you are a subhuman"), score("what an idiot"), score("damn ugly stitching")
    assert slur > insult > abuse.THRESHOLD > mild > 0
    long = " The seam of the coat holds well." * 3000
    assert abuse.THRESHOLD <= score("what an idiot." + long) < insult and score("damn ugly stitching." + long) < mild
    assert score("i.d.i.o.t") >= abuse.THRESHOLD and score(".".join("xyzq" * 60) + ". i.d.i.o.t") >= abuse.THRESHOLD
