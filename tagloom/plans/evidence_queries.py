"""Evidence: normal forms, identity, merging, leakage, splits and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tagloom.functions import normalize as N
from tagloom.operators import audit, cells, contracts, identity, quality, resolve, sampling, splits
from tagloom.plans import build
from tagloom.session import Scratch, dimension, table
from tagloom.sources import readers, writers

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


WS = "'" + N.WHITE_SPACE + "'"
LK = f"lk AS (SELECT trim(tag, {WS}) AS t, idx FROM label_dim UNION SELECT trim(a.alias, {WS}), l.idx FROM tag_alias a JOIN label_dim l ON trim(a.tag, {WS}) = l.tag)"
_STAND = ", ".join(f"'{s}'" for s in N.STAND_INS)
_NULLED = lambda c: f"CASE WHEN lower(trim({c}, {WS})) IN ({_STAND}) THEN NULL ELSE trim({c}, {WS}) END"
_SHA = rf"CASE WHEN regexp_full_match(regexp_replace(lower(trim(sha256, {WS})), '^sha256:', ''), '[0-9a-f]{{64}}') THEN regexp_replace(lower(trim(sha256, {WS})), '^sha256:', '') END"
_PH0 = f"regexp_replace(lower(trim(phash64, {WS})), '^0x', '')"
_PH = f"CASE WHEN regexp_full_match({_PH0}, '[0-9a-f]{{1,16}}') THEN lpad({_PH0}, 16, '0') END"
_REC0 = f"upper({_NULLED('record_id')})"
_REC = rf"CASE WHEN regexp_full_match({_REC0}, '[A-Z]+[\s_\-]*[0-9]+') THEN regexp_replace({_REC0}, '^([A-Z]+)[\s_\-]*0*([0-9]+)$', '\1-\2') ELSE {_REC0} END"
_PATH = rf"regexp_replace(regexp_replace(regexp_replace(split_part(replace(regexp_replace({_NULLED('image_path')}, '%2[fF]', '/', 'g'), '\', '/'), '?', 1), '/+', '/', 'g'), '^\./', ''), '[^/]+/\.\./', '')"
NORM = f"norm AS (SELECT DISTINCT key, source, split, captured_at, {_SHA} AS sha, {_PH} AS ph, {_REC} AS rec, {_PATH} AS path FROM evidence)"


def normal_forms(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "evidence")
    return e.select("key", "source", "split", "captured_at", N.sha256_hex(F.col("sha256")).alias("sha"), N.phash_hex(F.col("phash64")).alias("ph"), N.record_name(F.col("record_id")).alias("rec"), N.image_path(F.col("image_path")).alias("path"))


def _lookup(spark: SparkSession, d: str) -> dict[str, int]:
    return N.tag_lookup(table(spark, d, "label_dim"), table(spark, d, "tag_alias"))


def label_lists(spark: SparkSession, d: str) -> dict:
    lk = _lookup(spark, d)
    return {c: N.label_indices(F.col(c), lk) for c in ("pn_positive", "pu_positive", "pn_negative")}


@query(f"WITH {NORM} SELECT key, sha, ph, rec, path FROM norm")
def evidence_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    return normal_forms(spark, d).distinct().select("key", "sha", "ph", "rec", "path")


_TAGS = f"{LK}, tags AS (" + " UNION ".join(f"SELECT key, '{c}' AS list, idx FROM (SELECT DISTINCT key, trim(unnest({c}), {WS}) AS t FROM evidence) JOIN lk USING (t)" for c in ("pn_positive", "pu_positive", "pn_negative")) + ")"


@query(f"WITH {_TAGS} SELECT list, idx AS label_idx, count(*) AS n_keys FROM tags GROUP BY 1, 2")
def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    lists = label_lists(spark, d)
    named = F.array(*[F.struct(F.lit(n).alias("list"), c.alias("i")) for n, c in lists.items()])
    long = table(spark, d, "evidence").select("key", F.explode(named).alias("x")).select("key", "x.list", F.explode("x.i").alias("label_idx"))
    return long.distinct().groupBy("list", "label_idx").agg(F.count("*").alias("n_keys"))


@query(f"WITH {_TAGS} SELECT key, list, idx AS label_idx FROM tags JOIN label_dim USING (idx) WHERE (list = 'pu_positive' AND mode <> 'pu') OR (list <> 'pu_positive' AND mode <> 'pn')")
def evidence_mode_violations(spark: SparkSession, d: str) -> DataFrame:
    named = F.array(*[F.struct(F.lit(n).alias("list"), c.alias("i")) for n, c in label_lists(spark, d).items()])
    long = table(spark, d, "evidence").select("key", F.explode(named).alias("x")).select("key", "x.list", F.explode("x.i").alias("label_idx")).distinct()
    dim = dimension(table(spark, d, "label_dim").select(F.col("idx").alias("label_idx"), "mode"))
    return long.join(dim, "label_idx").where("(list = 'pu_positive' and mode <> 'pu') or (list <> 'pu_positive' and mode <> 'pn')").select("key", "list", "label_idx")


_STATE = """st AS (SELECT key, idx, max(CASE list WHEN 'pn_positive' THEN 3 WHEN 'pu_positive' THEN 2 ELSE 1 END) AS c FROM tags GROUP BY 1, 2)"""


@query(f"WITH {_TAGS}, {_STATE} SELECT tag, count(*) FILTER (c = 3) AS known_positive, count(*) FILTER (c = 1) AS known_negative, count(*) FILTER (c = 2) AS pu_positive FROM st JOIN label_dim USING (idx) GROUP BY 1")
def evidence_supervision(spark: SparkSession, d: str) -> DataFrame:
    c = cells.from_evidence(table(spark, d, "evidence"), table(spark, d, "label_dim"), label_lists(spark, d), ["key"])
    return c.groupBy("tag").agg(F.count_if((F.col("known") == 1) & (F.col("label") == 1)).alias("known_positive"), F.count_if((F.col("known") == 1) & (F.col("label") == 0)).alias("known_negative"), F.count_if(F.col("pu") == 1).alias("pu_positive"))


@query("SELECT key, count(*) AS n FROM evidence GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return contracts.duplicates(table(spark, d, "evidence"), ["key"])


_CLOSURE = f"""WITH RECURSIVE {NORM}, k AS (SELECT DISTINCT key, sha, ph FROM norm), e AS (
  SELECT key AS b, min(key) OVER (PARTITION BY sha) AS a FROM k WHERE sha IS NOT NULL UNION SELECT key, min(key) OVER (PARTITION BY ph) FROM k WHERE ph IS NOT NULL),
 e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT DISTINCT key AS v, key AS w FROM k UNION SELECT r.v, e2.b FROM r JOIN e2 ON r.w = e2.a) SELECT v AS key, min(w) AS group_key FROM r GROUP BY 1"""


@query(_CLOSURE)
def exact_identity_groups(spark: SparkSession, d: str) -> DataFrame:
    return identity.exact_groups(normal_forms(spark, d), "key", {"sha": F.col("sha"), "ph": F.col("ph")})


@query(f"WITH RECURSIVE {_CLOSURE.split('WITH RECURSIVE ', 1)[1].rsplit(' SELECT v AS key', 1)[0]}, g AS (SELECT v AS key, min(w) AS group_key FROM r GROUP BY 1) SELECT group_key, 'exact:' || substr(sha256(string_agg(key, chr(10) ORDER BY key)), 1, 20) AS group_id, count(*) AS members FROM g GROUP BY 1")
def exact_group_ids(spark: SparkSession, d: str) -> DataFrame:
    g = exact_identity_groups(spark, d)
    return g.groupBy("group_key").agg(identity.signature(F.collect_list("key"), "exact:", 20).alias("group_id"), F.count("*").alias("members"))


_PAIRS = f"""p AS (SELECT DISTINCT ph, CAST('0x' || substr(ph, 1, 8) AS BIGINT) AS h, CAST('0x' || substr(ph, 9, 8) AS BIGINT) AS l FROM norm WHERE ph IS NOT NULL),
 pr AS (SELECT a.ph AS ph_a, b.ph AS ph_b, bit_count(xor(a.h, b.h)) + bit_count(xor(a.l, b.l)) AS distance FROM p a JOIN p b ON a.ph < b.ph WHERE bit_count(xor(a.h, b.h)) + bit_count(xor(a.l, b.l)) <= 2)"""


@query(f"WITH {NORM}, {_PAIRS} SELECT ph_a, ph_b, CAST(distance AS INT) AS distance FROM pr")
def near_dup_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = identity.near_pairs(normal_forms(spark, d).select(N.hex_to_long(F.col("ph")).alias("h")), "h", 2)
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return p.select(F.least(text("h_a"), text("h_b")).alias("ph_a"), F.greatest(text("h_a"), text("h_b")).alias("ph_b"), "distance")


@query(f"""WITH RECURSIVE {NORM}, {_PAIRS}, e2 AS (SELECT ph_a AS a, ph_b AS b FROM pr UNION SELECT ph_b, ph_a FROM pr), r AS (SELECT ph AS v, ph AS w FROM p UNION SELECT r.v, e2.b FROM r JOIN e2 ON r.w = e2.a),
 k AS (SELECT DISTINCT key, ph FROM norm), m AS (SELECT v, min(k.key) AS component FROM r JOIN k ON k.ph = r.w GROUP BY 1) SELECT k.key, coalesce(m.component, k.key) AS component FROM k LEFT JOIN m ON m.v = k.ph""")
def near_dup_components(spark: SparkSession, d: str) -> DataFrame:
    rows = normal_forms(spark, d).select("key", N.hex_to_long(F.col("ph")).alias("h")).distinct()
    return identity.near_components(rows, "key", "h", 2)


@query(f"""WITH {NORM}, l AS (SELECT 'sha' AS kind, sha AS value, split FROM norm WHERE sha IS NOT NULL UNION SELECT 'ph', ph, split FROM norm WHERE ph IS NOT NULL) SELECT kind, value, string_agg(split, ',' ORDER BY split) AS splits FROM (SELECT DISTINCT * FROM l WHERE split IS NOT NULL) GROUP BY 1, 2 HAVING count(*) > 1""")
def leakage_report(spark: SparkSession, d: str) -> DataFrame:
    return identity.leakage(normal_forms(spark, d), "split", {"sha": F.col("sha"), "ph": F.col("ph")}).withColumn("splits", F.array_join("splits", ","))


_CLAIMS = f"{NORM}, {_TAGS}, cl AS (SELECT sha AS g, idx, max(CAST(list = 'pn_positive' AS INT)) AS pp, max(CAST(list = 'pu_positive' AS INT)) AS up, max(CAST(list = 'pn_negative' AS INT)) AS ng FROM (SELECT DISTINCT key, sha FROM norm WHERE sha IS NOT NULL) JOIN tags USING (key) GROUP BY 1, 2)"
_BAD = "bad AS (SELECT g, excl_group, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS detail FROM cl JOIN label_dim USING (idx) WHERE excl_group IS NOT NULL AND (pp = 1 OR up = 1) GROUP BY 1, 2 HAVING count(*) >= 2)"
_OK = "ok AS (SELECT cl.*, mode, excl_group FROM cl JOIN label_dim USING (idx) WHERE mode <> 'unsupported' AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.g = cl.g AND bad.excl_group = label_dim.excl_group))"
_ST = "s AS (SELECT g, idx, CAST(pp = 1 OR up = 1 AS INT) AS label, CAST(pp = 1 OR (up = 0 AND ng = 1) AS INT) AS known, CAST(pp = 0 AND up = 1 AS INT) AS pu FROM ok)"
#: Three rules for the fixture: (rule, if_idx, if_state, then_idx).
RULES = [("pullover_has_no_single_row", 18, "present", 14), ("single_row_is_no_pullover", 14, "known_present", 18), ("no_down_no_fleece", 31, "known_absent", 33)]
_RULES = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', {i}, '{s}', {t})" for r, i, s, t in RULES) + ") v(rule, if_idx, if_state, then_idx))"
_FIRED = "fired AS (SELECT s.g, r.then_idx AS idx, string_agg(DISTINCT r.rule, '; ' ORDER BY r.rule) AS why FROM s JOIN rules r ON s.idx = r.if_idx WHERE (if_state = 'present' AND label = 1) OR (if_state = 'known_present' AND label = 1 AND known = 1) OR (if_state = 'known_absent' AND label = 0 AND known = 1) GROUP BY 1, 2), fo AS (SELECT f.* FROM fired f JOIN label_dim USING (idx) WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.g = f.g AND bad.excl_group = label_dim.excl_group))"


def _resolved(spark: SparkSession, d: str):
    e = table(spark, d, "evidence")
    rows = e.select(N.sha256_hex(F.col("sha256")).alias("g"), *[c.alias(n) for n, c in label_lists(spark, d).items()]).where("g is not null")
    cl = resolve.claims(rows, "g", {resolve.PN_POSITIVE: "pn_positive", resolve.PU_POSITIVE: "pu_positive", resolve.PN_NEGATIVE: "pn_negative"})
    cl = Scratch(spark, "claims").keep(cl)  # several branches read the claims
    dim = table(spark, d, "label_dim")
    rules = spark.createDataFrame(RULES, "rule string, if_idx int, if_state string, then_idx int")
    return cl, dim, rules


@query(f"WITH {_CLAIMS}, {_BAD} SELECT g, excl_group, detail FROM bad")
def exclusion_conflicts(spark: SparkSession, d: str) -> DataFrame:
    cl, dim, _ = _resolved(spark, d)
    return resolve.exclusion_conflicts(cl, "g", dim).select("g", "excl_group", F.array_join("labels", ",").alias("detail"))


@query(f"WITH {_CLAIMS}, {_BAD}, {_OK}, {_ST} SELECT g, idx AS label_idx, label, known, pu FROM s")
def positive_wins(spark: SparkSession, d: str) -> DataFrame:
    cl, dim, _ = _resolved(spark, d)
    return resolve.resolve(cl, "g", dim)[0]


@query(f"WITH {_CLAIMS}, {_BAD}, {_OK}, {_ST}, {_RULES}, {_FIRED} SELECT coalesce(s.g, fo.g) AS g, coalesce(s.idx, fo.idx) AS label_idx, coalesce(label, 0) AS label, CASE WHEN why IS NOT NULL AND coalesce(label, 0) = 0 THEN 1 ELSE known END AS known, coalesce(pu, 0) AS pu FROM s FULL JOIN fo ON s.g = fo.g AND s.idx = fo.idx")
def implication_negatives(spark: SparkSession, d: str) -> DataFrame:
    cl, dim, rules = _resolved(spark, d)
    return resolve.resolve(cl, "g", dim, rules)[0]


@query(f"""WITH {_CLAIMS}, {_BAD}, {_OK}, {_ST}, {_RULES}, {_FIRED} SELECT g, 'mutually_exclusive_positive_conflict' AS kind, excl_group, CAST(NULL AS INT) AS label_idx, detail FROM bad
 UNION ALL SELECT g, 'positive_overrode_negative', NULL, idx, '' FROM ok WHERE (pp = 1 OR up = 1) AND ng = 1
 UNION ALL SELECT s.g, 'positive_overrode_implication_negative', NULL, s.idx, why FROM s JOIN fo ON s.g = fo.g AND s.idx = fo.idx WHERE label = 1""")
def conflict_notes(spark: SparkSession, d: str) -> DataFrame:
    cl, dim, rules = _resolved(spark, d)
    return resolve.resolve(cl, "g", dim, rules)[1]


@query(f"WITH {NORM} SELECT sha, key, rec, path FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY coalesce(trust_rank, 999), coalesce(rec, ''), coalesce(path, ''), key) AS r FROM norm LEFT JOIN evidence_source USING (source) WHERE sha IS NOT NULL) WHERE r = 1")
def representative_rows(spark: SparkSession, d: str) -> DataFrame:
    rank = dimension(table(spark, d, "evidence_source").select("source", "trust_rank"))
    rows = normal_forms(spark, d).where("sha is not null").join(rank, "source", "left")
    rows = rows.withColumns({"a": F.coalesce("trust_rank", F.lit(999)), "b": F.coalesce("rec", F.lit("")), "c": F.coalesce("path", F.lit(""))})
    return resolve.representative(rows, "sha", ["a", "b", "c", "key"], ["key", "rec", "path"]).select("sha", "key", "rec", "path")


@query(f"WITH {NORM}, k AS (SELECT DISTINCT key, source, sha FROM norm WHERE sha IS NOT NULL AND source IS NOT NULL), p AS (SELECT sha, source, count(*) AS n FROM k GROUP BY 1, 2) SELECT sha, string_agg(source, '+' ORDER BY source) AS sources, sum(n)::BIGINT AS binding_count FROM p GROUP BY 1")
def group_sources(spark: SparkSession, d: str) -> DataFrame:
    k = normal_forms(spark, d).select("key", "source", "sha").where("sha is not null and source is not null").distinct()
    return resolve.group_summary(k, "sha", "source", "key").select("sha", F.array_join("sources", "+").alias("sources"), "binding_count")


@query("SELECT o_orderkey, o_custkey AS c_custkey, coalesce(nullif(trim(CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE o_orderstatus END), ''), c_mktsegment) AS c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def identity_override_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise(F.col("o_orderstatus")).alias("c_mktsegment"))
    return identity.overlay(o, table(spark, d, "customer"), "c_custkey", ["c_mktsegment"]).select("o_orderkey", "c_custkey", "c_mktsegment")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) % 8 AS INT) AS rank FROM orders")
def stride_partition(spark: SparkSession, d: str) -> DataFrame:
    return splits.stride(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 8)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS o_totalprice FROM orders")
def ordered_merge(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    m = splits.positions(o.select("o_orderkey"), ["o_orderkey"])
    return audit.merge_shards(m, o.where("o_orderkey % 13 <> 0"), "o_orderkey", "position")


@query("SELECT o_orderkey, 'missing_in_b' AS side FROM orders WHERE o_orderkey % 13 = 0 UNION ALL SELECT -o_orderkey - 1, 'missing_in_a' FROM orders WHERE o_orderkey % 17 = 0")
def id_set_difference(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey")
    b = o.where("o_orderkey % 13 <> 0").unionByName(o.where("o_orderkey % 17 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey")))
    return audit.set_difference(o, b, "o_orderkey")


@query("SELECT position, key_a, key_b FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_orderkey AS key_a, CASE WHEN o_orderkey % 29 = 0 THEN -o_orderkey ELSE o_orderkey END AS key_b FROM orders) WHERE key_a <> key_b")
def positional_mismatches(spark: SparkSession, d: str) -> DataFrame:
    m = splits.positions(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    b = m.withColumn("o_orderkey", F.when(F.col("o_orderkey") % 29 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")))
    return audit.ordered_match(m, b, "position", "o_orderkey")


_SLOTS = f"slots AS (SELECT DISTINCT global_batch, slot, record_index, lower(trim(stream, {WS})) AS stream, balanced_label_index, padding, fallback FROM sample_reference)"


def _slots(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sample_reference").withColumn("stream", F.lower(N.strip(F.col("stream"))))
    return s.select("global_batch", "slot", "record_index", "stream", "balanced_label_index", "padding", "fallback").distinct()


@query(f"WITH {_SLOTS} SELECT stream, balanced_label_index, count(*) AS exposures, count(DISTINCT record_index) AS records, count(*) FILTER (padding) AS padding, count(*) FILTER (fallback) AS fallback FROM slots GROUP BY 1, 2")
def schedule_exposures(spark: SparkSession, d: str) -> DataFrame:
    return sampling.exposures(_slots(spark, d), ["stream", "balanced_label_index"])


@query(f"""WITH {_SLOTS}, {_TAGS}, {_STATE}, x AS (SELECT record_index, count(*) AS times FROM slots GROUP BY 1), r AS (SELECT DISTINCT key, record_index FROM evidence),
 t AS (SELECT idx, sum(times) FILTER (c = 3) AS p, sum(times) FILTER (c = 1) AS n FROM st JOIN r USING (key) JOIN x USING (record_index) GROUP BY 1)
 SELECT tag, coalesce(p, 0)::BIGINT AS positives, coalesce(n, 0)::BIGINT AS negatives, round(least(greatest(coalesce(n, 0) / CAST(greatest(coalesce(p, 0), 1) AS DOUBLE), 1.0), 20.0), 9) AS weight FROM t JOIN label_dim USING (idx) WHERE mode = 'pn'""")
def schedule_class_weights(spark: SparkSession, d: str) -> DataFrame:
    times = _slots(spark, d).groupBy("record_index").agg(F.count("*").alias("times"))
    c = cells.from_evidence(table(spark, d, "evidence"), table(spark, d, "label_dim"), label_lists(spark, d), ["key", "record_index"]).where("mode = 'pn'")
    t = c.join(times, "record_index").groupBy("tag").agg(F.coalesce(F.sum(F.when((F.col("known") == 1) & (F.col("label") == 1), F.col("times"))), F.lit(0)).alias("positives"), F.coalesce(F.sum(F.when((F.col("known") == 1) & (F.col("label") == 0), F.col("times"))), F.lit(0)).alias("negatives"))
    w = F.col("negatives") / F.greatest(F.col("positives"), F.lit(1)).cast("double")
    return t.withColumn("weight", F.round(F.least(F.greatest(w, F.lit(1.0)), F.lit(20.0)), 9))


@query(f"WITH {_SLOTS} SELECT global_batch, slot, record_index FROM slots WHERE slot // 8 = 3 AND global_batch >= 5")
def rank_slots(spark: SparkSession, d: str) -> DataFrame:
    return sampling.rank_slots(_slots(spark, d), 3, 8, 5).select("global_batch", "slot", "record_index")


def _component_rows(spark: SparkSession, d: str) -> DataFrame:
    """(key, component, labels): near-duplicate components with the labels of their keys."""
    rows = normal_forms(spark, d).select("key", N.hex_to_long(F.col("ph")).alias("h")).distinct()
    comp = identity.near_components(rows, "key", "h", 2)
    lab = table(spark, d, "evidence").groupBy("key").agg(F.min(label_lists(spark, d)["pn_positive"]).alias("labels"))  # copies of a row have the same
    return Scratch(spark, "split").keep(comp.join(lab, "key"))


_COMP = f"""{NORM}, {_PAIRS}, e2 AS (SELECT ph_a AS a, ph_b AS b FROM pr UNION SELECT ph_b, ph_a FROM pr), r AS (SELECT ph AS v, ph AS w FROM p UNION SELECT r.v, e2.b FROM r JOIN e2 ON r.w = e2.a),
 k AS (SELECT DISTINCT key, ph FROM norm), m AS (SELECT v, min(k.key) AS component FROM r JOIN k ON k.ph = r.w GROUP BY 1), co AS (SELECT k.key, coalesce(m.component, k.key) AS component FROM k LEFT JOIN m ON m.v = k.ph)"""
SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


@query(f"WITH RECURSIVE {_COMP} SELECT component, true AS placed_once FROM co GROUP BY 1")
def component_split(spark: SparkSession, d: str) -> DataFrame:
    """Components and whether each has exactly one of the splits."""
    plan = splits.split_components(_component_rows(spark, d), "component", "labels", SHARES, 7)
    return plan.groupBy("component").agg((F.count_if(F.col("split").isin(*SHARES)) == 1).alias("placed_once"))


@query(f"""WITH RECURSIVE {_COMP}, n AS (SELECT count(*) AS n, max(c) AS largest FROM (SELECT component, count(*) AS c FROM co GROUP BY 1)), v(split, share) AS (VALUES ('train', 0.8), ('val', 0.1), ('test', 0.1)), t AS (SELECT count(*) AS n FROM co)
 SELECT split, t.n AS rows, greatest(ceil(t.n * 0.02), n.largest)::BIGINT AS tolerance, true AS within FROM v, n, t""")
def split_ratio_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows and tolerance of the component split, and whether each split is within it."""
    rows = _component_rows(spark, d)
    plan = splits.split_components(rows, "component", "labels", SHARES, 7)
    per = rows.groupBy("component").agg(F.count("*").alias("c")).join(plan, "component").groupBy("split").agg(F.sum("c").alias("n"), F.max("c").alias("largest"))
    want = F.element_at(F.create_map(*[F.lit(x) for s, v in SHARES.items() for x in (s, v)]), F.col("split"))
    whole = Window.partitionBy()  # three rows, one per split
    t = per.withColumn("rows", F.sum("n").over(whole)).withColumn("tolerance", F.greatest(F.ceil(F.col("rows") * 0.02), F.max("largest").over(whole)))
    return t.select("split", "rows", "tolerance", (F.abs(F.col("n") - want * F.col("rows")) <= F.col("tolerance")).alias("within"))


@query(f"""WITH RECURSIVE {_COMP}, {_TAGS}, l AS (SELECT DISTINCT co.component, idx FROM tags JOIN co USING (key) WHERE list = 'pn_positive') SELECT idx AS label_idx, count(*) AS components, least(count(*), 3) AS splits FROM l GROUP BY 1""")
def split_support_check(spark: SparkSession, d: str) -> DataFrame:
    """Per label its components, and in how many splits some of them stand: in all three if there are as many."""
    rows = _component_rows(spark, d)
    plan = splits.split_components(rows, "component", "labels", SHARES, 7)
    long = rows.select("component", F.explode("labels").alias("label_idx")).distinct()
    return long.join(plan, "component").groupBy("label_idx").agg(F.count("*").alias("components"), F.count_distinct("split").alias("splits"))


def _schedule(spark: SparkSession, d: str) -> sampling.Schedule:
    """A schedule over all records, with every record that has a label as its candidate, weighted by its rows."""
    scratch = Scratch(spark, "schedule")
    e = table(spark, d, "evidence").where("record_index is not null").groupBy("record_index").agg(F.min(label_lists(spark, d)["pn_positive"]).alias("l"), F.count("*").alias("weight"))
    e = scratch.keep(e, "records")
    return sampling.two_stream_schedule(e, e.select(F.explode("l").alias("label"), "record_index", "weight"), 8, 6, 2, 7, scratch)


_RI = "ri AS (SELECT DISTINCT record_index FROM evidence WHERE record_index IS NOT NULL), nb AS (SELECT CAST(ceil(count(*) / 48.0) AS BIGINT) AS b, count(*) AS n FROM ri)"


@query(f"WITH {_RI}, s AS (SELECT unnest(range((SELECT b FROM nb) * 64)) AS x) SELECT CAST(x // 64 AS INT) AS global_batch, CAST(x % 64 AS INT) AS slot, CASE WHEN x % 8 < 6 THEN 'uniform' ELSE 'balanced' END AS stream, x // 64 = (SELECT b FROM nb) - 1 AND x % 8 < 6 AND x % 64 // 8 * 6 + x % 8 >= 48 - ((SELECT b * 48 - n FROM nb)) AS padding, 1 AS times FROM s")
def two_stream_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The slots of a schedule with their streams; ``times`` is how often the slot's record stands in its batch."""
    rows = _schedule(spark, d).rows
    once = rows.groupBy("global_batch", "record_index").agg(F.count("*").alias("times"))
    return rows.join(once, ["global_batch", "record_index"]).select("global_batch", "slot", "stream", "padding", F.col("times").cast("int").alias("times"))


@query(f"WITH {_RI} SELECT record_index, 1 AS uniform_times FROM ri")
def schedule_uniform_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How often each record stands in the uniform stream, padding aside."""
    rows = _schedule(spark, d).rows.where("stream = 'uniform' and not padding")
    return rows.groupBy("record_index").agg(F.count("*").cast("int").alias("uniform_times"))


@query(f"""WITH {_RI}, {_TAGS}, l AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT idx FROM tags WHERE list = 'pn_positive'))
 SELECT idx AS label_idx, ((SELECT b FROM nb) * 16 - i + k - 1) // k AS turns, 0 AS strangers FROM l""")
def schedule_label_balance(spark: SparkSession, d: str) -> DataFrame:
    """Balanced slots of each label, and how many of them hold a record without the label (a fallback would count for no label)."""
    rows = _schedule(spark, d).rows.where("balanced_label_index is not null").select(F.col("balanced_label_index").alias("label_idx"), "record_index")
    have = table(spark, d, "evidence").select("record_index", F.explode(label_lists(spark, d)["pn_positive"]).alias("label_idx")).distinct().withColumn("own", F.lit(1))
    return rows.join(have, ["record_index", "label_idx"], "left").groupBy("label_idx").agg(F.count("*").alias("turns"), F.count_if(F.col("own").isNull()).cast("int").alias("strangers"))


@query("""SELECT r_regionkey, strlen('{"r_name":"' || r_name || '"}') + 1 AS length, false AS differs FROM region""")
def inventory_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Writes a small tree, its checksum file, and compares both."""
    root = Scratch(spark, "inventory").folder("files")
    table(spark, d, "region").orderBy("r_regionkey").coalesce(1).write.partitionBy("r_regionkey").json(f"{root}/tree/sub")
    writers.checksums(f"{root}/tree", spark, f"{root}/SHA256SUMS")
    inv = readers.inventory(spark, f"{root}/tree")
    diff = audit.provenance(readers.checksum_file(spark, f"{root}/SHA256SUMS"), inv, "path", "sha256")
    files = inv.join(diff.select("path", F.lit(True).alias("differs")), "path", "left").where("path like '%.json'")
    return files.select(F.regexp_extract("path", "r_regionkey=([0-9]+)/", 1).cast("int").alias("r_regionkey"), "length", F.coalesce("differs", F.lit(False)).alias("differs"))


@query("SELECT r_name AS name, md5(r_name) AS expected, CASE WHEN r_regionkey = 3 THEN NULL ELSE md5(r_name || 'x') END AS actual FROM region WHERE r_regionkey IN (1, 3)")
def provenance_diff(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "region").select(F.col("r_name").alias("name"), F.md5("r_name").alias("sha256"), "r_regionkey")
    b = a.where("r_regionkey <> 3").withColumn("sha256", F.when(F.col("r_regionkey") == 1, F.md5(F.concat("name", F.lit("x")))).otherwise(F.col("sha256")))
    return audit.provenance(a.drop("r_regionkey"), b.drop("r_regionkey"))


_BUILT = f"""{_CLOSURE.split('WITH RECURSIVE ', 1)[1].rsplit(' SELECT v AS key', 1)[0]}, grp AS (SELECT v AS key, min(w) AS g FROM r GROUP BY 1), {_TAGS},
 cl AS (SELECT g, idx, max(CAST(list = 'pn_positive' AS INT)) AS pp, max(CAST(list = 'pu_positive' AS INT)) AS up, max(CAST(list = 'pn_negative' AS INT)) AS ng FROM grp JOIN tags USING (key) GROUP BY 1, 2), {_BAD}, {_OK}, {_ST}, {_RULES}, {_FIRED},
 fin AS (SELECT coalesce(label, 0) AS label, CASE WHEN why IS NOT NULL AND coalesce(label, 0) = 0 THEN 1 ELSE known END AS known, coalesce(pu, 0) AS pu FROM s FULL JOIN fo ON s.g = fo.g AND s.idx = fo.idx)"""


@query(f"""WITH RECURSIVE {_BUILT} SELECT 'keys' AS name, count(*) AS n FROM grp UNION ALL SELECT 'records', count(DISTINCT g) FROM grp UNION ALL SELECT 'merged', count(*) - count(DISTINCT g) FROM grp
 UNION ALL SELECT 'known_positive', count(*) FILTER (known = 1 AND label = 1) FROM fin UNION ALL SELECT 'known_negative', count(*) FILTER (known = 1 AND label = 0) FROM fin UNION ALL SELECT 'pu_positive', count(*) FILTER (pu = 1) FROM fin
 UNION ALL SELECT * FROM (SELECT 'mutually_exclusive_positive_conflict' AS name, count(*) AS n FROM bad UNION ALL SELECT 'positive_overrode_negative', count(*) FROM ok WHERE (pp = 1 OR up = 1) AND ng = 1
 UNION ALL SELECT 'positive_overrode_implication_negative', count(*) FROM s JOIN fo ON s.g = fo.g AND s.idx = fo.idx WHERE label = 1) WHERE n > 0 UNION ALL SELECT 'leaks', 0""")
def built_summary(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from evidence to split records, in figures."""
    e = table(spark, d, "evidence")
    rows = e.select("key", N.sha256_hex(F.col("sha256")).alias("sha"), N.phash_long(F.col("phash64")).alias("ph"), *[c.alias(n) for n, c in label_lists(spark, d).items()])
    rules = spark.createDataFrame(RULES, "rule string, if_idx int, if_state string, then_idx int")
    lists = {resolve.PN_POSITIVE: "pn_positive", resolve.PU_POSITIVE: "pu_positive", resolve.PN_NEGATIVE: "pn_negative"}
    return build.build_summary(rows, build.build_records(rows, lists, table(spark, d, "label_dim"), rules, SHARES, 7))
