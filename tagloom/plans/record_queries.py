"""Records: projection of evidence, row contracts, payloads of several modes, reports, monitor tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import normalize as N
from tagloom.operators import audit, calibrate, cells, contracts, identity, monitor, payload, projection, quality, summary
from tagloom.plans import build
from tagloom.plans._views import CATEGORIES, CELLS, VIEWED, confusion_sql, figures, ratio, viewed
from tagloom.plans._views import cells as cell_view
from tagloom.plans.evidence_queries import LK, NORM, WS, label_lists, normal_forms
from tagloom.plans.metric_queries import MICRO_MACRO, rounded
from tagloom.plans.metric_queries import SQL as METRIC_SQL
from tagloom.session import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


METRIC_LEAKS = f"WITH {NORM} SELECT DISTINCT sha, lower(trim(split, {WS})) AS split FROM norm WHERE sha IS NOT NULL AND split IS NOT NULL"
_GIVEN = "CASE WHEN pn_positive IS NOT NULL THEN 'pn_positive' WHEN pu_positive IS NOT NULL THEN 'pu_positive' WHEN source IS NOT NULL THEN 'source' END"


@query(f"""SELECT DISTINCT key, {_GIVEN} AS field, array_to_string(CASE {_GIVEN} WHEN 'pn_positive' THEN pn_positive WHEN 'pu_positive' THEN pu_positive WHEN 'source' THEN [source] ELSE [] END, '|') AS tags FROM evidence""")
def evidence_first_given(spark: SparkSession, d: str) -> DataFrame:
    """Which field a row's tags come from: the first of three that is given, one of which holds a single tag."""
    e = table(spark, d, "evidence").select("key", "pn_positive", "pu_positive", "source")
    field, tags = projection.first_given(e, ["no_such_field", "pn_positive", "pu_positive", "source"])
    return e.select("key", field.alias("field"), F.array_join(tags, "|").alias("tags")).distinct()


@query(f"""WITH {LK}, p AS (SELECT DISTINCT key, idx FROM (SELECT key, trim(unnest(pn_positive), {WS}) AS t FROM evidence) JOIN lk USING (t)), g AS (SELECT idx, excl_group FROM label_dim WHERE excl_group IS NOT NULL)
 SELECT key, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) AS negatives FROM (SELECT DISTINCT p.key, o.idx FROM p JOIN g USING (idx) JOIN g o ON o.excl_group = g.excl_group WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.key = p.key AND q.idx = o.idx)) GROUP BY 1""")
def exclusive_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Per key the labels that are absent because another of their exclusive group is present."""
    groups: dict[str, list[int]] = {}
    for r in table(spark, d, "label_dim").where("excl_group is not null").select("idx", "excl_group").orderBy("idx").limit(N.MAP_LIMIT).collect():
        groups.setdefault(r.excl_group, []).append(r.idx)
    e = table(spark, d, "evidence").select("key", label_lists(spark, d)["pn_positive"].alias("p")).distinct()
    n = e.select("key", projection.exclusive_negatives(F.col("p"), groups).alias("n")).where("size(n) > 0")
    return n.select("key", F.array_join("n", ",").alias("negatives"))


@query(f"WITH {NORM} SELECT DISTINCT key, coalesce(sha, sha256(path)) AS sha FROM norm")
def identity_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The digest of a row, or one computed for its path, once per path."""
    rows = normal_forms(spark, d).select("key", "path", "sha").distinct()
    return projection.with_computed(rows, "path", ["sha"], lambda p: p.select("path", F.sha2("path", 256).alias("sha"))).select("key", "sha").distinct()


_VEC = """vec AS (SELECT record_id, any_value(bucket) AS bucket, list(CASE WHEN record_id % 11 = 0 THEN 0 ELSE label END ORDER BY label_idx) AS y, list(CASE WHEN record_id % 11 = 0 THEN 0 ELSE known END ORDER BY label_idx) AS k, list(CASE WHEN record_id % 11 = 0 THEN 0 ELSE pu END ORDER BY label_idx) AS p FROM cells GROUP BY 1),
 rec AS (SELECT record_id, bucket, CASE WHEN record_id % 7 <> 0 THEN y END AS y, k, p, record_id % 5 - CASE WHEN record_id % 19 = 0 THEN 9 ELSE 0 END AS a, record_id % 3 AS b, record_id % 5 + record_id % 3 + CASE WHEN record_id % 13 = 0 THEN 1 ELSE 0 END AS total FROM vec)"""
_MASK = [1, 1, 1, 1, 1, 1, 0, 0, 0, 0]


@query(f"""WITH {CELLS}, {_VEC} SELECT name, CAST(record_id AS VARCHAR) AS key, '' AS detail FROM rec, LATERAL (SELECT 'labels_without_mask' AS name WHERE (y IS NULL) <> (k IS NULL)
 UNION ALL SELECT 'no_supervision' WHERE NOT list_contains(k, 1) AND NOT list_contains(p, 1) UNION ALL SELECT 'negative_binding_count' WHERE a < 0 OR b < 0 OR total < 0 UNION ALL SELECT 'binding_counts_do_not_add_up' WHERE a + b <> total
 UNION ALL SELECT 'mask_is_not_the_fixed_one' WHERE bucket = 'jd' AND k <> {_MASK} UNION ALL SELECT 'label_outside_mask' WHERE bucket = 'jd' AND y IS NOT NULL AND len(list_filter(list_zip(y, k), lambda x: x[2] = 0 AND x[1] <> 0)) > 0
 UNION ALL SELECT 'claim_beside_fixed_mask' WHERE bucket = 'jd' AND list_contains(p, 1)) r""")
def record_contract_violations(spark: SparkSession, d: str) -> DataFrame:
    """Records of which some were tampered with, against the rules of a record."""
    i = F.col("record_id")
    c = cell_view(spark, d)
    c = c.select("record_id", "bucket", "label_idx", *[F.when(i % 11 == 0, 0).otherwise(F.col(x)).alias(x) for x in ("label", "known", "pu")])
    v = cells.to_vectors(c, ["record_id", "bucket"], ["label", "known", "pu"])
    v = v.select("record_id", "bucket", F.when(i % 7 != 0, F.col("label")).alias("y"), F.col("known").alias("k"), F.col("pu").alias("p"), (i % 5 - F.when(i % 19 == 0, 9).otherwise(0)).alias("a"), (i % 3).alias("b"), (i % 5 + i % 3 + F.when(i % 13 == 0, 1).otherwise(0)).alias("total"))
    return contracts.violations(v, projection.record_constraints("y", "k", "p", ["a", "b"], "total", (F.col("bucket") == "jd", _MASK)), "record_id")


@query(f"WITH {CELLS} SELECT record_id, array_to_string(list(CASE WHEN score > 0.6 THEN 1 ELSE 0 END ORDER BY label_idx), '') AS hot FROM cells GROUP BY 1")
def fields_to_multi_hot(spark: SparkSession, d: str) -> DataFrame:
    """Two fields of tags, one of them with aliases, to one 0/1 vector."""
    c = cell_view(spark, d).where("score > 0.6")
    part = lambda k, pre: F.collect_list(F.when(F.col("label_idx") % 2 == k, F.concat(F.lit(pre), F.col("tag"))))
    f = c.groupBy("record_id").agg(part(0, "").alias("a"), part(1, "x-").alias("b"))
    ids = table(spark, d, "embeddings").select(F.col("vec_id").alias("record_id"))
    labels = [f"t{k}" for k in range(10)]
    v = projection.fields_to_vector([F.col("a"), F.col("b")], labels, {f"x-{t}": t for t in labels})
    return ids.join(f, "record_id", "left").select("record_id", F.array_join(v, "").alias("hot"))


# payloads -------------------------------------------------------------------------------------------------------------


def _payloads(spark: SparkSession, d: str):
    """Three modes of the same scores in long form; some texts and labels of the confidence mode are changed."""
    v = viewed(spark, d)
    sel = payload.unpack_selected(payload.render(v, "selected", CATEGORIES), CATEGORIES)
    con = payload.unpack_selected(payload.render(v, "confidence", CATEGORIES), CATEGORIES, confidence=True)
    i = F.col("record_id")
    con = con.withColumn("confidence", F.when(i % 17 == 0, "1.0").when(i % 17 == 1, "0.00").otherwise(F.col("confidence"))).where((i % 23 != 0) | (F.col("tag") != "t1"))
    return v, sel, con, payload.unpack_scores(payload.render(v, "all_scores", CATEGORIES))


_CON = f"""sel AS (SELECT record_id, tag, category, row_number() OVER (PARTITION BY record_id, category ORDER BY label_idx) - 1 AS pos, printf('%.2f', score) AS want FROM viewed WHERE fin = 1),
 con AS (SELECT record_id, tag, category, pos, CASE record_id % 17 WHEN 0 THEN '1.0' WHEN 1 THEN '0.00' ELSE want END AS confidence, want FROM sel WHERE record_id % 23 <> 0 OR tag <> 't1')"""


@query(f"""WITH {CELLS}, {VIEWED}, {_CON}, j AS (SELECT s.record_id, s.tag, c.tag IS NULL AS lost, c.pos <> s.pos AS moved, c.confidence, s.want FROM sel s LEFT JOIN con c ON s.record_id = c.record_id AND s.tag = c.tag)
 SELECT record_id, tag, rule FROM j, LATERAL (SELECT 'only_selected' AS rule WHERE lost UNION ALL SELECT 'elsewhere' WHERE moved UNION ALL SELECT 'not_two_decimals' WHERE NOT regexp_full_match(confidence, '(0\\.[0-9]{{2}}|1\\.00)') UNION ALL SELECT 'not_the_score' WHERE confidence <> want) r""")
def confidence_violations(spark: SparkSession, d: str) -> DataFrame:
    v, sel, con, _ = _payloads(spark, d)
    return payload.confidence_errors(con, sel, v)


@query(f"""WITH {CELLS}, s AS (SELECT record_id, tag, CASE WHEN mode = 'unsupported' THEN '0.00' ELSE printf('%.2f', score) END AS want FROM cells), t AS (SELECT *, CASE record_id % 17 WHEN 0 THEN '0.5' WHEN 1 THEN '0.01' ELSE want END AS txt FROM s WHERE record_id % 29 <> 0 OR tag <> 't9')
 SELECT s.record_id, s.tag, rule FROM s LEFT JOIN t ON s.record_id = t.record_id AND s.tag = t.tag, LATERAL (SELECT 'missing_label' AS rule WHERE t.tag IS NULL UNION ALL SELECT 'not_two_decimals' WHERE NOT regexp_full_match(txt, '(0\\.[0-9]{{2}}|1\\.00)') UNION ALL SELECT 'not_the_score' WHERE txt <> s.want) r""")
def all_scores_violations(spark: SparkSession, d: str) -> DataFrame:
    v, _, _, s = _payloads(spark, d)
    i = F.col("record_id")
    s = s.withColumn("text", F.when(i % 17 == 0, "0.5").when(i % 17 == 1, "0.01").otherwise(F.col("text"))).where((i % 29 != 0) | (F.col("tag") != "t9"))
    return payload.scores_errors(s, v, 10)


@query(f"""WITH {CELLS}, {VIEWED}, {_CON}, a AS (SELECT DISTINCT record_id FROM sel), c AS (SELECT DISTINCT record_id FROM con), l AS (SELECT s.record_id FROM sel s LEFT JOIN con c USING (record_id, tag) WHERE c.tag IS NULL)
 SELECT record_id, 'missing_in_a_mode' AS problem FROM (SELECT DISTINCT record_id FROM cells) WHERE record_id NOT IN (SELECT record_id FROM a) OR record_id NOT IN (SELECT record_id FROM c)
 UNION ALL SELECT DISTINCT record_id, 'other_labels' FROM l WHERE record_id IN (SELECT record_id FROM c) UNION ALL SELECT DISTINCT record_id, 'other_score' FROM con WHERE confidence <> want""")
def mode_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Three modes against each other; records without a selected label count as missing here, as no row stands for them."""
    _, sel, con, s = _payloads(spark, d)
    return payload.mode_consistency(sel, con, s)


@query(f"WITH {CELLS} SELECT DISTINCT record_id, true AS same FROM cells")
def payload_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return payload.round_trips(payload.render(cell_view(spark, d), "all_scores", CATEGORIES), "map<string,string>")


@query(f"WITH {CELLS} SELECT record_id, round(sum(score * (label_idx + 1)), 6) AS weighted, count(*) AS n FROM cells GROUP BY 1")
def verification_mode(spark: SparkSession, d: str) -> DataFrame:
    """The unrounded mode, read back: a sum that depends on every score and its place."""
    t = payload.render(cell_view(spark, d), "verification", CATEGORIES).select("record_id", F.posexplode(F.from_json("output", "scores array<double>")["scores"]).alias("i", "s"))
    return t.groupBy("record_id").agg(F.round(F.sum(F.col("s") * (F.col("i") + 1)), 6).alias("weighted"), F.count("*").alias("n"))


# thresholds and reports -------------------------------------------------------------------------------------------------


def _thresholds(c: DataFrame) -> DataFrame:
    """Thresholds of which some were tampered with."""
    t = calibrate.all_thresholds(c).select("label_idx", "mode", "threshold", "status")
    i = F.col("label_idx")
    t = t.withColumn("threshold", F.when(i == 2, 1.5).when(i == 9, 0.5).otherwise(F.col("threshold"))).withColumn("mode", F.when(i == 4, "pu").otherwise(F.col("mode")))
    return t.where("label_idx <> 1").unionByName(t.where("label_idx = 3"))


@query("SELECT * FROM (VALUES (2, 'not_a_share'), (9, 'unsupported_with_threshold'), (4, 'other_mode'), (1, 'missing'), (3, 'twice')) v(label_idx, rule)")
def threshold_contract(spark: SparkSession, d: str) -> DataFrame:
    c = cell_view(spark, d)
    dim = c.select(F.col("label_idx").alias("idx"), "mode").distinct()
    return contracts.threshold_errors(_thresholds(c), dim)


_ALL = " UNION ALL ".join(f"SELECT label_idx, tag, '{m}' AS mode, threshold, status FROM ({METRIC_SQL[q]})" for m, q in (("pn", "threshold_pn_f1"), ("pu", "threshold_pu_coverage")))


@query(f"{_ALL} UNION ALL (WITH {CELLS} SELECT DISTINCT label_idx, tag, mode, CAST(NULL AS DOUBLE), 'disabled_unsupported' FROM cells WHERE mode = 'unsupported')")
def threshold_table(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.all_thresholds(cell_view(spark, d)).select("label_idx", "tag", "mode", "threshold", "status")


@query(f"""WITH {CELLS}, {VIEWED}, c AS ({confusion_sql('label_idx, tag', 'fin')}), f AS (SELECT *, {figures(r=9)} FROM c), rec AS (SELECT label_idx, count(*) AS n, {ratio('sum(fin)', 'count(*)')} AS r FROM viewed WHERE bucket <> 'jd' AND ((mode = 'pn' AND known = 1 AND label = 1) OR (mode = 'pu' AND pu = 1)) GROUP BY 1),
 u AS (SELECT label_idx, tag, count(*) FILTER (pu = 1) AS p, count(*) FILTER (pu = 0) AS n, count(*) FILTER (pu = 1 AND fin = 1) AS sp, count(*) FILTER (pu = 0 AND fin = 1) AS su FROM viewed WHERE mode = 'pu' GROUP BY 1, 2),
 t AS (SELECT label_idx, tag, 'pn' AS mode, tp + fn AS positive_support, tn + fp AS negative_support, tp, fp, fn, tn, precision, recall, f1, specificity, NULL AS unlabeled_support, NULL AS unlabeled_coverage FROM f
  UNION ALL SELECT label_idx, tag, 'pu', p, NULL, NULL, NULL, NULL, NULL, NULL, round({ratio('sp', 'p')}, 9), NULL, NULL, n, round({ratio('su', 'n')}, 9) FROM u)
 SELECT t.* REPLACE (negative_support::DOUBLE AS negative_support, tp::DOUBLE AS tp, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tn::DOUBLE AS tn, unlabeled_support::DOUBLE AS unlabeled_support), coalesce(rec.n, 0) AS dictionary_support, round(rec.r, 9) AS dictionary_recall, CASE WHEN mode = 'pn' AND positive_support >= 20 AND f1 < 0.5 THEN 'low_f1_of_common_label' WHEN mode = 'pu' AND rec.n > 0 AND rec.r = 0 THEN 'no_dictionary_positive_found' ELSE '' END AS warning FROM t LEFT JOIN rec USING (label_idx)""")
def label_report(spark: SparkSession, d: str) -> DataFrame:
    r = rounded(summary.label_report(viewed(spark, d), "final", F.col("bucket") != "jd"))
    return r.withColumns({c: F.col(c).cast("double") for c in ("negative_support", "tp", "fp", "fn", "tn", "unlabeled_support")})


@query(f"""WITH {NORM}, k AS (SELECT DISTINCT key, sha, source, lower(trim(split, {WS})) AS split FROM norm) SELECT 'rows' AS dimension, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM k UNION ALL SELECT 'split', split, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM k GROUP BY 2
 UNION ALL SELECT 'groups', NULL, count(DISTINCT sha) FROM k UNION ALL SELECT 'merged', NULL, count(sha) - count(DISTINCT sha) FROM k""")
def grouping_totals(spark: SparkSession, d: str) -> DataFrame:
    k = normal_forms(spark, d).select("key", "sha", "source", F.lower(N.strip(F.col("split"))).alias("split")).distinct()
    return summary.grouping_totals(k, "sha", ["split", "source"])


@query(f"""WITH {CELLS}, s AS (SELECT *, unnest(CASE bucket WHEN 'mixed' THEN ['jd', 'dictionary'] ELSE [bucket] END) AS source FROM cells)
 SELECT source, count(DISTINCT record_id) AS records, count(*) FILTER (known = 1 AND label = 1) AS known_positive, count(*) FILTER (known = 1 AND label = 0) AS known_negative, count(*) FILTER (pu = 1) AS pu_positive FROM s GROUP BY 1""")
def source_bits(spark: SparkSession, d: str) -> DataFrame:
    c = cell_view(spark, d)
    both = F.when(F.col("bucket") == "mixed", F.array(F.lit("jd"), F.lit("dictionary"))).otherwise(F.array("bucket"))
    return summary.source_bits(c.withColumn("sources", both), "sources")


@query(f"""WITH {NORM}, k AS (SELECT DISTINCT key, ph FROM norm), p AS (SELECT DISTINCT ph, CAST('0x' || substr(ph, 1, 8) AS BIGINT) AS h, CAST('0x' || substr(ph, 9, 8) AS BIGINT) AS l FROM k WHERE ph IS NOT NULL),
 x AS (SELECT bit_count(xor(a.h, b.h)) + bit_count(xor(a.l, b.l)) AS distance, (substr(a.ph, 1, 4) = substr(b.ph, 1, 4))::INT + (substr(a.ph, 5, 4) = substr(b.ph, 5, 4))::INT + (substr(a.ph, 9, 4) = substr(b.ph, 9, 4))::INT + (substr(a.ph, 13, 4) = substr(b.ph, 13, 4))::INT AS same FROM p a JOIN p b ON a.ph < b.ph)
 SELECT (SELECT count(*) FROM k) AS rows, (SELECT count(ph) FROM k) AS with_value, (SELECT count(*) FROM p) AS different_values, count(*) FILTER (same >= 2) AS candidate_pairs, count(*) FILTER (distance <= 2) AS accepted_pairs FROM x""")
def near_statistics(spark: SparkSession, d: str) -> DataFrame:
    k = normal_forms(spark, d).select("key", N.hex_to_long(F.col("ph")).alias("h")).distinct()
    return summary.near_statistics(k, "h")


@query("SELECT 'val' AS split, doc_id FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT 'test', doc_id FROM documents WHERE doc_id % 10 = 4")
def evaluation_union(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return audit.tagged_union({"val": docs.where("doc_id % 10 = 3"), "test": docs.where("doc_id % 10 = 4")})


@query("SELECT sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey) || chr(10)) AS digest FROM orders")
def ordered_id_digest(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(audit.ordered_digest(table(spark, d, "orders"), ["o_orderkey"], "o_orderkey"),)], "digest string")


@query("SELECT o_orderkey, substr(sha256(o_orderstatus || chr(0) || o_orderkey), 1, 32) AS entry FROM orders")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", audit.cache_key(F.col("o_orderstatus"), F.col("o_orderkey")).alias("entry"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 31 = 0 THEN 'only_in_a' WHEN o_orderkey % 37 = 0 THEN 'twice' ELSE 'other_o_orderstatus' END AS problem FROM orders WHERE o_orderkey % 31 = 0 OR o_orderkey % 37 = 0 OR (o_orderkey % 41 = 0 AND o_orderstatus <> 'Z')")
def overlay_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """A copy of a table that lacks rows, repeats rows and changes a field, against the table."""
    a = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    i = F.col("o_orderkey")
    b = a.where(i % 31 != 0).withColumn("o_orderstatus", F.when(i % 41 == 0, "Z").otherwise(F.col("o_orderstatus")))
    return contracts.one_to_one(a, b.unionByName(b.where(i % 37 == 0)), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query(f"""WITH s AS (SELECT DISTINCT global_batch, slot, lower(trim(stream, {WS})) AS stream, balanced_label_index AS i FROM sample_reference), p AS (SELECT i, count(*) AS n FROM s WHERE i IS NOT NULL GROUP BY 1),
 t AS (SELECT count(DISTINCT global_batch) AS batches, count(*) AS slots, count(*) FILTER (stream = 'uniform') AS uniform, count(*) FILTER (stream = 'balanced') AS balanced, (SELECT min(n) FROM p) AS least_turns FROM s)
 SELECT name, expected::BIGINT AS expected, actual::BIGINT AS actual FROM t, LATERAL (VALUES ('batches', 1, batches), ('slots', slots, slots), ('uniform', 3, uniform), ('balanced', balanced, balanced), ('least_turns', 260, least_turns)) v(name, expected, actual) WHERE expected <> actual AND name IN ('batches', 'uniform', 'least_turns')""")
def schedule_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the given schedule against made-up ones."""
    s = table(spark, d, "sample_reference").select("global_batch", "slot", F.lower(N.strip(F.col("stream"))).alias("stream"), "balanced_label_index").distinct()
    return contracts.schedule_totals(s, {"batches": 1, "uniform": 3, "least_turns": 260})


@query(f"WITH {CELLS} SELECT label_idx, count(*) FILTER (pu = 1) AS p, count(*) FILTER (pu = 0 AND known = 0 AND record_id % 4 <> 0) AS u FROM cells WHERE mode = 'pu' GROUP BY 1")
def pair_sides(spark: SparkSession, d: str) -> DataFrame:
    """Positives of both streams and unlabelled cells of the uniform one; three of four records are in the uniform stream."""
    s = quality.pair_sides(cell_view(spark, d), F.col("record_id") % 4 != 0)
    return s.groupBy("label_idx").agg(F.count_if(F.col("side") == "p").alias("p"), F.count_if(F.col("side") == "u").alias("u"))


@query("SELECT r_name AS name, 'success' AS reported, CASE r_regionkey WHEN 2 THEN 'partial' WHEN 3 THEN 'fail' END AS measured FROM region WHERE r_regionkey >= 2")
def overclaims(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select(F.col("r_name").alias("name"), "r_regionkey")
    k = F.col("r_regionkey")
    measured = r.where(k != 4).select("name", F.when(k == 2, "partial").when(k == 3, "fail").otherwise("success").alias("status"))
    return contracts.overclaims(r.select("name", F.lit("success").alias("status")), measured, "name", "status")


_TH = "(SELECT label_idx, threshold FROM (" + METRIC_SQL["threshold_pn_f1"].replace("FROM cells WHERE mode", "FROM cells WHERE split = 'val' AND mode") + ") UNION ALL SELECT label_idx, threshold FROM (" + METRIC_SQL["threshold_pu_coverage"].replace("FROM cells WHERE mode", "FROM cells WHERE split = 'val' AND mode") + "))"


_CALIBRATED = f"""{CELLS}, th AS {_TH}, raws AS (SELECT c.*, CASE WHEN mode = 'unsupported' THEN 0 WHEN score >= coalesce(threshold, 0.5) THEN 1 ELSE 0 END AS raw FROM cells c LEFT JOIN th USING (label_idx) WHERE split = 'test'),
 viewed AS (SELECT *, CASE WHEN raw = 1 AND row_number() OVER (PARTITION BY record_id, subcategory ORDER BY raw DESC, score DESC, label_idx) = 1 THEN 1 ELSE 0 END AS fin FROM raws)"""
SQL["calibrated_micro_macro"] = f"WITH {_CALIBRATED}, " + MICRO_MACRO.format(conf=confusion_sql("label_idx", "fin"), by="", group="")


@query(f"""WITH {_CALIBRATED}, c AS ({confusion_sql('label_idx', 'fin')}),
 v AS (SELECT {ratio('2*sum(tp)', '(2*sum(tp)+sum(fp)+sum(fn))')} AS a, coalesce(avg({ratio('2*tp', '(2*tp+fp+fn)')}) FILTER (tp+fn > 0 AND fp+tn > 0), 0) AS b, {ratio('sum(tn)', '(sum(tn)+sum(fp))')} AS c FROM c),
 q AS (SELECT 'quality' AS part, CASE WHEN a >= 0.2 AND b >= 0.15 AND c >= 0.99 THEN 'success' WHEN a >= 0.05 THEN 'partial' ELSE 'fail' END AS status, ((a < 0.2)::INT + (b < 0.15)::INT + (c < 0.99)::INT)::BIGINT AS n FROM v),
 l AS (SELECT count(*) AS n FROM (SELECT sha FROM ({METRIC_LEAKS}) GROUP BY 1 HAVING count(DISTINCT split) > 1)),
 p AS (SELECT * FROM q UNION ALL SELECT 'thresholds', 'success', count(*) FILTER (threshold < 0 OR threshold > 1) FROM th UNION ALL SELECT 'payloads', 'success', 0 UNION ALL SELECT 'metrics', 'success', 0
  UNION ALL SELECT 'reproduction', 'partial', count(*) FROM cells WHERE split = 'test' AND record_id % 3 = 0 AND label_idx = 2 UNION ALL SELECT 'leakage', CASE WHEN n = 0 THEN 'success' ELSE 'fail' END, n FROM l)
 SELECT * FROM p UNION ALL SELECT 'verdict', CASE max(CASE status WHEN 'success' THEN 1 WHEN 'partial' THEN 2 ELSE 3 END) WHEN 1 THEN 'success' WHEN 2 THEN 'partial' ELSE 'fail' END, count(*) FILTER (status <> 'success') FROM p""")
def delivery_audit(spark: SparkSession, d: str) -> DataFrame:
    """A delivery whose scores were reproduced with a small drift, from thresholds to the verdict."""
    c = cell_view(spark, d)
    dim = c.select(F.col("label_idx").alias("idx"), "tag", "mode", "category", "subcategory").distinct()
    again = c.select("record_id", "label_idx", (F.col("score") + F.when((F.col("record_id") % 3 == 0) & (F.col("label_idx") == 2), 1e-7).otherwise(0.0)).alias("score"))
    rows = normal_forms(spark, d).select("sha", F.lower(N.strip(F.col("split"))).alias("split"))
    leaks = identity.leakage(rows, "split", {"sha": F.col("sha")})
    return build.audit_delivery(c, dim, CATEGORIES, {"micro_f1": 0.2, "macro_f1": 0.15, "specificity": 0.99}, ("micro_f1", 0.05), again, leaks)


# monitor --------------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '正常' WHEN 1 THEN '偏热' WHEN 2 THEN '严重' WHEN 3 THEN '危急' END AS zh, CASE event_id % 5 WHEN 0 THEN 'Normal' WHEN 1 THEN 'Elevated' WHEN 2 THEN 'Serious' WHEN 3 THEN 'Critical' END AS en,
 CAST(CASE WHEN event_id % 5 < 4 THEN event_id % 5 ELSE -1 END AS INT) AS severity, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'full' WHEN event_id % 2 = 0 THEN 'thermal_only' WHEN event_id % 3 = 0 THEN 'applications_only' ELSE 'hidden' END AS mode,
 coalesce(event_type <> 'view' AND event_id % 7 <> 0 AND user_id <> 3, false) AS visible, event_id % 7 <> 0 AND event_type NOT IN ('error', 'click') AS may_end FROM events""")
def monitor_tables(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "events"), F.col("event_id")
    state = F.get(F.array(*map(F.lit, ("nominal", "fair", "serious", "critical", "other"))), (i % 5).cast("int"))
    bundle = F.when(i % 7 != 0, F.col("event_type"))
    return e.select(
        "event_id", monitor.thermal_title(state).alias("zh"), monitor.thermal_title(state, "en").alias("en"), F.coalesce(monitor.severity(state).cast("int"), F.lit(-1)).alias("severity"), monitor.display_mode(i % 2 == 0, i % 3 == 0).alias("mode"),
        monitor.visible(F.col("event_type") != "view", bundle, F.col("user_id"), 3).alias("visible"), monitor.may_terminate(bundle, ["error", "click"]).alias("may_end"),
    )


@query("""WITH t AS (SELECT user_id, round(sum(value), 6) AS total FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY 1), r AS (SELECT user_id, row_number() OVER (ORDER BY total DESC, user_id) AS place FROM t QUALIFY place <= 7)
 SELECT e.event_id, e.user_id, r.place FROM events e JOIN r USING (user_id)""")
def top_users_sampled(spark: SparkSession, d: str) -> DataFrame:
    """The events of the seven users on top, of those who are live, that is had an error."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    live = monitor.keep_live(e, e.where("event_type = 'error'"), "user_id")
    top = monitor.top_k(live.groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("total")), "total", "user_id", 7)
    ranked = top.select("user_id", F.row_number().over(Window.orderBy(F.col("total").desc(), "user_id")).alias("place"))  # seven rows
    return monitor.pick_sampled(ranked, e.select("event_id", "user_id"), "user_id")
