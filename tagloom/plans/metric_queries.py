"""Metrics, calibration, rendering, contracts and audits over cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators import audit, calibrate, contracts, predict, quality, sampling
from tagloom.operators.cells import illegal
from tagloom.plans._views import CATEGORIES, CELLS, CELLS_TIES, VIEWED, cells, confusion_sql, figures, ratio, viewed
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


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


_FIG = ("precision", "recall", "f1", "specificity", "fpr", "accuracy")


@query(f"WITH {CELLS}, {VIEWED}, c AS ({confusion_sql('label_idx, tag', 'raw')}) SELECT label_idx, tag, tp, fp, fn, tn, tp+fp+fn+tn AS known_cells, tp+fn AS known_positive, fp+tn AS known_negative, {figures(r=9)} FROM c")
def pn_confusion_by_label(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.by_label(viewed(spark, d), "raw"))


MICRO_MACRO = f"""c AS ({{conf}}), f AS (SELECT *, {figures()} FROM c),
 t AS (SELECT {{by}} sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn,
   {', '.join(f'round(avg("{x}"), 9) AS macro_{x}' for x in _FIG)}, count(*) AS labels_evaluated,
   count(*) FILTER (tp+fn > 0 AND tn+fp > 0) AS labels_with_both_classes, round(coalesce(avg(f1) FILTER (tp+fn > 0 AND tn+fp > 0), 0), 9) AS macro_f1_both_classes,
   count(*) FILTER (tp+fn > 0) AS labels_with_positives, round(coalesce(avg(recall) FILTER (tp+fn > 0), 0), 9) AS macro_recall_with_positives
   FROM f {{group}})
 SELECT *, tp+fp+fn+tn AS known_cells, tp+fn AS known_positive, fp+tn AS known_negative, {figures(r=9)} FROM t"""


@query(f"WITH {CELLS}, {VIEWED}, " + MICRO_MACRO.format(conf=confusion_sql("label_idx", "fin"), by="", group=""))
def pn_micro_macro(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.micro_macro(viewed(spark, d), "final"))


@query(f"WITH {CELLS}, {VIEWED}, " + MICRO_MACRO.format(conf=confusion_sql("bucket, label_idx", "fin"), by="bucket,", group="GROUP BY bucket"))
def slice_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.micro_macro(viewed(spark, d), "final", ["bucket"]))


@query(f"""WITH {CELLS}, {VIEWED}, x AS (SELECT count(*) AS n, sum(label) AS p FROM cells WHERE bucket = 'mixed' AND known = 1), o AS (SELECT count(*) AS n FROM cells WHERE known = 1)
 SELECT (SELECT count(DISTINCT record_id) FROM cells WHERE bucket = 'mixed') AS record_count, x.n AS known_cells, x.p::BIGINT AS known_positive, (x.n - x.p)::BIGINT AS known_negative, round({ratio('x.n', 'o.n')}, 9) AS fraction FROM x, o""")
def mixed_audit(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    m = F.col("bucket") == "mixed"
    k = F.col("known") == 1
    t = c.agg(F.count_distinct(F.when(m, F.col("record_id"))).alias("record_count"), F.count_if(m & k).alias("known_cells"), F.count_if(m & k & (F.col("label") == 1)).alias("known_positive"), F.count_if(k).alias("a"))
    return t.select("record_count", "known_cells", "known_positive", (F.col("known_cells") - F.col("known_positive")).alias("known_negative"), F.round(F.col("known_cells") / F.nullif(F.col("a").cast("double"), F.lit(0.0)), 9).alias("fraction"))


@query(f"WITH {CELLS}, {VIEWED}, p AS (SELECT record_id, min(CAST(label = fin AS INT)) AS ok FROM viewed WHERE known = 1 AND mode = 'pn' GROUP BY record_id) SELECT count(*) AS rows, coalesce(sum(ok), 0)::BIGINT AS hits, round({ratio('sum(ok)', 'count(*)')}, 9) AS exact_match FROM p")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.exact_match(viewed(spark, d), "final"))


@query(f"WITH {CELLS}, {VIEWED} SELECT record_id, subcategory, label_idx, tag, score FROM viewed WHERE fin = 1")
def final_view_winners(spark: SparkSession, d: str) -> DataFrame:
    return predict.winners(viewed(spark, d))


@query(f"WITH {CELLS_TIES}, {VIEWED} SELECT record_id, subcategory, label_idx, tag, score FROM viewed WHERE fin = 1")
def final_view_winners_ties(spark: SparkSession, d: str) -> DataFrame:
    return predict.winners(viewed(spark, d, ties=True))


@query(f"""WITH {CELLS}, {VIEWED}, r AS ({confusion_sql('label_idx, tag', 'raw')}), f AS ({confusion_sql('label_idx, tag', 'fin')})
 SELECT r.label_idx, r.tag, round({ratio('2*r.tp', '(2*r.tp+r.fp+r.fn)')}, 9) AS raw_f1, round({ratio('2*f.tp', '(2*f.tp+f.fp+f.fn)')}, 9) AS final_f1,
  round({ratio('2*f.tp', '(2*f.tp+f.fp+f.fn)')} - {ratio('2*r.tp', '(2*r.tp+r.fp+r.fn)')}, 9) AS difference FROM r JOIN f USING (label_idx)""")
def raw_vs_final_metrics(spark: SparkSession, d: str) -> DataFrame:
    v = viewed(spark, d)
    a = quality.by_label(v, "raw").select("label_idx", "tag", F.col("f1").alias("raw_f1"))
    b = quality.by_label(v, "final").select("label_idx", F.col("f1").alias("final_f1"))
    return rounded(a.join(b, "label_idx").withColumn("difference", F.col("final_f1") - F.col("raw_f1")))


def _threshold_sql(cells_cte: str, mode: str) -> str:
    a, b = ("known = 1 AND label = 1", "known = 1 AND label = 0") if mode == "pn" else ("pu = 1", "known = 0 AND pu = 0")
    key = "2.0::DOUBLE*tp/(tp+fp+p)" if mode == "pn" else "coalesce(tp::DOUBLE/nullif(p,0),0) - coalesce(fp::DOUBLE/nullif(n,0),0)"
    second = "" if mode == "pn" else "coalesce(tp::DOUBLE/nullif(p,0),0) DESC,"
    ok = "p > 0 AND n > 0" if mode == "pn" else "p >= 5 AND n >= 50"
    names = ("known_positive", "known_negative") if mode == "pn" else ("positive", "unlabeled")
    method = "observed_pn_f1" if mode == "pn" else "positive_minus_unlabeled_coverage"
    return f"""WITH {cells_cte}, k AS (SELECT label_idx, tag, score, CAST({a} AS INT) AS a, CAST({b} AS INT) AS b FROM cells WHERE mode = '{mode}'),
 cand AS (SELECT DISTINCT label_idx, tag, score AS t FROM k WHERE a + b > 0 UNION SELECT DISTINCT label_idx, tag, CAST(0.5 AS DOUBLE) FROM k),
 s AS (SELECT c.label_idx, c.tag, c.t, sum(CASE WHEN k.score >= c.t THEN a ELSE 0 END) AS tp, sum(CASE WHEN k.score >= c.t THEN b ELSE 0 END) AS fp, sum(a) AS p, sum(b) AS n FROM cand c JOIN k USING (label_idx) GROUP BY 1, 2, 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY label_idx ORDER BY {key} DESC, {second} abs(t - 0.5), t DESC) AS o FROM s)
 SELECT label_idx, tag, CASE WHEN {ok} THEN t ELSE 0.5 END AS threshold, '{method}' AS method, CASE WHEN {ok} THEN 'calibrated' ELSE 'fallback_insufficient_support' END AS status, p::BIGINT AS {names[0]}, n::BIGINT AS {names[1]} FROM r WHERE o = 1"""


@query(_threshold_sql(CELLS, "pn"))
def threshold_pn_f1(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.pn_thresholds(cells(spark, d))


@query(_threshold_sql(CELLS_TIES, "pn"))
def threshold_pn_f1_ties(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.pn_thresholds(cells(spark, d, ties=True))


@query(_threshold_sql(CELLS, "pu"))
def threshold_pu_coverage(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.pu_thresholds(cells(spark, d))


@query(_threshold_sql(CELLS_TIES, "pu"))
def threshold_pu_coverage_ties(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.pu_thresholds(cells(spark, d, ties=True))


@query()
def thresholds_all_modes(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.all_thresholds(cells(spark, d))


@query()
def calibrated_micro_macro(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds from the validation split, metrics on the test split."""
    c = cells(spark, d)
    t = calibrate.all_thresholds(c.where("split = 'val'"))
    return rounded(quality.micro_macro(predict.views(c.where("split = 'test'"), t), "final"))


def _conc_sql(cells_cte: str) -> str:
    return f"""WITH {cells_cte}, p AS (SELECT label_idx, tag, score FROM cells WHERE mode = 'pu' AND pu = 1), u AS (SELECT label_idx, score FROM cells WHERE mode = 'pu' AND pu = 0 AND known = 0),
 x AS (SELECT p.label_idx, p.tag, sum(CASE WHEN u.score < p.score THEN 2 WHEN u.score = p.score THEN 1 ELSE 0 END) AS w FROM p JOIN u USING (label_idx) GROUP BY 1, 2),
 n AS (SELECT label_idx, count(*) FILTER (pu = 1) AS np, count(*) FILTER (pu = 0) AS nu FROM cells WHERE mode = 'pu' GROUP BY 1)
 SELECT x.label_idx, tag, np AS positive_count, nu AS unlabeled_count, round({ratio('0.5::DOUBLE * w', '(np*nu)')}, 9) AS concordance FROM x JOIN n USING (label_idx)"""


@query(_conc_sql(CELLS))
def pu_concordance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.concordance(cells(spark, d)))


@query(_conc_sql(CELLS_TIES))
def pu_concordance_ties(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.concordance(cells(spark, d, ties=True)))


@query(f"""WITH {CELLS} SELECT label_idx, tag, {', '.join(f"round(quantile_cont(score, {q}) FILTER ({c}), 9) AS {n}_p{round(q * 100)}" for n, c in (('positive', 'pu = 1'), ('unlabeled', 'pu = 0 AND known = 0')) for q in (0.1, 0.5, 0.9))} FROM cells WHERE mode = 'pu' GROUP BY 1, 2""")
def pu_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.pu_quantiles(cells(spark, d)))


_PU = f"""per AS (SELECT label_idx, tag, count(*) FILTER (pu = 1) AS positive_count, count(*) FILTER (pu = 0) AS unlabeled_count, count(*) FILTER (pu = 1 AND fin = 1) AS selected_positive, count(*) FILTER (pu = 0 AND fin = 1) AS selected_unlabeled FROM viewed WHERE mode = 'pu' GROUP BY 1, 2)"""
_PU_RATES = f"round({ratio('selected_positive', 'positive_count')}, 9) AS positive_recall, round({ratio('selected_unlabeled', 'unlabeled_count')}, 9) AS unlabeled_coverage, round({ratio('(selected_positive + selected_unlabeled)', '(positive_count + unlabeled_count)')}, 9) AS all_coverage"


@query(f"WITH {CELLS}, {VIEWED}, {_PU} SELECT *, {_PU_RATES} FROM per")
def pu_by_label(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.pu_by_label(viewed(spark, d)))


@query(f"""WITH {CELLS}, {VIEWED}, {_PU}, t AS (SELECT sum(positive_count)::BIGINT AS positive_count, sum(unlabeled_count)::BIGINT AS unlabeled_count, sum(selected_positive)::BIGINT AS selected_positive, sum(selected_unlabeled)::BIGINT AS selected_unlabeled FROM per),
 w AS (SELECT p.label_idx, sum(CASE WHEN u.score < p.score THEN 2 WHEN u.score = p.score THEN 1 ELSE 0 END)::DOUBLE * 0.5 / count(*) AS c FROM (SELECT label_idx, score FROM cells WHERE mode = 'pu' AND pu = 1) p JOIN (SELECT label_idx, score FROM cells WHERE mode = 'pu' AND pu = 0) u USING (label_idx) GROUP BY 1)
 SELECT t.*, (SELECT round(coalesce(avg(c), 0), 9) FROM w) AS macro_concordance, {_PU_RATES} FROM t""")
def pu_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.pu_summary(viewed(spark, d)))


_REC = "rec AS (SELECT label_idx, tag, mode, count(*) AS positive_support, sum(fin)::BIGINT AS selected_positive FROM viewed WHERE bucket <> 'jd' AND ((mode = 'pn' AND known = 1 AND label = 1) OR (mode = 'pu' AND pu = 1)) GROUP BY 1, 2, 3)"


@query(f"WITH {CELLS}, {VIEWED}, {_REC} SELECT *, round({ratio('selected_positive', 'positive_support')}, 9) AS recall FROM rec")
def dictionary_recall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.positive_recall(viewed(spark, d).where("bucket <> 'jd'")))


@query(f"WITH {CELLS}, {VIEWED}, {_REC} SELECT count(*) AS labels, round(coalesce(avg({ratio('selected_positive', 'positive_support')}), 0), 9) AS macro_recall, sum(positive_support)::BIGINT AS positive_support, sum(selected_positive)::BIGINT AS selected_positive, round({ratio('sum(selected_positive)', 'sum(positive_support)')}, 9) AS micro_recall FROM rec")
def dictionary_recall_total(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.positive_recall_total(viewed(spark, d).where("bucket <> 'jd'")))


@query(f"""WITH {CELLS}, {VIEWED}, per AS (SELECT record_id, subcategory, sum(raw) AS raw_n, count(*) FILTER (raw = 1 AND fin = 0) AS cut, count(*) FILTER ((known = 1 AND label = 1) OR pu = 1) AS obs, count(*) FILTER (((known = 1 AND label = 1) OR pu = 1) AND fin = 1) AS hit FROM viewed WHERE mode <> 'unsupported' GROUP BY 1, 2),
 t AS (SELECT subcategory, count(*) FILTER (raw_n > 1) AS raw_multi_records, sum(cut)::BIGINT AS suppressed, count(*) FILTER (obs > 1) AS observed_multi_records, sum(obs)::BIGINT AS observed_positive, count(*) FILTER (obs > 0) AS observed_records, count(*) FILTER (obs > 0 AND hit > 0) AS hit_records, sum(greatest(obs - 1, 0))::BIGINT AS forced_false_negatives FROM per GROUP BY 1)
 SELECT *, round({ratio('hit_records', 'observed_records')}, 9) AS hit_rate, round({ratio('observed_records', 'observed_positive')}, 9) AS recall_ceiling FROM t""")
def format_loss(spark: SparkSession, d: str) -> DataFrame:
    return rounded(predict.format_loss(viewed(spark, d)))


@query(f"WITH {CELLS}, {VIEWED} SELECT label_idx, tag, count(*) FILTER (raw = 1 AND fin = 0) AS suppressed FROM viewed WHERE mode <> 'unsupported' GROUP BY 1, 2")
def suppressed_by_tag(spark: SparkSession, d: str) -> DataFrame:
    return predict.suppressed_by_tag(viewed(spark, d))


@query(f"""WITH {CELLS}, {VIEWED}, c AS ({confusion_sql('label_idx', 'fin')}), {_REC}, v AS (SELECT round({ratio('2*sum(tp)', '(2*sum(tp)+sum(fp)+sum(fn))')}, 9) AS micro_f1, round(coalesce(avg({ratio('2*tp', '(2*tp+fp+fn)')}) FILTER (tp+fn > 0 AND fp+tn > 0), 0), 9) AS macro_f1, round({ratio('sum(tn)', '(sum(tn)+sum(fp))')}, 9) AS specificity FROM c),
 w AS (SELECT v.*, (SELECT round(coalesce(avg({ratio('selected_positive', 'positive_support')}), 0), 9) FROM rec) AS macro_recall FROM v)
 SELECT *, micro_f1 >= 0.88 AS gate_micro_f1, macro_f1 >= 0.75 AS gate_macro_f1, macro_recall >= 0.85 AS gate_macro_recall, specificity >= 0.9 AS gate_specificity,
  CASE WHEN micro_f1 >= 0.88 AND macro_f1 >= 0.75 AND macro_recall >= 0.85 AND specificity >= 0.9 THEN 'success' WHEN micro_f1 >= 0.82 THEN 'partial' ELSE 'fail' END AS verdict FROM w""")
def performance_gates(spark: SparkSession, d: str) -> DataFrame:
    v = viewed(spark, d)
    m = quality.micro_macro(v, "final").select(F.col("f1").alias("micro_f1"), F.col("macro_f1_both_classes").alias("macro_f1"), "specificity")
    r = quality.positive_recall_total(v.where("bucket <> 'jd'"), "final").select("macro_recall")
    one = rounded(m.withColumn("k", F.lit(1)).join(r.withColumn("k", F.lit(1)), "k").drop("k"))  # one row each
    return audit.gates(one, {"micro_f1": 0.88, "macro_f1": 0.75, "macro_recall": 0.85, "specificity": 0.9}, ("micro_f1", 0.82))


@query(f"""WITH {CELLS} SELECT record_id, '{{' || string_agg('"' || tag || '":"' || CASE WHEN mode = 'unsupported' THEN '0.00' ELSE printf('%.2f', score) END || '"', ',' ORDER BY label_idx) || '}}' AS output FROM cells GROUP BY 1""")
def render_all_scores(spark: SparkSession, d: str) -> DataFrame:
    return predict.render_scores(cells(spark, d))


def _selected_sql(item: str) -> str:
    parts = ' || \',\' || '.join(f"""'"{c}":[' || coalesce(string_agg({item}, ',' ORDER BY label_idx) FILTER (fin = 1 AND category = '{c}'), '') || ']'""" for c in CATEGORIES)
    return f"WITH {CELLS}, {VIEWED} SELECT record_id, '{{' || {parts} || '}}' AS output FROM viewed GROUP BY 1"


@query(_selected_sql("'\"' || tag || '\"'"))
def render_selected(spark: SparkSession, d: str) -> DataFrame:
    return predict.render_selected(viewed(spark, d), CATEGORIES)


@query(_selected_sql("'{\"name\":\"' || tag || '\",\"confidence\":\"' || printf('%.2f', score) || '\"}'"))
def render_confidence(spark: SparkSession, d: str) -> DataFrame:
    return predict.render_selected(viewed(spark, d), CATEGORIES, confidence=True)


@query(f"""WITH {CELLS} SELECT record_id, label_idx, rule FROM (
  SELECT record_id, label_idx, mode, known, CASE WHEN record_id % 7 = 0 THEN 1 ELSE pu END AS pu, CASE WHEN record_id % 11 = 0 THEN 1 ELSE label END AS label FROM cells) c,
  LATERAL (SELECT 'masks_overlap' AS rule WHERE known = 1 AND pu = 1 UNION ALL SELECT 'known_outside_pn' WHERE known = 1 AND mode <> 'pn' UNION ALL SELECT 'pu_outside_pu' WHERE pu = 1 AND mode <> 'pu'
   UNION ALL SELECT 'pu_without_label' WHERE pu = 1 AND label <> 1 UNION ALL SELECT 'unknown_not_neutral' WHERE known = 0 AND pu = 0 AND label <> 0
   UNION ALL SELECT 'unsupported_supervised' WHERE mode = 'unsupported' AND (known = 1 OR pu = 1 OR label = 1) UNION ALL SELECT 'not_binary' WHERE NOT (label IN (0, 1) AND known IN (0, 1) AND pu IN (0, 1))) r""")
def cell_contract_violations(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).withColumn("pu", F.when(F.col("record_id") % 7 == 0, 1).otherwise(F.col("pu"))).withColumn("label", F.when(F.col("record_id") % 11 == 0, 1).otherwise(F.col("label")))
    return illegal(c).select("record_id", "label_idx", "rule")


@query("""SELECT name, key, '' AS detail FROM (SELECT CAST(vec_id AS VARCHAR) AS key, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings) e,
 LATERAL (SELECT 'score_width' AS name WHERE len(s) <> 64 UNION ALL SELECT 'score_not_finite' WHERE len(list_filter(s, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 UNION ALL SELECT 'score_out_of_range' WHERE len(list_filter(s, lambda x: x < -0.35 OR x > 0.35)) > 0) r""")
def score_violations(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s"))
    a, b, _ = contracts.score_constraints("s", 64)
    far = contracts.Constraint("score_out_of_range", F.exists("s", lambda x: (x < -0.35) | (x > 0.35)))
    return contracts.violations(s, [a, b, far], "vec_id")


@query(f"""WITH {CELLS}, p AS (SELECT record_id, category, category_pos, tag, row_number() OVER (PARTITION BY record_id, category ORDER BY label_idx DESC) - 1 AS pos, label_idx, subcategory, mode FROM (SELECT *, CASE category WHEN 'shape' THEN 0 WHEN 'detail' THEN 1 ELSE 2 END AS category_pos FROM cells WHERE score > 0.55)),
 q AS (SELECT *, lag(label_idx) OVER (PARTITION BY record_id, category ORDER BY pos) AS before, count(*) OVER (PARTITION BY record_id, subcategory) AS in_sub FROM p)
 SELECT record_id, category, tag, rule FROM q, LATERAL (SELECT 'unsupported' AS rule WHERE mode = 'unsupported' UNION ALL SELECT 'out_of_order' WHERE before > label_idx UNION ALL SELECT 'several_in_subcategory' WHERE in_sub > 1) r""")
def payload_violations(spark: SparkSession, d: str) -> DataFrame:
    """Payloads that list every label above 0.55, in falling order, so that order, number and support are broken."""
    from pyspark.sql import Window

    c = cells(spark, d)
    dim = spark.createDataFrame([(k, f"t{k}", "pn" if k < 6 else "pu" if k < 9 else "unsupported", CATEGORIES[0 if k < 6 else 1 if k < 9 else 2], "abcd"[k // 3]) for k in range(10)], "idx int, tag string, mode string, category string, subcategory string")
    pos = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")) - 1
    p = c.where("score > 0.55").select("record_id", "category", pos.alias("category_pos"), (F.row_number().over(Window.partitionBy("record_id", "category").orderBy(F.col("label_idx").desc())) - 1).alias("pos"), "tag")
    return predict.payload_errors(p, dim, CATEGORIES)


@query(f"""WITH {CELLS} SELECT tag, split, count(*) FILTER (known = 1 AND label = 1) AS known_positive, count(*) FILTER (known = 1 AND label = 0) AS known_negative, count(*) FILTER (pu = 1) AS pu_positive, count(*) FILTER (known = 0 AND pu = 0) AS unknown, count(DISTINCT CASE WHEN label = 1 THEN record_id END) AS positive_groups FROM cells GROUP BY GROUPING SETS ((tag, split), (tag))""")
def supervision_by_split(spark: SparkSession, d: str) -> DataFrame:
    return quality.supervision(cells(spark, d))


@query(f"""WITH {CELLS}, c AS (SELECT label_idx, tag, count(*) FILTER (known = 1 AND label = 1) AS positives, count(*) FILTER (known = 1 AND label = 0) AS negatives FROM cells WHERE mode = 'pn' GROUP BY 1, 2)
 SELECT *, round(negatives / CAST(greatest(positives, 1) AS DOUBLE), 9) AS raw_weight, round(least(greatest(negatives / CAST(greatest(positives, 1) AS DOUBLE), 1.0), 20.0), 9) AS weight FROM c""")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.class_weights(cells(spark, d)))


@query(f"""WITH {CELLS}, x AS (SELECT record_id, label, (score - 0.5) * 8 AS z FROM cells WHERE known = 1), l AS (SELECT record_id, avg(CASE WHEN label = 1 THEN 2.0 * (ln(1 + exp(-abs(z))) + greatest(-z, 0)) ELSE ln(1 + exp(-abs(z))) + greatest(z, 0) END) AS loss FROM x GROUP BY 1)
 SELECT count(*) AS active_records, round(avg(loss), 8) AS loss FROM l""")
def masked_bce(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.masked_bce(cells(spark, d), (F.col("score") - 0.5) * 8, F.lit(2.0)), 8)


@query(f"""WITH {CELLS}, p AS (SELECT label_idx, tag, score FROM cells WHERE mode = 'pu' AND pu = 1), u AS (SELECT label_idx, score FROM cells WHERE mode = 'pu' AND pu = 0 AND known = 0)
 SELECT p.label_idx, p.tag, count(DISTINCT p.score) AS positives, count(DISTINCT u.score) AS unlabeled, round(avg(greatest(0.25 - p.score + u.score, 0)), 8) AS loss FROM p JOIN u USING (label_idx) GROUP BY 1, 2""")
def pairwise_hinge(spark: SparkSession, d: str) -> DataFrame:
    return rounded(quality.pairwise_hinge(cells(spark, d), margin=0.25), 8)


@query("""WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), b AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN list_transform(v, lambda x: x + 0.125) ELSE v END AS w FROM a),
 j AS (SELECT vec_id, round(coalesce(list_max(list_transform(list_zip(v, w), lambda p: abs(p[1] - p[2]))), 0), 9) AS max_abs_delta, v = w AS exact FROM a JOIN b USING (vec_id)) SELECT * FROM j""")
def repro_diff(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    b = a.select("vec_id", F.when(F.col("vec_id") % 5 == 0, F.transform("v", lambda x: x + 0.125)).otherwise(F.col("v")).alias("v"))
    return rounded(audit.vector_diff(a, b, "vec_id", "v"))


@query("SELECT count(*) AS records, (SELECT round(max(abs((x::DOUBLE + CASE WHEN vec_id % 5 = 0 THEN 0.125 ELSE 0 END) - x::DOUBLE)), 9) FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings)) AS max_abs_delta, count(*) FILTER (vec_id % 5 = 0) = 0 AS all_exact, count(*) FILTER (vec_id % 5 = 0) AS mismatches FROM embeddings")
def repro_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(audit.diff_summary(repro_diff(spark, d)))


@query(f"""WITH {CELLS}, {VIEWED}, c AS ({confusion_sql('tag', 'raw')}), t AS (SELECT tag, unnest(['tp','fp','fn','tn']) AS metric, unnest([tp, fp, fn, tn])::DOUBLE AS v FROM c)
 SELECT tag, metric, v + CASE WHEN tag = 't2' AND metric = 'fp' THEN 1 ELSE 0 END AS reported, v AS recomputed FROM t WHERE tag = 't2' AND metric = 'fp'""")
def metric_crosscheck(spark: SparkSession, d: str) -> DataFrame:
    """Two paths to the counts, one of which was tampered with in one place."""
    v = viewed(spark, d)
    path1 = audit.tidy(quality.confusion(v, ["tag"], "raw"), ["tag"])
    path1 = path1.withColumn("value", F.col("value") + F.when((F.col("tag") == "t2") & (F.col("metric") == "fp"), 1).otherwise(0))
    k = v.where("known = 1 and mode = 'pn'").groupBy("tag").pivot("label", [0, 1]).agg(F.sum("raw").alias("on"), F.count("record_id").alias("n"))
    path2 = audit.tidy(k.select("tag", F.col("1_on").alias("tp"), F.col("0_on").alias("fp"), (F.col("1_n") - F.col("1_on")).alias("fn"), (F.col("0_n") - F.col("0_on")).alias("tn")), ["tag"])
    return audit.crosscheck(path1, path2, ["tag"])


@query("SELECT doc_id, row_number() OVER (ORDER BY h, doc_id) AS pick FROM (SELECT doc_id, sha256('7:' || doc_id) AS h FROM documents) ORDER BY h, doc_id LIMIT 32")
def hash_order_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hash_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 32, 7)


_STRATA = ["lang = 'en'", "lang = 'zh'", "lang = 'de'", "lang = 'es'", "source IS NULL"]
_PICKS = [f"p{i} AS (SELECT doc_id, {i + 1} AS pick FROM o WHERE {c}{''.join(f' AND doc_id NOT IN (SELECT doc_id FROM p{j})' for j in range(i))} ORDER BY h, doc_id LIMIT 1)" for i, c in enumerate(_STRATA)]


@query(f"""WITH o AS (SELECT doc_id, lang, source, sha256('7:' || doc_id) AS h FROM documents), {', '.join(_PICKS)}, s AS ({' UNION ALL '.join(f'SELECT * FROM p{i}' for i in range(len(_STRATA)))}),
 f AS (SELECT doc_id, (SELECT count(*) FROM s) + row_number() OVER (ORDER BY h, doc_id) AS pick FROM o WHERE doc_id NOT IN (SELECT doc_id FROM s)) SELECT doc_id, lang, source, pick FROM (SELECT * FROM s UNION ALL SELECT * FROM f WHERE pick <= 32) JOIN documents USING (doc_id)""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return sampling.stratified_sample(docs, "doc_id", [F.col("lang") == x for x in ("en", "zh", "de", "es")] + [F.col("source").isNull()], 32, 7)


@query(f"""WITH {CELLS}, {VIEWED}, m AS (SELECT record_id, any_value(bucket) AS bucket, CASE WHEN count(*) FILTER ((known = 1 AND label <> fin) OR (pu = 1 AND fin = 0)) = 0 THEN 'success' ELSE 'error' END AS outcome, sha256('7:' || record_id) AS h FROM viewed GROUP BY 1),
 f AS (SELECT *, row_number() OVER (PARTITION BY outcome, bucket ORDER BY h, record_id) AS r FROM m),
 g AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY CASE WHEN r > 1 THEN 4 WHEN bucket = 'jd' THEN 1 WHEN bucket = 'dictionary' THEN 2 ELSE 3 END, h, record_id) AS pick FROM f)
 SELECT record_id, bucket, outcome, pick FROM g WHERE pick <= 4""")
def representatives(spark: SparkSession, d: str) -> DataFrame:
    v = viewed(spark, d)
    wrong = ((F.col("known") == 1) & (F.col("label") != F.col("final"))) | ((F.col("pu") == 1) & (F.col("final") == 0))
    m = v.groupBy("record_id").agg(F.min("bucket").alias("bucket"), F.when(F.max(wrong.cast("int")) == 0, "success").otherwise("error").alias("outcome"))
    return sampling.representatives(m, "record_id", "outcome", "bucket", ["jd", "dictionary", "mixed"], 8, 7)
