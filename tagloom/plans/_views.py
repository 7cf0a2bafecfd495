"""Input views that several queries share, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import predict
from tagloom.session import table

CATEGORIES = ["shape", "detail", "other"]


def cells(spark: SparkSession, d: str, ties: bool = False) -> DataFrame:
    """Cells over ``embeddings``: ten labels, scores from the first ten components, every supervision state."""
    e = table(spark, d, "embeddings")
    x = e.select(F.col("vec_id").alias("record_id"), F.col("label").alias("cls"), F.posexplode(F.slice("embedding", 1, 10)).alias("label_idx", "x"))
    k, v = F.col("label_idx"), F.col("record_id")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + F.col("x").cast("double")))
    if ties:
        score = F.floor(score * 20) / F.lit(20.0)
    known = (k < 6) & ((v + k) % 4 != 0)
    pu = (k >= 6) & (k < 9) & (F.col("cls") == k) & (v % 3 != 0)
    return x.select(
        "record_id", "label_idx", F.concat(F.lit("t"), k.cast("string")).alias("tag"),
        F.when(k < 6, "pn").when(k < 9, "pu").otherwise("unsupported").alias("mode"),
        F.when(k < 3, "a").when(k < 6, "b").when(k < 9, "c").otherwise("d").alias("subcategory"),
        F.when(k < 6, "shape").when(k < 9, "detail").otherwise("other").alias("category"),
        known.cast("int").alias("known"), pu.cast("int").alias("pu"), ((known | pu) & (F.col("cls") == k)).cast("int").alias("label"), score.alias("score"),
        F.when(v % 3 == 0, "jd").when(v % 3 == 1, "dictionary").otherwise("mixed").alias("bucket"),
        F.when(v % 10 == 0, "val").when(v % 10 == 1, "test").otherwise("train").alias("split"),
    )


def viewed(spark: SparkSession, d: str, ties: bool = False) -> DataFrame:
    return predict.views(cells(spark, d, ties))


def _cells_sql(score: str) -> str:
    return f"""cells AS (
  SELECT record_id, label_idx, 't' || label_idx AS tag, mode, subcategory, category, CAST(known AS INT) AS known, CAST(pu AS INT) AS pu,
         CAST((known OR pu) AND cls = label_idx AS INT) AS label, score, bucket, split
  FROM (SELECT e.vec_id AS record_id, CAST(k AS INT) AS label_idx, e.label AS cls,
    CASE WHEN k < 6 THEN 'pn' WHEN k < 9 THEN 'pu' ELSE 'unsupported' END AS mode,
    CASE WHEN k < 3 THEN 'a' WHEN k < 6 THEN 'b' WHEN k < 9 THEN 'c' ELSE 'd' END AS subcategory,
    CASE WHEN k < 6 THEN 'shape' WHEN k < 9 THEN 'detail' ELSE 'other' END AS category,
    k < 6 AND (e.vec_id + k) % 4 <> 0 AS known,
    k >= 6 AND k < 9 AND e.label = k AND e.vec_id % 3 <> 0 AS pu,
    {score} AS score,
    CASE e.vec_id % 3 WHEN 0 THEN 'jd' WHEN 1 THEN 'dictionary' ELSE 'mixed' END AS bucket,
    CASE e.vec_id % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split
  FROM embeddings e, range(10) r(k)))"""


_S = "greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CAST(0.5 AS DOUBLE) + CAST(e.embedding[k + 1] AS DOUBLE)))"
CELLS = _cells_sql(_S)
CELLS_TIES = _cells_sql(f"floor({_S} * 20) / CAST(20 AS DOUBLE)")
VIEWED = """viewed AS (
  SELECT *, CASE WHEN raw = 1 AND row_number() OVER (PARTITION BY record_id, subcategory ORDER BY raw DESC, score DESC, label_idx) = 1 THEN 1 ELSE 0 END AS fin
  FROM (SELECT *, CASE WHEN mode = 'unsupported' THEN 0 WHEN score >= 0.5 THEN 1 ELSE 0 END AS raw FROM cells))"""


def ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


def figures(tp: str = "tp", fp: str = "fp", fn: str = "fn", tn: str = "tn", r: int | None = None) -> str:
    cols = {
        "precision": ratio(tp, f"({tp}+{fp})"), "recall": ratio(tp, f"({tp}+{fn})"), "f1": ratio(f"2*{tp}", f"(2*{tp}+{fp}+{fn})"),
        "specificity": ratio(tn, f"({tn}+{fp})"), "fpr": ratio(fp, f"({fp}+{tn})"), "accuracy": ratio(f"({tp}+{tn})", f"({tp}+{fp}+{fn}+{tn})"),
    }
    return ", ".join(f"{v} AS \"{k}\"" if r is None else f"round({v}, {r}) AS \"{k}\"" for k, v in cols.items())


def confusion_sql(by: str, flag: str, src: str = "viewed") -> str:
    return f"""SELECT {by}, count(*) FILTER (label = 1 AND {flag} = 1) AS tp, count(*) FILTER (label = 0 AND {flag} = 1) AS fp,
      count(*) FILTER (label = 1 AND {flag} = 0) AS fn, count(*) FILTER (label = 0 AND {flag} = 0) AS tn
    FROM {src} WHERE known = 1 AND mode = 'pn' GROUP BY {by}"""
