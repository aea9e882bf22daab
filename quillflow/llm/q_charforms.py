"""Queries of problem 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm.charforms import alone_jamo, one_form, pieces
from quillflow.plans import sqltext as S
from quillflow.plans.registry import Registry
from quillflow.session import table

R = Registry()


def _forms(rows: DataFrame) -> DataFrame:
    """pred_id, g, p: both texts in their one form. ``pred_id`` is unique; sides are told apart by parity."""
    side = lambda c, n: rows.select((F.col("pred_id") * 2 + n).alias("k"), F.col(c).alias("t"))
    both = one_form(side("ground_truth", 0).unionByName(side("prediction", 1)), "k", "t")
    g = both.groupBy(F.expr("k div 2").alias("pred_id")).agg(F.max(F.when(F.col("k") % 2 == 0, F.col("form"))).alias("g"), F.max(F.when(F.col("k") % 2 == 1, F.col("form"))).alias("p"))
    return g


def _form_sql(x: str) -> str:
    """The same form by SQL's own composition and a character map; it leaves out composed letters of look-alike scripts."""
    pairs = [(c, p) for c, p, k in pieces() if len(p) == 1 and not k]
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    gone = "".join(c for c, p, k in pieces() if p == "" and c != chr(0))
    mapped = f"translate({x}, {lit(''.join(c for c, _ in pairs if c != chr(0)) + gone)}, {lit(''.join(p for c, p in pairs if c != chr(0)))})"
    alone = alone_jamo()
    return f"trim(regexp_replace(translate(nfc_normalize({mapped}), {lit(''.join(alone))}, {lit(''.join(alone.values()))}), ' +', ' ', 'g'))"


@R.add("p5_found", f"SELECT pred_id FROM ocr_prediction WHERE ground_truth <> prediction AND {_form_sql('ground_truth')} = {_form_sql('prediction')}")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "ocr_prediction").select("pred_id", "ground_truth", "prediction")
    return _forms(t.filter("ground_truth <> prediction")).filter("g = p").select("pred_id")


@R.add(
    "p5_rescored",
    f"""
    WITH d AS (SELECT model_name, ground_truth AS g0, prediction AS p0, {_form_sql('ground_truth')} AS g1, {_form_sql('prediction')} AS p1 FROM ocr_prediction WHERE ground_truth IS NOT NULL AND prediction IS NOT NULL),
    u AS (SELECT DISTINCT g0 AS t1, p0 AS t2 FROM d UNION SELECT DISTINCT g1, p1 FROM d), l AS (SELECT t1, t2, CASE WHEN t1 = t2 THEN 0 WHEN t1 = '' OR t2 = '' THEN length(t1) + length(t2) ELSE {S.lev('t1', 't2')} END AS dist FROM u)
    SELECT model_name, count(*) AS n, count(*) FILTER (WHERE g0 = p0) AS exact_raw, count(*) FILTER (WHERE g1 = p1) AS exact_form, CAST(sum(a.dist) AS DOUBLE) / greatest(1, sum(length(g0))) AS cer_raw, CAST(sum(b.dist) AS DOUBLE) / greatest(1, sum(length(g1))) AS cer_form
    FROM d JOIN l a ON a.t1 = g0 AND a.t2 = p0 JOIN l b ON b.t1 = g1 AND b.t2 = p1 GROUP BY model_name
    """,
)
def p5_rescored(spark: SparkSession, sf: str) -> DataFrame:
    """Per model: exact matches and corpus CER before and after both texts are in one form."""
    t = table(spark, sf, "ocr_prediction").filter("ground_truth IS NOT NULL AND prediction IS NOT NULL")
    f = _forms(t).join(t.select("pred_id", "model_name", "ground_truth", "prediction"), "pred_id")
    d = lambda a, b: F.sum(F.levenshtein(a, b)) / F.greatest(F.lit(1), F.sum(F.length(a)))
    return f.groupBy("model_name").agg(
        F.count("*").alias("n"), F.count_if(F.col("ground_truth") == F.col("prediction")).alias("exact_raw"), F.count_if(F.col("g") == F.col("p")).alias("exact_form"),
        d("ground_truth", "prediction").alias("cer_raw"), d("g", "p").alias("cer_form"),
    )
