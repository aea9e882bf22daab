"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm.repetition import GRAM, NUMBERING, rejected, repetition
from quillflow.plans.registry import Registry
from quillflow.session import table

R = Registry()


def _measured(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "strict_error_prediction").select("pred_id", "model_name", "raw_prediction")
    return t.select("pred_id", "model_name", repetition(F.col("raw_prediction")).alias("m"))


#: Places of the characters that a run or a word repeats, by self-made windows; compression plays no part in it.
_SHARES = f"""
    WITH t AS (SELECT pred_id, regexp_extract_all(regexp_replace(lower(raw_prediction), '{NUMBERING}', ' ', 'g'), '[\\p{{L}}\\p{{N}}]+') AS ws FROM strict_error_prediction WHERE raw_prediction IS NOT NULL),
    s AS (SELECT pred_id, ws, array_to_string(ws, '') AS s FROM t), l AS (SELECT *, length(s) AS n, least({GRAM}, greatest(1, length(s) // 2)) AS gram FROM s WHERE s <> ''),
    g AS (SELECT pred_id, gram, i, substring(s, i, gram) AS w FROM (SELECT *, unnest(range(1, n - gram + 2)) AS i FROM l)), f AS (SELECT pred_id, gram, i, min(i) OVER (PARTITION BY pred_id, w) AS least FROM g),
    u AS (SELECT pred_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM l),
    o AS (SELECT pred_id, w, k, min(k) OVER (PARTITION BY pred_id, w) AS least, sum(length(w)) OVER (PARTITION BY pred_id ORDER BY k) - length(w) + 1 AS i FROM u),
    c AS (SELECT pred_id, unnest(range(i, i + gram)) AS k FROM f WHERE least < i UNION SELECT pred_id, unnest(range(CAST(i AS BIGINT), CAST(i AS BIGINT) + length(w))) AS k FROM o WHERE least < k),
    m AS (SELECT pred_id, count(*) AS covered FROM c GROUP BY pred_id)
"""


@R.add("p6_found", _SHARES + "SELECT pred_id FROM l JOIN m USING (pred_id) WHERE covered * 2 >= n")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _measured(spark, sf).filter(rejected()).select("pred_id")


@R.add(
    "p6_shares",
    _SHARES + """SELECT p.pred_id, p.model_name, CASE WHEN p.raw_prediction IS NOT NULL THEN CAST(coalesce(l.n, 0) AS INTEGER) END AS n_chars,
    CASE WHEN p.raw_prediction IS NOT NULL THEN round(coalesce(coalesce(m.covered, 0) / l.n, 0.0), 6) END AS repeated_share
    FROM strict_error_prediction p LEFT JOIN l ON l.pred_id = p.pred_id LEFT JOIN m ON m.pred_id = p.pred_id""",
)
def p6_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Every answer's length and share of repeated content, whatever its band."""
    return _measured(spark, sf).select("pred_id", "model_name", "m.n_chars", F.round("m.repeated_share", 6).alias("repeated_share"))


@R.add("p6_bands")
def p6_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Answers per compression band, and what is repeated in them."""
    m = _measured(spark, sf).groupBy("m.band")
    return m.agg(F.count("*").alias("n"), F.count_if(rejected()).alias("n_rejected"), F.round(F.max("m.repeated_share"), 6).alias("most_repeated"), F.round(F.avg("m.ratio"), 6).alias("mean_ratio"))
