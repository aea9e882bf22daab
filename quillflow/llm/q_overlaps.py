"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.functions.text import id_form
from quillflow.llm.overlaps import Overlaps, expand, overlaps
from quillflow.llm.q_charforms import _form_sql
from quillflow.llm.q_splits import _id_sql
from quillflow.plans import sqltext as S
from quillflow.plans.registry import Registry
from quillflow.session import Workspace, table

R = Registry()


def _loose(c: str) -> str:
    return f"nullif(regexp_replace(lower({_form_sql(c)}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g'), '')"


def _members(side: str, name: str, texts: tuple[str, str]) -> str:
    parts = [f"SELECT '{side}' AS side, 'text' AS kind, row_id AS r, {_loose(c)} AS k FROM {name}" for c in texts]
    parts.append(f"SELECT '{side}', 'image_sha256', row_id, regexp_replace({_id_sql('image_sha256')}, '^sha-?256-', '') FROM {name}")
    parts.append(f"SELECT '{side}', 'source_sid', row_id, {_id_sql('source_sid')} FROM {name}")
    return " UNION ALL ".join(parts)


#: SQL's own way: near texts by a part that one contains of the other, then by edit distance (in bytes first, which is at most three times as much).
_LINKS = f"""
    WITH m AS (SELECT DISTINCT * FROM ({_members('e', 'benchmark_manifest', ('ground_truth', 'corrected_text'))} UNION ALL {_members('t', 'training_manifest', ('target', 'corrected_text'))}) WHERE k IS NOT NULL AND k <> ''),
    c AS (SELECT side, kind, k, min(r) AS rep FROM m GROUP BY ALL), e AS (SELECT k AS t1, rep, length(k) AS n FROM c WHERE side = 'e' AND kind = 'text'), t AS (SELECT k AS t2, rep, length(k) AS n FROM c WHERE side = 't' AND kind = 'text'),
    s AS (SELECT t1, n, rep, substring(t1, 1 + i * n // (n // 9 + 1), (i + 1) * n // (n // 9 + 1) - i * n // (n // 9 + 1)) AS part FROM (SELECT *, unnest(range(n // 9 + 1)) AS i FROM e)),
    h AS (SELECT DISTINCT t1, t2, s.rep AS rep_e, t.rep AS rep_t, greatest(s.n, t.n) // 10 AS most FROM s JOIN t ON contains(t2, part) AND abs(s.n - t.n) <= greatest(s.n, t.n) // 10 WHERE t1 <> t2),
    v AS (SELECT * FROM h WHERE levenshtein(t1, t2) <= 3 * most), w AS (SELECT rep_e, rep_t FROM (SELECT rep_e, rep_t, most, {S.lev('t1', 't2')} AS d FROM v) WHERE d <= most),
    links AS (SELECT a.kind, a.rep AS rep_e, b.rep AS rep_t FROM c a JOIN c b ON a.kind = b.kind AND a.k = b.k AND a.side = 'e' AND b.side = 't' UNION ALL SELECT 'near_text', rep_e, rep_t FROM w),
    l AS (SELECT *, CASE kind WHEN 'near_text' THEN 'text' ELSE kind END AS fam FROM links), members AS (SELECT m.side, m.kind, m.r AS row, c.rep FROM m JOIN c USING (side, kind, k))
"""


def _overlaps(spark: SparkSession, sf: str) -> Overlaps:
    e = table(spark, sf, "benchmark_manifest").select("row_id", "ground_truth", "corrected_text", "image_sha256", "source_sid")
    t = table(spark, sf, "training_manifest").select("row_id", "target", "corrected_text", "image_sha256", "source_sid")
    digest = F.regexp_replace(id_form("image_sha256"), "^sha-?256-", "")  # some are written with their kind
    keys = {"image_sha256": (digest, digest), "source_sid": (id_form("source_sid"), id_form("source_sid"))}
    return overlaps(e, t, "row_id", ["ground_truth", "corrected_text"], ["target", "corrected_text"], keys)


@R.add(
    "p3_found",
    _LINKS
    + """
    SELECT DISTINCT least(a.row, b.row) AS row_id_a, greatest(a.row, b.row) AS row_id_b FROM l JOIN members a ON a.side = 'e' AND a.kind = l.fam AND a.rep = l.rep_e JOIN members b ON b.side = 't' AND b.kind = l.fam AND b.rep = l.rep_t
    """,
)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    p = expand(_overlaps(spark, sf)).select("row_e", "row_t").distinct()
    return p.select(F.least("row_e", "row_t").alias("row_id_a"), F.greatest("row_e", "row_t").alias("row_id_b"))


@R.add("p3_links", _LINKS + "SELECT kind, rep_e, rep_t FROM links")
def p3_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links between classes, each named by its least row."""
    return _overlaps(spark, sf).links


@R.add(
    "p3_members",
    _LINKS
    + """
    , n AS (SELECT 'e' AS side, fam AS kind, rep_e AS rep, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT 't', fam, rep_t, count(*) FROM l GROUP BY ALL)
    SELECT side, kind, row, rep, coalesce(n, 0) AS n_links FROM members LEFT JOIN n USING (side, kind, rep)
    """,
)
def p3_members(spark: SparkSession, sf: str) -> DataFrame:
    """The class of each row by each kind of key, and how many classes of the other side that class is linked to."""
    o = _overlaps(spark, sf)
    by = F.when(F.col("kind") == "near_text", "text").otherwise(F.col("kind"))
    n = F.count("*").alias("n_links")
    links = o.links.groupBy(F.lit("e").alias("side"), by.alias("kind"), F.col("rep_e").alias("rep")).agg(n).unionByName(o.links.groupBy(F.lit("t").alias("side"), by.alias("kind"), F.col("rep_t").alias("rep")).agg(n))
    return o.members.join(links.hint("merge"), ["side", "kind", "rep"], "left").select("side", "kind", "row", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@R.add(
    "p3_report",
    _LINKS
    + """
    , size AS (SELECT kind AS fam, rep AS rep_t, count(*) AS n FROM members WHERE side = 't' GROUP BY ALL), met AS (SELECT l.fam, l.kind, rep_e AS rep, sum(n) AS n FROM l JOIN size USING (fam, rep_t) GROUP BY ALL),
    per_row AS (SELECT b.source_split, b.source, m.row, met.kind, sum(met.n) AS n FROM met JOIN members m ON m.side = 'e' AND m.kind = met.fam AND m.rep = met.rep JOIN benchmark_manifest b ON b.row_id = m.row GROUP BY ALL)
    SELECT source_split, source, kind, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_pairs FROM per_row GROUP BY ALL
    UNION ALL SELECT source_split, source, 'any', count(DISTINCT row), CAST(sum(n) AS BIGINT) FROM per_row GROUP BY ALL
    """,
)
def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation rows that overlap with training, per split, source and kind of overlap, and the training rows that they meet, once for each
    pair of texts or keys; ``any`` counts a row once. Counted by class: no pair of rows is built."""
    o = _overlaps(spark, sf)
    e = table(spark, sf, "benchmark_manifest").select(F.col("row_id").alias("row"), "source_split", "source")
    by = F.when(F.col("kind") == "near_text", "text").otherwise(F.col("kind")).alias("by")
    size = o.members.filter("side = 't'").groupBy(F.col("kind").alias("by"), F.col("rep").alias("rep_t")).agg(F.count("*").alias("n"))
    met = o.links.withColumn("by", by).join(size.hint("merge"), ["by", "rep_t"]).groupBy("by", "kind", F.col("rep_e").alias("rep")).agg(F.sum("n").alias("n"))
    mine = o.members.filter("side = 'e'").select(F.col("kind").alias("by"), "rep", "row")
    rows = met.join(mine.hint("merge"), ["by", "rep"]).groupBy("row", "kind").agg(F.sum("n").alias("n"))
    rows = rows.join(e.hint("merge"), "row")
    rows = Workspace(spark, "report").save(rows, "rows")
    one = rows.groupBy("source_split", "source", "kind").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_pairs"))
    whole = rows.groupBy("row", "source_split", "source").agg(F.sum("n").alias("n")).groupBy("source_split", "source").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_pairs"))
    return one.unionByName(whole.withColumn("kind", F.lit("any")))
