"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm.leaks import leaks, without_spans
from quillflow.llm.q_charforms import _form_sql
from quillflow.plans.registry import Registry
from quillflow.session import Workspace, table

R = Registry()


def _leaks(spark: SparkSession, sf: str, with_spans: bool = False) -> DataFrame:
    return leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_item"), "item_id", "text", with_spans=with_spans)


def _letters(c: str) -> str:
    return f"regexp_replace(lower({_form_sql(c)}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


#: SQL's plainer way: the share of an item that lies in runs of 8 letters (20 of alphabets) which the document has anywhere. It knows neither
#: passages nor their order, so it is a check on texts quoted in longer runs, as in the test tables, and no definition.
_SHARES = f"""
    WITH i AS (SELECT item_id, {_letters('text')} AS t FROM eval_item), k AS (SELECT item_id, t, CASE WHEN length(regexp_replace(t, '[\\x{{0}}-\\x{{10ff}}]', '', 'g')) * 2 >= length(t) THEN 8 ELSE 20 END AS w FROM i WHERE t <> ''),
    g AS (SELECT item_id, w, p, substring(t, p, w) AS run FROM (SELECT *, unnest(range(1, length(t) - w + 2)) AS p FROM k)), n AS (SELECT DISTINCT w, run FROM g),
    d AS (SELECT doc_id, {_letters('text')} AS t FROM documents WHERE text IS NOT NULL), r AS (SELECT DISTINCT doc_id, w, substring(t, p, w) AS run FROM (SELECT doc_id, t, w, unnest(range(1, length(t) - w + 2)) AS p FROM d, (VALUES (8), (20)) x(w))),
    h AS (SELECT r.doc_id, r.w, r.run FROM r JOIN n USING (w, run)), c AS (SELECT DISTINCT item_id, doc_id, unnest(range(p, p + g.w)) AS at FROM g JOIN h USING (w, run)),
    found AS (SELECT item_id, doc_id FROM c JOIN k USING (item_id) GROUP BY item_id, doc_id, t HAVING count(*) * 2 >= length(t))
"""


@R.add("p7_found", _SHARES + "SELECT item_id, doc_id FROM found")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _leaks(spark, sf).select("item_id", "doc_id")


@R.add("p7_items")
def p7_items(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items: the documents that hold them and the most of the item that one document holds."""
    return _leaks(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("coverage").alias("most"))


@R.add("p7_cleaned")
def p7_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of the documents that lose a passage, before and after."""
    docs = table(spark, sf, "documents")
    found = Workspace(spark, "leaks").save(_leaks(spark, sf, True), "found")
    bad = docs.select("doc_id", "text").join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    clean = without_spans(bad, "doc_id", "text", found).withColumnRenamed("text", "clean")
    return bad.join(clean, "doc_id").select("doc_id", F.length("text").alias("n_before"), F.length("clean").alias("n_after"))
