"""Queries of problem 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm.residue import residue
from quillflow.plans.registry import Registry
from quillflow.session import table

R = Registry()


@R.add("p9_found")
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue(table(spark, sf, "documents"), "doc_id", "text").filter("excluded").select("doc_id")


@R.add("p9_scores")
def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every record's score and counts."""
    return residue(table(spark, sf, "documents"), "doc_id", "text").withColumn("score", F.round("score", 6))
