"""Queries of problem 8."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm.mixing import mix, shares, source_form, token_count
from quillflow.plans.registry import Registry
from quillflow.session import table

R = Registry()
TOKENIZER = os.environ.get("QUILLFLOW_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def _targets(spark: SparkSession, sf: str) -> dict[str, tuple[float, int]]:
    """The wanted mix is a statement of a few rows; one per source."""
    t = table(spark, sf, "mix_target").select(source_form(F.col("source")).alias("source"), "target_share", "max_repeats")
    return {r["source"]: (r["target_share"], r["max_repeats"]) for r in t.collect() if r["source"]}


def _mixed(spark: SparkSession, sf: str, targets: dict) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", token_count(F.col("text"), TOKENIZER).alias("tokens"))
    return mix(d, "doc_id", source_form(F.col("source")), "tokens", targets)


@R.add("p8_mix")
def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    targets = _targets(spark, sf)
    return shares(_mixed(spark, sf, targets), targets)


@R.add("p8_copies")
def p8_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's rate and copies."""
    return _mixed(spark, sf, _targets(spark, sf))
