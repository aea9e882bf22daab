"""Joins with diagnostics: matching of two listings, alignment by place, lookups with reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def match_audit(left: DataFrame, left_key: Column, right: DataFrame, right_key: Column) -> DataFrame:
    """One row: keys of either side, matched, missing, orphaned, ambiguous, blank, and whether all match one to one."""
    a = left.groupBy(left_key.alias("k")).agg(F.count("*").alias("nl"))
    b = right.groupBy(right_key.alias("k")).agg(F.count("*").alias("nr"))
    j = a.join(b, a["k"].eqNullSafe(b["k"]), "full_outer").select(F.coalesce(a["k"], b["k"]).alias("k"), F.coalesce("nl", F.lit(0)).alias("nl"), F.coalesce("nr", F.lit(0)).alias("nr"))
    some = F.col("k").isNotNull()
    n = lambda c: F.count_if(some & c)
    g = j.agg(
        n(F.col("nl") > 0).alias("left_keys"), n(F.col("nr") > 0).alias("right_keys"), n((F.col("nl") > 0) & (F.col("nr") > 0)).alias("matched"), n((F.col("nl") > 0) & (F.col("nr") == 0)).alias("missing"),
        n((F.col("nl") == 0) & (F.col("nr") > 0)).alias("orphaned"), n((F.col("nl") == 1) & (F.col("nr") == 1)).alias("one_to_one"), n((F.col("nl") > 1) | (F.col("nr") > 1)).alias("ambiguous"),
        F.coalesce(F.sum(F.when(~some, F.col("nl") + F.col("nr"))), F.lit(0)).alias("without_key"),
    )
    return g.withColumn("passed", (F.col("missing") == 0) & (F.col("orphaned") == 0) & (F.col("ambiguous") == 0) & (F.col("without_key") == 0))


def unique_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows joined to the right rows whose key occurs there exactly once."""
    once = right.filter(F.col(key).isNotNull()).withColumn("_n", F.count("*").over(Window.partitionBy(key))).filter("_n = 1").drop("_n")
    return left.join(once, key)


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], missing: str = "not_found") -> DataFrame:
    """Left rows with the right side's columns and a ``lookup`` column: found, or the reason."""
    return left.join(right.withColumn("_hit", F.lit(True)), list(keys), "left").withColumn("lookup", F.when(F.col("_hit"), "found").otherwise(missing)).drop("_hit")


def last_wins(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row struct ``last`` per key: the last in order."""
    return df.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("last"))


def aligned(a: DataFrame, b: DataFrame, place: str, key: str) -> DataFrame:
    """(place, key, other, same): both sequences side by side by place."""
    x, y = a.select(place, F.col(key)), b.select(place, F.col(key).alias("other"))
    return x.join(y, place, "full_outer").select(place, key, "other", F.col(key).eqNullSafe(F.col("other")).alias("same"))


def is_prefix(results: DataFrame, manifest: DataFrame, place: str, key: str) -> DataFrame:
    """One row: results at hand, and how many are not the manifest's row at their place."""
    j = results.select(place, key).join(manifest.select(place, F.col(key).alias("_want")), place, "left")
    return j.agg(F.count("*").alias("done"), F.count_if(~F.col(key).eqNullSafe(F.col("_want"))).alias("out_of_place"))


def side_by_side(df: DataFrame, key: str, name: str, value: str, names: Sequence[str]) -> DataFrame:
    """One row per key with a column per name."""
    return df.groupBy(key).pivot(name, list(names)).agg(F.first(value))


def prefer_unseen(df: DataFrame, key: Column, seen: DataFrame, seen_key: Column) -> DataFrame:
    """The rows with ``unseen``: whether their key is not in the other table."""
    s = seen.select(seen_key.alias("_k")).filter("_k IS NOT NULL").distinct().withColumn("_hit", F.lit(True))
    return df.join(s, key == F.col("_k"), "left").withColumn("unseen", F.col("_hit").isNull()).drop("_k", "_hit")


def pending(manifest: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not done yet."""
    return manifest.join(done.select(key), key, "left_anti")
