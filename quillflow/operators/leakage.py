"""Multi-key overlap between datasets: flags, counts, removal and audit.

Keys of several fields form families (path, identifier, text, image hash). Both sides are brought to long form, one row per
(family, key); a family is matched by one equi-join on distinct keys, and matches are folded back to one flag per row, so a row
with many matches counts once. Null and empty keys never match.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Families = Mapping[str, Sequence[Column]]


def key_rows(df: DataFrame, row: str, families: Families) -> DataFrame:
    """(row, family, key): each different key of each row once."""
    per = [_tagged(name, cols) for name, cols in families.items()]
    return df.select(F.col(f"`{row}`").alias("row"), F.explode(F.concat(*per)).alias("e")).select("row", "e.family", "e.key")


def _tagged(name: str, cols: Sequence[Column]) -> Column:
    keys = F.array_distinct(F.filter(F.array(*(c.cast("string") for c in cols)), lambda k: k.isNotNull() & (k != "")))
    return F.transform(keys, lambda k: F.struct(F.lit(name).alias("family"), k.alias("key")))


def overlap_flags(left: DataFrame, row: str, left_families: Families, right: DataFrame, right_families: Families) -> DataFrame:
    """(row, one boolean per family): rows of the left that hit the right in any family."""
    short = [F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2")]  # 128 bits travel in place of texts
    taken = key_rows(right.withColumn("_r", F.lit(0)), "_r", right_families).select("family", *short).distinct()
    hit = key_rows(left, row, left_families).select("row", "family", *short).join(taken, ["family", "k1", "k2"], "left_semi")
    return hit.groupBy("row").agg(*(F.max(F.col("family") == f).alias(f) for f in left_families)).withColumnRenamed("row", row)


def with_overlap(left: DataFrame, row: str, left_families: Families, right: DataFrame, right_families: Families, suffix: str = "_overlap") -> DataFrame:
    """The left rows with a flag per family, in place of any earlier column of that name."""
    flags = overlap_flags(left, row, left_families, right, right_families)
    flags = flags.select(row, *(F.col(f).alias(f + suffix) for f in left_families))
    out = left.drop(*(f + suffix for f in left_families)).join(flags, row, "left")
    return reduce(lambda d, f: d.withColumn(f + suffix, F.coalesce(f + suffix, F.lit(False))), left_families, out)


def overlap_counts(left: DataFrame, row: str, left_families: Families, right: DataFrame, right_families: Families) -> DataFrame:
    """(family, rows): how many rows of the left hit the right, per family, zeros included."""
    flags = overlap_flags(left, row, left_families, right, right_families)
    one = flags.agg(*(F.count_if(F.col(f)).alias(f) for f in left_families))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("family"), F.col(f).alias("rows")) for f in left_families))).alias("e")).select("e.*")


def remove_overlap(left: DataFrame, row: str, left_families: Families, right: DataFrame, right_families: Families) -> DataFrame:
    """The left rows with the first family they hit as ``reason``, or 'kept'."""
    d = with_overlap(left, row, left_families, right, right_families)
    reason = F.lit("kept")
    for f in reversed(list(left_families)):
        reason = F.when(F.col(f + "_overlap"), f + "_overlap").otherwise(reason)
    return d.withColumn("reason", reason).drop(*(f + "_overlap" for f in left_families))


def audit(sides: Mapping[str, tuple[DataFrame, str, Families]], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(audit, family, rows, passed) for each pair of named sides; passed where nothing overlaps."""
    parts = [overlap_counts(*sides[a], sides[b][0], sides[b][2]).withColumn("audit", F.lit(f"{a}_{b}")) for a, b in pairs]
    return reduce(DataFrame.unionByName, parts).select("audit", "family", "rows", (F.col("rows") == 0).alias("passed"))
