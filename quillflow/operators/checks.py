"""Constraints: each check is a row (check, failures); a dataset passes if all are 0.

All row-wise checks of one table come from one aggregate; only uniqueness and references need a shuffle of their own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _long(one: DataFrame) -> DataFrame:
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").cast("long").alias("failures")) for c in one.columns))).alias("e")).select("e.*")


def row_checks(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Rows for which each condition does not hold; null counts as not."""
    return _long(df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items())))


def unique_checks(df: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows beyond the first of each value of each key; null is no value."""
    parts = []
    for name, cols in keys.items():
        some = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in cols))
        g = df.filter(some).groupBy(*cols).agg(F.count("*").alias("c"))
        parts.append(_long(g.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias(name))))
    return reduce(DataFrame.unionByName, parts)


def count_check(df: DataFrame, expected: int, name: str = "record_count") -> DataFrame:
    """How far the number of rows is from what is expected."""
    return _long(df.agg(F.abs(F.count("*") - expected).alias(name)))


def reference_check(df: DataFrame, keys: Sequence[str], other: DataFrame, name: str) -> DataFrame:
    """Rows whose key is not in the other table."""
    return _long(df.join(other.select(*keys).distinct(), list(keys), "left_anti").agg(F.count("*").alias(name)))


def disjoint_check(df: DataFrame, keys: Sequence[str], other: DataFrame, name: str) -> DataFrame:
    """Rows whose key is in the other table as well."""
    return _long(df.join(other.select(*keys).distinct(), list(keys), "left_semi").agg(F.count("*").alias(name)))


def same_rows(a: DataFrame, b: DataFrame, name: str = "same_rows") -> DataFrame:
    """Rows, with their repeats, that only one of both tables has."""
    return _long(a.exceptAll(b).unionAll(b.exceptAll(a)).agg(F.count("*").alias(name)))


def same_schema(df: DataFrame, expected: Mapping[str, str]) -> list[str]:
    """Fields that are missing or of another type; a driver-side check of the schema alone."""
    have = dict(df.dtypes)
    return sorted(c for c, t in expected.items() if have.get(c) != t)


def gate(checks: DataFrame) -> None:
    """Fails with the checks that did not pass. A row per check is all that reaches the driver."""
    bad = checks.filter("failures <> 0").orderBy("check").collect()
    if bad:
        raise ValueError("; ".join(f"{r['check']}: {r['failures']}" for r in bad))
