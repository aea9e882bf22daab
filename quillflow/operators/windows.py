"""Order-dependent operators over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillflow.session import Workspace


def first_k(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group in the given order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def adjacent_gap(df: DataFrame, by: list[str], order: list[str], start: str, end: str, name: str = "gap") -> DataFrame:
    """Each row with the next row's start less its own end; null at the last."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.lead(start).over(w) - F.col(end))


def nondecreasing(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Per group: whether the values never fall; null if any is null."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn("_ok", F.col(value) >= F.lag(value).over(w))
    return d.groupBy(*by).agg(F.when(F.count_if(F.col(value).isNull()) > 0, F.lit(None).cast("boolean")).otherwise(F.coalesce(F.bool_and("_ok"), F.lit(True))).alias("ordered"))


def _ranged(df: DataFrame, order: list[str], ws: Workspace) -> DataFrame:
    """The rows sorted over range partitions and saved, with their partition ``_p`` and a number ``_m`` that rises within it."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    return ws.save(d, "ranged")


def running_ratio(df: DataFrame, by: list[str], order: list[str], flag: str | Column) -> DataFrame:
    """Rows seen, flagged rows seen and their ratio so far, in order within each group.

    Groups may be few and large: each range of the order is counted on its own, and what came before it is added.
    """
    f = F.col(flag) if isinstance(flag, str) else flag
    d = _ranged(df.withColumn("_f", F.when(f, 1).otherwise(0)), [*by, *order], Workspace(df.sparkSession, "running"))
    w = Window.partitionBy("_p", *by).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("seen", F.count(F.lit(1)).over(w)).withColumn("flagged", F.sum("_f").over(w))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row per group and range
    per = d.groupBy("_p", *by).agg(F.count("*").alias("_n"), F.sum("_f").alias("_s"))
    per = per.select("_p", *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    on = F.col("d._p") == F.col("p._p")
    for c in by:
        on = on & F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}"))
    d = d.alias("d").join(per.alias("p"), on).select(*(F.col(f"d.{c}") for c in df.columns), (F.col("d.seen") + F.col("p._n0")).alias("seen"), (F.col("d.flagged") + F.col("p._s0")).alias("flagged"))
    return d.withColumn("ratio", F.col("flagged") / F.col("seen"))


def repetition_round(by: str, score: str, tie: Column) -> Column:
    """The how-manieth of its text a row is, best score first."""
    return F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))


def numbered(df: DataFrame, order: list[str], name: str = "id", width: int = 6) -> DataFrame:
    """1-based, zero-padded numbers in order, without sorting in one task: range partitions are numbered and shifted by the rows before them."""
    cols = df.columns
    d = _ranged(df, order, Workspace(df.sparkSession, "numbered"))
    per = d.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("least"))  # a row per partition
    per = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(F.broadcast(per), "_p")
    number = (F.col("before") + F.col("_m") - F.col("least") + 1).cast("string")
    return d.select(*cols, F.lpad(number, F.greatest(F.lit(width), F.length(number)), "0").alias(name))  # lpad alone cuts longer numbers
