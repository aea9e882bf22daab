"""Problem 1: splits that keep related records together.

Records that share a key are tied, and ties carry on. ``tied_sets`` finds the connected sets by
random-mate contraction over the graph of *keys* (a record that names two keys is an edge; records
of one key need no edge, so a key of a third of all rows is one vertex, not a clique): each round
every vertex flips a coin from its name and the round, a tail joins its smallest head neighbour,
edges are renamed and emptied of loops and repeats; at least a quarter of the vertices with edges
goes in each round in expectation. The joins of the rounds are then unwound from the last to the
first, and records take the label of their key.

``assign_splits`` gives whole sets to splits by cumulative weight: the sets that are heavy against
the total (at most ``1 / heavy`` of them, a proven bound) are placed one by one where most room is
left; all others are laid in hash order along a line whose parts are the rooms left, in buckets, so
that no task sees more than a bucket.

Edge cases: a record without any key (null or blank) is a set of its own; repeated records and
repeated keys change nothing; an empty table gives empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillflow.session import Workspace


def _coin(vertex: str, rnd: int) -> Column:
    """1 for heads."""
    return F.pmod(F.xxhash64(F.lit(rnd), F.col(vertex)), F.lit(2))


def contract(ws: Workspace, edges: DataFrame, max_rounds: int = 400) -> DataFrame:
    """(vertex, label) of every vertex that was joined to another; roots are their own labels.

    ``edges``: columns a, b, without loops. All vertices of a connected set end at one root.
    """
    edges, left = ws.save_counted(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges0")
    hooks: list[DataFrame] = []
    rnd = 0
    while left:
        if rnd == max_rounds:
            raise RuntimeError("contraction did not end; this has no chance to happen with fair coins")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mate = both.filter((_coin("a", rnd) == 0) & (_coin("b", rnd) == 1)).groupBy("a").agg(F.min("b").alias("to"))
        mate = ws.save(mate.select(F.col("a").alias("vertex"), "to"), f"hooks{rnd}")
        hooks.append(mate)
        of_a, of_b = mate.select(F.col("vertex").alias("a"), F.col("to").alias("to_a")), mate.select(F.col("vertex").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(of_a, "a", "left").join(of_b, "b", "left")
        moved = moved.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")).filter("a <> b")
        rnd += 1
        edges, left = ws.save_counted(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"edges{rnd}")
        ws.drop(f"edges{rnd - 1}")
    if not hooks:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("label"))
    done: list[str] = []
    labels = None
    for k in reversed(range(rnd)):
        mine = hooks[k]
        if labels is not None:
            far = labels.select(F.col("vertex").alias("to"), F.col("label").alias("far"))
            mine = mine.join(far, "to", "left").select("vertex", F.coalesce("far", "to").alias("label"))
        else:
            mine = mine.select("vertex", F.col("to").alias("label"))
        ws.save(mine, f"labels{k}")
        done.append(f"labels{k}")
        labels = ws.load(mine, *done)
    return labels


def tied_sets(records: DataFrame, id_col: str, keys: Column, ws: Workspace | None = None) -> DataFrame:
    """(id, group_id, size) of every record that names a key: its set's smallest id and number of records.

    ``keys``: an array of the record's keys, already of one spelling; nulls in it are ignored.
    """
    ws = ws or Workspace(records.sparkSession, "sets")
    ks = F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.isNotNull())))
    rows = records.select(F.col(f"`{id_col}`").alias("id"), ks.alias("keys")).filter(F.size("keys") > 0)
    rows = ws.save(rows.select("id", F.element_at("keys", 1).alias("key"), F.slice("keys", F.lit(2), F.size("keys")).alias("more")), "rows")
    edges = rows.filter(F.size("more") > 0).select(F.col("key").alias("a"), F.explode("more").alias("b"))
    labels = contract(ws, edges)
    per_key = rows.groupBy("key").agg(F.min("id").alias("least"), F.count_distinct("id").alias("n"))
    per_key = per_key.join(labels.withColumnRenamed("vertex", "key"), "key", "left").select("key", F.coalesce("label", "key").alias("label"), "least", "n")
    per_key = ws.save(per_key, "per_key")
    sets = per_key.groupBy("label").agg(F.min("least").alias("group_id"), F.sum("n").alias("size"))
    named = per_key.join(sets, "label").select("key", "group_id", "size")
    return rows.select("id", "key").join(named, "key").select("id", "group_id", "size")


def assign_splits(groups: DataFrame, proportions: Mapping[str, float], heavy: float = 0.001, per_bucket: int = 100_000, seed: int = 42) -> DataFrame:
    """(group_id, split) so that the splits' weights come near the proportions.

    ``groups``: group_id and weight (a whole number), one row each. A set heavier than ``heavy`` of the total is placed
    alone, so at most ``1 / heavy`` rows reach the driver. There are as many buckets as ``per_bucket`` sets each need, 16 at least.
    """
    spark = groups.sparkSession
    names = list(proportions)
    scale = sum(proportions.values())
    total, n = groups.agg(F.sum("weight"), F.count("*")).first()
    total, buckets = total or 0, max(16, -(-n // per_bucket))
    room = {n: total * proportions[n] / scale for n in names}
    limit = max(1.0, total * heavy)
    big = groups.filter(F.col("weight") > limit).orderBy(F.desc("weight"), "group_id").collect()
    placed = []
    for g in big:
        to = max(names, key=lambda n: (room[n], -names.index(n)))
        room[to] -= g["weight"]
        placed.append((g["group_id"], to))
    for n in names:
        room[n] = max(0.0, room[n])
    span = sum(room.values()) or 1.0
    small = groups.filter(F.col("weight") <= limit).withColumn("h", F.xxhash64(F.lit(seed), "group_id")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    per = small.groupBy("bucket").agg(F.sum("weight").alias("w"))
    before = per.select("bucket", (F.sum("w").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")).alias("base"), F.sum("w").over(Window.partitionBy()).alias("all"))
    w = Window.partitionBy("bucket").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, 0)
    at = (F.col("base") + F.sum("weight").over(w) - F.col("weight") / 2) / F.col("all")
    small = small.join(F.broadcast(before), "bucket").withColumn("at", at)  # at most `buckets` rows
    pick, edge = F.lit(names[-1]), 0.0
    steps = []
    for n in names[:-1]:
        edge += room[n] / span
        steps.append((edge, n))
    for edge, n in reversed(steps):
        pick = F.when(F.col("at") < edge, F.lit(n)).otherwise(pick)
    out = small.select("group_id", pick.alias("split"))
    if placed:
        out = out.unionByName(spark.createDataFrame(placed, out.schema))
    return out
