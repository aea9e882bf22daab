"""Deterministic sampling: hash order, quotas, ratio samples, and order-coupled greedy picks.

Hash order replaces seeded shuffles: sha256 of a namespace and an id sorts the same everywhere, in SQL too. Rank-to-quota
picks have a literal limit per group, so Spark keeps only the heads of groups in each task; where the first rows of a whole table matter,
``orderBy().limit()`` is used, which never sorts all rows in one task. Greedy picks depend on what was picked before, so they run in one
task by nature; before that the pool is narrowed, by rules that cannot change the pick, to the rows a pick can come to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stable_key(namespace: str, c: str | Column) -> Column:
    """sha256 of 'namespace:id' in hex."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sha2(F.concat(F.lit(namespace + ":"), c.cast("string")), 256)


def stable_seed(namespace: str, c: str | Column) -> Column:
    """The first eight bytes of the digest as an unsigned number."""
    return F.conv(F.substring(stable_key(namespace, c), 1, 16), 16, 10).cast("decimal(20,0)")


def hash_rank(namespace: str, c: str, *by: str) -> Column:
    """1-based place in hash order within the groups."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(stable_key(namespace, c), c))


def take_quota(df: DataFrame, c: str, by: str, quota: dict[str, int], namespace: str) -> DataFrame:
    """The first ``quota[g]`` rows of each group in hash order."""
    q = F.lit(0)
    for g, n in quota.items():
        q = F.when(F.col(by) == g, F.lit(n)).otherwise(q)
    ranked = df.filter(F.col(by).isin(*quota)).withColumn("rank", hash_rank(namespace, c, by))
    return ranked.filter(F.col("rank") <= max(quota.values(), default=0)).filter(F.col("rank") <= q)


def even_quota(names: list[str], n: int, remainder_to_first: bool = True) -> dict[str, int]:
    """n split evenly; what is left goes to the first names (or to the last)."""
    base, extra = divmod(n, len(names))
    order = names if remainder_to_first else names[::-1]
    return {g: base + (order.index(g) < extra) for g in names}


def proportional_quotas(counts: DataFrame, name: str, count: str, n: int) -> DataFrame:
    """Largest remainder: (name, count, quota); ties go to the smaller name. Fails if n is more than there is.

    ``counts`` has a row per group. Fractions are compared as whole remainders, so no rounding decides a tie.
    """
    c = F.col(count).cast("decimal(38,0)")
    t = counts.agg(F.sum(count).cast("decimal(38,0)").alias("total"))
    d = counts.join(F.broadcast(t))
    d = d.withColumn("base", F.expr(f"cast({n} * cast({count} as decimal(38,0)) div total as bigint)")).withColumn("rest", (F.lit(n) * c) % F.col("total"))
    d = d.withColumn("short", F.lit(n) - F.sum("base").over(Window.partitionBy()))
    d = d.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rest"), name)))
    q = F.when(F.lit(n) > F.col("total"), F.raise_error(F.lit("the quota exceeds the rows"))).otherwise(F.col("base") + F.when(F.col("place") <= F.col("short"), 1).otherwise(0))
    return d.select(name, count, q.cast("long").alias("quota"))


def sample_in_order(df: DataFrame, c: str, order: str, n: int, namespace: str) -> DataFrame:
    """n rows by hash order, given back in their own order."""
    return df.orderBy(stable_key(namespace, c), c).limit(n).orderBy(order)


def pick_validation(df: DataFrame, c: str, flag: str, outside: Column, n_per_flag: int, namespace: str) -> DataFrame:
    """Per value of ``flag``: rows from outside the training split first, then from it, each in its own hash order; exactly n or all there are."""
    first = F.when(outside, 0).otherwise(1)
    key = F.when(outside, stable_key(namespace + ":outside", c)).otherwise(stable_key(namespace + ":train", c))
    w = Window.partitionBy(flag).orderBy(first, key, c)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n_per_flag).withColumn("final_key", stable_key(namespace + ":order", c))


def ratio_sample(df: DataFrame, c: str, flag: Column, n: int, ratio: float, namespace: str) -> DataFrame:
    """n exposures, round(n * ratio) of them with the flag, each pool repeated in reshuffled epochs; (id, flagged, epoch, slot).

    Within an epoch no row comes twice. Whole epochs need no order, for they use all rows; only the head of each pool's last epoch is sorted out.
    """
    want = {True: round(n * ratio), False: n - round(n * ratio)}
    d = df.select(F.col(c).alias("id"), flag.alias("flagged"))
    pools = {r["flagged"]: r["pool"] for r in d.groupBy("flagged").agg(F.count("*").alias("pool")).collect() if r["flagged"] is not None}  # two rows
    parts = []
    for flagged, pool in pools.items():
        whole, rest = divmod(want[flagged], pool)
        mine = d.filter(F.col("flagged") == flagged)
        if whole:
            parts.append(mine.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(whole - 1)))))
        if rest:
            key = F.sha2(F.concat_ws(":", F.lit(namespace), F.lit(whole), F.col("id").cast("string")), 256)
            parts.append(mine.orderBy(key, "id").limit(rest).withColumn("epoch", F.lit(whole)))
    out = reduce(DataFrame.unionByName, parts) if parts else d.limit(0).withColumn("epoch", F.lit(0))
    slot = F.sha2(F.concat_ws(":", F.lit(namespace + ":slot"), F.col("epoch"), F.col("id").cast("string")), 256)
    return out.select("id", "flagged", "epoch", slot.alias("slot_key"))


def _one_group(rows: DataFrame, run, schema: str, most: int = 5_000_000) -> DataFrame:
    """Runs a sequential pick over a candidate pool in one task; a pool of more than ``most`` rows fails rather than swamps it."""
    names = rows.columns

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, n = [], 0
        for b in batches:
            n += len(b)
            if n > most:
                raise ValueError(f"a sequential pick is for pools of at most {most} rows; narrow the pool first")
            parts.append(b)
        yield run(pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names))

    return rows.repartition(1).mapInPandas(whole, schema)


def _heads(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; a literal limit, which Spark takes in each task before it sorts groups."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")


def greedy_round_robin(
    df: DataFrame, c: str, text: str, source: str, score: str, n: int, per_source: int, rounds: int = 8, namespace: str = "", seed: int = 42, strict: bool = True
) -> DataFrame:
    """(id, round): rounds over the texts, best r-th candidate first; each takes its first row not taken whose source has room.

    Candidates of a text go by score, then by sha256 of 'seed:namespace:text:id'; texts of a round by the score of their r-th candidate, then by
    sha256 of 'seed:gt-round:round:text'. Fails if there are fewer than n, if ``strict``. A text takes at most ``rounds`` rows, and of one source
    at most ``per_source``: only so many of the best of each text, and of each text and source, reach the pick. A null text takes no part.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:{namespace}:"), F.col(text), F.lit(":"), F.col(c).cast("string")), 256)
    rows = df.filter(F.col(text).isNotNull()).select(F.col(c).alias("id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"), F.col(score).cast("double").alias("score"), digest.alias("digest"))
    best = [F.desc("score"), F.col("digest"), F.col("id")]
    rows = _heads(rows, ["text"], best, rounds).unionByName(_heads(rows, ["text", "source"], best, min(per_source, rounds))).distinct()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["text", "score", "digest", "id"], ascending=[True, False, True, True])
        groups = {t: list(zip(g["id"], g["source"], g["score"])) for t, g in p.groupby("text", sort=False)}
        used: dict = {}
        taken: set = set()
        out = []
        for r in range(rounds):
            mark = {t: hashlib.sha256(f"{seed}:gt-round:{r}:{t}".encode()).hexdigest() for t, g in groups.items() if r < len(g)}
            for t in sorted(mark, key=lambda t: (-groups[t][r][2], mark[t])):
                if len(out) == n:
                    break
                got = next(((i, s) for i, s, _ in groups[t] if i not in taken and used.get(s, 0) < per_source), None)
                if got:
                    taken.add(got[0])
                    used[got[1]] = used.get(got[1], 0) + 1
                    out.append((got[0], r))
        return _enough(pd.DataFrame(out, columns=["id", "round"]), n, strict)

    return _one_group(rows, run, "id long, round int")


def _enough(picked: pd.DataFrame, n: int, strict: bool) -> pd.DataFrame:
    if strict and len(picked) < n:
        raise ValueError(f"only {len(picked)} of {n} rows can be picked")
    return picked


def select_training(df: DataFrame, c: str, source: str, text: str, place: str, n: int, used_texts: DataFrame, used: str, namespace: str, strict: bool = True) -> DataFrame:
    """(id, fallback): n rows, at most one a source. First, in the sources' hash order, each source's first row whose text neither ``used_texts``
    has nor another source took; then, where that is not enough, sources left over in the order of their rarest text give its row
    (rarest, then unused, then first in ``place``). Fails if there are fewer than n, if ``strict``. Rows without source or text take no part.
    """
    d = df.select(F.col(c).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"), F.coalesce(F.col(place).cast("long"), F.lit((1 << 62))).alias("place")).filter("source IS NOT NULL AND text IS NOT NULL")
    taken = used_texts.select(F.col(used).alias("text")).filter("text IS NOT NULL").distinct().withColumn("taken", F.lit(True))
    n_text = d.groupBy("text").agg(F.count("*").alias("frequency"))
    d = d.join(n_text, "text").join(taken, "text", "left").withColumn("key", stable_key(namespace, "id"))
    # Of equal texts of a source only the first by hash, or the first by place, can be picked.
    one = d.groupBy("source", "text").agg(
        F.min_by("id", F.struct("key", "id")).alias("id"), F.min("key").alias("key"), F.min_by("id", F.struct("place", "key", "id")).alias("early"), F.min("place").alias("place"), F.first("frequency").alias("frequency"), F.first(F.coalesce("taken", F.lit(False))).alias("taken")
    )

    def run(p: pd.DataFrame) -> pd.DataFrame:
        gone = set(p.loc[p["taken"], "text"])
        by = {s: list(g.sort_values(["key", "id"]).itertuples(index=False)) for s, g in p.groupby("source")}
        mark = lambda kind, s: hashlib.sha256(f"{namespace}:{kind}:{s}".encode()).hexdigest()
        out, left = [], []
        for s in sorted(by, key=lambda s: mark("source", s)):
            row = next((x for x in by[s] if x.text not in gone), None) if len(out) < n else None
            if row is None:
                left.append(s)
            else:
                gone.add(row.text)
                out.append((row.id, False))
        for s in sorted(left, key=lambda s: (min(x.frequency for x in by[s]), mark("fallback", s))):
            if len(out) == n:
                break
            row = min(by[s], key=lambda x: (x.frequency, x.text in gone, x.place, x.key))
            gone.add(row.text)
            out.append((row.early, True))
        return _enough(pd.DataFrame(out, columns=["id", "fallback"]), n, strict)

    return _one_group(one, run, "id long, fallback boolean")


def quota_unique(df: DataFrame, c: str, by: str, source: str, text: str, quota: dict[str, int], namespace: str, strict: bool = True) -> DataFrame:
    """(id, category): per category, in its name's order, ``quota`` rows in the sources' hash order; no source and no text comes twice over all
    categories. Fails if a quota is not met, if ``strict``. Rows without source or text take no part."""
    d = df.select(F.col(c).alias("id"), F.col(by).alias("category"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")).filter(F.col("category").isin(*quota) & F.col("source").isNotNull() & F.col("text").isNotNull())
    # Of equal texts of a source only the first by hash can be picked.
    one = d.withColumn("key", stable_key(namespace, "id")).groupBy("category", "source", "text").agg(F.min(F.struct("key", "id")).alias("m")).select("category", "source", "text", "m.key", "m.id")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        sources, texts, out = set(), set(), []
        for g, rows in sorted(p.groupby("category")):
            by_source = {s: list(x.sort_values(["key", "id"]).itertuples(index=False)) for s, x in rows.groupby("source")}
            n = 0
            for s in sorted(by_source, key=lambda s: hashlib.sha256(f"{namespace}:{g}:{s}".encode()).hexdigest()):
                if n == quota[g]:
                    break
                row = None if s in sources else next((x for x in by_source[s] if x.text not in texts), None)
                if row is not None:
                    sources.add(s)
                    texts.add(row.text)
                    out.append((row.id, g))
                    n += 1
        return _enough(pd.DataFrame(out, columns=["id", "category"]), sum(quota.values()), strict)

    return _one_group(one, run, "id long, category string")


def greedy_unique(df: DataFrame, c: str, source: str, text: str) -> DataFrame:
    """(source, id): sources with the fewest different texts first; each takes its rarest, then longest, text no other source took."""
    # Of equal texts of a source only the least id can be taken.
    rows = df.select(F.col(c).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")).groupBy("source", "text").agg(F.min("id").alias("id"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        freq = p.groupby("text")["source"].nunique().to_dict()
        by = {s: sorted(g.itertuples(index=False), key=lambda x: (freq[x.text], -len(x.text), x.text, x.id)) for s, g in p.groupby("source")}
        used, out = set(), []
        for s in sorted(by, key=lambda s: (len({x.text for x in by[s]}), s)):
            for x in by[s]:
                if x.text not in used:
                    used.add(x.text)
                    out.append((s, x.id))
                    break
        return pd.DataFrame(out, columns=["source", "id"])

    return _one_group(rows, run, "source string, id long")


def ranked_and_random(df: DataFrame, c: str, by: str, source: str, rank: list[Column], quota: dict[str, int], namespace: str, strict: bool = True) -> DataFrame:
    """(id, category, chosen_by): per category, in its name's order, half of its quota (rounded down) by rank and the rest by hash order; no source
    comes twice over all categories. Fails if a quota is not met, if ``strict``. Rows without a source take no part.

    All picks use up at most as many sources as there are picks, so each category's best rows of that many sources, by either order, are enough.
    """
    total = sum(quota.values())
    d = df.filter(F.col(source).isNotNull() & F.col(by).isin(*quota)).withColumn("_key", stable_key(namespace, c))
    orders = {"rank": [*rank, F.col(c)], "random": [F.col("_key"), F.col(c)]}
    parts = []
    for how, order in orders.items():
        best = _heads(_heads(d, [by, source], order, 1), [by], order, total + max(quota.values(), default=0))
        place = F.row_number().over(Window.partitionBy(by).orderBy(*order))  # of a bounded number of rows
        parts.append(best.select(F.col(c).alias("id"), F.col(by).alias("category"), F.col(source).cast("string").alias("source"), F.lit(how).alias("chosen_by"), place.alias("place")))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for g in sorted(quota):
            n = 0
            for how, most in (("rank", quota[g] // 2), ("random", quota[g])):
                for x in p[(p["category"] == g) & (p["chosen_by"] == how)].sort_values("place").itertuples(index=False):
                    if n == most:
                        break
                    if x.source not in used:
                        used.add(x.source)
                        out.append((x.id, g, how))
                        n += 1
        return _enough(pd.DataFrame(out, columns=["id", "category", "chosen_by"]), total, strict)

    return _one_group(reduce(DataFrame.unionByName, parts), run, "id long, category string, chosen_by string")
