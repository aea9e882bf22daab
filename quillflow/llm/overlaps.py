"""Problem 3: same or near-same records across splits.

Edit-distance segment join. Texts are compared by their letters, digits and marks alone, in one character form and
without case. Two texts are near if their edit distance is at most a tenth of the longer one's length.
An evaluation text of n characters is cut into floor(n / 9) + 1 even segments, one more than the edits any near
text can have, so at least one segment stands unchanged in every near training text, at a place that the edits
before and behind it allow. Segments and allowed training substrings meet in an equi-join on a hash of content and
place; the join also compares parity signatures (one edit flips at most two of 64 bits), so that phrases shared by
many texts cost a comparison of two numbers and are not passed on. What is left is verified by banded dynamic
programming. For evaluation texts over ``PLACED`` characters the place is left out of the hash: the number of keys
then stays linear in the length.

Training substrings are tested against a bit table of the segments before they leave their task, so only those that can
meet one are shuffled. The table has ``BITS`` bits whatever the data: with more segments it lets more through and loses
nothing. A segment so common that its pairs pass ``PER_TASK`` is split: its training side by hash, its evaluation side copied to each part.

Records are never paired while they are compared. Records of one side with the same text, hash or id form a class (told apart by
128 bits), classes are linked, and ``expand`` gives the pairs of records only to whoever asks for them.

Edge cases: null and blank texts, hashes and ids match nothing; repeated rows are members like others, and pairs are given once;
an empty side gives no links; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillflow.llm.charforms import fold
from quillflow.session import Workspace

#: One edit in so many characters is allowed.
ONE_IN = 10
#: Longest evaluation text whose segments are matched by place as well.
PLACED = 90
#: Size of the table of segments; pairs of a segment that one task compares.
BITS, PER_TASK = 1 << 25, 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_KEYS = T.StructType([T.StructField("id", T.LongType()), T.StructField("sig", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])


@F.pandas_udf(T.StringType())
def loose(s: pd.Series) -> pd.Series:
    """Letters, digits and marks in one form, without case; null for null or if nothing is left."""
    def one(x):
        if not isinstance(x, str):
            return None
        y = "".join(c for c in fold(x).casefold() if c.isalnum() or unicodedata.combining(c))
        return y or None

    return s.map(one)


def edits(n: int, m: int) -> int:
    return max(n, m) // ONE_IN


def _cuts(n: int) -> list[tuple[int, int]]:
    """(start, length) of an evaluation text's segments."""
    m = n // (ONE_IN - 1) + 1
    at = [i * n // m for i in range(m + 1)]
    return [(at[i], at[i + 1] - at[i]) for i in range(m)]


def _near_lengths(n: int) -> range:
    """Lengths of evaluation texts that can be near a text of n characters."""
    lo = n
    while lo > 1 and n - (lo - 1) <= edits(n, lo - 1):
        lo -= 1
    hi = n
    while hi + 1 - n <= edits(n, hi + 1):
        hi += 1
    return range(lo, hi + 1)


def _places(n: int) -> list[tuple[int, int, int]]:
    """(start, length, tag) of the substrings of a training text of n characters that can equal a segment there."""
    out = []
    free: set[int] = set()
    for le in _near_lengths(n):
        cuts = _cuts(le)
        if le > PLACED:
            free |= {ln for _, ln in cuts}
            continue
        last, shift = len(cuts) - 1, n - le
        for i, (p, ln) in enumerate(cuts):
            lo = max(0, p - i, p + shift - (last - i))
            hi = min(n - ln, p + i, p + shift + (last - i))
            out += [(s, ln, le * 256 + i + 1) for s in range(lo, hi + 1)]
    for ln in free:
        out += [(s, ln, 0) for s in range(n - ln + 1)]
    return out


def _mix(h: np.ndarray, ln: int, tag: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ np.uint64((tag * 0x9E3779B1 + ln * 0x85EBCA77) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _keyed(ids: np.ndarray, texts: list[str], cut: bool) -> Iterator[pd.DataFrame]:
    """Hash keys and signatures of texts, worked on by length so that each step covers all texts of one length."""
    by: dict[int, list[int]] = {}
    for k, t in enumerate(texts):
        by.setdefault(len(t), []).append(k)
    for n, rows in by.items():
        a = np.frombuffer("".join(texts[k] for k in rows).encode("utf-32-le"), dtype=np.uint32).reshape(len(rows), n).astype(np.uint64)
        with np.errstate(over="ignore"):
            bit = np.uint64(1) << ((a * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(58))
            sig = np.bitwise_xor.reduce(bit, axis=1)
            pre = np.zeros((len(rows), n + 1), dtype=np.uint64)
            for j in range(n):
                pre[:, j + 1] = pre[:, j] * _BASE + a[:, j] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
            power = [np.uint64(1)]
            for _ in range(n):
                power.append(power[-1] * _BASE)
            spots = [(p, ln, n * 256 + i + 1 if n <= PLACED else 0) for i, (p, ln) in enumerate(_cuts(n))] if cut else _places(n)
            keys = np.empty((len(rows), len(spots)), dtype=np.uint64)
            for c, (s, ln, tag) in enumerate(spots):
                keys[:, c] = _mix(pre[:, s + ln] - pre[:, s] * power[ln], ln, tag)
        yield pd.DataFrame({"id": ids[rows], "sig": sig.view(np.int64), "n": np.int32(n), "keys": list(keys.view(np.int64))})


def keyed(texts: DataFrame, cut: bool, table: Broadcast | None = None) -> DataFrame:
    """(id, sig, n, key): one row per segment of an evaluation text (``cut``) or allowed substring of a training text that is in the table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 2000):
                for got in _keyed(pdf["id"].to_numpy()[a : a + 2000], list(pdf["text"])[a : a + 2000], cut):
                    if table is not None:
                        got["keys"] = [k[_there(k, table.value)] for k in got["keys"]]
                        got = got[[len(k) > 0 for k in got["keys"]]]
                    yield got

    got = texts.select("id", "text").mapInPandas(run, _KEYS)
    return got.select("id", "sig", "n", F.explode(F.array_distinct("keys")).alias("key"))


def _there(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = keys & (BITS - 1)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _table(keys: DataFrame) -> Broadcast:
    """Which of the ``BITS`` places have a segment: at most BITS / 64 numbers reach the driver."""
    spark = keys.sparkSession
    at = F.col("key").bitwiseAND(F.lit(BITS - 1))
    words = keys.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("b")).toArrow()
    full = np.zeros(BITS // 64, dtype=np.int64)
    full[words["w"].to_numpy()] = words["b"].to_numpy()
    return spark.sparkContext.broadcast(full.view(np.uint8))


def near_texts(evaluation: DataFrame, training: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(id_e, id_t) of different texts (id, text; each text once a side) that are near but not equal."""
    ws = ws or Workspace(evaluation.sparkSession, "near")
    e = ws.save(keyed(evaluation, True), "segments")
    t = ws.save(keyed(training, False, _table(e)), "substrings")
    e, t = (x.select(F.col("id").alias(f"id_{y}"), F.col("sig").alias(f"sig_{y}"), F.col("n").alias(f"n_{y}"), "key") for x, y in ((e, "e"), (t, "t")))
    pairs = F.col("c_e") * F.col("c_t")
    hot = e.groupBy("key").agg(F.count("*").alias("c_e")).join(t.groupBy("key").agg(F.count("*").alias("c_t")), "key").filter(pairs > PER_TASK)
    hot = ws.save(hot.select("key", F.ceil(pairs / PER_TASK).cast("int").alias("parts")), "hot")
    parts = F.coalesce("parts", F.lit(1))
    e = e.join(hot, "key", "left").select("id_e", "sig_e", "n_e", "key", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    t = t.join(hot, "key", "left").select("id_t", "sig_t", "n_t", "key", F.pmod(F.xxhash64("id_t"), parts).cast("int").alias("part"))
    k = (F.greatest("n_e", "n_t") / ONE_IN).cast("int")
    same_bits = F.bit_count(F.col("sig_e").bitwiseXOR(F.col("sig_t"))) <= k * 2
    hit = e.hint("merge").join(t, ["key", "part"]).filter(same_bits & (F.abs(F.col("n_e") - F.col("n_t")) <= k)).select("id_e", "id_t").distinct()
    hit = hit.join(evaluation.select(F.col("id").alias("id_e"), F.col("text").alias("e")).hint("merge"), "id_e").join(training.select(F.col("id").alias("id_t"), F.col("text").alias("t")).hint("merge"), "id_t")
    hit = hit.filter("e <> t")
    n = F.greatest(F.length("e"), F.length("t"))
    d = F.levenshtein("e", "t")
    for most in (100_000, 10_000, 1_000, 100):  # the width of the band grows with the length; -1 is beyond it
        d = F.when(n <= most, F.levenshtein("e", "t", most // ONE_IN)).otherwise(d)
    return hit.filter((d >= 0) & (d <= (n / ONE_IN).cast("int"))).select("id_e", "id_t")


class Overlaps(NamedTuple):
    """members (side, kind, row, rep): the class of each record by each kind of key, named by its least record of that side;
    links (kind, rep_e, rep_t): classes that overlap, of kind ``near_text`` where their texts are near but not equal."""

    members: DataFrame
    links: DataFrame


def _keys(rows: DataFrame, side: str, row: str, texts: list[str], keys: dict[str, Column]) -> DataFrame:
    """(side, kind, row, k1, k2, text) of each key that says something; the text only of texts."""
    said = F.array_distinct(F.array(*(loose(F.col(f"`{x}`")) for x in texts)))
    r = F.col(f"`{row}`").alias("row")
    others = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in keys.items()))
    t = rows.select(r, F.explode(said).alias("key")).select("row", F.lit("text").alias("kind"), "key")
    o = rows.select(r, F.explode(others).alias("o")).select("row", "o.kind", "o.key")
    all_ = (t.unionByName(o) if keys else t).filter("key IS NOT NULL")
    return all_.select(F.lit(side).alias("side"), "kind", "row", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2"), F.when(F.col("kind") == "text", F.col("key")).alias("text"))


def overlaps(evaluation: DataFrame, training: DataFrame, row: str, eval_texts: list[str], train_texts: list[str], keys: dict[str, tuple[Column, Column]]) -> Overlaps:
    """Classes and links of records that share a text almost, or one of ``keys`` (a kind to a column of each side)."""
    ws = Workspace(evaluation.sparkSession, "overlaps")
    both = _keys(evaluation, "e", row, eval_texts, {k: v[0] for k, v in keys.items()}).unionByName(_keys(training, "t", row, train_texts, {k: v[1] for k, v in keys.items()}))
    both = ws.save(both, "keys")
    classes = both.groupBy("side", "kind", "k1", "k2").agg(F.min("row").alias("rep"), F.first("text").alias("text"))
    classes = ws.save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = ws.save(both.select("side", "kind", "row", "k1", "k2").distinct().join(classes.drop("text", "id").hint("merge"), ["side", "kind", "k1", "k2"]).select("side", "kind", "row", "rep"), "members")
    side = lambda x: classes.filter(F.col("side") == x)
    equal = side("e").select("kind", "k1", "k2", F.col("rep").alias("rep_e")).hint("merge").join(side("t").select("kind", "k1", "k2", F.col("rep").alias("rep_t")), ["kind", "k1", "k2"])
    texts = lambda x: side(x).filter("kind = 'text'").select("id", "text")
    near = near_texts(texts("e"), texts("t"), ws)
    reps = lambda x: side(x).select(F.col("id").alias(f"id_{x}"), F.col("rep").alias(f"rep_{x}")).hint("merge")
    near = near.join(reps("e"), "id_e").join(reps("t"), "id_t").select(F.lit("near_text").alias("kind"), "rep_e", "rep_t")
    links = ws.save(equal.select("kind", "rep_e", "rep_t").unionByName(near), "links")
    return Overlaps(members, links)


def expand(found: Overlaps) -> DataFrame:
    """(row_e, row_t, kind): every pair of records of linked classes."""
    links = found.links.withColumn("by", F.when(F.col("kind") == "near_text", "text").otherwise(F.col("kind")))
    side = lambda x: found.members.filter(F.col("side") == x).select(F.col("kind").alias("by"), F.col("rep").alias(f"rep_{x}"), F.col("row").alias(f"row_{x}"))
    return links.join(side("e").hint("merge"), ["by", "rep_e"]).join(side("t").hint("merge"), ["by", "rep_t"]).select("row_e", "row_t", "kind").distinct()
