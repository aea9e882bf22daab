"""Problem 8: mixing sources to target weights.

Entropy balancing. Among all document rates within [0, max_repeats] that give each source its share of the tokens, those
nearest to the uniform rate (in relative entropy) are exponentially tilted: rate = cap or base * exp(lambda_s * tokens / scale),
whichever is less. The multipliers solve a convex dual, found by Newton steps over distributed sums. A rate depends on a
document only through its source and token count, so one aggregate to (source, tokens, documents) holds all that the
iterations need; each iteration is one small aggregate to a row per source.

Rates become copies by floor(rate + u) with u from a hash of the document's id, moved per source by the offset that brings
the copied tokens nearest to the target; the offset comes from a histogram over ``BINS`` bins, so documents are never sorted.

The total: as given, or the tokens at hand, but at most what the caps allow at these shares.

Edge cases: a source without a target, a null source and a text of no tokens are left out (rate 0, copies 0); several spellings of
one source count together; a target without documents makes the total 0 unless its share is 0; repeated ids get the same u.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillflow.session import Workspace

BINS = 4096


# Fixed value: the pattern that splits text before the merges of a byte-level rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_count(text: Column, path: str) -> Column:
    """Tokens of a public tokenizer's file (ranks, or the JSON form), whole texts; 0 for null."""

    @F.pandas_udf(T.LongType())
    def count(s: pd.Series) -> pd.Series:
        n = _counter(path)
        return pd.Series([n(x) if isinstance(x, str) and x else 0 for x in s], dtype="int64")

    return count(text)


_LOADED: dict[str, Callable[[str], int]] = {}


def _counter(path: str) -> Callable[[str], int]:
    if path not in _LOADED:
        if path.endswith(".tiktoken"):
            import base64

            from tiktoken import Encoding

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            ordinary = Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _LOADED[path] = lambda x: len(ordinary(x))
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _LOADED[path] = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    return _LOADED[path]


def source_form(c: Column) -> Column:
    """One spelling of a source; null where missing or blank."""
    s = F.regexp_replace(F.lower(F.regexp_replace(c, r"[\p{Cf}]", "")), r"[^\p{L}\p{N}]+", "_")
    return F.nullif(F.regexp_replace(s, "^_+|_+$", ""), F.lit(""))


def solve(hist: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, rounds: int = 60, close: float = 1e-10) -> tuple[float, dict[str, tuple[float, float, float]]]:
    """(total, {source: (base, lambda, scale)}) from a histogram (source, tokens, docs).

    A row per source is all that reaches the driver in each round.
    """
    have = {r["source"]: (r["w"], r["n"], r["w2"]) for r in hist.groupBy("source").agg(F.sum(F.col("tokens") * F.col("docs")).alias("w"), F.sum("docs").alias("n"), F.sum(F.col("tokens").cast("double") * F.col("tokens") * F.col("docs")).alias("w2")).collect()}
    have = {s: have.get(s, (0, 0, 0.0)) for s in targets}
    most = min((c * have[s][0] / share for s, (share, c) in targets.items() if share > 0), default=0.0)
    total = min(most, float(sum(w for w, _, _ in have.values())) if total is None else total)
    want = {s: share * total for s, (share, _) in targets.items()}
    todo, par = set(), {}
    for s, (w, n, w2) in have.items():
        cap = targets[s][1]
        if not w or not want[s]:
            par[s] = (0.0, 0.0, 1.0)
        elif want[s] >= cap * w * (1 - 1e-12):
            par[s] = (float(cap), 0.0, 1.0)  # the cap itself: every document as often as allowed
        else:
            par[s] = (total / sum(x for x, _, _ in have.values()), 0.0, w2 / w)
            todo.add(s)
    best: dict[str, tuple[float, float]] = {}  # the multipliers between which the sum crosses its target
    for _ in range(rounds):
        if not todo:
            break
        rate, free = _rate(par, {s: targets[s][1] for s in par})
        part = hist.filter(F.col("source").isin(*todo)).withColumn("r", rate).withColumn("free", free)
        sums = part.groupBy("source").agg(
            F.sum(F.col("r") * F.col("tokens") * F.col("docs")).alias("got"), F.sum(F.when(F.col("free"), F.col("r") * F.col("tokens") * F.col("tokens") * F.col("docs")).otherwise(0.0)).alias("slope")
        )
        for g in sums.collect():
            s, (base, lam, scale) = g["source"], par[g["source"]]
            gap = want[s] - g["got"]
            if abs(gap) <= close * want[s]:
                todo.discard(s)
                continue
            lo, hi = best.get(s, (-math.inf, math.inf))
            lo, hi = (lam, hi) if gap > 0 else (lo, lam)
            best[s] = lo, hi
            step = lam + (gap * scale / g["slope"] if g["slope"] > 0 else math.copysign(1.0, gap))
            step = min(max(step, lam - 5.0), lam + 5.0)
            if not lo < step < hi:
                step = (lo + hi) / 2 if math.isfinite(lo + hi) else (lo + 1.0 if hi == math.inf else hi - 1.0)
            par[s] = (base, step, scale)
    return total, par


def _rate(par: dict[str, tuple[float, float, float]], caps: dict[str, int]) -> tuple[Column, Column]:
    """(rate, whether it is below the cap) from columns source and tokens."""
    base = cap = expo = F.lit(None).cast("double")
    for s, (b, lam, scale) in par.items():
        hit = F.col("source") == s
        base = F.when(hit, F.lit(b)).otherwise(base)
        cap = F.when(hit, F.lit(float(caps[s]))).otherwise(cap)
        expo = F.when(hit, F.least(F.lit(700.0), F.lit(lam / scale) * F.col("tokens"))).otherwise(expo)
    raw = base * F.exp(expo)
    return F.least(raw, cap), raw < cap


def mix(documents: DataFrame, doc_id: str, source: Column, tokens: str, targets: dict[str, tuple[float, int]], total: float | None = None, seed: int = 42, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, source, tokens, rate, copies) of every document; ``targets``: source to (share, max_repeats), one row per source."""
    ws = ws or Workspace(documents.sparkSession, "mix")
    d = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), source.alias("source"), F.col(f"`{tokens}`").alias("tokens"))
    d = ws.save(d, "tokens")
    known = d.filter(F.col("source").isin(*targets) & (F.col("tokens") > 0))
    hist = ws.save(known.groupBy("source", "tokens").agg(F.count("*").alias("docs")), "hist")
    total, par = solve(hist, targets, total)
    rate, _ = _rate(par, {s: c for s, (_, c) in targets.items()})
    rated = d.withColumn("rate", F.when(F.col("tokens") > 0, F.coalesce(rate, F.lit(0.0))).otherwise(0.0))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") / float(1 << 53)
    whole = F.floor("rate").cast("int")
    rated = rated.withColumn("whole", whole).withColumn("need", 1 - (F.col("rate") - whole) - u)  # a further copy if need <= offset
    # Copied tokens as a function of the offset, in bins; the offset of each source is the bin's edge nearest to its target.
    b = F.floor((F.col("need") + 1) / 2 * BINS).cast("int")
    h = rated.filter((F.col("rate") > 0) & F.col("source").isin(*targets)).groupBy("source", F.when(F.col("rate") > F.col("whole"), b).alias("bin")).agg(F.sum(F.col("whole") * F.col("tokens")).alias("sure"), F.sum("tokens").alias("more"))
    offsets, by = {}, {}
    for r in h.collect():  # at most BINS + 1 rows per source
        by.setdefault(r["source"], []).append((r["bin"], r["sure"], r["more"]))
    for s, (share, _) in targets.items():
        rows = sorted(by.get(s, []), key=lambda r: (r[0] is None, r[0]))
        have, want = sum(r[1] for r in rows), share * total
        near = (abs(have - want), -1)
        for k, _, extra in rows:
            if k is not None:
                have += extra
                near = min(near, (abs(have - want), k))
        offsets[s] = near[1]
    off = F.lit(-1)
    for s, k in offsets.items():
        off = F.when(F.col("source") == s, F.lit(k)).otherwise(off)
    more = (F.col("rate") > F.col("whole")) & (b <= off)
    return rated.select("doc_id", "source", "tokens", "rate", (F.col("whole") + F.when(more, 1).otherwise(0)).alias("copies"))


def shares(mixed: DataFrame, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """Per source: its target share and what the copies reach."""
    spark = mixed.sparkSession
    t = spark.createDataFrame([(s, x, c) for s, (x, c) in targets.items()], "source string, target_share double, max_repeats int")
    g = mixed.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens_at_hand"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens_mixed"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies")
    )
    j = t.join(g, "source", "left").withColumn("total", F.sum("tokens_mixed").over(Window.partitionBy()))  # a row per target
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("source", "target_share", "max_repeats", z("n_docs"), z("tokens_at_hand"), z("tokens_mixed"), z("copies"), z("most_copies"), (F.coalesce("tokens_mixed", F.lit(0)) / F.greatest(F.lit(1), F.coalesce("total", F.lit(0)))).alias("reached_share"))
