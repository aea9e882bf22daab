"""Edit-distance metrics and the classification of answers against a text with errors."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillflow.functions.text import canonical, punctuation_insensitive

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("operation", T.StringType()),
            T.StructField("gt_start", T.IntegerType()),
            T.StructField("gt_end", T.IntegerType()),
            T.StructField("error", T.StringType()),
            T.StructField("correct", T.StringType()),
            T.StructField("single_correction_variant", T.StringType()),
        ]
    )
)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distance(a: str | Column, b: str | Column) -> Column:
    """Edit distance in code points; null counts as ''."""
    return F.levenshtein(F.coalesce(_c(a), F.lit("")), F.coalesce(_c(b), F.lit("")))


def cer(reference: str | Column, answer: str | Column) -> Column:
    """Distance over the reference's length (1 at least); may exceed 1."""
    return distance(reference, answer) / F.greatest(F.lit(1), F.length(F.coalesce(_c(reference), F.lit(""))))


def closer_to(to_reference: Column, to_corrected: Column) -> Column:
    return F.when(to_reference < to_corrected, "ground_truth").when(to_corrected < to_reference, "corrected").otherwise("tie")


def strict_score(reference: str | Column, corrected: str | Column, answer: str | Column) -> Column:
    """A struct of the strict rule: the answer equals the text with errors, the corrected text, or neither; both distances."""
    r, k, a = (F.coalesce(_c(x), F.lit("")) for x in (reference, corrected, answer))
    dr, dk = distance(r, a), distance(k, a)
    kept, fixed = a == r, a == k
    return F.struct(
        kept.alias("error_preserved"), fixed.alias("over_corrected"), (~kept & ~fixed).alias("recognition_error"),
        F.when(kept, "error_preserved").when(fixed, "over_corrected").otherwise("recognition_error").alias("classification"),
        dr.alias("distance_to_ground_truth"), dk.alias("distance_to_corrected"), (dr / F.greatest(F.lit(1), F.length(r))).alias("cer"), closer_to(dr, dk).alias("closer_to"),
    )


def _spans(wrong: str, right: str) -> list[tuple]:
    ops = difflib.SequenceMatcher(None, wrong, right, autojunk=False).get_opcodes()
    return [(op, a, b, wrong[a:b], right[c:d], wrong[:a] + right[c:d] + wrong[b:]) for op, a, b, c, d in ops if op != "equal"]


@F.pandas_udf(SPANS)
def _span_udf(wrong: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_spans(a, b) if isinstance(a, str) and isinstance(b, str) else None for a, b in zip(wrong, right)], dtype=object)


def correction_spans(reference: str | Column, corrected: str | Column) -> Column:
    """The differing spans of both texts by longest matching blocks, each with the reference in which that span alone is corrected."""
    return _span_udf(_c(reference), _c(corrected))


def score_spans(spans: str | Column, reference: str | Column, answer: str | Column) -> Column:
    """Each span with its outcome: over-corrected if the answer is nearer to the text with that span corrected, preserved if farther."""
    base = distance(reference, answer)

    def one(s: Column) -> Column:
        d = distance(s["single_correction_variant"], answer)
        return F.struct(
            *(s[f.name].alias(f.name) for f in SPANS.elementType.fields), F.when(d < base, "over_corrected").when(d > base, "error_preserved").otherwise("other_recognition_error").alias("outcome"),
            base.alias("distance_to_error_ground_truth"), d.alias("distance_to_single_correction"),
        )

    return F.transform(_c(spans), one)


def sample_class(scored: str | Column, reference: str | Column, answer: str | Column) -> Column:
    """Equal texts are preserved; else any over-corrected span decides; else the row is another recognition error."""
    return F.when(_c(reference) == _c(answer), "error_preserved").when(F.exists(_c(scored), lambda s: s["outcome"] == "over_corrected"), "over_corrected").otherwise("other_recognition_error")


def error_flags(reference: str | Column, corrected: str | Column, answer: str | Column) -> Column:
    """A struct on texts without punctuation: both distances, CER, whether the answer is the corrected text, and whether only punctuation sets it apart from the reference."""
    r, k, a = (punctuation_insensitive(x) for x in (reference, corrected, answer))
    d = distance(r, a)
    return F.struct(
        d.alias("distance_to_ground_truth"), distance(k, a).alias("distance_to_corrected"), (d / F.greatest(F.lit(1), F.length(r))).alias("cer"), (a == k).alias("exact_corrected_match"),
        ((a == r) & (canonical(answer) != canonical(reference))).alias("punctuation_only_difference"),
    )


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; 0 where the whole is 0."""
    return F.when(whole != 0, 100.0 * part / F.when(whole != 0, whole).otherwise(1)).otherwise(0.0)


def tradeoff(overall_cer: Column, over_corrected: Column, error_preserved: Column, normal_preserved: Column) -> Column:
    """Lower is better."""
    return overall_cer + over_corrected + (1 - error_preserved) + (1 - normal_preserved)


def last_subsequence(values: str | Column, needle: str | Column) -> Column:
    """0-based start of the last place where ``needle`` stands in ``values``; null if nowhere or empty."""
    v, n = _c(values), _c(needle)
    last = F.size(v) - F.size(n)
    starts = F.when((F.size(n) > 0) & (last >= 0), F.sequence(F.lit(0), F.greatest(F.lit(0), last))).otherwise(F.array().cast("array<int>"))
    return F.array_max(F.filter(starts, lambda i: F.slice(v, i + 1, F.size(n)) == n))


def mask_before(ids: str | Column, start: str | Column, fill: int = -100) -> Column:
    """The array with everything before ``start`` replaced."""
    s = _c(start)
    return F.transform(_c(ids), lambda x, i: F.when(i < s, F.lit(fill)).otherwise(x))


def chat(*turns: tuple[str, Column]) -> Column:
    """An array of (role, content) turns."""
    return F.array(*(F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in turns))


def generated_text(output: str | Column) -> Column:
    """The text of a generator's JSON output: generated_text or text of the (first) object, else its last assistant message."""
    j = F.regexp_replace(_c(output), r"^\s*\[([\s\S]*)\]\s*$", "$1")
    direct = F.coalesce(F.get_json_object(j, "$.generated_text"), F.get_json_object(j, "$.text"))
    msgs = F.from_json(direct, "array<struct<role:string,content:string>>")
    mine = F.filter(msgs, lambda m: m["role"] == "assistant")
    spoken = F.when(F.size(mine) > 0, F.element_at(mine, -1)["content"])
    parts = F.from_json(spoken, "array<struct<type:string,text:string>>")
    joined = F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda p: p["text"]), ""))
    return F.coalesce(joined, spoken, direct)
