"""Ordered first-match rules: every filter has a reason."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.functions import text as X

# Runs that look like personal data.
PERSONAL = {
    "email": r"(?iU)\b[\w.+-]+@[\w.-]+\.[a-z]{2,}\b",
    "phone": r"(?<![0-9])(01[016789][- ]?[0-9]{3,4}[- ]?[0-9]{4}|0[0-9]{1,2}[- ]?[0-9]{3,4}[- ]?[0-9]{4})(?![0-9])",
    "resident_number": r"(?<![0-9])[0-9]{6}[- ]?[1-4][0-9]{6}(?![0-9])",
    "long_digits": r"[0-9]{7,}",
    "url": r"(?iU)(https?://|www\.)\S+",
}
# What a text for recognition must not hold; digits are counted without blanks.
EMAIL_LIKE, LONG_DIGITS = r"(?U)[^\s@]+@[^\s@]+\.[^\s@]+", r"(?U)\d{7,}"
# Fixed value: a sentence's end.
TERMINAL = r"[.!?。！？]\s*$"


class Rule(NamedTuple):
    """A reason and the condition under which a row gets it; a null condition does not apply."""

    reason: str
    when: Column


def first_match(rules: Sequence[Rule], otherwise: str = "accepted") -> Column:
    """The reason of the first rule that applies."""
    out = F.lit(otherwise)
    for r in reversed(rules):
        out = F.when(F.coalesce(r.when, F.lit(False)), F.lit(r.reason)).otherwise(out)
    return out


def all_matches(rules: Sequence[Rule]) -> Column:
    """The reasons of all rules that apply, in order."""
    return F.filter(F.array(*(F.when(F.coalesce(r.when, F.lit(False)), F.lit(r.reason)) for r in rules)), lambda x: x.isNotNull())


def route(df: DataFrame, rules: Sequence[Rule], reason: str = "reason") -> DataFrame:
    """The rows with their reason."""
    return df.withColumn(reason, first_match(rules))


def reason_counts(df: DataFrame, reason: str = "reason", *by: str) -> DataFrame:
    """Rows per reason, beside every filter."""
    return df.groupBy(*by, reason).agg(F.count("*").alias("n"))


def text_rules(text: str, least: int = 2, script: str = "[가-힣]", digits: float = 0.2) -> list[Rule]:
    """Rules for a usable short text: something, enough of it, in the script, no address or number, not mostly digits."""
    t = F.col(text)
    return [
        Rule("non_string", t.isNull()),
        Rule("empty", X.collapse(t) == ""),
        Rule("too_short", X.nonspace_length(t) < least),
        Rule("not_in_script", ~t.rlike(script)),
        Rule("email_like", t.rlike(EMAIL_LIKE)),
        Rule("long_digit_sequence", X.nonspace(t).rlike(LONG_DIGITS)),
        Rule("digit_ratio", X.digit_ratio(t) > digits),
    ]


def personal(text: str | Column) -> Column:
    """Whether any pattern of personal data occurs."""
    t = F.col(text) if isinstance(text, str) else text
    out = F.lit(False)
    for p in PERSONAL.values():
        out = out | t.rlike(p)
    return F.coalesce(out, F.lit(False))


def mostly_symbols(text: str | Column, least: float = 0.5) -> Column:
    """Whether less than ``least`` of the characters are of the script; true for empty text."""
    return X.hangul_ratio(text) < least


def ends_with_any(text: str | Column, endings: Sequence[str]) -> Column:
    """Whether the text, without sentence marks at its end, ends with one of the endings."""
    t = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(F.coalesce(t, F.lit("")), r"[\s.!?。！？…,]+$", "")
    return bare.rlike("(" + "|".join(sorted(set(endings), key=len, reverse=True)) + ")$")


def terminal(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(t.rlike(TERMINAL), F.lit(False))


def is_true(c: str | Column) -> Column:
    """Three-valued flags: only true is true."""
    c = F.col(c) if isinstance(c, str) else c
    return c.eqNullSafe(F.lit(True))
