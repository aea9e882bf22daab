"""Text columns, on the JVM side wherever a built-in has the semantics.

Only composition (NFC) has no built-in; it is an Arrow function. All functions map null to the
empty string unless they say otherwise, and count code points.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: All blanks of Unicode, with the ASCII separators that other regex engines leave out.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
#: Marks that take no room.
INVISIBLE = r"[\p{Cf}\u115F\u1160\u3164\uFFA0\uFE00-\uFE0F\u034F\u180B-\u180D]"

#: Texts of these alone are composed: no character of them takes part in composition or has another form.
COMPOSED = r"^[\x00-˿​‐-‧、-〩〱-ゖァ-ヺㄱ-ㆎ一-鿿가-힣﻿！-～]*$"

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """NFC; null stays null."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: str | Column) -> Column:
    """Any run of blanks becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(_c(c), BLANKS, " "))


def canonical(c: str | Column, compose: bool = True) -> Column:
    """NFC, without U+200B and U+FEFF, blanks collapsed; null becomes ''."""
    s = F.coalesce(_c(c), F.lit(""))
    if compose:  # only texts that may hold something to compose leave the JVM
        s = F.coalesce(nfc(F.when(~s.rlike(COMPOSED), s)), s)
    return collapse(F.translate(s, "\u200b\ufeff", ""))


def punctuation_insensitive(c: str | Column, compose: bool = True) -> Column:
    """Canonical text without any character of category P."""
    return collapse(F.regexp_replace(canonical(c, compose), r"\p{P}", ""))


# What a model writes before its answer, and the quotes it puts around it.
LABEL = r"(인식(된)?\s*(결과|텍스트)|출력|텍스트)\s*[:：]\s*"
QUOTES = ('"', "'", "“", "”")


def clean_prediction(c: str | Column, compose: bool = True) -> Column:
    """A model's answer without thoughts, code fence, leading label and one pair of equal quotes; canonical."""
    s = collapse_ends(F.regexp_replace(F.coalesce(_c(c), F.lit("")), r"(?s)<think>.*?</think>", ""))
    fenced = s.startswith("```") & s.endswith("```")
    s = F.when(fenced, F.regexp_replace(s, r"(?iU)^```(text)?\s*|\s*```$", "")).otherwise(s)
    s = F.regexp_replace(collapse_ends(s), "(?U)^" + LABEL, "")
    q = (F.length(s) >= 2) & (F.substring(s, 1, 1) == F.substring(s, -1, 1)) & F.substring(s, 1, 1).isin(*QUOTES)
    return canonical(F.when(q, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s), compose)


def collapse_ends(c: str | Column) -> Column:
    """The text without blanks at its ends; inner blanks stay."""
    return F.regexp_replace(_c(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def words(c: str | Column) -> Column:
    """Array of the words between blanks."""
    return F.filter(F.split(F.coalesce(_c(c), F.lit("")), BLANKS), lambda w: w != "")


def word_count(c: str | Column) -> Column:
    return F.size(words(c))


def nonspace(c: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(_c(c), F.lit("")), BLANKS, "")


def nonspace_length(c: str | Column) -> Column:
    return F.length(nonspace(c))


def share_of(c: str | Column, pattern: str) -> Column:
    """Share of the pattern's characters among those that are no blanks; 0 on empty text."""
    return F.regexp_count(F.coalesce(_c(c), F.lit("")), F.lit(pattern)) / F.greatest(F.lit(1), nonspace_length(c))


def hangul_ratio(c: str | Column) -> Column:
    return share_of(c, "[가-힣]")


def digit_ratio(c: str | Column) -> Column:
    return share_of(c, r"(?U)\d")


def id_form(c: str | Column) -> Column:
    """One spelling of an identifier; null where it is missing or blank.

    Wide forms become narrow, case and invisible marks go, and any run of other characters
    between letters and digits becomes one hyphen.
    """
    s = F.lower(F.translate(F.regexp_replace(_c(c), INVISIBLE, ""), _WIDE, _NARROW))
    return F.nullif(F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), F.lit(""))


def file_form(c: str | Column) -> Column:
    """One spelling of a file's name, whatever folder or scheme it is written with; null where missing or blank."""
    s = F.lower(F.translate(F.regexp_replace(_c(c), INVISIBLE, ""), _WIDE, _NARROW))
    s = F.element_at(F.split(collapse(F.translate(s, "\\", "/")), "/"), -1)
    return F.nullif(F.trim(s), F.lit(""))
