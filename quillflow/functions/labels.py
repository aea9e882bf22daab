"""Labels, display forms and pluggable scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillflow.functions.text import words


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def display_value(c: str | Column, kind: T.DataType | None = None, missing: str = "<MISSING>") -> Column:
    """Text of a value: nested ones as JSON, null as a label."""
    c = _c(c)
    s = F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")
    return F.coalesce(s, F.lit(missing))


def family_label(rule_id: str | Column, labels: Mapping[str, str], otherwise: str) -> Column:
    """A label by the part of an id before its first dot."""
    family = F.split_part(_c(rule_id), F.lit("."), F.lit(1))
    out = F.lit(otherwise)
    for k, v in labels.items():
        out = F.when(family == k, F.lit(v)).otherwise(out)
    return out


def label_set(items: str | Column, label: Callable[[Column], Column]) -> Column:
    """Sorted different labels of an array's elements; empty for null."""
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(_c(items), label), lambda x: x.isNotNull()))), F.array().cast("array<string>"))


def model_label(name: str | Column, valid: str | Column) -> Column:
    """The name, marked where the model's results are not valid."""
    return F.when(F.coalesce(_c(valid), F.lit(True)), _c(name)).otherwise(F.concat(_c(name), F.lit(" ⚠")))


def linked_words(text: str | Column, endings: Sequence[str]) -> Column:
    """Words that end like inflected ones; the built-in stand-in for a morphological analyser, which ``batched`` can plug in."""
    bare = lambda w: F.regexp_replace(w, r"[\s\p{P}]+$", "")
    pattern = ".(" + "|".join(sorted(set(endings), key=len, reverse=True)) + ")$"
    return F.size(F.filter(words(text), lambda w: bare(w).rlike(pattern)))


def data_uri(content: str | Column, media: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{media};base64,"), F.base64(_c(content)))


def escaped(text: str | Column) -> Column:
    """Text for HTML."""
    s = F.replace(_c(text), F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def batched(df: DataFrame, column: str, out: str, load: Callable[[], Callable[[list], list]], kind: T.DataType, size: int = 64) -> DataFrame:
    """Adds what a batch scorer says of a column. ``load`` makes the scorer once per task; it must answer every item of a batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for p in parts:
            items, got = p[column].tolist(), []
            for a in range(0, len(items), size):
                said = scorer(items[a : a + size])
                if len(said) != len(items[a : a + size]):
                    raise ValueError("the scorer answered another number of items than it was given")
                got += said
            yield p.assign(**{out: got})

    return df.mapInPandas(run, schema)
