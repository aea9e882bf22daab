"""Aggregations and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.functions import metrics as M


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric_stats(value: str | Column, prefix: str = "") -> list[Column]:
    """Mean, exact median, least and most; null on empty input."""
    v = _c(value)
    return [F.avg(v).alias(prefix + "mean"), F.median(v).alias(prefix + "median"), F.min(v).alias(prefix + "min"), F.max(v).alias(prefix + "max")]


def strict_stats(df: DataFrame, value: str, prefix: str = "") -> DataFrame:
    """The same, failing on empty input."""
    g = df.agg(*numeric_stats(value, prefix), F.count(value).alias("_n"))
    mean = prefix + "mean"
    return g.withColumn(mean, F.when(F.col("_n") == 0, F.raise_error(F.lit("no values")).cast("double")).otherwise(F.col(mean))).drop("_n")


def or_zero(c: Column, digits: int = 4) -> Column:
    """An aggregate, rounded, 0 where there is nothing."""
    return F.coalesce(F.round(c, digits), F.lit(0.0))


def distribution(df: DataFrame, key: str | Column, missing: str | None = None) -> DataFrame:
    """(key, n, percent), null under the given label."""
    k = _c(key).cast("string")
    g = df.groupBy((F.coalesce(k, F.lit(missing)) if missing is not None else k).alias("key")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.join(F.broadcast(total)).select("key", "n", M.percent(F.col("n"), F.col("total")).alias("percent"))


def field_distributions(df: DataFrame, fields: Sequence[str | tuple[str, Column]], missing: str = "<MISSING>") -> DataFrame:
    """(field, value, n) of several fields in one pass."""
    named = [(f, F.col(f)) if isinstance(f, str) else f for f in fields]
    e = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.coalesce(c.cast("string"), F.lit(missing)).alias("value")) for n, c in named))).alias("e")
    return df.select(e).groupBy("e.field", "e.value").agg(F.count("*").alias("n")).select("field", "value", "n")


def frequency(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Different values with their counts, by count down, then by value."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def base_stats(df: DataFrame, path: str, digest: str, text: str) -> DataFrame:
    """One row: rows, different paths, digests and texts, repeats beyond the first, the most frequent text's count, length and word stats."""
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""))
    one = df.agg(
        F.count("*").alias("n"), F.count_distinct(path).alias("n_paths"), F.count_distinct(digest).alias("n_digests"), F.count_distinct(text).alias("n_texts"),
        (F.count(text) - F.count_distinct(text)).alias("repeated_texts"), *numeric_stats(F.length(text), "chars_"), *numeric_stats(words, "words_"),
    )
    most = df.filter(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("c")).agg(F.max("c").alias("most_frequent"))
    return one.join(F.broadcast(most))


def answer_summary(df: DataFrame, by: Sequence[str], reference: str, answer: str, seconds: str | None = None) -> DataFrame:
    """Per group: mean and corpus CER, character accuracy, exact matches, time."""
    d = M.distance(reference, answer)
    n = F.length(F.coalesce(F.col(reference), F.lit("")))
    corpus = F.sum(d) / F.greatest(F.lit(1), F.sum(n))
    cols = [
        F.count("*").alias("n"), F.avg(M.cer(reference, answer)).alias("mean_cer"), corpus.alias("corpus_cer"), F.greatest(F.lit(0.0), 1 - corpus).alias("character_accuracy"),
        F.sum(d).alias("distance"), F.sum(n).alias("characters"), F.count_if(F.col(reference) == F.col(answer)).alias("exact"),
    ]
    if seconds:
        cols += [F.avg(seconds).alias("mean_seconds"), F.sum(seconds).alias("total_seconds")]
    return df.groupBy(*by).agg(*cols).withColumn("exact_rate", F.col("exact") / F.col("n"))


def class_summary(df: DataFrame, by: Sequence[str], classes: Sequence[str], column: str = "classification") -> DataFrame:
    """Per group: rows, and count and rate of each class."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.col(column) == c).alias(c) for c in classes))
    return g.select("*", *((F.col(c) / F.greatest(F.lit(1), F.col("n"))).alias(c + "_rate") for c in classes))


def label_breakdown(df: DataFrame, labels: str, column: str, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows per label and class; a row counts once under each of its labels."""
    e = df.select(*by, F.explode(F.array_distinct(labels)).alias("label"), column)
    return e.groupBy(*by, "label").agg(F.count("*").alias("n"), *(F.count_if(F.col(column) == c).alias(c) for c in classes))


def with_totals(df: DataFrame, by: Sequence[str], sets: Sequence[Sequence[str]], *aggs: Column) -> DataFrame:
    """GROUPING SETS: the same aggregates per several groupings; absent keys are null."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in by)).agg(*aggs)


def best_by(df: DataFrame, by: Sequence[str], value: Column, order: Sequence[Column]) -> DataFrame:
    """Per group, the row struct ``best`` with the greatest value, the first in order on ties."""
    key = F.struct(value.alias("v"), *(o for o in order))
    return df.groupBy(*by).agg(F.max_by(F.struct("*"), key).alias("best"))


def most_per_group(df: DataFrame, inner: Sequence[str], outer: Sequence[str], name: str = "most") -> DataFrame:
    """Rows per inner group, and the most of these per outer group."""
    return df.groupBy(*inner).agg(F.count("*").alias("c")).groupBy(*outer).agg(F.max("c").alias(name))


def best_setting(df: DataFrame, name: str, score: str, overall: str) -> DataFrame:
    """The row of the least score, then least overall rate, then name."""
    return df.orderBy(score, overall, name).limit(1)


def json_keys(df: DataFrame, text: str | Column) -> DataFrame:
    """(key, n): presence of each top-level key of JSON texts."""
    return df.select(F.explode(F.json_object_keys(_c(text))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def compare_to(df: DataFrame, name: str, base: str, columns: Sequence[str]) -> DataFrame:
    """Each setting's difference from one of them."""
    b = df.filter(F.col(name) == base).select(*(F.col(c).alias("_" + c) for c in columns)).limit(1)
    return df.join(F.broadcast(b)).select(name, *((F.col(c) - F.col("_" + c)).alias(c + "_delta") for c in columns))


def flatten_metrics(df: DataFrame, name: str, groups: dict[str, dict[str, str]]) -> DataFrame:
    """Nested metric structs as flat columns: {struct: {field: flat name}}."""
    return df.select(name, *(F.col(f"{g}.{f}").alias(flat) for g, fields in groups.items() for f, flat in fields.items()))


def first_seen(df: DataFrame, value: str | Column, order: str) -> DataFrame:
    """(value, first): different values with the place each is seen first; in that order they are the values without repeats."""
    return df.select(_c(value).alias("value"), F.col(order).alias("first")).filter("value IS NOT NULL").groupBy("value").agg(F.min("first").alias("first"))


def merged(a: str | Column, b: str | Column, add: bool = False) -> Column:
    """Two maps as one: of a key in both the second's value, or with ``add`` the sum; null counts as an empty map."""
    none = lambda x: F.coalesce(_c(x), F.create_map().cast("map<string,bigint>"))
    return F.map_zip_with(none(a), none(b), lambda k, x, y: (F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))) if add else F.coalesce(y, x))
