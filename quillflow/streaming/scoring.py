"""Resumable, append-style scoring.

New prediction files are picked up as a stream, scored with the batch operators and appended; the checkpoint keeps what was
done, so a restart goes on where it ended and a row is never scored twice. Work that resumes without a stream takes the rows
left over from a manifest, by id or by place.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from quillflow.functions.metrics import cer, distance


def predictions(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100, fmt: str = "json") -> DataFrame:
    """Prediction files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


def score(df: DataFrame, reference: str = "ground_truth", answer: str = "prediction") -> DataFrame:
    return df.withColumn("distance", distance(reference, answer)).withColumn("cer", cer(reference, answer)).withColumn("exact_match", F.coalesce(F.col(reference) == F.col(answer), F.lit(False)))


def score_and_append(stream: DataFrame, key: str, target: str, checkpoint: str, how: Callable[[DataFrame], DataFrame] = score, once: bool = True) -> StreamingQuery:
    """Scores each new row once by key and appends it to a Parquet folder."""
    q = how(stream.dropDuplicates([key])).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (q.trigger(availableNow=True) if once else q).start()


def live_counts(stream: DataFrame, by: Sequence[str], name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Running counts per class in a memory table."""
    q = stream.groupBy(*by).count().writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("complete")
    return (q.trigger(availableNow=True) if once else q).start()


def progress(query: StreamingQuery) -> dict:
    """Rows so far, rows a second of the last batch, and whether it still runs."""
    batches = [json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else p for p in query.recentProgress]
    last = batches[-1] if batches else {}
    return {"batches": len(batches), "rows": sum(b["numInputRows"] for b in batches), "rows_per_second": last["processedRowsPerSecond"] if batches else 0.0, "active": query.isActive}


def watch(query: StreamingQuery, show: Callable[[dict], None], every: float = 10.0) -> dict:
    """Shows the progress every so many seconds until the query ends; a failure is raised."""
    while not query.awaitTermination(every):
        show(progress(query))
    return progress(query)


def windowed(stream: DataFrame, ts: str, width: str, late: str, *aggs: Column, by: Sequence[str] = ()) -> DataFrame:
    """Event-time windows with a watermark; works on batches too. An addition: prediction files themselves have no time axis."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *by).agg(*aggs).select("*", F.col("w.start").alias("window_start")).drop("w")


def remaining(manifest: DataFrame, done: DataFrame, key: str, place: str | None = None, limit: int | None = None) -> DataFrame:
    """What is left of a manifest: rows without a result or, with ``place``, those after the results at hand; up to ``limit``."""
    if place is None:
        left = manifest.join(done.select(key), key, "left_anti")
        return left if limit is None else left.limit(limit)
    n = done.agg(F.count("*").alias("_n"))
    left = manifest.join(F.broadcast(n)).filter(F.col(place) > F.col("_n")).drop("_n")
    return left if limit is None else left.filter(F.col(place) <= limit)
