"""Readers: JSON lines, JSON documents with their errors, configurations, listings and checks of files."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillflow.session import file_system

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """One object per line, blank lines skipped; strict fails on a line that is none, lax gives a row of nulls."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_json_documents(spark: SparkSession, root: str, schema: T.StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of all JSON files below a folder; a file that is no object or lacks a required field is an error row."""
    s = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(s).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root).select("*", F.col("_metadata.file_path").alias("file_path"))
    lacking = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)), lambda x: x.isNotNull())
    reason = F.when(F.col("_corrupt_record").isNotNull(), "unreadable").when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", ")))
    raw = raw.withColumn("reason", reason)
    return raw.filter("reason IS NULL").drop("_corrupt_record", "reason"), raw.filter("reason IS NOT NULL").select("file_path", "reason")


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that is one JSON object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def stem(path: Column) -> Column:
    """File name without folder and suffix."""
    return F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot, or ''."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def list_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES, digest: bool = False) -> DataFrame:
    """(path, stem, suffix, length[, sha256]) of the files below a folder; contents are read only for digests."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.filter(suffix(F.col("path")).isin(*("." + s for s in suffixes)))
    cols = [F.col("path"), stem(F.col("path")).alias("stem"), suffix(F.col("path")).alias("suffix"), F.col("length")]
    return files.select(*cols, *([F.sha2("content", 256).alias("sha256")] if digest else []))


def missing_files(manifest: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """Manifest rows whose file is not listed."""
    return manifest.join(files.select(F.col("path").alias(path)), path, "left_anti")


def read_config(spark: SparkSession, path: str) -> dict:
    """A small YAML or JSON file that is one mapping, from any store; fails on anything else."""
    text = spark.read.text(path, wholetext=True).first()
    if path.endswith((".yaml", ".yml")):
        import yaml  # only where such a file is read

        value = yaml.safe_load(text[0] if text else "")
    else:
        value = json.loads(text[0] if text else "null")
    if not isinstance(value, dict):
        raise TypeError(f"no mapping: {path}")
    return value


def hashes_by_id(rows: DataFrame, key: str, path: str, files: DataFrame) -> DataFrame:
    """(key, sha256, n_files): the digest of each id's file (the least where ids repeat with other files), null where the file is not listed."""
    f = files.select(F.col("path").alias("_path"), "sha256")
    d = rows.select(F.col(key).alias("key"), F.col(path).alias("_path")).filter("key IS NOT NULL").distinct()
    return d.join(f, "_path", "left").groupBy("key").agg(F.min("sha256").alias("sha256"), F.count_distinct("sha256").alias("n_files"))


IMAGE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def _image(data: bytes | None) -> tuple | None:
    """(kind, width, height) by the header; None for what is no image."""
    if not data or len(data) < 26:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and zlib.crc32(data[12:29]) == int.from_bytes(data[29:33], "big"):
        return "png", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif", int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"BM":
        return "bmp", int.from_bytes(data[18:22], "little"), abs(int.from_bytes(data[22:26], "little", signed=True))
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 9 < len(data) and data[at] == 0xFF:  # from segment to segment until the frame's own
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return "jpeg", int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 + size
    return None


@F.pandas_udf(IMAGE)
def image_header(content: pd.Series) -> pd.DataFrame:
    """Kind and size of an image by its header; nulls for what is none."""
    return pd.DataFrame([_image(x) or (None, None, None) for x in content], columns=IMAGE.names).astype({"width": "Int32", "height": "Int32"})


def image_checks(spark: SparkSession, manifest: DataFrame, path: str, width: str | None = None, height: str | None = None) -> DataFrame:
    """(path, problem) of each different image of a manifest: missing, unreadable, of another size than the manifest says, or null if it is fine."""
    m = manifest.select(F.col(path).alias("path"), *((F.col(c) if c else F.lit(None).cast("int")).alias(n) for c, n in ((width, "w"), (height, "h")))).filter("path IS NOT NULL").distinct()
    roots = [r["root"] for r in m.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("root")).distinct().collect()]  # a row per folder
    have = [r for r in roots if r and file_system(spark, r)[0].exists(file_system(spark, r)[1])]
    bare = lambda c: F.regexp_replace(c, "^file:/+", "/")
    if have:
        files = spark.read.format("binaryFile").load(have).select(bare(F.col("path")).alias("at"), image_header("content").alias("i"))
    else:
        files = m.select(F.lit("").alias("at"), F.lit(None).cast(IMAGE).alias("i")).limit(0)
    d = m.join(files, bare(F.col("path")) == F.col("at"), "left")
    size = (F.col("w").isNotNull() & (F.col("w") != F.col("i.width"))) | (F.col("h").isNotNull() & (F.col("h") != F.col("i.height")))
    return d.select("path", F.when(F.col("at").isNull(), "missing").when(F.col("i.kind").isNull(), "unreadable").when(size, "size").alias("problem"))


def count_records(spark: SparkSession, path: str, limit: int | None = None) -> int:
    """Lines that are not blank, at most ``limit``; 0 if there is no file. Any store that Spark can reach, with wildcards."""
    fs, p = file_system(spark, path)
    if not fs.globStatus(p):
        return 0
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return (lines if limit is None else lines.limit(limit)).count()


def tail(path: str, lines: int = 20, spark: SparkSession | None = None) -> list[str]:
    """The last lines of a log on the driver; with ``spark`` from any store."""
    if spark is None:
        with open(path, "rb") as f:
            return _tail(f.seek(0, 2), lambda at, n: (f.seek(at), f.read(n))[1], lines)
    fs, p = file_system(spark, path)
    f = fs.open(p)
    try:
        return _tail(fs.getFileStatus(p).getLen(), lambda at, n: (f.seek(at), bytes(f.readNBytes(n)))[1], lines)
    finally:
        f.close()


def _tail(end: int, read: Callable[[int, int], bytes], lines: int, block: int = 1 << 13) -> list[str]:
    data = b""
    while end > 0 and data.count(b"\n") <= lines:
        step = min(block, end)
        end -= step
        data = read(end, step) + data
    return data.decode("utf-8", "replace").splitlines()[-lines:]
