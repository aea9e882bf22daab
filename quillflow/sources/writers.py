"""Writers: JSON lines, CSV, and small reports from the driver."""

from __future__ import annotations

import datetime
import html
import json
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quillflow.session import file_system


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object per line; the commit protocol makes it all or nothing, and an existing target is refused by default."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists") -> None:
    """The given columns with a header; others are left out."""
    df.select(*columns).write.mode(mode).option("header", True).csv(path)


def write_text(path: str, text: str, spark: SparkSession | None = None) -> None:
    """A small file, replaced at once; with ``spark`` in any store that Spark can reach."""
    if spark is not None:
        jvm = spark.sparkContext._jvm
        fs, p = file_system(spark, path)
        tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(fs.makeQualified(tmp), fs.makeQualified(p), how)
        return
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(tmp, path)


def write_json(path: str, value, spark: SparkSession | None = None) -> None:
    write_text(path, json.dumps(value, ensure_ascii=False, indent=2) + "\n", spark)


def write_best(path: str, best: DataFrame, spark: SparkSession | None = None) -> dict:
    """The one row of a best setting as a JSON file; fails where there is none."""
    row = best.limit(1).collect()
    if not row:
        raise ValueError("no setting to write")
    write_json(path, row[0].asDict(True), spark)
    return row[0].asDict(True)


def refuse_existing(paths: Sequence[str], spark: SparkSession | None = None) -> None:
    """Fails if any target is there; with ``spark`` in any store."""
    def there(p: str) -> bool:
        if spark is None:
            return os.path.exists(p)
        fs, at = file_system(spark, p)
        return fs.exists(at)

    found = [p for p in paths if there(p)]
    if found:
        raise FileExistsError(", ".join(found))


@contextmanager
def staged(spark: SparkSession, targets: Sequence[str]) -> Iterator[dict[str, str]]:
    """Folders to write in place of the targets; all take their names together at the end, none if anything fails, and an existing target is refused."""
    refuse_existing(targets, spark)
    stage = {t: f"{t.rstrip('/')}.{uuid.uuid4().hex}.staged" for t in targets}
    moved: list[str] = []
    try:
        yield stage
        for t in targets:
            fs, at = file_system(spark, stage[t])
            if not fs.exists(at):
                raise OSError(f"nothing was staged for {t}")
        for t in targets:
            fs, at = file_system(spark, stage[t])
            if not fs.rename(at, file_system(spark, t)[1]):
                raise OSError(f"cannot take the name {t}")
            moved.append(t)
    except BaseException:
        for t in (*moved, *stage.values()):
            fs, at = file_system(spark, t)
            fs.delete(at, True)
        raise


def report_date(now: datetime.datetime | None = None) -> str:
    """The day of a report, as in 2024-01-31."""
    return (now or datetime.datetime.now()).date().isoformat()


def markdown(report: DataFrame, formats: dict[str, str] | None = None) -> str:
    """A pipe table of an aggregated report; formats are those of format()."""
    f = formats or {}
    show = lambda c, v: "" if v is None else format(v, f[c]) if c in f else str(v)
    lines = ["| " + " | ".join(report.columns) + " |", "| " + " | ".join("---" for _ in report.columns) + " |"]
    lines += ["| " + " | ".join(show(c, r[c]) for c in report.columns) + " |" for r in report.toLocalIterator()]
    return "\n".join(lines) + "\n"


def cards(report: DataFrame, title: str, image: str | None = None) -> str:
    """A page of escaped cards of a small report, with a box that hides cards without the text typed in."""
    filter_ = "<input placeholder='filter' oninput=\"for (const a of document.querySelectorAll('article')) a.hidden = !a.textContent.toLowerCase().includes(this.value.toLowerCase())\">"
    out = [f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>" + filter_]
    for r in report.toLocalIterator():
        fields = "".join(f"<dt>{html.escape(c)}</dt><dd>{html.escape('' if r[c] is None else str(r[c]))}</dd>" for c in report.columns if c != image)
        out.append("<article>" + (f"<img src='{html.escape(r[image] or '', quote=True)}'>" if image else "") + f"<dl>{fields}</dl></article>")
    return "\n".join(out) + "\n"
