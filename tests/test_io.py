"""Readers, writers and resumable scoring."""

import datetime
import json
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillflow.sources import readers as D
from quillflow.sources import writers as O
from quillflow.streaming import scoring as Z

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("ground_truth", T.StringType()), T.StructField("prediction", T.StringType())])


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "ground_truth": "가"}\n\n{"id": "2"}\n', encoding="utf-8")
    assert D.read_jsonl(spark, str(p), SCHEMA).count() == 2 and D.count_records(spark, str(p)) == 2 and D.count_records(spark, str(p), 1) == 1 and D.count_records(spark, str(tmp_path / "no.jsonl")) == 0
    (tmp_path / "b.jsonl").write_text("nope\n")
    with pytest.raises(Exception):
        D.read_jsonl(spark, str(tmp_path / "b.jsonl"), SCHEMA).collect()
    assert D.read_jsonl(spark, str(tmp_path / "b.jsonl"), SCHEMA, strict=False).first()["id"] is None
    O.write_jsonl(D.read_jsonl(spark, str(p), SCHEMA), str(tmp_path / "out"))
    assert D.read_jsonl(spark, str(tmp_path / "out"), SCHEMA).filter("ground_truth = '가'").count() == 1
    with pytest.raises(Exception):
        O.write_jsonl(spark.range(1), str(tmp_path / "out"))


def test_documents_and_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/1.json").write_text(json.dumps({"Dataset": {"label_path": "a"}, "bbox": []}))
    (tmp_path / "2.json").write_text("{")
    (tmp_path / "3.json").write_text(json.dumps({"Dataset": None, "bbox": []}))
    s = T.StructType([T.StructField("Dataset", T.StructType([T.StructField("label_path", T.StringType())])), T.StructField("bbox", T.ArrayType(T.StringType()))])
    docs, errors = D.read_json_documents(spark, str(tmp_path), s, ["Dataset", "bbox"])
    assert docs.count() == 1 and {r["reason"] for r in errors.collect()} == {"unreadable", "missing: Dataset"}
    (tmp_path / "x/a.PNG").write_bytes(b"1")
    (tmp_path / "b.txt").write_bytes(b"1")
    f = D.list_files(spark, str(tmp_path), digest=True).collect()
    assert [(r["stem"], r["suffix"], r["sha256"][:8]) for r in f] == [("a", ".png", "6b86b273")]
    m = spark.createDataFrame([(f[0]["path"],), ("file:/none.png",)], "image_path string")
    assert [r[0] for r in D.missing_files(m, "image_path", D.list_files(spark, str(tmp_path))).collect()] == ["file:/none.png"]


def test_reports(spark, tmp_path):
    d = spark.createDataFrame([("m<1>", 0.25, None)], "model string, rate double, x string")
    assert O.markdown(d, {"rate": ".2%"}).splitlines()[2] == "| m<1> | 25.00% |  |"
    assert "m&lt;1&gt;" in O.cards(d, "t")
    O.write_json(str(tmp_path / "r.json"), {"가": 1})
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == {"가": 1}
    with pytest.raises(FileExistsError):
        O.refuse_existing([str(tmp_path / "r.json")])
    O.write_csv(d, str(tmp_path / "c"), ["model", "rate"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["model", "rate"]
    (tmp_path / "log").write_text("\n".join(map(str, range(100))))
    assert D.tail(str(tmp_path / "log"), 3) == ["97", "98", "99"]


def test_resumable_scoring(spark, tmp_path):
    src, out, chk = tmp_path / "in", tmp_path / "out", tmp_path / "chk"
    src.mkdir()
    put = lambda n, rows: (src / n).write_text("".join(json.dumps(r) + "\n" for r in rows), encoding="utf-8")
    put("1.json", [{"id": "1", "ground_truth": "가나", "prediction": "가다"}])
    run = lambda: Z.score_and_append(Z.predictions(spark, str(src), SCHEMA), "id", str(out), str(chk)).awaitTermination()
    run()
    put("2.json", [{"id": "1", "ground_truth": "가나", "prediction": "가다"}, {"id": "2", "ground_truth": "가", "prediction": "가"}])
    run()
    got = {r["id"]: (r["distance"], r["exact_match"]) for r in spark.read.parquet(str(out)).collect()}
    assert got == {"1": (1, False), "2": (0, True)} and spark.read.parquet(str(out)).count() == 2
    Z.live_counts(Z.predictions(spark, str(src), SCHEMA), ["ground_truth"], "live", str(tmp_path / "chk2")).awaitTermination()
    assert {r["ground_truth"]: r["count"] for r in spark.table("live").collect()} == {"가나": 2, "가": 1}


def test_remaining(spark):
    m = spark.createDataFrame([(i, f"x{i}") for i in range(1, 6)], "place int, id string")
    done = m.filter("place <= 2")
    assert [r["place"] for r in Z.remaining(m, done, "id", "place", 4).orderBy("place").collect()] == [3, 4]
    assert Z.remaining(m, done, "id").count() == 3
    e = spark.createDataFrame([("2020-01-01 00:00:10", 1), ("2020-01-01 00:01:10", 2)], "ts string, v int").withColumn("ts", F.to_timestamp("ts"))
    assert Z.windowed(e, "ts", "1 minute", "5 minutes", F.sum("v").alias("s")).count() == 2


def test_any_store(spark, tmp_path):
    """The same through Hadoop's file system, which other stores share."""
    at = "file://" + str(tmp_path)
    O.write_json(f"{at}/r.json", {"가": 1}, spark)
    O.write_json(f"{at}/r.json", {"가": 2}, spark)
    assert D.read_config(spark, f"{at}/r.json") == {"가": 2} and [p.name for p in tmp_path.iterdir() if p.suffix in (".json", ".tmp")] == ["r.json"]
    with pytest.raises(FileExistsError):
        O.refuse_existing([f"{at}/none", f"{at}/r.json"], spark)
    (tmp_path / "log").write_text("\n".join(map(str, range(9000))))
    assert D.tail(f"{at}/log", 3, spark) == ["8997", "8998", "8999"] and D.count_records(spark, f"{at}/lo*") == 9000 and D.count_records(spark, f"{at}/no*") == 0
    (tmp_path / "c.yaml").write_text("seed: 42\npools:\n  normal: 2\n")
    assert D.read_config(spark, f"{at}/c.yaml") == {"seed": 42, "pools": {"normal": 2}}
    (tmp_path / "l.yaml").write_text("- 1\n")
    with pytest.raises(TypeError):
        D.read_config(spark, f"{at}/l.yaml")
    best = spark.createDataFrame([("m", 0.5)], "model string, score double")
    assert O.write_best(f"{at}/best.json", best, spark) == {"model": "m", "score": 0.5} == D.read_config(spark, f"{at}/best.json")
    with pytest.raises(ValueError):
        O.write_best(f"{at}/best.json", best.limit(0), spark)


def test_staged_outputs_come_together_or_not_at_all(spark, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    with pytest.raises(RuntimeError):
        with O.staged(spark, [a, b]) as s:
            O.write_jsonl(spark.range(3), s[a])
            raise RuntimeError("half way")
    with pytest.raises(OSError):
        with O.staged(spark, [a, b]) as s:
            O.write_jsonl(spark.range(3), s[a])  # b is never written
    assert not [p for p in tmp_path.iterdir() if p.is_dir()]
    with O.staged(spark, [a, b]) as s:
        O.write_jsonl(spark.range(3), s[a])
        O.write_jsonl(spark.range(4), s[b])
    assert D.count_records(spark, a) == 3 and D.count_records(spark, b) == 4
    with pytest.raises(FileExistsError):
        with O.staged(spark, [a]):
            pass


def _png(w, h):
    head = b"IHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\x00\x00\x00\x00"
    return b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + head + zlib.crc32(head).to_bytes(4, "big")


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(_png(30, 20))
    (tmp_path / "b.png").write_bytes(_png(30, 20)[:-1] + b"x")
    (tmp_path / "c.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x14\x00\x1e" + bytes(20))
    m = spark.createDataFrame([(f"{tmp_path}/{n}", w, h) for n, w, h in (("a.png", 30, 20), ("a.png", 30, 20), ("b.png", 30, 20), ("c.jpg", 30, 21), ("d.png", 1, 1))] + [("/none/e.png", 1, 1), (None, 1, 1)], "p string, w int, h int")
    got = {r["path"].rpartition("/")[2]: r["problem"] for r in D.image_checks(spark, m, "p", "w", "h").collect()}
    assert got == {"a.png": None, "b.png": "unreadable", "c.jpg": "size", "d.png": "missing", "e.png": "missing"}
    assert D._image(b"GIF89a" + (7).to_bytes(2, "little") + (9).to_bytes(2, "little") + bytes(20)) == ("gif", 7, 9) and D._image(None) is None
    files = D.list_files(spark, str(tmp_path), digest=True)
    first = files.filter("stem = 'a'").first()
    rows = spark.createDataFrame([("s1", first["path"]), ("s1", first["path"]), ("s2", "file:/no.png"), (None, first["path"])], "sid string, image string")
    assert {(r["key"], r["sha256"], r["n_files"]) for r in D.hashes_by_id(rows, "sid", "image", files).collect()} == {("s1", first["sha256"], 1), ("s2", None, 0)}


def test_progress_and_date(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"id": "1", "ground_truth": "가", "prediction": "가"}\n{"id": "2", "ground_truth": "가", "prediction": "나"}\n', encoding="utf-8")
    q = Z.score_and_append(Z.predictions(spark, str(tmp_path / "in"), SCHEMA), "id", str(tmp_path / "out"), str(tmp_path / "chk"))
    seen = []
    end = Z.watch(q, seen.append, 0.2)
    assert (end["rows"], end["active"]) == (2, False) and all(s["rows"] in (0, 2) for s in seen)
    assert O.report_date(datetime.datetime(2024, 1, 31, 23)) == "2024-01-31"
