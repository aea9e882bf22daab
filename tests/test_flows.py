"""Whole flows and pluggable scorers."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillflow.functions import labels as B
from quillflow.functions import text as X
from quillflow.operators import rules as U
from quillflow.plans import flows


def _source(spark, n=60):
    rows = [(i, f"s{i // 2}", f"문장 {i}", "train" if i % 4 else "dev", bool(i % 3 == 0) if i % 5 else None, "accepted") for i in range(n)]
    rows += [(1000, "b1", "벤치 글", "train", False, "x"), (1001, "s999", "벤치  글", "train", True, "x"), (1002, "s998", "", "train", True, "x")]
    return spark.createDataFrame(rows, "row long, sid string, text string, split string, has_error boolean, other string")


def test_prepare_pools(spark, tmp_path):
    bench = spark.createDataFrame([(1, "b1", "벤치 글")], "row long, sid string, text string")
    fam = {"identifier": [F.col("sid")], "text": [X.canonical("text")]}
    out = flows.prepare_pools(_source(spark), "row", fam, bench, fam, [U.Rule("empty", X.canonical("text") == "")], "has_error", "split", 5, str(tmp_path / "out"))
    train, val = {r["sid"] for r in out["train"].collect()}, {r["sid"] for r in out["validation"].collect()}
    assert train and len(val) > 0 and not train & val and out["validation"].count() == 10
    reasons = {}
    for r in out["reasons"].collect():
        reasons[r["reason"]] = reasons.get(r["reason"], 0) + r["n"]
    assert reasons["identifier_overlap"] >= 1 and reasons["text_overlap"] == 1 and reasons["empty"] == 1
    assert all(r["passed"] for r in out["audit"].collect()) and spark.read.json(str(tmp_path / "out/train")).count() == out["train"].count()


def test_final_report(spark):
    t = spark.createDataFrame([("m1", "가나", "가나", 1.0), ("m1", "가나", "가다", 3.0), ("m2", "가", "나", None)], "model_name string, ground_truth string, prediction string, inference_time double")
    e = spark.createDataFrame([("m1", ["x", "y"], "학교애 갔다", "학교에 갔다", "학교에 갔다"), ("m1", ["x"], "학교애", "학교에", "학교애"), ("m2", None, "같음", "같음", "z")], "model_name string, error_type array<string>, g string, k string, p string")
    models = spark.createDataFrame([("m1", True), ("m2", False)], "model_name string, valid boolean")
    r = flows.final_report({"real": t, "clean": t}, e, F.col("g"), F.col("k"), F.col("p"), models)
    a = {(x["model_name"], x["track"]): x for x in r["answers"].collect()}
    assert a[("m1", None)]["n"] == 4 and a[("m1", "real")]["corpus_cer"] == 0.25 and a[("m2", "clean")]["valid"] is False
    m = {x["model_name"]: x for x in r["errors"].collect()}
    assert (m["m1"]["over_corrected"], m["m1"]["error_preserved"]) == (1, 1) and "m2" not in m
    assert {(x["label"], x["n"]) for x in r["labels"].collect()} == {("x", 2), ("y", 1)}


def test_labels(spark):
    d = spark.createDataFrame([("5C.1", True, [2, 1, 2], "<a & 'b'>"), (None, None, None, None)], "rule string, valid boolean, xs array<int>, t string")
    r = d.select(
        B.family_label("rule", {"5C": "particle"}, "other").alias("f"), B.model_label(F.lit("m"), "valid").alias("m"), B.label_set("xs", lambda x: x.cast("string")).alias("s"), B.escaped("t").alias("e"),
        B.display_value("xs", T.ArrayType(T.IntegerType())).alias("d"), B.linked_words(F.lit("나는 학교에 갔다. 밥"), ["는", "에", "다"]).alias("w"),
    ).collect()
    assert tuple(r[0]) == ("particle", "m", ["1", "2"], "&lt;a &amp; &#x27;b&#x27;&gt;", "[2,1,2]", 3)
    assert tuple(r[1]) == ("other", "m", [], None, "<MISSING>", 3)
    out = B.batched(d.select("rule"), "rule", "n", lambda: lambda xs: [len(x or "") for x in xs], T.IntegerType(), 1)
    assert sorted(x["n"] for x in out.collect()) == [0, 4]
    with pytest.raises(Exception, match="another number"):
        B.batched(d.select("rule"), "rule", "n", lambda: lambda xs: [], T.IntegerType()).collect()
