"""Text and metric functions against plain Python."""

import difflib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillflow.functions import metrics as M
from quillflow.functions import text as X

TEXTS = ["", None, " a 　b ", "\x1ca\x1f b", "가​나﻿", unicodedata.normalize("NFD", "각나"), "! . , “ ” … · ~ $ + ㆍ", "...", "가", "\U0001f600", "a\n\tb"]


def _canon(v):
    s = unicodedata.normalize("NFC", v or "").replace("​", "").replace("﻿", "")
    return re.sub(r"\s+", " ", s).strip()


def _nopunct(v):
    return re.sub(r"\s+", " ", "".join(c for c in _canon(v) if not unicodedata.category(c).startswith("P"))).strip()


def test_canonical_forms(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", X.canonical("t").alias("c"), X.punctuation_insensitive("t").alias("p"), X.word_count("t").alias("w"))
    for r in df.collect():
        assert (r["c"], r["p"], r["w"]) == (_canon(TEXTS[r["i"]]), _nopunct(TEXTS[r["i"]]), len((TEXTS[r["i"]] or "").split()))


def test_clean_prediction(spark):
    cases = {"<think>x\ny</think>\n가나": "가나", "```text\n가나\n```": "가나", "인식 결과: 가나": "가나", "\"가나\"": "가나", "“가나”": "“가나”", "출력：가 나 ": "가 나", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.clean_prediction("t").alias("c"))
    assert {r["t"]: r["c"] for r in df.collect()} == cases


def test_id_and_file_forms(spark):
    ids = ["HW00-1", " hw00 - 1", "ＨＷ00－1", "HW00_1", "HW​00-1 "]
    df = spark.createDataFrame([(i,) for i in [*ids, None, " ", ""]], "t string")
    assert [r[0] for r in df.select(X.id_form("t")).collect()] == ["hw00-1"] * 5 + [None] * 3
    files = ["images/T/a-1.png", "IMAGES\\t\\A-1.PNG", "file:///mnt/x/a-1.Png", "./images//a-1.png", " a-1.png", None, ""]
    df = spark.createDataFrame([(i,) for i in files], "t string")
    assert [r[0] for r in df.select(X.file_form("t")).collect()] == ["a-1.png"] * 5 + [None] * 2


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_scores(spark):
    rows = [("가나다", "가나라", "가나다"), ("가나다", "가나라", "가나라"), ("가", "나", "나다라"), ("\U0001f600", "x", ""), ("ab", "cd", "ef"), ("", "x", None)]
    df = spark.createDataFrame(rows, "g string, k string, p string").select("*", M.strict_score("g", "k", "p").alias("s"), M.cer("g", "p").alias("cer"))
    got = df.collect()
    for r in got:
        assert r["s"]["distance_to_ground_truth"] == _lev(r["g"], r["p"] or "") and r["cer"] == _lev(r["g"], r["p"] or "") / max(1, len(r["g"]))
    assert [r["s"]["classification"] for r in got] == ["error_preserved", "over_corrected", "recognition_error", "recognition_error", "recognition_error", "error_preserved"]
    assert got[2]["cer"] == 3.0 and got[4]["s"]["closer_to"] == "tie" and got[1]["s"]["closer_to"] == "corrected"


def test_spans(spark):
    g, k = "그는 학교애 갔단 말했다", "그는 학교에 갔다 말했다"
    rows = [(g, k, g, "error_preserved"), (g, k, k, "over_corrected"), (g, k, "그는 학교에 갔단 말했다", "over_corrected"), (g, k, "아무 상관 없는 글", "other_recognition_error")]
    df = spark.createDataFrame(rows, "g string, k string, p string, want string").withColumn("spans", M.correction_spans("g", "k"))
    df = df.withColumn("scored", M.score_spans("spans", "g", "p")).withColumn("cls", M.sample_class("scored", "g", "p"))
    for r in df.collect():
        ops = [o for o in difflib.SequenceMatcher(None, g, k, autojunk=False).get_opcodes() if o[0] != "equal"]
        assert [(s["operation"], s["gt_start"], s["gt_end"]) for s in r["spans"]] == [(o[0], o[1], o[2]) for o in ops]
        assert r["cls"] == r["want"]
    none = spark.createDataFrame([(None, "x")], "g string, k string").select(M.correction_spans("g", "k").alias("s")).first()
    assert none["s"] is None


def test_arrays_and_percent(spark):
    df = spark.createDataFrame([([1, 2, 3, 1, 2], [1, 2]), ([1], [1, 2]), ([1], []), ([], [1])], "v array<int>, n array<int>")
    assert [r[0] for r in df.select(M.last_subsequence("v", "n")).collect()] == [3, None, None, None]
    assert spark.range(1).select(M.mask_before(F.array(F.lit(5), F.lit(6), F.lit(7)), F.lit(2)).alias("m")).first()["m"] == [-100, -100, 7]
    assert spark.range(1).select(M.percent(F.lit(1), F.lit(0)).alias("a"), M.percent(F.lit(1), F.lit(4)).alias("b")).first() == (0.0, 25.0)


def test_published_rates(spark):
    r = spark.range(1).select((F.lit(1137) / 1825).alias("a"), M.tradeoff(F.lit(0.1), F.lit(0.2), F.lit(0.6), F.lit(0.9)).alias("t")).first()
    assert r["a"] == pytest.approx(0.623014, abs=1e-6) and r["t"] == pytest.approx(0.8)


def test_generated_text(spark):
    rows = ['[{"generated_text": "가나"}]', '{"text": "x"}', '{"generated_text": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "답"}]}', '{"generated_text": [{"role": "assistant", "content": [{"type": "text", "text": "가"}, {"type": "text", "text": "나"}]}]}']
    df = spark.createDataFrame([(x,) for x in rows], "j string").select(M.generated_text("j").alias("t"))
    assert [r["t"] for r in df.collect()] == ["가나", "x", "답", "가나"]
