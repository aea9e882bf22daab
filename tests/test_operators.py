"""Rules, leakage, matching, sampling, windows, summaries, checks and layout."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillflow.operators import checks as K
from quillflow.operators import layout as Y
from quillflow.operators import leakage as L
from quillflow.operators import matching as J
from quillflow.operators import rules as U
from quillflow.operators import sampling as Q
from quillflow.operators import summaries as A
from quillflow.operators import windows as W


def test_first_match_and_null_conditions(spark):
    df = spark.createDataFrame([(None,), ("",), ("가",), ("abc def",), ("가나 a@b.co",), ("가나 12345678",), ("가1나2다3",), ("가나다라",)], "t string")
    got = [r["reason"] for r in U.route(df, U.text_rules("t")).collect()]
    assert got == ["non_string", "empty", "too_short", "not_in_script", "email_like", "long_digit_sequence", "digit_ratio", "accepted"]
    assert {r["reason"]: r["n"] for r in U.reason_counts(U.route(df, U.text_rules("t"))).collect()} == {g: 1 for g in got}
    flags = spark.createDataFrame([(True,), (False,), (None,)], "b boolean").select(U.is_true("b").alias("t"), U.all_matches([U.Rule("x", F.col("b")), U.Rule("y", ~F.col("b"))]).alias("all"))
    assert [(r["t"], r["all"]) for r in flags.collect()] == [(True, ["x"]), (False, ["y"]), (False, [])]


def test_endings_and_symbols(spark):
    df = spark.createDataFrame([("갔다.",), ("가고",), ("",), ("123 !!",), (None,)], "t string").select(U.ends_with_any("t", ["다", "다", "요"]).alias("e"), U.mostly_symbols("t").alias("m"), U.terminal("t").alias("p"), U.personal("t").alias("pii"))
    assert [tuple(r) for r in df.collect()] == [(True, False, True, False), (False, False, False, False), (False, True, False, False), (False, True, True, False), (False, True, False, False)]


def test_leakage_counts_rows_not_matches(spark):
    left = spark.createDataFrame([(1, "a", "t1"), (2, "b", None), (3, None, "t9"), (4, "", "")], "row long, k string, t string")
    right = spark.createDataFrame([("a", "t1"), ("a", "t1"), ("a", "x"), ("", ""), (None, None)], "k string, t string")
    fam = {"key": [F.col("k")], "text": [F.col("t"), F.col("t")]}
    assert {r["family"]: r["rows"] for r in L.overlap_counts(left, "row", fam, right, fam).collect()} == {"key": 1, "text": 1}
    assert {r["row"]: r["reason"] for r in L.remove_overlap(left, "row", fam, right, fam).collect()} == {1: "key_overlap", 2: "kept", 3: "kept", 4: "kept"}
    clean = L.audit({"a": (left.filter("row > 1"), "row", fam), "b": (right, "k", fam)}, [("a", "b")])
    assert all(r["passed"] for r in clean.collect())
    seeded = L.audit({"a": (left, "row", fam), "b": (right, "k", fam)}, [("a", "b")])
    assert not any(r["passed"] for r in seeded.collect())


def test_matching(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("x", 1), ("z", 2)], "k string, v int")
    r = J.match_audit(a, F.col("k"), b, F.col("k")).first()
    assert (r["matched"], r["missing"], r["orphaned"], r["ambiguous"], r["without_key"], r["passed"]) == (1, 1, 1, 1, 1, False)
    assert {(x["k"], x["lookup"]) for x in J.lookup(a, b, ["k"]).collect()} == {("x", "found"), ("y", "not_found"), (None, "not_found")}
    m, d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "p int, k string"), spark.createDataFrame([(1, "a"), (2, "x")], "p int, k string")
    assert tuple(J.is_prefix(d, m, "p", "k").first()) == (2, 1)
    assert J.aligned(m, d, "p", "k").filter("NOT same").count() == 2
    assert [x["k"] for x in J.pending(m, d, "k").orderBy("k").collect()] == ["b", "c"]
    assert J.unique_match(b, spark.createDataFrame([("x", 1), ("z", 1), ("z", 2)], "k string, w int"), "k").count() == 1


def test_hash_order(spark):
    df = spark.range(50).select(F.col("id"), Q.stable_key("n", "id").alias("k"), Q.stable_seed("n", "id").alias("s"))
    for r in df.collect():
        h = hashlib.sha256(f"n:{r['id']}".encode()).hexdigest()
        assert r["k"] == h and int(r["s"]) == int(h[:16], 16)
    got = [r["id"] for r in Q.sample_in_order(spark.range(50), "id", "id", 7, "n").collect()]
    assert got == sorted(sorted(range(50), key=lambda i: hashlib.sha256(f"n:{i}".encode()).hexdigest())[:7])


def test_quotas(spark):
    c = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1)], "name string, n long")
    assert {r["name"]: r["quota"] for r in Q.proportional_quotas(c, "name", "n", 5).collect()} == {"a": 2, "b": 2, "c": 1}
    tie = spark.createDataFrame([("b", 3), ("a", 3)], "name string, n long")
    assert {r["name"]: r["quota"] for r in Q.proportional_quotas(tie, "name", "n", 3).collect()} == {"a": 2, "b": 1}
    with pytest.raises(Exception, match="exceeds"):
        Q.proportional_quotas(c, "name", "n", 12).collect()
    assert Q.even_quota(["a", "b"], 5) == {"a": 3, "b": 2} and Q.even_quota(["dev", "test"], 5, False) == {"dev": 2, "test": 3}
    d = spark.range(20).withColumn("g", F.when(F.col("id") < 12, "a").otherwise("b"))
    assert {r["g"]: r["n"] for r in Q.take_quota(d, "id", "g", {"a": 3, "b": 99}, "x").groupBy("g").agg(F.count("*").alias("n")).collect()} == {"a": 3, "b": 8}


def test_ratio_sample(spark):
    d = spark.range(30).withColumn("f", F.col("id") < 4)
    got = Q.ratio_sample(d, "id", F.col("f"), 21, 0.5, "s").collect()
    assert len(got) == 21 and sum(r["flagged"] for r in got) == round(21 * 0.5)
    assert len({(r["id"], r["epoch"]) for r in got}) == 21


def _sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _round_robin(rows, n, cap, rounds):
    """The plain way, over all candidates."""
    groups = {}
    for i, t, s, v in rows:
        groups.setdefault(t, []).append((-v, _sha(f"42:ns:{t}:{i}"), i, s))
    for g in groups.values():
        g.sort()
    used, taken, out = {}, set(), []
    for r in range(rounds):
        for t in sorted(groups, key=lambda t: (groups[t][r][0] if r < len(groups[t]) else 10**6, _sha(f"42:gt-round:{r}:{t}"))):
            if r < len(groups[t]) and len(out) < n:
                for _, _, i, s in groups[t]:
                    if i not in taken and used.get(s, 0) < cap:
                        taken.add(i)
                        used[s] = used.get(s, 0) + 1
                        out.append((i, r))
                        break
    return out


def test_round_robin_equals_the_plain_way(spark):
    rnd = random.Random(1)
    rows = [(i, f"t{rnd.randrange(12)}", f"s{rnd.randrange(5)}", float(rnd.randrange(4))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, text string, source string, score double")
    for n, cap, rounds in ((20, 6, 8), (60, 3, 4), (30, 20, 8)):
        got = [(r["id"], r["round"]) for r in Q.greedy_round_robin(df, "id", "text", "source", "score", n, cap, rounds, "ns", strict=False).collect()]
        assert got == _round_robin(rows, n, cap, rounds)
    with pytest.raises(Exception, match="can be picked"):
        Q.greedy_round_robin(df, "id", "text", "source", "score", 500, 6).collect()


def test_greedy_unique(spark):
    rnd = random.Random(1)
    rows = [(i, f"t{rnd.randrange(12)}", f"s{rnd.randrange(5)}") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, text string, source string")
    by = {r[0]: r for r in rows}
    u = Q.greedy_unique(df, "id", "source", "text").collect()
    assert len({by[r["id"]][1] for r in u}) == len(u) <= 5
    assert Q.greedy_unique(df.limit(0), "id", "source", "text").count() == 0


def test_select_training(spark):
    rows = [(1, "a", "x", 0), (2, "a", "y", 1), (3, "b", "x", 0), (4, "c", "x", 0), (5, "c", "x", 1), (6, "d", "v", 0), (7, "e", "x", 3), (8, "e", "x", 2), (9, None, "q", 0), (10, "f", None, 0)]
    d = spark.createDataFrame(rows, "id long, s string, t string, k int")
    used = spark.createDataFrame([("v",), (None,)], "text string")
    got = {r["id"]: r["fallback"] for r in Q.select_training(d, "id", "s", "t", "k", 5, used, "text", "n").collect()}
    src = {r[0]: r[1] for r in rows}
    assert sorted(src[i] for i in got) == ["a", "b", "c", "d", "e"]  # one a source
    fresh = [i for i, f in got.items() if not f]
    assert len({dict((r[0], r[2]) for r in rows)[i] for i in fresh}) == len(fresh) and 6 not in fresh and got[6]  # v is used already
    assert not {5, 7} & {i for i, f in got.items() if f}  # of equal texts a fallback takes the first by place
    with pytest.raises(Exception, match="only 5 of 6"):
        Q.select_training(d, "id", "s", "t", "k", 6, used, "text", "n").collect()
    assert Q.select_training(d.limit(0), "id", "s", "t", "k", 5, used, "text", "n", strict=False).count() == 0


def _quota_unique(rows, quota):
    sources, texts, out = set(), set(), set()
    for g in sorted(quota):
        n = 0
        for s in sorted({r[2] for r in rows if r[1] == g and r[2]}, key=lambda s: _sha(f"n:{g}:{s}")):
            mine = sorted((r for r in rows if r[1] == g and r[2] == s and r[3]), key=lambda r: _sha(f"n:{r[0]}"))
            row = next((r for r in mine if r[3] not in texts), None)
            if n < quota[g] and s not in sources and row:
                sources.add(s), texts.add(row[3]), out.add((row[0], g))
                n += 1
    return out


def test_quota_unique_equals_the_plain_way(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("abc"), rnd.choice([None, *(f"s{k}" for k in range(25))]), rnd.choice([None, *(f"t{k}" for k in range(18))])) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, g string, s string, t string")
    quota = {"a": 4, "b": 6, "c": 3}
    got = {tuple(r) for r in Q.quota_unique(d, "id", "g", "s", "t", quota, "n").collect()}
    assert got == _quota_unique(rows, quota) and len(got) == 13
    with pytest.raises(Exception, match="can be picked"):
        Q.quota_unique(d, "id", "g", "s", "t", {"a": 40}, "n").collect()


def test_ranked_and_random_use_a_source_once(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("abc"), f"s{rnd.randrange(30)}", rnd.randrange(9)) for i in range(400)]
    d = spark.createDataFrame(rows, "id long, g string, s string, v int")
    quota = {"a": 5, "b": 8, "c": 4}
    got = Q.ranked_and_random(d, "id", "g", "s", [F.desc("v")], quota, "n").collect()
    used, want = set(), set()
    for g in sorted(quota):
        mine, n = [r for r in rows if r[1] == g], 0
        for how, most, key in (("rank", quota[g] // 2, lambda r: (-r[3], r[0])), ("random", quota[g], lambda r: _sha(f"n:{r[0]}"))):
            for r in sorted(mine, key=key):
                if n < most and r[2] not in used:
                    used.add(r[2]), want.add((r[0], g, how))
                    n += 1
    assert {tuple(r) for r in got} == want
    assert Q.ranked_and_random(d.limit(0), "id", "g", "s", [F.desc("v")], quota, "n", strict=False).count() == 0


def test_quota_heads_are_taken_in_each_task(spark):
    d = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, "a").otherwise("b"))
    plan = Q.take_quota(d, "id", "g", {"a": 3, "b": 99}, "x")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_running_ratio_over_few_large_groups(spark):
    d = spark.range(5000).selectExpr("id", "IF(id % 7 = 0, NULL, CAST(id % 2 AS STRING)) AS g", "id % 3 = 0 AS f").repartition(7)
    got = {r["id"]: (r["seen"], r["flagged"]) for r in W.running_ratio(d, ["g"], ["id"], "f").collect()}
    seen = {}
    for i in range(5000):
        g = None if i % 7 == 0 else i % 2
        n, k = seen.get(g, (0, 0))
        seen[g] = n + 1, k + (i % 3 == 0)
        assert got[i] == seen[g]


def test_windows(spark):
    d = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 8, 10), (1, 2, 9, 12), (2, 0, 3, 4), (3, 0, None, 1)], "g int, p int, a int, b int")
    assert [r["gap"] for r in W.adjacent_gap(d, ["g"], ["p"], "a", "b").orderBy("g", "p").collect()] == [3, -1, None, None, None]
    assert {r["g"]: r["ordered"] for r in W.nondecreasing(d, ["g"], ["p"], "a").collect()} == {1: True, 2: True, 3: None}
    assert [(r["seen"], r["flagged"]) for r in W.running_ratio(d.filter("g = 1"), ["g"], ["p"], F.col("a") > 0).orderBy("p").collect()] == [(1, 0), (2, 1), (3, 2)]
    assert [(r["v"], r["id"]) for r in W.numbered(spark.range(2000).select((F.lit(5000) - F.col("id")).alias("v")).repartition(5), ["v"]).orderBy("v").limit(3).collect()] == [(3001, "000001"), (3002, "000002"), (3003, "000003")]


def test_summaries(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 10.0), (None, None)], "k string, v double")
    r = d.agg(*A.numeric_stats("v")).first()
    assert (r["mean"], r["median"], r["min"], r["max"]) == (4.25, 3.0, 1.0, 10.0)
    assert d.limit(0).agg(*A.numeric_stats("v")).first()["mean"] is None
    with pytest.raises(Exception, match="no values"):
        A.strict_stats(d.limit(0), "v").collect()
    assert {r["key"]: r["percent"] for r in A.distribution(d, "k", "?").collect()} == {"a": 60.0, "b": 20.0, "?": 20.0}
    best = A.best_by(spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4)], "k string, i int, v int"), ["k"], F.col("v"), [-F.col("i")]).first()
    assert best["best"]["i"] == 1
    lab = spark.createDataFrame([(["x", "y", "x"], "c1"), (["x"], "c2"), (None, "c1")], "l array<string>, c string")
    assert {r["label"]: (r["n"], r["c1"]) for r in A.label_breakdown(lab, "l", "c", ["c1", "c2"]).collect()} == {"x": (2, 1), "y": (1, 1)}
    ans = spark.createDataFrame([("m", "가나", "가나"), ("m", "가나", None), ("m", "가", "나다라")], "m string, g string, p string")
    s = A.answer_summary(ans, ["m"], "g", "p").first()
    assert (s["distance"], s["characters"], s["exact"], s["character_accuracy"], s["mean_cer"]) == (5, 5, 1, 0.0, 4 / 3)
    delta = A.compare_to(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "n string, v double"), "n", "a", ["v"]).collect()
    assert {r["n"]: r["v_delta"] for r in delta} == {"a": 0.0, "b": 2.0}
    nested = spark.sql("SELECT 'r' AS n, named_struct('cer', 0.5) AS normal, named_struct('cer', 0.7) AS error")
    flat = A.flatten_metrics(nested, "n", {"normal": {"cer": "normal_cer"}, "error": {"cer": "error_cer"}}).first()
    assert (float(flat["normal_cer"]), float(flat["error_cer"])) == (0.5, 0.7)


def test_checks(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    rows = K.row_checks(d, {"given": F.col("k").isNotNull(), "small": F.col("v") < 3}).unionByName(K.unique_checks(d, {"unique": ["k"]})).unionByName(K.count_check(d, 3))
    assert {r["check"]: r["failures"] for r in rows.collect()} == {"given": 1, "small": 1, "unique": 1, "record_count": 0}
    with pytest.raises(ValueError, match="given: 1"):
        K.gate(rows)
    K.gate(rows.filter("check = 'record_count'"))
    assert K.same_rows(d, d).first()["failures"] == 0 and K.same_rows(d, d.limit(2)).first()["failures"] == 1
    assert K.same_schema(d, {"k": "string", "v": "bigint", "w": "int"}) == ["v", "w"]
    assert K.disjoint_check(d, ["v"], d.limit(1), "x").first()["failures"] == 1 and K.reference_check(d, ["v"], d.limit(1), "x").first()["failures"] == 2


def test_layout(spark):
    pages = spark.createDataFrame(
        [(1, (200, 100), [(0, "나", [50.0, 70.0], [10.0, 20.0]), (1, "가", [10.0, 30.0], [12.0, 22.0]), (2, "다", [10.0, 40.0], [60.0, 70.0]), None, (3, "", [5.0, 5.0], [1.0, 2.0]), (4, "라", [float("nan"), 3.0], [1.0, 2.0])])],
        "page_id long, images struct<width: int, height: int>, bbox array<struct<id: int, data: string, x: array<double>, y: array<double>>>",
    )
    b = Y.explode_boxes(pages, strict=True)
    assert [r["problem"] for r in b.orderBy("box").collect()] == [None, None, None, "null_box", "empty_text", "bad_coordinates"]
    assert Y.explode_boxes(pages).filter("problem IS NULL").count() == 4
    good = b.filter("problem IS NULL")
    lines = Y.group_lines(good)
    assert {(r["box"], r["line"], r["place"]) for r in lines.collect()} == {(1, 0, 0), (0, 0, 1), (2, 1, 0)}
    r = Y.line_records(good, lines).orderBy("line").collect()
    assert r[0]["text"] == "가 나" and r[0]["gaps"] == [20.0] and r[0]["ids_follow_places"] is False and r[0]["crop_box"] == [6, 6, 74, 26]
    tall = spark.createDataFrame([(1, 0, (0.0, 0.0, 5.0, 13.0)), (1, 1, (9.0, 9.0, 14.0, 22.0))], "page long, box int, hull struct<xmin: double, ymin: double, xmax: double, ymax: double>")
    assert Y.group_lines(tall, "build").agg(F.max("line")).first()[0] == 1 and Y.group_lines(tall, "analysis").agg(F.max("line")).first()[0] == 0


def test_numbers_past_the_width_are_whole(spark):
    got = W.numbered(spark.range(1_000_003), ["id"], "number").filter("id >= 999998 OR id = 0").orderBy("id")
    assert [r[1] for r in got.collect()] == ["000001", "999999", "1000000", "1000001", "1000002", "1000003"]


def test_greedy_unique_needs_room_for_different_texts_only(spark, monkeypatch):
    one = Q._one_group
    monkeypatch.setattr(Q, "_one_group", lambda rows, run, schema: one(rows, run, schema, most=10))
    d = spark.range(5, 205).selectExpr("id", "concat('s', id % 2) AS source", "concat('t', id % 4) AS text")
    assert {(r["source"], r["id"]) for r in Q.greedy_unique(d, "id", "source", "text").collect()} == {("s0", 8), ("s1", 5)}
