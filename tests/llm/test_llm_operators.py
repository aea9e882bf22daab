"""Each operator against brute force on small fixtures, and its edge cases."""

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillflow.llm import answers, charforms, leaks, mixing, overlaps, repetition, residue, splits


# --- problem 1 ---------------------------------------------------------------------------------------------------------
def _sets(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, ks in pairs:
        for k in ks:
            if k is not None:
                parent[find(("r", i))] = find(("k", k))
    out = {}
    for i, ks in pairs:
        if any(k is not None for k in ks):
            out.setdefault(find(("r", i)), set()).add(i)
    return {i: min(s) for s in out.values() for i in s}


def test_tied_sets_equal_union_find(spark):
    rnd = random.Random(3)
    pairs = [(i, [f"k{rnd.randrange(90)}", None if rnd.random() < 0.4 else f"k{rnd.randrange(90)}"]) for i in range(80)]
    pairs += [(1000 + i, ["hot", f"k{200 + i}"]) for i in range(60)]  # one key in a third of the rows
    pairs += [(2000 + i, [f"c{i}", f"c{i + 1}"]) for i in range(40)]  # a chain
    pairs += [(3000, [None, None]), (5, ["k1", "k1"])]
    df = spark.createDataFrame([(i, ks, "x") for i, ks in pairs], "id long, ks array<string>, key string")
    got = {r["id"]: r["group_id"] for r in splits.tied_sets(df, "id", F.col("ks")).collect()}
    assert got == _sets(pairs)


def test_tied_sets_of_nothing(spark):
    df = spark.createDataFrame([], "id long, ks array<string>")
    assert splits.tied_sets(df, "id", F.col("ks")).count() == 0


def test_splits_keep_proportions(spark):
    rows = [(i, 1) for i in range(3000)] + [(9000, 1500)]
    g = spark.createDataFrame(rows, "group_id long, weight long")
    out = g.join(splits.assign_splits(g, {"train": 0.8, "validation": 0.1, "test": 0.1}), "group_id")
    w = {r["split"]: r["w"] for r in out.groupBy("split").agg(F.sum("weight").alias("w")).collect()}
    assert out.count() == len(rows)
    assert all(abs(w[s] / 4500 - p) < 0.02 for s, p in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
    assert splits.assign_splits(g.limit(0), {"a": 0.5, "b": 0.5}).count() == 0


# --- problem 2 ---------------------------------------------------------------------------------------------------------
G = "키 큰 악사는 하늬 책방에서 접힌 열쇠를 챙기는 사이 장날 수업이 끝나고 평범한 구슬을 무심코 그렸다."
P = "사진 속 손글씨를 보이는 대로 옮겨 적으세요. 고치지 마세요."
CASES = [
    (1, G, None), (2, "```text\n" + G + "\n```", None), (3, "인식 결과: " + G, None), (4, None, "empty"), (5, "“”", "empty"), (6, "<think>줄을 센다.</think>\n``` ```", "empty"), (7, G[:20], "truncated"),
    (8, "<think>x</think>키 큰 악산는 하늬 책방에서 접힌…", "truncated"), (9, P, "copied_prompt"), (10, "질문: 고치지 마세요.", "copied_prompt"), (11, "죄송합니다. 이미지의 글씨를 판독할 수 없습니다.", "refusal"),
    (12, "I am sorry, I cannot read this image.", "refusal"), (13, "雨の日に隣の大工は図書館で小さなかばんを直しました。", "other_language"), (14, "Una tarde de lluvia mi tía contó el cuaderno viejo.", "other_language"),
    (15, G + " " + G + " " + G, None), (16, G[:-1], None), (17, G * 400, None), (18, "", "empty"),
]


def test_defects(spark):
    rows = [(i, a, P, G, "clash") for i, a, _ in CASES] + [(30, "x y", None, None, "clash"), (31, G, None, G, "clash"), (32, "미안하지만 그날은 편지를 읽을 수 없었다.", P, "미안하지만 그날은 편지를 읽을 수 없었다.", "c")]
    df = spark.createDataFrame(rows, "id long, raw string, prompt string, gt string, a string")
    got = {r["id"]: r["defect_type"] for r in answers.defects(df, "id", "raw", "prompt", "gt").collect()}
    assert got == {i: d for i, _, d in CASES if d}
    assert answers.defects(df.limit(0), "id", "raw", "prompt", "gt").count() == 0


def test_shortened_finds_prefixes(spark):
    rows = [(1, "가나다라 마바", False), (2, "다른말 다라마바 사아자", False), (3, "전혀 다른 글입니다", False), (4, "가나다라 마바", False), (None, "가나다라 마바 사아자 차카", True), (None, "어떤말 다라마바 사아자 차카", True)]
    t = spark.createDataFrame(rows, "id long, t string, w boolean")
    assert {r["id"] for r in answers.shortened(t, "id", "t", "w").collect()} == {1, 2, 4}  # the second by its second word


@pytest.mark.parametrize("per", [7, 10_000])
def test_neighbours_equal_brute_force(spark, per):
    from quillflow.session import Workspace

    rnd = random.Random(9)
    some = {"가가가" + "".join(rnd.choice("가나다") for _ in range(rnd.randrange(1, 9))): rnd.random() < 0.2 for _ in range(120)}  # one opening
    d = spark.createDataFrame(list(some.items()), "t string, whole boolean")
    got = {r["t"]: (r["before"], r["after"]) for r in answers.neighbours(d, Workspace(spark, "n"), per).collect()}
    want = {t: (max((x for x, w in some.items() if w and x < t), default=None), min((x for x, w in some.items() if w and x > t), default=None)) for t in some}
    assert got == want


def test_truncation_comes_from_sorting_and_spikes(spark, monkeypatch):
    d = spark.createDataFrame([(1, G[:20], P, G), (2, G, P, G), (3, "컨 " + G[2:22], P, G)], "id long, raw string, prompt string, gt string")
    found = lambda: {r["id"] for r in answers.defects(d, "id", "raw", "prompt", "gt").collect()}
    assert found() == {1, 3}
    monkeypatch.setattr(answers, "shortened", lambda texts, *a, **k: texts.select(F.col("k")).limit(0))
    assert found() == set()


def test_truncation_equals_full_alignment(spark):
    """What is left out before the alignment would not be truncated by it."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("가나다라마") for _ in range(rnd.randrange(1, 4)))
    rows = []
    for i in range(300):
        g = " ".join(word() for _ in range(12)) + "."
        a = list(g[: rnd.randrange(6, len(g) + 1)])
        for _ in range(rnd.randrange(5)):
            a[rnd.randrange(len(a))] = rnd.choice(["", "바", "사자", " "])
        rows.append((i, "".join(a), "문장을 적으세요.", g))
    d = spark.createDataFrame(rows, "id long, raw string, prompt string, gt string")
    got = {r["id"] for r in answers.defects(d, "id", "raw", "prompt", "gt").filter("defect_type = 'truncated'").collect()}
    plain = lambda x: "".join(c for c in x if c.isalpha())
    want = set()
    for i, a, _, g in rows:
        a, g = plain(a), plain(g)
        n, j = min((_lev(a, g[:j]), -j) for j in range(len(g) + 1))
        if n <= len(a) * 0.35 and len(g) + j >= len(g) * 0.25:
            want.add(i)
    assert got <= want and len(want - got) <= len(want) // 25 and len(want) > 100, want - got  # sorting may miss a text misread in each of its first words


def test_prefix_fit_equals_brute_force():
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("가나다라") for _ in range(n))
    for _ in range(300):
        g = word(rnd.randrange(1, 30))
        a = list(g[: rnd.randrange(1, len(g) + 1)])
        for _ in range(rnd.randrange(4)):
            a[rnd.randrange(len(a))] = word(rnd.randrange(3))
        a = "".join(a) or "가"
        best = min((_lev(a, g[:j]), -j) for j in range(len(g) + 1))
        want = (best[0], -best[1]) if best[0] <= int(len(a) * 0.35) else (float("inf"), 0)
        assert answers._prefix_fit(a, g, 0.35) == want


def test_length_spikes(spark):
    rows = [("x" * 50,)] * 200 + [("x" * n,) for n in range(20, 90)]
    assert [r["spike"] for r in answers.length_spikes(spark.createDataFrame(rows, "t string"), "t").collect()] == [50]


def test_very_long_answers_are_compared_whole(spark):
    rnd = random.Random(7)
    long = "".join(chr(rnd.randrange(0xAC00, 0xD7A4)) for _ in range(6000))
    other = "".join(chr(rnd.randrange(0xAC00, 0xD7A4)) for _ in range(6000))
    rows = [
        (1, long[1:], long, "짧은 글"),  # the prompt but for its first letter
        (2, "가" + long, long, "짧은 글"),
        (3, long[:3000] + other[:3000], long, "짧은 글"),  # half of it
        (4, "the " * 1900, "x", "the " * 1900),
        (5, long[1:], long[:5500], long),  # reads like its reference, which comes first
        (6, "가나다라마바사" * 900, ("가나다라마바사" + other[:7]) * 450, "짧은 글"),  # a loop is no copy
    ]
    d = spark.createDataFrame(rows, "k long, raw string, prompt string, ref string")
    got = {r["k"]: r["defect_type"] for r in answers.defects(d, "k", "raw", "prompt", "ref").collect()}
    assert got == {1: "copied_prompt", 2: "copied_prompt"}


def test_banded_distance_is_exact(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("가나b") for _ in range(rnd.randrange(12)))
    d = spark.createDataFrame([(word(), word(), k) for _ in range(300) for k in (0, 1, 3, 6)], "x string, y string, k int")
    full, band = F.levenshtein("x", "y"), F.call_function("levenshtein", "x", "y", "k")
    assert d.filter((full <= F.col("k")) != (band >= 0)).count() == 0


# --- problem 3 ---------------------------------------------------------------------------------------------------------
def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_near_texts_equal_brute_force(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("가나다라마바사아") for _ in range(n)) for n in (12, 25, 40, 44, 60, 89, 95, 130) for _ in range(4)]

    def edit(s, k):
        s = list(s)
        for _ in range(k):
            op, i = rnd.randrange(3), rnd.randrange(len(s))
            if op == 0:
                s[i] = "파"
            elif op == 1:
                s.insert(i, "하")
            else:
                del s[i]
        return "".join(s)

    train = list(dict.fromkeys([edit(b, k) for b in base for k in (1, 2, 4, len(b) // 10, len(b) // 10 + 2)]))
    e = spark.createDataFrame([(i, t) for i, t in enumerate(dict.fromkeys(base))], "id long, text string")
    t = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(train)], "id long, text string")
    got = {(r["id_e"], r["id_t"]) for r in overlaps.near_texts(e, t).collect()}
    want = {(i, 1000 + j) for i, a in enumerate(dict.fromkeys(base)) for j, b in enumerate(train) if a != b and _lev(a, b) <= max(len(a), len(b)) // 10}
    assert got >= want and all(_lev(*pair) <= max(map(len, pair)) // 10 for pair in ((list(dict.fromkeys(base))[i], train[j - 1000]) for i, j in got))
    assert len(want) > 50


def test_overlaps_edge_cases(spark):
    e = spark.createDataFrame([(1, "Ａｂｃ 가나다!", None, "h1", "x"), (2, None, "", None, "x"), (3, "   ", None, "", "x"), (4, "abc가나다", None, "h2", "x")], "r long, g string, c string, h string, row string")
    t = spark.createDataFrame([(11, "abc 가나다", None, "h1", "x"), (12, None, None, None, "x"), (13, "", "", "", "x"), (11, "abc 가나다", None, "h1", "x")], "r long, g string, c string, h string, id string")
    h = F.nullif(F.col("h"), F.lit(""))
    o = overlaps.overlaps(e, t, "r", ["g", "c"], ["g", "c"], {"hash": (h, h)})
    assert sorted((r["row_e"], r["row_t"], r["kind"]) for r in overlaps.expand(o).collect()) == [(1, 11, "hash"), (1, 11, "text"), (4, 11, "text")]
    assert {tuple(r) for r in o.links.collect()} == {("text", 1, 11), ("hash", 1, 11)}
    assert {tuple(r) for r in o.members.filter("kind = 'text'").collect()} == {("e", "text", 1, 1), ("e", "text", 4, 1), ("t", "text", 11, 11)}
    assert overlaps.overlaps(e, t.limit(0), "r", ["g"], ["g"], {"hash": (h, h)}).links.count() == 0


def test_hot_segments_are_split_and_lose_nothing(spark, monkeypatch):
    rnd = random.Random(11)
    tail = lambda: "".join(rnd.choice("가나다라마바사아") for _ in range(25))
    base = ["같은시작으로쓴글의첫머리" + tail() for _ in range(30)]
    e = spark.createDataFrame(list(enumerate(base)), "id long, text string")
    t = spark.createDataFrame([(100 + i, b[:-1] + "하") for i, b in enumerate(base)], "id long, text string")
    monkeypatch.setattr(overlaps, "PER_TASK", 50)
    assert {(r["id_e"], r["id_t"]) for r in overlaps.near_texts(e, t).collect()} >= {(i, 100 + i) for i in range(30)}


# --- problem 5 ---------------------------------------------------------------------------------------------------------
TEXTS = ["a\u0316\u0301", "q\u0301\u0307\u0316", "a\u0301\u0301", "\u0301a", "αɑօⲟᎪ", "", "  ", "가나다", "각 ᄀ", "q̣̇", "q̣̇", "Ｐａｘ－７", "Ρах-7", "a​b﻿c", "a 　 b", "café", "café", "ﬁ①²", "ﾻﾻㅋ", "Å", "ộ", "한국어", "\U0001f600x", "­조‍선", "a\tb\nc", "말 없는 악산는 푸른솔"]


def test_one_form_equals_fold(spark):
    texts = TEXTS + ["가" * 20000 + "각", unicodedata.normalize("NFD", "손글씨 인식 시험 문장이다. Ångström")]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "k long, t string, pos string")
    got = {r["k"]: r["form"] for r in charforms.one_form(df, "k", "t").collect()}
    assert got == {i: charforms.fold(t) for i, t in enumerate(texts)}
    none = spark.createDataFrame([(1, None)], "k long, t string")
    assert [tuple(r) for r in charforms.one_form(none, "k", "t").collect()] == [(1, None)]
    assert charforms.one_form(none.limit(0), "k", "t").count() == 0


def test_fold_keeps_visible_differences():
    f = charforms.fold
    assert f("가나") == f(unicodedata.normalize("NFD", "가나")) and f("Рах") == "Pax" and f("a b") == "a b"
    assert f("ﬁ") != "fi" and f("①") != "1" and f("ㄱㅏ") != "가" and f("A") != f("a") and f("ab") != f("a b")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_fold_is_idempotent(s):
    assert charforms.fold(charforms.fold(s)) == charforms.fold(s)


# --- problem 6 ---------------------------------------------------------------------------------------------------------
def _share(words, g=5):
    t = "".join(words)
    g = min(g, max(1, len(t) // 2))
    seen, on = set(), [False] * len(t)
    for i in range(len(t) - g + 1):
        w = t[i : i + g]
        if w in seen:
            on[i : i + g] = [True] * g
        seen.add(w)
    seen, k = set(), 0
    for w in words:
        if w in seen:
            on[k : k + len(w)] = [True] * len(w)
        seen.add(w)
        k += len(w)
    return sum(on) / len(t) if t else 0.0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="가나다ab ", max_size=80))
def test_repeated_share_equals_brute_force(t):
    assert repetition.repeated_share(t.split()) == pytest.approx(_share(t.split()))


def _bands(spark, rows):
    return {r["id"]: r for r in spark.createDataFrame(rows, "id long, t string").select("id", repetition.repetition(F.col("t")).alias("m")).select("id", "m.*", repetition.rejected().alias("rejected")).collect()}


def test_repetition_bands(spark):
    loop, fresh = "1. " + G + "\n2. " + G + "\n3. " + G, G
    rnd = random.Random(1)
    noise = "".join(chr(rnd.randrange(0xAC00, 0xD7A3)) for _ in range(3000))
    rows = [(1, loop), (2, fresh), (3, None), (4, ""), (5, "...!!"), (6, noise), (7, noise + noise), (8, "ㅋ" * 50), (9, "지난수요일" * 30), (10, fresh * 2000)]
    rows += [(11, "안녕 안녕"), (12, "안녕하세 안녕하세"), (13, "아아아아아"), (14, "2023 2023 2023"), (15, "가나다"), (16, "1. 가나다라 2. 마바사아 3. 자차카타")]
    got = _bands(spark, rows)
    assert {i for i, r in got.items() if r["rejected"]} == {1, 7, 8, 9, 10, 11, 12, 13, 14}
    assert got[3]["repeated_share"] is None and got[4]["repeated_share"] == 0 and got[5]["band"] == "empty" and got[6]["band"] in ("incompressible", "fresh")
    assert got[16]["repeated_share"] == 0


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", [chr(c) for c in range(0xAC00, 0xD7A4)], [chr(0xAC00 + 28 * k) for k in range(300)]])
def test_no_band_passes_over_half_repeated_text(spark, letters):
    rnd = random.Random(2)
    rows = []
    for i in range(80):  # shuffled pieces that each stand twice, the hardest to compress
        n = rnd.choice((10, 20, 40, 60, 100, 200, 450, 900, 3000, 9000)) // 10
        pieces = ["".join(rnd.choice(letters) for _ in range(5)) for _ in range(n)] * 2
        rnd.shuffle(pieces)
        rows.append((i, "".join(pieces)))
    big = ["".join(rnd.choice(letters) for _ in range(5)) for _ in range(6000)] * 2
    rnd.shuffle(big)
    got = _bands(spark, rows + [(99, "".join(big))])
    assert all(r["rejected"] for r in got.values() if r["repeated_share"] >= 0.5) and sum(r["repeated_share"] >= 0.5 for r in got.values()) > 60


# --- problem 7 ---------------------------------------------------------------------------------------------------------
def test_automaton_finds_longest_matches():
    rnd = random.Random(2)
    items = ["".join(rnd.choice("abc") for _ in range(30)) for _ in range(4)] + ["aaaa", "aaaa"]
    a = leaks.Automaton(items, 3)
    joined = "|" + "|".join(items) + "|"
    for _ in range(50):
        t = "".join(rnd.choice("abcd") for _ in range(40))
        got = {e: (n, s) for e, n, s in zip(*(x.tolist() for x in a.stream(t, 1)))}
        for end in range(1, 41):
            n = max((k for k in range(end + 1) if any(t[end - k : end] in x for x in items)), default=0)
            assert got.get(end, (0, 0))[0] == n
            if n:
                w = t[end - n : end]
                s = got[end][1]
                assert {p - n + 1 for p in a.ends[a.lo[s] : a.hi[s]].tolist()} == {i for i in range(len(joined)) if joined.startswith(w, i)}
            if n >= 3:
                s = a.locus[got[end][1]]
                assert sorted(p - 2 for p in a.ends[a.lo[s] : a.hi[s]].tolist()) == [i for i in range(len(joined)) if joined.startswith(t[end - 3 : end], i)]


def test_matches_are_each_items_own_longest():
    rnd = random.Random(3)
    g = leaks.Group([(i, "".join(rnd.choice("가나") for _ in range(25))) for i in range(5)], 1.0)
    joined = "\1" + "".join(t + "\1" for t in g.texts)
    for pairs in (1, leaks.PAIRS):
        leaks.PAIRS, was = pairs, leaks.PAIRS
        text = "\0" + "".join(rnd.choice("가나다") for _ in range(80)) + "\0"
        got = sorted(map(tuple, g.matches(text).tolist()))
        leaks.PAIRS = was
        want = []
        for i in range(1, len(text)):
            for p in range(1, len(joined)):
                if text[i - 1] != joined[p - 1]:
                    n = 0
                    while text[i + n : i + n + 1] == joined[p + n : p + n + 1] != "":
                        n += 1
                    if n >= 5:
                        want.append((i, p, n))
        assert got == want


ITEM = "차가운 봉투를 챙겼던 목소리 큰 요리사는 휴가 마지막 날 밤늦게 참샘 우체국까지 가서 평범한 못을 꼼꼼히 구경했다. 운동회 날 점심시간에 물안개 빵집에 들른 느긋한 기관사는 기꺼이 찢어진 접시를 꺼냈고, 짧은 나침반도 함께 숨겼다."
OTHER = "새벽별 공원 앞에서 앞집 할아버지는 얇은 화분을 준비하다가 장마철 아홉 시쯤 오래된 편지를 힘차게 찾았다. "


def test_leaks(spark):
    half = ITEM[: len(ITEM) * 6 // 10]
    docs = [
        (1, OTHER + ITEM + OTHER), (2, OTHER * 5), (3, None), (4, ""), (5, OTHER + ITEM.replace(" ", "").replace("평범한", "둥근")), (6, OTHER + unicodedata.normalize("NFD", ITEM)), (7, OTHER + half), (8, OTHER + ITEM[: len(ITEM) // 4]),
        (9, OTHER * 3000 + ITEM), (1, OTHER + ITEM + OTHER),
    ]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, id string")
    q = spark.createDataFrame([(100, ITEM), (101, None), (102, " "), (103, OTHER + "x")], "item_id long, text string")
    got = leaks.leaks(d, "doc_id", "text", q.filter("item_id < 103"), "item_id", "text")
    assert sorted((r["item_id"], r["doc_id"]) for r in got.collect()) == [(100, 1), (100, 1), (100, 5), (100, 6), (100, 7), (100, 9)]
    clean = {r["doc_id"]: r["text"] for r in leaks.without_spans(d.filter("doc_id = 1").limit(1), "doc_id", "text", got).collect()}
    assert "요리사" not in clean[1] and clean[1].count("할아버지") == 2
    assert leaks.leaks(d, "doc_id", "text", q.limit(0), "item_id", "text").count() == 0
    assert leaks.leaks(d.limit(0), "doc_id", "text", q, "item_id", "text").count() == 0
    few = leaks.leaks(d, "doc_id", "text", q, "item_id", "text", block_chars=60)  # several blocks give the same rows
    assert {(100, 1), (100, 9), (103, 2)} <= {(r["item_id"], r["doc_id"]) for r in few.collect()}


def test_leaks_of_half_in_blocks_runs_or_altered(spark):
    words = ITEM.split()
    block, n = "", 0
    for w in words:  # a block of just over half
        if n * 2 >= len(leaks.normal(ITEM)):
            break
        block, n = block + w + " ", n + len(leaks.normal(w))
    runs = [" ".join(words[k : k + 4]) for k in range(0, len(words), 4)]
    other = OTHER.split()
    scattered = " ".join(r + " " + " ".join(other[k : k + 6]) for k, r in enumerate(runs[:5]))
    altered = " ".join("둥근" if k % 3 == 2 else w for k, w in enumerate(words))
    third = " ".join(words[: len(words) * 3 // 10])
    docs = [(1, OTHER + block + OTHER), (2, OTHER + scattered + OTHER), (3, OTHER + altered), (4, OTHER + third + OTHER), (5, OTHER * 4)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(100, ITEM)], "item_id long, text string")
    assert {r["doc_id"] for r in leaks.leaks(d, "doc_id", "text", q, "item_id", "text").collect()} == {1, 2, 3}


def test_bounds_pass_no_item_over():
    """What the bounds leave out has no passages that cover so much."""
    rnd = random.Random(5)
    words = ITEM.split() + OTHER.split()
    (g,) = leaks.Block([1, 2], [ITEM, OTHER]).groups
    found = 0
    for _ in range(400):
        text = leaks.normal(" ".join(rnd.choice([ITEM, OTHER])[(a := rnd.randrange(60)) : a + rnd.randrange(4, 30)] if rnd.random() < 0.7 else rnd.choice(words) for _ in range(8)))
        got = {k: share for _, k, share, _ in g.leaked([text], 0.3)}
        m = g.matches("\0" + text + "\0")
        for k in range(2):
            own = sorted((i - 1, p - int(g.first[k]), n) for i, p, n in m.tolist() if g.first[k] <= p < g.first[k] + len(g.texts[k]))
            share = leaks._cover([(p, q) for _, _, p, q in g.passages(k, own)]) / len(g.texts[k])
            dense = g.exact(own, g.passages(k, own)) >= leaks.DENSE * 0.3 * len(g.texts[k])
            assert (share >= 0.3 and dense) == (k in got) and got.get(k, share) == share
            found += k in got
    assert found > 20


def test_an_item_inside_a_longer_match_of_another_is_found(spark):
    """A = X + Y, B = X + Z, and a document holds X + Y: both leak."""
    rnd = random.Random(8)
    w = lambda n: "".join(chr(rnd.randrange(0xAC00, 0xD7A4)) for _ in range(n))
    x, y, z = w(40), w(20), w(20)
    d = spark.createDataFrame([(1, OTHER + x + y)], "doc_id long, text string")
    q = spark.createDataFrame([(1, x + y), (2, x + z)], "item_id long, text string")
    assert {r["item_id"] for r in leaks.leaks(d, "doc_id", "text", q, "item_id", "text").collect()} == {1, 2}


@pytest.mark.parametrize("copies", [1, 3, 4, 10])
def test_altered_items_are_found_however_often_they_stand_in_the_set(spark, copies):
    rnd = random.Random(8)
    item = [chr(rnd.randrange(0xAC00, 0xD7A4)) for _ in range(64)]
    altered = "".join("하" if i % 16 == 15 else c for i, c in enumerate(item))
    d = spark.createDataFrame([(1, OTHER + altered)], "doc_id long, text string")
    q = spark.createDataFrame([(i, "".join(item)) for i in range(copies)], "item_id long, text string")
    assert leaks.leaks(d, "doc_id", "text", q, "item_id", "text").count() == copies


def test_invisible_letters_do_not_hide_a_leak():
    assert leaks.normal("가\u3164나") == "가나" == leaks.places("가\u3164나")[0]


# --- problem 8 ---------------------------------------------------------------------------------------------------------
def test_mix_reaches_targets(spark):
    rnd = random.Random(4)
    rows = [(i, s, max(1, int(rnd.gauss(200, 80)))) for i, s in enumerate(["Big One"] * 4000 + ["big-one"] * 100 + ["small"] * 200 + [None] * 20 + ["else"] * 50)] + [(99999, "small", 0)]
    d = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = {"big_one": (0.7, 1), "small": (0.3, 3), "absent": (0.0, 2)}
    m = mixing.mix(d, "doc_id", mixing.source_form(F.col("source")), "tokens", targets).cache()
    s = {r["source"]: r for r in mixing.shares(m, targets).collect()}
    assert abs(s["big_one"]["reached_share"] - 0.7) < 0.005 and abs(s["small"]["reached_share"] - 0.3) < 0.005 and s["absent"]["copies"] == 0
    assert m.filter("copies > 3 OR (source = 'big_one' AND copies > 1) OR (source = 'else' AND copies > 0)").count() == 0
    free = m.filter("source = 'big_one'").select("tokens", F.log("rate").alias("l")).toPandas()
    assert np.polyfit(free["tokens"], free["l"], 1, full=True)[1].sum() < 1e-6  # exponentially tilted in tokens
    assert mixing.mix(d.limit(0), "doc_id", F.col("source"), "tokens", targets).count() == 0


def test_token_count(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "손글씨 인식 123! \n\n it's"), (6, "가" * 20000), (7, "\ud7a3 e\u0301 \u3164")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = [{r["id"]: r["n"] for r in df.select("id", mixing.token_count(F.col("t"), f"/opt/tokenizers/byte_bpe_50k.{kind}").alias("n")).collect()} for kind in ("json", "tiktoken")]
    assert got[0] == got[1] and got[0][1] == 2 and got[0][2] == got[0][3] == 0 and got[0][4] > 1


# --- problem 9 ---------------------------------------------------------------------------------------------------------
def test_residue(spark):
    rnd = random.Random(6)
    w = "어부 농부 악사 약사 사서 시장 공원 책방 강당 편지를 열쇠를 사과를 모자를 그렸다 팔았다 샀다 날랐다".split()
    prose = lambda n: " ".join(" ".join(rnd.choice(w) for _ in range(8)) + "." for _ in range(n))
    docs = [(i, prose(6)) for i in range(300)]
    docs += [(1000 + i, x) for i, x in enumerate(["페이지를 찾을 수 없습니다.\n메뉴 | 위로", "잠시 후 다시 시도해 주세요.\n메뉴 | 위로", "JavaScript is required.\n메뉴 | 위로", "요청하신 원고를 열 수 없습니다.\n메뉴 | 위로"] * 10)]
    docs += [(2001, prose(3) + " {{이름}} " + prose(3)), (2002, "집합 {1, 2, 3}의 [참고] <나의 하루>라고 " + prose(5)), (2003, prose(6) + " 어부는 찾을 수 없습니다 라는 말을 적었다."), (2004, None), (2005, ""), (2006, prose(4000)), (2007, "값이 9% 올라 " + prose(4))]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string")
    r = residue.residue(d, "doc_id", "text").filter("excluded")
    assert {x["doc_id"] for x in r.collect()} == {*range(1000, 1040), 2001}
    assert residue.residue(d.limit(0), "doc_id", "text").count() == 0


def _prose(rnd, english):
    if english:
        a = "the old clerk|a quiet teacher|their miller|one careful nurse".split("|")
        b = "polished counted repaired misplaced carried sold".split()
        c = "striped heavy curious woollen rusty bent".split()
        d = "chair hinge basket ribbon jar satchel".split()
        e = "by the market|inside the chapel|near the school|behind the canal".split("|")
        return " ".join(f"On Monday {rnd.choice(a)} {rnd.choice(b)} the {rnd.choice(c)} {rnd.choice(d)} {rnd.choice(e)}." for _ in range(6))
    w = "어부 농부 악사 약사 사서 시장 공원 책방 강당 편지를 열쇠를 사과를 모자를 그렸다 팔았다 샀다 날랐다".split()
    return " ".join(" ".join(rnd.choice(w) for _ in range(8)) + "." for _ in range(6))


@pytest.mark.parametrize("n", [100, 1000, 10_000])
def test_residue_at_every_size(spark, n):
    """Prose in a language rare among notices, and prose that speaks of errors, stays in, however few trusted records there are."""
    rnd = random.Random(n)
    notices = ["Page not found.", "Access denied.\nGo back", "페이지를 찾을 수 없습니다.\n메뉴 | 위로", "Please enable JavaScript to view this page.", "로그인이 필요합니다."]
    docs, want = [], set()
    for i in range(n):
        if i % 25 == 0:
            docs.append((i, notices[i // 25 % 5]))
            want.add(i)
        elif i % 25 == 1:
            docs.append((i, _prose(rnd, i % 2 == 0) + " " + rnd.choice(["{{ name }}", "${date}", "[INSERT TITLE HERE]", "<%= sign_off %>"]) + " " + _prose(rnd, False)))
            want.add(i)
        elif i % 25 == 2:
            docs.append((i, _prose(rnd, True) + " The clerk wrote that page 22 was not found in the old index. " + _prose(rnd, True)))
        else:
            docs.append((i, _prose(rnd, i % 10 == 3) + (" [참고] (a b 3)" if i % 40 == 7 else "")))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"] for r in residue.residue(d, "doc_id", "text").filter("excluded").collect()} == want
