"""Shredding against a plain walk, and its edge cases."""

import json

from pyspark.sql import functions as F

from quillflow.operators import shredding as S


def _walk(container, prefix=""):
    """box_path of every box, the plain way."""
    if isinstance(container, str):
        try:
            container = json.loads(container)
        except ValueError:
            return
    if isinstance(container, dict):
        container = list(container.values()) if container and "bbox" not in container and all(isinstance(v, dict) or v is None for v in container.values()) else [container] if container else []
    for i, e in enumerate(container or []):
        if isinstance(e, dict):
            yield f"{prefix}{i}"
            yield from _walk(e.get("bbox"), f"{prefix}{i}.")


PAYLOADS = [
    {"Dataset": {"label_path": "a", "src_path": "b"}, "Images": {"identifier": "P1", "width": "10", "height": 20}, "bbox": [{"id": 0, "data": "가", "x": [1, 2], "y": [3.5, "4"]}, None, {"id": 1, "bbox": [{"id": 2, "x": []}, {"bbox": [{}, {"x": None}]}]}, {}]},
    {"bbox": {"id": 5, "x": 3, "note": {"k": [1, [2]]}}},
    {"bbox": {"0": {"id": 1}, "1": None, "10": {"id": 3}, "2": {"id": 4, "bbox": "[{\"id\": 9}]"}}},
    {"bbox": json.dumps([{"id": 1}, {"id": 2}])},
    {"bbox": {"bbox": {"id": 1}}}, {"bbox": {"bbox": [{"bbox": {"bbox": {}}}]}},
    {"bbox": None}, {"bbox": []}, {"Images": None}, {"bbox": "no boxes"}, {"bbox": [3, "x", [1]]},
]


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "page_id long, payload string, path string")


def test_places_equal_walk(spark):
    texts = [json.dumps(p, ensure_ascii=False) for p in PAYLOADS] + ["﻿" + json.dumps(PAYLOADS[0]) + "​", "{\"bbox\": [", "", None, "null", "[1]", json.dumps(json.dumps(PAYLOADS[0]))]
    s = S.shred(_frame(spark, texts), "page_id", "payload").cache()
    got = {(r["page_id"], r["box_path"]) for r in S.box_places(S.entries(s)).collect()}
    want = {(i, b) for i, p in enumerate(PAYLOADS) for b in _walk(p.get("bbox"))}
    n = len(PAYLOADS)
    want |= {(i, b) for i in (n, n + 6) for b in _walk(PAYLOADS[0]["bbox"])}
    assert got == want


def test_tables_link_and_lose_nothing(spark):
    s = S.shred(_frame(spark, [json.dumps(PAYLOADS[0])]), "page_id", "payload").cache()
    e = S.entries(s).cache()
    b = {r["box_path"]: r for r in S.boxes(e).collect()}
    assert b["2.1.0"]["parent_path"] == "2.1" and b["0"]["parent_path"] is None and b["0"]["data"] == "가" and b["2.0"]["id"] == "2"
    assert [(r["box_path"], r["point"], r["x"], r["y"]) for r in S.points(e).orderBy("box_path", "point").collect()] == [("0", 0, 1.0, 3.5), ("0", 1, 2.0, 4.0)]
    p = S.pages(e).first()
    assert (p["identifier"], p["width"], p["height"], p["label_path"]) == ("P1", 10, 20, "a")
    leaves = sum(len([v for v in r["vals"] if v is not None]) for r in s.filter(~F.col("path").endswith("$")).collect())
    assert leaves == 2 + 3 + 6 + 2  # every scalar of the payload: Dataset, Images, the first box, and the ids of two others


def test_levels_follow_definition():
    cols = S._Shredder(["bbox"])({"bbox": [{"x": [1, 2]}, None, {"x": []}, {}]})
    assert cols["bbox[].x[]"][2:] == ([0, 2, 1, 1, 1], [6, 6, 2, 4, 3], ["1", "2", None, None, None])
    assert cols["bbox[].$"][2:] == ([0, 1, 1, 1], [3, 2, 3, 3], ["object", "null", "object", "object"])


def test_long_page_and_empty_table(spark):
    big = json.dumps({"bbox": [{"id": i, "bbox": [{"id": 0}] * 3} for i in range(5000)]})
    s = S.shred(_frame(spark, [big]), "page_id", "payload")
    assert S.box_places(S.entries(s)).count() == 20000
    empty = S.shred(_frame(spark, [big]).limit(0), "page_id", "payload")
    assert S.box_places(S.entries(empty)).count() == 0 and S.pages(S.entries(empty)).count() == 0


def test_remaining_leaves(spark):
    texts = [
        {"Images": {"identifier": "P", "type": "t", "width": "wide", "pen_type": "ink"}, "odd": 7, "list": [{"k": [1, 2]}],
         "bbox": [{"id": 0, "x": [1], "size": 4, "note": {"checked": True, "tags": ["a", "b"]}, "bbox": [{"id": 1, "note": {"checked": False}}, 8]}, 9]},
        {"bbox": [{"id": 3, "x": 5}]},
    ]
    d = _frame(spark, [json.dumps(t) for t in texts])
    want = {
        (0, None, "Images.identifier", "", "P"), (0, None, "Images.type", "", "t"), (0, None, "Images.width", "", "wide"), (0, None, "Images.pen_type", "", "ink"), (0, None, "odd", "", "7"),
        (0, None, "list[].k[]", "0.0", "1"), (0, None, "list[].k[]", "0.1", "2"), (0, "0", "bbox[].size", "0", "4"), (0, "0", "bbox[].note.checked", "0", "true"),
        (0, "0", "bbox[].note.tags[]", "0.0", "a"), (0, "0", "bbox[].note.tags[]", "0.1", "b"), (0, "0.0", "bbox[].bbox[].note.checked", "0.0", "false"),
        (0, "0", "bbox[].bbox[]", "0.1", "8"), (0, None, "bbox[]", "1", "9"), (1, "0", "bbox[].x", "0", "5"),
    }
    for keep in (None, S.LEFT):
        s = S.shred(d, "page_id", "payload", keep=keep).cache()
        got = [tuple(r) for r in S.leaves(S.entries(s)).collect()]
        assert set(got) == want and len(got) == len(want)
    s = S.shred(d, "page_id", "payload").cache()
    p = {r["page_id"]: r for r in S.pages(S.entries(s.filter("max_rep = 0")), s).collect()}
    assert set(p) == {0, 1} and (p[0]["type"], p[0]["pen_type"], p[1]["type"]) == ("t", "ink", None)


def test_deep_nesting(spark):
    """Records nested deeper than the interpreter's usual limit are shredded like others."""
    note, boxes, n = "1", "{}", 1500
    for _ in range(n):
        note, boxes = '{"k": ' + note + "}", '{"bbox": [' + boxes + "]}"
    far = "[" * 30_000 + "]" * 30_000
    s = S.shred(_frame(spark, ['{"bbox": [{"id": 4, "note": ' + note + "}]}", boxes, '{"bbox": [{"id": 7, "far": ' + far + "}]}"]), "page_id", "payload", keep=S.BOX + r"\.(\$|id)$").cache()
    got = S.box_places(S.entries(s)).collect()
    assert sorted(r["page_id"] for r in got) == [0] + [1] * n + [2]
    assert max((r["box_path"] for r in got), key=len) == ".".join(["0"] * n)


def test_repeated_names_are_kept(spark):
    s = S.shred(_frame(spark, ['{"a": 1, "b": 2, "a": 3, "a": 4, "bbox": [{"id": 1, "id": 2}]}']), "page_id", "payload").cache()
    e = S.entries(s).cache()
    assert {(r["path"], r["value"]) for r in S.leaves(e).collect()} == {("a", "4"), ("a$1", "1"), ("a$2", "3"), ("b", "2"), ("bbox[].id$1", "1")}
    assert S.boxes(e).first()["id"] == "2"


def test_pages_without_fields_are_pages(spark):
    s = S.shred(_frame(spark, ["{}", '{"bbox": []}', '{"Images": null}', "[1]", "x"]), "page_id", "payload")
    assert {r["page_id"] for r in S.pages(S.entries(s)).collect()} == {0, 1, 2}
