"""Nested, drifting JSON records -> flat related tables, by columnar shredding.

``shred`` stripes every record into one row per leaf path: three parallel arrays hold the
repetition level, the definition level and the value of each entry, in written order. A path
names its fields with dots and its repeated steps with ``[]``; every repeated step also has the
marker leaf ``$`` that holds the kind of each element, so that an element without any field is
still on record. ``rebuild`` turns the stripes of one or more leaves back into rows of their
nearest repeated ancestor: the place of an entry in each ancestor follows from the repetition
levels alone (running counts), whether it exists from the definition levels.

Levels: a field that is present and not null adds one definition level, a list adds another once
it has an element, an element that is not null adds a third. The repetition level says at which
repeated step the entry begins a new element; 0 begins a new record.

Edge cases. Null or unreadable payloads shred to nothing (``readable`` is false); invisible marks
around a payload are set aside. A field that must be a container (``containers``) may arrive as a
list, as one object (a list of one), as an object of elements keyed by place (its values in written
order, keys kept in the leaf ``$key``), as JSON text of any of these, or null (no elements). Null
elements keep their place. Any unexpected field keeps its own leaf. Repeated rows shred to
repeated stripes, told apart by ``record``. Extra columns of the input are ignored; an input column
may carry any name, for only the two named ones are read.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Steps of nesting that a record may have, times the calls a step takes.
DEEPEST = 1_000_000
STRIPES = T.StructType(
    [
        T.StructField("record", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("max_rep", T.IntegerType()),
        T.StructField("max_def", T.IntegerType()),
        T.StructField("reps", T.ArrayType(T.IntegerType())),
        T.StructField("defs", T.ArrayType(T.IntegerType())),
        T.StructField("vals", T.ArrayType(T.StringType())),
    ]
)


def _bare(text: str) -> str:
    """The text without blanks, controls and invisible marks around it."""
    a, b = 0, len(text)
    odd = lambda c: unicodedata.category(c) in ("Cf", "Cc", "Zs", "Zl", "Zp")
    while a < b and odd(text[a]):
        a += 1
    while b > a and odd(text[b - 1]):
        b -= 1
    return text[a:b]


def _object(pairs: list[tuple[str, object]]) -> dict:
    """The last of fields of one name counts, as everywhere; earlier ones stay on record as name$1, name$2 and so on."""
    out = dict(pairs)
    if len(out) < len(pairs):
        left = {k: 0 for k in out}
        last = {k: i for i, (k, _) in enumerate(pairs)}
        for i, (k, v) in enumerate(pairs):
            if i < last[k]:
                left[k] += 1
                out[f"{k}${left[k]}"] = v
    return out


class _Deep(json.JSONDecoder):
    """Reads texts nested deeper than the built-in reader can go."""

    def __init__(self):
        super().__init__(object_pairs_hook=_object)
        self.parse_object, self.parse_array = json.decoder.JSONObject, json.decoder.JSONArray
        self.scan_once = json.scanner.py_make_scanner(self)


def parse(text: str | None):
    """(readable, value) of a JSON text."""
    if text is None:
        return False, None
    try:
        return True, json.loads(_bare(text), object_pairs_hook=_object)
    except ValueError:
        return False, None
    except RecursionError:
        try:
            return True, _Deep().decode(_bare(text))
        except ValueError:
            return False, None


def _elements(value, names: frozenset[str] = frozenset()):
    """[(key, element)] of a container in any of its shapes; None if it holds none. An object that itself has a container is one element."""
    if isinstance(value, str):
        ok, inner = parse(value)
        return _elements(inner, names) if ok and isinstance(inner, (list, dict)) else [(None, value)]
    if isinstance(value, dict):
        if value and all(isinstance(v, dict) or v is None for v in value.values()) and not names & value.keys():
            return list(value.items())
        return [(None, value)] if value else []
    if isinstance(value, list):
        return [(None, v) for v in value]
    return None if value is None else [(None, value)]


def _kind(v) -> str:
    return "null" if v is None else "object" if isinstance(v, dict) else "list" if isinstance(v, list) else "scalar"


def _scalar(v) -> str:
    return v if isinstance(v, str) else str(v) if type(v) is int else json.dumps(v, ensure_ascii=False)


class _Node:
    """A step of the record's own schema: its path, the levels it can have, and where its entries go."""

    __slots__ = ("path", "mr", "md", "fields", "item", "leaf", "column", "kinds", "live")

    def __init__(self, path: str, mr: int, md: int):
        self.path, self.mr, self.md = path, mr, md
        self.fields: dict[str, _Node] = {}
        self.item: _Node | None = None
        self.leaf = False
        self.column = self.kinds = None
        self.live = False

    def field(self, name: str) -> _Node:
        got = self.fields.get(name)
        if got is None:
            got = self.fields[name] = _Node(f"{self.path}.{name}" if self.path else name, self.mr, self.md + 1)
        return got

    def element(self) -> _Node:
        if self.item is None:
            self.item = _Node(f"{self.path}[]", self.mr + 1, self.md + 2)
        return self.item


class _Shredder:
    """Stripes one record after another; only wanted leaves, and only the steps that lead to them, are visited."""

    def __init__(self, containers: Sequence[str], keep: str | None = None):
        self.containers = frozenset(containers)
        self.wanted = re.compile(keep).search if keep else lambda path: True

    def _form(self, name: str | None, v):
        """Containers become lists of (key, element); other lists too, without keys."""
        if name in self.containers:
            return _elements(v, self.containers)
        return [(None, x) for x in v] if isinstance(v, list) else v

    def _learn(self, node: _Node, v) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                f = self._form(k, x)
                child = node.field(k)
                if isinstance(f, list):
                    item = child.element()
                    for key, e in f:
                        if key is not None:
                            item.field("$key").leaf = True
                        self._learn(item, e)
                else:
                    self._learn(child, f)
        elif isinstance(v, list):
            item = node.element()
            for e in v:
                self._learn(item, e)
        else:
            node.leaf = True

    def _place(self, node: _Node, out: dict) -> bool:
        """Gives wanted leaves their columns; says whether any is below."""
        if node.leaf and self.wanted(node.path):
            node.column = out[node.path] = (node.mr, node.md, [], [], [])
        if node.item is not None and self.wanted(f"{node.path}[].$"):
            node.kinds = out[f"{node.path}[].$"] = (node.mr + 1, node.md + 2, [], [], [])
        below = [self._place(c, out) for c in (*node.fields.values(), *([node.item] if node.item is not None else []))]
        node.live = bool(node.column or node.kinds or any(below))
        return node.live

    def _absent(self, node: _Node, r: int, d: int) -> None:
        """Every leaf below gets an entry that says how far its path exists."""
        if node.column:
            _put(node.column, r, d, None)
        for c in node.fields.values():
            if c.live:
                self._absent(c, r, d)
        if node.item is not None:
            if node.kinds:
                _put(node.kinds, r, d, None)
            if node.item.live:
                self._absent(node.item, r, d)

    def _emit(self, node: _Node, v, r: int, key=None) -> None:
        """Entries of a value that is there; a list comes as pairs of key and element."""
        md = node.md
        if node.column:
            plain = v is not None and not isinstance(v, (dict, list))
            _put(node.column, r, md if plain else md - 1, _scalar(v) if plain else None)
        there = isinstance(v, dict)
        for k, c in node.fields.items():
            if not c.live:
                continue
            if k == "$key":
                if key is not None:
                    self._emit(c, key, r)
                else:
                    self._absent(c, r, md)
            elif there and v.get(k) is not None:
                self._emit(c, self._form(k, v[k]), r)
            else:
                self._absent(c, r, md if there else md - 1)
        item = node.item
        if item is None or not (node.kinds or item.live):
            return
        if isinstance(v, list) and v:
            for i, (k, e) in enumerate(v):
                at = r if i == 0 else item.mr
                e = [(None, x) for x in e] if isinstance(e, list) else e
                if node.kinds:
                    _put(node.kinds, at, md + 2 if e is not None else md + 1, _kind(e))
                if not item.live:
                    continue
                if e is None:
                    self._absent(item, at, md + 1)
                else:
                    self._emit(item, e, at, k)
        else:
            if node.kinds:
                _put(node.kinds, r, md, None)
            if item.live:
                self._absent(item, r, md)

    def __call__(self, value):
        """{path: (max_rep, max_def, reps, defs, vals)} of one record."""
        root, out = _Node("", 0, 0), {}
        if self.wanted("$"):
            out["$"] = (0, 0, [0], [0], [_kind(value)])  # the record itself, which may hold nothing else
        self._learn(root, value)
        if self._place(root, out):
            self._emit(root, value, 0)
        return out


def _put(column: tuple, r: int, d: int, v) -> None:
    column[2].append(r)
    column[3].append(d)
    column[4].append(v)


def shred(df: DataFrame, record: str, payload: str | Column, containers: Sequence[str] = ("bbox",), keep: str | None = None) -> DataFrame:
    """Stripes of each record's payload (JSON text): see the module. One pass, no shuffle.

    ``keep``: a pattern of the paths wanted; other leaves are not striped.
    """
    body = F.col(f"`{payload}`") if isinstance(payload, str) else payload
    rows = df.select(F.col(f"`{record}`").cast("long").alias("record"), body.alias("payload"))
    names = tuple(containers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))  # frames of Python lie on the heap
        sh = _Shredder(names, keep)
        for pdf in batches:
            got = []
            for rec, text in zip(pdf["record"], pdf["payload"]):
                ok, v = parse(text)
                if ok and isinstance(v, str):  # JSON within JSON
                    ok, v = parse(v)
                if not ok or not isinstance(v, dict):
                    continue
                got += [(rec, p, *col) for p, col in sh(v).items()]
            yield pd.DataFrame(got, columns=STRIPES.names)

    return rows.mapInPandas(run, STRIPES)


ENTRIES = "record long, path string, max_rep int, max_def int, pos int, rep int, def int, value string, place array<long>"


def _places(rep: np.ndarray, most: np.ndarray) -> pa.ListArray:
    """The place of each entry in each of its ``most`` repeated ancestors: at level k, entries that begin an element there since the last that began one above."""
    n, at = len(rep), np.arange(len(rep))
    place = np.zeros((n, int(most.max(initial=0))), dtype=np.int64)
    for k in range(1, place.shape[1] + 1):
        count = np.cumsum(rep <= k)
        place[:, k - 1] = count - count[np.maximum.accumulate(np.where(rep < k, at, 0))]
    offsets = np.concatenate(([0], np.cumsum(most)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(place[np.arange(place.shape[1]) < most[:, None]], pa.int64()))


def entries(stripes: DataFrame, rows: int = 256) -> DataFrame:
    """One row per entry, with its place in each repeated ancestor (``place``, outermost first).

    A stripe holds all entries of a record's leaf, so places come from its own levels and nothing is shuffled. ``rows`` stripes are
    worked on at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                b = whole.slice(a, rows)
                lists = {c: b.column(c).flatten() for c in ("reps", "defs", "vals")}
                n = pc.list_value_length(b.column("reps")).to_numpy(zero_copy_only=False).astype(np.int64)
                of = np.repeat(np.arange(b.num_rows), n)
                most = b.column("max_rep").to_numpy()[of]
                pos = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                head = [b.column(c).take(pa.array(of)) for c in ("record", "path", "max_rep", "max_def")]
                got = [*head, pa.array(pos, pa.int32()), lists["reps"], lists["defs"], lists["vals"], _places(lists["reps"].to_numpy(zero_copy_only=False), most)]
                yield pa.RecordBatch.from_arrays(got, ["record", "path", "max_rep", "max_def", "pos", "rep", "def", "value", "place"])

    return stripes.select("record", "path", "max_rep", "max_def", "reps", "defs", "vals").mapInArrow(run, ENTRIES)


def profile(stripes: DataFrame) -> DataFrame:
    """(path, records, entries, present): how many records have each leaf path, its entries, and those with a value; drift shows as paths of few records."""
    there = F.size(F.filter(F.zip_with("defs", "vals", lambda d, v: (d == F.col("max_def")) & v.isNotNull()), lambda x: x))
    return stripes.groupBy("path").agg(F.count_distinct("record").alias("records"), F.sum(F.size("defs")).alias("entries"), F.sum(there).alias("present"))


BOX = r"^bbox\[\](\.bbox\[\])*"


def boxes(e: DataFrame) -> DataFrame:
    """One row per box: page_id, box_path, parent_path (null at the top), depth, id, data, and its other scalar fields as a map."""
    at = e.filter(F.col("path").rlike(BOX + r"\.[^.\[\]]+$"))
    own = F.col("def") == F.col("max_def")
    name = F.element_at(F.split("path", r"\."), -1)
    g = at.groupBy("record", "max_rep", "place").agg(
        F.max(F.when((name == "$") & own & (F.col("value") == "object"), True)).alias("is_box"),
        F.max(F.when(name == "id", F.col("value"))).alias("id"),
        F.max(F.when(name == "data", F.col("value"))).alias("data"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~name.isin("$", "id", "data") & own, F.struct(name.alias("key"), F.col("value").alias("value")))))).alias("other"),
    )
    parent = F.slice("place", 1, F.col("max_rep") - 1)
    return g.filter("is_box").select(
        F.col("record").alias("page_id"),
        F.array_join(F.col("place").cast("array<string>"), ".").alias("box_path"),
        F.when(F.col("max_rep") > 1, F.array_join(parent.cast("array<string>"), ".")).alias("parent_path"),
        F.col("max_rep").alias("depth"),
        "id",
        "data",
        "other",
    )


def box_places(e: DataFrame) -> DataFrame:
    """page_id and box_path of every box, from the marker leaves alone."""
    at = e.filter(F.col("path").rlike(BOX + r"\.\$$") & (F.col("def") == F.col("max_def")) & (F.col("value") == "object"))
    return at.select(F.col("record").alias("page_id"), F.array_join(F.col("place").cast("array<string>"), ".").alias("box_path"))


def points(e: DataFrame) -> DataFrame:
    """One row per coordinate place of a box: page_id, box_path, point, x, y (as written, and as numbers where they are)."""
    at = e.filter(F.col("path").rlike(BOX + r"\.[xy]\[\]$"))
    axis = F.element_at(F.split(F.regexp_replace("path", r"\[\]$", ""), r"\."), -1)
    at = at.withColumn("up", F.slice("place", 1, F.col("max_rep") - 1)).filter(F.col("def") >= F.col("max_def") - 1)
    g = at.groupBy("record", "up", F.element_at("place", -1).alias("point")).agg(
        F.max(F.when(axis == "x", F.col("value"))).alias("x_text"), F.max(F.when(axis == "y", F.col("value"))).alias("y_text")
    )
    return g.select(
        F.col("record").alias("page_id"),
        F.array_join(F.col("up").cast("array<string>"), ".").alias("box_path"),
        F.col("point").cast("int").alias("point"),
        F.expr("try_cast(x_text as double)").alias("x"),
        F.expr("try_cast(y_text as double)").alias("y"),
        "x_text",
        "y_text",
    )


def pages(e: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, the fields of Dataset and Images, and with any other top-level scalar as a map of path to text.

    ``records``: a frame with a column ``record`` of all pages, where ``e`` may lack those without a top-level scalar.
    """
    at = e.filter((F.col("max_rep") == 0) & (F.col("def") == F.col("max_def")) & (F.col("path") != "$"))
    g = at.groupBy("record").agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("key"), F.col("value").alias("value")))).alias("f"))
    known = (e if records is None else records).select("record").distinct()
    m = F.map_from_entries(F.coalesce(F.col("f"), F.array().cast("array<struct<key:string,value:string>>")))
    g = known.join(g, "record", "left").withColumn("m", m)
    place = lambda n: F.coalesce(F.col("m")[f"Images.{n}"], F.col("m")[f"images.{n}"])
    data = lambda n: F.coalesce(F.col("m")[f"Dataset.{n}"], F.col("m")[f"dataset.{n}"])
    return g.select(
        F.col("record").alias("page_id"), data("label_path").alias("label_path"), data("src_path").alias("src_path"), place("identifier").alias("identifier"),
        F.expr("try_cast(coalesce(m['Images.width'], m['images.width']) as int)").alias("width"),
        F.expr("try_cast(coalesce(m['Images.height'], m['images.height']) as int)").alias("height"),
        F.coalesce(place("acquisition_location"), place("acquistion_location")).alias("acquisition_location"),
        *(place(n).alias(n) for n in ("type", "writer_age", "writer_sex", "media_type", "pen_type", "written_content", "application_field")),
        F.col("m").alias("fields"),
    )


#: Leaves that no other table holds: not the id and data of a box, its coordinates, or the markers.
LEFT = r"^(?!\$$)(?!bbox\[\](\.bbox\[\])*\.(id|data|[xy]\[\])$)(?!.*\[\]\.\$$)"


def leaves(e: DataFrame) -> DataFrame:
    """One row per value that ``boxes`` and ``points`` do not hold, at any depth: page_id, box_path (null outside boxes), path, place, value.

    ``path`` is whole, ``place`` the place in each of its repeated steps; top-level values are here as written, with a column in ``pages`` or not.
    """
    at = e.filter(F.col("path").rlike(LEFT) & (F.col("def") == F.col("max_def")) & F.col("value").isNotNull())
    up = F.regexp_count(F.regexp_extract("path", BOX + r"\.", 0), F.lit(r"\[\]"))
    steps = F.col("place").cast("array<string>")
    return at.select(
        F.col("record").alias("page_id"), F.when(up > 0, F.array_join(F.slice(steps, F.lit(1), up), ".")).alias("box_path"), "path", F.array_join(steps, ".").alias("place"), "value"
    )
