"""Queries over the nested page labels (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.operators import shredding as S
from quillflow.plans.registry import Registry
from quillflow.session import Workspace, table

R = Registry()


def _payloads(spark: SparkSession, sf: str, raw: bool = True) -> DataFrame:
    page = table(spark, sf, "label_page").select("page_id", F.to_json(F.struct("dataset", "images", "bbox")).alias("payload"))
    return page.unionByName(table(spark, sf, "label_raw").select("page_id", "payload")) if raw else page


def _entries(spark: SparkSession, sf: str, keep: str | None = None, raw: bool = True) -> DataFrame:
    """Shredded once, written as the striped table, then read by whatever is rebuilt from it."""
    s = S.shred(_payloads(spark, sf, raw), "page_id", "payload", keep=keep)
    return S.entries(Workspace(spark, "stripes").save(s, "stripes"))


def _clean(t: str) -> str:
    """SQL: a payload without blanks and invisible marks around it."""
    return f"regexp_replace({t}, '^[\\s\\p{{C}}\\p{{Z}}]+|[\\s\\p{{C}}\\p{{Z}}]+$', '', 'g')"


def _inner(c: str) -> str:
    """SQL: a JSON value, or what a JSON text within it says."""
    t = _clean(f"({c} ->> '$')")
    return f"CASE WHEN json_type({c}) = 'VARCHAR' AND json_valid({t}) AND json_type(CAST({t} AS JSON)) IN ('ARRAY', 'OBJECT') THEN CAST({t} AS JSON) ELSE {c} END"


def _list(c: str) -> str:
    """SQL: the elements of a container in any of its shapes."""
    value = f"json_extract({c}, '$.\"' || k || '\"')"
    keyed = f"NOT list_contains(json_keys({c}), 'bbox') AND len(list_filter(json_keys({c}), lambda k: json_type({value}) NOT IN ('OBJECT', 'NULL'))) = 0"
    return f"CASE json_type({c}) WHEN 'ARRAY' THEN json_extract({c}, '$[*]') WHEN 'OBJECT' THEN CASE WHEN len(json_keys({c})) = 0 THEN [] WHEN {keyed} THEN list_transform(json_keys({c}), lambda k: {value}) ELSE [{c}] END ELSE [] END"


#: SQL's own way through both tables: the boxes of every depth, by a recursive query.
BOXES = f"""
    WITH RECURSIVE p AS (SELECT page_id, {_clean('payload')} AS t FROM label_raw), j AS (SELECT page_id, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM p),
    v AS (SELECT page_id, {_inner('j')} AS v FROM j WHERE j IS NOT NULL), c AS (SELECT page_id, CASE WHEN json_type(v) = 'OBJECT' THEN json_extract(v, '$.bbox') END AS c FROM v),
    top AS (SELECT page_id, {_inner('c')} AS c FROM c WHERE c IS NOT NULL),
    b(page_id, box_path, parent_path, depth, e) AS (
      SELECT page_id, CAST(i AS VARCHAR), CAST(NULL AS VARCHAR), 1, e FROM (SELECT page_id, unnest(l) AS e, unnest(range(len(l))) AS i FROM (SELECT page_id, {_list('c')} AS l FROM top))
      UNION ALL SELECT page_id, box_path || '.' || i, box_path, depth + 1, e FROM (SELECT page_id, box_path, depth, unnest(l) AS e, unnest(range(len(l))) AS i FROM
        (SELECT page_id, box_path, depth, {_list('c')} AS l FROM (SELECT page_id, box_path, depth, {_inner('c')} AS c FROM (SELECT page_id, box_path, depth, json_extract(e, '$.bbox') AS c FROM b WHERE json_type(e) = 'OBJECT') WHERE c IS NOT NULL)))),
    k AS (SELECT page_id, unnest(bbox) AS e, unnest(range(len(bbox))) AS i FROM label_page WHERE bbox IS NOT NULL),
    boxes AS (SELECT page_id, box_path, parent_path, depth, CAST(e AS JSON) AS e FROM b WHERE json_type(e) = 'OBJECT'
      UNION ALL SELECT page_id, CAST(i AS VARCHAR), NULL, 1, CAST(e AS JSON) FROM k WHERE e IS NOT NULL)
"""


#: The leaves that a row of boxes comes from.
_OWN = S.BOX + r"\.(\$|id|data)$"


def _text(c: str) -> str:
    return f"CASE WHEN json_type(e, '$.{c}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN e ->> '$.{c}' END"


@R.add("p4_found", BOXES + "SELECT page_id, box_path FROM boxes")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return S.box_places(_entries(spark, sf, S.BOX + r"\.\$$"))


_PLAIN = ("type", "writer_age", "writer_sex", "media_type", "pen_type", "written_content", "application_field")


def _field(group: str, name: str) -> str:
    one = lambda g: f"CASE WHEN json_type(v, '$.{g}.{name}') NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN v ->> '$.{g}.{name}' END"
    return f"coalesce({one(group)}, {one(group.lower())})"


@R.add(
    "p4_pages",
    f"""
    WITH p AS (SELECT page_id, {_clean('payload')} AS t FROM label_raw), j AS (SELECT page_id, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM p), i AS (SELECT page_id, {_inner('j')} AS v FROM j WHERE j IS NOT NULL),
    d AS (SELECT page_id, v FROM i WHERE json_type(v) = 'OBJECT' UNION ALL SELECT page_id, to_json({{'dataset': dataset, 'images': images}}) FROM label_page)
    SELECT page_id, {_field('Dataset', 'label_path')} AS label_path, {_field('Dataset', 'src_path')} AS src_path, {_field('Images', 'identifier')} AS identifier, TRY_CAST({_field('Images', 'width')} AS INTEGER) AS width,
    TRY_CAST({_field('Images', 'height')} AS INTEGER) AS height, coalesce({_field('Images', 'acquisition_location')}, {_field('Images', 'acquistion_location')}) AS acquisition_location, {', '.join(f"{_field('Images', n)} AS {n}" for n in _PLAIN)} FROM d
    """,
)
def p4_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every page that can be read, by its known fields; all of its values, as written, are in p4_leaves."""
    e = _entries(spark, sf, r"^[^\[\]]*$")
    return S.pages(e).drop("fields")


@R.add("p4_boxes", BOXES + f"SELECT page_id, box_path, parent_path, depth, {_text('id')} AS id, {_text('data')} AS data FROM boxes")
def p4_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Every box and its parent; what other fields hold is in p4_points and p4_leaves."""
    return S.boxes(_entries(spark, sf, _OWN)).drop("other")


@R.add("label_profile")
def label_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of the labels as they arrived, by path: records, entries and values."""
    return S.profile(S.shred(table(spark, sf, "label_raw").select("page_id", "payload"), "page_id", "payload"))


@R.add("p4_leaves")
def p4_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Every value that p4_boxes and p4_points do not hold."""
    return S.leaves(_entries(spark, sf, S.LEFT))


@R.add(
    "p4_points",
    BOXES
    + """, a AS (SELECT page_id, box_path, CASE json_type(e, '$.x') WHEN 'ARRAY' THEN json_extract(e, '$.x[*]') ELSE [] END AS x, CASE json_type(e, '$.y') WHEN 'ARRAY' THEN json_extract(e, '$.y[*]') ELSE [] END AS y FROM boxes),
    n AS (SELECT *, unnest(range(greatest(len(x), len(y)))) AS i FROM a), t AS (SELECT page_id, box_path, CAST(i AS INTEGER) AS point, x[i + 1] ->> '$' AS x_text, y[i + 1] ->> '$' AS y_text FROM n)
    SELECT page_id, box_path, point, TRY_CAST(x_text AS DOUBLE) AS x, TRY_CAST(y_text AS DOUBLE) AS y, x_text, y_text FROM t""",
)
def p4_points(spark: SparkSession, sf: str) -> DataFrame:
    return S.points(_entries(spark, sf, S.BOX + r"\.[xy]\[\]$"))


@R.add(
    "p4_page_boxes",
    """
    WITH b AS (SELECT page_id, unnest(bbox) AS e, unnest(range(len(bbox))) AS i FROM label_page WHERE bbox IS NOT NULL)
    SELECT page_id, CAST(i AS VARCHAR) AS box_path, CAST(e.id AS VARCHAR) AS id, e.data AS data FROM b WHERE e IS NOT NULL
    """,
)
def p4_page_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """The typed pages alone, which SQL can follow without JSON."""
    return S.boxes(_entries(spark, sf, _OWN, raw=False)).select("page_id", "box_path", "id", "data")


@R.add(
    "p4_page_points",
    """
    WITH b AS (SELECT page_id, unnest(bbox) AS e, unnest(range(len(bbox))) AS i FROM label_page WHERE bbox IS NOT NULL),
    k AS (SELECT page_id, i, e, unnest(range(greatest(coalesce(len(e.x), 0), coalesce(len(e.y), 0)))) AS j FROM b WHERE e IS NOT NULL)
    SELECT page_id, CAST(i AS VARCHAR) AS box_path, CAST(j AS INTEGER) AS point, e.x[j + 1] AS x, e.y[j + 1] AS y FROM k
    """,
)
def p4_page_points(spark: SparkSession, sf: str) -> DataFrame:
    return S.points(_entries(spark, sf, S.BOX + r"\.[xy]\[\]$", raw=False)).select("page_id", "box_path", "point", "x", "y")
