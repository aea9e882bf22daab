"""Page layout: boxes, lines of boxes, line records.

A page's boxes are read in a fixed order and each joins the nearest line within a tolerance; a line's centre moves with its
members, so the grouping depends on the order and runs per page (a page is a small, natural group).
"""

from __future__ import annotations

from statistics import mean, median

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillflow.functions import text as X


def finite(a: str | Column) -> Column:
    """The finite numbers of an array."""
    a = F.col(a) if isinstance(a, str) else a
    return F.filter(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def box_hull(x: Column, y: Column, strict: bool = False) -> Column:
    """Least and greatest coordinates of a box as a struct; null without two finite ones a side, and, if strict, without area."""
    fx, fy = finite(x), finite(y)
    h = F.struct(F.array_min(fx).alias("xmin"), F.array_min(fy).alias("ymin"), F.array_max(fx).alias("xmax"), F.array_max(fy).alias("ymax"))
    ok = (F.size(fx) >= 2) & (F.size(fy) >= 2)
    if strict:
        ok = ok & (F.array_max(fx) > F.array_min(fx)) & (F.array_max(fy) > F.array_min(fy))
    return F.when(ok, h)


def pixel_box(hull: Column, width: Column, height: Column) -> Column:
    """The hull in whole pixels if it lies in the page and has area; else null."""
    b = F.struct(F.floor(hull["xmin"]).cast("int").alias("x0"), F.floor(hull["ymin"]).cast("int").alias("y0"), F.ceil(hull["xmax"]).cast("int").alias("x1"), F.ceil(hull["ymax"]).cast("int").alias("y1"))
    return F.when((b["x0"] >= 0) & (b["y0"] >= 0) & (b["x1"] <= width) & (b["y1"] <= height) & (b["x1"] > b["x0"]) & (b["y1"] > b["y0"]), b)


def padded(box: Column, width: Column, height: Column, pad: int) -> Column:
    """[x0, y0, x1, y1] grown by pad and kept in the page."""
    zero = F.lit(0)
    return F.array(F.greatest(zero, box["x0"] - pad), F.greatest(zero, box["y0"] - pad), F.least(width, box["x1"] + pad), F.least(height, box["y1"] + pad))


def explode_boxes(pages: DataFrame, page: str = "page_id", strict: bool = False) -> DataFrame:
    """(page, box, id, data, hull, problem): one row per entry of a page's bbox array, with what is wrong with it."""
    e = pages.select(F.col(page).alias("page"), F.col("images.width").alias("width"), F.col("images.height").alias("height"), F.posexplode("bbox").alias("box", "b"))
    h = box_hull(F.col("b.x"), F.col("b.y"), strict)
    problem = F.when(F.col("b").isNull(), "null_box")
    if strict:
        problem = problem.when(X.collapse(F.coalesce("b.data", F.lit(""))) == "", "empty_text")
    problem = problem.when(h.isNull(), "bad_coordinates")
    return e.select("page", "box", "width", "height", F.col("b.id").alias("id"), F.col("b.data").alias("data"), h.alias("hull"), problem.alias("problem"))


LINES = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("box", "line", "place")]))
#: The two ways at hand: floor of the tolerance in pixels, and how a line's centre follows its boxes.
PRESETS = {"analysis": (10.0, mean), "build": (8.0, median)}
#: Where boxes of a line begin at one place: by their place in the page, or by their id as text.
BY_ID = {"build"}


def _grouped(boxes: list[tuple], floor: float, share: float, centre, by_id: bool) -> list[tuple[int, int, int]]:
    """(box, line, place) of one page's boxes, given as (ymin, ymax, xmin, xmax, box, id)."""
    rows = sorted(((b[0] + b[1]) / 2, (b[2] + b[3]) / 2, b[4], b[2], str(b[5]) if by_id else "") for b in boxes)
    tolerance = max(floor, share * median(b[1] - b[0] for b in boxes))
    lines: list[list] = []
    middles: list[float] = []
    for r in rows:
        near = min(((abs(m - r[0]), k) for k, m in enumerate(middles)), default=None)
        if near is not None and near[0] <= tolerance:
            k = near[1]
            lines[k].append(r)
            middles[k] = centre([m[0] for m in lines[k]])
        else:
            lines.append([r])
            middles.append(r[0])
    order = sorted(range(len(lines)), key=middles.__getitem__)
    return [(m[2], line, place) for line, k in enumerate(order) for place, m in enumerate(sorted(lines[k], key=lambda m: (m[3], m[4], m[2] if not by_id else (m[0], m[1], m[2]))))]


def group_lines(boxes: DataFrame, preset: str = "build", share: float = 0.6) -> DataFrame:
    """(page, box, line, place): lines from top to bottom and places from left to right, both 0-based.

    ``boxes``: page, box, hull and, for the build preset, id of usable boxes. A page's boxes travel as one array.
    """
    floor, centre = PRESETS[preset]
    by_id = preset in BY_ID and "id" in boxes.columns

    @F.pandas_udf(LINES)
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([_grouped([(b["ymin"], b["ymax"], b["xmin"], b["xmax"], b["box"], b["id"]) for b in p], floor, share, centre, by_id) for p in pages], dtype=object)

    h = F.col("hull")
    one = F.struct(h["ymin"].alias("ymin"), h["ymax"].alias("ymax"), h["xmin"].alias("xmin"), h["xmax"].alias("xmax"), F.col("box").cast("int").alias("box"), (F.col("id") if by_id else F.lit(None)).cast("string").alias("id"))
    per = boxes.filter("hull IS NOT NULL").groupBy(F.col("page").cast("long").alias("page")).agg(F.collect_list(one).alias("boxes"))
    return per.select("page", F.explode(run("boxes")).alias("m")).select("page", "m.*")


def line_records(boxes: DataFrame, lines: DataFrame, pad: int = 4) -> DataFrame:
    """One row per line: text, tokens, ratios, gaps, whether ids follow the places, and the padded crop box."""
    b = boxes.join(lines, ["page", "box"])
    s = F.array_sort(F.collect_list(F.struct("place", "data", "id", "hull"))).alias("s")
    g = b.groupBy("page", "line").agg(s, F.max("width").alias("width"), F.max("height").alias("height"))
    hull = lambda f, n: f(F.transform("s", lambda x: x["hull"][n]))
    pix = F.struct(*(f(hull(a, n)).cast("int").alias(m) for f, a, n, m in ((F.floor, F.array_min, "xmin", "x0"), (F.floor, F.array_min, "ymin", "y0"), (F.ceil, F.array_max, "xmax", "x1"), (F.ceil, F.array_max, "ymax", "y1"))))
    text = F.array_join(F.transform("s", lambda x: F.coalesce(x["data"], F.lit(""))), " ")
    gaps = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.element_at("s", i + 1)["hull"]["xmin"] - F.element_at("s", i)["hull"]["xmax"])
    gaps = F.when(F.size("s") > 1, gaps).otherwise(F.array().cast("array<double>"))
    ids = F.transform("s", lambda x: x["id"])
    follow = F.when(~F.exists(ids, lambda i: i.isNull()), F.array_sort(ids) == ids)
    return g.select(
        "page", "line", F.size("s").alias("n_boxes"), text.alias("text"), F.transform("s", lambda x: x["data"]).alias("tokens"), X.hangul_ratio(text).alias("hangul_ratio"), X.digit_ratio(text).alias("digit_ratio"),
        F.filter(gaps, lambda x: x >= 0).alias("gaps"), F.size(F.filter(gaps, lambda x: x < 0)).alias("overlaps"), follow.alias("ids_follow_places"), padded(pix, F.col("width"), F.col("height"), pad).alias("crop_box"),
    )
