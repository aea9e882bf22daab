"""Queries over page labels and text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.functions import labels as B
from quillflow.functions import text as X
from quillflow.operators import checks as K
from quillflow.operators import layout as Y
from quillflow.operators import matching as J
from quillflow.operators import rules as U
from quillflow.operators import sampling as Q
from quillflow.operators import summaries as A
from quillflow.operators import windows as W
from quillflow.plans import sqltext as S
from quillflow.plans.registry import Registry
from quillflow.session import table
from quillflow.sources import readers as D

R = Registry()


@R.add(
    "rejection_cascade",
    f"""
    SELECT coalesce(model_name, '<MISSING>') AS model_name, CASE WHEN prediction IS NULL THEN 'non_string' WHEN trim(regexp_replace(prediction, '{S.BLANK}+', ' ', 'g')) = '' THEN 'empty' WHEN length({S.bare('prediction')}) < 2 THEN 'too_short'
      WHEN NOT regexp_matches(prediction, '[가-힣]') THEN 'not_in_script' WHEN regexp_matches(prediction, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') THEN 'email_like' WHEN regexp_matches({S.bare('prediction')}, '\\p{{Nd}}{{7,}}') THEN 'long_digit_sequence'
      WHEN CAST({S.count_of('prediction', chr(92) + 'p{Nd}')} AS DOUBLE) / greatest(1, length({S.bare('prediction')})) > 0.2 THEN 'digit_ratio' ELSE 'accepted' END AS reason, count(*) AS n
    FROM strict_error_prediction GROUP BY 1, 2
    """,
)
def rejection_cascade(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "strict_error_prediction").withColumn("model_name", F.coalesce("model_name", F.lit("<MISSING>")))
    return U.reason_counts(U.route(d, U.text_rules("prediction")), "reason", "model_name")


@R.add(
    "line_flags",
    f"""
    SELECT line_id, array_to_string(list_filter([CASE WHEN {S.words('ground_truth')} < 2 THEN 'single_word' END, CASE WHEN CAST({S.count_of('ground_truth', '[가-힣]')} AS DOUBLE) / greatest(1, length({S.bare('ground_truth')})) < 0.5 THEN 'mostly_symbols' END,
      CASE WHEN bbox_id_order_matches_x_order IS NOT TRUE THEN 'uncertain_order' END, CASE WHEN visual_gt_coverage_pass IS NOT TRUE THEN 'coverage' END], lambda x: x IS NOT NULL), '|') AS reasons FROM line_record
    """,
)
def line_flags(spark: SparkSession, sf: str) -> DataFrame:
    """All reasons against each line, in order."""
    rules = [
        U.Rule("single_word", X.word_count("ground_truth") < 2), U.Rule("mostly_symbols", U.mostly_symbols("ground_truth")), U.Rule("uncertain_order", ~U.is_true("bbox_id_order_matches_x_order")),
        U.Rule("coverage", ~U.is_true("visual_gt_coverage_pass")),
    ]
    return table(spark, sf, "line_record").select("line_id", F.array_join(U.all_matches(rules), "|").alias("reasons"))


@R.add(
    "personal_data",
    """
    SELECT line_id, regexp_matches(g, '(?i)[\\p{L}\\p{N}_][\\p{L}\\p{N}_.+-]*@[\\p{L}\\p{N}_.-]+\\.[a-z]{2,}([^\\p{L}\\p{N}_]|$)') OR regexp_matches(g, '(^|[^0-9])(01[016789][- ]?[0-9]{3,4}[- ]?[0-9]{4}|0[0-9]{1,2}[- ]?[0-9]{3,4}[- ]?[0-9]{4})([^0-9]|$)')
      OR regexp_matches(g, '(^|[^0-9])[0-9]{6}[- ]?[1-4][0-9]{6}([^0-9]|$)') OR regexp_matches(g, '[0-9]{7,}') OR regexp_matches(g, '(?i)(https?://|www\\.)\\S+') AS personal,
      regexp_matches(g, '[.!?。！？]\\s*$') AS terminal FROM (SELECT line_id, coalesce(ground_truth, '') AS g FROM line_record)
    """,
)
def personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "line_record").select("line_id", U.personal("ground_truth").alias("personal"), U.terminal("ground_truth").alias("terminal"))


@R.add(
    "text_measures",
    f"""
    SELECT line_id, length({S.bare('ground_truth')}) AS nonspace, {S.words('ground_truth')} AS words, CAST({S.count_of('ground_truth', '[가-힣]')} AS DOUBLE) / greatest(1, length({S.bare('ground_truth')})) AS hangul,
      CAST({S.count_of('ground_truth', chr(92) + 'p{Nd}')} AS DOUBLE) / greatest(1, length({S.bare('ground_truth')})) AS digits, {S.canon('ground_truth')} AS canonical, {S.nopunct('ground_truth')} AS without_punctuation FROM line_record
    """,
)
def text_measures(spark: SparkSession, sf: str) -> DataFrame:
    g = "ground_truth"
    return table(spark, sf, "line_record").select(
        "line_id", X.nonspace_length(g).cast("long").alias("nonspace"), X.word_count(g).cast("long").alias("words"), X.hangul_ratio(g).alias("hangul"), X.digit_ratio(g).alias("digits"),
        X.canonical(g).alias("canonical"), X.punctuation_insensitive(g).alias("without_punctuation"),
    )


@R.add(
    "match_audit",
    """
    WITH a AS (SELECT images.identifier AS k, count(*) AS nl FROM label_page GROUP BY 1), b AS (SELECT identifier AS k, count(*) AS nr FROM line_record GROUP BY 1),
    j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(nl, 0) AS nl, coalesce(nr, 0) AS nr FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k),
    g AS (SELECT count(*) FILTER (WHERE k IS NOT NULL AND nl > 0) AS left_keys, count(*) FILTER (WHERE k IS NOT NULL AND nr > 0) AS right_keys, count(*) FILTER (WHERE k IS NOT NULL AND nl > 0 AND nr > 0) AS matched,
      count(*) FILTER (WHERE k IS NOT NULL AND nl > 0 AND nr = 0) AS missing, count(*) FILTER (WHERE k IS NOT NULL AND nl = 0 AND nr > 0) AS orphaned, count(*) FILTER (WHERE k IS NOT NULL AND nl = 1 AND nr = 1) AS one_to_one,
      count(*) FILTER (WHERE k IS NOT NULL AND (nl > 1 OR nr > 1)) AS ambiguous, CAST(coalesce(sum(CASE WHEN k IS NULL THEN nl + nr END), 0) AS BIGINT) AS without_key FROM j)
    SELECT *, missing = 0 AND orphaned = 0 AND ambiguous = 0 AND without_key = 0 AS passed FROM g
    """,
)
def match_audit(spark: SparkSession, sf: str) -> DataFrame:
    return J.match_audit(table(spark, sf, "label_page"), F.col("images.identifier"), table(spark, sf, "line_record"), F.col("identifier"))


@R.add(
    "unique_match",
    """
    WITH o AS (SELECT images.identifier AS k, any_value(page_id) AS page_id FROM label_page WHERE images.identifier IS NOT NULL GROUP BY 1 HAVING count(*) = 1)
    SELECT line_id, page_id FROM line_record JOIN o ON k = identifier
    """,
)
def unique_match(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "label_page").select(F.col("images.identifier").alias("identifier"), "page_id")
    return J.unique_match(table(spark, sf, "line_record").select("line_id", "identifier"), pages, "identifier").select("line_id", "page_id")


@R.add(
    "lines_per_page",
    """
    WITH c AS (SELECT identifier, count(*) FILTER (WHERE bbox_count >= 2) AS n FROM line_record WHERE identifier IS NOT NULL GROUP BY 1)
    SELECT page_id, coalesce(n, 0) AS n_lines FROM label_page LEFT JOIN c ON c.identifier = images.identifier
    """,
)
def lines_per_page(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "line_record").filter("identifier IS NOT NULL").groupBy("identifier").agg(F.count_if(F.col("bbox_count") >= 2).alias("n"))
    p = table(spark, sf, "label_page").select("page_id", F.col("images.identifier").alias("identifier"))
    return p.join(c, "identifier", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n_lines"))


@R.add(
    "page_fields",
    """
    WITH p AS (SELECT images AS i, dataset AS d FROM label_page), f AS (SELECT unnest([{'field': 'writer_age', 'value': i.writer_age}, {'field': 'writer_sex', 'value': i.writer_sex}, {'field': 'media_type', 'value': i.media_type}, {'field': 'pen_type', 'value': i.pen_type},
      {'field': 'written_content', 'value': i.written_content}, {'field': 'type', 'value': lower(i.type)}, {'field': 'location', 'value': coalesce(i.acquisition_location, i.acquistion_location)}, {'field': 'same_path', 'value': CAST(d.label_path = d.src_path AS VARCHAR)}]) AS x FROM p)
    SELECT x.field AS field, coalesce(x.value, '<MISSING>') AS value, count(*) AS n FROM f GROUP BY 1, 2
    """,
)
def page_fields(spark: SparkSession, sf: str) -> DataFrame:
    i = lambda n: F.col(f"images.{n}")
    fields = [(n, i(n)) for n in ("writer_age", "writer_sex", "media_type", "pen_type", "written_content")]
    fields += [("type", F.lower(i("type"))), ("location", F.coalesce(i("acquisition_location"), i("acquistion_location"))), ("same_path", F.col("dataset.label_path") == F.col("dataset.src_path"))]
    return A.field_distributions(table(spark, sf, "label_page"), fields)


@R.add("json_keys", "WITH k AS (SELECT unnest(json_keys(props)) AS key FROM events) SELECT key, count(*) AS n FROM k GROUP BY key")
def json_keys(spark: SparkSession, sf: str) -> DataFrame:
    return A.json_keys(table(spark, sf, "events"), "props")


_BOX_SQL = """
    WITH b AS (SELECT page_id AS page, images.width AS w, images.height AS h, unnest(bbox) AS e, unnest(range(len(bbox))) AS box FROM label_page WHERE bbox IS NOT NULL),
    f AS (SELECT *, list_filter(e.x, lambda v: v IS NOT NULL AND isfinite(v)) AS fx, list_filter(e.y, lambda v: v IS NOT NULL AND isfinite(v)) AS fy FROM b)
"""


@R.add(
    "box_problems",
    _BOX_SQL
    + f"""
    SELECT CASE WHEN e IS NULL THEN 'null_box' WHEN trim(regexp_replace(coalesce(e.data, ''), '{S.BLANK}+', ' ', 'g')) = '' THEN 'empty_text'
      WHEN len(fx) >= 2 AND len(fy) >= 2 AND list_max(fx) > list_min(fx) AND list_max(fy) > list_min(fy) THEN 'fine' ELSE 'bad_coordinates' END AS problem, count(*) AS n FROM f GROUP BY 1
    """,
)
def box_problems(spark: SparkSession, sf: str) -> DataFrame:
    b = Y.explode_boxes(table(spark, sf, "label_page"), strict=True)
    return b.groupBy(F.coalesce("problem", F.lit("fine")).alias("problem")).agg(F.count("*").alias("n"))


@R.add(
    "pixel_boxes",
    _BOX_SQL
    + """
    , p AS (SELECT page, box, w, h, CAST(floor(list_min(fx)) AS INTEGER) AS x0, CAST(floor(list_min(fy)) AS INTEGER) AS y0, CAST(ceil(list_max(fx)) AS INTEGER) AS x1, CAST(ceil(list_max(fy)) AS INTEGER) AS y1 FROM f WHERE len(fx) >= 2 AND len(fy) >= 2)
    SELECT page, CAST(box AS INTEGER) AS box, x0, y0, x1, y1 FROM p WHERE x0 >= 0 AND y0 >= 0 AND x1 <= w AND y1 <= h AND x1 > x0 AND y1 > y0
    """,
)
def pixel_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = Y.explode_boxes(table(spark, sf, "label_page")).withColumn("p", Y.pixel_box(F.col("hull"), F.col("width"), F.col("height"))).filter("p IS NOT NULL")
    return b.select("page", "box", "p.*")


def _lines(spark: SparkSession, sf: str, preset: str) -> tuple[DataFrame, DataFrame]:
    b = Y.explode_boxes(table(spark, sf, "label_page"), strict=preset == "build").filter("problem IS NULL")
    return b, Y.group_lines(b, preset)


def _lines_sql(name: str, floor: float, centre: str, strict: bool) -> str:
    """SQL's own way to lines: one box of every page after another, the lines so far as a list."""
    fine = f"trim(regexp_replace(coalesce(e.data, ''), '{S.BLANK}+', ' ', 'g')) <> '' AND list_max(fx) > list_min(fx) AND list_max(fy) > list_min(fy)" if strict else "true"
    middle = f"list_aggregate(list_append(lines[i].ys, cy), '{centre}')"
    return f"""
    {name}_b AS (SELECT page, CAST(box AS INTEGER) AS box, e.id AS id, (list_min(fy) + list_max(fy)) / 2 AS cy, (list_min(fx) + list_max(fx)) / 2 AS cx, list_min(fx) AS x0, list_max(fy) - list_min(fy) AS tall FROM f WHERE e IS NOT NULL AND len(fx) >= 2 AND len(fy) >= 2 AND {fine}),
    {name}_o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY cy, cx, box) AS k, greatest({floor}, 0.6 * median(tall) OVER (PARTITION BY page)) AS tol FROM {name}_b),
    {name}_s(page, k, lines) AS (SELECT page, k, [{{'c': CAST(cy AS DOUBLE), 'ys': [CAST(cy AS DOUBLE)], 'bs': [box]}}] FROM {name}_o WHERE k = 1
      UNION ALL SELECT page, k, CASE WHEN least_ > tol THEN list_append(lines, {{'c': cy, 'ys': [cy], 'bs': [box]}})
        ELSE list_transform(range(1, len(lines) + 1), lambda j: CASE WHEN j = i THEN {{'c': {middle}, 'ys': list_append(lines[i].ys, cy), 'bs': list_append(lines[i].bs, box)}} ELSE lines[j] END) END
      FROM (SELECT *, list_position(far, list_min(far)) AS i, list_min(far) AS least_ FROM (SELECT o.page, o.k, o.cy, o.box, o.tol, s.lines, list_transform(s.lines, lambda l: abs(l.c - o.cy)) AS far FROM {name}_s s JOIN {name}_o o ON o.page = s.page AND o.k = s.k + 1))),
    {name}_l AS (SELECT page, n, CAST(row_number() OVER (PARTITION BY page ORDER BY l.c, n) - 1 AS INTEGER) AS line, l.bs AS bs FROM (SELECT page, unnest(lines) AS l, unnest(range(len(lines))) AS n FROM (SELECT page, arg_max(lines, k) AS lines FROM {name}_s GROUP BY page)))"""


_BUILD, _ANALYSIS = _lines_sql("build", 8.0, "median", True), _lines_sql("analysis", 10.0, "avg", False)


@R.add(
    "line_places",
    _BOX_SQL.replace("WITH b", "WITH RECURSIVE b", 1)
    + f""", {_BUILD}, u AS (SELECT page, line, unnest(bs) AS box FROM build_l)
    SELECT u.page, u.box, u.line, CAST(row_number() OVER (PARTITION BY u.page, u.line ORDER BY o.x0, coalesce(CAST(o.id AS VARCHAR), 'None'), o.k) - 1 AS INTEGER) AS place FROM u JOIN build_o o ON o.page = u.page AND o.box = u.box""",
)
def line_places(spark: SparkSession, sf: str) -> DataFrame:
    """The line of each box and its place in it."""
    return _lines(spark, sf, "build")[1]


@R.add("lines_rebuilt")
def lines_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    b, lines = _lines(spark, sf, "build")
    return Y.line_records(b, lines)


@R.add(
    "lines_compared",
    _BOX_SQL.replace("WITH b", "WITH RECURSIVE b", 1)
    + f""", {_BUILD}, {_ANALYSIS}, x AS (SELECT page, count(*) AS build FROM build_l GROUP BY page), y AS (SELECT page, count(*) AS analysis FROM analysis_l GROUP BY page)
    SELECT page, CAST(build AS INTEGER) AS build, CAST(analysis AS INTEGER) AS analysis FROM x FULL JOIN y USING (page)""",
)
def lines_compared(spark: SparkSession, sf: str) -> DataFrame:
    """Lines per page by either way of grouping."""
    n = lambda p: _lines(spark, sf, p)[1].groupBy("page").agg((F.max("line") + 1).alias(p))
    return n("build").join(n("analysis"), "page", "full_outer")


@R.add(
    "token_gaps",
    """
    WITH b AS (SELECT line_id, unnest(token_bboxes) AS t, unnest(range(len(token_bboxes))) AS k FROM line_record WHERE token_bboxes IS NOT NULL)
    SELECT line_id, CAST(k AS INTEGER) AS place, lead(t[1]) OVER (PARTITION BY line_id ORDER BY k) - t[3] AS gap FROM b
    """,
)
def token_gaps(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "line_record").select("line_id", F.posexplode("token_bboxes").alias("place", "t")).select("line_id", "place", F.get("t", F.lit(0)).alias("x0"), F.get("t", F.lit(2)).alias("x1"))
    return W.adjacent_gap(b, ["line_id"], ["place"], "x0", "x1").select("line_id", "place", "gap")


@R.add(
    "tokens_in_order",
    """
    WITH b AS (SELECT line_id, unnest(token_bboxes)[1] AS x, unnest(range(len(token_bboxes))) AS k FROM line_record WHERE token_bboxes IS NOT NULL),
    l AS (SELECT line_id, x, x >= lag(x) OVER (PARTITION BY line_id ORDER BY k) AS ok FROM b)
    SELECT line_id, CASE WHEN count(*) FILTER (WHERE x IS NULL) > 0 THEN NULL ELSE coalesce(bool_and(ok), true) END AS ordered FROM l GROUP BY line_id
    """,
)
def tokens_in_order(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "line_record").select("line_id", F.posexplode("token_bboxes").alias("place", "t")).select("line_id", "place", F.get("t", F.lit(0)).alias("x"))
    return W.nondecreasing(b, ["line_id"], ["place"], "x")


@R.add(
    "longest_first",
    "SELECT category, line_id, n FROM (SELECT category, line_id, length(ground_truth) AS n, row_number() OVER (PARTITION BY category ORDER BY length(ground_truth) DESC, line_id) AS k FROM line_record WHERE ground_truth IS NOT NULL) WHERE k = 1",
)
def longest_first(spark: SparkSession, sf: str) -> DataFrame:
    """The longest line of each category, the first on ties."""
    d = table(spark, sf, "line_record").filter("ground_truth IS NOT NULL").select("category", "line_id", F.length("ground_truth").cast("long").alias("n"))
    return A.best_by(d, ["category"], F.col("n"), [-F.col("line_id")]).select("category", "best.line_id", "best.n")


@R.add(
    "most_lines_per_source",
    "SELECT category, max(c) AS most FROM (SELECT category, source_image, count(*) AS c FROM line_record GROUP BY 1, 2) GROUP BY category",
)
def most_lines_per_source(spark: SparkSession, sf: str) -> DataFrame:
    return A.most_per_group(table(spark, sf, "line_record"), ["category", "source_image"], ["category"])


_ORDER_SQL = "CASE WHEN recommended_sentence_candidate THEN 0 ELSE 1 END, CASE WHEN automatic_sentence_candidate THEN 0 ELSE 1 END, sentence_score DESC NULLS LAST, bbox_count DESC NULLS LAST, identifier ASC NULLS LAST, line_index ASC NULLS LAST, line_id"


@R.add("preview_ranking", f"SELECT category, rank, line_id FROM (SELECT category, line_id, row_number() OVER (PARTITION BY category ORDER BY {_ORDER_SQL}) AS rank FROM line_record) WHERE rank <= 10")
def preview_ranking(spark: SparkSession, sf: str) -> DataFrame:
    order = [
        F.when(F.col("recommended_sentence_candidate"), 0).otherwise(1), F.when(F.col("automatic_sentence_candidate"), 0).otherwise(1), F.col("sentence_score").desc_nulls_last(), F.col("bbox_count").desc_nulls_last(),
        F.col("identifier").asc_nulls_last(), F.col("line_index").asc_nulls_last(), F.col("line_id"),
    ]
    return W.first_k(table(spark, sf, "line_record"), ["category"], order, 10).select("category", "rank", "line_id")


_QUOTAS = "SELECT g, 100 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY g) <= 100 % count(*) OVER () THEN 1 ELSE 0 END AS quota FROM (SELECT DISTINCT category AS g FROM d)"


@R.add(
    "preview_mixed",
    f"""
    WITH RECURSIVE d AS (SELECT * FROM line_record WHERE bbox_count >= 3 AND length({S.bare('ground_truth')}) >= 10 AND hangul_ratio >= 0.6 AND digit_ratio <= 0.2 AND category IS NOT NULL), q AS ({_QUOTAS}),
    a AS (SELECT category AS g, line_id AS id, identifier AS s, 0 AS how, row_number() OVER (ORDER BY CASE WHEN recommended_sentence_candidate THEN 0 ELSE 1 END, CASE WHEN automatic_sentence_candidate THEN 0 ELSE 1 END, sentence_score DESC NULLS LAST, bbox_count DESC, identifier, line_index NULLS FIRST, line_id) AS place FROM d WHERE identifier IS NOT NULL
      UNION ALL SELECT category, line_id, identifier, 1, row_number() OVER (ORDER BY {S.key('preview', 'line_id')}, line_id) FROM d WHERE identifier IS NOT NULL),
    o AS (SELECT *, CASE how WHEN 0 THEN quota // 2 ELSE quota END AS most, row_number() OVER (ORDER BY g, how, place) AS k FROM a JOIN q USING (g)),
    p(k, id, g, how, taken, used, cats) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER), false, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
      UNION ALL SELECT k, id, g, how, ok, CASE WHEN ok THEN list_append(used, s) ELSE used END, CASE WHEN ok THEN list_append(cats, g) ELSE cats END
      FROM (SELECT o.k, o.id, o.g, o.how, o.s, used, cats, NOT list_contains(used, o.s) AND len(list_filter(cats, lambda c: c = o.g)) < most AS ok FROM p JOIN o ON o.k = p.k + 1))
    SELECT id, g AS category, CASE how WHEN 0 THEN 'rank' ELSE 'random' END AS chosen_by FROM p WHERE taken
    """,
)
def preview_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Structural lines for a preview: half by rank, half by hash order, every page at most once."""
    d = table(spark, sf, "line_record")
    d = d.filter((F.col("bbox_count") >= 3) & (X.nonspace_length("ground_truth") >= 10) & (F.col("hangul_ratio") >= 0.6) & (F.col("digit_ratio") <= 0.2) & F.col("category").isNotNull())
    names = sorted(r["category"] for r in d.select("category").distinct().collect())  # a row per category
    flag = lambda c: F.when(F.col(c), 0).otherwise(1)
    rank = [flag("recommended_sentence_candidate"), flag("automatic_sentence_candidate"), F.col("sentence_score").desc_nulls_last(), F.col("bbox_count").desc(), F.col("identifier"), F.col("line_index")]
    return Q.ranked_and_random(d, "line_id", "category", "identifier", rank, Q.even_quota(names, 100) if names else {}, "preview", strict=False)


@R.add(
    "training_pick",
    f"""
    WITH RECURSIVE d AS (SELECT line_id AS id, identifier AS s, ground_truth AS t, line_index AS i, {S.key('training', 'line_id')} AS h FROM line_record WHERE identifier IS NOT NULL AND ground_truth IS NOT NULL), f AS (SELECT t, count(*) AS n FROM d GROUP BY t),
    g AS (SELECT s, list({{'id': id, 't': t}} ORDER BY h, id) AS c, list({{'id': id, 't': t, 'n': n, 'i': i, 'h': h}}) AS all_, min(n) AS rare FROM d JOIN f USING (t) GROUP BY s), o AS (SELECT *, row_number() OVER (ORDER BY {S.key('training:source', 's')}) AS k FROM g),
    p(k, s, id, used) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), (SELECT list(DISTINCT ground_truth) FROM benchmark_manifest WHERE ground_truth IS NOT NULL)
      UNION ALL SELECT k, s, z.id, CASE WHEN z IS NULL THEN used ELSE list_append(used, z.t) END FROM (SELECT o.k, o.s, used, list_filter(o.c, lambda z: NOT list_contains(used, z.t))[1] AS z FROM p JOIN o ON o.k = p.k + 1)),
    w AS (SELECT o.s, all_, row_number() OVER (ORDER BY rare, {S.key('training:fallback', 'o.s')}) AS k FROM o JOIN p ON p.s = o.s WHERE p.id IS NULL),
    v(k, id, used) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), (SELECT arg_max(used, k) FROM p)
      UNION ALL SELECT k, z.id, list_append(used, z.t) FROM (SELECT w.k, used, list_sort(list_transform(w.all_, lambda x: {{'n': x.n, 'u': list_contains(used, x.t), 'i': x.i, 'h': x.h, 'id': x.id, 't': x.t}}))[1] AS z FROM v JOIN w ON w.k = v.k + 1))
    SELECT id, false AS fallback FROM p WHERE id IS NOT NULL UNION ALL SELECT id, true FROM v WHERE id IS NOT NULL
    """,
)
def training_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Lines for training, one a page, of texts the benchmark does not have as long as there are such."""
    return Q.select_training(table(spark, sf, "line_record"), "line_id", "identifier", "ground_truth", "line_index", 300, table(spark, sf, "benchmark_manifest"), "ground_truth", "training", strict=False)


@R.add(
    "category_pick",
    f"""
    WITH RECURSIVE d AS (SELECT line_id AS id, category, identifier AS s, ground_truth AS t, {S.key('crops', 'line_id')} AS h FROM line_record WHERE category IS NOT NULL), q AS ({_QUOTAS}),
    c AS (SELECT category AS g, s, list({{'id': id, 't': t}} ORDER BY h, id) AS c FROM d WHERE s IS NOT NULL AND t IS NOT NULL GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY g, sha256('crops:' || g || ':' || s)) AS k FROM c JOIN q USING (g)),
    p(k, g, id, sources, texts, cats) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
      UNION ALL SELECT k, g, z.id, CASE WHEN z IS NULL THEN sources ELSE list_append(sources, s) END, CASE WHEN z IS NULL THEN texts ELSE list_append(texts, z.t) END, CASE WHEN z IS NULL THEN cats ELSE list_append(cats, g) END
      FROM (SELECT o.k, o.g, o.s, sources, texts, cats, CASE WHEN NOT list_contains(sources, o.s) AND len(list_filter(cats, lambda x: x = o.g)) < quota THEN list_filter(o.c, lambda z: NOT list_contains(texts, z.t))[1] END AS z FROM p JOIN o ON o.k = p.k + 1))
    SELECT id, g AS category FROM p WHERE id IS NOT NULL
    """,
)
def category_pick(spark: SparkSession, sf: str) -> DataFrame:
    """An even number of lines of each category; no page and no text twice."""
    d = table(spark, sf, "line_record").filter("category IS NOT NULL")
    names = sorted(r["category"] for r in d.select("category").distinct().collect())  # a row per category
    return Q.quota_unique(d, "line_id", "category", "identifier", "ground_truth", Q.even_quota(names, 100) if names else {}, "crops", strict=False)


@R.add(
    "category_stats",
    """
    SELECT category, count(*) AS lines, count(*) FILTER (WHERE bbox_count >= 2) AS multi_box, count(*) FILTER (WHERE bbox_id_order_matches_x_order) AS monotone, count(*) FILTER (WHERE recommended_sentence_candidate) AS recommended,
      median(character_length) AS median_length, max(character_length) AS longest, count(DISTINCT ground_truth) AS texts, count(ground_truth) - count(DISTINCT ground_truth) AS repeats, bool_and(sentence_punctuation) AS all_punctuated FROM line_record GROUP BY category
    """,
)
def category_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "line_record").groupBy("category").agg(
        F.count("*").alias("lines"), F.count_if(F.col("bbox_count") >= 2).alias("multi_box"), F.count_if("bbox_id_order_matches_x_order").alias("monotone"), F.count_if("recommended_sentence_candidate").alias("recommended"),
        F.median("character_length").alias("median_length"), F.max("character_length").alias("longest"), F.count_distinct("ground_truth").alias("texts"),
        (F.count("ground_truth") - F.count_distinct("ground_truth")).alias("repeats"), F.bool_and("sentence_punctuation").alias("all_punctuated"),
    )


@R.add(
    "numbered_lines",
    "SELECT line_id, lpad(CAST(row_number() OVER (ORDER BY line_id) AS VARCHAR), 6, '0') AS id FROM line_record",
)
def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    return W.numbered(table(spark, sf, "line_record").select("line_id"), ["line_id"])


@R.add(
    "path_parts",
    r"""
    SELECT line_id, regexp_extract(image_path, '([^/\\]+?)(\.[^./\\]*)?$', 1) AS stem, lower(regexp_extract(image_path, '(\.[^./\\]+)$', 1)) AS suffix, coalesce(nullif(regexp_extract(json_path, '/([^/]+/[^/]+)/[^/]+$', 1), ''), '<UNKNOWN>') AS category FROM line_record
    """,
)
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    c = F.coalesce(F.nullif(F.regexp_extract("json_path", "/([^/]+/[^/]+)/[^/]+$", 1), F.lit("")), F.lit("<UNKNOWN>"))
    return table(spark, sf, "line_record").select("line_id", D.stem(F.col("image_path")).alias("stem"), D.suffix(F.col("image_path")).alias("suffix"), c.alias("category"))


@R.add(
    "quality_score",
    """
    SELECT line_id, 10 * CASE WHEN automatic_sentence_candidate THEN 1 ELSE 0 END + 3 * least(coalesce(bbox_count, 0), 8) + 2 * least(coalesce(predicate_ending_count, 0), 2) + least(coalesce(grammatical_ending_count, 0), 4) + coalesce(sentence_score, 0) AS quality FROM line_record
    """,
)
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    q = 10 * F.when(F.col("automatic_sentence_candidate"), 1).otherwise(0) + 3 * F.least(z("bbox_count"), F.lit(8)) + 2 * F.least(z("predicate_ending_count"), F.lit(2)) + F.least(z("grammatical_ending_count"), F.lit(4)) + z("sentence_score")
    return table(spark, sf, "line_record").select("line_id", q.alias("quality"))


@R.add(
    "repetition_rounds",
    f"SELECT line_id, CAST(round AS INTEGER) AS round FROM (SELECT line_id, row_number() OVER (PARTITION BY ground_truth ORDER BY coalesce(sentence_score, 0) DESC, {S.key('42', 'line_id')}) AS round FROM line_record WHERE ground_truth IS NOT NULL) WHERE round <= 8",
)
def repetition_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The how-manieth use of its text each line would be, up to the eighth, which is the most that a pick allows."""
    d = table(spark, sf, "line_record").filter("ground_truth IS NOT NULL").select("line_id", "ground_truth", F.coalesce("sentence_score", F.lit(0)).alias("score"))
    return d.withColumn("round", W.repetition_round("ground_truth", "score", Q.stable_key("42", "line_id"))).filter("round <= 8").select("line_id", "round")


@R.add("texts_in_order", "SELECT ground_truth AS value, min(line_id) AS first FROM line_record WHERE ground_truth IS NOT NULL GROUP BY ground_truth")
def texts_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Different texts by where each is seen first."""
    return A.first_seen(table(spark, sf, "line_record"), "ground_truth", "line_id")


@R.add(
    "same_lines",
    "WITH a AS (SELECT identifier, line_index, ground_truth FROM line_record), b AS (SELECT identifier, line_index, ground_truth FROM line_record WHERE bbox_count >= 2) SELECT 'same_rows' AS \"check\", count(*) AS failures FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a))",
)
def same_lines(spark: SparkSession, sf: str) -> DataFrame:
    """How many lines, with their repeats, only one of two sets has."""
    d = table(spark, sf, "line_record")
    rows = lambda x: x.select("identifier", "line_index", "ground_truth")
    return K.same_rows(rows(d), rows(d.filter("bbox_count >= 2")))


@R.add(
    "displayed",
    "SELECT page_id, coalesce(images.identifier, '<MISSING>') AS identifier, coalesce(CAST(images.width AS VARCHAR), '<MISSING>') AS width, coalesce(CAST(len(bbox) AS VARCHAR), '<MISSING>') AS n_boxes FROM label_page",
)
def displayed(spark: SparkSession, sf: str) -> DataFrame:
    """Values as a report shows them."""
    n = F.when(F.col("bbox").isNotNull(), F.size("bbox"))
    return table(spark, sf, "label_page").select("page_id", B.display_value("images.identifier").alias("identifier"), B.display_value("images.width").alias("width"), B.display_value(n).alias("n_boxes"))
