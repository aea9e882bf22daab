"""Queries that score predictions and report on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.functions import metrics as M
from quillflow.functions import text as X
from quillflow.operators import matching as J
from quillflow.operators import summaries as A
from quillflow.operators import windows as W
from quillflow.plans import sqltext as S
from quillflow.plans.registry import Registry
from quillflow.session import table
from quillflow.streaming.scoring import score as scored

R = Registry()
CLASSES = ["error_preserved", "over_corrected", "recognition_error"]
STRICT = "CASE WHEN {p} = {g} THEN 'error_preserved' WHEN {p} = {k} THEN 'over_corrected' ELSE 'recognition_error' END"


@R.add(
    "answer_summary",
    f"""
    WITH d AS (SELECT model_name, ground_truth, prediction, coalesce(ground_truth, '') AS t1, coalesce(prediction, '') AS t2 FROM ocr_prediction),
    u AS (SELECT DISTINCT t1, t2 FROM d), l AS (SELECT t1, t2, CASE WHEN t1 = t2 THEN 0 ELSE {S.lev('t1', 't2')} END AS dist FROM u)
    SELECT model_name, count(*) AS n, CAST(sum(dist) AS BIGINT) AS distance, CAST(sum(length(t1)) AS BIGINT) AS characters, CAST(sum(dist) AS DOUBLE) / greatest(1, sum(length(t1))) AS corpus_cer,
      count(*) FILTER (WHERE ground_truth = prediction) AS exact, CAST(count(*) FILTER (WHERE ground_truth = prediction) AS DOUBLE) / count(*) AS exact_rate
    FROM d JOIN l USING (t1, t2) GROUP BY model_name
    """,
)
def answer_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = A.answer_summary(table(spark, sf, "ocr_prediction"), ["model_name"], "ground_truth", "prediction")
    return s.select("model_name", "n", F.col("distance").cast("long").alias("distance"), "characters", "corpus_cer", "exact", "exact_rate")


@R.add(
    "model_totals",
    """
    WITH d AS (SELECT model_name, coalesce(b.source, '<NONE>') AS track, length(coalesce(p.ground_truth, '')) AS c, coalesce(p.exact_match, false) AS e FROM ocr_prediction p LEFT JOIN (SELECT DISTINCT id, source FROM benchmark_manifest) b USING (id))
    SELECT model_name, track, count(*) AS n, CAST(sum(c) AS BIGINT) AS characters, count(*) FILTER (WHERE e) AS exact FROM d GROUP BY GROUPING SETS ((model_name, track), (model_name))
    """,
)
def model_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Per track and combined in one pass."""
    b = table(spark, sf, "benchmark_manifest").select("id", "source").distinct()
    d = table(spark, sf, "ocr_prediction").join(b, "id", "left").withColumn("track", F.coalesce("source", F.lit("<NONE>")))
    n = F.length(F.coalesce("ground_truth", F.lit("")))
    return A.with_totals(d, ["model_name", "track"], [["model_name", "track"], ["model_name"]], F.count("*").alias("n"), F.sum(n).alias("characters"), F.count_if(F.coalesce("exact_match", F.lit(False))).alias("exact"))


@R.add(
    "punctuation_insensitive",
    f"""
    WITH d AS (SELECT model_name, {S.canon('ground_truth')} AS g, {S.canon('prediction')} AS p, {S.nopunct('ground_truth')} AS gn, {S.nopunct('prediction')} AS pn FROM ocr_prediction)
    SELECT model_name, count(*) AS n, count(*) FILTER (WHERE g = p) AS exact_canonical, count(*) FILTER (WHERE gn = pn) AS exact_without_punctuation, count(*) FILTER (WHERE gn = pn AND g <> p) AS punctuation_only,
      CAST(sum(length(gn)) AS BIGINT) AS characters FROM d GROUP BY model_name
    """,
)
def punctuation_insensitive(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "ocr_prediction").select(
        "model_name", X.canonical("ground_truth").alias("g"), X.canonical("prediction").alias("p"), X.punctuation_insensitive("ground_truth").alias("gn"), X.punctuation_insensitive("prediction").alias("pn")
    )
    return d.groupBy("model_name").agg(
        F.count("*").alias("n"), F.count_if(F.col("g") == F.col("p")).alias("exact_canonical"), F.count_if(F.col("gn") == F.col("pn")).alias("exact_without_punctuation"),
        F.count_if((F.col("gn") == F.col("pn")) & (F.col("g") != F.col("p"))).alias("punctuation_only"), F.sum(F.length("gn")).alias("characters"),
    )


def _strict(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "strict_error_prediction")
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    kind = F.when(c("prediction") == c("ground_truth"), CLASSES[0]).when(c("prediction") == c("corrected_text"), CLASSES[1]).otherwise(CLASSES[2])
    return t.withColumn("class", kind)


_STRICT_SQL = "SELECT *, " + STRICT.format(p="coalesce(prediction, '')", g="coalesce(ground_truth, '')", k="coalesce(corrected_text, '')") + " AS class FROM strict_error_prediction"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE class = '{c}') AS {c}" for c in CLASSES)


@R.add("strict_classes", f"WITH d AS ({_STRICT_SQL}) SELECT model_name, count(*) AS n, {_COUNTS}, " + ", ".join(f"CAST(count(*) FILTER (WHERE class = '{c}') AS DOUBLE) / count(*) AS {c}_rate" for c in CLASSES) + " FROM d GROUP BY model_name")
def strict_classes(spark: SparkSession, sf: str) -> DataFrame:
    return A.class_summary(_strict(spark, sf), ["model_name"], CLASSES, "class")


@R.add("label_breakdown", f"WITH d AS ({_STRICT_SQL}), e AS (SELECT class, unnest(list_distinct(error_type)) AS label FROM d) SELECT label, count(*) AS n, {_COUNTS} FROM e WHERE label IS NOT NULL GROUP BY label")
def label_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return A.label_breakdown(_strict(spark, sf), "error_type", "class", CLASSES).filter("label IS NOT NULL")


@R.add("class_examples", f"WITH d AS ({_STRICT_SQL}), r AS (SELECT class, pred_id, row_number() OVER (PARTITION BY class ORDER BY pred_id) AS rank FROM d) SELECT class, rank, pred_id FROM r WHERE rank <= 20")
def class_examples(spark: SparkSession, sf: str) -> DataFrame:
    return W.first_k(_strict(spark, sf).select("class", "pred_id"), ["class"], ["pred_id"], 20).select("class", "rank", "pred_id")


_DISTANCES = f"""
    WITH t AS (SELECT pred_id, coalesce(ground_truth, '') AS g, coalesce(corrected_text, '') AS k, coalesce(prediction, '') AS t2 FROM strict_error_prediction),
    u AS (SELECT DISTINCT g AS t1, t2 FROM t UNION SELECT DISTINCT k, t2 FROM t), l AS {S.distances('u')}
"""


@R.add(
    "strict_scores",
    _DISTANCES
    + f"""
    SELECT pred_id, t.t2 = g AS error_preserved, t.t2 = k AS over_corrected, t.t2 <> g AND t.t2 <> k AS recognition_error, {STRICT.format(p='t.t2', g='g', k='k')} AS classification, a.d AS distance_to_ground_truth, b.d AS distance_to_corrected,
      CAST(a.d AS DOUBLE) / greatest(1, length(g)) AS cer, CASE WHEN a.d < b.d THEN 'ground_truth' WHEN b.d < a.d THEN 'corrected' ELSE 'tie' END AS closer_to
    FROM t JOIN l a ON a.t1 = g AND a.t2 = t.t2 JOIN l b ON b.t1 = k AND b.t2 = t.t2
    """,
)
def strict_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Distances, class and nearer text of every answer."""
    t = table(spark, sf, "strict_error_prediction")
    return t.select("pred_id", M.strict_score("ground_truth", "corrected_text", "prediction").alias("s")).select("pred_id", "s.*")


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "strict_error_prediction").filter("ground_truth IS NOT NULL AND corrected_text IS NOT NULL").select(
        "pred_id", "model_name", X.punctuation_insensitive("ground_truth").alias("g"), X.punctuation_insensitive("corrected_text").alias("k"), X.punctuation_insensitive(X.clean_prediction("raw_prediction")).alias("p")
    )
    t = t.filter("g <> k")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # aligning costs much more than its bytes say, so they must not set the number
    pairs = t.select("g", "k").repartition(parts, "g", "k").distinct().withColumn("spans", M.correction_spans("g", "k"))  # each different pair once
    t = t.join(pairs, ["g", "k"]).withColumn("scored", M.score_spans("spans", "g", "p"))
    return t.withColumn("class", M.sample_class("scored", "g", "p"))


@R.add(
    "error_flags",
    f"""
    WITH t AS (SELECT pred_id, {S.nopunct('ground_truth')} AS g, {S.nopunct('corrected_text')} AS k, {S.nopunct('prediction')} AS t2, {S.canon('ground_truth')} AS cg, {S.canon('prediction')} AS cp FROM strict_error_prediction WHERE ground_truth IS NOT NULL AND corrected_text IS NOT NULL),
    c AS (SELECT * FROM t WHERE g <> k), u AS (SELECT DISTINCT g AS t1, t2 FROM c UNION SELECT DISTINCT k, t2 FROM c), l AS {S.distances('u')}
    SELECT pred_id, a.d AS distance_to_ground_truth, b.d AS distance_to_corrected, CAST(a.d AS DOUBLE) / greatest(1, length(g)) AS cer, c.t2 = k AS exact_corrected_match, c.t2 = g AND cp <> cg AS punctuation_only_difference
    FROM c JOIN l a ON a.t1 = g AND a.t2 = c.t2 JOIN l b ON b.t1 = k AND b.t2 = c.t2
    """,
)
def error_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Distances and flags of each answer whose texts differ by more than punctuation."""
    t = table(spark, sf, "strict_error_prediction").filter("ground_truth IS NOT NULL AND corrected_text IS NOT NULL")
    t = t.filter(X.punctuation_insensitive("ground_truth") != X.punctuation_insensitive("corrected_text"))
    return t.select("pred_id", M.error_flags("ground_truth", "corrected_text", "prediction").alias("f")).select("pred_id", "f.*")


@R.add("clean_answers", f"SELECT pred_id, {S.clean_answer('raw_prediction')} AS answer FROM strict_error_prediction")
def clean_answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "strict_error_prediction").select("pred_id", X.clean_prediction("raw_prediction").alias("answer"))


@R.add("span_outcomes")
def span_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Per model: spans by outcome, and rows by class."""
    entry = lambda level, outcome: F.struct(F.lit(level).alias("level"), outcome.alias("outcome"))
    both = F.concat(F.transform("scored", lambda s: entry("span", s["outcome"])), F.array(entry("sample", F.col("class"))))
    d = _spans(spark, sf).select("model_name", F.explode(both).alias("e"))
    return d.groupBy("model_name", "e.level", "e.outcome").agg(F.count("*").alias("n"))


@R.add("span_rows")
def span_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per differing span of each answer's texts."""
    return _spans(spark, sf).select("pred_id", "class", F.posexplode("scored").alias("place", "s")).select("pred_id", "class", "place", "s.*")


@R.add(
    "best_setting",
    f"""
    WITH d AS ({_STRICT_SQL}), g AS (SELECT model_name, count(*) AS n, CAST(count(*) FILTER (WHERE class = 'over_corrected') AS DOUBLE) / count(*) AS oc, CAST(count(*) FILTER (WHERE class = 'error_preserved') AS DOUBLE) / count(*) AS ep,
      CAST(count(*) FILTER (WHERE exact_match) AS DOUBLE) / count(*) AS np FROM d WHERE model_name IS NOT NULL GROUP BY model_name)
    SELECT model_name, n, oc AS over_corrected_rate, ep AS error_preserved_rate, 0.0::DOUBLE + oc + (1 - ep) + (1 - np) AS score FROM g ORDER BY score, over_corrected_rate, model_name LIMIT 1
    """,
)
def best_setting(spark: SparkSession, sf: str) -> DataFrame:
    d = _strict(spark, sf).filter("model_name IS NOT NULL").groupBy("model_name").agg(
        F.count("*").alias("n"), (F.count_if(F.col("class") == "over_corrected") / F.count("*")).alias("over_corrected_rate"), (F.count_if(F.col("class") == "error_preserved") / F.count("*")).alias("error_preserved_rate"),
        (F.count_if("exact_match") / F.count("*")).alias("np"),
    )
    d = d.withColumn("score", M.tradeoff(F.lit(0.0), F.col("over_corrected_rate"), F.col("error_preserved_rate"), F.col("np"))).drop("np")
    return A.best_setting(d, "model_name", "score", "over_corrected_rate")


@R.add(
    "models_side_by_side",
    """
    WITH d AS (SELECT id, model_name, count(*) AS n FROM ocr_prediction WHERE id IS NOT NULL GROUP BY id, model_name)
    SELECT id, max(n) FILTER (WHERE model_name = m1) AS first_model, max(n) FILTER (WHERE model_name = m2) AS second_model FROM d, (SELECT min(model_name) AS m1, max(model_name) AS m2 FROM ocr_prediction) GROUP BY id
    """,
)
def models_side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "ocr_prediction").filter("id IS NOT NULL")
    ends = t.agg(F.min("model_name").alias("a"), F.max("model_name").alias("b")).first()
    d = t.groupBy("id", "model_name").agg(F.count("*").alias("n"))
    return J.side_by_side(d, "id", "model_name", "n", [ends["a"], ends["b"]]).select("id", F.col(ends["a"]).alias("first_model"), F.col(ends["b"]).alias("second_model"))


@R.add(
    "resume_state",
    """
    WITH m AS (SELECT id, row_number() OVER (ORDER BY id) AS place FROM benchmark_manifest), d AS (SELECT id, row_number() OVER (ORDER BY id) AS place FROM (SELECT DISTINCT id FROM ocr_prediction WHERE id IN (SELECT id FROM benchmark_manifest)))
    SELECT count(*) AS done, count(*) FILTER (WHERE d.id IS DISTINCT FROM m.id) AS out_of_place FROM d LEFT JOIN m USING (place)
    """,
)
def resume_state(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the answers at hand are the first of the manifest, in order."""
    m = table(spark, sf, "benchmark_manifest").select("id")
    d = table(spark, sf, "ocr_prediction").select("id").distinct().join(m, "id", "left_semi")
    place = lambda x: W.numbered(x, ["id"], "place", 12).withColumn("place", F.col("place").cast("long"))
    return J.is_prefix(place(d), place(m), "place", "id")


@R.add(
    "running_exposure",
    """
    SELECT row_id, source_split, count(*) OVER w AS seen, CAST(sum(CASE WHEN pool_kind = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS flagged,
      CAST(sum(CASE WHEN pool_kind = 'error' THEN 1 ELSE 0 END) OVER w AS DOUBLE) / count(*) OVER w AS ratio
    FROM training_manifest WINDOW w AS (PARTITION BY source_split ORDER BY row_id ROWS UNBOUNDED PRECEDING)
    """,
)
def running_exposure(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "training_manifest").select("row_id", "source_split", "pool_kind")
    return W.running_ratio(t, ["source_split"], ["row_id"], F.col("pool_kind") == "error").drop("pool_kind")


@R.add(
    "chat_turns",
    """
    WITH t AS (SELECT pred_id, unnest([{'k': 1, 'role': 'user', 'content': prompt}, {'k': 2, 'role': 'assistant', 'content': raw_prediction}]) AS m FROM strict_error_prediction)
    SELECT pred_id, CAST(m.k AS INTEGER) AS turn, m.role AS role, m.content AS content FROM t WHERE m.content IS NOT NULL
    """,
)
def chat_turns(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "strict_error_prediction").select("pred_id", F.posexplode(M.chat(("user", F.col("prompt")), ("assistant", F.col("raw_prediction")))).alias("turn", "m"))
    return t.select("pred_id", (F.col("turn") + 1).alias("turn"), "m.role", "m.content").filter("content IS NOT NULL")


@R.add(
    "error_histogram",
    """
    WITH e AS (SELECT unnest(error_details) AS d FROM benchmark_manifest WHERE error_details IS NOT NULL), f AS (SELECT unnest([{'field': 'error_category', 'value': d.error_category}, {'field': 'error_level', 'value': d.error_level},
      {'field': 'error_area', 'value': d.error_area}, {'field': 'rule_family', 'value': split_part(d.rule_id, '.', 1)}]) AS x FROM e)
    SELECT x.field AS field, coalesce(x.value, '<MISSING>') AS value, count(*) AS n FROM f GROUP BY 1, 2
    """,
)
def error_histogram(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "benchmark_manifest").select(F.explode("error_details").alias("d")).select("d.*")
    fields = [("error_category", F.col("error_category")), ("error_level", F.col("error_level")), ("error_area", F.col("error_area")), ("rule_family", F.split_part("rule_id", F.lit("."), F.lit(1)))]
    return A.field_distributions(e, fields)


@R.add(
    "timing",
    "SELECT model_name, count(inference_time) AS n, min(inference_time) AS least, median(inference_time) AS median, max(inference_time) AS most FROM ocr_prediction GROUP BY model_name",
)
def timing(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "ocr_prediction")
    return t.groupBy("model_name").agg(F.count("inference_time").alias("n"), F.min("inference_time").alias("least"), F.median("inference_time").alias("median"), F.max("inference_time").alias("most"))


@R.add(
    "ocr_scores",
    f"""
    WITH a AS (SELECT pred_id, coalesce(ground_truth, '') AS t1, coalesce(prediction, '') AS t2, coalesce(ground_truth = prediction, false) AS exact_match FROM ocr_prediction), u AS (SELECT DISTINCT t1, t2 FROM a), l AS {S.distances('u')}
    SELECT pred_id, d AS distance, CAST(d AS DOUBLE) / greatest(1, length(t1)) AS cer, exact_match FROM a JOIN l USING (t1, t2)
    """,
)
def ocr_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Distance, CER and match of every answer, by the scorer of the stream."""
    return scored(table(spark, sf, "ocr_prediction").select("pred_id", "ground_truth", "prediction")).select("pred_id", "distance", "cer", "exact_match")


@R.add(
    "aligned_places",
    """
    WITH m AS (SELECT id, row_number() OVER (ORDER BY id) AS place FROM benchmark_manifest), r AS (SELECT id AS other, row_number() OVER (ORDER BY id) AS place FROM (SELECT DISTINCT id FROM ocr_prediction WHERE id IS NOT NULL))
    SELECT place, id, other, id IS NOT DISTINCT FROM other AS same FROM m FULL JOIN r USING (place)
    """,
)
def aligned_places(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest and results side by side, place by place."""
    place = lambda x: W.numbered(x, ["id"], "place", 12).withColumn("place", F.col("place").cast("long"))
    return J.aligned(place(table(spark, sf, "benchmark_manifest").select("id")), place(table(spark, sf, "ocr_prediction").select("id").filter("id IS NOT NULL").distinct()), "place", "id")


@R.add(
    "model_deltas",
    f"""
    WITH d AS ({_STRICT_SQL}), g AS (SELECT model_name, count(*) FILTER (WHERE class = 'over_corrected') / CAST(count(*) AS DOUBLE) AS oc, count(*) FILTER (WHERE class = 'error_preserved') / CAST(count(*) AS DOUBLE) AS ep FROM d WHERE model_name IS NOT NULL GROUP BY model_name)
    SELECT g.model_name, g.oc - b.oc AS over_corrected_rate_delta, g.ep - b.ep AS error_preserved_rate_delta FROM g, (SELECT * FROM g ORDER BY model_name LIMIT 1) b
    """,
)
def model_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Each model's rates less those of the first by name."""
    g = A.class_summary(_strict(spark, sf).filter("model_name IS NOT NULL"), ["model_name"], CLASSES, "class")
    first = g.agg(F.min("model_name")).first()[0]
    return A.compare_to(g, "model_name", first, ["over_corrected_rate", "error_preserved_rate"])


@R.add(
    "merged_counts",
    f"""
    WITH d AS ({_STRICT_SQL}), a AS (SELECT coalesce(model_name, '<MISSING>') AS k, count(*) AS n FROM d GROUP BY 1), b AS (SELECT coalesce(model_name, '<MISSING>') AS k, count(*) AS n FROM ocr_prediction GROUP BY 1)
    SELECT k AS model_name, CAST(coalesce(a.n, 0) + coalesce(b.n, 0) AS BIGINT) AS added, coalesce(b.n, a.n) AS last FROM a FULL JOIN b USING (k)
    """,
)
def merged_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Answers per model of both tables, merged as counters and as maps in which the second wins."""
    counts = lambda t: table(spark, sf, t).groupBy(F.coalesce("model_name", F.lit("<MISSING>")).alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias(t))
    a, b = "strict_error_prediction", "ocr_prediction"
    one = counts(a).join(F.broadcast(counts(b)))  # a row each
    one = one.select(A.merged(a, b, add=True).alias("added"), A.merged(a, b).alias("last"))
    return one.select(F.explode("added").alias("model_name", "added"), "last").select("model_name", "added", F.col("last")[F.col("model_name")].alias("last"))
