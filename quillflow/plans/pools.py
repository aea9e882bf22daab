"""Queries that build and audit leak-free pools from the manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.functions import text as X
from quillflow.operators import checks as K
from quillflow.operators import leakage as L
from quillflow.operators import matching as J
from quillflow.operators import rules as U
from quillflow.operators import sampling as Q
from quillflow.operators import summaries as A
from quillflow.plans import sqltext as S
from quillflow.plans.registry import Registry
from quillflow.session import table

R = Registry()

# --- keys of the three tables, by family ---------------------------------------------------------------------------------
POOL = {"path": ["image"], "identifier": ["sid", "source_sid", "record_id"], "text": ["text", "text_src", "rendered_text", "reference_text"]}
TRAIN = {"path": ["image_path"], "identifier": ["id", "source_sid", "record_id"], "text": ["target", "corrected_text", "text_src"], "hash": ["image_sha256"]}
BENCH = {"path": ["image_path"], "identifier": ["source_sid", "record_id"], "text": ["ground_truth", "corrected_text"], "hash": ["image_sha256"]}


def _families(fields: dict[str, list[str]], only: tuple[str, ...] | None = None) -> dict[str, list[Column]]:
    return {f: [X.canonical(c) if f == "text" else F.col(c) for c in cols] for f, cols in fields.items() if only is None or f in only}


def _keys_sql(name: str, source: str, row: str, fields: dict[str, list[str]], only: tuple[str, ...]) -> str:
    parts = [
        f"SELECT {row} AS r, '{f}' AS family, {S.canon(c) if f == 'text' else c} AS k FROM {source}"
        for f, cols in fields.items() if f in only for c in cols
    ]
    return f"{name} AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(parts)}) WHERE k IS NOT NULL AND k <> '')"


_POOL_FAMILIES = ("path", "identifier", "text")


@R.add(
    "leak_free_accept",
    f"""
    WITH {_keys_sql('p', 'source_metadata', 'row_id', POOL, _POOL_FAMILIES)}, {_keys_sql('b', 'benchmark_manifest', 'row_id', BENCH, _POOL_FAMILIES)},
    h AS (SELECT p.r, bool_or(p.family = 'path') AS hp, bool_or(p.family = 'identifier') AS hi, bool_or(p.family = 'text') AS ht
          FROM p JOIN (SELECT DISTINCT family, k FROM b) b ON p.family = b.family AND p.k = b.k GROUP BY p.r),
    c AS (SELECT CASE WHEN {S.canon('rendered_text')} = '' THEN 'empty_text' WHEN coalesce(has_unrendered, false) THEN 'unrendered_character' WHEN coalesce(hp, false) THEN 'path_overlap'
          WHEN coalesce(hi, false) THEN 'identifier_overlap' WHEN coalesce(ht, false) THEN 'text_overlap'
          WHEN coalesce(has_error, false) AND ({S.canon('reference_text')} = '' OR {S.canon('reference_text')} = {S.canon('rendered_text')}) THEN 'invalid_error_target'
          ELSE 'accepted' END AS reason, split FROM source_metadata LEFT JOIN h ON h.r = row_id)
    SELECT split, reason, count(*) AS n FROM c GROUP BY split, reason
    """,
)
def leak_free_accept(spark: SparkSession, sf: str) -> DataFrame:
    pool, bench = table(spark, sf, "source_metadata"), table(spark, sf, "benchmark_manifest")
    d = L.with_overlap(pool, "row_id", _families(POOL), bench, _families(BENCH, _POOL_FAMILIES))
    text, ref = X.canonical("rendered_text"), X.canonical("reference_text")
    rules = [
        U.Rule("empty_text", text == ""), U.Rule("unrendered_character", F.col("has_unrendered")), U.Rule("path_overlap", F.col("path_overlap")),
        U.Rule("identifier_overlap", F.col("identifier_overlap")), U.Rule("text_overlap", F.col("text_overlap")),
        U.Rule("invalid_error_target", U.is_true("has_error") & ((ref == "") | (ref == text))),
    ]
    return U.reason_counts(U.route(d, rules), "reason", "split")


_ALL = ("path", "identifier", "text", "hash")


@R.add(
    "split_overlap_audit",
    f"""
    WITH {_keys_sql('t', 'training_manifest', 'row_id', TRAIN, _ALL)}, {_keys_sql('b', 'benchmark_manifest', 'row_id', BENCH, _ALL)},
    f AS (SELECT unnest(['path', 'identifier', 'text', 'hash']) AS family),
    tb AS (SELECT t.family, count(DISTINCT t.r) AS n FROM t JOIN (SELECT DISTINCT family, k FROM b) b USING (family, k) GROUP BY t.family),
    bt AS (SELECT b.family, count(DISTINCT b.r) AS n FROM b JOIN (SELECT DISTINCT family, k FROM t) t USING (family, k) GROUP BY b.family)
    SELECT 'train_benchmark' AS audit, f.family, coalesce(n, 0) AS rows, coalesce(n, 0) = 0 AS passed FROM f LEFT JOIN tb USING (family)
    UNION ALL SELECT 'benchmark_train', f.family, coalesce(n, 0), coalesce(n, 0) = 0 FROM f LEFT JOIN bt USING (family)
    """,
)
def split_overlap_audit(spark: SparkSession, sf: str) -> DataFrame:
    sides = {"train": (table(spark, sf, "training_manifest"), "row_id", _families(TRAIN)), "benchmark": (table(spark, sf, "benchmark_manifest"), "row_id", _families(BENCH))}
    return L.audit(sides, [("train", "benchmark"), ("benchmark", "train")])


@R.add(
    "deleak_train",
    f"""
    WITH {_keys_sql('t', 'training_manifest', 'row_id', TRAIN, _ALL)}, {_keys_sql('b', "(SELECT * FROM benchmark_manifest WHERE source_split = 'dev')", 'row_id', BENCH, _ALL)},
    h AS (SELECT t.r, bool_or(t.family = 'path') AS hp, bool_or(t.family = 'identifier') AS hi, bool_or(t.family = 'text') AS ht, bool_or(t.family = 'hash') AS hh
          FROM t JOIN (SELECT DISTINCT family, k FROM b) b USING (family, k) GROUP BY t.r)
    SELECT row_id, CASE WHEN coalesce(hp, false) THEN 'path_overlap' WHEN coalesce(hi, false) THEN 'identifier_overlap' WHEN coalesce(ht, false) THEN 'text_overlap'
      WHEN coalesce(hh, false) THEN 'hash_overlap' ELSE 'kept' END AS reason FROM training_manifest LEFT JOIN h ON h.r = row_id
    """,
)
def deleak_train(spark: SparkSession, sf: str) -> DataFrame:
    dev = table(spark, sf, "benchmark_manifest").filter("source_split = 'dev'")
    return L.remove_overlap(table(spark, sf, "training_manifest"), "row_id", _families(TRAIN), dev, _families(BENCH)).select("row_id", "reason")


@R.add(
    "training_projection",
    f"""
    SELECT row_id, sid AS id, image AS image_path, {S.canon('rendered_text')} AS target, 'rendered_text' AS target_field, CASE WHEN coalesce(has_error, false) THEN 'error' ELSE 'normal' END AS partition,
      coalesce(has_error, false) AS has_error, {S.canon('reference_text')} AS corrected_text, split AS source_split, coalesce(nullif(source_sid, ''), sid) AS source_key, sample_id, record_id, text_src, writer,
      len(coalesce(errors, [])) AS n_errors FROM source_metadata
    """,
)
def training_projection(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.coalesce("has_error", F.lit(False))
    return table(spark, sf, "source_metadata").select(
        "row_id", F.col("sid").alias("id"), F.col("image").alias("image_path"), X.canonical("rendered_text").alias("target"), F.lit("rendered_text").alias("target_field"),
        F.when(flag, "error").otherwise("normal").alias("partition"), flag.alias("has_error"), X.canonical("reference_text").alias("corrected_text"), F.col("split").alias("source_split"),
        F.coalesce(F.nullif("source_sid", F.lit("")), "sid").alias("source_key"), "sample_id", "record_id", "text_src", "writer", F.size(F.coalesce("errors", F.array())).cast("long").alias("n_errors"),
    )


@R.add(
    "benchmark_labels",
    """
    SELECT row_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(errors, []), lambda e: e.error_area), lambda a: a IS NOT NULL))), '|') AS error_types,
      coalesce(error_count, len(coalesce(errors, []))) AS error_count FROM source_metadata WHERE coalesce(has_error, false)
    """,
)
def benchmark_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted different labels of each row's annotations."""
    areas = F.filter(F.transform("errors", lambda e: e["error_area"]), lambda a: a.isNotNull())
    d = table(spark, sf, "source_metadata").filter(F.coalesce("has_error", F.lit(False)))
    return d.select("row_id", F.coalesce(F.array_join(F.array_sort(F.array_distinct(areas)), "|"), F.lit("")).alias("error_types"), F.coalesce(F.col("error_count"), F.size(F.coalesce("errors", F.array()))).cast("long").alias("error_count"))


@R.add(
    "validation_pick",
    f"""
    WITH r AS (SELECT row_id, split, coalesce(has_error, false) AS has_error, row_number() OVER (PARTITION BY coalesce(has_error, false) ORDER BY CASE WHEN split <> 'train' THEN 0 ELSE 1 END,
      CASE WHEN split <> 'train' THEN {S.key('validation:outside', 'row_id')} ELSE {S.key('validation:train', 'row_id')} END, row_id) AS rank FROM source_metadata)
    SELECT row_id, split, has_error, rank, {S.key('validation:order', 'row_id')} AS final_key FROM r WHERE rank <= 256
    """,
)
def validation_pick(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "source_metadata").select("row_id", "split", F.coalesce("has_error", F.lit(False)).alias("has_error"))
    return Q.pick_validation(d, "row_id", "has_error", F.col("split") != "train", 256, "validation")


@R.add(
    "clean_quota_pick",
    f"""
    WITH r AS (SELECT row_id, split, row_number() OVER (PARTITION BY split ORDER BY {S.key('clean', 'row_id')}, row_id) AS rank FROM source_metadata WHERE NOT coalesce(has_error, false) AND split IN ('dev', 'test'))
    SELECT * FROM r WHERE rank <= CASE split WHEN 'dev' THEN 25 ELSE 26 END
    """,
)
def clean_quota_pick(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "source_metadata").filter(~F.coalesce("has_error", F.lit(False)) & F.col("split").isin("dev", "test")).select("row_id", "split")
    return Q.take_quota(d, "row_id", "split", Q.even_quota(["dev", "test"], 51, remainder_to_first=False), "clean")


@R.add(
    "largest_remainder",
    """
    WITH c AS (SELECT coalesce(category, '<MISSING>') AS category, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS total FROM c),
    b AS (SELECT category, n, CAST(137 * n // total AS BIGINT) AS base, (137 * n) % total AS rest FROM c, t),
    k AS (SELECT *, 137 - sum(base) OVER () AS short, row_number() OVER (ORDER BY rest DESC, category) AS place FROM b)
    SELECT category, n, CAST(base + CASE WHEN place <= short THEN 1 ELSE 0 END AS BIGINT) AS quota FROM k
    """,
)
def largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").groupBy(F.coalesce("category", F.lit("<MISSING>")).alias("category")).agg(F.count("*").alias("n"))
    return Q.proportional_quotas(c, "category", "n", 137)


@R.add(
    "ratio_sample",
    """
    WITH d AS (SELECT row_id AS id, pool_kind = 'error' AS flagged FROM training_manifest), s AS (SELECT flagged, count(*) AS pool FROM d GROUP BY flagged),
    n AS (SELECT d.*, pool, CASE WHEN flagged THEN 1000 ELSE 1000 END AS need FROM d JOIN s USING (flagged)),
    e AS (SELECT *, unnest(range(0, CAST(ceil(need / pool) AS BIGINT))) AS epoch FROM n),
    p AS (SELECT *, row_number() OVER (PARTITION BY flagged, epoch ORDER BY sha256('exposure:' || epoch || ':' || id), id) AS place FROM e)
    SELECT id, flagged, CAST(epoch AS INTEGER) AS epoch, sha256('exposure:slot:' || epoch || ':' || id) AS slot_key FROM p WHERE epoch * pool + place <= need
    """,
)
def ratio_sample(spark: SparkSession, sf: str) -> DataFrame:
    return Q.ratio_sample(table(spark, sf, "training_manifest").filter("pool_kind IS NOT NULL"), "row_id", F.col("pool_kind") == "error", 2000, 0.5, "exposure")


@R.add(
    "hash_ordered_sample",
    f"SELECT * FROM (SELECT row_id, id FROM benchmark_manifest ORDER BY {S.key('preview', 'row_id')} LIMIT 100)",
)
def hash_ordered_sample(spark: SparkSession, sf: str) -> DataFrame:
    return Q.sample_in_order(table(spark, sf, "benchmark_manifest").select("row_id", "id"), "row_id", "row_id", 100, "preview")


@R.add("sorted_head", "SELECT row_id, split, sid FROM source_metadata ORDER BY split, sid, row_id LIMIT 200")
def sorted_head(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_metadata").select("row_id", "split", "sid").orderBy("split", "sid", "row_id").limit(200)


@R.add(
    "pool_lookup",
    """
    WITH s AS (SELECT sid, count(*) AS copies, max(row_id) AS last_row FROM source_metadata GROUP BY sid)
    SELECT row_id, CASE WHEN s.sid IS NULL THEN 'not_in_pool' ELSE 'found' END AS lookup, copies, last_row FROM training_manifest LEFT JOIN s ON s.sid = id
    """,
)
def pool_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each training row's pool record: found or not, its deliveries and the last of them."""
    last = table(spark, sf, "source_metadata").groupBy("sid").agg(F.count("*").alias("copies"), F.max("row_id").alias("last_row")).withColumnRenamed("sid", "id")
    return J.lookup(table(spark, sf, "training_manifest").select("row_id", "id"), last, ["id"], "not_in_pool").select("row_id", "lookup", "copies", "last_row")


@R.add(
    "last_delivery",
    "SELECT sid, row_id, split, writer FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY ingested_at DESC NULLS LAST, row_id DESC) AS k FROM source_metadata) WHERE k = 1",
)
def last_delivery(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "source_metadata").select("sid", "row_id", "split", "writer", "ingested_at")
    return J.last_wins(d, "sid", F.struct(F.col("ingested_at").isNotNull(), "ingested_at", "row_id")).select("sid", "last.row_id", "last.split", "last.writer")


@R.add(
    "unseen_first",
    f"""
    WITH s AS (SELECT DISTINCT {S.canon('target')} AS k FROM training_manifest)
    SELECT row_id, s.k IS NULL AS unseen FROM benchmark_manifest LEFT JOIN s ON s.k = {S.canon('ground_truth')}
    """,
)
def unseen_first(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "training_manifest")
    return J.prefer_unseen(table(spark, sf, "benchmark_manifest").select("row_id", X.canonical("ground_truth").alias("g")), F.col("g"), t, X.canonical("target")).select("row_id", "unseen")


@R.add(
    "set_operations",
    """
    WITH t AS (SELECT DISTINCT source_sid AS k FROM training_manifest WHERE source_sid IS NOT NULL), b AS (SELECT DISTINCT source_sid AS k FROM benchmark_manifest WHERE source_sid IS NOT NULL)
    SELECT 'both' AS part, k FROM (SELECT k FROM t INTERSECT SELECT k FROM b) UNION ALL SELECT 'train_only', k FROM (SELECT k FROM t EXCEPT SELECT k FROM b) UNION ALL SELECT 'benchmark_only', k FROM (SELECT k FROM b EXCEPT SELECT k FROM t)
    """,
)
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    t, b = (table(spark, sf, n).select(F.col("source_sid").alias("k")).filter("k IS NOT NULL").distinct() for n in ("training_manifest", "benchmark_manifest"))
    part = lambda d, n: d.select(F.lit(n).alias("part"), "k")
    return part(t.intersect(b), "both").unionByName(part(t.exceptAll(b), "train_only")).unionByName(part(b.exceptAll(t), "benchmark_only"))


@R.add(
    "manifest_checks",
    """
    WITH t AS (SELECT * FROM training_manifest), r AS (SELECT
      count(*) FILTER (WHERE NOT coalesce(id <> '', false)) AS id_given, count(*) FILTER (WHERE NOT coalesce(pool_kind IN ('normal', 'error'), false)) AS known_partition,
      count(*) FILTER (WHERE NOT coalesce((pool_kind = 'error') = coalesce(has_error, false), false)) AS pure_partition, count(*) FILTER (WHERE NOT coalesce(NOT (pool_kind = 'error' AND target = corrected_text), true)) AS error_differs,
      count(*) FILTER (WHERE NOT coalesce(regexp_matches(image_sha256, '^[0-9a-f]{64}$'), false)) AS hash_form FROM t),
    u AS (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS v FROM (SELECT count(*) AS c FROM t WHERE id IS NOT NULL GROUP BY id)),
    h AS (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS v FROM (SELECT count(*) AS c FROM t WHERE image_sha256 IS NOT NULL GROUP BY image_sha256))
    SELECT 'id_given' AS "check", id_given AS failures FROM r UNION ALL SELECT 'known_partition', known_partition FROM r UNION ALL SELECT 'pure_partition', pure_partition FROM r
    UNION ALL SELECT 'error_differs', error_differs FROM r UNION ALL SELECT 'hash_form', hash_form FROM r UNION ALL SELECT 'unique_id', v FROM u UNION ALL SELECT 'unique_hash', v FROM h
    UNION ALL SELECT 'id_in_pool', count(*) FROM t WHERE NOT EXISTS (SELECT 1 FROM source_metadata s WHERE s.sid = t.id)
    UNION ALL SELECT 'hash_not_in_benchmark', count(*) FROM t WHERE EXISTS (SELECT 1 FROM benchmark_manifest b WHERE b.image_sha256 = t.image_sha256)
    UNION ALL SELECT 'record_count', abs(count(*) - 1100) FROM t
    """,
)
def manifest_checks(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "training_manifest")
    kind, flag = F.col("pool_kind"), F.coalesce("has_error", F.lit(False))
    rows = K.row_checks(t, {
        "id_given": F.col("id") != "", "known_partition": kind.isin("normal", "error"), "pure_partition": (kind == "error") == flag,
        "error_differs": F.coalesce(~((kind == "error") & (F.col("target") == F.col("corrected_text"))), F.lit(True)), "hash_form": F.col("image_sha256").rlike("^[0-9a-f]{64}$"),
    })
    pool = table(spark, sf, "source_metadata").select(F.col("sid").alias("id"))
    return (
        rows.unionByName(K.unique_checks(t, {"unique_id": ["id"], "unique_hash": ["image_sha256"]})).unionByName(K.reference_check(t, ["id"], pool, "id_in_pool"))
        .unionByName(K.disjoint_check(t, ["image_sha256"], table(spark, sf, "benchmark_manifest"), "hash_not_in_benchmark")).unionByName(K.count_check(t, 1100))
    )


@R.add(
    "manifest_profile",
    """
    WITH w AS (SELECT image_path, image_sha256, target, length(target) AS c, len(list_filter(regexp_split_to_array(coalesce(target, ''), '\\s+'), lambda x: x <> '')) AS k FROM training_manifest)
    SELECT count(*) AS n, count(DISTINCT image_path) AS n_paths, count(DISTINCT image_sha256) AS n_digests, count(DISTINCT target) AS n_texts, count(target) - count(DISTINCT target) AS repeated_texts,
      avg(c) AS chars_mean, median(c) AS chars_median, min(c) AS chars_min, max(c) AS chars_max, avg(k) AS words_mean, median(k) AS words_median, min(k) AS words_min, max(k) AS words_max,
      (SELECT max(q) FROM (SELECT count(*) AS q FROM training_manifest WHERE target IS NOT NULL GROUP BY target)) AS most_frequent FROM w
    """,
)
def manifest_profile(spark: SparkSession, sf: str) -> DataFrame:
    d = A.base_stats(table(spark, sf, "training_manifest"), "image_path", "image_sha256", "target")
    return d.select(*(F.col(c).cast("long").alias(c) if c.endswith(("_min", "_max")) else F.col(c) for c in d.columns))


@R.add(
    "writer_distribution",
    """
    WITH c AS (SELECT coalesce(writer, '<MISSING>') AS key, count(*) AS n FROM source_metadata GROUP BY 1)
    SELECT key, n, 100.0::DOUBLE * n / (SELECT CAST(sum(n) AS BIGINT) FROM c) AS percent FROM c
    """,
)
def writer_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return A.distribution(table(spark, sf, "source_metadata"), "writer", "<MISSING>")


@R.add(
    "pending_rows",
    "SELECT row_id, id FROM benchmark_manifest b WHERE NOT EXISTS (SELECT 1 FROM ocr_prediction p WHERE p.id = b.id)",
)
def pending_rows(spark: SparkSession, sf: str) -> DataFrame:
    return J.pending(table(spark, sf, "benchmark_manifest").select("row_id", "id"), table(spark, sf, "ocr_prediction"), "id")


@R.add(
    "greedy_round_robin",
    """
    WITH RECURSIVE d AS (SELECT line_id AS id, ground_truth AS t, coalesce(identifier, '?') AS s, CAST(coalesce(sentence_score, 0) AS DOUBLE) AS v, sha256('42:aihub:' || ground_truth || ':' || line_id) AS h FROM line_record WHERE ground_truth <> ''),
    g AS (SELECT t, list({'id': id, 's': s, 'v': v} ORDER BY v DESC, h, id) AS c FROM d GROUP BY t), r AS (SELECT t, c, unnest(range(least(8, len(c)))) AS r FROM g),
    o AS (SELECT c, r, row_number() OVER (ORDER BY r, -c[r + 1].v, sha256('42:gt-round:' || r || ':' || t)) AS k FROM r),
    p(k, id, r, taken, used) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS VARCHAR[])
      UNION ALL SELECT k, z.id, r, CASE WHEN z IS NULL THEN taken ELSE list_append(taken, z.id) END, CASE WHEN z IS NULL THEN used ELSE list_append(used, z.s) END
      FROM (SELECT o.k, o.r, taken, used, list_filter(o.c, lambda z: NOT list_contains(taken, z.id) AND len(list_filter(used, lambda u: u = z.s)) < 6)[1] AS z FROM p JOIN o ON o.k = p.k + 1 WHERE len(taken) < 2000))
    SELECT id, CAST(r AS INTEGER) AS round FROM p WHERE id IS NOT NULL
    """,
)
def greedy_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "line_record").filter("ground_truth IS NOT NULL AND ground_truth <> ''").select("line_id", "ground_truth", F.coalesce("identifier", F.lit("?")).alias("source"), F.coalesce("sentence_score", F.lit(0)).alias("score"))
    # Fixed value: the digests' name for real lines.
    return Q.greedy_round_robin(d, "line_id", "ground_truth", "source", "score", 2000, 6, namespace="aihub", strict=False)


@R.add(
    "greedy_unique",
    """
    WITH RECURSIVE d AS (SELECT identifier AS s, ground_truth AS t, min(line_id) AS id FROM line_record WHERE ground_truth <> '' AND identifier IS NOT NULL GROUP BY ALL), f AS (SELECT t, count(*) AS n FROM d GROUP BY t),
    g AS (SELECT s, count(*) AS n, list({'t': t, 'id': id} ORDER BY f.n, -length(t), t, id) AS c FROM d JOIN f USING (t) GROUP BY s), o AS (SELECT s, c, row_number() OVER (ORDER BY n, s) AS k FROM g),
    p(k, s, id, used) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST([] AS VARCHAR[])
      UNION ALL SELECT k, s, z.id, CASE WHEN z IS NULL THEN used ELSE list_append(used, z.t) END FROM (SELECT o.k, o.s, used, list_filter(o.c, lambda z: NOT list_contains(used, z.t))[1] AS z FROM p JOIN o ON o.k = p.k + 1))
    SELECT s AS source, id FROM p WHERE id IS NOT NULL
    """,
)
def greedy_unique(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "line_record").filter("ground_truth IS NOT NULL AND ground_truth <> '' AND identifier IS NOT NULL").select("line_id", "ground_truth", "identifier")
    return Q.greedy_unique(d, "line_id", "identifier", "ground_truth")
