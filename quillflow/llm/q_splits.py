"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillflow.functions.text import file_form, id_form
from quillflow.llm.splits import assign_splits, tied_sets
from quillflow.plans.registry import Registry
from quillflow.session import Workspace, table

R = Registry()
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Both tables; the prefixes keep their keys, and the kinds of keys of lines, apart."""
    line = table(spark, sf, "line_record").select(
        F.col("line_id").alias("id"), F.array(F.concat(F.lit("i:"), id_form("identifier")), F.concat(F.lit("f:"), file_form("source_image"))).alias("keys")
    )
    pool = table(spark, sf, "source_metadata").select(
        F.col("row_id").alias("id"), F.array(F.concat(F.lit("s:"), id_form("sid")), F.concat(F.lit("s:"), id_form("source_sid"))).alias("keys")
    )
    return line.unionByName(pool)


_WIDE, _THIN = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")


def _folded(c: str) -> str:
    return f"lower(translate(regexp_replace({c}, '[\\p{{Cf}}]', '', 'g'), '{_WIDE}', '{_THIN}'))"


def _id_sql(c: str) -> str:
    return f"nullif(regexp_replace(regexp_replace({_folded(c)}, '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), '')"


def _file_sql(c: str) -> str:
    return f"nullif(trim(list_last(string_split(regexp_replace(replace({_folded(c)}, chr(92), '/'), '[\\s\\p{{Z}}]+', ' ', 'g'), '/'))), '')"


@R.add(
    "p1_found",
    f"""
    WITH RECURSIVE r AS (SELECT line_id AS id, 'i:' || {_id_sql('identifier')} AS k FROM line_record UNION ALL SELECT line_id, 'f:' || {_file_sql('source_image')} FROM line_record
      UNION ALL SELECT row_id, 's:' || {_id_sql('sid')} FROM source_metadata UNION ALL SELECT row_id, 's:' || {_id_sql('source_sid')} FROM source_metadata),
    n AS (SELECT DISTINCT id, k FROM r WHERE k IS NOT NULL), e AS (SELECT DISTINCT a.k AS k1, b.k AS k2 FROM n a JOIN n b ON a.id = b.id AND a.k <> b.k),
    reach AS (SELECT DISTINCT k AS a, k AS b FROM n UNION SELECT reach.a, e.k2 FROM reach JOIN e ON reach.b = e.k1),
    m AS (SELECT k, min(id) AS least FROM n GROUP BY k), g AS (SELECT a AS k, min(least) AS group_id FROM reach JOIN m ON m.k = reach.b GROUP BY a), s AS (SELECT DISTINCT n.id, g.group_id FROM n JOIN g USING (k))
    SELECT id AS record_id, group_id FROM s WHERE group_id IN (SELECT group_id FROM s GROUP BY group_id HAVING count(*) > 1)
    """,
)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    sets = tied_sets(_records(spark, sf), "id", F.col("keys"))
    return sets.filter("size > 1").select(F.col("id").alias("record_id"), "group_id")


@R.add("p1_splits")
def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Records, sets and share of each split, over both tables."""
    ws = Workspace(spark, "splits")
    all_rows = _records(spark, sf)
    sets = ws.save(tied_sets(all_rows, "id", F.col("keys"), ws), "sets")
    alone = all_rows.filter(F.size(F.filter("keys", lambda k: k.isNotNull())) == 0).groupBy(F.col("id").alias("group_id")).agg(F.lit(1).cast("long").alias("weight"))
    groups = ws.save(sets.groupBy("group_id").agg(F.count_distinct("id").alias("weight")).unionByName(alone), "groups")
    given = groups.join(assign_splits(groups, PROPORTIONS), "group_id")
    per = given.groupBy("split").agg(F.sum("weight").alias("n_records"), F.count("*").alias("n_groups"))
    wanted = F.create_map(*(F.lit(x) for kv in PROPORTIONS.items() for x in kv))
    total = F.sum("n_records").over(Window.partitionBy())  # a row per split
    return per.select("split", "n_records", "n_groups", (F.col("n_records") / total).alias("share"), wanted[F.col("split")].alias("wanted"))
