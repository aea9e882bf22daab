"""Whole flows: leak-free pools from a source table, and the final report of a set of runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.functions import metrics as M
from quillflow.operators import checks as K
from quillflow.operators import leakage as L
from quillflow.operators import rules as U
from quillflow.operators import sampling as Q
from quillflow.operators import summaries as A
from quillflow.session import Workspace
from quillflow.sources import writers as O


def prepare_pools(
    source: DataFrame, row: str, families: L.Families, benchmarks: DataFrame, benchmark_families: L.Families, rules: Sequence[U.Rule], flag: str, split: str, n_validation: int,
    target: str | None = None, namespace: str = "pools",
) -> dict[str, DataFrame]:
    """Training and validation rows without overlap with the benchmarks or each other, with the reasons and the audit.

    Rows are routed by ``rules`` and by their overlap; validation is picked per value of ``flag``, from outside the training
    split first; training rows that share any key with it are removed; every pair of results is audited, and a failing audit
    stops the flow. With ``target`` the results are written as JSON lines there.
    """
    ws = Workspace(source.sparkSession, "pools")
    d = L.with_overlap(source, row, families, benchmarks, benchmark_families)
    over = [U.Rule(f + "_overlap", F.col(f + "_overlap")) for f in families if f in benchmark_families]
    routed = ws.save(U.route(d, [*rules, *over]), "routed")
    fine = routed.filter("reason = 'accepted'").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    validation = ws.save(Q.pick_validation(fine, row, flag, F.col(split) != "train", n_validation, namespace), "validation")
    train = fine.filter(F.col(split) == "train").join(validation.select(row), row, "left_anti")
    kept = ws.save(L.remove_overlap(train, row, families, validation, families), "train")
    clean = kept.filter("reason = 'kept'")
    sides = {"train": (clean, row, families), "validation": (validation, row, families), "benchmark": (benchmarks, row, benchmark_families)}
    shared = {f: c for f, c in families.items() if f in benchmark_families}
    audit = L.audit(sides, [("train", "validation")]).unionByName(
        L.audit({"train": (clean, row, shared), "validation": (validation, row, shared), "benchmark": sides["benchmark"]}, [("train", "benchmark"), ("validation", "benchmark")])
    )
    audit = ws.save(audit, "audit")
    K.gate(audit.select(F.concat_ws("_", "audit", "family").alias("check"), F.col("rows").alias("failures")))
    reasons = U.reason_counts(routed, "reason", split).unionByName(kept.groupBy(F.col(split), "reason").agg(F.count("*").alias("n")))
    out = {"train": clean.withColumn("order_key", Q.stable_key(namespace + ":train", row)), "validation": validation, "reasons": reasons, "audit": audit}
    if target:
        for name in ("train", "validation"):
            O.write_jsonl(out[name], f"{target}/{name}")
    return out


def final_report(tracks: Mapping[str, DataFrame], errors: DataFrame, reference: Column, corrected: Column, answer: Column, models: DataFrame | None = None) -> dict[str, DataFrame]:
    """Per track and combined answer summaries, and the error classes per model, each with the models' validity."""
    all_ = None
    for name, df in tracks.items():
        part = df.select("model_name", F.lit(name).alias("track"), "ground_truth", "prediction", "inference_time")
        all_ = part if all_ is None else all_.unionByName(part)
    d, n = M.distance("ground_truth", "prediction"), F.length(F.coalesce("ground_truth", F.lit("")))
    answers = A.with_totals(all_, ["model_name", "track"], [["model_name", "track"], ["model_name"]], F.count("*").alias("n"), (F.sum(d) / F.greatest(F.lit(1), F.sum(n))).alias("corpus_cer"), F.avg("inference_time").alias("mean_seconds"))
    e = errors.select("model_name", "error_type", reference.alias("g"), corrected.alias("k"), answer.alias("p")).filter("g <> k")
    e = e.withColumn("scored", M.score_spans(M.correction_spans("g", "k"), "g", "p")).withColumn("class", M.sample_class("scored", "g", "p"))
    kinds = ["error_preserved", "over_corrected", "other_recognition_error"]
    by_model = A.class_summary(e, ["model_name"], kinds, "class")
    by_label = A.label_breakdown(e, "error_type", "class", kinds, ["model_name"])
    if models is not None:  # a row per model
        answers, by_model = (x.join(F.broadcast(models), "model_name", "left") for x in (answers, by_model))
    return {"answers": answers, "errors": by_model, "labels": by_label}
