"""Document types from signals in page texts."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.rules import mortgage as M


def scores(pages: DataFrame, signals: Mapping[str, Mapping[str, bool]] = M.TYPE_SIGNALS) -> DataFrame:
    """doc_id, type_ord, doc_type, score: points of each type with a signal in the document.

    pages: doc_id, page, text.  A signal counts once a document, one point or three if it
    belongs to one type.  A signal may run over two consecutive pages.  Pages are scored on
    their own and only matched signals are shuffled.
    """
    longest = max(len(s) for ss in signals.values() for s in ss)
    rows = [{"type_ord": i, "doc_type": t, "signal": s, "points": 3 if x else 1} for i, (t, ss) in enumerate(signals.items()) for s, x in ss.items()]
    # one constant, which the optimizer folds, instead of an expression for each signal
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<type_ord:int,doc_type:string,signal:string,points:int>>")
    low = lambda d: d.select("doc_id", F.lower("text").alias("low"))
    found = lambda d: low(d).select("doc_id", F.explode(F.filter(table, lambda h: F.contains(F.col("low"), h["signal"]))).alias("h"))
    # signals over a page break: only the ends of the texts meet, those of every scan of a page; the texts themselves aren't shuffled
    ends = pages.select("doc_id", (F.col("page") + 1).alias("page"), F.expr(f"right(text, {longest})").alias("tail")).distinct()
    heads = pages.select("doc_id", "page", F.substring("text", 1, longest).alias("head"))
    breaks = heads.join(ends, ["doc_id", "page"]).select("doc_id", F.concat_ws(" ", "tail", "head").alias("text"))
    hits = found(pages).unionByName(found(breaks)).select("doc_id", "h.*").distinct()
    return hits.groupBy("doc_id", "type_ord", "doc_type").agg(F.sum("points").alias("score"))


def classify(pages: DataFrame, told: DataFrame | None = None, signals: Mapping[str, Mapping[str, bool]] = M.TYPE_SIGNALS) -> DataFrame:
    """doc_id, doc_type, confidence, best_score, second_score of every document.

    told: doc_id, told_type, told_confidence of a model, optional.  The best type is sure
    with three points and half as many again as the second.  A sure type holds, high if
    the model agrees or is silent, else medium.  Else a sure model holds; a half sure one
    makes the best type medium; then the best type is low, without any the model's.
    Without a model two points make medium, else Unknown.
    """
    per = scores(pages, signals).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("score"), (-F.col("type_ord")).alias("o"), F.col("doc_type"))), asc=False).alias("s"))
    d = pages.select("doc_id").distinct().join(per, "doc_id", "left")
    d = d.withColumn("best", F.get("s", F.lit(0))["doc_type"]).withColumn("best_score", F.coalesce(F.get("s", F.lit(0))["score"], F.lit(0))).withColumn("second_score", F.coalesce(F.get("s", F.lit(1))["score"], F.lit(0))).drop("s")
    if told is not None:
        d = d.join(told, "doc_id", "left")
    else:
        d = d.withColumn("told_type", F.lit(None).cast("string")).withColumn("told_confidence", F.lit(None).cast("string"))
    b, model = F.col("best_score"), F.col("told_type").isNotNull()
    sure = (b >= 3) & ((F.col("second_score") == 0) | (b >= 1.5 * F.col("second_score")))
    same = F.col("told_type") == F.col("best")
    doc_type = (
        F.when(sure, F.col("best"))
        .when(model & (F.col("told_confidence") == "high"), F.col("told_type"))
        .when(model & (b > 0), F.col("best"))
        .when(model, F.col("told_type"))
        .when(b >= 2, F.col("best"))
        .otherwise("Unknown")
    )
    confidence = (
        F.when(sure & (~model | same), "high").when(sure, "medium").when(model & (F.col("told_confidence") == "high"), "high").when(model & (F.col("told_confidence") == "medium") & (b >= 2), "medium").when(model, "low").when(b >= 2, "medium").otherwise("low")
    )
    return d.select("doc_id", doc_type.alias("doc_type"), confidence.alias("confidence"), F.col("best_score").cast("long").alias("best_score"), F.col("second_score").cast("long").alias("second_score"))
