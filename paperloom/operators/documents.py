"""Whole documents: caching of answers, summaries, nested results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TTL_SECONDS = 86_400


def cache_misses(requests: DataFrame, cache: DataFrame, now: str | None = None) -> DataFrame:
    """Distinct requests whose key no stored answer younger than a day has; cache: key, stored_at."""
    moment = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    fresh = cache.where(F.col("stored_at") > moment - F.make_dt_interval(secs=F.lit(TTL_SECONDS))).select("key").distinct()
    return requests.dropDuplicates(["key"]).join(fresh, "key", "left_anti")


def counts(docs: DataFrame, **children: DataFrame) -> DataFrame:
    """doc_id and n_<child> of every document; each child is counted before it is joined."""
    out = docs.select("doc_id").distinct()
    for name, child in children.items():
        out = out.join(child.groupBy("doc_id").agg(F.count(F.lit(1)).alias(f"n_{name}")), "doc_id", "left").na.fill(0, [f"n_{name}"])
    return out


def nested(docs: DataFrame, **children: DataFrame) -> DataFrame:
    """One row a document with each child as a sorted array of structs, empty where it has none.

    For export only: a document's records come together in one row.
    """
    out = docs
    for name, child in children.items():
        cols = [c for c in child.columns if c != "doc_id"]
        own = child.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        out = out.join(own, "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    return out


def page_summaries(pages: DataFrame) -> DataFrame:
    """doc_id, pages: what a model is told of a document to classify it, its pages in order.

    pages: doc_id, page, page_type, fields array<string>, is_correction_page; no texts.
    """
    line = F.struct("page", "page_type", "fields", "is_correction_page")
    return pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(line)).alias("pages"))
