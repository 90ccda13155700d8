"""Confidence after format and page quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import format_fails


def degraded_pages(pages: DataFrame) -> DataFrame:
    """doc_id, source_page of pages flagged or graded as degraded; pages: doc_id, page, has_degraded_text, text_quality."""
    bad = F.coalesce("has_degraded_text", F.lit(False)) | F.col("text_quality").isin("degraded", "unreadable")
    return pages.where(bad).select("doc_id", F.col("page").alias("source_page")).distinct()


def adjust(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """Fields with confidence lowered a level for a bad format, and from high for a degraded page.

    Unknown confidence counts as medium.  The reason is dropped where the result is high.
    """
    d = fields.join(degraded_pages(pages).withColumn("degraded", F.lit(True)), ["doc_id", "source_page"], "left")
    level = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "low", 0).otherwise(1)
    bad = format_fails(F.col("field"), F.col("raw_value"))
    after = F.when(bad.isNotNull(), F.greatest(level - 1, F.lit(0))).otherwise(level)
    worn = (after == 2) & F.col("degraded").isNotNull()
    final = F.when(worn, 1).otherwise(after)
    old = F.nullif(F.col("confidence_reason"), F.lit(""))
    reason = F.concat_ws("; ", old, F.when(bad.isNotNull(), F.concat(F.lit("not in the format of "), bad)), F.when(worn, F.concat(F.lit("page "), F.col("source_page").cast("string"), F.lit(" is degraded"))))
    return d.withColumn("confidence_reason", F.when(final < 2, F.nullif(reason, F.lit("")))).withColumn("confidence", F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), final + 1)).drop("degraded")
