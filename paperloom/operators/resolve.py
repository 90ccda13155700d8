"""Which of several values of a field is authoritative."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.keys import strip
from paperloom.functions.text import date_tuple, is_null_like
from paperloom.rules import mortgage as M

KEY = ["doc_id", "field"]


def occurrences(page_fields: DataFrame) -> DataFrame:
    """Usable occurrences of (doc_id, page, ord, field, value, ...): null-like values and names go."""
    return page_fields.where(~is_null_like(F.col("value")) & F.col("field").isNotNull())


def text_candidates(pages: DataFrame, patterns: Sequence[tuple[str, str, str, str]] = M.REVISION_PATTERNS, trigger: str = M.CORRECTION_TRIGGER) -> DataFrame:
    """Corrections that page texts announce: doc_id, field, value, page, date, ord.

    pages: doc_id, page, text.  A page counts only if it has a trigger word; its date is
    its last d/d/y; each pattern gives its first match.
    """
    date = F.try_element_at(F.regexp_extract_all("text", F.lit(r"(\d{1,2}/\d{1,2}/\d{2,4})"), F.lit(1)), F.lit(-1))
    hits = []
    for i, (field, pattern, before, after) in enumerate(patterns):
        got = F.regexp_extract("text", pattern, 1)
        hits.append(F.struct(F.lit(field).alias("field"), F.when(got != "", F.concat(F.lit(before), got, F.lit(after))).alias("value"), F.lit(i).alias("ord")))
    found = pages.where(F.col("text").rlike("(?i)" + trigger)).select("doc_id", "page", date.alias("date"), F.explode(F.filter(F.array(*hits), lambda h: h["value"].isNotNull())).alias("h"))
    return found.select("doc_id", "h.field", "h.value", "page", "date", "h.ord")


def candidates(told: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates that pages tell outright, and those of texts on pages that tell none for the field.

    Told ones without a field or value are ignored.
    """
    told = told.where((F.coalesce("field", F.lit("")) != "") & (strip(F.coalesce("value", F.lit(""))) != ""))
    new = texts.join(told.select(*KEY, "page").distinct(), [*KEY, "page"], "left_anti")
    return told.withColumn("origin", F.lit(0)).unionByName(new.withColumn("origin", F.lit(1)))


def resolve(found: DataFrame, corrections: DataFrame, correction_pages: DataFrame, fixed: Sequence[str] = M.UNCORRECTED_FIELDS) -> DataFrame:
    """One row for each (doc_id, field): the authoritative value and what it replaced.

    found: doc_id, field, value, page, ord, confidence, confidence_reason, evidence.
    corrections: doc_id, field, value, page, date, ord, origin.  correction_pages: doc_id, page.

    A field with candidates takes the one of the latest date, then page, then the first
    collected; undated ones come last, and a date without a calendar day still orders.
    Others take the occurrence on the lowest page, then the first seen.  Fields in
    ``fixed`` are never corrected.  original_value is the first occurrence off correction
    pages, else any first, else "unknown" on page 1.  Both sides are aggregated before
    they meet, so a hot document reaches the join as one row a field.
    """
    flags = correction_pages.select("doc_id", "page").distinct().withColumn("on_correction", F.lit(True))
    occ = found.join(flags, ["doc_id", "page"], "left")
    entry = F.struct("page", "ord", "value", "confidence", "confidence_reason", "evidence")
    first = occ.groupBy(*KEY).agg(F.min(entry).alias("any"), F.min(F.when(F.col("on_correction").isNull(), entry)).alias("plain"))
    day = date_tuple(F.col("date"))
    rank = F.struct(day.isNotNull().alias("dated"), day.alias("day"), F.col("page").alias("page"), (-F.col("origin")).alias("o"), (-F.col("ord")).alias("n"), F.col("value").alias("value"), F.coalesce("date", F.lit("")).alias("date"))
    best = corrections.where(~F.col("field").isin(*fixed)).groupBy(*KEY).agg(F.max(rank).alias("w"))
    d = first.join(best, KEY, "full_outer")
    w, a = F.col("w"), F.col("any")
    was = F.coalesce("plain", "any")
    corrected = w.isNotNull()
    return d.select(
        *KEY,
        F.when(corrected, w["value"]).otherwise(a["value"]).alias("raw_value"),
        F.when(corrected, w["page"]).otherwise(a["page"]).alias("source_page"),
        F.when(corrected, F.lit("high")).otherwise(a["confidence"]).alias("confidence"),
        F.when(~corrected, a["confidence_reason"]).alias("confidence_reason"),
        F.when(~corrected, a["evidence"]).alias("evidence"),
        corrected.alias("corrected"),
        F.when(corrected, F.coalesce(was["value"], F.lit("unknown"))).alias("original_value"),
        F.when(corrected, F.coalesce(was["page"], F.lit(1))).alias("original_page"),
        F.when(corrected, w["page"]).alias("correction_page"),
        F.when(corrected, w["date"]).alias("correction_date"),
        F.when(corrected & (w["date"] != ""), "latest dated correction").when(corrected, "latest correction page, undated").alias("rule"),
    )


def correction_records(fields: DataFrame) -> DataFrame:
    """The corrections among resolved fields."""
    return fields.where("corrected").select(*KEY, "original_value", "original_page", F.col("raw_value").alias("corrected_value"), "correction_page", "correction_date", "rule")
