"""Queries of the subpackage and, where SQL can say the same, their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.common import table
from paperloom.llm import consensus as C
from paperloom.llm.encode import encode
from paperloom.llm.mixing import p8_mix, p8_shares
from paperloom.llm import personal, scan_noise, truncation
from paperloom.llm.survivorship import field_value_survivors, survivor_rows

SURVIVING = ("raw_value", "evidence", "correction_date")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivor_rows(field_value_survivors(table(spark, sf_dir, "field_values")), SURVIVING)


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = field_value_survivors(table(spark, sf_dir, "field_values"))
    return best.select("document_id", "field", "n_records", *[c for a in SURVIVING for c in (best[f"{a}.value"].alias(a), best[f"{a}.row_id"].alias(f"{a}_fv_id"))])


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.texts_of(table(spark, sf_dir, "page_analyses"), table(spark, sf_dir, "degraded_blocks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise.find_noise(_scanned(spark, sf_dir)).where("kind <> 'break'").select("origin", "record_id", "line_no", "kind").distinct()


def p2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _scanned(spark, sf_dir)
    return scan_noise.repair(texts, scan_noise.find_noise(texts))


def _panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, C.Consensus]:
    reviews = table(spark, sf_dir, "import_corrections")
    latest = C.latest_answers(reviews)
    return reviews, latest, C.fit(latest, reviews.select(F.col("task_id").alias("item")), C.VERDICTS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir)[2].items.select(F.col("item").alias("task_id"), F.col("label").alias("verdict"))


def p3_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews, latest, fitted = _panel(spark, sf_dir)
    original = reviews.groupBy(F.col("task_id").alias("item")).agg(F.min("original_pipeline_value").alias("original"))
    given = latest.where(F.col("label") != "unsure").groupBy("item").agg(F.count(F.lit(1)).alias("n_answers"), F.count(F.when(F.col("label") == "correct", 1)).alias("n_correct"))
    out = fitted.items.join(original, "item", "left").join(given, "item", "left").join(C.consensus_values(latest, fitted), "item", "left")
    n, c = F.coalesce("n_answers", F.lit(0)), F.coalesce("n_correct", F.lit(0))
    same = (c * (c - 1) + (n - c) * (n - c - 1)) / F.when(n > 1, n * (n - 1))
    return out.select(
        F.col("item").alias("task_id"), F.col("label").alias("verdict"), F.col("p0").alias("p_correct"), n.alias("n_answers"), same.alias("pair_agreement"),
        F.when(F.col("label") == "correct", F.col("original")).otherwise(F.col("value")).alias("value"), "support",
    )


def p3_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(spark, sf_dir)[2].annotators.withColumnRenamed("annotator", "reviewer")


def p3_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.agreement(C.latest_answers(table(spark, sf_dir, "import_corrections")).where(F.col("label") != "unsure"))


def _mentions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    values = table(spark, sf_dir, "field_values")
    texts = personal.texts_of(values, table(spark, sf_dir, "page_analyses"))
    return texts, personal.find_personal(texts, personal.gazetteer(values))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir)[1].select("origin", "record_id", "kind", "start_pos").distinct()


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redact(*_mentions(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.detect(table(spark, sf_dir, "documents")).where("is_cut").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(truncation.detect(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_survivors": p1_survivors,
        "p2_found": p2_found,
        "p2_text": p2_text,
        "p3_found": p3_found,
        "p3_consensus": p3_consensus,
        "p3_reviewers": p3_reviewers,
        "p3_agreement": p3_agreement,
        "p4_found": p4_found,
        "p4_text": p4_text,
        "p7_ids": p7_ids,
        "p8_mix": p8_mix,
        "p8_shares": p8_shares,
        "p9_found": p9_found,
        "p9_rates": p9_rates,
    }


def oracle_sql() -> dict[str, str]:
    from paperloom.llm.oracles import ORACLES

    return dict(ORACLES)
