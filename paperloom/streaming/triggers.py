"""Continuous counting of corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id bigint, field string, at timestamp"


def read_corrections(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """Correction files (JSON lines) of a folder as a stream."""
    return spark.readStream.schema(schema).json(folder)


def frequent(stream: DataFrame, window: str = "30 days", slide: str = "1 day", late: str = "2 days", least: int = 3) -> DataFrame:
    """field, start, end, n of windows in which a field was corrected ``least`` times.

    Submissions repeated within the lateness count once; later ones than that are dropped,
    which the watermark bounds the state by.
    """
    d = stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
    per = d.groupBy("field", F.window("at", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per.where(F.col("n") >= least).select("field", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
