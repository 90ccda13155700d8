"""Outputs: nested results, review tasks, corrections."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(name))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one file a partition; folders are made."""
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON array in one file, as a reader of a whole document wants it; null entries are kept.

    Lines are made and sorted by all tasks; the file itself is written by one task, which
    streams through them.
    """
    lines = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("j"))
    # an empty text goes first, so that there is a task also without rows
    lines = lines.union(df.sparkSession.createDataFrame([("",)], "j string")).sort("j")

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for batch in batches:
            out = []
            for j in filter(None, batch.column(0).to_pylist()):
                out.append(before + j)
                before = ","
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if before == "[" else "]"], pa.string())], names=["value"])

    lines.coalesce(1).mapInArrow(wrapped, "value string").write.mode(mode).text(path)


def store_answers(answers: DataFrame, path: str) -> None:
    """Answers of a model (key, response, stored_at) added to the cache table."""
    answers.select("key", "response", "stored_at").write.mode("append").parquet(path)
