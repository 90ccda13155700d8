"""Inputs: page files, page answers, results and annotations."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import document_key, repaired_json

ANNOTATIONS = "id bigint, data map<string,string>, annotations array<struct<completed_at string, result array<struct<from_name string, value struct<choices array<string>, text array<string>>>>>>"
#: A page splitter gets the bytes of one file and yields (page number from 1, text, tables as rows of cells).
Splitter = Callable[[bytes], Iterable[tuple[int, str, list[list[list[str]]]]]]


def plain_pages(content: bytes) -> Iterator[tuple[int, str, list[list[list[str]]]]]:
    """Pages of a text file, divided by form feeds; the splitter that needs no library."""
    for i, page in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        yield i, page.strip(), []


def pdf_pages(content: bytes) -> Iterator[tuple[int, str, list[list[list[str]]]]]:
    """Pages of a PDF file; needs an optional PDF library on the executors."""
    import io

    import pdfplumber  # optional

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for i, page in enumerate(pdf.pages, 1):
            try:
                tables = [[[c or "" for c in row] for row in t] for t in page.extract_tables() or []]
            except Exception:  # noqa: BLE001 - a page's tables are optional
                tables = []
            yield i, (page.extract_text() or "").strip(), tables


def read_pages(spark: SparkSession, path: str, splitter: Splitter = plain_pages) -> DataFrame:
    """doc_id, filename, page, text, tables, error of the files under a path.

    A file that can't be split is one row with its error and no page, and fails nothing.
    """
    files = spark.read.format("binaryFile").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for name, content in zip(p["path"], p["content"], strict=True):
                try:
                    rows = [(name, i, text, tables, None) for i, text, tables in splitter(bytes(content))]
                except Exception as e:  # noqa: BLE001 - told in the row
                    rows = [(name, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "page", "text", "tables", "error"]).astype({"page": "Int64"})

    out = files.select("path", "content").mapInPandas(run, "path string, page bigint, text string, tables array<array<array<string>>>, error string")
    return out.select(document_key(F.col("path")).alias("doc_id"), F.substring_index("path", "/", -1).alias("filename"), F.col("page").cast("int").alias("page"), "text", "tables", "error")


def read_page_answers(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, page, response of stored model answers (JSON lines)."""
    return spark.read.schema("doc_id string, page int, response string").json(path)


#: What an exported result holds, for a reader that wants columns; other entries stay in the text.
RESULT = (
    "document_id string, filename string, document_type string, document_type_confidence string, pages_processed int, "
    "fields map<string, struct<raw_value string, confidence string, confidence_reason string, evidence string, source_page int>>"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """filename, result_json, result of exported results, one JSON document a file.

    result has the columns of RESULT, and is null for a text without a JSON object.
    """
    texts = spark.read.text(path, wholetext=True).select(F.substring_index(F.input_file_name(), "/", -1).alias("filename"), F.col("value").alias("result_json"))
    return texts.withColumn("result", repaired_json(F.col("result_json"), RESULT))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """task_id, data, annotations of an annotation export."""
    return spark.read.schema(ANNOTATIONS).json(path, multiLine=True).withColumnRenamed("id", "task_id")
