"""Extracted tables: shaping, and cross-validation against fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.keys import strip
from paperloom.functions.text import table_money
from paperloom.rules import mortgage as M

#: Cells that hold a row's label and its amount, the first filled one counts.
LABEL_KEYS = ("label", "Label", "description", "Description", "item", "Item")
AMOUNT_KEYS = ("amount", "Amount", "value", "Value", "cost", "Cost")


def header_rows(tables: DataFrame) -> DataFrame:
    """Rows of raw tables keyed by their first row: doc_id, page, name, row_ord, cells, confidence.

    tables: doc_id, page, table_ord, rows array<array<string>>.  Null cells become empty,
    empty rows go, a table needs two rows left.  Columns without a header are col_k; of
    equal headers the last cell counts.
    """
    rows = F.filter(F.transform("rows", lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("")))), lambda r: F.exists(r, lambda c: c != ""))
    d = tables.select("doc_id", "page", "table_ord", rows.alias("rows")).where(F.size("rows") > 1)
    d = d.select("doc_id", "page", "table_ord", F.col("rows")[0].alias("head"), F.posexplode(F.slice("rows", F.lit(2), F.size("rows") - 1)).alias("row_ord", "row"))
    names = F.transform("head", lambda h, i: F.when(strip(h) != "", strip(h)).otherwise(F.concat(F.lit("col_"), i.cast("string"))))
    pairs = F.filter(F.transform("names", lambda n, i: F.struct(n.alias("k"), F.coalesce(F.get("row", i), F.lit("")).alias("v"), i.alias("i"))), lambda s: s["i"] < F.size("row"))
    last = F.filter("pairs", lambda s: ~F.exists("pairs", lambda t: (t["k"] == s["k"]) & (t["i"] > s["i"])))
    d = d.withColumn("names", names).withColumn("pairs", pairs)
    name = F.concat(F.lit("Parsed Table "), F.col("table_ord").cast("string"), F.lit(" (p"), F.col("page").cast("string"), F.lit(")"))
    return d.select("doc_id", "page", name.alias("name"), "row_ord", F.map_from_entries(F.transform(last, lambda s: F.struct(s["k"], s["v"]))).alias("cells"), F.lit("high").alias("confidence"))


def new_tables(parsed: DataFrame, present: DataFrame) -> DataFrame:
    """Parsed rows of tables whose name the page doesn't have yet."""
    return parsed.join(present.select("doc_id", "page", "name").distinct(), ["doc_id", "page", "name"], "left_anti")


def usable_tables(tables: DataFrame) -> DataFrame:
    """Tables with rows; null rows go, cells are stripped.  tables: ..., rows array<map<string,string>>."""
    rows = F.transform(F.filter("rows", lambda r: r.isNotNull()), lambda r: F.transform_values(r, lambda _, v: strip(F.coalesce(v, F.lit("")))))
    return tables.withColumn("rows", rows).where(F.size("rows") > 0)


def table_confidence(quality: Column) -> Column:
    return F.when(quality == "clean", "high").otherwise("medium")


def first_filled(cells: Column, keys: Sequence[str]) -> Column:
    """Value of the first of the keys that has one."""
    return F.coalesce(*[F.nullif(strip(F.try_element_at(cells, F.lit(k))), F.lit("")) for k in keys])


def cross_validate(rows: DataFrame, fields: DataFrame, labels: Mapping[str, Sequence[str]] = M.TABLE_LABELS, tolerance: float = M.CELL_TOLERANCE) -> DataFrame:
    """Table rows with field, cell_value, field_value and differs: the cell against the field its label names.

    rows: doc_id, ..., cells map<string,string>; fields: doc_id, field, raw_value.  Rows of
    unknown labels or without numbers have differs false.  Fields are never changed.
    """
    table = F.create_map(*[F.lit(x) for f, ns in labels.items() for n in ns for x in (n, f)])
    d = rows.withColumn("field", F.try_element_at(table, F.lower(strip(first_filled(F.col("cells"), LABEL_KEYS))))).withColumn("cell_value", table_money(first_filled(F.col("cells"), AMOUNT_KEYS)))
    known = fields.where(F.col("field").isin(*labels)).select("doc_id", "field", table_money(F.col("raw_value")).alias("field_value"))
    d = d.join(known, ["doc_id", "field"], "left")
    return d.withColumn("differs", F.coalesce(F.abs(F.col("cell_value") - F.col("field_value")) > tolerance, F.lit(False)))


def annotated(rows: DataFrame) -> DataFrame:
    """Rows of cross_validate() whose differing cells get a note, after a note that is there."""
    note = F.concat(F.lit("possible read error: field says "), F.format_number("field_value", 2))
    old = F.nullif(F.try_element_at("cells", F.lit("notes")), F.lit(""))
    cells = F.map_concat(F.map_filter("cells", lambda k, _: k != "notes"), F.create_map(F.lit("notes"), F.concat_ws("; ", old, note)))
    return rows.withColumn("cells", F.when(F.col("differs"), cells).otherwise(F.col("cells")))
