"""The whole way from page texts and page answers to resolved, checked and classified documents.

A page's answer is read entry by entry: what has an odd shape is skipped and takes nothing
else with it.  Null entries count as the text "None", as their sources write them; absent ones
have defaults.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.common import cut
from paperloom.functions import text as T
from paperloom.operators import checks, classify, confidence, documents, names, resolve, tables

#: A provider turns requests (doc_id, page, text, dpi) into answers (doc_id, page, response).
Provider = Callable[[DataFrame], DataFrame]
#: A classifier turns summaries (doc_id, pages) into told types (doc_id, told_type, told_confidence).
Classifier = Callable[[DataFrame], DataFrame]

_MAP, _LIST = "map<string,string>", "array<string>"


def stored(answers: DataFrame) -> Provider:
    """The provider that looks answers up."""
    return lambda requests: requests.select("doc_id", "page").join(answers, ["doc_id", "page"], "left")


def _object(c: Column) -> Column:
    """Entries of a JSON object as texts, null for anything else."""
    return F.when(c.startswith("{"), F.from_json(c, _MAP))


def _objects(c: Column) -> Column:
    """The objects among the entries of a JSON list, with their places; empty for anything else."""
    entries = F.coalesce(F.when(c.startswith("["), F.from_json(c, _LIST)), F.array().cast(_LIST))
    placed = F.transform(entries, lambda x, i: F.struct(i.alias("ord"), _object(x).alias("o")))
    return F.filter(placed, lambda s: s["o"].isNotNull())


def _said(o: Column, key: str, default: str) -> Column:
    """An entry's text: "None" where it is null, the default where it is absent."""
    return F.when(F.map_contains_key(o, F.lit(key)), F.coalesce(F.try_element_at(o, F.lit(key)), F.lit("None"))).otherwise(F.lit(default))


def _flag(answer: Column, key: str, default: Column) -> Column:
    """Truth of a present entry: null, false, 0 and empty ones are false, all others true, also the text "false"."""
    v = F.try_variant_get(answer, f"$.{key}", "variant")
    kind, s = F.schema_of_variant(v), F.try_variant_get(answer, f"$.{key}", "string")
    truth = (
        F.when(kind == "VOID", F.lit(False))
        .when(kind == "BOOLEAN", s == "true")
        .when(kind == "STRING", s != "")
        .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~F.to_json(v).isin("[]", "{}"))
        .otherwise(F.coalesce(s.try_cast("double") != 0, F.lit(True)))
    )
    return F.when(kind.isNull(), default).otherwise(truth)


@dataclass
class Engine:
    provider: Provider
    word_rules: bool = True
    fuzzy: bool = True
    semantic: DataFrame | None = None
    told_types: DataFrame | None = None
    classifier: Classifier | None = None

    def run(self, raw_pages: DataFrame) -> Result:
        """Everything about the documents of raw_pages(doc_id, page, text [, tables, error]).

        A row without a page is a document that could not be read: its type is Unknown, of low
        confidence, with the error as reason.  tables are those a parser found on the page.
        """
        readable = raw_pages.where("page is not null")
        extra = [c for c in ("tables",) if c in raw_pages.columns]
        pages = readable.select(
            "doc_id", "page", *extra, T.strip(F.coalesce("text", F.lit(""))).alias("raw_text"), T.render_dpi(F.col("text")).alias("dpi"),
            T.text_quality(F.col("text")).alias("rule_quality"), T.has_degraded_text(F.col("text")).alias("rule_degraded"), T.is_correction_page(F.col("text")).alias("rule_correction"),
        ).withColumn("text", T.clean_text(F.col("raw_text"), self.word_rules))
        answers = self.provider(pages.select("doc_id", "page", "text", "dpi")).withColumn("answer", T.json_object(F.col("response")))
        # parsed once: five explodes read it
        read = answers.select("doc_id", "page", F.from_json("answer", _MAP).alias("a"), F.try_parse_json("answer").alias("v"))
        joined = pages.join(read, ["doc_id", "page"], "left")
        quality = F.try_element_at("a", F.lit("text_quality"))
        p = cut(joined.select(
            "doc_id", "page", *extra, "raw_text", "text", "dpi", "a", T.coerce(quality, T.M.TEXT_QUALITIES, F.col("rule_quality")).alias("text_quality"),
            _flag(F.col("v"), "is_correction_page", F.col("rule_correction")).alias("is_correction_page"), _flag(F.col("v"), "has_degraded_text", F.col("rule_degraded")).alias("has_degraded_text"),
            _flag(F.col("v"), "is_correction_page", F.lit(False)).alias("told_correction"), F.coalesce(F.try_element_at("a", F.lit("page_type")), F.lit("unknown")).alias("page_type"),
        ))
        part = lambda key: F.try_element_at("a", F.lit(key))
        pages = p.select("doc_id", "page", "raw_text", "text", "dpi", "is_correction_page", "text_quality", "has_degraded_text", "page_type")
        entries = F.transform(F.map_entries(F.coalesce(_object(part("extracted_fields")), F.create_map().cast(_MAP))), lambda e, i: F.struct(i.alias("pos"), e["key"].alias("name"), _object(e["value"]).alias("o")))
        found = p.select("doc_id", "page", F.explode(F.filter(entries, lambda e: (e["name"] != "") & e["o"].isNotNull())).alias("e"))
        found = found.select("doc_id", "page", "e.pos", "e.name", T.strip(_said(F.col("e.o"), "value", "")).alias("value"), _said(F.col("e.o"), "confidence", "medium").alias("confidence"), F.try_element_at("e.o", F.lit("confidence_reason")).alias("confidence_reason"), F.try_element_at("e.o", F.lit("evidence")).alias("evidence"))
        found = resolve.occurrences(found.withColumn("field", F.col("name"))).drop("field")
        seen = found.groupBy("doc_id", "name").agg(F.min(F.struct("page", "pos")).alias("first"))
        targets = p.where("is_correction_page").select("doc_id", "page", F.explode(_objects(part("correction_targets"))).alias("t"))
        targets = targets.select("doc_id", "page", "t.ord", F.try_element_at("t.o", F.lit("field")).alias("name"), T.strip(_said(F.col("t.o"), "corrected_value", "")).alias("value"), F.coalesce(F.try_element_at("t.o", F.lit("correction_date")), F.lit("")).alias("date")).where("name <> ''")
        resolved = cut(names.resolve_names(found.select("name").unionByName(targets.select("name")), semantic=self.semantic, fuzzy=self.fuzzy))
        occ = names.with_canonical(found, resolved, "name").join(seen, ["doc_id", "name"])
        occ = occ.select("doc_id", "page", F.struct(F.col("first.page").alias("p"), F.col("first.pos").alias("o"), "pos").alias("ord"), F.col("canonical").alias("field"), "value", T.coerce(F.col("confidence"), T.M.CONFIDENCES, "medium").alias("confidence"), "confidence_reason", "evidence")
        told = names.with_canonical(targets, resolved, "name").select("doc_id", F.col("canonical").alias("field"), "value", "page", "date", "ord")
        every = resolve.candidates(told, resolve.text_candidates(pages.select("doc_id", "page", "text")))
        fields = resolve.resolve(occ, every, pages.where("is_correction_page").select("doc_id", "page"))
        fields = cut(fields.withColumn("normalized", T.normalized_value(F.col("field"), F.col("raw_value"))))
        rows = self._tables(p, part)
        elements = p.select("doc_id", "page", F.explode(_objects(part("detected_elements"))).alias("e")).withColumn("description", T.strip(_said(F.col("e.o"), "description", "")))
        elements = elements.where(~T.is_absent_element(F.col("description"))).select(
            "doc_id", "page", "e.ord", T.coerce(_said(F.col("e.o"), "type", "image"), T.M.ELEMENT_TYPES, "image").alias("element_type"), "description", T.coerce(_said(F.col("e.o"), "confidence", "medium"), T.M.CONFIDENCES, "medium").alias("confidence"),
        )
        blocks = p.select("doc_id", "page", F.explode(_objects(part("degraded_text_blocks"))).alias("b"))
        blocks = blocks.select(
            "doc_id", "page", "b.ord", T.strip(_said(F.col("b.o"), "location", "unknown")).alias("location"), T.strip(_said(F.col("b.o"), "partial_text", "")).alias("partial_text"),
            _said(F.col("b.o"), "reason", "degraded scan").alias("reason"), T.coerce(_said(F.col("b.o"), "confidence", "low"), ("medium", "low"), "low").alias("confidence"),
        ).where("partial_text <> '' or location <> ''")
        summaries = documents.page_summaries(p.select("doc_id", "page", "page_type", F.coalesce(F.map_keys(_object(part("extracted_fields"))), F.array().cast(_LIST)).alias("fields"), F.col("told_correction").alias("is_correction_page")))
        types = classify.classify(pages.select("doc_id", "page", "text"), self.classifier(summaries) if self.classifier else self.told_types)
        types = types.withColumn("reason", F.lit(None).cast("string"))
        if "error" in raw_pages.columns:
            failed = raw_pages.where("page is null").groupBy("doc_id").agg(F.min("error").alias("reason")).join(readable.select("doc_id").distinct(), "doc_id", "left_anti")
            types = types.unionByName(failed.select("doc_id", F.lit("Unknown").alias("doc_type"), F.lit("low").alias("confidence"), F.lit(0).cast("long").alias("best_score"), F.lit(0).cast("long").alias("second_score"), "reason"))
        return Result(
            pages=pages, fields=confidence.adjust(fields, pages), corrections=resolve.correction_records(fields), table_rows=tables.annotated(tables.cross_validate(rows, fields)),
            elements=elements, degraded_blocks=blocks, mismatches=checks.all_checks(fields), types=types, summaries=summaries,
        )

    def _tables(self, p: DataFrame, part: Callable[[str], Column]) -> DataFrame:
        """Rows of the answers' tables, then of the parsed ones whose name the page doesn't have yet."""
        cells = lambda s: F.transform_values(s["o"], lambda _, v: T.strip(F.coalesce(v, F.lit(""))))
        t = p.select("doc_id", "page", "text_quality", F.explode(_objects(part("tables"))).alias("t"))
        t = t.select("doc_id", "page", "text_quality", F.col("t.ord").alias("table_ord"), F.try_element_at("t.o", F.lit("name")).alias("name"), F.transform(_objects(F.try_element_at("t.o", F.lit("rows"))), cells).alias("rows")).where(F.size("rows") > 0)
        default = F.concat(F.lit("Table (p"), F.col("page").cast("string"), F.lit(")"))
        rows = t.select("doc_id", "page", "table_ord", F.coalesce("name", default).alias("name"), tables.table_confidence(F.col("text_quality")).alias("confidence"), F.posexplode("rows").alias("row_ord", "cells"))
        if "tables" not in p.columns:
            return rows
        raw = p.select("doc_id", "page", F.posexplode("tables").alias("k", "rows")).withColumn("table_ord", F.col("k") + 1)
        parsed = tables.new_tables(tables.header_rows(raw), rows)
        return rows.unionByName(parsed.select("doc_id", "page", F.lit(None).cast("int").alias("table_ord"), "name", "confidence", "row_ord", "cells"))


@dataclass
class Result:
    pages: DataFrame
    fields: DataFrame
    corrections: DataFrame
    table_rows: DataFrame
    elements: DataFrame
    degraded_blocks: DataFrame
    mismatches: DataFrame
    types: DataFrame
    summaries: DataFrame

    def documents(self) -> DataFrame:
        """The nested export view, one row a document."""
        return documents.nested(
            self.types, fields=self.fields, corrections=self.corrections, table_rows=self.table_rows.withColumn("cells", F.to_json("cells")), elements=self.elements,
            degraded_blocks=self.degraded_blocks, mismatches=self.mismatches,
        )

    def counts(self) -> DataFrame:
        """doc_id and the number of pages, fields, tables, corrections and mismatches of every document."""
        one = self.table_rows.select("doc_id", "page", "table_ord", "name").distinct()
        return documents.counts(self.types, pages=self.pages, fields=self.fields, tables=one, corrections=self.corrections, mismatches=self.mismatches)
