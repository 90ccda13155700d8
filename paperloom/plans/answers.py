"""Page answers made from the domain's tables, for the queries that run the whole engine.

A page says what field_values and degraded_blocks record of it, as a model would answer: with
absent and null keys, flags that are texts or numbers, entries of odd shapes, code fences,
stray text and cut ends.  Which page or entry takes which form follows its id, so that SQL can
tell the outcome without reading any answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.common import table
from paperloom.functions import keys as K
from paperloom.plans.engine import Engine, Result, stored

_KEEP = {"ignoreNullFields": "false"}


def raw_pages(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, page, page_id, text: of several scans of a page the one of the smallest id."""
    p = table(spark, d, "page_analyses").select(K.clean_document_id(F.col("document_id")).alias("doc_id"), F.col("page_number").alias("page"), "page_id", F.coalesce("raw_text", F.lit("")).alias("text"))
    one = p.where("doc_id is not null and page is not null").groupBy("doc_id", "page").agg(F.min(F.struct("page_id", "text")).alias("x"))
    return one.select("doc_id", "page", "x.page_id", "x.text")


def _json(**parts: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]), _KEEP)


def _form(key: str, n: int, **forms: str) -> Column:
    """A part of an answer by the remainder of the page's id, null (absent) for others."""
    out = F.when(F.lit(False), "")
    for rest, text in forms.items():
        out = out.when(F.col("page_id") % n == int(rest[1:]), F.lit(f'"{key}":{text}'))
    return out


def answers(spark: SparkSession, d: str, pages: DataFrame) -> DataFrame:
    """doc_id, page, response of five pages of six."""
    v = table(spark, d, "field_values").select(
        K.clean_document_id(F.col("document_id")).alias("doc_id"), "field", K.clean_field_name(F.col("field")).alias("clean"), "fv_id", "raw_value", "confidence", "confidence_reason", "evidence",
        "source_page", "corrected", "correction_page", "correction_date",
    ).where("field is not null")
    # a page's fields are as many as one page holds
    plain = v.where("not corrected").groupBy("doc_id", F.col("source_page").alias("page"), "field").agg(F.min(F.struct("fv_id", "raw_value", "confidence", "confidence_reason", "evidence", "clean")).alias("x"))
    form = F.col("x.fv_id") % 10
    said = _json(value=F.col("x.raw_value"), confidence=F.col("x.confidence"), confidence_reason=F.col("x.confidence_reason"), evidence=F.col("x.evidence"))
    entry = F.when(form == 7, F.lit('"x"')).when(form == 8, F.lit('{"confidence":"high"}')).when(form == 9, F.lit('{"value":null}')).otherwise(said)
    quoted = F.regexp_replace(F.to_json(F.array("field")), r"^\[|\]$", "")
    row = _json(label=F.translate("x.clean", "_", " "), amount=F.col("x.raw_value"))
    sorted_ = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id"), c.alias("j")))), lambda s: s["j"]), ",")
    fields = plain.withColumn("id", F.col("x.fv_id")).groupBy("doc_id", "page").agg(sorted_(F.concat(quoted, F.lit(":"), entry)).alias("fields"), sorted_(row).alias("rows"))
    told = v.where("corrected").withColumn("id", F.col("fv_id"))
    form = F.col("fv_id") % 7
    target = F.when(form == 0, _json(field=F.col("field"), correction_date=F.col("correction_date"))).when(form == 1, _json(field=F.col("field"), corrected_value=F.lit(None).cast("string"), correction_date=F.col("correction_date")))
    target = target.when(form == 2, F.lit('"x"')).otherwise(_json(field=F.col("field"), corrected_value=F.col("raw_value"), correction_date=F.col("correction_date")))
    targets = told.groupBy("doc_id", F.col("correction_page").alias("page")).agg(sorted_(target).alias("targets"))
    seen = v.where("evidence is not null").withColumn("id", F.col("fv_id"))
    kind = F.element_at(F.array(F.lit(None).cast("string"), F.lit("stamp"), F.lit("seal")), (F.col("fv_id") % 3 + 1).cast("int"))
    element = F.when(F.col("fv_id") % 11 == 0, F.lit('"x"')).otherwise(F.to_json(F.struct(kind.alias("type"), F.col("evidence").alias("description"), F.when(F.col("fv_id") % 2 == 1, F.col("confidence")).alias("confidence"))))
    elements = seen.groupBy("doc_id", F.col("source_page").alias("page")).agg(sorted_(element).alias("elements"))
    b = table(spark, d, "degraded_blocks").select(K.clean_document_id(F.col("document_id")).alias("doc_id"), "page", F.col("block_id").alias("id"), F.to_json(F.struct("location", "partial_text", "reason", "confidence")).alias("j"))
    blocks = b.groupBy("doc_id", "page").agg(sorted_(F.col("j")).alias("blocks"))
    out = pages.where("page_id % 6 <> 0")
    for side in (fields, targets, elements, blocks):
        out = out.join(side, ["doc_id", "page"], "left")
    part = lambda key, c, a, z: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{key}":{a}'), F.col(c), F.lit(z)))
    named = F.when(F.col("page_id") % 2 == 1, F.lit('"name":"Fees",')).otherwise("")
    body = F.concat_ws(
        ",", _form("page_type", 4, r1='"main"', r2='"addendum"'), _form("is_correction_page", 5, r1="null", r2="true", r3='"yes"', r4="false"), _form("has_degraded_text", 3, r1="0", r2="1"),
        _form("text_quality", 4, r1='"noisy"', r2='"Clean"', r3='"degraded"'), part("extracted_fields", "fields", "{", "}"), part("correction_targets", "targets", "[", "]"), part("detected_elements", "elements", "[", "]"),
        F.when(F.col("rows").isNotNull(), F.concat(F.lit('"tables":["x",{'), named, F.lit('"rows":["x",'), F.col("rows"), F.lit(']},{"rows":[]}]'))), part("degraded_text_blocks", "blocks", "[", "]"), F.lit('"guard":[{"g":1}],"end":1'),
    )
    j = F.concat(F.lit("{"), body, F.lit("}"))
    form = F.col("page_id") % 7
    wrapped = F.when(form == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(form == 1, F.concat(F.lit("note "), j, F.lit(" end"))).when(form == 2, F.concat(F.lit("{"), body)).otherwise(j)
    return out.select("doc_id", "page", wrapped.alias("response"))


def told_types(summaries: DataFrame) -> DataFrame:
    """A classifier that goes by the summaries alone: the first page's type, and the number of pages."""
    kind = F.when(F.col("pages")[0]["page_type"] == "main", "Deed of Trust").when(F.col("pages")[0]["page_type"] == "addendum", "Closing Disclosure").otherwise("Other")
    sure = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.size("pages") % 3 + 1)
    return summaries.where(F.size("pages") % 4 > 0).select("doc_id", kind.alias("told_type"), sure.alias("told_confidence"))


def result(spark: SparkSession, d: str) -> Result:
    """The engine's result over all pages, with one unreadable document for every unit of measure."""
    pages = raw_pages(spark, d)
    failed = table(spark, d, "measure_units").select(F.concat(F.lit("err-"), F.col("unit_code")).alias("doc_id"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("ValueError: "), F.col("unit_code")).alias("error"))
    raw = pages.select("doc_id", "page", "text", F.lit(None).cast("string").alias("error")).unionByName(failed)
    return Engine(stored(answers(spark, d, pages)), fuzzy=False, classifier=told_types).run(raw)


def engine_pages(spark, d):
    return result(spark, d).pages.select("doc_id", "page", "dpi", "text_quality", "has_degraded_text", "is_correction_page", "page_type", F.md5("text").alias("digest"))


def engine_fields(spark, d):
    f, n = result(spark, d).fields, F.col("normalized")
    return f.select("doc_id", "field", "raw_value", "source_page", "confidence", "confidence_reason", "corrected", "original_value", "original_page", "correction_page", "correction_date", "rule", n["kind"].alias("kind"), n["num"].alias("num"), n["str"].alias("str"))


def engine_corrections(spark, d):
    return result(spark, d).corrections


def engine_table_rows(spark, d):
    r, cell = result(spark, d).table_rows, lambda k: F.try_element_at("cells", F.lit(k))
    return r.select("doc_id", "page", "table_ord", "name", "confidence", "row_ord", cell("label").alias("label"), cell("amount").alias("amount"), cell("notes").alias("notes"), "field", "differs")


def engine_elements(spark, d):
    return result(spark, d).elements.select("doc_id", "page", "element_type", "description", "confidence")


def engine_blocks(spark, d):
    return result(spark, d).degraded_blocks.drop("ord")


def engine_mismatches(spark, d):
    r = lambda c: F.round(c, 4).alias(c)
    return result(spark, d).mismatches.select("doc_id", "check", "field", r("stated"), r("computed"), r("difference"), "severity", F.array_join("components", ",").alias("components"), F.array_join("missing", ",").alias("missing"))


def engine_summaries(spark, d):
    s = result(spark, d).summaries.select("doc_id", F.explode("pages").alias("p"))
    return s.select("doc_id", "p.page", "p.page_type", F.array_join("p.fields", "|").alias("fields"), "p.is_correction_page")


def engine_types(spark, d):
    return result(spark, d).types


def engine_counts(spark, d):
    return result(spark, d).counts()


def engine_documents(spark, d):
    """The nested view of every document, its arrays by size and digest."""
    n = result(spark, d).documents()
    return n.select("doc_id", "doc_type", "confidence", *[F.size(c).alias(f"n_{c}") for c in ("fields", "corrections", "table_rows", "elements", "degraded_blocks", "mismatches")], F.md5(F.array_join(F.array_sort(F.transform("fields", lambda x: x["field"])), "|")).alias("digest"))


QUERIES = {f.__name__: f for f in (engine_pages, engine_fields, engine_corrections, engine_table_rows, engine_elements, engine_blocks, engine_mismatches, engine_summaries, engine_types, engine_counts, engine_documents)}
