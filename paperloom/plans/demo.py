"""The reference operators' queries over the domain's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.common import table
from paperloom.functions import keys as K
from paperloom.functions import text as T
from paperloom.operators import checks, classify, confidence, documents, names, nested, resolve, review, tables
from paperloom.rules import mortgage as M


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_analyses")
    return p.select(K.clean_document_id(F.col("document_id")).alias("doc_id"), F.col("page_number").alias("page"), "page_id", "filename", F.coalesce("raw_text", F.lit("")).alias("text"), F.col("is_correction_page"), F.col("has_degraded_text"), F.lower(K.strip(F.col("text_quality"))).alias("text_quality"))


def field_rows(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "field_values")
    return v.select(
        K.clean_document_id(F.col("document_id")).alias("doc_id"), K.clean_field_name(F.col("field")).alias("field"), F.col("source_page").alias("page"), F.col("fv_id").alias("ord"), F.col("raw_value").alias("value"),
        T.coerce(F.lower(K.strip(F.col("confidence"))), M.CONFIDENCES, "medium").alias("confidence"), "confidence_reason", "evidence", "corrected", "correction_page", "correction_date",
    )


def resolved_fields(spark: SparkSession, d: str) -> DataFrame:
    rows, pages = field_rows(spark, d), page_texts(spark, d)
    told = rows.where("corrected").select("doc_id", "field", "value", F.col("correction_page").alias("page"), F.col("correction_date").alias("date"), "ord")
    told = told.where(~T.is_null_like(F.col("value"))).where(F.col("page").isNotNull()).withColumn("origin", F.lit(0))
    plain = resolve.occurrences(rows.where("not corrected").select("doc_id", "field", "page", "ord", "value", "confidence", "confidence_reason", "evidence"))
    return resolve.resolve(plain, told, pages.where("is_correction_page").select("doc_id", "page"))


def clean_text(spark, d):
    c = T.clean_text(F.col("text"))
    return page_texts(spark, d).select("page_id", F.md5(c).alias("digest"), F.length(c).alias("n"))


def page_grades(spark, d):
    t = F.col("text")
    return page_texts(spark, d).select("page_id", T.render_dpi(t).alias("dpi"), T.text_quality(t).alias("quality"), T.has_degraded_text(t).alias("degraded"), T.is_correction_page(t).alias("correction"))


def page_report(spark, d):
    return page_texts(spark, d).select("doc_id", "page", "page_id", "text_quality", "has_degraded_text", "is_correction_page", F.length("text").alias("n_chars"))


def absent_elements(spark, d):
    v = table(spark, d, "field_values")
    return v.where(T.is_absent_element(F.col("evidence"))).select("fv_id")


def coerced_enums(spark, d):
    v = table(spark, d, "field_values")
    return v.select("fv_id", T.coerce(F.col("confidence"), M.CONFIDENCES, "medium").alias("confidence"), T.normalize_key(F.col("field")).alias("key"))


def parsed_values(spark, d):
    v, c = table(spark, d, "field_values"), F.col("raw_value")
    day = T.date_tuple(c)
    return v.select("fv_id", T.money(c).alias("money"), T.percent(c).alias("pct"), T.date_text(c).alias("day"), T.table_money(c).alias("cell"), T.check_money(c).alias("checked"), day["y"].alias("y"), day["m"].alias("m"), day["d"].alias("d"))


def normalized_fields(spark, d):
    n = T.normalized_value(F.col("field"), F.col("value"))
    return field_rows(spark, d).select(F.col("ord").alias("fv_id"), n["kind"].alias("kind"), n["num"].alias("num"), n["str"].alias("str"))


def format_failures(spark, d):
    return field_rows(spark, d).select(F.col("ord").alias("fv_id"), T.format_fails(F.col("field"), F.col("value")).alias("bad"))


def name_exact(spark, d):
    v = table(spark, d, "field_values")
    return names.resolve_names(v, "field", fuzzy=False).groupBy("key", "canonical", "layer").agg(F.count(F.lit(1)).alias("n_spellings"))


def name_fuzzy(spark, d):
    v = table(spark, d, "field_values")
    return names.resolve_names(v, "field")


#: Labels of the vocabulary that the driver takes; more are an error.
LABELS = 10_000


def name_semantic(spark, d):
    e = table(spark, d, "embeddings")
    # the vocabulary: the first vector of each label, as many as there are labels
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id")).join(e.select("vec_id", "embedding"), "vec_id").orderBy("label").limit(LABELS + 1).collect()
    if len(first) > LABELS:
        raise ValueError(f"more than {LABELS} labels: the vocabulary doesn't fit the driver")
    got = names.nearest(e, [(str(r.label), list(r.embedding)) for r in first], "vec_id", "embedding")
    return got.select("vec_id", "canonical", F.round("score", 4).alias("score"))


def first_occurrence(spark, d):
    rows = resolve.occurrences(field_rows(spark, d))
    return rows.groupBy("doc_id", "field").agg(F.min(F.struct("page", "ord", "value")).alias("f")).select("doc_id", "field", "f.page", F.col("f.ord").alias("fv_id"), "f.value")


#: A pattern of this data beside the rule pack's.
DEMO_PATTERNS = (("replaced_amount", r"(?i)addendum\s+replaces\s+the\s+earlier\s+amount\s+of\s+\$([\d,]+\.\d{2})", "$", ""),)


def text_corrections(spark, d):
    pages = page_texts(spark, d).select(F.col("page_id").cast("string").alias("doc_id"), "page", "text")
    return resolve.text_candidates(pages, (*M.REVISION_PATTERNS, *DEMO_PATTERNS)).select(F.col("doc_id").cast("long").alias("page_id"), "field", "value", "date", "ord")


def corrections(spark, d):
    return resolve.correction_records(resolved_fields(spark, d))


GENERIC_FIELDS = ("total_closing_costs", "total_loan_costs", "origination_charges", "prepaids", "escrow_deposit", "taxes_and_govt_fees", "monthly_escrow")


def mismatches(kind: str) -> Callable:
    def run(spark, d):
        f = resolved_fields(spark, d)
        # the data has no ratio fields, and only totals that other checks know: rates stand in, and every total is generic
        rates = f.withColumn("field", F.when(F.col("field") == "note_rate", "ltv_revised").when(F.col("field") == "interest_rate", "ltv_original").otherwise(F.col("field")))
        got = {"sum": lambda: checks.sum_checks(f), "generic": lambda: checks.generic_totals(f.where(F.col("field").isin(*GENERIC_FIELDS)), known=()), "ratio": lambda: checks.ratio_checks(rates), "all": lambda: checks.all_checks(rates)}[kind]()
        r = lambda c: F.round(c, 4).alias(c)
        return got.select("doc_id", "check", "field", r("stated"), r("computed"), r("difference"), "severity", F.array_join("components", ",").alias("components"), F.array_join("missing", ",").alias("missing"))

    return run


def cross_validated(spark, d):
    got = nested.shred(table(spark, d, "extraction_results"), "result_id", "result_json").records
    root = got.where("child = '$'").select("doc_key", K.clean_document_id(F.element_at("attributes", F.lit("document_id"))).alias("doc_id"))
    rows = got.where("child = 'rows'").select("doc_key", "row", F.col("attributes").alias("cells")).join(root, "doc_key")
    out = tables.cross_validate(rows, resolved_fields(spark, d))
    return out.select(F.col("doc_key").alias("result_id"), "row", "doc_id", "field", "cell_value", "field_value", "differs")


def adjusted_confidence(spark, d):
    out = confidence.adjust(resolved_fields(spark, d), page_texts(spark, d))
    return out.select("doc_id", "field", "confidence", "confidence_reason")


def classified(spark, d):
    return classify.classify(page_texts(spark, d).dropDuplicates(["page_id"]).select("doc_id", "page", "text"))


def classify_summary(spark, d):
    return classified(spark, d).groupBy("doc_type", "confidence").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("best_score"), 6).alias("mean_score"))


def review_queue(spark, d):
    return review.tasks(resolved_fields(spark, d), "medium")


def verdict_summary(spark, d):
    r = table(spark, d, "import_corrections").select(F.lower(K.strip(F.col("reviewer_verdict"))).alias("verdict")).where("verdict is not null")
    return review.verdict_counts(r)


def override_rate(spark, d):
    r = table(spark, d, "import_corrections").select(F.substring_index("document", ".", 1).alias("k"), K.clean_field_name(F.col("field")).alias("field"), F.lower(K.strip(F.col("reviewer_verdict"))).alias("verdict")).where("verdict is not null")
    f = resolved_fields(spark, d).select("doc_id", "field", "confidence")
    return review.override_rate(r.withColumn("doc_id", F.substring_index("k", "_", -1)).join(f, ["doc_id", "field"]))


def latest_annotation(spark, d):
    return review.answers(_annotations(spark, d))


def cache_misses(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.md5("text").alias("key"))
    stored = table(spark, d, "documents").where("text is not null and lang = 'de'").select(F.md5("text").alias("key"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("stored_at"))
    return documents.cache_misses(docs, stored, "2026-01-01 12:00:00")


def frequent_corrections(spark, d):
    e = table(spark, d, "import_corrections").where("lower(trim(reviewer_verdict)) = 'wrong'")
    return review.frequent_corrections(e.select(F.col("review_id").alias("id"), K.clean_field_name(F.col("field")).alias("field"), F.col("reviewed_at").alias("at")))


def checked_corrections(spark, d):
    e = table(spark, d, "import_corrections").where("lower(trim(reviewer_verdict)) = 'wrong'")
    return review.check_corrections(e.select(F.col("review_id").alias("id"), K.clean_field_name(F.col("field")).alias("field"), F.col("reviewer_corrected_value").alias("value"), F.when(F.col("review_id") % 9 > 0, F.col("reviewed_at")).alias("at"))).select("id", "problem")


def changed_values(spark, d):
    old = resolved_fields(spark, d)
    new = old.withColumn("raw_value", F.when(F.col("field") == "loan_type", F.upper("raw_value")).otherwise(F.col("raw_value"))).where("field <> 'nmls'")
    return review.changed_values(old, new)


def document_counts(spark, d):
    pages, f = page_texts(spark, d), resolved_fields(spark, d)
    return documents.counts(pages, pages=pages, fields=f, corrections=f.where("corrected"))


def field_report(spark, d):
    f = resolved_fields(spark, d)
    n = T.normalized_value(F.col("field"), F.col("raw_value"))
    return f.select("doc_id", T.display_name(F.col("field")).alias("field_display"), F.col("raw_value").alias("value"), n["kind"].alias("kind"), "source_page", "corrected", T.shorten(F.col("evidence"), 80).alias("evidence"))


def json_recovery(spark, d):
    e = table(spark, d, "events")
    cut = F.when(F.col("event_id") % 3 == 0, F.expr("left(props, length(props) - 1)")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).otherwise(F.concat(F.lit("note "), F.col("props"), F.lit(" end")))
    return e.select("event_id", T.repaired_json(cut, "k long")["k"].alias("k"))


def json_arms(spark, d):
    """Answers cut in each of the ways that recovery knows, and one that it doesn't."""
    e, k = table(spark, d, "events"), F.regexp_extract("props", r"(-?\d+)", 1)
    forms = ('{"k": %, "a": {"b": 1', '{"k": %, "a": 1', '{"k": %, "b": "tru', '{"a": 1, "c": {"k": %, "b": "tru', 'note {"k": %, "a": {"b": 1} so', "[%]", '{"k": %, "b": ["x", "y"')
    made = F.element_at(F.array(*[F.concat(*[x for i, part in enumerate(f.split("%")) for x in ([k] if i else []) + [F.lit(part)]]) for f in forms]), (F.col("event_id") % len(forms) + 1).cast("int"))
    got = T.repaired_json(made, "k long, c struct<k long>")
    return e.select("event_id", F.coalesce(got["k"], got["c"]["k"]).alias("k"))


def _annotations(spark, d):
    """Answers packed as an annotation export, a task's annotations in order."""
    r = table(spark, d, "import_corrections")
    one = lambda n, c, k: F.struct(F.lit(n).alias("from_name"), F.struct((F.array(c) if k == "choices" else F.array().cast("array<string>")).alias("choices"), (F.array(c) if k == "text" else F.array().cast("array<string>")).alias("text")).alias("value"))
    entry = F.struct(F.col("reviewed_at").cast("string").alias("completed_at"), F.col("review_id"), F.array(one("verdict", F.lower(K.strip(F.col("reviewer_verdict"))), "choices"), one("corrected_value", F.col("reviewer_corrected_value"), "text"), one("reviewer_notes", F.col("reviewer_notes"), "text")).alias("result"))
    # a task's answers are as many as it has reviewers
    return r.groupBy("task_id").agg(F.array_sort(F.collect_list(entry)).alias("annotations"))


def wrong_answers(spark, d):
    return review.answers(_annotations(spark, d), only_wrong=True)


def form_faults(spark, d):
    r = table(spark, d, "import_corrections")
    return review.form_faults(r.select("review_id", F.col("reviewer_verdict").alias("verdict"), F.col("reviewer_corrected_value").alias("corrected_value"))).select("review_id", "fault")


def extended_aliases(spark, d):
    """The rule pack's aliases with the spellings that reviewers met, by the clean name."""
    known = spark.createDataFrame([(n, f) for f, ns in M.ALIASES.items() for n in ns], "name string, canonical string")
    r = table(spark, d, "import_corrections").where("lower(trim(reviewer_verdict)) = 'wrong'")
    return review.extended_aliases(known, r.select(F.lower(F.trim("field_display")).alias("name"), K.clean_field_name(F.col("field")).alias("canonical")))


def added_tables(spark, d):
    """Rows of parsed tables on pages whose answer has no table of that name."""
    p = page_texts(spark, d).where("page is not null")
    parsed = tables.header_rows(_label_lines(p))
    present = p.where("page_id % 3 = 0").select(F.col("page_id").cast("string").alias("doc_id"), "page", F.concat(F.lit("Parsed Table 1 (p"), F.col("page").cast("string"), F.lit(")")).alias("name"))
    return tables.new_tables(parsed, present).select(F.col("doc_id").cast("long").alias("page_id"), "name", "row_ord", "confidence", F.element_at("cells", F.lit("Item")).alias("item"), F.element_at("cells", F.lit("col_1")).alias("amount"))


def low_confidence(spark, d):
    """the resolved fields of low confidence after adjustment."""
    return confidence.adjust(resolved_fields(spark, d), page_texts(spark, d)).where("confidence = 'low'").select("doc_id", "field", "raw_value")


def cache_keys(spark, d):
    """Keys under which answers about pages are stored: model, content and prompt."""
    return page_texts(spark, d).select("page_id", T.cache_key(F.lit("m1"), F.col("text"), F.concat(F.lit("page "), F.coalesce(F.col("page").cast("string"), F.lit("?")))).alias("key"), T.document_key(F.coalesce("filename", F.lit(""))).alias("doc_key"))


def document_rollup(spark, d):
    """Resolved fields of each document: counts by confidence and the sum of its amounts."""
    f = resolved_fields(spark, d)
    n = lambda c: F.count(F.when(F.col("confidence") == c, 1)).alias(f"n_{c}")
    return f.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_fields"), n("high"), n("medium"), n("low"), F.count(F.when(F.col("corrected"), 1)).alias("n_corrected"), F.sum(T.check_money(F.when(F.col("field").isin(*M.MONEY_FIELDS), F.col("raw_value"))).cast("decimal(18,2)")).alias("amounts"))


def failure_classes(spark, d):
    r = table(spark, d, "field_values")
    msg = F.concat(F.element_at(F.array(*map(F.lit, ("HTTP 429", "model not_found", "503 busy", "401 denied", "odd"))), (F.col("fv_id") % 5 + 1).cast("int")), F.lit(" at "), F.coalesce("feed", F.lit("none")))
    return r.groupBy(T.error_class(msg).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def _label_lines(p: DataFrame) -> DataFrame:
    """Pages' label and amount lines as raw tables, keyed by a header row."""
    rows = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^([A-Z][A-Za-z ]+?) {3,}(\$[0-9,.]+)$"), F.lit(0)), lambda s: F.split(s, " {3,}"))
    return p.select(F.col("page_id").cast("string").alias("doc_id"), F.coalesce("page", F.lit(0)).alias("page"), F.lit(1).alias("table_ord"), F.concat(F.array(F.array(F.lit("Item"), F.lit(""))), rows).alias("rows"))


def header_tables(spark, d):
    out = tables.header_rows(_label_lines(page_texts(spark, d)))
    return out.select(F.col("doc_id").cast("long").alias("page_id"), "name", "row_ord", F.element_at("cells", F.lit("Item")).alias("item"), F.element_at("cells", F.lit("col_1")).alias("amount"))


def classified_sources(spark, d):
    """Rows by source and language of the documents, the generic group count."""
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


QUERIES = {
    "classify_summary": classify_summary, "classified": classified, "clean_text": clean_text, "page_grades": page_grades, "page_report": page_report, "absent_elements": absent_elements,
    "coerced_enums": coerced_enums, "parsed_values": parsed_values, "normalized_fields": normalized_fields, "format_failures": format_failures, "name_exact": name_exact, "name_fuzzy": name_fuzzy,
    "name_semantic": name_semantic, "first_occurrence": first_occurrence, "text_corrections": text_corrections, "resolved_fields": resolved_fields, "corrections": corrections,
    "sum_mismatches": mismatches("sum"), "generic_totals": mismatches("generic"), "ratio_mismatches": mismatches("ratio"), "all_mismatches": mismatches("all"), "cross_validated": cross_validated,
    "adjusted_confidence": adjusted_confidence, "review_queue": review_queue, "verdict_summary": verdict_summary, "override_rate": override_rate, "latest_annotation": latest_annotation,
    "cache_misses": cache_misses, "frequent_corrections": frequent_corrections, "checked_corrections": checked_corrections, "changed_values": changed_values, "document_counts": document_counts,
    "field_report": field_report, "json_recovery": json_recovery, "failure_classes": failure_classes, "header_tables": header_tables, "json_arms": json_arms, "wrong_answers": wrong_answers, "form_faults": form_faults, "extended_aliases": extended_aliases,
    "added_tables": added_tables, "low_confidence": low_confidence, "cache_keys": cache_keys, "document_rollup": document_rollup, "document_sources": classified_sources,
}
