import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import checks, classify, confidence, documents, names, resolve, review, tables
from paperloom.plans import demo
from paperloom.plans.engine import Engine, stored
from paperloom.sources import readers, writers
from paperloom.streaming import triggers

OCC = "doc_id string, field string, page int, ord long, value string, confidence string, confidence_reason string, evidence string"
CAND = "doc_id string, field string, value string, page int, date string, ord long, origin int"


def resolved(spark, occ, cand, pages=((),)):
    o = spark.createDataFrame([(d, f, p, i, v, c, None, None) for i, (d, f, p, v, c) in enumerate(occ)], OCC)
    c = spark.createDataFrame([(d, f, v, p, t, i, 0) for i, (d, f, v, p, t) in enumerate(cand)], CAND)
    cp = spark.createDataFrame([x for x in pages if x], "doc_id string, page int")
    return {(r.doc_id, r.field): r for r in resolve.resolve(o, c, cp).collect()}


def test_correction_winners(spark):
    cand = [
        ("r1", "f", "a", 2, "03/18/2026"), ("r1", "f", "b", 3, "03/01/2026"), ("r2", "f", "a", 2, "03/18/2026"), ("r2", "f", "b", 3, ""), ("r3", "f", "a", 2, ""), ("r3", "f", "b", 3, None),
        ("r4", "f", "a", 2, "1/1/26"), ("r4", "f", "b", 3, "01/01/2026"), ("r4b", "f", "a", 2, ""), ("r4b", "f", "b", 2, ""), ("r5", "f", "a", 2, "03/18/2026"), ("r5", "f", "b", 3, "2027-01-01"),
        ("r6", "ltv_original", "x", 2, "1/1/26"), ("r10", "f", "None", 2, ""), ("r12", "f", "z", 4, "1/1/26"), ("r13", "f", "z", 4, "1/1/26"),
    ]
    occ = [("r6", "ltv_original", 1, "80%", "high"), ("r8", "g", 1, "100", "low"), ("r8", "g", 1, "200", "high"), ("r9", "g", 1, "lo", "low"), ("r9", "g", 2, "hi", "high"), ("r13", "f", 3, "later", "high"), ("r13", "f", 2, "first", "high"), ("r1", "f", 2, "on", "high"), ("r1", "f", 5, "off", "high")]
    got = resolved(spark, occ, cand, [("r13", 2), ("r13", 3), ("r1", 2)])
    assert [got[d, "f"].raw_value for d in ("r1", "r2", "r3", "r4", "r4b", "r5", "r10")] == ["a", "a", "b", "b", "a", "a", "None"]
    assert got["r3", "f"].rule != got["r1", "f"].rule and got["r1", "f"].original_value == "off"
    assert got["r6", "ltv_original"].raw_value == "80%" and not got["r6", "ltv_original"].corrected
    assert got["r8", "g"].raw_value == "100" and (got["r9", "g"].raw_value, got["r9", "g"].confidence) == ("lo", "low")
    assert (got["r12", "f"].original_value, got["r12", "f"].original_page) == ("unknown", 1) and got["r13", "f"].original_value == "first"


def test_text_candidates_give_way(spark):
    pages = spark.createDataFrame([("d", 2, "ADDENDUM: value REVISED DOWNWARD to $586,500.00 on 01/02/2026, seen 04/02/2026"), ("d", 3, "value revised downward to $5"), ("e", 1, "plain $5"), ("e", 2, None)], "doc_id string, page int, text string")
    got = resolve.text_candidates(pages)
    assert {(r.doc_id, r.page, r.field, r.value, r.date) for r in got.collect()} == {("d", 2, "appraised_value", "$586,500.00", "04/02/2026"), ("d", 3, "appraised_value", "$5", None)}
    told = spark.createDataFrame([("d", "appraised_value", "$1", 2, "", 0), ("d", "", "$1", 3, "", 0), ("d", "appraised_value", " ", 3, "", 0)], "doc_id string, field string, value string, page int, date string, ord int")
    assert sorted((r.page, r.origin) for r in resolve.candidates(told, got).collect()) == [(2, 0), (3, 1)]


def flags(spark, check, values):
    f = spark.createDataFrame([("d", k, v) for k, v in values.items()], "doc_id string, field string, raw_value string")
    return [(r.field, round(r.difference, 2), r.severity, r.missing) for r in check(f).collect()]


def test_sums(spark):
    base = {"origination_charges": "4860", "services_borrower_did_not_shop": "1,240", "services_borrower_shopped": "$500"}
    assert flags(spark, checks.sum_checks, base | {"total_loan_costs": "6600"}) == []
    assert flags(spark, checks.sum_checks, base | {"total_loan_costs": "6602"}) == [("total_loan_costs", 2.0, "error", [])]
    assert flags(spark, checks.sum_checks, base | {"total_loan_costs": "6601.01"}) == [("total_loan_costs", 1.01, "error", [])]
    assert flags(spark, checks.sum_checks, base | {"total_loan_costs": "6600", "services_borrower_did_not_shop": "?"}) == [("total_loan_costs", 1240.0, "error", ["services_borrower_did_not_shop"])]
    assert flags(spark, checks.sum_checks, {"total_loan_costs": "5"}) == []
    once = flags(spark, checks.sum_checks, base | {"total_loan_costs": "6600", "total_other_costs": "1", "total_closing_costs": "9"})
    assert [f for f, *_ in once].count("total_closing_costs") == 1


def test_generic_and_ratio(spark):
    assert flags(spark, checks.generic_totals, {"total_x": "100", "a": "40", "b": "50"}) == [("total_x", 10.0, "warning", [])]
    assert flags(spark, checks.generic_totals, {"total_x": "100", "a": "40", "b": "60"}) == [] == flags(spark, checks.generic_totals, {"total_x": "100", "a": "40"})
    assert flags(spark, checks.generic_totals, {"total_x": "100", **{f"p{i}": "1" for i in range(7)}}) == []
    loan = {"loan_amount": "480000", "appraised_value": "600000"}
    for v in ("80%", "0.8", "80.6"):
        assert flags(spark, checks.ratio_checks, loan | {"ltv_original": v}) == []
    assert flags(spark, checks.ratio_checks, loan | {"ltv_original": "1"}) == [("ltv_original", 20.0, "error", [])]
    assert flags(spark, checks.ratio_checks, loan | {"ltv_original": "10", "ltv_revised": "?"}) == []


def test_tables(spark):
    raw = spark.createDataFrame([("d", 1, 1, [["Item", "", "Item"], ["a", "b", "c"], [None, "", None]]), ("d", 1, 2, [["x"]])], "doc_id string, page int, table_ord int, rows array<array<string>>")
    rows = tables.header_rows(raw)
    assert [(r.name, r.cells) for r in rows.collect()] == [("Parsed Table 1 (p1)", {"Item": "c", "col_1": "b"})]
    assert tables.new_tables(rows, rows).count() == 0
    cells = spark.createDataFrame([("d", {"label": "Prepaids", "amount": "$1,000.00", "notes": "poc"}), ("d", {"Item": "prepaids", "value": "1001"}), ("d", {"label": "what", "amount": "1"}), ("d", {"label": "", "Description": "prepaids", "Cost": "x"})], "doc_id string, cells map<string,string>")
    fields = spark.createDataFrame([("d", "prepaids", "$1,002.00")], "doc_id string, field string, raw_value string")
    got = tables.annotated(tables.cross_validate(cells, fields)).collect()
    noted = [r for r in got if r.differs]
    assert len(noted) == 1 and noted[0].cells["notes"].startswith("poc; ") and len(got) == 4
    usable = spark.createDataFrame([("d", [{"a": " x "}, None]), ("d", [])], "doc_id string, rows array<map<string,string>>")
    assert [r.rows for r in tables.usable_tables(usable).collect()] == [[{"a": "x"}]]


@pytest.mark.parametrize(
    ("conf", "value", "page", "out"),
    [("high", "x", 1, "medium"), ("high", "$5", 2, "medium"), ("high", "x", 2, "medium"), ("medium", "x", 1, "low"), ("medium", "$5", 2, "medium"), ("low", "x", 1, "low"), ("high", "$5", 1, "high"), ("?", "$5", 1, "medium")],
)
def test_confidence(spark, conf, value, page, out):
    f = spark.createDataFrame([("d", "prepaids", value, page, conf, "old")], "doc_id string, field string, raw_value string, source_page int, confidence string, confidence_reason string")
    p = spark.createDataFrame([("d", 1, False, "clean"), ("d", 2, True, "clean"), ("d", 2, True, "clean")], "doc_id string, page int, has_degraded_text boolean, text_quality string")
    r = confidence.adjust(f, p).collect()
    assert len(r) == 1 and r[0].confidence == out and (r[0].confidence_reason is None) == (out == "high")


def test_types(spark):
    pages = [("n", 1, "promissory note i promise to pay note holder"), ("u", 1, None), ("x", 1, ""), ("s", 1, "the sales"), ("s", 2, "comparison approach"), ("m", 1, "promissory note i promise to pay note holder")]
    df = spark.createDataFrame(pages, "doc_id string, page int, text string")
    told = spark.createDataFrame([("x", "X", "high"), ("m", "Other", "low")], "doc_id string, told_type string, told_confidence string")
    got = {r.doc_id: r for r in classify.classify(df, told).collect()}
    assert (got["n"].doc_type, got["n"].confidence, got["n"].best_score) == ("Promissory Note", "high", 7)
    assert (got["u"].doc_type, got["u"].confidence) == ("Unknown", "low") and (got["x"].doc_type, got["x"].confidence) == ("X", "high")
    assert got["m"].confidence == "medium" and got["s"].best_score == 3


def test_names(spark):
    df = spark.createDataFrame([("Recording Fee",), ("Loan-Number",), ("poc_amount",), ("consummation_date",), ("zzz",), (None,), ("vec",)], "name string")
    near = spark.createDataFrame([("vec", "nmls")], "name string, canonical string")
    got = {r.name: (r.canonical, r.layer) for r in names.resolve_names(df, semantic=near).collect()}
    assert got == {"Recording Fee": ("taxes_and_govt_fees", "alias"), "Loan-Number": ("loan_number", "schema"), "poc_amount": ("loan_amount", "fuzzy"), "consummation_date": ("inspection_date", "fuzzy"), "zzz": ("zzz", "key"), "vec": ("nmls", "semantic")}
    assert round(names.similarity("poc_amount", "loan_amount"), 1) == 76.2
    v = spark.createDataFrame([(1, [1.0, 0.1]), (2, [-1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0])], "id int, v array<double>")
    assert [(r.id, r.canonical) for r in names.nearest(v, [("a", [1, 0]), ("b", [0, 1])], "id", "v").collect()] == [(1, "a")]


def test_review(spark):
    f = spark.createDataFrame([("d", f"f{i}", "v", c, None, "e" * n, 1) for i, (c, n) in enumerate([("high", 5), ("medium", 401), ("low", 400), ("odd", 0)])], "doc_id string, field string, raw_value string, confidence string, confidence_reason string, evidence string, source_page int")
    assert [review.tasks(f, m).count() for m in ("low", "medium", "all")] == [2, 3, 4]
    assert {len(r.evidence) for r in review.tasks(f, "all").collect()} == {5, 401, 400, 0}
    ann = lambda v: {"completed_at": "t", "result": [{"from_name": "verdict", "value": {"choices": [v] if v else [], "text": []}}]}
    export = spark.createDataFrame([(1, [ann("correct"), ann("wrong")]), (2, [ann(None)]), (3, []), (4, [ann("correct")])], "task_id long, annotations array<struct<completed_at string, result array<struct<from_name string, value struct<choices array<string>, text array<string>>>>>>")
    assert {(r.task_id, r.verdict) for r in review.answers(export).collect()} == {(1, "wrong"), (4, "correct")}
    assert [r.task_id for r in review.answers(export, only_wrong=True).collect()] == [1]
    assert {r.verdict: r.n for r in review.verdict_counts(review.answers(export)).collect()} == {"wrong": 1, "correct": 1}


def test_corrections_over_time(spark, tmp_path):
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    rows = [(i, "f", day(n)) for i, n in enumerate([0, 10, 29, 45])] + [(9, "g", day(0))]
    df = spark.createDataFrame(rows, "id long, field string, at timestamp")
    assert [(r.day.isoformat(), r.n) for r in review.frequent_corrections(df).collect()] == [("2026-01-30", 3)]
    bad = spark.createDataFrame([(1, "prepaids", "$5", day(0)), (2, "prepaids", "$5", day(0)), (3, "prepaids", "5", day(0)), (4, "", "x", day(0)), (5, "f", "", day(0))], "id long, field string, value string, at timestamp")
    assert [r.problem for r in review.check_corrections(bad).orderBy("id").collect()] == [None, "repeat", "bad amount", "missing field", "missing value"]
    # the stream finds what the batch finds, late repeats included
    folder = tmp_path / "in"
    folder.mkdir()
    for k, part in enumerate([rows[:3], [*rows[3:], rows[2], (99, "z", day(90))]]):
        (folder / f"{k}.json").write_text("".join(json.dumps({"id": i, "field": f, "at": a.isoformat()}) + "\n" for i, f, a in part))
    q = triggers.frequent(triggers.read_corrections(spark, str(folder))).writeStream.format("memory").queryName("freq").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.field, r.n) for r in spark.table("freq").collect()}
    assert got == {("f", 3)}


def test_history_and_cache(spark):
    old = spark.createDataFrame([("d", "a", "1", "high"), ("d", "b", "1", "low"), ("d", "c", "1", "high"), ("d", "e", None, "high")], "doc_id string, field string, raw_value string, confidence string")
    new = spark.createDataFrame([("d", "a", "2", "high"), ("d", "b", "2", "high"), ("d", "e", None, "low")], "doc_id string, field string, raw_value string, confidence string")
    assert {(r.field, r.new_value) for r in review.changed_values(old, new).collect()} == {("a", "2"), ("c", None)}
    req = spark.createDataFrame([("k1",), ("k1",), ("k2",), ("k3",)], "key string")
    cache = spark.createDataFrame([("k2", dt.datetime(2026, 1, 1)), ("k3", dt.datetime(2025, 1, 1))], "key string, stored_at timestamp")
    assert {r.key for r in documents.cache_misses(req, cache, "2026-01-01 12:00:00").collect()} == {"k1", "k3"}
    al = spark.createDataFrame([("x", "f")], "name string, canonical string")
    assert review.extended_aliases(al, spark.createDataFrame([("x", "g"), ("y", "g"), (None, "g")], "name string, canonical string")).count() == 2


PAGE1 = {"page_type": "main", "is_correction_page": False, "text_quality": "clean", "extracted_fields": {"Recording Fee": {"value": "$100", "confidence": "low"}, "county tax": {"value": "$200", "confidence": "high"}, "Prepaids": {"value": "n/a"}, "borrower": {"value": "Ann", "confidence": "HIGH"}}, "tables": [{"name": None, "rows": [{"label": "prepaids", "amount": "$1"}]}], "detected_elements": [{"type": "seal", "description": "Round notary stamp", "confidence": "High"}, {"type": "stamp", "description": "No visible stamp"}]}
PAGE2 = {"is_correction_page": True, "correction_targets": [{"field": "recording fee", "corrected_value": "$150.00", "correction_date": "03/18/2026"}, {"field": "", "corrected_value": "x"}], "degraded_text_blocks": [{"location": "", "partial_text": ""}, {"partial_text": "abc", "confidence": "high"}]}


def test_engine(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Promissory Note. I promise to pay the note holder.\fADDENDUM of 04/02/2026")
    (tmp_path / "b.txt").write_bytes(b"x")
    raw = readers.read_pages(spark, str(tmp_path / "*.txt"))
    assert raw.count() == 3
    broken = readers.read_pages(spark, str(tmp_path / "b.txt"), splitter=lambda content: 1 / 0)
    assert broken.first().error.startswith("ZeroDivisionError") and broken.first().page is None
    doc = raw.where("filename = 'a.txt'").first().doc_id
    answers = spark.createDataFrame([(doc, 1, "```json\n" + json.dumps(PAGE1) + "\n```"), (doc, 2, json.dumps(PAGE2)[:-1])], "doc_id string, page int, response string")
    out = Engine(stored(answers)).run(raw)
    fields = {r.field: r for r in out.fields.where(F.col("doc_id") == doc).collect()}
    assert fields["taxes_and_govt_fees"].raw_value == "$150.00" and fields["taxes_and_govt_fees"].original_value == "$100"
    assert fields["borrower_name"].confidence == "medium" and "prepaids" not in fields
    assert [(r.element_type, r.confidence) for r in out.elements.collect()] == [("image", "medium")]
    assert [(r.location, r.confidence) for r in out.degraded_blocks.collect()] == [("unknown", "low")]
    assert {r.doc_id: r.doc_type for r in out.types.collect()}[doc] == "Promissory Note"
    assert out.corrections.count() == 1 and out.table_rows.first().name == "Table (p1)"
    nested = out.documents()
    assert nested.count() == 2
    writers.write_json(nested, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert readers.read_results(spark, str(tmp_path / "out")).count() >= 1


def engine_of(spark, *pages):
    raw = spark.createDataFrame([("d", i, "some words", None) for i in range(1, len(pages) + 1)] + [("bad", None, None, "ValueError: no file")], "doc_id string, page int, text string, error string")
    return Engine(stored(spark.createDataFrame([("d", i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(pages, 1)], "doc_id string, page int, response string"))).run(raw)


def test_odd_entries_take_nothing_with_them(spark):
    page = {
        "extracted_fields": {"a": {"value": " 1 "}, "b": "x", "c": {"value": None}, "d": {"value": 2.50, "confidence": None}, "e": ["y"], "": {"value": "9"}},
        "tables": ["t", {"rows": ["x", {"label": "y", "amount": None}, 5]}, {"name": "N", "rows": ["x"]}, {"name": "M"}], "detected_elements": [{"description": "Round stamp"}, 7, {"description": None, "type": "stamp"}],
        "degraded_text_blocks": [{}, "x", {"location": "", "partial_text": None}, {"location": "", "partial_text": ""}],
    }
    out = engine_of(spark, page, '[{"value": 1}]', "null", "")
    assert {(r.field, r.raw_value, r.confidence) for r in out.fields.collect()} == {("a", "1", "medium"), ("d", "2.5", "medium")}
    assert [(r.name, r.row_ord, r.cells) for r in out.table_rows.collect()] == [("Table (p1)", 0, {"label": "y", "amount": ""})]
    assert {(r.description, r.element_type) for r in out.elements.collect()} == {("Round stamp", "image"), ("None", "stamp")}
    assert {(r.location, r.partial_text) for r in out.degraded_blocks.collect()} == {("unknown", ""), ("", "None")}
    assert out.pages.count() == 4


@pytest.mark.parametrize(("flag", "is_correction"), [("true", True), ('"yes"', True), ('"false"', True), ("false", False), ("null", False), ("0", False), ('""', False), ("[]", False), ('{"x": 1}', True), ("1", True)])
def test_flags_by_truth(spark, flag, is_correction):
    out = engine_of(spark, f'{{"is_correction_page": {flag}, "correction_targets": [{{"field": "prepaids", "corrected_value": "$1"}}]}}')
    assert out.pages.first().is_correction_page is is_correction and out.corrections.count() == int(is_correction)


def test_absent_and_null_corrections(spark):
    target = [{"field": "prepaids"}, {"field": "nmls", "corrected_value": None}, "x", {"field": None, "corrected_value": "1"}, {"field": "loan_type", "corrected_value": "VA", "correction_date": "01/02/2026"}]
    out = engine_of(spark, {"extracted_fields": {"prepaids": {"value": "$5"}}}, {"is_correction_page": True, "correction_targets": target})
    assert {(r.field, r.raw_value, r.corrected) for r in out.fields.collect()} == {("prepaids", "$5", False), ("nmls", "None", True), ("loan_type", "VA", True)}


def test_failed_documents_and_empty_children(spark):
    out = engine_of(spark, {})
    types = {r.doc_id: r for r in out.types.collect()}
    assert (types["bad"].doc_type, types["bad"].confidence, types["bad"].reason) == ("Unknown", "low", "ValueError: no file")
    rows = {r.doc_id: r for r in out.documents().collect()}
    assert rows["bad"].fields == [] == rows["d"].mismatches and len(rows) == 2
    assert {r.doc_id: (r.n_pages, r.n_tables) for r in out.counts().collect()} == {"d": (1, 0), "bad": (0, 0)}


def test_parsed_tables_and_told_types(spark):
    raw = spark.createDataFrame([("d", 2, "x", [[["Item", "Cost"], ["prepaids", "$1"]], [["A"], ["b"]]]), ("d", 1, "y", None)], "doc_id string, page int, text string, tables array<array<array<string>>>")
    answers = spark.createDataFrame([("d", 2, '{"page_type": "main", "extracted_fields": {"b": 1, "a": {}}, "tables": [{"name": "Parsed Table 2 (p2)", "rows": [{"x": "1"}]}]}')], "doc_id string, page int, response string")
    told = lambda s: s.select("doc_id", F.concat_ws(",", F.transform("pages", lambda p: F.concat_ws("/", p["page"].cast("string"), p["page_type"], F.array_join(p["fields"], "+")))).alias("told_type"), F.lit("high").alias("told_confidence"))
    out = Engine(stored(answers), classifier=told).run(raw)
    assert {(r.name, r.cells.get("Item"), r.confidence) for r in out.table_rows.collect()} == {("Parsed Table 2 (p2)", None, "medium"), ("Parsed Table 1 (p2)", "prepaids", "high")}
    assert out.types.first().doc_type == "1/unknown/,2/main/b+a"


def test_form_faults(spark):
    rows = [(1, "correct", None), (2, "wrong", "1"), (3, "wrong", " "), (4, "Wrong", "1"), (5, None, "1"), (6, "unsure", "2"), (7, "", None)]
    got = review.form_faults(spark.createDataFrame(rows, "id long, verdict string, corrected_value string"))
    assert {r.id: r.fault for r in got.collect()} == {3: "no corrected value", 4: "unknown verdict", 5: "no verdict", 6: "needless corrected value", 7: "no verdict"}


def test_json_files(spark, tmp_path):
    rows = spark.createDataFrame([(2, None), (1, "é\n\"")], "id int, note string")
    writers.write_json_array(rows, str(tmp_path / "all"))
    writers.write_json_array(rows.limit(0), str(tmp_path / "none"))
    text = lambda name: "".join(p.read_text("utf-8") for p in (tmp_path / name).glob("part-*"))
    assert json.loads(text("all")) == [{"id": 1, "note": "é\n\""}, {"id": 2, "note": None}] and json.loads(text("none")) == []
    (tmp_path / "r1.json").write_text('{"document_type": "X", "fields": {"a": {"raw_value": "1", "source_page": 2}}}')
    (tmp_path / "r2.json").write_text("no")
    got = {r.filename: r.result for r in readers.read_results(spark, str(tmp_path / "r*.json")).collect()}
    assert got["r1.json"].fields["a"].source_page == 2 and got["r2.json"] is None


def test_corrections_without_a_time_are_no_repeats(spark):
    rows = [(1, "f", "x", None), (2, "f", "x", None), (3, "f", "x", dt.datetime(2026, 1, 1)), (4, "f", "x", dt.datetime(2026, 1, 1)), (5, None, "x", None)]
    got = review.check_corrections(spark.createDataFrame(rows, "id long, field string, value string, at timestamp")).orderBy("id").collect()
    assert [r.problem for r in got] == [None, None, None, "repeat", "missing field"]


def test_broadcasts_by_bytes(spark, monkeypatch):
    from paperloom import common

    few = spark.createDataFrame([("x" * 50_000, [1, 2])], "k string, xs array<int>")
    assert common.broadcast_if_small(few) is not few
    monkeypatch.setattr(common, "BROADCAST_BYTES", 10_000)
    assert common.broadcast_if_small(few) is few


def test_empty_inputs(spark):
    none = resolve.resolve(spark.createDataFrame([], OCC), spark.createDataFrame([], CAND), spark.createDataFrame([], "doc_id string, page int"))
    assert none.count() == 0 and checks.all_checks(none).count() == 0
    assert documents.counts(none, fields=none).count() == 0


def test_signal_over_a_page_break_of_each_scan(spark):
    # a page was scanned three times; a signal starts on each scan and goes on on the next page
    scans = ["this is a loan", "you pay it before you", "the projected"]
    rows = [("d", 1, t) for t in scans] + [("d", 2, x) for x in ("estimate of costs", "close the sale", "payments table")]
    signals = {"A": {"loan estimate": True}, "B": {"before you close": True}, "C": {"projected payments": True}}
    got = {r.doc_type: r.score for r in classify.scores(spark.createDataFrame(rows, "doc_id string, page int, text string"), signals).collect()}
    assert got == {"A": 3, "B": 3, "C": 3}


def test_labels_over_the_bound_are_an_error(spark, tmp_path):
    rows = spark.range(10_001).select(F.col("id").alias("vec_id"), F.col("id").cast("string").alias("label"), F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    with pytest.raises(ValueError, match="labels"):
        demo.name_semantic(spark, str(tmp_path))
