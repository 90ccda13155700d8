from paperloom.llm import personal as P

FIRST, LAST = {"nojes", "griv", "zirn"}, {"soumot", "subriamern", "mazarov"}


def found(text):
    return {(k, text[a:b]) for k, a, b, _, _ in P.propose(text, FIRST, LAST)}


def test_spans():
    assert found("Sent by Mr. Subriamern <a.b+home@mailbox.example> with") == {("NAME", "Subriamern"), ("EMAIL", "a.b+home@mailbox.example")}
    assert found("call +1 (555) 555-0182 or 1-555-555-0177 or (555)555-0167 ext. 94 or 5555550164.") >= {("PHONE", "+1 (555) 555-0182"), ("PHONE", "1-555-555-0177"), ("PHONE", "(555)555-0167 ext. 94"), ("PHONE", "5555550164")}
    assert found("write to fat_bro (at)\ninbox.test. The") == {("EMAIL", "fat_bro (at)\ninbox.test")}
    assert found("write\nto siatus.m.rakiv+home [at] post\n[dot] example [dot] org. The") == {("EMAIL", "siatus.m.rakiv+home [at] post\n[dot] example [dot] org")}
    assert ("ADDRESS", "Flat 19, 4496 East Giselul St. #41, Zougallton,\nYK 00031") in found("premises at Flat 19, 4496 East Giselul St. #41, Zougallton,\nYK 00031 were")
    assert ("ADDRESS", "P.O. Box 949, Zuloth Heights, QX 00978") in found("to P.O. Box 949, Zuloth Heights, QX 00978 until")
    assert found("SSN 666-24-7788, TIN 981001246, DL No. X406-6755-93, Passport No. XQ7018356") >= {("ID", "666-24-7788"), ("ID", "981001246"), ("ID", "X406-6755-93"), ("ID", "XQ7018356")}
    assert found("Loan No. 4481-20-3388, LN-8200-A97, NMLS 975828, File Ref. 2026-0542-77, $1,234.00 on 06/13/2026") == set()
    assert found("by SOUMOT, GRIV D and Zirn\nMazarov in the presence") == {("NAME", "SOUMOT, GRIV D"), ("NAME", "Zirn\nMazarov")}
    assert found("Contact Soumot, Griv at") == {("NAME", "Soumot, Griv")} and found("Contact G. Soumot at") == {("NAME", "G. Soumot")} and found("Contact Griv Soumot at") == {("NAME", "Griv Soumot")}
    assert found("") == set() and found("x" * 100_000) == set()


def test_reliabilities_follow_the_votes():
    p = P.reliabilities([("NAME", "++000++0", 400), ("NAME", "+0000+00", 60), ("NAME", "--0-000-", 50), ("NAME", "0+0-0000", 5)])
    assert p["NAME", "++000++0"] > 0.99 and p["NAME", "--0-000-"] < 0.1


def test_whole_way(spark):
    names = spark.createDataFrame([(v,) for v in ["Nojes Soumot", "SOUMOT, NOJES D", "Mr. Mazarov", "Zirn Mazarov", "Zirn B. Mazarov", None, "N/A", "Griv Subriamern", "Griv Subriamern"]], "raw_value string")
    parts = P.name_parts(names, "raw_value")
    assert {r.part for r in parts.collect()} == {"nojes", "soumot", "mazarov", "zirn", "griv", "subriamern"}
    line = "Inquiries: Nojes Soumot, telephone 555-555-0107, or write to nsoumot@mail.example.\nSSN: 666-13-1565 at the counter. Sent to 584 Tusind Street, Diakes, YK 00019 until"
    rows = [("page", i, f"{line}", "x") for i in range(40)] + [("page", 100, None, ""), ("page", 101, "", ""), ("field", 1, "Lender sheet of Corvane & Pell Finance gives Zirn Mazarov", ""), ("field", 1, "Lender sheet of Corvane & Pell Finance gives Zirn Mazarov", "")]
    texts = spark.createDataFrame(rows, "origin string, record_id long, text string, KIND string")
    got = P.find_personal(texts, parts)
    of = lambda o, i: {(r.kind, r.start_pos) for r in got.collect() if (r.origin, r.record_id) == (o, i)}
    at = lambda s: line.index(s) + 1
    assert of("page", 3) == {("NAME", at("Nojes")), ("PHONE", at("555-555")), ("EMAIL", at("nsoumot")), ("ID", at("666")), ("ADDRESS", at("584"))}
    assert of("page", 100) == of("page", 101) == set() and {k for k, _ in of("field", 1)} == {"NAME"}
    clean = {(r.origin, r.record_id): r.text for r in P.redact(texts.dropDuplicates(["origin", "record_id"]), got).collect()}
    assert clean["page", 3] == "Inquiries: [NAME], telephone [PHONE], or write to [EMAIL].\nSSN: [ID] at the counter. Sent to [ADDRESS] until" and clean["page", 100] is None
    assert clean["field", 1] == "Lender sheet of Corvane & Pell Finance gives [NAME]"


def test_empty(spark):
    texts = spark.createDataFrame([], "origin string, record_id long, text string")
    parts = P.name_parts(spark.createDataFrame([], "raw_value string"), "raw_value")
    assert P.find_personal(texts, parts).count() == 0


def some_texts(spark, n=300):
    line = "Inquiries: Nojes Soumot, telephone 555-555-01%02d, or write to nsoumot@mail.example. SSN: 666-13-15%02d. Contact Griv Subriamern."
    return spark.createDataFrame([("page", i, line % (i % 90, i % 90)) for i in range(n)], "origin string, record_id long, text string")


def test_gazetteer_by_join_or_by_worker(spark, monkeypatch):
    parts = P.name_parts(spark.createDataFrame([(v,) for v in ["Nojes Soumot", "Soumot, Nojes", "Griv Subriamern", "Griv Subriamern"]], "raw_value string"), "raw_value")
    texts = some_texts(spark, 40)
    small = {tuple(r[:5]) for r in P.spans(texts, parts).collect()}
    monkeypatch.setattr(P, "PARTS", 1)
    assert {tuple(r[:5]) for r in P.spans(texts, parts).collect()} == small and len([x for x in small if x[2] == "NAME"]) == 80


def test_the_sample_does_not_grow_with_tasks(spark, monkeypatch):
    seen = []
    fit = P.fit_classifier
    monkeypatch.setattr(P, "SAMPLE", 60)
    monkeypatch.setattr(P, "fit_classifier", lambda rows, posterior: seen.append(len(rows)) or fit(rows, posterior))
    parts = P.name_parts(spark.createDataFrame([(v,) for v in ["Nojes Soumot", "Nojes Soumot"]], "raw_value string"), "raw_value")
    texts = some_texts(spark)
    for tasks in (2, 60):
        assert P.find_personal(texts.repartition(tasks), parts).where("kind = 'ID'").count() == 300
    assert seen[0] == seen[1] and 30 <= seen[0] <= 120


def test_enough_counts_turn_a_belief(spark):
    # the second labeler's votes for come with votes against of three others only
    rows = [("NAME", "++++0", 4000), ("NAME", "-+---", 4000), ("NAME", "+0++0", 4000), ("NAME", "-0---", 300)]
    p = P.reliabilities(rows)
    assert p["NAME", "-+---"] < 0.05 < 0.95 < p["NAME", "+0++0"]
