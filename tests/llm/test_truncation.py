import random

from paperloom.llm import truncation as T

WORDS = "the committee minister proposal budget library harbour regional hospital transport funding report debate question chamber record answer evidence member sitting school".split()


def sentence(rnd):
    return " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(6, 14))).capitalize() + "."


def test_planted_cuts(spark):
    rnd = random.Random(11)
    rows, cut = [], set()
    for i in range(1500):
        text = " ".join(sentence(rnd) for _ in range(rnd.randint(1, 12)))
        source = rnd.choice(["wide", "narrow", "free"])
        if source == "narrow" and len(text) > 400:
            text = text[:400] + rnd.choice(["", "…", " [...]"])
            cut.add(i)
        elif source == "free" and rnd.random() < 0.1:
            text = text[: rnd.randint(20, len(text) - 4)].rstrip(" .")
            if not text.endswith("."):
                cut.add(i)
        elif rnd.random() < 0.1:
            text += rnd.choice(["\nThe sitting resumed at 18.04", " [Interruption.]", " And so, Madam President …", " I have not finished —"])
        rows.append((i, source, text, "EN"))
    rows += [(5000, "free", None, ""), (5001, "free", "", ""), (5002, None, " \n ", ""), (5003, "free", "x" * 100_000, ""), (5004, None, "Done.", ""), (5004, None, "Done.", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, is_cut string")
    out = T.detect(docs)
    got = {r.doc_id for r in out.where("is_cut").collect() if r.doc_id < 5000}
    assert out.count() == len(rows)
    assert len(got & cut) >= 0.97 * len(cut) and len(got - cut) <= 0.03 * len(cut)
    assert not [r for r in out.collect() if r.doc_id in (5000, 5001, 5002, 5004) and r.is_cut]
    rates = {r.source: r for r in T.rates(out).collect()}
    assert rates["narrow"].rate > 0.2 and rates["wide"].n_cut == 0


def test_tokens(value):
    assert value(T._tokens, "Hello, Mr. X.\n\nAt 18.04 he") == ["hello", "mr", "¶", "x", "¶", "at", "#", "#", "he", "§"]


def test_empty(spark):
    assert T.detect(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0


def test_copies_make_no_formula(spark):
    rnd = random.Random(5)
    texts = [" ".join(sentence(rnd) for _ in range(rnd.randint(1, 12))) for _ in range(600)]
    rows = [(i, "free", t) for i, t in enumerate(texts)]
    # one text cut after a whole known word and delivered 200 times, and one that a limit cut, in 50 copies
    rows += [(10_000 + i, "free", texts[0] + " The unheard proposal of the committee") for i in range(200)]
    cuts = {t[:300] for t in (" ".join(sentence(rnd) for _ in range(12)) for _ in range(40)) if not t[:300].rstrip().endswith(".")}
    rows += [(20_000 + i, "narrow", t) for i, t in enumerate(sorted(cuts))]
    at_limit = (" ".join(sentence(rnd) for _ in range(12)))[:280].rsplit(". ", 1)[0] + ". "
    at_limit += ("The minister " + "of the chamber record " * 20)[: 300 - len(at_limit) - 7] + " record"
    rows += [(30_000 + i, "narrow", at_limit) for i in range(50)]
    # a heading delivered often is no limit of its source
    rows += [(40_000 + i, "free", "The sitting was suspended at 18.04") for i in range(50)]
    rows += [(50_000 + i, "free", t + "\nThe sitting was suspended at 18.04") for i, t in enumerate(texts[:30])]
    got = {r.doc_id: r.evidence for r in T.detect(spark.createDataFrame(rows, "doc_id long, source string, text string")).where("is_cut").collect()}
    assert {got.get(10_000 + i) for i in range(200)} == {"open"}
    assert {got.get(20_000 + i) for i in range(len(cuts))} == {"limit"}
    assert len(at_limit) == 300 and {got.get(30_000 + i) for i in range(50)} == {"limit"}
    assert not [i for i in got if i >= 40_000]


def test_word_parts_make_no_formula(spark):
    rnd = random.Random(6)
    texts = [" ".join(sentence(rnd) for _ in range(rnd.randint(1, 12))) for _ in range(300)]
    rows = [(i, "free", t + " That has been taken down.") for i, t in enumerate(texts)] + [(1000 + i, "free", t + " They take evidence.") for i, t in enumerate(texts)]
    # "has been take" ends eight different texts, in a word that the corpus knows
    rows += [(5000 + i, "free", t + " It has been take") for i, t in enumerate(texts[:8])]
    got = {r.doc_id for r in T.detect(spark.createDataFrame(rows, "doc_id long, source string, text string")).where("is_cut").collect()}
    assert got == set(range(5000, 5008))


def test_last_words_of_long_tokens(spark):
    long = "x" * 500
    texts = [f"the member said {long}", f"the member {'y' * 300} {'z' * 300}", "the member said " * 100 + "so", f"Order. The member {long}"]
    ends = T.endings(spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "id long, source string, text string"))
    hashes = [("member", "said", long), ("member", "y" * 300, "z" * 300), ("member", "said", "so"), ("the", "member", long)]
    want = {i: spark.createDataFrame([h], "a string, b string, c string").selectExpr("xxhash64(a, b, c)").first()[0] for i, h in enumerate(hashes)}
    assert {r.id: r.gram for r in ends.collect()} == want


def test_signs_add_up(spark):
    rnd = random.Random(9)
    texts = [" ".join(sentence(rnd) for _ in range(rnd.randint(6, 14))) for _ in range(400)]
    rows = [(i, "free", t) for i, t in enumerate(texts)] + [(1000 + i, "narrow", t[:300]) for i, t in enumerate(texts[:150]) if len(t) > 300]
    rows += [(5000, "free", texts[0] + " The committee minis"), (5001, "free", texts[0] + " The committee [...]")]
    got = {r.doc_id: r for r in T.detect(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert set(got[5000].signs) == {"prefix", "open"} and got[5000].evidence == "prefix"
    assert got[5001].signs[0] == "mark" and got[5001].score == T.START + T.WEIGHTS["mark"]
    narrow = [r for i, r in got.items() if 1000 <= i < 5000 and r.is_cut]
    assert len(narrow) > 100 and all("limit" in r.signs for r in narrow) and any({"limit", "prefix"} <= set(r.signs) for r in narrow)
    assert all(r.is_cut == (r.score > 0) for r in got.values())
