import datetime as dt
import math
import random

from pyspark.sql import functions as F

from paperloom.llm import consensus as C


def test_digamma_and_trigamma(spark):
    x = [0.1, 0.5, 1.0, 2.5, 30.0, 1e4]
    rows = spark.createDataFrame([(v,) for v in x], "x double").select("x", C.digamma(F.col("x")).alias("p"), C.trigamma(F.col("x")).alias("t")).collect()
    for r in rows:
        h = 1e-4 * r.x
        assert abs(r.p - (math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h)) < 1e-3 * max(1, abs(r.p))
    one = next(r for r in rows if r.x == 1.0)
    assert abs(one.p + 0.5772156649) < 1e-7 and abs(one.t - math.pi**2 / 6) < 1e-7


def test_finds_spammers_and_adversaries(spark):
    rnd = random.Random(5)
    truth = {i: rnd.random() < 0.6 for i in range(600)}
    skill = {f"r{j}": p for j, p in enumerate([0.95, 0.9, 0.9, 0.85, 0.5, 0.5, 0.15])}
    rows = [(i, a, "correct" if (truth[i] == (rnd.random() < p)) else "wrong") for i in truth for a, p in skill.items() if rnd.random() < 0.7]
    rows += [(i, "yes", "correct") for i in truth]
    answers = spark.createDataFrame(rows, "item long, annotator string, label string")
    items = spark.createDataFrame([(i,) for i in [*truth, 9999]], "item long")
    got = C.fit(answers, items, C.VERDICTS)
    verdicts = {r.item: r.label for r in got.items.collect()}
    right = sum((verdicts[i] == "correct") == t for i, t in truth.items()) / len(truth)
    majority = {}
    for i, _, v in rows:
        majority[i] = majority.get(i, 0) + (1 if v == "correct" else -1)
    by_votes = sum((majority.get(i, 0) >= 0) == t for i, t in truth.items()) / len(truth)
    assert right > 0.95 and right > by_votes and verdicts[9999] == "correct" and len(verdicts) == 601
    rel = {r.annotator: r for r in got.annotators.collect()}
    assert rel["r6"].reliability < 0.3 < rel["r4"].reliability < 0.7 < rel["r0"].low and rel["yes"].recall_1 < 0.1
    assert all(r.low <= r.reliability <= r.high for r in rel.values())


def test_agreement(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, "a"), (3, "b"), (4, "a")]
    r = C.agreement(spark.createDataFrame(rows, "item int, label string")).first()
    # by hand: 6 values in pairs, observed 2/6, expected 2*3*3/(6*5)
    assert r.n_items == 3 and r.n_values == 6 and abs(r.alpha - (1 - (2 / 6) / (18 / 30))) < 1e-9
    assert C.agreement(spark.createDataFrame([(1, "a"), (1, "a")], "item int, label string")).first().alpha == 1.0
    assert C.agreement(spark.createDataFrame([], "item int, label string")).first().alpha is None


def test_latest_answers(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [(1, 1, "x", "correct", None, t), (2, 1, "x", " WRONG ", "5", t), (3, 1, "x", None, None, t + dt.timedelta(1)), (4, 2, "x", "wrong", "1", None), (5, 2, "x", "unsure", None, t), (6, 3, None, "wrong", "1", t), (7, 4, "y", "maybe", "", t)]
    df = spark.createDataFrame(rows, "review_id long, task_id long, reviewer string, reviewer_verdict string, reviewer_corrected_value string, reviewed_at timestamp")
    assert {(r.item, r.label, r.value) for r in C.latest_answers(df).collect()} == {(1, "wrong", "5"), (2, "unsure", None)}
    assert C.latest_answers(df.limit(0)).count() == 0


def test_values_in_several_spellings(value):
    k = lambda s: value(C.value_key, s)
    assert k("$2,310.00") == k("2310") == k("USD 2 310") and k("($5)") != k("5") and k("03/12/2025") == k("March 12, 2025") and k(" Single  Family") == k("single-family")


def test_no_answers(spark):
    empty = spark.createDataFrame([], "item long, annotator string, label string")
    got = C.fit(empty, spark.createDataFrame([(1,), (1,), (None,)], "item long"), C.VERDICTS, rounds=2)
    assert [r.label for r in got.items.collect()] == ["correct"] and got.annotators.count() == 0


def test_both_kinds_of_rounds_agree(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, f"r{a}", rnd.choice("xyz") if rnd.random() < 0.3 else "xyz"[i % 3]) for i in range(120) for a in range(7) if rnd.random() < 0.6] + [(500, "r1", "other"), (None, "r1", "x"), (501, None, "x")]
    answers = spark.createDataFrame(rows, "item long, annotator string, label string")
    items = answers.select("item")
    packed = C.fit(answers, items, ("x", "y", "z"))
    monkeypatch.setattr(C, "MAX_CELLS", 0)
    joined = C.fit(answers, items, ("x", "y", "z"))
    assert packed.rounds == joined.rounds > 2
    of = lambda df, key: {r[key]: [x if isinstance(x, str) else round(x, 9) for x in r if x is not r[key]] for r in df.collect()}
    assert of(packed.items, "item") == of(joined.items, "item") and of(packed.annotators, "annotator") == of(joined.annotators, "annotator")
