import random

from pyspark.sql import Row

from paperloom.llm.mixing import mix, plan_budgets

TARGETS = "source string, target_share double, max_repeats int"


def test_budgets():
    R = lambda s, t, m, a: Row(source=s, target_share=t, max_repeats=m, available=a)
    got = {b["source"]: b for b in plan_budgets([R("a", 0.5, 1, 1000), R("b", 0.25, 3, 100), R("c", 0.25, 2, None)])}
    assert got["c"]["budget"] == 0 and got["b"]["budget"] == 300 and got["b"]["copies"] == 3 and got["a"]["budget"] == 600 and got["a"]["part"] == 600
    assert plan_budgets([]) == []


def test_shares_caps_and_nesting(spark):
    rnd = random.Random(3)
    words = "the quick brown fox jumps over lazy dogs and cats".split()
    docs = [(i, rnd.choice(["big"] * 8 + ["small"] * 2), " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60)))) for i in range(3000)] + [(9001, "big", None), (9002, "big", ""), (9003, None, "x"), (9004, "other", "y z")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 3), ("none", 0.2, 5)], TARGETS)
    rows, report = mix(df, targets)
    rows, report = rows.collect(), {r.source: r for r in report.collect()}
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"big", "small"}
    for s, cap in (("big", 1), ("small", 3)):
        used = sum(r.n_tokens * r.copies for r in rows if r.source == s)
        assert used == report[s].used_tokens <= report[s].budget_tokens < used + 70 and max(r.copies for r in rows if r.source == s) <= cap
    assert abs(report["small"].actual_share - 0.6) < 0.01 and report["none"].used_tokens == 0
    fewer = {r.doc_id for r in mix(df, spark.createDataFrame([("big", 0.2, 1), ("small", 0.8, 3)], TARGETS))[0].collect() if r.source == "big"}
    assert fewer <= {r.doc_id for r in rows if r.source == "big"}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    rows, report = mix(docs, spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert rows.count() == 0 and report.first().used_tokens == 0
    rows, report = mix(docs, spark.createDataFrame([], TARGETS))
    assert rows.count() == 0 and report.count() == 0
