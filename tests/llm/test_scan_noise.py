import itertools
import random

import numpy as np

from paperloom.llm import scan_noise as S

SCHEMA = "origin string, record_id long, page int, whole boolean, text string, KIND string"
BODY = "the settlement statement requires confirmation that every recorded easement was transferred electronically before the final amendment and the refundable deposit remains unverified pending departmental approval of the municipality".split()


def pages(n=160):
    rnd, rows, truth = random.Random(2), [], set()
    for i in range(n):
        page, lines = rnd.randint(1, 9), []
        head = rnd.choice([f"File LN-{rnd.randint(1000, 9999)}  Corvane Home Loans", "Loan Estimate — Confidential — Page 1 of 9", "PROMISSORY NOTE"])
        if rnd.random() < 0.8:
            lines.append(head)
            truth.add(("page", i, len(lines), "header"))
        for _ in range(rnd.randint(6, 12)):
            words = [rnd.choice(BODY) for _ in range(8)]
            lines.append(" ".join(words))
            if rnd.random() < 0.15:
                lines[-1] = lines[-1].rsplit(" ", 1)[0] + " trans-"
                lines.append("ferred " + " ".join(words))
                truth.add(("page", i, len(lines) - 1, "hyphen"))
            elif rnd.random() < 0.15:
                lines[-1] += " " + rnd.choice(["rccorded", "ea5ement", "arnendment", "c0nfirmation", "$1,O00.00"])
                truth.add(("page", i, len(lines), "char"))
        lines[-1] += " third-party co-"
        lines.append("signer is named " + " ".join(rnd.choice(BODY) for _ in range(5)))
        lines += [" ".join(rnd.choice(BODY) for _ in range(rnd.randint(3, 8))) for _ in range(2)]
        if rnd.random() < 0.7:
            lines.append(rnd.choice([str(page), f"Page {page}", f"- {page} -"]))
            truth.add(("page", i, len(lines), "pageno"))
        rows.append(("page", i, page, True, "\n".join(lines), "x"))
    return rows, truth


def test_planted_noise(spark):
    rows, truth = pages()
    rows += [("page", 900, 1, True, None, ""), ("page", 901, 1, True, "", ""), ("page", 902, None, True, " \n ", ""), ("block", 1, None, False, "the rccorded easement", ""), ("page", 903, 2, True, "word " * 40_000, "")]
    texts = spark.createDataFrame(rows, SCHEMA)
    noise = S.find_noise(texts)
    got = {(r.origin, r.record_id, r.line_no, r.kind) for r in noise.collect()}
    for kind in ("header", "pageno", "hyphen", "char"):
        t, g = {x for x in truth if x[3] == kind}, {x for x in got if x[3] == kind and x[1] < 900 and x[0] == "page"}
        assert len(t & g) >= 0.95 * len(t) and len(g - t) <= 0.05 * len(t), kind
    assert ("block", 1, 1, "char") in got
    both = {(o, r, n) for o, r, n, k in got if k in ("header", "pageno")}
    assert not [x for x in got if x[:3] in both and x[3] in ("hyphen", "char")]
    fixed = {(r.origin, r.record_id): r.text for r in S.repair(texts, noise).collect()}
    assert fixed["page", 900] is None and fixed["page", 901] == "" and len(fixed["page", 903]) > 190_000
    assert fixed["block", 1] == "the recorded easement" and not any("trans-" in (t or "") for t in fixed.values())


def test_reassemble():
    text = "HEAD\nThe rccorded deposit is trans-\nferred to the third-\nparty.\n\nNew part\n7"
    noise = [(1, "header", None, None), (2, "hyphen", "trans-ferred", "transferred"), (2, "char", "rccorded", "recorded"), (7, "pageno", None, None)]
    assert S.reassemble(text, noise) == "The recorded deposit is transferred to the third- party.\nNew part"


def test_undone():
    assert {"daily", "recorded"} <= {*S._undone("dally"), *S._undone("rccorded")} and "titles" in S._undone("ti+1es")


def test_empty(spark):
    assert S.find_noise(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_recur_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE", 40)
    rows, _ = pages(400)
    rnd, truth = random.Random(3), set()
    # twenty wordings that look like body lines and recur at the top of six pages each
    wordings = [" ".join(rnd.sample(BODY, 7)) for _ in range(20)]
    for i in range(120):
        o, rid, page, whole, text, x = rows[i]
        rows[i] = (o, rid, page, whole, wordings[i % 20] + "\n" + "\n".join(text.split("\n")[1:]), x)
        truth.add((rid, 1))
    got = {(r.record_id, r.line_no) for r in S.find_noise(spark.createDataFrame(rows, SCHEMA)).where("kind = 'header'").collect()}
    assert len(truth & got) >= 0.95 * len(truth)


def test_batched_paths_are_the_best_ones():
    rnd = np.random.default_rng(3)
    step, start = np.log(rnd.dirichlet(np.ones(5), 5)), np.log(rnd.dirichlet(np.ones(5)))
    sizes = np.array([3, 0, 1, 4, 2, 4])
    own = rnd.normal(size=(sizes.sum(), 5))
    for cells in (1, 5, 1000):
        got, at = S.viterbi(own, sizes, step, start, cells), 0
        for n in sizes:
            if n:
                score = lambda y, e=own[at : at + n]: start[y[0]] + sum(e[i, k] for i, k in enumerate(y)) + sum(step[a, b] for a, b in zip(y, y[1:], strict=False))
                assert tuple(got[at : at + n]) == max(itertools.product(range(5), repeat=int(n)), key=score)
            at += n


def test_paragraphs_follow_the_labels(spark):
    rows, _ = pages(200)
    para = "the settlement statement requires confirmation that\nevery recorded easement was transferred.\nThe refundable deposit remains unverified pending departmental\napproval of the municipality.\n\nThe amendment follows the final\n\nstatement of the municipality before the deposit"
    rows += [("page", 1000 + i, 3, True, f"PROMISSORY NOTE\n{para}\nPage 3", "x") for i in range(60)]
    texts = spark.createDataFrame(rows, SCHEMA)
    text = {r.record_id: r.text for r in S.repair(texts, S.find_noise(texts)).collect()}[1003]
    # a blank line within a sentence divides nothing, and neither header nor page number is left
    assert "PROMISSORY" not in text and "Page 3" not in text
    assert "requires confirmation that every recorded easement" in text and "\nThe amendment follows" in text


def test_the_sample_does_not_grow_with_tasks(spark, monkeypatch):
    seen = []
    train = S.train
    monkeypatch.setattr(S, "SAMPLE", 50)
    monkeypatch.setattr(S, "train", lambda entries: seen.append(len(entries)) or train(entries))
    texts = spark.createDataFrame(pages(300)[0], SCHEMA)
    for tasks in (2, 60):
        S.fit_lines(texts.repartition(tasks), S.recurring_lines(texts))
    assert seen[0] == seen[1] and 20 <= seen[0] <= 100


def test_long_tokens_and_words_are_judged(spark):
    common = "arrangement consideration " * 40
    rows = [("page", i, 1, True, common, "") for i in range(5)]
    rows += [("page", 50, 1, True, "x " * 300 + "c0nsideration at the end", ""), ("page", 51, 1, True, "9" * 5000 + " and " + "w" * 20_000, ""), ("page", 52, 1, True, "arrange–\nment here", "")]
    got = {(r.record_id, r.line_no, r.kind) for r in S.find_noise(spark.createDataFrame(rows, SCHEMA)).where("kind in ('char', 'hyphen')").collect()}
    assert got == {(50, 1, "char"), (52, 1, "hyphen")}
