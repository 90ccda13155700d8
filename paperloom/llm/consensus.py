"""Consensus from several annotators' labels (problem 3).

A mean-field variational confusion model: Dirichlet priors on the classes and on the rows of
each annotator's confusion matrix, digamma updates.  The answers are shuffled once and packed
by item; a round is one scan of them, in which each task sums its expected confusion counts
before these are grouped by cell.  The only state between rounds is one matrix an annotator.
With more annotators than the driver should hold, rounds are joins and group-bys instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.common import broadcast_if_small, cut, join_dictionary
from paperloom.functions import keys as K

ROUNDS, TOLERANCE = 25, 5e-4
#: Dirichlet priors: classes; right and wrong answers of an annotator.
PRIOR_CLASS, PRIOR_RIGHT, PRIOR_WRONG = 1.0, 3.0, 1.0
#: Cells of all confusion matrices up to which the driver and each worker hold them, eight bytes each.
MAX_CELLS = 1_000_000


def digamma(x: Column) -> Column:
    """psi(x) for x > 0: six steps of the recurrence, then the asymptotic series."""
    y = x + 6
    steps = reduce(add, [1 / (x + i) for i in range(6)])
    z = 1 / (y * y)
    return F.ln(y) - 0.5 / y - z * (F.lit(1 / 12) - z * (F.lit(1 / 120) - z / 252)) - steps


def trigamma(x: Column) -> Column:
    """psi'(x) for x > 0, in the same way."""
    y = x + 6
    steps = reduce(add, [1 / ((x + i) * (x + i)) for i in range(6)])
    z = 1 / (y * y)
    return 1 / y + 0.5 * z + z / y * (F.lit(1 / 6) - z * (F.lit(1 / 30) - z / 42)) + steps


@dataclass
class Consensus:
    #: item, p0..pk-1 (posterior of each label), label
    items: DataFrame
    #: annotator, n_answers, reliability, low, high, and per label recall_<i>, low_<i>, high_<i>
    annotators: DataFrame
    rounds: int


def fit(answers: DataFrame, items: DataFrame, labels: Sequence[str], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Consensus:
    """Consensus of answers(item, annotator, label); one row for each row of items(item).

    At most one answer of an annotator to an item, labels among ``labels``; other rows
    are ignored.  An item without answers gets the class prior; of equal posteriors the
    earlier label holds.  Rounds end when no cell of the summed confusion counts
    moved by more than ``tolerance`` of the number of items, or after ``rounds``.  An empty table gives no rows.
    """
    size = len(labels)
    code = reduce(lambda c, i: c.when(F.col("label") == labels[i], i), range(size), F.when(F.lit(False), 0))
    given = answers.select("item", "annotator", code.alias("l")).where("l is not null and item is not null and annotator is not null")
    most = MAX_CELLS // (size * size)
    names = [r.annotator for r in given.select("annotator").distinct().limit(most + 1).collect()]
    run = _packed_rounds if len(names) <= most else _joined_rounds
    q, params, masses, done = run(given, sorted(names), size, max(1, rounds), tolerance)
    out = items.select("item").where("item is not null").distinct().join(q, "item", "left")
    base = [m / sum(masses) for m in masses]
    post = [F.coalesce(F.col(f"q{k}"), F.lit(base[k])) for k in range(size)]
    best = reduce(lambda c, k: c.when(reduce(lambda a, b: a & b, [post[k] >= p for p in post]), F.lit(labels[k])), range(size), F.when(F.lit(False), F.lit("")))
    result = out.select("item", *[post[k].alias(f"p{k}") for k in range(size)], best.alias("label"))
    return Consensus(result, _reliability(params, size, base), done)


#: Posteriors of the items, counts of the annotators, class masses, rounds.
Rounds = tuple[DataFrame, DataFrame, list[float], int]


def _packed_rounds(given: DataFrame, names: list, size: int, rounds: int, tolerance: float) -> Rounds:
    """Rounds as scans of the items, each with its answers in an array, at most one of each annotator."""
    spark, kind = given.sparkSession, given.schema["annotator"].dataType.simpleString()
    index = spark.createDataFrame([(a, i) for i, a in enumerate(names)], f"annotator {kind}, a int")
    coded = given.join(F.broadcast(index), "annotator").select("item", (F.col("a") * size + F.col("l")).alias("x"))
    packed = cut(coded.groupBy("item").agg(F.collect_list("x").alias("said")))
    item = packed.schema["item"].dataType.simpleString()
    many = len(names)

    def posteriors(said: pa.ListArray, logs: np.ndarray | None, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = said.value_lengths().to_numpy(zero_copy_only=False)
        at, x = np.repeat(np.arange(len(n)), n), said.flatten().to_numpy(zero_copy_only=False)
        if logs is None:  # majority vote with half a vote added for each label starts the posteriors
            votes = np.bincount(at * size + x % size, minlength=len(n) * size).reshape(-1, size) + 0.5
            return votes / votes.sum(axis=1, keepdims=True), at, x
        score = np.stack([np.bincount(at, weights=logs[x // size, k, x % size], minlength=len(n)) for k in range(size)], axis=1) + prior
        soft = np.exp(score - score.max(axis=1, keepdims=True))
        return soft / soft.sum(axis=1, keepdims=True), at, x

    def counted(logs: np.ndarray | None, prior: np.ndarray) -> np.ndarray:
        """Expected counts by annotator, true and given label, and below them the class masses."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(many * size * size + size)
            for batch in batches:
                q, at, x = posteriors(batch.column("said"), logs, prior)
                for k in range(size):
                    own = np.bincount(x, weights=q[at, k], minlength=many * size).reshape(many, size)
                    total[: many * size * size].reshape(many, size, size)[:, k, :] += own
                total[many * size * size :] += q.sum(axis=0)
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells])], names=["cell", "x"])

        total = np.zeros(many * size * size + size)
        # as many rows as there are cells
        for r in packed.select("said").mapInArrow(run, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():
            total[r.cell] = r.x
        return total

    logs, prior, before, n, masses, done = None, np.zeros(size), None, None, None, 0
    for _ in range(rounds):
        done += 1
        total = counted(logs, prior)
        n, masses = total[:-size].reshape(many, size, size), total[-size:] + PRIOR_CLASS
        rows = n + PRIOR_WRONG + (PRIOR_RIGHT - PRIOR_WRONG) * np.eye(size)
        logs, prior = _psi(rows) - _psi(rows.sum(axis=2, keepdims=True)), _psi(masses) - _psi(masses.sum())
        stat = n.sum(axis=0)
        if before is not None and np.abs(stat - before).max() <= tolerance * masses.sum():
            break
        before = stat

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = posteriors(batch.column("said"), logs, prior)[0]
            yield pa.RecordBatch.from_arrays([batch.column("item"), *(pa.array(np.ascontiguousarray(q[:, k])) for k in range(size))], names=["item", *(f"q{k}" for k in range(size))])

    q = packed.mapInArrow(final, ", ".join([f"item {item}", *(f"q{k} double" for k in range(size))]))
    cols = ", ".join([f"annotator {kind}", "n bigint", *(f"n{k}{m} double" for k in range(size) for m in range(size))])
    params = spark.createDataFrame([(a, int(round(x.sum())), *map(float, x.ravel())) for a, x in zip(names, n, strict=True)], cols)
    return q, params, [float(m) for m in masses], done


def _psi(x: np.ndarray) -> np.ndarray:
    """digamma of an array, by the same series as of a column."""
    y = x + 6
    z = 1 / (y * y)
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z / 252)) - sum(1 / (x + i) for i in range(6))


def _joined_rounds(given: DataFrame, _: list, size: int, rounds: int, tolerance: float) -> Rounds:
    """Rounds as group-bys of the answers; an annotator of very many answers is spread by join_dictionary."""
    given = cut(given)
    votes = given.groupBy("item").agg(*[F.count(F.when(F.col("l") == k, 1)).alias(f"v{k}") for k in range(size)])
    total = reduce(add, [F.col(f"v{k}") for k in range(size)]) + 0.5 * size
    q = votes.select("item", *[((F.col(f"v{k}") + 0.5) / total).alias(f"q{k}") for k in range(size)])
    done, before, params, masses = 0, None, None, []
    for _round in range(rounds):
        done += 1
        params = cut(given.join(q, "item").groupBy("annotator").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(F.when(F.col("l") == m, F.col(f"q{k}")).otherwise(0.0)).alias(f"n{k}{m}") for k in range(size) for m in range(size)],
        ))
        rows = {f"a{k}{m}": F.col(f"n{k}{m}") + (PRIOR_RIGHT if k == m else PRIOR_WRONG) for k in range(size) for m in range(size)}
        logs = params.select("annotator", *[(digamma(rows[f"a{k}{m}"]) - digamma(reduce(add, [rows[f"a{k}{j}"] for j in range(size)]))).alias(f"e{k}{m}") for k in range(size) for m in range(size)])
        # class sizes: how many items lean to each label, from the posteriors that made the counts
        mass = q.agg(*[F.sum(f"q{k}").alias(f"m{k}") for k in range(size)]).first()
        masses = [(mass[f"m{k}"] or 0.0) + PRIOR_CLASS for k in range(size)]
        prior = (_psi(np.array(masses)) - _psi(np.array(sum(masses)))).tolist()
        said = join_dictionary(given, logs, ["annotator"], "inner")
        score = said.groupBy("item").agg(*[(F.sum(_pick(k, size)) + prior[k]).alias(f"s{k}") for k in range(size)])
        top = F.greatest(*[F.col(f"s{k}") for k in range(size)]) if size > 1 else F.col("s0")
        soft = [F.exp(F.col(f"s{k}") - top) for k in range(size)]
        q = cut(score.select("item", *[(soft[k] / reduce(add, soft)).alias(f"q{k}") for k in range(size)]))
        stat = params.agg(*[F.sum(f"n{k}{m}") for k in range(size) for m in range(size)]).first()
        moved = max(abs((x or 0.0) - (y or 0.0)) for x, y in zip(stat, before, strict=True)) if before else None
        before = stat
        if moved is not None and moved <= tolerance * sum(masses):
            break
    return q, params, masses, done


def _pick(k: int, size: int) -> Column:
    return reduce(lambda c, m: c.when(F.col("l") == m, F.col(f"e{k}{m}")), range(size), F.when(F.lit(False), F.lit(0.0)))


def _reliability(params: DataFrame, size: int, base: list[float]) -> DataFrame:
    """Posterior of each annotator's rate of right answers, with 95 % intervals.

    The rate for one label has a beta posterior; its interval comes from the exact mean
    and variance of its log odds.  reliability weighs the rates by the labels' shares.
    """
    expit = lambda c: 1 / (1 + F.exp(-c))
    cols: list[Column] = []
    mean, var = [], []
    for k in range(size):
        a = F.col(f"n{k}{k}") + PRIOR_RIGHT
        b = reduce(add, [F.col(f"n{k}{m}") + PRIOR_WRONG for m in range(size) if m != k]) if size > 1 else F.lit(PRIOR_WRONG)
        center, spread = digamma(a) - digamma(b), 1.96 * F.sqrt(trigamma(a) + trigamma(b))
        cols += [(a / (a + b)).alias(f"recall_{k}"), expit(center - spread).alias(f"low_{k}"), expit(center + spread).alias(f"high_{k}")]
        mean.append(base[k] * a / (a + b))
        var.append(base[k] ** 2 * a * b / ((a + b) * (a + b) * (a + b + 1)))
    r, s = reduce(add, mean), 1.96 * F.sqrt(reduce(add, var))
    return params.select("annotator", F.col("n").alias("n_answers"), r.alias("reliability"), F.greatest(r - s, F.lit(0.0)).alias("low"), F.least(r + s, F.lit(1.0)).alias("high"), *cols)


def agreement(answers: DataFrame) -> DataFrame:
    """Krippendorff's alpha for nominal labels: one row n_items, n_values, observed, expected, alpha.

    Items with fewer than two labels don't count.  alpha is 1 where no disagreement is
    possible, null without any pair.
    """
    per = answers.where("item is not null and label is not null").groupBy("item", "label").agg(F.count(F.lit(1)).alias("n"))
    items = per.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("ss")).where("m > 1")
    observed = items.agg(F.count(F.lit(1)).alias("n_items"), F.sum("m").alias("n_values"), F.sum((F.col("m") * F.col("m") - F.col("ss")) / (F.col("m") - 1)).alias("d_o"))
    totals = per.join(items.select("item"), "item").groupBy("label").agg(F.sum("n").alias("n_c"))
    expected = totals.agg(F.sum("n_c").alias("n_all"), F.sum(F.col("n_c").cast("double") * F.col("n_c")).alias("s_c"))
    both = observed.join(F.broadcast(expected), F.lit(True), "inner")  # one row each
    n = F.col("n_values")
    d_o, d_e = F.col("d_o") / n, (n.cast("double") * n - F.col("s_c")) / (n * (n - 1))
    alpha = F.when(n.isNull(), None).when(d_e == 0, F.lit(1.0)).otherwise(1 - d_o / d_e)
    return both.select("n_items", "n_values", d_o.alias("observed"), d_e.alias("expected"), alpha.alias("alpha"))


VERDICTS = ("correct", "wrong")


def latest_answers(reviews: DataFrame) -> DataFrame:
    """item, annotator, label, value: each reviewer's latest given answer to a task.

    A null, blank or other verdict than correct, wrong and unsure is no given answer; of
    equal times (null is earliest) the higher review_id is the later.
    """
    verdict = F.lower(K.strip(F.col("reviewer_verdict")))
    flat = reviews.select(F.col("task_id").alias("item"), F.trim("reviewer").alias("annotator"), verdict.alias("label"), F.col("reviewed_at").alias("at"), F.col("review_id").alias("id"), F.col("reviewer_corrected_value").alias("value"))
    flat = flat.where(F.col("label").isin(*VERDICTS, "unsure") & F.col("item").isNotNull() & F.col("annotator").isNotNull())
    last = flat.groupBy("item", "annotator").agg(F.max(F.struct("at", "id", "label", "value")).alias("a"))
    return last.select("item", "annotator", "a.label", "a.value")


def value_key(c: Column) -> Column:
    """One form of values that are written in several ways: days, amounts, else words."""
    s = F.lower(F.regexp_replace(K.strip(c), r"\s+", " "))
    day = K.parse_day(c)
    number = F.regexp_replace(s, r"^(?:us\$|usd|\$)\s*|,|\s*(?:dollars|usd)$|(?<=[0-9])\s(?=[0-9]{3}(?:\D|$))", "")
    amount = F.regexp_replace(number, r"[()$\s]", "").try_cast("decimal(24,4)")
    signed = F.when(number.rlike(r"^\(.*\)$"), -amount).otherwise(amount)
    return F.coalesce(F.concat(F.lit("d:"), day.cast("string")), F.concat(F.lit("n:"), signed.cast("string")), F.regexp_replace(s, r"[^\p{L}\p{N}%]+", " "))


def consensus_values(latest: DataFrame, fitted: Consensus) -> DataFrame:
    """item, value, support: the corrected value with most reliable reviewers behind it.

    Each reviewer who called the value wrong and gave one adds the log odds of their
    recall of wrong values (at least 0.01).  Of equal sums the smaller key wins; the value
    is shown in its alphabetically first spelling.
    """
    weight = F.greatest(F.ln(F.col("recall_1") / (1 - F.col("recall_1"))), F.lit(0.01))
    weights = fitted.annotators.select("annotator", weight.alias("w"))
    said = latest.where((F.col("label") == "wrong") & K.is_usable(F.col("value"))).join(broadcast_if_small(weights), "annotator")
    sums = said.groupBy("item", value_key(F.col("value")).alias("key")).agg(F.round(F.sum("w"), 9).alias("support"), F.min("value").alias("value"))
    ranked = sums.groupBy("item").agg(F.min(F.struct((-F.col("support")).alias("neg"), "key", "value")).alias("b"))
    return ranked.select("item", "b.value", (-F.col("b.neg")).alias("support"))
