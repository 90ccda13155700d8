"""Mixing sources to target weights by hash-threshold histograms (problem 8).

Each row has a hash; a source's partial copy is every row whose hash lies under the
source's threshold.  The threshold comes from token sums by source and hash bucket;
only the bucket that holds the budget's boundary is split again.  Nothing is sorted,
and a larger budget always keeps what a smaller one had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from paperloom.common import cut, table
from paperloom.llm.encode import count_tokens

#: Bits of the hash that one refinement resolves, and how many refinements there are.
BITS, LEVELS = 12, 5
#: Rows that the table of targets may have at most; it is read by the driver.
MAX_SOURCES = 10_000


def plan_budgets(rows: list[Row]) -> list[dict]:
    """Budget of each source: the largest total at which every source meets its share.

    rows: source, target_share, max_repeats, available.  A source without tokens, share
    or repeats can't be reached: it gets nothing and the other shares are rescaled to
    one.  copies is the number of whole copies, part the tokens of one more, partial copy.
    """
    live = [r for r in rows if (r.available or 0) > 0 and (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0]
    scale = sum(r.target_share for r in live)
    total = min((r.max_repeats * r.available * scale / r.target_share for r in live), default=0.0)
    out = []
    for r in rows:
        budget = int(total * r.target_share / scale + 1e-6) if r in live else 0
        copies = min(budget // r.available, r.max_repeats) if r in live else 0
        out.append({"source": r.source, "target_share": r.target_share, "max_repeats": r.max_repeats, "available": r.available or 0, "budget": budget, "copies": copies, "part": budget - copies * r.available if r in live else 0})
    return out


def _bucket(level: int) -> Column:
    return F.shiftrightunsigned(F.col("h"), 64 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)


def thresholds(sized: DataFrame, budgets: list[dict]) -> dict[str, int]:
    """Per source the number of leading hash units (of BITS*LEVELS bits) that its partial copy takes."""
    spark = sized.sparkSession
    left = {b["source"]: b["part"] for b in budgets if b["part"] > 0}
    prefix = dict.fromkeys(left, 0)
    for level in range(LEVELS):
        if not left:
            break
        bounds = F.broadcast(spark.createDataFrame([(s, prefix[s], left[s]) for s in left], "source string, prefix long, budget long"))
        inside = sized.join(bounds, "source")
        if level:
            inside = inside.where(F.shiftrightunsigned(F.col("h"), 64 - BITS * level) == F.col("prefix"))
        histogram = inside.groupBy("source", "budget", _bucket(level).alias("b")).agg(F.sum("n_tokens").alias("n"))
        # the first bucket that the rest of the budget doesn't cover; all are covered only if rounding left a token
        running = histogram.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))
        covered = F.col("upto") <= F.col("budget")
        ends = running.groupBy("source").agg(F.min(F.when(~covered, F.col("b"))).alias("b"), F.sum(F.when(covered, F.col("n")).otherwise(0)).alias("n")).collect()  # a row a source
        by = {r.source: r for r in ends}
        for s in list(left):
            boundary = by[s].b if s in by and by[s].b is not None else 1 << BITS
            left[s] -= by[s].n if s in by else 0
            prefix[s] = (prefix[s] << BITS) + boundary
            if boundary == 1 << BITS:  # everything under this prefix fits
                prefix[s] <<= BITS * (LEVELS - 1 - level)
                left[s] = -1
        left = {s: n for s, n in left.items() if n >= 0}
    return prefix


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of times to use each, and the report of shares.

    First frame: id, source, n_tokens, copies, only rows used at least once.  Second:
    source, target_share, max_repeats, available_tokens, budget_tokens, used_tokens,
    used_documents, actual_share, max_copies for every target.  A source ends below its
    budget by less than one of its documents.  Rows of a null source or of one without
    target, and rows without tokens (null or empty text), are not used.  Documents of
    equal id stand or fall together, as the hash is of the id.  An empty table gives no
    rows and a report of zeros.
    """
    sized = count_tokens(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where(F.col("source").isNotNull()), "text", path)
    sized = cut(sized.where("n_tokens > 0").withColumn("h", F.xxhash64("id")))
    wanted = targets.select(F.col("source").cast("string").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats"))
    wanted = wanted.where("source is not null").limit(MAX_SOURCES + 1)
    sums = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    rows = wanted.join(sums, "source", "left").collect()
    if len(rows) > MAX_SOURCES or len({r.source for r in rows}) < len(rows):
        raise ValueError(f"the targets must name each source once, and at most {MAX_SOURCES}")
    budgets = plan_budgets(rows)
    under = thresholds(sized, budgets)
    spark, unit = docs.sparkSession, 64 - BITS * LEVELS
    plan = spark.createDataFrame(
        [(b["source"], b["target_share"], b["max_repeats"], b["available"], b["budget"], b["copies"], under.get(b["source"], 0)) for b in budgets],
        "source string, target_share double, max_repeats long, available_tokens long, budget_tokens long, whole long, under long",
    )
    used = sized.join(F.broadcast(plan.select("source", "whole", "under")), "source").withColumn("copies", F.col("whole") + (F.shiftrightunsigned("h", unit) < F.col("under")).cast("long")).where("copies > 0")
    chosen = used.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "n_tokens", "copies")
    got = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.count(F.lit(1)).alias("used_documents"), F.max("copies").alias("max_copies"))
    report = (
        plan.drop("whole", "under")
        .join(got, "source", "left")
        .na.fill(0, ["used_tokens", "used_documents", "max_copies"])
        # one window over the report, of at most MAX_SOURCES rows
        .withColumn("total", F.sum("used_tokens").over(Window.partitionBy()))
        .withColumn("actual_share", F.when(F.col("total") > 0, F.col("used_tokens") / F.col("total")).otherwise(F.lit(0.0)))
        .drop("total")
    )
    return chosen, report


def p8_mix(spark, sf_dir):  # noqa: ANN001, ANN201
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark, sf_dir):  # noqa: ANN001, ANN201
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]
