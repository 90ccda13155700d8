"""Arithmetic checks across the fields of a document; stated values are never changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import check_money
from paperloom.rules import mortgage as M

FLAG = "doc_id string, check string, field string, stated double, computed double, difference double, severity string, components array<string>, missing array<string>"


def _numbers(fields: DataFrame) -> DataFrame:
    return fields.select("doc_id", "field", check_money(F.col("raw_value")).alias("x"))


def _total(values: Column) -> Column:
    """Sum in order, as doubles, so that the same numbers give the same last digit."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def sum_checks(fields: DataFrame, checks: Sequence[tuple] = M.SUM_CHECKS, tolerance: float = M.SUM_TOLERANCE) -> DataFrame:
    """Totals that differ from the sum of their present components by more than the tolerance.

    fields: doc_id, field (unique in a document), raw_value.  A total without a number, or
    with no component at all, gives nothing.  A check may be moot where another's flag stands.
    """
    names = sorted({t for _, t, _, _ in checks} | {c for _, _, cs, _ in checks for c in cs})
    wide = _numbers(fields.where(F.col("field").isin(*names))).groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == n, F.col("x"))).alias(f"v_{n}") for n in names])
    made, flagged = [], {}
    for check, total, components, unless in checks:
        present = F.filter(F.array(*[F.struct(F.lit(c).alias("n"), F.col(f"v_{c}").alias("x")) for c in components]), lambda s: s["x"].isNotNull())
        missing = F.filter(F.array(*[F.when(F.col(f"v_{c}").isNull(), F.lit(c)) for c in components]), lambda s: s.isNotNull())
        computed, stated = _total(F.transform(present, lambda s: s["x"])), F.col(f"v_{total}")
        off = F.coalesce((F.size(present) > 0) & (F.abs(computed - stated) > tolerance), F.lit(False))
        flagged[check] = off
        if unless:
            off = off & ~flagged[unless]
        made.append(F.when(off, F.struct(F.lit(check).alias("check"), F.lit(total).alias("field"), stated.alias("stated"), computed.alias("computed"), F.abs(computed - stated).alias("difference"), F.lit("error").alias("severity"), F.array(*map(F.lit, components)).alias("components"), missing.alias("missing"))))
    return wide.select("doc_id", F.explode(F.filter(F.array(*made), lambda s: s.isNotNull())).alias("s")).select("doc_id", "s.*")


def generic_totals(fields: DataFrame, known: Sequence[str] = tuple({t for _, t, _, _ in M.SUM_CHECKS}), excluded: Sequence[str] = M.GENERIC_EXCLUDED, tolerance: float = M.SUM_TOLERANCE) -> DataFrame:
    """Other fields named total_* or *_total against all smaller positive fields, where these are two to six.

    A document's fields, at most one of each name, are gathered into one array; no rows are paired.
    """
    is_total = F.col("field").startswith("total_") | F.col("field").endswith("_total")
    rows = _numbers(fields).where("x > 0 and not isnan(x)")
    per = rows.groupBy("doc_id").agg(
        F.collect_list(F.when(is_total & ~F.col("field").isin(*known), F.struct("field", "x"))).alias("totals"),
        F.array_sort(F.collect_list(F.when(~is_total & ~F.col("field").isin(*excluded), F.struct("field", "x")))).alias("parts"),
    )
    d = per.select("doc_id", "parts", F.explode("totals").alias("t"))
    d = d.withColumn("used", F.filter("parts", lambda s: s["x"] < F.col("t.x"))).withColumn("computed", _total(F.transform("used", lambda s: s["x"])))
    d = d.where(F.size("used").between(2, 6) & (F.abs(F.col("computed") - F.col("t.x")) > tolerance))
    return d.select("doc_id", F.lit("generic_total").alias("check"), F.col("t.field").alias("field"), F.col("t.x").alias("stated"), "computed", F.abs(F.col("computed") - F.col("t.x")).alias("difference"), F.lit("warning").alias("severity"), F.transform("used", lambda s: s["field"]).alias("components"), F.array().cast("array<string>").alias("missing"))


def ratio_checks(fields: DataFrame, tolerance: float = M.RATIO_TOLERANCE) -> DataFrame:
    """A stated loan-to-value ratio against 100 times loan amount by appraised value.

    The revised ratio counts where that field exists, even if it can't be read; stated
    ratios up to one are fractions.
    """
    names = ("ltv_revised", "ltv_original", "loan_amount", "appraised_value")
    d = _numbers(fields.where(F.col("field").isin(*names))).groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == n, F.col("x"))).alias(n) for n in names], *[F.max(F.when(F.col("field") == n, True)).alias(f"has_{n}") for n in names[:2]])
    ltv = F.when(F.col("has_ltv_revised"), F.col("ltv_revised")).otherwise(F.col("ltv_original"))
    stated = F.when(ltv <= 1, ltv * 100).otherwise(ltv)
    computed = F.when((F.col("loan_amount") != 0) & (F.col("appraised_value") > 0), F.col("loan_amount") / F.col("appraised_value") * 100)
    label = F.when(F.col("has_ltv_original"), "ltv_original").otherwise("ltv_revised")
    return d.where(F.abs(stated - computed) > tolerance).select(
        "doc_id", F.lit("ltv").alias("check"), label.alias("field"), stated.alias("stated"), computed.alias("computed"), F.abs(stated - computed).alias("difference"),
        F.lit("error").alias("severity"), F.array(F.lit("loan_amount"), F.lit("appraised_value")).alias("components"), F.array().cast("array<string>").alias("missing"),
    )


def all_checks(fields: DataFrame) -> DataFrame:
    """Every flag; a generic one goes where another check flags the same field."""
    named = sum_checks(fields).unionByName(ratio_checks(fields))
    return named.unionByName(generic_totals(fields).join(named.select("doc_id", "field").distinct(), ["doc_id", "field"], "left_anti"))
