"""Human review: queues, answers and what they tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import display_name, shorten

#: What a reviewer is asked; a verdict is required.
VERDICTS = ("correct", "wrong", "unsure")
RANKS = {"high": 0, "medium": 1, "low": 2}


def rank(c: Column) -> Column:
    """0 for high, 1 for medium, 2 for low and anything else."""
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def tasks(fields: DataFrame, min_confidence: str = "low") -> DataFrame:
    """Review tasks of fields(doc_id, field, raw_value, confidence, confidence_reason, evidence, source_page).

    min_confidence: low, medium (and low), or all.
    """
    kept = fields if min_confidence == "all" else fields.where(rank(F.col("confidence")) >= RANKS[min_confidence])
    return kept.select(
        "doc_id", "field", display_name(F.col("field")).alias("field_display"), F.coalesce("raw_value", F.lit("")).alias("pipeline_value"), F.coalesce("confidence", F.lit("low")).alias("confidence"),
        F.coalesce("confidence_reason", F.lit("")).alias("confidence_reason"), shorten(F.coalesce("evidence", F.lit("")), 400).alias("evidence"), F.concat(F.lit("Page "), F.coalesce(F.col("source_page").cast("string"), F.lit("?"))).alias("source_page"),
    )


def answers(export: DataFrame, only_wrong: bool = False) -> DataFrame:
    """One answer a task of an annotation export: task_id, verdict, corrected_value, notes, reviewed_at.

    export: task_id, annotations array<struct<completed_at, result array<struct<from_name,
    value struct<choices array<string>, text array<string>>>>>>.  The last annotation counts,
    in it the first choice and text of each name; tasks without a verdict have no row.
    """
    d = export.withColumn("a", F.try_element_at("annotations", F.lit(-1)))
    named = lambda n: F.get(F.filter("a.result", lambda r: r["from_name"] == n), F.lit(0))["value"]
    out = d.select("task_id", F.get(named("verdict")["choices"], F.lit(0)).alias("verdict"), F.get(named("corrected_value")["text"], F.lit(0)).alias("corrected_value"), F.get(named("reviewer_notes")["text"], F.lit(0)).alias("notes"), F.col("a.completed_at").alias("reviewed_at"))
    out = out.where("verdict is not null")
    return out.where("verdict = 'wrong'") if only_wrong else out


def form_faults(answered: DataFrame) -> DataFrame:
    """Answers (with verdict, corrected_value) that the review form doesn't allow, with fault.

    no verdict; unknown verdict (case and outer blanks count); a wrong one without a
    corrected value; a corrected value beside another verdict.
    """
    has_value = F.trim(F.coalesce("corrected_value", F.lit(""))) != ""
    verdict = F.col("verdict")
    fault = (
        F.when(F.coalesce(verdict, F.lit("")) == "", "no verdict")
        .when(~verdict.isin(*VERDICTS), "unknown verdict")
        .when((verdict == "wrong") & ~has_value, "no corrected value")
        .when((verdict != "wrong") & has_value, "needless corrected value")
    )
    return answered.withColumn("fault", fault).where("fault is not null")


def verdict_counts(answered: DataFrame) -> DataFrame:
    return answered.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def override_rate(answered: DataFrame, alarm: float = 0.2) -> DataFrame:
    """confidence, n, n_wrong, rate, alarm of answers(confidence, verdict)."""
    n, wrong = F.count(F.lit(1)), F.count(F.when(F.col("verdict") == "wrong", 1))
    return answered.groupBy("confidence").agg(n.alias("n"), wrong.alias("n_wrong"), (wrong / n).alias("rate"), (wrong / n > alarm).alias("alarm"))


def frequent_corrections(corrections: DataFrame, days: int = 30, least: int = 3) -> DataFrame:
    """field, at, n: corrections(id, field, at) at which a field reaches ``least`` within the days before.

    Counts are made by day and field first, so a hot field is a row a day; the days of the
    window are then summed for each, and single corrections meet them by an equi-join.
    """
    per = corrections.where("at is not null").groupBy("field", F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    spread = per.select("field", F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("day"), "n")
    sums = spread.groupBy("field", "day").agg(F.sum("n").alias("n"))
    return sums.join(per.select("field", "day"), ["field", "day"]).where(F.col("n") >= least)


def check_corrections(corrections: DataFrame) -> DataFrame:
    """Corrections(id, field, value, at) with problem: missing field, missing value, bad amount, or repeat within the week.

    Of equal corrections in a week the smallest id is the first; one without a time, field or
    value can't be told to be a repeat.
    """
    from paperloom.functions.text import money
    from paperloom.rules import mortgage as M

    # sums by week first: only the ids of first ones come back to the rows
    timed = corrections.where("at is not null and field is not null and value is not null")
    first = timed.groupBy("field", "value", F.window("at", "7 days").alias("w")).agg(F.min("id").alias("first_id")).drop("w")
    again = corrections.join(first.select(F.col("first_id").alias("id"), F.lit(True).alias("is_first")).distinct(), "id", "left")
    is_money = F.col("field").isin(*M.MONEY_FIELDS)
    problem = (
        F.when(F.coalesce("field", F.lit("")) == "", "missing field")
        .when(F.coalesce("value", F.lit("")) == "", "missing value")
        .when(is_money & (~F.col("value").startswith("$") | money(F.col("value")).isNull()), "bad amount")
        .when(F.col("is_first").isNull() & F.col("at").isNotNull(), "repeat")
    )
    return again.select("id", "field", "value", "at", problem.alias("problem"))


def changed_values(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, field, old_value, new_value of fields that were of high confidence and now read otherwise or are gone."""
    o = old.where("confidence = 'high'").select("doc_id", "field", F.col("raw_value").alias("old_value"))
    n = new.select("doc_id", "field", F.col("raw_value").alias("new_value"))
    return o.join(n, ["doc_id", "field"], "left").where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def extended_aliases(aliases: DataFrame, answered: DataFrame) -> DataFrame:
    """Aliases(name, canonical) with those that reviewers confirmed, names already there first."""
    new = answered.select("name", "canonical").where("name is not null and canonical is not null").distinct()
    new = new.groupBy("name").agg(F.min("canonical").alias("canonical"))
    return aliases.unionByName(new.join(aliases.select("name"), "name", "left_anti"))
