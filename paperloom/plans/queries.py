"""Queries of the core and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.common import table
from paperloom.operators import nested, units
from paperloom.plans import answers, demo

#: Elements of an extraction result that problem 5 asks for, with the names it gives them.
P5_TABLES = {"fields": "fields", "tables": "tables", "rows": "table_rows", "corrections_applied": "corrections_applied", "mismatches": "mismatches", "component_fields": "component_fields"}


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = nested.shred(table(spark, sf_dir, "extraction_results"), "result_id", "result_json")
    return nested.child_keys(got, P5_TABLES).withColumnRenamed("doc_key", "result_id")


def _p5_table(label: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.shred(table(spark, sf_dir, "extraction_results"), "result_id", "result_json").table(label).drop("doc_row")

    return run


def _standard(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return units.standardize(*(table(spark, sf_dir, t) for t in ("field_values", "measured_fields", "measure_units", "capture_feeds")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.converted(_standard(spark, sf_dir)[0])


def p6_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standard(spark, sf_dir)[0]


def p6_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _standard(spark, sf_dir)[1]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **demo.QUERIES,
        **answers.QUERIES,
        "p5_found": p5_found,
        **{f"p5_{name}": _p5_table(label) for label, name in P5_TABLES.items()},
        "p6_found": p6_found,
        "p6_common": p6_common,
        "p6_aliases": p6_aliases,
    }


def oracle_sql() -> dict[str, str]:
    from paperloom.plans.oracles import ORACLES

    from paperloom.plans.engine_oracles import ORACLES as ENGINE

    return ORACLES | ENGINE
