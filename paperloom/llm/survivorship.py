"""Best representative of each duplicate group (problem 1).

One aggregation: for each attribute the maximum of a composite struct (usable,
rank of the source, ..., row, value).  max() combines on the map side, so a group
that holds a third of all rows reaches its reducer as one struct per map task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import keys as K


def survivors(df: DataFrame, group: Mapping[str, Column], attributes: Mapping[str, tuple[Column, Column]], rank: Sequence[Column], row_id: Column, min_rows: int = 2) -> DataFrame:
    """One row per group, each attribute from the best record that has it.

    group: output name -> key expression; rows with a null key belong to no group.
    attributes: name -> (value, usable).  rank: descending order of the records; a
    null ranks last.  row_id: unique number, the smaller one wins a full tie; rows
    repeated with the same id are one candidate but count towards min_rows.
    Result: the keys, n_records, and per attribute a struct <value, row_id>, null if
    no record has a usable value.  An empty table gives no rows; extra columns of any
    name are ignored, as only the given expressions are read.
    """
    keys = [c.alias(f"k{i}") for i, c in enumerate(group.values())]
    ranks = [c.alias(f"r{i}") for i, c in enumerate(rank)]
    values = [x for i, (v, ok) in enumerate(attributes.values()) for x in (v.alias(f"v{i}"), F.coalesce(ok, F.lit(False)).alias(f"u{i}"))]
    flat = df.select(*keys, *ranks, row_id.cast("long").alias("id"), *values)
    for i in range(len(keys)):
        flat = flat.where(F.col(f"k{i}").isNotNull())
    order = [x for i in range(len(ranks)) for x in (F.col(f"r{i}"),)]
    best = []
    for i in range(len(attributes)):
        # an unusable record stays out of the maximum; its value need not be shuffled either
        entry = F.when(F.col(f"u{i}"), F.struct(*order, (-F.col("id")).alias("neg"), F.col(f"v{i}").alias("value")))
        best.append(F.max(entry).alias(f"b{i}"))
    out = flat.groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("n"), *best).where(F.col("n") >= min_rows)
    return out.select(
        *[F.col(f"k{i}").alias(name) for i, name in enumerate(group)],
        F.col("n").alias("n_records"),
        *[
            F.when(F.col(f"b{i}").isNotNull(), F.struct(F.col(f"b{i}.value").alias("value"), (-F.col(f"b{i}.neg")).alias("row_id"))).alias(name)
            for i, name in enumerate(attributes)
        ],
    )


def field_value_survivors(field_values: DataFrame) -> DataFrame:
    """survivors() with the ranking of field values.

    Confidence, later correction day, higher source page, later capture, smaller
    fv_id.  Null, blank and placeholder texts are unusable, as are correction dates
    that name no calendar day.
    """
    day = K.parse_day(F.col("correction_date"))
    return survivors(
        field_values,
        {"document_id": K.clean_document_id(F.col("document_id")), "field": K.clean_field_name(F.col("field"))},
        {
            "raw_value": (F.col("raw_value"), K.is_usable(F.col("raw_value"))),
            "evidence": (F.col("evidence"), K.is_usable(F.col("evidence"))),
            "correction_date": (F.col("correction_date"), K.is_usable(F.col("correction_date")) & day.isNotNull()),
        },
        [K.confidence_rank(F.col("confidence")), day, F.col("source_page"), F.col("captured_at")],
        F.col("fv_id"),
    )


def survivor_rows(best: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Long form: document_id, field, attribute and the fv_id whose value survives."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"{a}.row_id").alias("fv_id")) for a in attributes])
    return (
        best.select("document_id", "field", F.explode(pairs).alias("p"))
        .select("document_id", "field", "p.attribute", "p.fv_id")
        .where(F.col("fv_id").isNotNull())
    )
