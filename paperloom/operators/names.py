"""Free-form field names onto a canonical vocabulary."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.common import join_dictionary
from paperloom.functions.text import normalize_key
from paperloom.rules import mortgage as M

FUZZY_CUTOFF, SEMANTIC_CUTOFF = 65.0, 0.50


def exact_name(key: Column, aliases: Mapping[str, Sequence[str]] = M.ALIASES, schema: Sequence[str] = M.SCHEMA_FIELDS) -> Column:
    """Canonical name of a normalized key: an alias' field first, then the name itself, else null."""
    table = F.create_map(*[F.lit(x) for field, names in aliases.items() for n in names for x in (n, field)])
    return F.coalesce(F.try_element_at(table, key), F.when(key.isin(*schema), key))


def common_subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def similarity(a: str, b: str) -> float:
    """100 times the share of characters that both texts have in common order."""
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def fuzzy_name(key: Column, schema: Sequence[str] = M.SCHEMA_FIELDS, cutoff: float = FUZZY_CUTOFF) -> Column:
    """The most similar canonical name at or over the cutoff; of equal ones the first in schema order."""
    words = tuple(schema)

    @F.pandas_udf("string")
    def nearest(s: pd.Series) -> pd.Series:
        out = []
        for k in s:
            best, name = cutoff, None
            for w in words if k else ():
                score = similarity(k, w)
                if score > best or (name is None and score == best):
                    best, name = score, w
            out.append(name)
        return pd.Series(out, dtype="object")

    return nearest(key)


def resolve_names(names: DataFrame, column: str = "name", schema: Sequence[str] = M.SCHEMA_FIELDS, semantic: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """name, key, canonical, layer of each distinct name.

    Layers: alias, schema, semantic (a frame name, canonical made by nearest()), fuzzy, key.
    Work is per distinct name; join the result back to the rows.  Null names have no row.
    """
    d = names.select(F.col(column).alias("name")).where("name is not null").distinct().withColumn("key", normalize_key(F.col("name")))
    alias_only = exact_name(F.col("key"), schema=())
    d = d.withColumn("alias", alias_only).withColumn("own", F.when(F.col("key").isin(*schema), F.col("key")))
    if semantic is not None:
        d = join_dictionary(d, semantic.select("name", F.col("canonical").alias("near")), ["name"])
    else:
        d = d.withColumn("near", F.lit(None).cast("string"))
    known = F.coalesce("alias", "own", "near")
    d = d.withColumn("fuzzy", fuzzy_name(F.when(known.isNull(), F.col("key")), schema) if fuzzy else F.lit(None).cast("string"))
    layer = F.when(F.col("alias").isNotNull(), "alias").when(F.col("own").isNotNull(), "schema").when(F.col("near").isNotNull(), "semantic").when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("key")
    return d.select("name", "key", F.coalesce("alias", "own", "near", "fuzzy", "key").alias("canonical"), layer.alias("layer"))


def with_canonical(rows: DataFrame, resolved: DataFrame, column: str) -> DataFrame:
    """Rows with the canonical name of ``column``."""
    return join_dictionary(rows, resolved.select(F.col("name").alias(column), "canonical"), [column])


def nearest(vectors: DataFrame, targets: Sequence[tuple[str, Sequence[float]]], id_col: str, vector_col: str, cutoff: float = SEMANTIC_CUTOFF) -> DataFrame:
    """id, canonical, score: the target of greatest cosine similarity, at or over the cutoff.

    targets are the vocabulary's vectors, a configuration list; one matrix product a batch.
    Vectors that are null, of another length or zero have no row.
    """
    names, matrix = [t for t, _ in targets], np.array([v for _, v in targets], dtype=float)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p = p[[v is not None and len(v) == matrix.shape[1] for v in p[vector_col]]]
            if not len(p):
                continue
            x = np.stack([np.asarray(v, dtype=float) for v in p[vector_col]])
            norm = np.linalg.norm(x, axis=1)
            score = x @ matrix.T / np.maximum(norm, 1e-300)[:, None]
            best = score.argmax(axis=1)
            top = score[np.arange(len(x)), best]
            keep = (top >= cutoff) & (norm > 0)
            yield pd.DataFrame({id_col: p[id_col].to_numpy()[keep], "canonical": np.array(names, dtype=object)[best[keep]], "score": top[keep]})

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vector_col).mapInPandas(run, f"`{id_col}` {kind}, canonical string, score double")
