"""Shared plumbing: tables, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a side table up to which it is broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in spark.checkpoint.dir.  Only a session that has none
    (tests, a laptop) gets a folder of its own, and only if its executors are threads of
    this process (local, not local-cluster); that one is removed at the end.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="paperloom-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialize ``df`` reliably in the shared folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row has: texts and nested values by their length, others eight each."""
    sizes = [F.lit(8)]
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary", "varchar", "char"):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif kind in ("array", "map", "struct", "variant"):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)))
        else:
            sizes.append(F.lit(8))
    return reduce(add, sizes)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if rows and bytes, counted just past the limit, prove the size.

    Beyond limit or BROADCAST_BYTES the frame itself comes back, without a hint, and the join shuffles.
    """
    n, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    return F.broadcast(df) if n <= limit and (size or 0) <= BROADCAST_BYTES else df


def temp_names(df: DataFrame, *wanted: str) -> list[str]:
    """Working column names that no column of ``df`` has (case does not count)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def join_dictionary(df: DataFrame, dictionary: DataFrame, on: list[str], how: str = "left", salts: int = 16) -> DataFrame:
    """Join a dictionary, unique in ``on``, to rows of which one key may hold a third.

    A dictionary of proven size is broadcast.  A larger one is repeated ``salts`` times
    and joined on key and salt, so the rows of a hot key spread over as many tasks.
    """
    hinted = broadcast_if_small(dictionary)
    if hinted is not dictionary:
        return df.join(hinted, on, how)
    (salt,) = temp_names(df, "salt")
    spread = dictionary.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # the salt comes from the row itself, so a task that runs again makes the same one
    salted = df.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if dict(df.dtypes)[c][:3] != "map"]), F.lit(salts)).cast("int"))
    return salted.join(spread, [*on, salt], how).drop(salt)
