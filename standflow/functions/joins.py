"""Equi-joins whose keys may be null, or hold many rows on both sides; rows dealt by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 1024
DEALT_ROWS = 1_000_000  # of a partition


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join where two nulls match; the result has the left keys once."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    match = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    )
    return left.join(renamed, match, how).drop(*[f"__r_{k}" for k in keys])


def tiled_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", tile: int = TILE
) -> DataFrame:
    """Join on few keys with many rows each, for pairs that are all wanted. The right rows of a key
    (distinct ones) are dealt into tiles of about `tile` rows by their hash, and each left row
    meets every tile of its key, so a key is as many units of work as it has tiles. Two nulls
    match; the result has the left columns, then those of the right that are no keys. `how` is
    "inner" or "left"."""
    if how not in ("inner", "left"):
        raise ValueError(how)
    own = [c for c in right.columns if c not in keys]
    key = F.struct(*keys)
    sizes = right.groupBy(key.alias("__k")).agg(
        F.ceil(F.count(F.lit(1)) / tile).cast("long").alias("__tiles")
    )
    dealt = right.select(key.alias("__k"), *own).join(sizes, "__k")
    dealt = dealt.withColumn("__t", F.pmod(F.xxhash64(*own), F.col("__tiles"))).drop("__tiles")
    sized = left.withColumn("__k", key).join(sizes, "__k", how)
    met = (
        sized.withColumn("__t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__tiles") - 1)))
        .join(dealt, ["__k", "__t"])
        .select(*left.columns, *own)
    )
    if how == "inner":
        return met
    alone = sized.where(F.col("__tiles").isNull()).select(*left.columns)
    return met.unionByName(alone, allowMissingColumns=True)


def dealt(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys and columns only, rows of equal keys in one partition. For aggregates with nearly as many
    groups as rows: over the input's own splits each task would hold the groups of all its rows,
    before a shuffle that saves little; here it holds those of one bounded shuffle partition.

    Rows are counted first (a job): where the session's shuffle partitions would hold more than
    `DEALT_ROWS` on average, there are more of them, so a task's memory doesn't grow with the input."""
    n = -(-df.count() // DEALT_ROWS)
    picked = df.select(*keys, *columns)
    if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return picked.repartition(n, *keys)
    return picked.repartition(*keys)
