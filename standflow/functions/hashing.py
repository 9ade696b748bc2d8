"""Seeded draws that depend on row values only, never on partitioning or order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*cols: Column | str, seed: int = 0) -> Column:
    """md5 over the row's key values and a seed, as hexadecimal text."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts], F.lit(str(seed))))


def hash_int(*cols: Column | str, seed: int = 0) -> Column:
    """A whole number in [0, 2^32) from the first eight digits of the digest."""
    return F.conv(F.substring(digest(*cols, seed=seed), 1, 8), 16, 10).cast("bigint")


def hash_unit(*cols: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1)."""
    return hash_int(*cols, seed=seed) / F.lit(4294967296.0)
