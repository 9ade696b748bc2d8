"""Ordered computations over groups of any size.

A window over a whole group puts that group into one task. Here a group is cut into blocks that
follow the order of its rows. Each block is summarised, the summaries (one row per block) are scanned
in order, and every block gets back what it must know about the blocks before and after it. Whole
rows are shuffled once, by group and block; the columns that the summaries read a second time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = "__block"
_KEY = "__key_"


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds one column that is never null and equal just where the keys are, unless an earlier step
    has left it: a struct, in which two nulls are equal. Aggregates, windows and joins on it share
    one partitioning of the rows, which joins on keys that may be null do not."""
    names = key_names(keys)
    if not names or names[0] in df.columns:
        return df
    return df.withColumn(names[0], F.struct(*keys))


def key_names(keys: Sequence[str]) -> list[str]:
    """The column of `keyed`, if there are keys."""
    return [_KEY + "_".join(keys)] if keys else []


def unkeyed(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(_KEY)])


def preceding(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def following(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(1, Window.unboundedFollowing)


def whole(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def carry(
    df: DataFrame,
    keys: Sequence[str],
    summary: Mapping[str, Column],
    carried: Mapping[str, Callable[[WindowSpec], Column]],
    then: Mapping[str, Callable[[WindowSpec], Column]] | None = None,
) -> DataFrame:
    """Summarise each (keys, block), scan the summaries in block order and join the result back.

    `summary` names aggregates over one block, `carried` window expressions over them and `then`
    window expressions over those. Rows whose keys are null are a group like any other. The column
    of `keyed` stays in the result, for steps that go on with its partitioning; `unkeyed` drops
    it."""
    df = keyed(df, keys)
    order = Window.partitionBy(*key_names(keys)).orderBy(BLOCK)
    on = [*key_names(keys), BLOCK]
    blocks = df.groupBy(*on).agg(*[c.alias(n) for n, c in summary.items()])
    scanned = blocks.select(*on, *[make(order).alias(n) for n, make in carried.items()])
    if then:
        scanned = scanned.select("*", *[make(order).alias(n) for n, make in then.items()])
    return df.join(scanned, on)


def blocked_row_number(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[Column | str],
    name: str,
) -> DataFrame:
    """1-based running number per group. `block` must not decrease along `order`."""
    columns = [*[c for c in df.columns if c != name], name]
    counted = carry(
        df.withColumn(BLOCK, F.struct(block.alias("at"))),  # null blocks are a block
        keys,
        {"__n": F.count(F.lit(1))},
        {"__before": lambda w: F.coalesce(F.sum("__n").over(preceding(w)), F.lit(0))},
    )
    within = Window.partitionBy(*key_names(keys), BLOCK).orderBy(*order)
    numbered = counted.withColumn(name, F.col("__before") + F.row_number().over(within))
    return numbered.select(*columns)
