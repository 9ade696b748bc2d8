"""Yearly timelines to state-transition examples.

`unit` names the columns that identify one timeline, `order` its whole-number year (one row per
year) and `state` the state code. A timeline may be of any length: it is worked in blocks of
`block_years`, see `functions.scans`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_int
from ..functions.scans import (
    BLOCK, carry, following, key_names, keyed, preceding, unkeyed, whole,
)

# Fixed values of the study.
HORIZON = 10
QUIET_YEARS = 10
HISTORY = 3
MISSING = "missing"
BLOCK_YEARS = 4096

_POS, _TOTAL, _PREV = "__pos", "__total", "__prev"
_LAST, _NEXT = "__last_change", "__next_change"


def _in_block(unit: Sequence[str], order: str):
    return Window.partitionBy(*key_names(unit), BLOCK).orderBy(order)


def _with_block(
    df: DataFrame, unit: Sequence[str], order: str, block_years: int
) -> DataFrame:
    """Adds block and keys, unless an earlier step has left them: then its partitioning is used
    again."""
    df = keyed(df, unit)
    if BLOCK in df.columns:
        return df
    missing = F.raise_error(F.lit(f"{order} is null in a timeline")).cast("bigint")
    return df.withColumn(BLOCK, F.coalesce(F.floor(F.col(order) / block_years), missing))


def with_previous(
    df: DataFrame, unit: Sequence[str], order: str, state: str, block_years: int = BLOCK_YEARS
) -> DataFrame:
    """State of the row before, across block borders; null in the first row."""
    w = _in_block(unit, order)
    d = carry(
        _with_block(df, unit, order, block_years),
        unit,
        {"__tail": F.max_by(state, order)},
        {"__prev_tail": lambda b: F.lag("__tail").over(b)},
    )
    return d.withColumn(_PREV, F.coalesce(F.lag(state).over(w), "__prev_tail")).drop("__prev_tail")


def with_changes(
    df: DataFrame,
    unit: Sequence[str],
    order: str,
    state: str,
    horizon: int = HORIZON,
    block_years: int = BLOCK_YEARS,
) -> DataFrame:
    """Row position, timeline length, state of the row before, position of the last change up to
    each row, and position and state of the next change after it.

    Changes inside a block are found there. Whether its first row is one too depends on the last
    state of the block before, so that is settled among the block summaries."""
    w = _in_block(unit, order)
    up_to_here = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.rowsBetween(1, horizon - 1)
    d = _with_block(df, unit, order, block_years).withColumns({
        "__i": F.row_number().over(w), "__lag": F.lag(state).over(w),
    })
    change = F.when(F.col(state) != F.col("__lag"), F.struct(F.col("__i"), F.col(state)))
    d = d.withColumn("__change", change)

    rows_before = lambda b: F.coalesce(F.sum("__rows").over(preceding(b)), F.lit(0))
    tail = lambda b: F.lag("__tail").over(b)

    def global_change(inner: str, head_first: bool):
        """First or last change of a block as (position, state), its first row included."""

        def make(b):
            at = F.when(
                F.col(inner).isNotNull(),
                F.struct((rows_before(b) + F.col(inner)["__i"]).alias(_POS), F.col(inner)[state]),
            )
            head = F.when(
                F.col("__head") != tail(b),
                F.struct((rows_before(b) + 1).alias(_POS), F.col("__head").alias(state)),
            )
            return F.coalesce(head, at) if head_first else F.coalesce(at, head)

        return make

    d = carry(
        d,
        unit,
        {
            "__rows": F.count(F.lit(1)),
            "__head": F.min_by(state, order),
            "__tail": F.max_by(state, order),
            "__first": F.min("__change"),
            "__last": F.max("__change"),
        },
        {
            "__before": rows_before,
            _TOTAL: lambda b: F.sum("__rows").over(whole(b)),
            "__prev_tail": tail,
            "__g_first": global_change("__first", True),
            "__g_last": global_change("__last", False),
        },
        then={
            "__last_before": lambda b: F.max("__g_last").over(preceding(b)),
            "__first_after": lambda b: F.min("__g_first").over(following(b)),
        },
    )
    shifted = lambda c: F.when(
        c.isNotNull(), F.struct((F.col("__before") + c["__i"]).alias(_POS), c[state])
    )
    head = F.when(F.col("__prev_tail") != F.first(state).over(w), F.col("__before") + 1)
    return (
        d.withColumns({
            _POS: F.col("__before") + F.col("__i"),
            _PREV: F.coalesce("__lag", "__prev_tail"),
            _LAST: F.coalesce(
                F.col("__before") + F.max("__change").over(up_to_here)["__i"],
                head,
                F.col("__last_before")[_POS],
            ),
            _NEXT: F.coalesce(shifted(F.min("__change").over(ahead)), "__first_after"),
        })
        .drop("__i", "__lag", "__change", "__before", "__prev_tail", "__g_first", "__g_last",
              "__last_before", "__first_after")
    )


def _residence() -> Column:
    return (F.col(_POS) - F.coalesce(F.col(_LAST), F.lit(1)) + 1).cast("int")


def _target_time(horizon: int) -> Column:
    gap = F.col(_NEXT)[_POS] - F.col(_POS)
    return (
        F.when(gap <= horizon - 1, gap)
        .when(F.col(_TOTAL) - F.col(_POS) >= horizon - 1, horizon)
        .cast("int")
    )


def _target_state(state: str, horizon: int) -> Column:
    time = _target_time(horizon)
    return F.when(time == horizon, F.col(state)).when(time.isNotNull(), F.col(_NEXT)[state])


def _flag(quiet: int) -> Column:
    """1 on a change and on every `quiet`-th year since it. Before the first change the count
    starts with the first row, which is no change itself."""
    quiet_year = F.when(F.col(_LAST).isNull(), _residence() % quiet == 0).otherwise(
        _residence() % quiet == 1
    )
    return quiet_year.cast("int")


def _clean(df: DataFrame) -> DataFrame:
    return unkeyed(df.drop(BLOCK, _POS, _TOTAL, _PREV, _LAST, _NEXT))


def residence_time(df, unit, order, state, block_years: int = BLOCK_YEARS) -> DataFrame:
    """Years since the state last changed, starting at 1."""
    d = with_changes(df, unit, order, state, block_years=block_years)
    return _clean(d.withColumn("residence_time", _residence()))


def previous_state(df, unit, order, state, block_years: int = BLOCK_YEARS) -> DataFrame:
    """State of the previous row; the first row has its own."""
    d = with_previous(df, unit, order, state, block_years)
    return _clean(d.withColumn("previous_year_state", F.coalesce(_PREV, state)))


def target_time(
    df, unit, order, state, horizon: int = HORIZON, block_years: int = BLOCK_YEARS
) -> DataFrame:
    """Rows until the next other state; `horizon` if a full window shows none; null if the
    timeline ends first."""
    d = with_changes(df, unit, order, state, horizon, block_years)
    return _clean(d.withColumn("target_time", _target_time(horizon)))


def target_state(
    df, unit, order, state, horizon: int = HORIZON, block_years: int = BLOCK_YEARS
) -> DataFrame:
    """The state at that change; the own state if there is none within the horizon."""
    d = with_changes(df, unit, order, state, horizon, block_years)
    return _clean(d.withColumn("target_state", _target_state(state, horizon)))


def example_flag(
    df, unit, order, state, quiet: int = QUIET_YEARS, block_years: int = BLOCK_YEARS
) -> DataFrame:
    """1 for rows that become examples: changes and every `quiet`-th year without one."""
    d = with_changes(df, unit, order, state, block_years=block_years)
    return _clean(d.withColumn("flag", _flag(quiet)))


def complete_flagged_rows(df: DataFrame, flag: str = "flag") -> DataFrame:
    """Rows without any null whose flag is 1."""
    return df.dropna().where(F.col(flag) == 1)


def example_history(
    df: DataFrame,
    unit: Sequence[str],
    order: str,
    state: str,
    res: str = "residence_time",
    n: int = HISTORY,
    block_years: int = BLOCK_YEARS,
) -> DataFrame:
    """State and residence time of the `n` examples before each one."""
    w = _in_block(unit, order)
    item = F.struct(F.col(order).alias("t"), F.col(state).alias("s"), F.col(res).alias("r"))
    latest = F.slice(F.sort_array(F.collect_list(item), asc=False), 1, n)
    none = F.array().cast("array<struct<t:bigint,s:string,r:int>>")

    def before(b):
        # every block here holds an example, so the n blocks before hold the n examples before
        return F.flatten(
            F.array(*[F.coalesce(F.lag("__latest", k).over(b), none) for k in range(1, n + 1)])
        )

    d = carry(
        _with_block(df, unit, order, block_years),
        unit,
        {"__latest": latest.cast("array<struct<t:bigint,s:string,r:int>>")},
        {"__before": before},
    ).withColumn("__rn", F.row_number().over(w))

    def lagged(col: str, field: str, k: int, default) -> Column:
        carried = F.get("__before", F.lit(k) - F.col("__rn"))[field]
        inside = F.lag(col, k).over(w)
        return F.coalesce(F.when(F.col("__rn") > k, inside).otherwise(carried), F.lit(default))

    for k in range(1, n + 1):
        d = d.withColumn(f"hist_state{k}", lagged(state, "s", k, MISSING))
    for k in range(1, n + 1):
        d = d.withColumn(f"hist_time{k}", lagged(res, "r", k, 0).cast("int"))
    return unkeyed(d.drop(BLOCK, "__before", "__rn"))


def augmentation_candidates(df: DataFrame, target_time: str = "target_time", drop=(1, 10)):
    """Examples whose horizon can be shortened."""
    return df.where(~F.col(target_time).isin(*drop))


def augmentation_shift(
    df: DataFrame,
    keys: Sequence[str],
    seed: int = 1,
    res: str = "residence_time",
    target_time: str = "target_time",
) -> DataFrame:
    """Move each example r years on, r drawn from 1..target_time-1 by hash of its keys."""
    r = (F.lit(1) + F.pmod(hash_int(*keys, seed=seed), F.col(target_time) - 1)).cast("int")
    return (
        df.withColumn("__r", r)
        .withColumn(res, F.col(res) + F.col("__r"))
        .withColumn(target_time, F.col(target_time) - F.col("__r"))
        .drop("__r")
    )


def flagged_examples(
    df: DataFrame,
    unit: Sequence[str],
    order: str,
    state: str,
    horizon: int = HORIZON,
    quiet: int = QUIET_YEARS,
    block_years: int = BLOCK_YEARS,
    keep_block: bool = False,
) -> DataFrame:
    """All columns of an example except its history, for the rows that are kept."""
    d = with_changes(df, unit, order, state, horizon, block_years)
    d = d.select(
        *df.columns,
        *([BLOCK, *key_names(unit)] if keep_block else []),
        F.coalesce(_PREV, state).alias("previous_year_state"),
        _residence().alias("residence_time"),
        _target_state(state, horizon).alias("target_state"),
        _target_time(horizon).alias("target_time"),
        _flag(quiet).alias("flag"),
    )
    return complete_flagged_rows(d)


def transition_qa(df: DataFrame, state: str = "svd_state", target: str = "target_state"):
    """Row count, states holding the text `NA`, distinct targets, and share without change."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(state).contains("NA")).alias("n_na_state"),
        F.countDistinct(target).alias("n_targets"),
        F.count_if(F.col(state) == F.col(target)).alias("n_no_change"),
        F.avg((F.col(state) == F.col(target)).cast("int")).alias("share_no_change"),
    )
