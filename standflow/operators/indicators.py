"""Predictions to change indicators per grid point."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import statecode as sc
from ..functions.joins import dealt
from ..functions.scans import blocked_row_number

# Fixed values of the study.
BASELINE = ("1981-1990", "1991-2000", "2001-2010", "1981-2010")
RCPS = ("rcp_8_5", "rcp_4_5", "rcp_2_6")
HISTORICAL = "historical"
CLIMATE_MODELS = {"ICHEC-EC-EARTH": "ichec", "MPI-M-MPI-ESM-LR": "mpi"}
OTHER_MODEL = "ncc"

DIFF_PLACES = 10


def transition_time_expr(k: int = 3) -> Column:
    add = lambda a, b: a + b
    weighted = reduce(
        add, [F.col(f"time_index_{i}") * F.col(f"time_proba_{i}") for i in range(1, k + 1)]
    )
    return F.try_divide(weighted, reduce(add, [F.col(f"time_proba_{i}") for i in range(1, k + 1)]))


def expected_transition_time(df: DataFrame, k: int = 3) -> DataFrame:
    """Mean of the k likeliest times, weighted by probability; null if their sum is zero."""
    return df.withColumn("t_time_est", transition_time_expr(k))


def parse_prediction(
    df: DataFrame, state: str = "state", pred: str = "pred_state_1"
) -> DataFrame:
    """Composition, leaf-area class and upper height of initial and predicted state."""
    return df.withColumns({
        "sp_init": sc.composition(state),
        "lai_init": sc.lai_class(state),
        "height_init": sc.height_high(state),
        "sp_pred": sc.composition(pred),
        "lai_pred": sc.lai_class(pred),
        "height_pred": sc.height_high(pred),
    })


def _holds(text: Column, piece: Column) -> Column:
    """Text search that answers no for a null."""
    return F.coalesce(F.contains(text, piece), F.lit(False))


def same_vegetation(df: DataFrame) -> DataFrame:
    """1 if the predicted composition contains the initial one, upper and lower case apart."""
    return df.withColumn(
        "veg_same", F.when(_holds(F.col("sp_pred"), F.col("sp_init")), 1).otherwise(0)
    )


def lai_change_rate(df: DataFrame) -> DataFrame:
    """Change of leaf-area class per year; 0 where the vegetation is another."""
    change = F.when(F.col("veg_same") == 0, 0).otherwise(F.col("lai_pred") - F.col("lai_init"))
    return df.withColumn("lai_diff", F.try_divide(change, F.col("t_time_est")))


def growth_rate(df: DataFrame) -> DataFrame:
    """Direction of height change per year; 0 where the vegetation is another."""
    change = F.when(F.col("veg_same") == 0, 0).otherwise(
        F.col("height_pred") - F.col("height_init")
    )
    return df.withColumn("growth", F.try_divide(F.signum(change), F.col("t_time_est")))


def dominance_shift(df: DataFrame) -> DataFrame:
    """0 if the dominant species stays dominant, 1 if it is only admixed or the second species has
    taken over, null otherwise. An empty second species is found in any prediction."""
    first = F.substring("sp_init", 1, 4)
    second = F.substring("sp_init", 5, 4)
    pred = F.col("sp_pred")
    shift = F.when(_holds(pred, first), 0).when(
        _holds(pred, F.lower(first)) | _holds(pred, F.upper(second)), 1
    )
    return df.withColumn("veg_diff", shift).withColumn(
        "veg_diff_rate", F.try_divide(F.col("veg_diff"), F.col("t_time_est"))
    )


def climate_model_tag(df: DataFrame, source: str = "source") -> DataFrame:
    """Short name of the climate model in the source name."""
    tag = reduce(
        lambda acc, m: acc.when(F.col(source).contains(m[0]), m[1]),
        CLIMATE_MODELS.items(),
        F.when(F.lit(False), ""),
    )
    return df.withColumn("scen", tag.otherwise(OTHER_MODEL))


def row_ids_and_tags(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    block: Column,
    tags: dict[str, Column] | None = None,
) -> DataFrame:
    """Constant tags, and a running `id` per input part along `order`; `block` cuts a part into
    pieces that follow that order."""
    tagged = df.withColumns(tags) if tags else df
    return blocked_row_number(tagged, part, block, order, "id")


def scenario_fanout(
    df: DataFrame, rcps: Sequence[str] = RCPS, rcp: str = "rcp", historical: str = HISTORICAL
) -> DataFrame:
    """Historical rows take part in every scenario; other scenarios than those listed drop out."""
    targets = F.when(F.col(rcp) == historical, F.array(*[F.lit(r) for r in rcps])).otherwise(
        F.filter(F.array(*[F.lit(r) for r in rcps]), lambda r: r == F.col(rcp))
    )
    return df.withColumn(rcp, F.explode(targets))


def baseline_future_means(
    df: DataFrame,
    var: str,
    keys: Sequence[str] = ("species", "rcp", "point_id", "init_state", "scen"),
    baseline: Sequence[str] = BASELINE,
    timestep: str = "timestep",
) -> DataFrame:
    """Mean in the baseline decades and in the later ones, for groups with a later row. One pass;
    the same as joining the baseline means to the later ones from the left. A group has few rows, so
    rows are dealt by group first."""
    is_base = F.col(timestep).isin(*baseline)
    later = ~is_base
    others = [c for c in dict.fromkeys((timestep, var)) if c not in keys]
    return (
        dealt(df, keys, others)
        .groupBy(*keys)
        .agg(
            F.avg(F.when(is_base, F.col(var))).alias("var_base"),
            F.avg(F.when(later, F.col(var))).alias("var_fut"),
            F.count_if(later).alias("__later"),
        )
        .where(F.col("__later") > 0)
        .drop("__later")
    )


def net_change(
    df: DataFrame,
    point: Sequence[str] = ("species", "rcp", "point_id"),
    sign: int = 1,
) -> DataFrame:
    """Counts of falling and rising differences per point, mean difference, number of rows (nulls
    counted) and the net share in percent.

    A distributed mean has no fixed summation order, so differences are rounded to DIFF_PLACES
    before their sign is read; otherwise equal means could count as a change."""
    diff = F.round((F.col("var_fut") - F.col("var_base")) * sign, DIFF_PLACES)
    return (
        df.withColumn("__diff", diff)
        .groupBy(*point)
        .agg(
            F.count_if(F.col("__diff") < 0).alias("net_negative"),
            F.count_if(F.col("__diff") > 0).alias("net_positive"),
            F.avg("__diff").alias("diff"),
            F.count(F.lit(1)).alias("sum"),
        )
        .withColumn(
            "net_change", (F.col("net_positive") - F.col("net_negative")) / F.col("sum") * 100
        )
    )


def prediction_uncertainty(
    df: DataFrame,
    rcps: Sequence[str] = RCPS,
    baseline: Sequence[str] = BASELINE,
    state_proba: str = "state_proba_1",
    time_proba: str = "time_proba_1",
) -> DataFrame:
    """Mean state and time probability per point before and after the baseline end; a null makes
    the mean of its group null. Historical rows are summed before the sums take part in every
    scenario."""
    means = {"mean_state_proba": state_proba, "mean_time_proba": time_proba}
    period = F.when(F.col("timestep").isin(*baseline), "historical").otherwise("future")
    sums = df.groupBy("species", "rcp", period.alias("period"), "point_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"sum_{m}") for m, c in means.items()],
        *[F.count(c).alias(f"n_{m}") for m, c in means.items()],
    )

    def strict_mean(m: str) -> Column:
        return F.when(F.sum(f"n_{m}") == F.sum("n"), F.sum(f"sum_{m}") / F.sum("n"))

    return (
        scenario_fanout(sums, rcps)
        .groupBy("species", "rcp", "period", "point_id")
        .agg(*[strict_mean(m).alias(m) for m in means])
    )
