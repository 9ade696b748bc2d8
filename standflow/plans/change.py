"""Predictions of all species and scenarios to net changes per grid point."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import dealt
from ..operators import indicators as ind


def rates(preds: DataFrame) -> DataFrame:
    """Leaf-area and growth rate of each prediction row."""
    d = ind.same_vegetation(ind.parse_prediction(ind.expected_transition_time(preds)))
    return ind.growth_rate(ind.lai_change_rate(d)).withColumnRenamed("state", "init_state")


def _changes(
    df: DataFrame, signs: Mapping[str, int], rcps: Sequence[str], baseline: Sequence[str]
) -> DataFrame:
    """One row per species, scenario and point, one struct of change counts per variable.

    All variables and scenarios share one scan and one shuffle: sums and counts per scenario are
    conditional aggregates of a (point, initial state, climate model) group, so historical rows
    are not copied for each scenario. A group has few rows, so rows are dealt by group first."""
    is_base = F.col("timestep").isin(*baseline)
    sums = {}
    for r in rcps:
        own = F.col("rcp").isin(r, ind.HISTORICAL)
        sums[f"{r}_later"] = F.count_if(own & ~is_base)
        for v in signs:
            for side, rows in (("base", own & is_base), ("fut", own & ~is_base)):
                sums[f"{r}_{v}_{side}_s"] = F.sum(F.when(rows, F.col(v)))
                sums[f"{r}_{v}_{side}_n"] = F.count(F.when(rows, F.col(v)))
    keys = ["species", "point_id", "init_state", "scen"]
    wide = dealt(df, keys, ["rcp", "timestep", *signs]).groupBy(*keys).agg(
        *[c.alias(n) for n, c in sums.items()]
    )
    names = ["later", *[f"{v}_{s}_{k}" for v in signs for s in ("base", "fut") for k in "sn"]]
    per_rcp = F.array(*[
        F.struct(F.lit(r).alias("rcp"), *[F.col(f"{r}_{n}").alias(n) for n in names]) for r in rcps
    ])
    groups = wide.select("species", "point_id", F.inline(per_rcp)).where(F.col("later") > 0)
    parts = []
    for v, sign in signs.items():
        base, fut = (F.try_divide(f"{v}_{s}_s", f"{v}_{s}_n") for s in ("base", "fut"))
        diff = F.round((fut - base) * sign, ind.DIFF_PLACES)
        down, up, n = F.count_if(diff < 0), F.count_if(diff > 0), F.count(F.lit(1))
        parts.append(
            F.struct(
                down.alias("net_negative"), up.alias("net_positive"), F.avg(diff).alias("diff"),
                n.alias("sum"), ((up - down) / n * 100).alias("net_change"),
            ).alias(v)
        )
    return groups.groupBy("species", "rcp", "point_id").agg(*parts)


def _result(changes: DataFrame, var: str, indicator: str) -> DataFrame:
    return changes.select(
        "point_id", f"{var}.*", F.lit(indicator).alias("indicator"), "rcp", "species"
    )


def lai_net_change(
    preds: DataFrame, rcps: Sequence[str] = ind.RCPS, baseline: Sequence[str] = ind.BASELINE
) -> DataFrame:
    return _result(_changes(rates(preds), {"lai_diff": 1}, rcps, baseline), "lai_diff", "1")


def growth_net_change(
    preds: DataFrame, rcps: Sequence[str] = ind.RCPS, baseline: Sequence[str] = ind.BASELINE
) -> DataFrame:
    return _result(_changes(rates(preds), {"growth": 1}, rcps, baseline), "growth", "2")


def dominance_net_change(
    preds: DataFrame, rcps: Sequence[str] = ind.RCPS, baseline: Sequence[str] = ind.BASELINE
) -> DataFrame:
    """Losses of dominance count as negative."""
    d = ind.dominance_shift(ind.parse_prediction(ind.expected_transition_time(preds)))
    d = d.withColumnRenamed("state", "init_state")
    return _result(_changes(d, {"veg_diff": -1}, rcps, baseline), "veg_diff", "1")


def csi_from_predictions(
    preds: DataFrame, rcps: Sequence[str] = ind.RCPS, baseline: Sequence[str] = ind.BASELINE
) -> DataFrame:
    """Both components and their mean per species, scenario and point, from one pass over the
    predictions; equals joining the two result tables."""
    changes = _changes(rates(preds), {"lai_diff": 1, "growth": 1}, rcps, baseline)
    return changes.select(
        "species", "rcp", "point_id",
        F.col("lai_diff.diff").alias("diff_lai"),
        F.col("lai_diff.net_change").alias("net_change_lai"),
        F.col("growth.diff").alias("diff_hei"),
        F.col("growth.net_change").alias("net_change_hei"),
        ((F.col("lai_diff.net_change") + F.col("growth.net_change")) / 2).alias("csi"),
    )
