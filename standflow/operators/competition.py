"""Competitive strength (CSI) per species, scenario and area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import RCP_LABELS, mean_ci, species_group

KEYS = ("species", "rcp", "point_id")


def csi(lai: DataFrame, height: DataFrame) -> DataFrame:
    """Mean of the net changes of leaf area and height, per species, scenario and point."""
    left = lai.select(*KEYS, F.col("diff").alias("diff_lai"),
                      F.col("net_change").alias("net_change_lai"))
    right = height.select(*KEYS, F.col("diff").alias("diff_hei"),
                          F.col("net_change").alias("net_change_hei"))
    return left.join(right, list(KEYS), "left").withColumn(
        "csi", (F.col("net_change_lai") + F.col("net_change_hei")) / 2
    )


def rcp_label(rcp: Column) -> Column:
    low, mid, high = RCP_LABELS.values()
    return F.when(rcp == "rcp_2_6", low).when(rcp == "rcp_4_5", mid).otherwise(high)


def relabel(df: DataFrame) -> DataFrame:
    """Scenario and species names as in the figures; the scenario column becomes `RCP`."""
    return df.withColumn("RCP_label", rcp_label(F.col("rcp"))).drop("rcp").withColumnRenamed(
        "RCP_label", "RCP"
    ).withColumn("species", F.translate("species", "_", " "))


def species_order(df: DataFrame, key: str = "species", value: str = "csi") -> DataFrame:
    """Species by falling mean. A null makes the mean of its species null."""
    mean = F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))
    return df.groupBy(key).agg(mean.alias("avg")).orderBy(F.desc_nulls_last("avg"), key)


def group_mean_of_means(
    df: DataFrame, key: str = "species", value: str = "csi", group: Column | None = None
) -> DataFrame:
    """Mean over species of the species means, by species group."""
    means = species_order(df, key, value)
    group = species_group(key) if group is None else group
    strict = F.when(F.count("avg") == F.count(F.lit(1)), F.avg("avg"))
    return means.groupBy(group.alias("sp_group")).agg(strict.alias("avg"))


def area_share_by_sign(df: DataFrame, key: str = "species", value: str = "csi") -> DataFrame:
    """Percent of cells below and above zero; cells without a value stay in the total."""
    return (
        df.groupBy(key)
        .agg(
            F.count_if(F.col(value) < 0).alias("net_negative"),
            F.count_if(F.col(value) > 0).alias("net_positive"),
            F.count(F.lit(1)).alias("sum"),
        )
        .withColumn("pct_neg", 100 / F.col("sum") * F.col("net_negative"))
        .withColumn("pct_pos", 100 / F.col("sum") * F.col("net_positive"))
    )


def csi_ci(df: DataFrame, value: str = "csi", keys: Sequence[str] = ("species", "RCP")):
    return mean_ci(df, value, keys, mean_name="mean_csi", sd_name="sd_csi")


def component_ci(result: DataFrame, component: str = "net_change") -> DataFrame:
    """Interval of one component (leaf area or height) by species and scenario label."""
    return mean_ci(relabel(result.select("species", "rcp", component)), component,
                   ("species", "RCP"))


def join_range_size(summary: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds range sizes by species; the area is cells / 100."""
    named = ranges.select(
        F.translate("species_name", "_", " ").alias("species"), "dom_range", "whole_range"
    )
    return summary.join(named, ["species"], "left").withColumn(
        "range_area", F.col("whole_range") / 100
    )
