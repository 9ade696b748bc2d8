"""Summary expressions shared by the competition and niche tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The broadleaved species of the study; every other one is coniferous.
BROADLEAVED = ("Fagus_sylvatica", "Quercus_robur", "Betula_pendula", "Quercus_ilex")

# Scenario labels of the result tables and of the figures.
RCP_LABELS = {"rcp_2_6": "RCP2.6", "rcp_4_5": "RCP4.5", "rcp_8_5": "RCP8.5"}


def species_group(
    species: Column | str, broadleaved: str = "broadleaved", coniferous: str = "coniferous"
) -> Column:
    """Group of a species, for names written with `_` or with a space."""
    name = F.translate(F.col(species) if isinstance(species, str) else species, " ", "_")
    return F.when(name.isin(*BROADLEAVED), broadleaved).otherwise(coniferous)


def mean_ci(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    z: float = 1.96,
    mean_name: str = "mean",
    sd_name: str = "sd",
) -> DataFrame:
    """Mean, standard deviation, row count (nulls counted), standard error and interval by key."""
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias(mean_name),
        F.stddev_samp(value).alias(sd_name),
        F.count(F.lit(1)).alias("sum"),
    )
    return with_interval(stats.withColumn("se", F.col(sd_name) / F.sqrt("sum")), mean_name, "se", z)


def with_interval(df: DataFrame, mean_name: str, se_name: str, z: float = 1.96) -> DataFrame:
    return df.withColumn("upper", F.col(mean_name) + F.lit(z) * F.col(se_name)).withColumn(
        "lower", F.col(mean_name) - F.lit(z) * F.col(se_name)
    )
