"""Competitive strength along the climate niche of each species."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join, tiled_join
from ..functions.scans import BLOCK, blocked_row_number, carry, key_names, preceding, whole
from ..functions.stats import mean_ci, species_group, with_interval
from ..session import materialise

CENTER = "center"
RCPS = ("rcp_2_6", "rcp_4_5", "rcp_8_5")
GROUPS = ("Broadleaved", "Coniferous")

# Names of the niche edges in the printed table.
EDGE_NAMES = {
    "center": "Core",
    "cold-dry": "Cold-dry edge",
    "cold-wet": "Cold-wet edge",
    "warm-dry": "Warm-dry edge",
}
OTHER_EDGE = "Warm-wet edge"


def edge_climate(edges: DataFrame) -> DataFrame:
    """Mean temperature and precipitation by point, edge and species."""
    return edges.groupBy("point_id", "edge", "species").agg(
        F.avg("MAT_avg").alias("MAT_avg"), F.avg("ANP_avg").alias("ANP_avg")
    )


def csi_by_edge(csi: DataFrame, edge_means: DataFrame) -> DataFrame:
    """CSI of each point with the edges it belongs to, complete rows only."""
    return (
        csi.select("species", "rcp", "point_id", "csi")
        .join(edge_means, ["species", "point_id"], "left")
        .dropna()
    )


def edge_group_ci(df: DataFrame) -> DataFrame:
    """Interval by edge, species group and scenario."""
    grouped = df.withColumn("sp_group", species_group("species"))
    return mean_ci(grouped, "csi", ("edge", "sp_group", "rcp"),
                   mean_name="mean_csi", sd_name="sd_csi")


def diff_to_center(df: DataFrame, center: str = CENTER) -> DataFrame:
    """Each edge minus the center of its group and scenario, with the two axes of the edge. The
    input has one row per edge, so the center comes from a small window, not a second scan."""
    core = F.max(F.when(F.col("edge") == center, F.col("mean_csi"))).over(
        Window.partitionBy("sp_group", "rcp")
    )
    return (
        df.withColumn("center_csi", core)
        .where(F.col("edge") != center)
        .select(
            "edge", "sp_group", "rcp",
            F.when(F.col("edge").contains("warm"), "warm").otherwise("cold").alias("x"),
            F.when(F.col("edge").contains("dry"), "dry").otherwise("wet").alias("y"),
            (F.col("mean_csi") - F.col("center_csi")).alias("diff_to_center"),
        )
    )


def species_edge_ci(df: DataFrame) -> DataFrame:
    """Distinct rows, then the interval by species, group, scenario and edge."""
    grouped = df.dropna().withColumn("sp_group", species_group("species", *GROUPS)).distinct()
    return mean_ci(grouped, "csi", ("species", "sp_group", "rcp", "edge"),
                   mean_name="mean_csi", sd_name="sd_csi")


def pooled_group_ci(
    df: DataFrame, keys: Sequence[str] = ("sp_group", "rcp", "edge")
) -> DataFrame:
    """Mean of species means, pooled standard deviation, standard error and interval."""
    pooled = F.sqrt(
        F.try_divide(
            F.sum((F.col("sum") - 1) * F.col("sd_csi") * F.col("sd_csi")), F.sum("sum") - 1
        )
    )
    stats = df.groupBy(*keys).agg(
        F.avg("mean_csi").alias("mean_csi_group"),
        pooled.alias("sd_group"),
        F.sum("sum").alias("total_sum"),
    )
    return with_interval(
        stats.withColumn("se_group", F.col("sd_group") / F.sqrt("total_sum")),
        "mean_csi_group", "se_group",
    )


def niche_table_wide(pooled: DataFrame, rcps: Sequence[str] = RCPS) -> DataFrame:
    """One row per edge; mean and standard error per scenario and group, rounded half to even."""
    columns = [f"{r}_{g}" for r in rcps for g in GROUPS]
    wide = (
        pooled.withColumn("col", F.concat_ws("_", "rcp", "sp_group"))
        .withColumn("edge", F.translate("edge", "_", "-"))
        .groupBy("edge")
        .pivot("col", columns)
        .agg(F.first("mean_csi_group").alias("mean"), F.first("se_group").alias("se"))
    )
    return wide.select(
        "edge",
        *[F.bround(f"{c}_mean", 1).alias(c) for c in columns],
        *[F.bround(f"{c}_se", 1).alias(f"{c}_SE") for c in columns],
    )


def niche_table_formatted(wide: DataFrame, rcps: Sequence[str] = RCPS) -> DataFrame:
    """`mean ±se` texts and printed edge names; a missing value prints as NA."""

    def text(c: str) -> Column:
        return F.when(F.col(c).isNull(), "NA").otherwise(F.format_string("%.1f", F.col(c)))

    edge = reduce(
        lambda acc, e: acc.when(F.col("edge") == e[0], e[1]),
        EDGE_NAMES.items(),
        F.when(F.lit(False), ""),
    ).otherwise(OTHER_EDGE)
    columns = [f"{r}_{g}" for r in rcps for g in GROUPS]
    return wide.select(
        edge.alias("edge"),
        *[F.concat(text(c), F.lit(" ±"), text(f"{c}_SE")).alias(c) for c in columns],
    )


def niche_table_two_scenarios(pooled: DataFrame) -> DataFrame:
    """The printed table without the middle scenario."""
    rcps = (RCPS[0], RCPS[2])
    return niche_table_formatted(niche_table_wide(pooled, rcps), rcps)


def bin_2d_mean(
    df: DataFrame,
    x: str,
    y: str,
    z: str,
    x_step: float = 0.5,
    y_step: float = 0.5,
    min_n: int = 10,
) -> DataFrame:
    """Rows with their bin on both axes, the mean of `z` in the bin, its row count and a dense id,
    for bins of more than `min_n` rows. Bins start at the floor of the least value. The rows are
    written first: the least values, the bins and the result read them."""
    df = materialise(df, "rows")
    low = df.agg(
        F.struct(F.floor(F.min(x)).alias("x"), F.floor(F.min(y)).alias("y"))
    ).scalar()
    binned = df.withColumns({
        "x_bin": low["x"] + F.floor((F.col(x) - low["x"]) / x_step) * x_step,
        "y_bin": low["y"] + F.floor((F.col(y) - low["y"]) / y_step) * y_step,
    }).dropna()
    table = materialise(
        binned.groupBy("x_bin", "y_bin").agg(
            F.avg(z).alias("bin_mean"), F.count(F.lit(1)).alias("n")
        ),
        "bins",
    )
    # the id counts every bin, also those dropped for their size
    table = blocked_row_number(table, [], F.col("x_bin"), ["x_bin", "y_bin"], "unique_id")
    return binned.join(table.where(F.col("n") > min_n), ["x_bin", "y_bin"])


def species_diff_to_center(
    df: DataFrame,
    center: str = CENTER,
    value: str = "csi",
    keys: Sequence[str] = ("species", "sp_group", "rcp"),
) -> DataFrame:
    """Differences of every edge row to every center row of its species, group and scenario, as a
    table of distinct value pairs with the number of row pairs behind each (`n_pairs`).

    Both sides are counted by value first, values rounded to ten places, and the counts are written.
    Net changes are shares of small counts, so few values stand for many rows, and no row pair is
    built. The values of a center are dealt into tiles that meet the edges in tasks of their own."""
    counted = materialise(
        df.withColumn(value, F.round(value, 10))
        .groupBy(*keys, "edge", value)
        .agg(F.count(F.lit(1)).alias("n")),
        "counts",
    )
    core = counted.where(F.col("edge") == center).select(
        *keys, F.col(value).alias("center_value"), F.col("n").alias("n_center")
    )
    return (
        tiled_join(counted.where(F.col("edge") != center), core, keys, "left")
        .groupBy(*keys, "edge", (F.col(value) - F.col("center_value")).alias("diff_to_center"))
        .agg(F.sum(F.col("n") * F.coalesce("n_center", F.lit(1))).alias("n_pairs"))
    )


def box_summary(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    weight: str | None = None,
    block_width: float = 1.0,
) -> DataFrame:
    """Exact quartiles (linear interpolation) and whisker ends (last value within 1.5 quartile
    ranges), per key. Values are counted first; the counts are written, as they are read several
    times, and ranked in blocks of `block_width`, so that no
    group is sorted in one task. `weight` counts a row that many times."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = materialise(
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("__n")), "counts"
    )
    d = carry(
        counts.withColumn(BLOCK, F.floor(F.col(value) / block_width)),
        keys,
        {"__rows": F.sum("__n")},
        {
            "__before": lambda w: F.coalesce(F.sum("__rows").over(preceding(w)), F.lit(0)),
            "__total": lambda w: F.sum("__rows").over(whole(w)),
        },
    )
    within = Window.partitionBy(*key_names(keys), BLOCK).orderBy(value)
    d = d.withColumn("__end", F.col("__before") + F.sum("__n").over(within)).withColumn(
        "__start", F.col("__end") - F.col("__n")
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__start") <= rank) & (rank < F.col("__end")), F.col(value)))

    quartiles = {}
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        h = (F.col("__total") - 1) * p
        quartiles[f"__{name}_lo"] = at(F.floor(h))
        quartiles[f"__{name}_hi"] = at(F.ceil(h))
    q = d.groupBy(*keys).agg(
        F.max("__total").alias("n"), *[c.alias(k) for k, c in quartiles.items()]
    )
    for name, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        h = (F.col("n") - 1) * p
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        q = q.withColumn(name, lo + (h - F.floor(h)) * (hi - lo))
    q = q.select(*keys, "n", "q1", "median", "q3")
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return (
        null_safe_join(counts, q, keys)
        .groupBy(*keys, "n", "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        )
    )


def linear_trend(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """Least-squares line of y on x per key."""
    return df.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_count(y, x).alias("n"),
    )
