"""Operators on grid cells, outlines and hexagons.

Rasters are tables of cells, outlines are tables of edges (poly_id, x1, y1, x2, y2).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.joins import null_safe_join
from ..session import materialise

# Species of the study behind a class of the dominant-species map.
CLASS_SPECIES = {
    1: "Abies_alba",
    3: "Betula_pendula",
    7: "Fagus_sylvatica",
    12: "Pinus_halepensis",
    13: "Quercus_ilex",
    14: "Picea_abies",
    16: "Pinus_sylvestris",
    19: "Quercus_robur",
}
CONIFER_CLASSES = (1, 9, 14, 16)
LOSS_THRESHOLD = -5.0


def attach_to_grid(
    grid: DataFrame, result: DataFrame, species: str | None = None, rcp: str | None = None
) -> DataFrame:
    """All cells with the complete result rows of one species and scenario."""
    if species is not None:
        result = result.where(F.col("species") == species)
    if rcp is not None:
        result = result.where(F.col("rcp") == rcp)
    return grid.join(result.dropna(), ["point_id"], "left")


# widens the cells of an edge by more than its crossings can be off, in cells
_SLACK = 1e-6
_ENDS = ("x1", "y1", "x2", "y2")


def outline_cells(edges: DataFrame, side: float = 1.0) -> DataFrame:
    """(poly_id, __cx, __cy, __base, __edges, __ends): the cells of a square grid in which a point
    may be inside a closed outline, and what is needed to tell.

    A ray to the right of a point crosses edges that touch the point's cell (`__edges`) and edges
    wholly to the right of the cell. An edge crosses height y if one of its ends lies above y, so of
    the latter only the ends count: those above the whole row of cells make `__base`; those within
    the row are ends of two edges and cancel, but where only one of the two is to the right of
    the cell (`__ends`). A cell without edges is inside throughout, or left out."""
    low, high, row = F.least("y1", "y2"), F.greatest("y1", "y2"), F.col("__cy")
    slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    clipped = [
        F.col("x1") + (y - F.col("y1")) * slope
        for y in (F.greatest(low, row * side), F.least(high, (row + 1) * side))
    ]
    parts = (
        edges.select("poly_id", *[F.col(c).cast("double").alias(c) for c in _ENDS])
        .where(F.col("y1") != F.col("y2"))
        .withColumn("__cy", F.explode(F.sequence(F.floor(low / side), F.floor(high / side))))
        .withColumn("__from", F.floor(F.least(*clipped) / side - _SLACK))
        .withColumn("__to", F.floor(F.greatest(*clipped) / side + _SLACK))
    )
    of_row = ["poly_id", "__cy"]
    at = [*of_row, "__cx"]
    above = sum([(F.floor(F.col(c) / side) > row).cast("int") for c in ("y1", "y2")], F.lit(0))

    touched = parts.withColumn("__cx", F.explode(F.sequence("__from", "__to"))).select(
        *at, F.when(F.col("__cx") == F.col("__from"), above % 2).otherwise(0).alias("__weight"),
        F.struct(*_ENDS).alias("__edge"), F.lit(None).cast("double").alias("__end"),
    )
    # an end within the row counts to the left of one of its edges, but not of the other
    ends = (
        parts.withColumn("__end", F.explode(F.array("y1", "y2")))
        .where(F.floor(F.col("__end") / side) == row)
        .groupBy(*of_row, "__end")
        .agg(F.sort_array(F.collect_list("__from"), asc=False).alias("f"))
    )
    pair = F.explode(F.sequence(F.lit(0), F.floor(F.size("f") / 2).cast("int") - 1))
    alone = (
        ends.where(F.size("f") > 1)
        .select(*of_row, "__end", "f", pair.alias("i"))
        .select(
            *of_row, "__end",
            F.get("f", F.col("i") * 2 + 1).alias("a"), F.get("f", F.col("i") * 2).alias("b"),
        )
        .where(F.col("a") < F.col("b"))
        .withColumn("__cx", F.explode(F.sequence(F.col("a"), F.col("b") - 1)))
        .select(*at, F.lit(0).alias("__weight"), F.lit(None).cast(
            "struct<x1:double,y1:double,x2:double,y2:double>").alias("__edge"), "__end")
    )
    facts = touched.unionByName(alone).groupBy(*at).agg(
        F.sum("__weight").alias("__weight"),
        F.collect_list("__edge").alias("__edges"), F.collect_list("__end").alias("__ends"),
    )
    # the weights to the right, and the cells without facts up to the next one on the right
    to_right = Window.partitionBy(*of_row).orderBy(F.desc("__cx"))
    known = facts.withColumns({
        "__base": F.coalesce(F.sum("__weight").over(to_right.rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)) % 2,
        "__next": F.lag("__cx").over(to_right),
    })
    gap = known.where((F.col("__base") == 1) & (F.col("__next") > F.col("__cx") + 1))
    inside = gap.withColumn(
        "__cx", F.explode(F.sequence(F.col("__cx") + 1, F.col("__next") - 1))
    ).withColumns({"__edges": F.slice("__edges", 1, 0), "__ends": F.slice("__ends", 1, 0)})
    return known.unionByName(inside).select(*at, "__base", "__edges", "__ends")


def point_in_polygon(
    points: DataFrame, edges: DataFrame, x: str = "x", y: str = "y", band: float = 1.0
) -> DataFrame:
    """(points, poly_id) for points inside a closed outline, as often as they occur.

    A ray to the right of each point is crossed an odd number of times. Points meet the cells
    of side `band` that the outlines touch or hold (`outline_cells`), so a point only sees the edges
    of its own cell, and every pair of point and outline is settled in one row."""
    cells = outline_cells(edges, band)
    p = points.withColumns({
        "__cx": F.floor(F.col(x) / band), "__cy": F.floor(F.col(y) / band),
    })

    def crossed(e: Column) -> Column:
        at = (e["x2"] - e["x1"]) * (F.col(y) - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        return ((e["y1"] > F.col(y)) != (e["y2"] > F.col(y))) & (F.col(x) < at)

    crossings = (
        F.col("__base")
        + F.size(F.filter("__ends", lambda end: end > F.col(y)))
        + F.size(F.filter("__edges", crossed))
    )
    return (
        p.join(cells, ["__cx", "__cy"])
        .where(crossings % 2 == 1)
        .select(*[p[c] for c in points.columns], "poly_id")
    )


def polygon_union_mask(
    points: DataFrame,
    edges_a: DataFrame,
    edges_b: DataFrame,
    x: str = "x",
    y: str = "y",
    band: float = 1.0,
) -> DataFrame:
    """Points inside at least one of two sets of outlines, as often as they occur."""
    a = point_in_polygon(points, edges_a, x, y, band).drop("poly_id")
    b = point_in_polygon(points, edges_b, x, y, band).drop("poly_id")
    inside = a.unionByName(b).distinct()
    return null_safe_join(points, inside, points.columns, "left_semi")


def class_filter(cells: DataFrame, classes: Sequence[int], cls: str = "class") -> DataFrame:
    """The class where it is listed, else null."""
    return cells.withColumn(cls, F.when(F.col(cls).isin(*classes), F.col(cls)))


def modal_block(
    cells: DataFrame, fact: int = 10, ix: str = "ix", iy: str = "iy", cls: str = "class"
) -> DataFrame:
    """`modal`: the most frequent class of the cell's block of fact x fact cells, the smallest on
    ties; null where the cell has no class. Counts are taken per class before a block is
    reduced."""
    keyed = cells.withColumn("__bx", F.floor(F.col(ix) / fact)).withColumn(
        "__by", F.floor(F.col(iy) / fact)
    )
    modes = (
        keyed.where(F.col(cls).isNotNull())
        .groupBy("__bx", "__by", cls)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("__bx", "__by")
        .agg(F.max(F.struct(F.col("n"), (-F.col(cls)).alias("c"))).alias("m"))
        .select("__bx", "__by", (-F.col("m")["c"]).alias("__mode"))
    )
    return (
        keyed.join(modes, ["__bx", "__by"], "left")
        .withColumn("modal", F.when(F.col(cls).isNotNull(), F.col("__mode")))
        .drop("__bx", "__by", "__mode")
    )


def dominated_cells(
    cells: DataFrame, range_edges: DataFrame, cls: int, column: str = "class", band: float = 1.0
) -> DataFrame:
    """Distinct ids of cells of one class inside a range outline."""
    own = cells.where(F.col(column) == cls)
    return point_in_polygon(own, range_edges, band=band).select("point_id").distinct()


def range_sizes(
    cells: DataFrame,
    range_edges: DataFrame,
    class_of: Mapping[str, int],
    column: str = "class",
    band: float = 1.0,
) -> DataFrame:
    """Cells dominated by the species and cells with any class, inside its range (poly_id is the
    species); largest range first."""
    species_class = F.create_map(*[F.lit(v) for kv in class_of.items() for v in kv])
    inside = point_in_polygon(cells.where(F.col(column).isNotNull()), range_edges, band=band)
    return (
        inside.groupBy(F.col("poly_id").alias("species_name"))
        .agg(
            F.count_if(
                F.col(column) == F.try_element_at(species_class, F.col("poly_id"))
            ).alias("dom_range"),
            F.count(F.lit(1)).alias("whole_range"),
        )
        .orderBy(F.desc("whole_range"), "species_name")
    )


def class_share(
    cells: DataFrame,
    classes: Sequence[int] = CONIFER_CLASSES,
    mask: DataFrame | None = None,
    cls: str = "class",
) -> DataFrame:
    """Cells with a class, cells of the listed classes and their percentage; with a mask only the
    cells in it."""
    if mask is not None:
        cells = cells.join(mask.select("point_id").distinct(), ["point_id"], "left_semi")
    return cells.agg(
        F.count(cls).alias("n_all"),
        F.count_if(F.col(cls).isin(*classes)).alias("n_listed"),
    ).withColumn("pct", F.try_divide(F.lit(100.0) * F.col("n_listed"), F.col("n_all")))


def csi_grid(lai: DataFrame, height: DataFrame, grid: DataFrame) -> DataFrame:
    """Cell-wise mean of both net changes (null if either is), with least and greatest value per
    species and scenario. The cells are written, as they are read twice; the limits, one row per
    species and scenario, are written too, so that their size is known when they are joined."""
    keys = ["species", "rcp", "point_id"]
    a = lai.dropna().select(*keys, F.col("net_change").alias("a"))
    b = height.dropna().select(*keys, F.col("net_change").alias("b"))
    cells = materialise(
        a.join(b, keys, "full")
        .withColumn("csi", (F.col("a") + F.col("b")) / 2)
        .drop("a", "b")
        .join(grid.select("point_id", "x", "y"), ["point_id"]),
        "cells",
    )
    limits = materialise(
        cells.groupBy("species", "rcp").agg(
            F.min("csi").alias("min_csi"), F.max("csi").alias("max_csi")
        ),
        "limits",
    )
    return cells.join(limits, ["species", "rcp"])


def cell_mean_across_species(
    df: DataFrame,
    cell: Sequence[str] = ("rcp", "point_id"),
    value: str = "net_change",
    floor: float = LOSS_THRESHOLD,
) -> DataFrame:
    """Mean over species per cell, nulls ignored; what lies above `floor` becomes 0."""
    mean = F.avg(value)
    return df.groupBy(*cell).agg(F.when(mean > floor, 0.0).otherwise(mean).alias("mean_change"))


def value_of_dominant(
    cells: DataFrame,
    changes: DataFrame,
    class_species: Mapping[int, str] = CLASS_SPECIES,
    cls: str = "modal",
    value: str = "net_change",
) -> DataFrame:
    """Per cell the net change of the species that dominates it, for every scenario in `changes`;
    cells of other classes or without a change have no row."""
    species_of = F.create_map(*[F.lit(v) for kv in class_species.items() for v in kv])
    dominated = cells.withColumn("species", F.try_element_at(species_of, F.col(cls))).where(
        F.col("species").isNotNull()
    )
    change = changes.dropna().select("point_id", "species", "rcp", value)
    return dominated.join(change, ["point_id", "species"])


def negative_shift(
    df: DataFrame, cell: Sequence[str] = ("rcp", "point_id"), value: str = "net_change"
) -> DataFrame:
    """Sum over species per cell with gains cut to 0, and 1 where there is any value."""
    total = F.sum(value)
    return df.groupBy(*cell).agg(
        F.when(total > 0, 0.0).otherwise(total).alias("shift"),
        F.when(total.isNotNull(), 1).alias("present"),
    )


def hex_bin(
    points: DataFrame,
    kind: str = "hexagonal",
    cell_width: float | None = None,
    cell_area: float | None = None,
    x: str = "x",
    y: str = "y",
) -> DataFrame:
    """Index (bin_q, bin_r) of the hexagonal or square cell that holds a point."""
    width = geo.cell_width_of(kind, cell_width, cell_area)
    index = geo.hexagon_index if kind == "hexagonal" else geo.square_index
    q, r = index(F.col(x), F.col(y), width)
    return points.withColumns({"bin_q": q, "bin_r": r})


def hex_clip(
    binned: DataFrame, edges: DataFrame, x: str = "x", y: str = "y", band: float = 1.0
) -> DataFrame:
    """Distinct bins that hold at least one point of the study area."""
    inside = point_in_polygon(binned, edges, x, y, band)
    return inside.select("bin_q", "bin_r").distinct()


def hex_zonal_stats(
    binned: DataFrame,
    value: str = "shift",
    keys: Sequence[str] = ("rcp", "bin_q", "bin_r"),
) -> DataFrame:
    """Mean of the cell values per bin, nulls ignored, and the number of cells with a value."""
    return binned.groupBy(*keys).agg(
        F.avg(value).alias("mean_shift"), F.count(value).alias("n_cells")
    )


def loss_share(
    hexes: DataFrame,
    threshold: float = LOSS_THRESHOLD,
    value: str = "mean_shift",
    keys: Sequence[str] = ("rcp",),
) -> DataFrame:
    """Number and percent of bins at or below the threshold (loss = 1) and of the rest. A bin
    without a value, or with 0, is no loss."""
    v = F.coalesce(F.when(F.col(value) <= threshold, F.col(value)), F.lit(0.0))
    counts = hexes.groupBy(*keys, F.when(v != 0, 1).otherwise(0).alias("loss")).agg(
        F.count(F.lit(1)).alias("count")
    )
    total = F.sum("count").over(Window.partitionBy(*keys))
    return counts.withColumn("all", total).withColumn("pct", 100 * F.col("count") / F.col("all"))


def project_laea(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Equal-area coordinates in metres, columns `x_laea` and `y_laea`."""
    x, y = geo.laea(F.col(lon), F.col(lat))
    return points.withColumns({"x_laea": x, "y_laea": y})
