"""Dominance losses per hexagon, by scenario."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grid as g


def dominance_shift_map_table(
    cells: DataFrame,
    changes: DataFrame,
    rcps: Sequence[str],
    cell_width: float,
    fact: int = 10,
    class_species: Mapping[int, str] = g.CLASS_SPECIES,
    threshold: float = g.LOSS_THRESHOLD,
    area: DataFrame | None = None,
) -> DataFrame:
    """Share of hexagons that lose dominance. Cells carry point_id, x, y, ix, iy and class; every
    hexagon with a cell counts, also without a change. With the outlines of a study area (poly_id,
    x1, y1, x2, y2) hexagons are cut at its border: only cells inside one of them count. The modal
    classes come from all cells, as their blocks are not cut."""
    own = g.class_filter(cells, list(class_species))
    modal = g.modal_block(own, fact)
    dominant = g.value_of_dominant(
        modal, changes.where(F.col("rcp").isin(*rcps)), class_species
    )
    shift = g.negative_shift(dominant)
    studied = cells
    if area is not None:
        inside = g.point_in_polygon(cells.select("point_id", "x", "y"), area)
        studied = cells.join(inside.select("point_id").distinct(), ["point_id"], "left_semi")
    binned = g.hex_bin(studied, cell_width=cell_width).select("point_id", "bin_q", "bin_r")
    scenarios = binned.withColumn("rcp", F.explode(F.array(*[F.lit(r) for r in rcps])))
    values = scenarios.join(shift, ["rcp", "point_id"], "left")
    return g.loss_share(g.hex_zonal_stats(values), threshold)
