"""Joins that add site data to examples or take examples out.

No side is broadcast by hint: Spark broadcasts a side whose measured size is below
`spark.sql.autoBroadcastJoinThreshold`, otherwise it sorts and merges, and adaptive execution
splits keys that hold too many rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

SOIL = ("WHC", "TextureSand", "SoilDepth", "AvailableNitrogen")
FAN = 4  # children of a bin along each axis
TOP = 256  # bins at the top of a pyramid
INT_COLUMNS = ("uniqueID", "simulationID", "Year", "residence_time", "target_time")

# Sources whose simulations are not yearly.
NOT_YEARLY = (1005, 1015)


def _site(metadata: DataFrame, cols: Sequence[str]) -> DataFrame:
    return metadata.select("uniqueID", F.col("ID").alias("simulationID"), *cols)


def add_soil(examples: DataFrame, metadata: DataFrame) -> DataFrame:
    """Soil columns by (uniqueID, simulationID); the flag goes, identifiers become ints."""
    joined = examples.join(_site(metadata, SOIL), ["uniqueID", "simulationID"], "left").drop("flag")
    return joined.select(
        *[F.col(c).cast("int").alias(c) if c in INT_COLUMNS else F.col(c) for c in joined.columns]
    )


def add_coordinates(examples: DataFrame, metadata: DataFrame) -> DataFrame:
    return examples.join(_site(metadata, ("Lon", "Lat")), ["uniqueID", "simulationID"], "left")


def exclude_units(
    df: DataFrame, exclusions: DataFrame, keys: Sequence[str] = ("uniqueID", "simulationID")
) -> DataFrame:
    return df.join(exclusions.select(*keys).distinct(), list(keys), "left_anti")


def exclude_ids(df: DataFrame, key: str = "uniqueID", ids: Sequence[int] = NOT_YEARLY) -> DataFrame:
    """Rows whose key is not listed; null keys fall out too, as a comparison with them is unknown."""
    return df.where(~F.col(key).isin(*ids))


def scenario_partitions(
    df: DataFrame, scenario: str = "scenario", unit: str = "uniqueID", contains: str | None = None
) -> DataFrame:
    """Distinct (scenario, unit) pairs, sorted, without null scenarios."""
    d = df.where(F.col(scenario).isNotNull())
    if contains is not None:
        d = d.where(F.col(scenario).contains(contains))
    return d.select(scenario, unit).distinct().orderBy(scenario, unit)


def _gap(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - x, x - high, F.lit(0.0))


def nearest_grid_cell(
    points: DataFrame,
    grid: DataFrame,
    cell: float,
    lon: str = "lon",
    lat: str = "lat",
    keys: Sequence[str] = ("lon", "lat"),
) -> DataFrame:
    """Id of the grid cell (x, y, point_id; cell centres) that holds a point, else of the cell
    with the least |dlon| + |dlat|, the smaller id on ties. `keys` identify a point.

    Points inside a cell resolve by an equi-join on the cell index. The others walk down a stored
    pyramid of bins, four times as wide at each level: a bin stays only if it may still hold the
    nearest cell, so the search is exact and no point meets the whole grid. The grid is read once and
    written, with its bins, to the shared folder. Points without coordinates have no cell."""
    idx = lambda c, side: F.floor(c / F.lit(side) + F.lit(0.5)).cast("bigint")
    g = materialise(
        grid.select(
            F.col("x").alias("__x"), F.col("y").alias("__y"), "point_id",
            idx(F.col("x"), cell).alias("__ix"), idx(F.col("y"), cell).alias("__iy"),
        ),
        "cells",
    )
    homes = g.groupBy("__ix", "__iy").agg(F.min("point_id").alias("point_id"))
    p = points.withColumn("__ix", idx(F.col(lon), cell)).withColumn("__iy", idx(F.col(lat), cell))
    placed = p.join(homes, ["__ix", "__iy"], "left").drop("__ix", "__iy")

    lost = placed.where(F.col("point_id").isNull()).select(
        *keys, F.col(lon).cast("double").alias("__lon"), F.col(lat).cast("double").alias("__lat")
    ).distinct()
    found = _descend(lost, g, keys)
    found = found.withColumnRenamed("point_id", "__nearest")
    return (
        placed.join(found, list(keys), "left")
        .withColumn("point_id", F.coalesce("point_id", "__nearest"))
        .drop("__nearest")
    )


def _box(x_lo: str, x_hi: str, y_lo: str, y_hi: str) -> list[Column]:
    return [
        F.min(x_lo).alias("x_lo"), F.max(x_hi).alias("x_hi"),
        F.min(y_lo).alias("y_lo"), F.max(y_hi).alias("y_hi"),
    ]


def _low(b: Column) -> Column:
    """No cell of the box is nearer."""
    return _gap(F.col("__lon"), b["x_lo"], b["x_hi"]) + _gap(F.col("__lat"), b["y_lo"], b["y_hi"])


def _high(b: Column) -> Column:
    """Every box has a cell on each side, so one cell is no farther."""
    far = lambda v, lo, hi: F.greatest(F.abs(v - lo), F.abs(v - hi))
    return far(F.col("__lon"), b["x_lo"], b["x_hi"]) + far(F.col("__lat"), b["y_lo"], b["y_hi"])


def _pyramid(cells: DataFrame, width: int, height: int) -> list[DataFrame]:
    """Bins from the bottom up, each level made of the written one below. A row is a bin (bx, by)
    with its box and the boxes of its children; the last level has at most TOP bins."""
    boxes = _box("__x", "__x", "__y", "__y")
    levels = [cells.groupBy(F.col("__ix").alias("bx"), F.col("__iy").alias("by")).agg(*boxes)]
    while width * height > TOP:
        width, height = math.ceil(width / FAN), math.ceil(height / FAN)
        child = F.struct("bx", "by", "x_lo", "x_hi", "y_lo", "y_hi")
        above = levels[-1].groupBy(
            F.floor(F.col("bx") / FAN).alias("px"), F.floor(F.col("by") / FAN).alias("py")
        ).agg(*_box("x_lo", "x_hi", "y_lo", "y_hi"), F.collect_list(child).alias("children"))
        above = above.withColumnsRenamed({"px": "bx", "py": "by"})
        levels.append(materialise(above, "bins"))
    return levels


def _descend(lost: DataFrame, g: DataFrame, keys: Sequence[str]) -> DataFrame:
    extent = g.agg(
        F.min("__ix").alias("x0"), F.max("__ix").alias("x1"),
        F.min("__iy").alias("y0"), F.max("__iy").alias("y1"),
    ).first()
    if extent["x0"] is None or extent["y0"] is None:
        return lost.select(*keys, F.lit(None).cast("bigint").alias("point_id"))
    cells = g.where(F.col("__ix").isNotNull() & F.col("__iy").isNotNull()).withColumns({
        "__ix": F.col("__ix") - extent["x0"], "__iy": F.col("__iy") - extent["y0"],
    })
    levels = _pyramid(cells, extent["x1"] - extent["x0"] + 1, extent["y1"] - extent["y0"] + 1)

    # the boxes of the top level, at most TOP, meet a point as one array: no key holds all points
    box = F.struct("bx", "by", "x_lo", "x_hi", "y_lo", "y_hi")
    tops = levels[-1].agg(F.collect_list(box)).scalar()
    boxes = lost.withColumn("__boxes", tops)
    best = F.array_min(F.transform("__boxes", _high))
    state = boxes.withColumn("__best", best).select(
        *keys, "__lon", "__lat",
        F.inline(F.filter("__boxes", lambda b: _low(b) <= F.col("__best"))),
    )
    state = state.select(*keys, "__lon", "__lat", "bx", "by")
    for level in reversed(levels[1:]):
        step = state.join(level.select("bx", "by", "children"), ["bx", "by"])
        # a point has few bins left, and a window keeps each level from being computed twice
        near = F.array_min(F.transform("children", _high))
        step = step.withColumn("__best", F.min(near).over(Window.partitionBy(*keys)))
        state = step.select(
            *keys, "__lon", "__lat",
            F.inline(F.filter("children", lambda b: _low(b) <= F.col("__best"))),
        ).select(*keys, "__lon", "__lat", "bx", "by")
    cells = cells.select(
        F.col("__ix").alias("bx"), F.col("__iy").alias("by"), "__x", "__y", "point_id"
    )
    dist = F.abs(F.col("__lon") - F.col("__x")) + F.abs(F.col("__lat") - F.col("__y"))
    return (
        state.join(cells, ["bx", "by"])
        .groupBy(*keys)
        .agg(F.min(F.struct(dist.alias("d"), F.col("point_id"))).alias("m"))
        .select(*keys, F.col("m")["point_id"].alias("point_id"))
    )


def all_in(df: DataFrame, cols: Sequence[str], states: DataFrame, state: str) -> DataFrame:
    """Rows whose listed columns all occur in `states`: one semi join per column."""
    keep = lambda d, c: d.join(states.select(F.col(state).alias(c)), [c], "left_semi")
    return reduce(keep, cols, df).select(*df.columns)
