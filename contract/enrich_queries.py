"""Joins that add site data or take rows out."""

from pyspark.sql import functions as F

from standflow.operators import enrich

from .bindings import UNIT, enriched_examples, examples, query, shared, table

_INTS = ", ".join(
    f"CAST({c} AS INT) AS {c}"
    for c in ("uniqueID", "simulationID", "Year", "residence_time", "target_time")
)


@query("add_soil", f"""
    SELECT * EXCLUDE (flag, Lon, Lat, grid_id, scenario) REPLACE ({_INTS}) FROM {{b_examples}}""")
def _(spark, d):
    return enrich.add_soil(examples(spark, d), shared(spark, d, "b_metadata"))


@query("add_coordinates", """
    SELECT * EXCLUDE (WHC, TextureSand, SoilDepth, AvailableNitrogen, grid_id, scenario)
    FROM {b_examples}""")
def _(spark, d):
    return enrich.add_coordinates(examples(spark, d), shared(spark, d, "b_metadata"))


@query("exclude_units", """
    SELECT * FROM {t_examples} WHERE (uniqueID, simulationID) NOT IN
    (SELECT (uniqueID, ID) FROM {b_metadata} WHERE WHC < 3000)""")
def _(spark, d):
    low = shared(spark, d, "b_metadata").where("WHC < 3000").withColumnRenamed("ID", "simulationID")
    return enrich.exclude_units(examples(spark, d), low)


# points lie on a coarse lattice around the grid, half of them outside
@query("nearest_grid_cell", """
    SELECT o_orderkey, lon, lat,
           coalesce((SELECT min(g.point_id) FROM {b_grid} g
                     WHERE floor(lon / 0.5 + 0.5) = floor(g.x / 0.5 + 0.5)
                       AND floor(lat / 0.5 + 0.5) = floor(g.y / 0.5 + 0.5)),
                    n.point_id) AS point_id
    FROM (SELECT o_orderkey, CAST((o_orderkey % 53) * 0.6 - 4 AS DOUBLE) AS lon,
                 CAST(36 + (o_custkey % 41) * 0.7 AS DOUBLE) AS lat FROM orders) p
    JOIN (SELECT plon, plat, min_by(point_id, d * 1000000 + point_id) AS point_id
          FROM (SELECT plon, plat, g.point_id,
                       round(abs(plon - g.x) + abs(plat - g.y), 6) AS d
                FROM (SELECT DISTINCT CAST((o_orderkey % 53) * 0.6 - 4 AS DOUBLE) AS plon,
                             CAST(36 + (o_custkey % 41) * 0.7 AS DOUBLE) AS plat FROM orders) q,
                     {b_grid} g) c
          GROUP BY ALL) n ON n.plon = p.lon AND n.plat = p.lat""")
def _(spark, d):
    points = table(spark, d, "orders").select(
        "o_orderkey",
        ((F.col("o_orderkey") % 53) * 0.6 - 4).cast("double").alias("lon"),
        (36 + (F.col("o_custkey") % 41) * 0.7).cast("double").alias("lat"),
    )
    return enrich.nearest_grid_cell(points, shared(spark, d, "b_grid"), 0.5)


@query("exclude_ids", "SELECT * FROM {t_examples} WHERE uniqueID NOT IN (3, 7)")
def _(spark, d):
    return enrich.exclude_ids(examples(spark, d), "uniqueID", (3, 7))


@query("scenario_partitions", """
    SELECT DISTINCT scenario, uniqueID FROM {b_examples} WHERE contains(scenario, 'rcp')""")
def _(spark, d):
    return enrich.scenario_partitions(enriched_examples(spark, d), contains="rcp")
