"""Grid, outline and hexagon operators."""

from pyspark.sql import functions as F

from standflow.operators import grid as g
from standflow.plans import change, shift_map

from .bindings import query, r6, shared

# Outlines over the grid as vertex lists: one convex, one with a notch, and one small square.
OUTLINES = {
    "Fagus_sylvatica": ((1.2, 40.3), (15.1, 40.3), (18.4, 47.2), (9.3, 57.6), (2.1, 50.7)),
    "Picea_abies": ((0.3, 41.1), (19.2, 41.1), (19.2, 58.9), (10.1, 45.3), (0.3, 58.9)),
    "Pinus_sylvestris": ((4.1, 43.1), (6.6, 43.1), (6.6, 45.6), (4.1, 45.6)),
}
EDGE_ROWS = [
    (name, *ring[i], *ring[(i + 1) % len(ring)])
    for name, ring in OUTLINES.items()
    for i in range(len(ring))
]
CLASS_OF = {"Fagus_sylvatica": 7, "Picea_abies": 14, "Pinus_sylvestris": 16}


def edges(spark, *names):
    rows = [e for e in EDGE_ROWS if not names or e[0] in names]
    return spark.createDataFrame(
        rows, "poly_id string, x1 double, y1 double, x2 double, y2 double"
    )


_EDGES = "edges AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{p}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for p, a, b, c, e in EDGE_ROWS
) + ") e(poly_id, x1, y1, x2, y2))"
# every cell against every edge
_INSIDE = f"""{_EDGES},
    inside AS (SELECT * EXCLUDE (crossings) FROM (
      SELECT g.*, poly_id, count(*) FILTER (
               ((y1 <= y AND y < y2) OR (y2 <= y AND y < y1))
               AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) AS crossings
      FROM {{b_grid}} g, edges GROUP BY ALL) c WHERE crossings % 2 = 1)"""


def cells(spark, d):
    return shared(spark, d, "b_grid")


def lai(spark, d):
    return change.lai_net_change(shared(spark, d, "b_predictions"))


def dominance(spark, d):
    return change.dominance_net_change(shared(spark, d, "b_predictions"))


# Written as one aggregate: the engine behind the SQL fails on a constant filter below this join.
@query("attach_to_grid", """
    SELECT g.point_id, g.x, g.y, any_value(r.species) FILTER (hit) AS species,
           any_value(r.rcp) FILTER (hit) AS rcp,
           round(any_value(r.net_change) FILTER (hit), 6) AS net_change
    FROM {b_grid} g
    LEFT JOIN (SELECT *, species = 'Picea_abies' AND rcp = 'rcp_8_5' AND diff IS NOT NULL AS hit
               FROM {g_lai}) r USING (point_id)
    GROUP BY g.point_id, g.x, g.y""")
def _(spark, d):
    out = g.attach_to_grid(cells(spark, d), lai(spark, d), "Picea_abies", "rcp_8_5")
    return r6(out.select("point_id", "x", "y", "species", "rcp", "net_change"), "net_change")


@query("point_in_polygon", f"WITH {_INSIDE} SELECT point_id, poly_id FROM inside")
def _(spark, d):
    inside = g.point_in_polygon(cells(spark, d), edges(spark))
    return inside.select("point_id", "poly_id")


@query("polygon_union_mask", f"""
    WITH {_INSIDE} SELECT DISTINCT point_id, x, y FROM inside WHERE poly_id <> 'Pinus_sylvestris'
    """)
def _(spark, d):
    points = cells(spark, d).select("point_id", "x", "y")
    return g.polygon_union_mask(
        points, edges(spark, "Fagus_sylvatica"), edges(spark, "Picea_abies")
    )


@query("class_filter", """
    SELECT point_id, CASE WHEN class IN (1, 3, 7, 12, 13, 14, 16, 19) THEN class END AS class
    FROM {b_grid}""")
def _(spark, d):
    return g.class_filter(cells(spark, d), list(g.CLASS_SPECIES)).select("point_id", "class")


_MODAL = """
    SELECT g.*, CASE WHEN g.class IS NOT NULL THEN m.class END AS modal
    FROM grid g LEFT JOIN (
      SELECT bx, by_, class FROM (
        SELECT *, row_number() OVER (PARTITION BY bx, by_ ORDER BY n DESC, class) AS r
        FROM (SELECT floor(ix / {fact}) AS bx, floor(iy / {fact}) AS by_, class, count(*) AS n
              FROM grid WHERE class IS NOT NULL GROUP BY ALL) c) d WHERE r = 1) m
      ON m.bx = floor(g.ix / {fact}) AND m.by_ = floor(g.iy / {fact})"""


@query("modal_block", f"""
    WITH grid AS (SELECT * FROM {{b_grid}})
    SELECT point_id, class, modal FROM ({_MODAL.replace("{fact}", "10")}) m""")
def _(spark, d):
    return g.modal_block(cells(spark, d)).select("point_id", "class", "modal")


@query("dominated_cells", f"""
    WITH {_INSIDE} SELECT DISTINCT point_id FROM inside
    WHERE poly_id = 'Picea_abies' AND class = 14""")
def _(spark, d):
    return g.dominated_cells(cells(spark, d), edges(spark, "Picea_abies"), 14)


@query("range_sizes", f"""
    WITH {_INSIDE} SELECT poly_id AS species_name, count(*) FILTER (class = CASE poly_id
           WHEN 'Fagus_sylvatica' THEN 7 WHEN 'Picea_abies' THEN 14 ELSE 16 END) AS dom_range,
           count(*) AS whole_range
    FROM inside WHERE class IS NOT NULL GROUP BY poly_id""")
def _(spark, d):
    return g.range_sizes(cells(spark, d), edges(spark), CLASS_OF)


@query("class_share", f"""
    WITH {_INSIDE},
    masked AS (SELECT 'all' AS mask, class FROM {{b_grid}}
             UNION ALL SELECT 'range', class FROM inside WHERE poly_id = 'Picea_abies')
    SELECT mask, count(class) AS n_all, count(*) FILTER (class IN (1, 9, 14, 16)) AS n_listed,
           round(100.0 * count(*) FILTER (class IN (1, 9, 14, 16)) / count(class), 6) AS pct
    FROM masked GROUP BY mask""")
def _(spark, d):
    mask = g.point_in_polygon(cells(spark, d), edges(spark, "Picea_abies"))
    all_cells = g.class_share(cells(spark, d)).withColumn("mask", F.lit("all"))
    masked = g.class_share(cells(spark, d), mask=mask).withColumn("mask", F.lit("range"))
    return r6(all_cells.unionByName(masked), "pct")


@query("csi_grid", """
    SELECT species, rcp, point_id, x, y, round(csi, 6) AS csi,
           round(min(csi) OVER w, 6) AS min_csi, round(max(csi) OVER w, 6) AS max_csi
    FROM (SELECT c.species, c.rcp, g.point_id, g.x, g.y,
                 CASE WHEN diff_lai IS NOT NULL AND diff_hei IS NOT NULL THEN csi END AS csi
          FROM {g_csi} c JOIN {b_grid} g USING (point_id)
          WHERE diff_lai IS NOT NULL OR diff_hei IS NOT NULL) a
    WINDOW w AS (PARTITION BY species, rcp)""")
def _(spark, d):
    hei = change.growth_net_change(shared(spark, d, "b_predictions"))
    return r6(g.csi_grid(lai(spark, d), hei, cells(spark, d)), "csi", "min_csi", "max_csi")


@query("cell_mean_across_species", """
    SELECT rcp, point_id, round(CASE WHEN avg(net_change) > -5 THEN 0 ELSE avg(net_change) END, 6)
           AS mean_change FROM {g_dom} GROUP BY ALL""")
def _(spark, d):
    return r6(g.cell_mean_across_species(dominance(spark, d)), "mean_change")


_CLASS_SPECIES = "(VALUES " + ", ".join(f"({c}, '{s}')" for c, s in g.CLASS_SPECIES.items()) + (
    ") k(cls, species)"
)


def _dominant(fact: int, listed: bool) -> str:
    """Modal classes, and the change of the species behind them."""
    source = (
        "SELECT * REPLACE (CASE WHEN class IN (1, 3, 7, 12, 13, 14, 16, 19) THEN class END AS class)"
        if listed else "SELECT *"
    )
    return f"""
    grid AS ({source} FROM {{b_grid}}), modal AS ({_MODAL.replace("{fact}", str(fact))}),
    dominant AS (SELECT m.point_id, m.modal, k.species, c.rcp, c.net_change
                 FROM modal m JOIN {_CLASS_SPECIES} ON k.cls = m.modal
                 JOIN (SELECT * FROM {{g_dom}} WHERE diff IS NOT NULL) c
                   ON c.point_id = m.point_id AND c.species = k.species)"""


@query("value_of_dominant", f"""
    WITH {_dominant(2, False)}
    SELECT point_id, species, rcp, modal, round(net_change, 6) AS net_change FROM dominant""")
def _(spark, d):
    out = g.value_of_dominant(g.modal_block(cells(spark, d), 2), dominance(spark, d))
    return r6(out.select("point_id", "species", "rcp", "modal", "net_change"), "net_change")


@query("negative_shift", """
    SELECT rcp, point_id, round(CASE WHEN sum(net_change) > 0 THEN 0 ELSE sum(net_change) END, 6)
           AS shift, CASE WHEN sum(net_change) IS NOT NULL THEN 1 END AS present
    FROM {g_dom} GROUP BY ALL""")
def _(spark, d):
    return r6(g.negative_shift(dominance(spark, d)), "shift")


# The nearest of all hexagon centres around a point, instead of coordinate rounding. Points are
# moved off the grid so that none lies on a border.
_W = 1.7
_HEX = f"""
    SELECT point_id, px, py, min_by(q, dist) AS bin_q, min_by(r, dist) AS bin_r
    FROM (SELECT point_id, px, py, q, r,
                 pow(px - {_W} * (q + r / 2), 2) + pow(py - {_W} * sqrt(3) / 2 * r, 2) AS dist
          FROM (SELECT point_id, x + 0.013 AS px, y + 0.0071 AS py,
                       CAST(floor((y + 0.0071) / ({_W} * sqrt(3) / 2)) AS BIGINT) + i AS r, j
                FROM {{b_grid}}, (SELECT unnest(range(-1, 3)) AS i) a,
                     (SELECT unnest(range(-2, 4)) AS j) b) c,
               LATERAL (SELECT CAST(floor(px / {_W} - r / 2) AS BIGINT) + j AS q) l) e
    GROUP BY point_id, px, py"""


def moved(spark, d):
    return cells(spark, d).select(
        "point_id", (F.col("x") + 0.013).alias("px"), (F.col("y") + 0.0071).alias("py")
    )


@query("hex_bin", f"""
    SELECT point_id, bin_q, bin_r, CAST(floor(px / 2) AS BIGINT) AS square_q,
           CAST(floor(py / 2) AS BIGINT) AS square_r
    FROM ({_HEX}) h""")
def _(spark, d):
    hexes = g.hex_bin(moved(spark, d), cell_width=_W, x="px", y="py")
    squares = g.hex_bin(moved(spark, d), "square", cell_area=4.0, x="px", y="py").select(
        "point_id", F.col("bin_q").alias("square_q"), F.col("bin_r").alias("square_r")
    )
    return hexes.join(squares, ["point_id"]).select(
        "point_id", "bin_q", "bin_r", "square_q", "square_r"
    )


@query("hex_clip", f"""
    WITH {_INSIDE.replace("FROM {b_grid} g, edges", "FROM (SELECT point_id, px AS x, py AS y, bin_q, bin_r FROM (" + _HEX + ") h) g, edges")}
    SELECT DISTINCT bin_q, bin_r FROM inside WHERE poly_id = 'Fagus_sylvatica'""")
def _(spark, d):
    binned = g.hex_bin(moved(spark, d), cell_width=_W, x="px", y="py")
    return g.hex_clip(binned, edges(spark, "Fagus_sylvatica"), "px", "py")


_ZONES = f"""
    SELECT rcp, bin_q, bin_r, avg(shift) AS mean_shift, count(shift) AS n_cells
    FROM (SELECT h.bin_q, h.bin_r, s.* FROM ({_HEX}) h
          JOIN (SELECT rcp, point_id, CASE WHEN sum(net_change) > 0 THEN 0 ELSE sum(net_change) END
                       AS shift FROM {{g_dom}} GROUP BY ALL) s USING (point_id)) z
    GROUP BY rcp, bin_q, bin_r"""


def zones(spark, d):
    binned = g.hex_bin(moved(spark, d), cell_width=_W, x="px", y="py")
    shift = g.negative_shift(dominance(spark, d))
    return g.hex_zonal_stats(binned.join(shift, ["point_id"]))


@query("hex_zonal_stats", f"""
    SELECT rcp, bin_q, bin_r, round(mean_shift, 6) AS mean_shift, n_cells FROM ({_ZONES}) z""")
def _(spark, d):
    return r6(zones(spark, d), "mean_shift")


_LOSS = """
    SELECT rcp, loss, count, CAST(sum(count) OVER (PARTITION BY rcp) AS BIGINT) AS "all",
           round(100.0 * count / sum(count) OVER (PARTITION BY rcp), 6) AS pct
    FROM (SELECT rcp, CASE WHEN mean_shift <= {limit} THEN 1 ELSE 0 END AS loss, count(*) AS count
          FROM ({zones}) z GROUP BY ALL) c"""


@query("loss_share", _LOSS.replace("{limit}", "-60").replace("{zones}", _ZONES))
def _(spark, d):
    return r6(g.loss_share(zones(spark, d), -60.0), "pct")


@query("project_laea", """
    WITH k AS (SELECT 6378137.0::DOUBLE AS a, 2 / 298.257222101 - pow(1 / 298.257222101, 2) AS e2),
    c AS (SELECT a, e2, sqrt(e2) AS e, sin(radians(52)) AS s0 FROM k),
    z AS (SELECT *, (1 - e2) * (1 / (1 - e2) - ln((1 - e) / (1 + e)) / (2 * e)) AS qp,
                 (1 - e2) * (s0 / (1 - e2 * s0 * s0) - ln((1 - e * s0) / (1 + e * s0)) / (2 * e)) AS q0
          FROM c),
    w AS (SELECT *, asin(q0 / qp) AS b0, a * sqrt(qp / 2) AS rq,
                 cos(radians(52)) / sqrt(1 - e2 * s0 * s0) AS m0 FROM z),
    p AS (SELECT ID, w.*, radians(Lon - 10) AS dl, sin(radians(Lat)) AS s,
                 a * m0 / (rq * cos(b0)) AS d FROM {b_metadata}, w),
    b AS (SELECT *, asin((1 - e2) * (s / (1 - e2 * s * s)
                 - ln((1 - e * s) / (1 + e * s)) / (2 * e)) / qp) AS beta FROM p),
    f AS (SELECT *, rq * sqrt(2 / (1 + sin(b0) * sin(beta) + cos(b0) * cos(beta) * cos(dl))) AS bb
          FROM b)
    SELECT ID AS point_id, round(bb * d * cos(beta) * sin(dl) + 4321000, 3) AS x_laea,
           round(bb / d * (cos(b0) * sin(beta) - sin(b0) * cos(beta) * cos(dl)) + 3210000, 3) AS y_laea
    FROM f""")
def _(spark, d):
    points = shared(spark, d, "b_metadata").select(
        F.col("ID").alias("point_id"), F.col("Lon").alias("lon"), F.col("Lat").alias("lat")
    )
    out = g.project_laea(points)
    return out.select("point_id", F.round("x_laea", 3).alias("x_laea"),
                      F.round("y_laea", 3).alias("y_laea"))


@query("dominance_shift_map_table", f"""
    WITH {_INSIDE.replace("FROM {b_grid} g, edges", "FROM (" + _HEX + ") g, edges").replace("y1 <= y AND y < y2", "y1 <= py AND py < y2").replace("y2 <= y AND y < y1", "y2 <= py AND py < y1").replace("x < (x2", "px < (x2").replace("(y - y1)", "(py - y1)")},
    {_dominant(2, True)},
    shift AS (SELECT rcp, point_id, CASE WHEN sum(net_change) > 0 THEN 0 ELSE sum(net_change) END
                     AS shift FROM dominant GROUP BY ALL),
    hexes AS (SELECT DISTINCT point_id, bin_q, bin_r FROM inside),
    zones AS (SELECT r.rcp, bin_q, bin_r, avg(shift) AS mean_shift
              FROM hexes h CROSS JOIN (SELECT unnest(['rcp_8_5', 'rcp_2_6']) AS rcp) r
              LEFT JOIN shift s ON s.rcp = r.rcp AND s.point_id = h.point_id GROUP BY ALL)
    {_LOSS.replace("{limit}", "-5").replace("{zones}", "SELECT * FROM zones")}""")
def _(spark, d):
    own = cells(spark, d).withColumns({"x": F.col("x") + 0.013, "y": F.col("y") + 0.0071})
    out = shift_map.dominance_shift_map_table(
        own, dominance(spark, d), ["rcp_8_5", "rcp_2_6"], _W, fact=2, area=edges(spark)
    )
    return r6(out, "pct")
