import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from standflow.functions import geo, joins
from standflow.functions.joins import tiled_join
from standflow.functions.scans import blocked_row_number
from standflow.operators import enrich, grid, niche


def test_nearest_cell_is_exact(spark):
    rng = random.Random(5)
    cells = [(0.5 * i, 40 + 0.5 * j, 100 * i + j) for i in range(30) for j in range(20)
             if rng.random() < 0.35]
    g = spark.createDataFrame(cells, "x double, y double, point_id bigint")
    pts = [(rng.uniform(-30, 60), rng.uniform(20, 80)) for _ in range(150)]
    pts += [(rng.uniform(0, 15), rng.uniform(40, 50)) for _ in range(150)]
    p = spark.createDataFrame(pts, "lon double, lat double")
    got = {(r.lon, r.lat): r.point_id for r in enrich.nearest_grid_cell(p, g, 0.5).collect()}
    at = {i: (x, y) for x, y, i in cells}
    for lon, lat in pts:
        inside = [i for i, (x, y) in at.items()
                  if -0.25 <= lon - x < 0.25 and -0.25 <= lat - y < 0.25]
        want = inside[0] if inside else min(
            at, key=lambda i: (abs(lon - at[i][0]) + abs(lat - at[i][1]), i)
        )
        assert got[(lon, lat)] == want


def test_nearest_cell_in_a_deep_pyramid(spark):
    rng = random.Random(6)
    cells = sorted({(rng.randrange(3000) // 7 * 3, rng.randrange(900)) for _ in range(120)})
    at = {i: (0.5 * x, 0.5 * y) for i, (x, y) in enumerate(cells)}
    g = spark.createDataFrame([(x, y, i) for i, (x, y) in at.items()],
                              "x double, y double, point_id bigint")
    pts = [(rng.uniform(-300, 1000), rng.uniform(-200, 600)) for _ in range(120)] + [(None, 1.0)]
    p = spark.createDataFrame(pts, "lon double, lat double")
    got = {(r.lon, r.lat): r.point_id for r in enrich.nearest_grid_cell(p, g, 0.5).collect()}
    for lon, lat in pts:
        if lon is None:
            assert got[(lon, lat)] is None
            continue
        inside = [i for i, (x, y) in at.items()
                  if -0.25 <= lon - x < 0.25 and -0.25 <= lat - y < 0.25]
        assert got[(lon, lat)] == (inside[0] if inside else min(
            at, key=lambda i: (abs(lon - at[i][0]) + abs(lat - at[i][1]), i)
        ))
    none = enrich.nearest_grid_cell(p, g.limit(0), 0.5).collect()
    assert len(none) == len(pts) and all(r.point_id is None for r in none)


def test_tiles_of_a_key_meet_all_left_rows(spark):
    left = spark.createDataFrame([(k, i) for k in ("a", None, "z") for i in range(7)], "k string, l int")
    right = spark.createDataFrame([(k, i) for k in ("a", None, "b") for i in range(50)], "k string, r int")
    want = [(k, i, j) for k in ("a", None) for i in range(7) for j in range(50)]
    order = lambda rows: sorted(rows, key=str)
    for tile in (3, 1000):
        got = tiled_join(left, right, ["k"], tile=tile).collect()
        assert order(map(tuple, got)) == order(want)
        got = tiled_join(left, right, ["k"], "left", tile=tile).collect()
        assert order(map(tuple, got)) == order(want + [("z", i, None) for i in range(7)])


def test_row_numbers_across_blocks(spark):
    rows = [(k, v) for k in ("a", None) for v in range(57)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    out = blocked_row_number(df, ["k"], F.floor(F.col("v") / 10), ["v"], "n")
    assert all(r.n == r.v + 1 for r in out.collect()) and out.count() == 114
    # rows without a block come first
    early = blocked_row_number(df, ["k"], F.when(F.col("v") > 9, F.col("v")), ["v"], "n")
    assert all(r.n == r.v + 1 for r in early.collect()) and early.columns == ["k", "v", "n"]


def test_projection_of_known_point(spark):
    df = spark.createDataFrame([(5.0, 50.0), (10.0, 52.0)], "lon double, lat double")
    a, b = grid.project_laea(df).collect()
    assert abs(a.x_laea - 3962799.45) < 0.01 and abs(a.y_laea - 2999718.85) < 0.01
    assert (round(b.x_laea, 3), round(b.y_laea, 3)) == (4321000.0, 3210000.0)


def test_hexagon_is_nearest_centre(spark):
    rng = random.Random(8)
    pts = [(rng.uniform(-50, 50), rng.uniform(-50, 50)) for _ in range(500)]
    df = spark.createDataFrame(pts, "x double, y double")
    w = 3.0
    for r in grid.hex_bin(df, cell_width=w).collect():
        def dist(q, s):
            return math.hypot(r.x - w * (q + s / 2), r.y - w * math.sqrt(3) / 2 * s)

        near = min(
            (dist(q, s), q, s)
            for q in range(r.bin_q - 2, r.bin_q + 3) for s in range(r.bin_r - 2, r.bin_r + 3)
        )
        assert near[1:] == (r.bin_q, r.bin_r)
    assert geo.cell_width_of("square", None, 9.0) == 3.0
    assert abs(geo.cell_width_of("hexagonal", None, 9.0) ** 2 * math.sqrt(3) / 2 - 9.0) < 1e-9
    with pytest.raises(ValueError):
        geo.cell_width_of("round", 1.0, None)


def test_concave_outline(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    edges = spark.createDataFrame(
        [("p", *ring[i], *ring[(i + 1) % 5]) for i in range(5)],
        "poly_id string, x1 double, y1 double, x2 double, y2 double",
    )
    pts = [(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 0.3, 3.0), (4, 5.0, 1.0), (5, 2.0, 0.9), (6, 3.8, 3.0)]
    p = spark.createDataFrame(pts, "point_id int, x double, y double")
    for band in (0.3, 1.0, 10.0):
        inside = grid.point_in_polygon(p, edges, band=band).collect()
        assert sorted(r.point_id for r in inside) == [1, 3, 5, 6]


def test_modal_block_ties_and_nulls(spark):
    cells = [(0, 0, 3), (0, 1, 5), (1, 0, 5), (1, 1, 3), (2, 0, None), (3, 1, 9), (2, 1, None)]
    df = spark.createDataFrame(cells, "ix int, iy int, class int")
    got = {(r.ix, r.iy): r.modal for r in grid.modal_block(df, 2).collect()}
    assert got == {(0, 0): 3, (0, 1): 3, (1, 0): 3, (1, 1): 3, (2, 0): None, (3, 1): 9, (2, 1): None}


def test_box_summary_is_exact(spark):
    rng = random.Random(2)
    rows = [("hot", round(rng.gauss(0, 30), 2)) for _ in range(3000)] + [("one", 4.0)]
    rows += [("few", float(v)) for v in (1, 2, 2, 3, 50)] + [("few", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    for r in niche.box_summary(df, "v", ["k"], block_width=5.0).collect():
        v = np.array([x for k, x in rows if k == r.k and x is not None])
        q1, q2, q3 = np.quantile(v, [0.25, 0.5, 0.75])
        inside = v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]
        want = (len(v), q1, q2, q3, inside.min(), inside.max())
        assert np.allclose((r.n, r.q1, r.median, r.q3, r.whisker_low, r.whisker_high), want)


def test_differences_to_center_count_all_pairs(spark):
    rng = random.Random(4)
    rows = [("s", "g", "r", e, float(rng.randint(-3, 3))) for e in ("center", "warm_dry", "cold_wet")
            for _ in range(40)]
    df = spark.createDataFrame(rows, "species string, sp_group string, rcp string, edge string, csi double")
    got = {(r.edge, r.diff_to_center): r.n_pairs for r in niche.species_diff_to_center(df).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[3] != "center" and b[3] == "center":
                want[(a[3], a[4] - b[4])] = want.get((a[3], a[4] - b[4]), 0) + 1
    assert got == want


def test_loss_share_nulls_are_no_loss(spark):
    df = spark.createDataFrame([("r", -7.0), ("r", -5.0), ("r", -4.9), ("r", None)], "rcp string, mean_shift double")
    got = {r.loss: (r["count"], r["all"], r.pct) for r in grid.loss_share(df).collect()}
    assert got == {1: (2, 4, 50.0), 0: (2, 4, 50.0)}


def test_rows_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(3000).selectExpr("nullif(id % 400, 7) AS k", "id % 3 AS g", "id AS v", "1 AS x")
    monkeypatch.setattr(joins, "DEALT_ROWS", 30)
    out = joins.dealt(df, ["k", "g"], ["v"])
    assert out.columns == ["k", "g", "v"]
    parts = [[tuple(r) for r in p] for p in out.rdd.glom().collect()]
    assert len(parts) == 100 > few
    assert sorted(r[2] for p in parts for r in p) == list(range(3000))
    where = {}
    for i, p in enumerate(parts):
        for k, g, _ in p:
            assert where.setdefault((k, g), i) == i
    monkeypatch.undo()
    assert joins.dealt(df, ["k"], ["v"]).rdd.getNumPartitions() <= few  # as the session has it
