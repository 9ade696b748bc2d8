"""Points in outlines against a plain ray test."""

import math
import random

import pytest

from standflow.operators.grid import outline_cells, point_in_polygon


def star(r, poly, cx, cy, n, size):
    """A closed outline with long and short edges, some of them horizontal."""
    ring = []
    for i in range(n):
        reach = size * r.uniform(0.2, 1.0)
        a = 2 * math.pi * i / n
        ring.append((cx + reach * math.cos(a), cy + reach * math.sin(a)))
    ring[n // 3] = (ring[n // 3][0], ring[n // 3 - 1][1])
    return [(poly, *p, *q) for p, q in zip(ring, ring[1:] + ring[:1])]


@pytest.mark.parametrize("side", [0.3, 1.0, 7.5])
def test_against_rays(spark, side):
    r = random.Random(2)
    edges = []
    for i in range(12):
        edges += star(r, i, r.uniform(-5, 5), r.uniform(-5, 5), r.choice([3, 7, 60]), r.uniform(1, 6))
    edges += [(90, *e) for e in ((0, 0, 0, 3), (0, 3, 3, 3), (3, 3, 3, 0), (3, 0, 0, 0))]  # on cell borders
    hole = [(1, 1, 1, 2), (1, 2, 2, 2), (2, 2, 2, 1), (2, 1, 1, 1)]
    edges += [(90, *e) for e in hole] + [(None, *e) for e in hole]
    points = [(i, r.uniform(-9, 9), r.uniform(-9, 9)) for i in range(1500)]
    points += [(5000 + i, float(x), float(y)) for i, (x, y) in enumerate(
        (a / 2, b / 2) for a in range(-1, 8) for b in range(-1, 8))]
    points += [(7000 + i, float(e[1]), float(e[2])) for i, e in enumerate(edges)]  # corners
    points += points[:40] + [(9000, None, 1.0), (9001, 1.5, None), (None, 1.5, 1.5)]
    want = []
    for p in points:
        if p[1] is None or p[2] is None:
            continue
        odd = {}
        for poly, x1, y1, x2, y2 in edges:
            if (y1 > p[2]) != (y2 > p[2]) and p[1] < (x2 - x1) * (p[2] - y1) / (y2 - y1) + x1:
                odd[poly] = odd.get(poly, 0) + 1
        want += [(*p, poly) for poly, n in odd.items() if n % 2]
    e = spark.createDataFrame([tuple(map(lambda v: float(v), x[1:])) + (x[0],) for x in edges],
                              "x1 double, y1 double, x2 double, y2 double, poly_id int")
    p = spark.createDataFrame(points, "id int, x double, y double")
    got = sorted((tuple(x) for x in point_in_polygon(p, e, band=side).collect()), key=str)
    assert got == sorted(want, key=str)


def test_a_cell_holds_its_own_edges_only(spark):
    r = random.Random(3)
    edges = star(r, 1, 0.0, 0.0, 4000, 40)
    e = spark.createDataFrame(edges, "poly_id int, x1 double, y1 double, x2 double, y2 double")
    cells = outline_cells(e, 1.0).collect()
    assert max(len(c["__edges"]) for c in cells) < 1000 and max(len(c["__ends"]) for c in cells) < 200
    assert any(not c["__edges"] and c["__base"] == 1 for c in cells)
    empty = e.where("false")
    assert outline_cells(empty).collect() == []
