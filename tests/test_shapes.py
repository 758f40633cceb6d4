"""Polygons and projections against plain computations and published points."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from setcast.operators import polygons, projection


def rings(*shapes):
    return [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in shapes]


SQUARE = rings([(0, 0), (10, 0), (10, 10), (0, 10)])
RING = rings([(0, 0), (0, 30), (30, 30), (30, 0)], [(10, 10), (20, 10), (20, 20), (10, 20)])
DART = rings([(40, 0), (60, 30), (40, 10), (20, 30)])
SLIVER = rings([(100, 0), (200, 100), (200, 101), (100, 1)])
FLAT = rings([(0, 0), (5, 5), (9, 9)])


def zones(spark, shapes):
    return spark.createDataFrame([(k, r) for k, r in shapes], f"zone long, rings {polygons.RINGS}")


def within(x, y, shape):
    n = 0
    for ring in shape:
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            if (p["y"] > y) != (q["y"] > y) and x > (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"]:
                n += 1
    return n % 2 == 1


def test_drawn_points(spark):
    shapes = [(1, SQUARE), (2, RING), (3, DART), (4, SLIVER), (5, FLAT), (None, SQUARE), (6, None)]
    areas = {1: 100.0, 2: 800.0, 3: 200.0, 4: 100.0}
    df = zones(spark, shapes)
    found = {r["zone"]: r["area"] for r in polygons.covered(df.where("rings IS NOT NULL AND zone IS NOT NULL")).collect()}
    assert found == {**areas, 5: 0.0}
    got = polygons.draw_points(df, 997, seed=2).collect()
    by = {k: [r for r in got if r["zone"] == k] for k in areas}
    assert len(got) == 997 and all(abs(len(by[k]) - 997 * a / 1200) <= 1 for k, a in areas.items())
    assert all(within(r["x"], r["y"], dict(shapes)[r["zone"]]) for r in got) and len({(r["x"], r["y"]) for r in got}) == 997
    again = polygons.draw_points(df.repartition(4), 997, seed=2).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    left = [r for r in by[2] if r["x"] < 10]  # a third and a ninth of the ring's area
    assert len(left) / len(by[2]) == pytest.approx(300 / 800, abs=0.06)
    assert polygons.draw_points(df.limit(0), 5).count() == 0


def test_large_zones_are_drawn_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(polygons, "BLOCK", 50)
    df = zones(spark, [(1, SQUARE), (2, RING)])
    few = sorted(map(str, polygons.draw_points(df, 700).collect()))
    monkeypatch.setattr(polygons, "BLOCK", 4096)
    assert few == sorted(map(str, polygons.draw_points(df, 700).collect())) and len(few) == 700


def test_points_in_zones(spark):
    shapes = [(1, SQUARE), (2, RING), (3, DART), (4, SLIVER)]
    r = random.Random(5)
    points = [(k, r.uniform(-5, 205), r.uniform(-5, 105)) for k in range(1500)]
    df = spark.createDataFrame([*points, (9999, None, 1.0)], "id long, x double, y double")
    got = {(x["id"], x["zone"]) for x in polygons.points_in_zones(df, zones(spark, shapes), 7.0).collect()}
    assert got == {(k, z) for k, x, y in points for z, s in shapes if within(x, y, s)} and len(got) > 30


def test_overlays_by_brute_force(spark):
    """Areas of shapes with whole corners and straight sides are counted in unit cells; others are told from known figures."""
    r = random.Random(8)
    one, two = [], []
    for k in range(14):
        for out in (one, two):
            x, y, w, h = r.randrange(40), r.randrange(40), r.randrange(4, 30), r.randrange(4, 30)
            outline = [(x, y), (x + w, y), (x + w, y + h // 2), (x + w // 2, y + h // 2), (x + w // 2, y + h), (x, y + h)]
            shape = rings(outline[:: r.choice([1, -1])], *([[(x + 1, y + 1), (x + 2, y + 1), (x + 2, y + 2), (x + 1, y + 2)]] if k % 2 else []))
            out.append((k, shape))
    cells = lambda shape: {(x, y) for x in range(80) for y in range(80) if within(x + 0.5, y + 0.5, shape)}
    a = spark.createDataFrame([*one, (50, None), (None, SQUARE)], f"a long, rings {polygons.RINGS}")
    b = spark.createDataFrame(two, f"b long, rings {polygons.RINGS}")
    want = {(i, j): float(n) for i, s in one for j, t in two if (n := len(cells(s) & cells(t)))}
    for cell in (9.0, 1000.0):
        got = {(x["a"], x["b"]): round(x["area"], 6) for x in polygons.overlay_areas(a, b, cell).collect()}
        assert got == want
    assert polygons.overlap(SQUARE, rings([(5, -5), (15, 5), (5, 15), (-5, 5)])) == pytest.approx(100.0)
    assert polygons.overlap(DART, DART) == pytest.approx(200.0) and polygons.overlap(RING, RING) == pytest.approx(800.0)
    assert polygons.overlap(SQUARE, FLAT) == 0 and polygons.overlap(SQUARE, rings([(10, 0), (20, 0), (20, 10)])) == pytest.approx(0.0)


# A published worked example: 52 39' 27.2531" N, 1 43' 4.5177" E on the Airy ellipsoid, in the British national grid.
AIRY = projection.Grid(a=6377563.396, inverse=6377563.396 / (6377563.396 - 6356256.910), lon0=-2.0, lat0=49.0, scale=0.9996012717, east=400_000.0, north=-100_000.0)


def test_published_point_and_back(spark):
    row = spark.range(1).select(F.lit(1 + 43 / 60 + 4.5177 / 3600).alias("lon"), F.lit(52 + 39 / 60 + 27.2531 / 3600).alias("lat"))
    got = projection.with_grid(row, AIRY).select("x", "y").first()
    assert got[0] == pytest.approx(651409.903, abs=0.001) and got[1] == pytest.approx(313177.270, abs=0.001)


def test_meridian_by_quadrature(spark):
    """On the central meridian the northing is the meridian's length, here summed up in small steps."""
    g = projection.SYSTEMS[25833]
    e2 = g.e**2
    for lat in (10.0, 45.0, 59.9, 71.0):
        phi = np.linspace(0, math.radians(lat), 20_001)
        f = g.a * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
        length = (phi[1] / 3) * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())
        got = projection.with_grid(spark.range(1).select(F.lit(15.0).alias("lon"), F.lit(lat).alias("lat")), g).select("x", "y").first()
        assert got[0] == pytest.approx(500_000.0, abs=1e-6) and got[1] == pytest.approx(g.scale * length, abs=1e-3)


def test_there_and_back(spark):
    r = random.Random(3)
    points = [(k, r.uniform(-100_000, 1_100_000), r.uniform(6_300_000, 7_900_000)) for k in range(300)] + [(900, None, 1.0), (901, 1.0, None)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    there = projection.reprojected(df, 25832, 25833)
    back = {x["id"]: (x["x"], x["y"]) for x in projection.reprojected(there, 25833, 25832).collect()}
    assert all(back[k] == pytest.approx((x, y), abs=1e-3) for k, x, y in points[:300]) and back[900] == (None, None)
    assert there.columns == df.columns and "Exchange" not in there._jdf.queryExecution().executedPlan().toString()
    tile = projection.tiled(df.where("id = 0")).first()
    assert (tile["tile_x"], tile["tile_y"]) == (math.floor(points[0][1] / 1e4), math.floor(points[0][2] / 1e4))
