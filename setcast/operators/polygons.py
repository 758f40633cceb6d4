"""Polygons as rings of points: areas, points drawn from them, points inside them, areas of their overlay.

A polygon has the rings of its outline and holes, in any direction; a point is inside if a ray from it crosses the rings an odd number of
times. Its cover is a grid of its own: BANDS bands of equal height, each with the edges in it and the cells that they span, so that a ray is cast against one
band's edges only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setcast.sources.tables import removed, settled

RINGS = "array<array<struct<x:double,y:double>>>"
BANDS = 16
#: Candidates that are drawn and ranked together.
BLOCK = 4096
#: Triangles of a pair of polygons that are clipped at once.
_AT_ONCE = 1 << 16


def ring_area(ring: Column) -> Column:
    """Signed; positive for a ring that runs anticlockwise. The last point need not repeat the first."""
    n = F.size(ring)
    terms = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.coalesce(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0))


def area(rings: Column) -> Column:
    """The outline's, which comes first, less the holes'."""
    return F.aggregate(F.transform(rings, lambda r, i: F.abs(ring_area(r)) * F.when(i == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda s, x: s + x)


def edges(rings: Column) -> Column:
    """(x1, y1, x2, y2) of all rings."""
    each = F.transform(rings, lambda r: F.transform(r, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(r, (i + 1) % F.size(r))["x"].alias("x2"), F.get(r, (i + 1) % F.size(r))["y"].alias("y2"))))
    return F.flatten(each)


def inside(x: Column, y: Column, some_edges: Column) -> Column:
    """Whether a ray to the left crosses an odd number of the edges, which need be those only that reach the point's height."""
    crossed = F.filter(some_edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x > (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return F.size(crossed) % 2 == 1


def covered(zones: DataFrame, bands: int = BANDS) -> DataFrame:
    """zones(zone, rings) with area, left, low, side (of a cell), total (cells of the cover) and cover: a (first, n, upto, edges) for each band, n cells from the
    first on, upto those of the bands before."""
    rows = zones.withColumn("area", area(F.col("rings"))).withColumn("edges", edges(F.col("rings")))
    xs, ys = F.transform("edges", lambda e: e["x1"]), F.transform("edges", lambda e: e["y1"])
    rows = rows.withColumn("left", F.array_min(xs)).withColumn("low", F.array_min(ys))
    rows = rows.withColumn("side", F.greatest(F.array_max(xs) - F.col("left"), F.array_max(ys) - F.col("low")) / bands)

    def band(k: Column) -> Column:
        bottom, top = F.col("low") + k * F.col("side"), F.col("low") + (k + 1) * F.col("side")
        own = F.filter("edges", lambda e: (F.least(e["y1"], e["y2"]) <= top) & (F.greatest(e["y1"], e["y2"]) >= bottom))
        at = lambda e, y: F.when(e["y1"] == e["y2"], e["x1"]).otherwise(e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]))
        ends = F.flatten(F.transform(own, lambda e: F.array(*(at(e, F.greatest(F.least(e[c], top), bottom)) for c in ("y1", "y2")), *(F.when(e["y1"] == e["y2"], e[c]).otherwise(F.lit(None)) for c in ("x1", "x2")))))
        first = F.floor((F.array_min(ends) - F.col("left")) / F.col("side"))
        last = F.least(F.floor((F.array_max(ends) - F.col("left")) / F.col("side")), F.lit(bands - 1))
        return F.struct(F.coalesce(first, F.lit(0)).alias("first"), F.greatest(F.coalesce(last - first + 1, F.lit(0)), F.lit(0)).alias("n"), own.alias("edges"))

    rows = rows.withColumn("each", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band))
    upto = lambda k: F.aggregate(F.slice("each", 1, k), F.lit(0).cast("long"), lambda s, b: s + b["n"])
    rows = rows.withColumn("cover", F.transform("each", lambda b, k: F.struct(b["first"].alias("first"), b["n"].alias("n"), upto(k).alias("upto"), b["edges"].alias("edges"))))
    return rows.withColumn("total", upto(F.lit(bands))).drop("each", "edges")


def draws(zone: Column, j: Column, seed: int) -> list[Column]:
    """Three numbers in [0, 1) from the zone and the number of the draw."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), zone.cast("string"), j.cast("string")))
    return [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") / F.lit(float(1 << 32)) for k in range(3)]


def _quotas(zones: DataFrame, n: int) -> DataFrame:
    """zones with quota: n in proportion to the areas, by rounding their running sum in the order of zones. Parts of that order are added up by
    themselves, and the driver gets one number for each."""
    rows = settled(zones.where("area > 0").repartitionByRange("zone").withColumn("part", F.spark_partition_id()), "zones")
    sums = sorted((r["part"], r["s"]) for r in rows.groupBy("part").agg(F.sum("area").alias("s")).collect())
    total, before, upto = sum(s for _, s in sums), {}, 0.0
    for part, s in sums:
        before[part], upto = upto, upto + s
    start = F.element_at(F.create_map(*(F.lit(x) for k, v in before.items() for x in (k, v))), F.col("part")) if before else F.lit(0.0)
    here = F.sum("area").over(Window.partitionBy("part").orderBy("zone"))
    rows = rows.withColumn("_end", start + here)
    share = lambda c: F.floor(c * n / F.lit(total or 1.0))
    return rows.withColumn("quota", (share(F.col("_end")) - share(F.col("_end") - F.col("area"))).cast("long")).drop("_end", "part")


def draw_points(zones: DataFrame, n: int, seed: int = 0, bands: int = BANDS) -> DataFrame:
    """zones(zone, rings), zone unique -> exactly n points (zone, draw, x, y) inside the zones, each zone's number in proportion to its area.

    A zone's draws are numbered; each takes a cell of the cover and a place in it, and the first draws that fall inside count, so that reruns agree whatever the
    partitions. Draws of a large zone are spread over tasks. Zones without an area, null zones and null rings get none; without an area at all the result is empty.
    """
    rows = settled(_quotas(covered(zones.where("zone IS NOT NULL AND rings IS NOT NULL"), bands), n).where("quota > 0"), "quotas")
    # The share of the cover that lies inside tells how many draws are needed.
    needed = lambda missing: F.ceil(missing * F.greatest(F.col("total") * F.col("side") * F.col("side") / F.col("area"), F.lit(1.0)) * 1.2) + 8
    todo, hits = rows.select("zone", F.col("quota").alias("missing"), F.lit(0).cast("long").alias("begin")), None
    while True:
        asked = settled(rows.join(todo, "zone").withColumn("until", F.col("begin") + needed(F.col("missing"))), "asked")
        if asked.isEmpty():
            break
        blocks = asked.select("*", F.explode(F.sequence(F.floor(F.col("begin") / BLOCK), F.floor((F.col("until") - 1) / BLOCK))).alias("block")).repartition("zone", "block")
        first, last = F.greatest(F.col("begin"), F.col("block") * BLOCK), F.least(F.col("until"), (F.col("block") + 1) * BLOCK) - 1
        each = blocks.select("zone", "left", "low", "side", "total", "cover", "block", F.explode(F.sequence(first, last)).alias("draw"))
        found = settled(_inside_draws(each, seed), "hits")
        hits = found if hits is None else hits.union(found)
        got = hits.groupBy("zone").agg(F.count("*").alias("got"))
        todo = settled(asked.select("zone", "quota", "until").join(got, "zone", "left").select("zone", (F.col("quota") - F.coalesce("got", F.lit(0))).alias("missing"), F.col("until").alias("begin")).where("missing > 0"), "todo")
        removed(asked)
    if hits is None:
        return rows.selectExpr("zone", "0L AS draw", "0D AS x", "0D AS y")
    counts = hits.groupBy("zone", "block").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.sum("c").over(Window.partitionBy("zone").orderBy("block")) - F.col("c")).join(rows.select("zone", "quota"), "zone").where("before < quota")
    ranked = hits.join(before, ["zone", "block"]).withColumn("rank", F.row_number().over(Window.partitionBy("zone", "block").orderBy("draw")) + F.col("before"))
    return ranked.where("rank <= quota").select("zone", "draw", "x", "y")


def _inside_draws(each: DataFrame, seed: int) -> DataFrame:
    one, two, three = draws(F.col("zone"), F.col("draw"), seed)
    rows = each.withColumn("cell", F.floor(one * F.col("total"))).withColumn("u", two).withColumn("v", three)
    rows = rows.withColumn("band", F.size(F.filter("cover", lambda b: b["upto"] <= F.col("cell"))) - 1)
    # Of bands without cells the last before the cell is not its own.
    rows = rows.withColumn("own", F.get("cover", F.col("band")))
    x = F.col("left") + (F.col("own.first") + F.col("cell") - F.col("own.upto") + F.col("u")) * F.col("side")
    y = F.col("low") + (F.col("band") + F.col("v")) * F.col("side")
    return rows.withColumn("x", x).withColumn("y", y).where(inside(F.col("x"), F.col("y"), F.col("own.edges"))).select("zone", "block", "draw", "x", "y")


def points_in_zones(points: DataFrame, zones: DataFrame, cell: float) -> DataFrame:
    """points(x, y, ...) joined with zones(zone, rings) that hold them: an equi-join on the cells of a common grid that a zone's bounding box covers, then a ray."""
    shapes = _boxed(zones, "zone", "rings", cell).withColumn("e", edges(F.col("rings"))).select("zone", "e", "cx", "cy")
    at = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    return at.join(shapes, ["cx", "cy"]).where(inside(F.col("x"), F.col("y"), F.col("e"))).select(*points.columns, "zone")


def _boxed(zones: DataFrame, zone: str, rings: str, cell: float) -> DataFrame:
    """A row for each cell of the common grid that a zone's bounding box covers."""
    points = F.flatten(F.col(rings))
    box = {"x0": F.array_min(F.transform(points, lambda p: p["x"])), "x1": F.array_max(F.transform(points, lambda p: p["x"])), "y0": F.array_min(F.transform(points, lambda p: p["y"])), "y1": F.array_max(F.transform(points, lambda p: p["y"]))}
    rows = zones.where(F.col(zone).isNotNull() & F.col(rings).isNotNull() & (F.size(points) > 0)).select(zone, rings, *(v.alias(k) for k, v in box.items()))
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    return rows.withColumn("cx", cells("x0", "x1")).withColumn("cy", cells("y0", "y1"))


def overlay_areas(one: DataFrame, two: DataFrame, cell: float) -> DataFrame:
    """one(a, rings), two(b, rings) -> (a, b, area) of the pairs that overlap.

    Pairs meet in the cells of a common grid, and are kept in one of them alone: that of the lower left corner of what their bounding boxes share. Every
    ring is a sum of signed triangles, so that the area of an overlay is the sum over pairs of triangles, each clipped by the other, whatever the shapes.
    """
    left = _boxed(one.select("a", F.col("rings").alias("ra")), "a", "ra", cell)
    right = _boxed(two.select("b", F.col("rings").alias("rb")), "b", "rb", cell).withColumnsRenamed({c: f"{c}b" for c in ("x0", "x1", "y0", "y1")})
    pairs = left.join(right, ["cx", "cy"]).where("x0 <= x1b AND x0b <= x1 AND y0 <= y1b AND y0b <= y1")
    own = (F.col("cx") == F.floor(F.greatest("x0", "x0b") / cell)) & (F.col("cy") == F.floor(F.greatest("y0", "y0b") / cell))
    kinds = dict(left.dtypes), dict(right.dtypes)
    found = pairs.where(own).select("a", "b", "ra", "rb").mapInArrow(_clipped, f"a {kinds[0]['a']}, b {kinds[1]['b']}, area double")
    return found.where("area > 1e-9")


def _triangles(rings: list) -> tuple[np.ndarray, np.ndarray]:
    """Triangles of all rings, each anticlockwise, and their signs: holes count against the outline."""
    shapes, signs = [], []
    for k, ring in enumerate(rings):
        p = np.array([(q["x"], q["y"]) for q in ring], np.float64).reshape(-1, 2)
        if len(p) < 3:
            continue
        fan = np.stack([np.broadcast_to(p[0], (len(p) - 2, 2)), p[1:-1], p[2:]], 1)
        cross = (fan[:, 1, 0] - fan[:, 0, 0]) * (fan[:, 2, 1] - fan[:, 0, 1]) - (fan[:, 2, 0] - fan[:, 0, 0]) * (fan[:, 1, 1] - fan[:, 0, 1])
        whole = np.sign(cross.sum()) * (1 if k == 0 else -1)
        shapes.append(np.where((cross < 0)[:, None, None], fan[:, ::-1], fan)[cross != 0])
        signs.append((np.sign(cross) * whole)[cross != 0])
    return (np.concatenate(shapes), np.concatenate(signs)) if shapes else (np.zeros((0, 3, 2)), np.zeros(0))


def overlap(one: list, two: list) -> float:
    """The area that two polygons share."""
    (s, a), (t, b) = _triangles(one), _triangles(two)
    near = (s.min(1)[:, None] <= t.max(1)).all(2) & (t.min(1) <= s.max(1)[:, None]).all(2)
    i, j = near.nonzero()
    return float(sum((a[i[k : k + _AT_ONCE]] * b[j[k : k + _AT_ONCE]] * _shared(s[i[k : k + _AT_ONCE]], t[j[k : k + _AT_ONCE]])).sum() for k in range(0, len(i), _AT_ONCE)))


def _shared(shape: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Areas of convex shapes within anticlockwise triangles, side by side: each side of the triangle cuts off what is to its right."""
    for k in range(3):
        p, q = clip[:, k, None], clip[:, (k + 1) % 3, None]
        side = (q[..., 0] - p[..., 0]) * (shape[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (shape[..., 0] - p[..., 0])
        then, after = np.roll(shape, -1, 1), np.roll(side, -1, 1)
        crosses = (side > 0) & (after < 0) | (side < 0) & (after > 0)
        t = np.where(crosses, side / np.where(crosses, side - after, 1), 0)
        out = np.stack([shape, shape + t[..., None] * (then - shape)], 2).reshape(len(shape), -1, 2)
        valid = np.stack([side >= 0, crosses], 2).reshape(len(shape), -1)
        # A place without a point takes the one before it, which changes no area.
        at = np.maximum.accumulate(np.where(valid, np.arange(valid.shape[1]), -1), 1)
        at = np.where(at < 0, at[:, -1:], at)
        shape = np.take_along_axis(out, np.maximum(at, 0)[..., None], 1)
        shape = np.where((at[:, -1] < 0)[:, None, None], 0.0, shape)
    x, y = shape[..., 0], shape[..., 1]
    return ((x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1)) / 2


def _clipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        areas = [overlap(one, two) for one, two in zip(batch.column("ra").to_pylist(), batch.column("rb").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(areas, pa.float64())], ["a", "b", "area"])
