"""Connected regions of equal cells of a grid, and their outlines.

Regions: cells of a tile are united within the tile, whose size bounds what a task holds; only the cells along tile borders then make a graph between
regions of neighbouring tiles, whose components Spark finds in rounds. Outlines: a cell's four sides are directed with the cell on their left, the sides
between two cells of a region cancel out, and the others are linked to rings by pointer doubling, so that a ring of n sides takes log2(n)
rounds and is never gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setcast.sources.tables import removed, settled

#: Cells along a tile's side.
TILE = 256


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any orderable type -> (node, root), root the smallest node that can be reached; nodes without an edge to another are not returned.

    In turns, larger neighbours and then smaller ones are hung under each node's smallest neighbour, which is found by a combined aggregation. The neighbours of a
    node with very many of them still meet in the join with it, where Spark can split them as a skewed key.
    """
    now = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    digest = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = digest(now)
    while seen[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        then = settled(small.union(least).distinct(), "edges")
        removed(now)
        now, found = then, digest(then)
        if found == seen:
            break
        seen = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def united(kinds: np.ndarray, there: np.ndarray) -> np.ndarray:
    """For each cell of a tile the smallest number, in row order, of a cell of its region; -1 where there is no cell."""
    n = kinds.size
    number = np.arange(n).reshape(kinds.shape)
    pairs = []
    for one, two in (((slice(None, -1), slice(None)), (slice(1, None), slice(None))), ((slice(None), slice(None, -1)), (slice(None), slice(1, None)))):
        same = there[one] & there[two] & (kinds[one] == kinds[two])
        pairs.append(np.stack([number[one][same], number[two][same]], 1))
    edges = np.concatenate(pairs)
    root = np.arange(n)
    while len(edges):
        a, b = root[edges[:, 0]], root[edges[:, 1]]
        open_edges = a != b
        if not open_edges.any():
            break
        edges, a, b = edges[open_edges], a[open_edges], b[open_edges]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    return np.where(there.ravel(), root, -1).reshape(kinds.shape)


def _in_tile(tile: int):
    def run(part: pa.Table) -> pa.Table:
        x, y = (part[c].to_numpy() for c in ("cx", "cy"))
        kinds, kind = np.unique(part["kind"].to_numpy(), return_inverse=True)
        x0, y0 = x[0] // tile * tile, y[0] // tile * tile
        grid, there = np.full((tile, tile), len(kinds)), np.zeros((tile, tile), bool)
        np.minimum.at(grid, (x - x0, y - y0), kind)
        there[x - x0, y - y0] = True
        i, j = there.nonzero()
        root = united(grid, there)[i, j]
        return pa.table({"cx": i + x0, "cy": j + y0, "kind": kinds[grid[i, j]], "lx": root // tile + x0, "ly": root % tile + y0})

    return run


def regions(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """cells(cx, cy, kind) -> (cx, cy, kind, region_x, region_y): cells that share a side and their kind are of one region, which is named by its
    smallest cell, by cx and then cy.

    Rows with a null are left out; of several rows of a cell the smallest kind counts; an empty table gives an empty result. Cells need not fill
    the grid.
    """
    known = cells.where("cx IS NOT NULL AND cy IS NOT NULL AND kind IS NOT NULL").select(F.col("cx").cast("long"), F.col("cy").cast("long"), F.col("kind").cast("long"))
    tiled = known.withColumn("tx", F.floor(F.col("cx") / tile)).withColumn("ty", F.floor(F.col("cy") / tile))
    local = settled(tiled.groupBy("tx", "ty").applyInArrow(_in_tile(tile), "cx long, cy long, kind long, lx long, ly long"), "regions")
    node = F.struct(F.col("lx").alias("x"), F.col("ly").alias("y"))
    there = local.select("cx", "cy", "kind", node.alias("b"))
    edges = None
    for c, other in (("cx", "cy"), ("cy", "cx")):  # the last cells of a tile and those behind them
        last = local.where(F.pmod(c, F.lit(tile)) == tile - 1).select((F.col(c) + 1).alias(c), other, "kind", node.alias("a"))
        found = last.join(there.where(F.pmod(c, F.lit(tile)) == 0), ["cx", "cy", "kind"]).select("a", "b")
        edges = found if edges is None else edges.union(found)
    roots = components(edges.distinct()).select(F.col("node.x").alias("lx"), F.col("node.y").alias("ly"), "root")
    joined = local.join(roots, ["lx", "ly"], "left")
    region = F.coalesce("root", node)
    return joined.select("cx", "cy", "kind", region["x"].alias("region_x"), region["y"].alias("region_y"))


#: A cell's sides with the cell on their left: where they start, as steps from its corner, and their direction; 0 east, 1 north, 2 west, 3 south.
_SIDES = ((0, 0, 0), (1, 0, 1), (1, 1, 2), (0, 1, 3))


def _end(x: Column, y: Column, way: Column) -> tuple[Column, Column]:
    return x + F.when(way == 0, 1).when(way == 2, -1).otherwise(0), y + F.when(way == 1, 1).when(way == 3, -1).otherwise(0)


def _sides(cells: DataFrame) -> DataFrame:
    """(rx, ry, x, y, way) of the sides that a region shares with no cell of its own."""
    each = F.explode(F.array(*(F.struct((F.col("cx") + i).alias("x"), (F.col("cy") + j).alias("y"), F.lit(d).alias("way")) for i, j, d in _SIDES))).alias("s")
    rows = cells.select(F.col("region_x").alias("rx"), F.col("region_y").alias("ry"), each).select("rx", "ry", "s.*")
    x2, y2 = _end(F.col("x"), F.col("y"), F.col("way"))
    # Both directions of a side have the same lower end and axis.
    rows = rows.select("*", F.least("x", x2).alias("ux"), F.least("y", y2).alias("uy"), (F.col("way") % 2).alias("axis"))
    return rows.groupBy("rx", "ry", "ux", "uy", "axis").agg(F.count("*").alias("n"), F.min(F.struct("x", "y", "way")).alias("s")).where("n = 1").select("rx", "ry", "s.*")


def outlines(cells: DataFrame) -> DataFrame:
    """cells(cx, cy, region_x, region_y), one row each -> the corners of all rings: (region_x, region_y, ring_x, ring_y, hole, place, x, y).

    A ring keeps its region on its left: outer rings run anticlockwise, holes clockwise. Where two cells of a region touch at a corner only, rings turn left
    and so don't cross. ring_x and ring_y are the ring's smallest vertex; place counts cell sides from there. An empty table gives an empty result.
    """
    sides = _sides(cells)
    edge = F.struct("rx", "ry", "x", "y", "way")
    x2, y2 = _end(F.col("x"), F.col("y"), F.col("way"))
    ends = sides.select("rx", "ry", x2.alias("vx"), y2.alias("vy"), edge.alias("into"), F.lit(None).cast("struct<rx:bigint,ry:bigint,x:bigint,y:bigint,way:int>").alias("out"))
    starts = sides.select("rx", "ry", F.col("x").alias("vx"), F.col("y").alias("vy"), F.lit(None).cast("struct<rx:bigint,ry:bigint,x:bigint,y:bigint,way:int>").alias("into"), edge.alias("out"))
    at = ends.union(starts).groupBy("rx", "ry", "vx", "vy").agg(F.collect_list("into").alias("into"), F.collect_list("out").alias("out"))  # two of each at most
    linked = at.select(F.explode("into").alias("e"), "out")
    left = F.element_at(F.filter("out", lambda o: (F.size("out") == 1) | (o["way"] == (F.col("e.way") + 1) % 4)), 1)
    now = settled(linked.select("e", left.alias("next"), left["way"].alias("turn")).select("e", "next", "turn", F.col("next").alias("jump"), F.col("e").alias("low"), F.lit(0).cast("long").alias("off")), "outline")
    step, changed = 1, now.count()
    while changed:
        ahead = now.select(F.col("e").alias("jump"), F.col("jump").alias("jump2"), F.col("low").alias("low2"), F.col("off").alias("off2"))
        lower = F.col("low2") < F.col("low")
        then = now.join(ahead, "jump").select("e", "next", "turn", F.col("jump2").alias("jump"), F.when(lower, F.col("low2")).otherwise(F.col("low")).alias("low"), F.when(lower, F.col("off2") + step).otherwise(F.col("off")).alias("off"), lower.alias("moved"))
        then = settled(then, "outline")
        removed(now)
        changed, step = then.where("moved").count(), 2 * step
        now = then.drop("moved")
    # Twice the signed area tells holes; sums are whole numbers.
    ex, ey = _end(F.col("e.x"), F.col("e.y"), F.col("e.way"))
    rings = now.groupBy("low").agg(F.count("*").alias("n"), F.sum(F.col("e.x") * ey - ex * F.col("e.y")).alias("area"))
    corners = now.where("e.way <> turn").join(rings, "low")
    place = F.pmod(F.col("n") - F.col("off") + 1, F.col("n"))
    return corners.select(F.col("e.rx").alias("region_x"), F.col("e.ry").alias("region_y"), F.col("low.x").alias("ring_x"), F.col("low.y").alias("ring_y"), (F.col("area") < 0).alias("hole"), place.alias("place"), ex.alias("x"), ey.alias("y"))
