"""Regions and outlines against plain flood fill and walks."""

import random

import numpy as np
import pytest

from setcast.operators import regions


def flood(cells):
    root = {}
    for start in sorted(cells):
        if start in root:
            continue
        todo = [start]
        while todo:
            x, y = todo.pop()
            if (x, y) in root or cells.get((x, y)) != cells[start]:
                continue
            root[x, y] = start
            todo += [(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)]
    return root


def walks(root):
    """{(region, ring): (hole, corners with their places)}"""
    sides = {}
    for (x, y), r in root.items():
        for way, (i, j, a, b) in enumerate(((0, 0, 0, -1), (1, 0, 1, 0), (1, 1, 0, 1), (0, 1, -1, 0))):
            if root.get((x + a, y + b)) != r:
                sides[r, x + i, y + j, way] = (x, y)
    step = ((1, 0), (0, 1), (-1, 0), (0, -1))
    found, left = {}, set(sides)
    while left:
        start = now = min(left)
        ring, area = [], 0
        while True:
            left.discard(now)
            r, x, y, way = now
            x2, y2 = x + step[way][0], y + step[way][1]
            area += x * y2 - x2 * y
            out = [w for w in range(4) if (r, x2, y2, w) in sides]
            turn = (way + 1) % 4 if len(out) == 2 else out[0]
            ring.append((x2, y2, way != turn))
            now = (r, x2, y2, turn)
            if now == start:
                break
        n = len(ring)
        found[start[0], (start[1], start[2])] = (area < 0, sorted(((k + 1) % n, x, y) for k, (x, y, corner) in enumerate(ring) if corner))
    return found


def pattern(name):
    r = random.Random(3)
    if name == "random":
        return {(x, y): r.choice([1, 1, 2, 3]) for x in range(-9, 14) for y in range(-5, 17) if r.random() < 0.9}
    if name == "spiral":
        rows = ["#########", "........#", "#######.#", "#.....#.#", "#.###.#.#", "#.#...#.#", "#.#####.#", "#.......#", "#########"]
        return {(x, y): int(c == "#") for y, row in enumerate(rows) for x, c in enumerate(row)}
    if name == "holes":  # holes that touch at a corner, and an island within one
        rows = ["#######", "#..####", "#..####", "###..##", "###..##", "#######"]
        return {(x, y): 5 for y, row in enumerate(rows) for x, c in enumerate(row) if c == "#"}
    return {(x, y): (x + y) % 2 for x in range(6) for y in range(6)}


@pytest.mark.parametrize("name", ["random", "spiral", "holes", "chess"])
def test_regions_and_outlines_match_plain_ones(spark, name):
    cells = pattern(name)
    df = spark.createDataFrame([(x, y, k) for (x, y), k in cells.items()], "cx long, cy long, kind int")
    want, rings = flood(cells), walks(flood(cells))
    for tile in (4, 256) if name == "random" else (3,):
        found = regions.regions(df, tile)
        assert {(r["cx"], r["cy"]): (r["region_x"], r["region_y"]) for r in found.collect()} == want
    got = {}
    for r in regions.outlines(found).collect():
        hole, corners = got.setdefault(((r["region_x"], r["region_y"]), (r["ring_x"], r["ring_y"])), (r["hole"], []))
        assert hole == r["hole"]
        corners.append((r["place"], r["x"], r["y"]))
    assert {k: (h, sorted(c)) for k, (h, c) in got.items()} == rings
    if name == "holes":
        assert sum(h for h, _ in got.values()) == 1  # what touches at a corner only is outside together


def test_odd_cells(spark):
    df = spark.createDataFrame([(0, 0, 2), (0, 0, 1), (1, 0, 1), (None, 0, 1), (5, None, 1), (5, 5, None)], "cx long, cy long, kind int")
    assert sorted(tuple(r) for r in regions.regions(df).collect()) == [(0, 0, 1, 0, 0), (1, 0, 1, 0, 0)]
    empty = regions.regions(df.limit(0))
    assert empty.collect() == [] and regions.outlines(empty).collect() == []
    far = np.zeros((3, 3), int)
    assert regions.united(far, np.ones((3, 3), bool)).max() == 0 and regions.united(far, np.zeros((3, 3), bool)).max() == -1
