"""Rasters, tiled prediction and executor memory."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from setcast.operators import grid, rasters
from setcast.plans import harness


def test_values_at_points(spark):
    r = random.Random(1)
    pixels = {(x, y): r.uniform(0, 9) for x in range(-7, 20) for y in range(-5, 9) if r.random() < 0.95}
    df = spark.createDataFrame([(x, y, v) for (x, y), v in pixels.items()] + [(None, 1, 2.0)], "px long, py long, value double")
    tiles = rasters.to_tiles(df, 4)
    assert all(len(t["values"]) == 16 for t in tiles.collect())
    points = [(k, r.uniform(-80, 230), r.uniform(-60, 100)) for k in range(600)] + [(700, 5.0, 5.0), (701, 0.0, 0.0), (702, None, 1.0)]
    at = spark.createDataFrame(points, "id long, x double, y double")
    got = {x["id"]: x["value"] for x in rasters.nearest_values(at, tiles, 4, 10.0).collect()}
    assert got == {k: pixels.get((math.floor(x / 10), math.floor(y / 10))) if x is not None else None for k, x, y in points}

    def between(x, y):
        fx, fy = x / 10 - 0.5, y / 10 - 0.5
        i, j = math.floor(fx), math.floor(fy)
        u, v = fx - i, fy - j
        parts = [(w, pixels.get((i + a, j + b))) for a, b, w in ((0, 0, (1 - u) * (1 - v)), (1, 0, u * (1 - v)), (0, 1, (1 - u) * v), (1, 1, u * v)) if w > 0]
        return None if any(p is None for _, p in parts) else sum(w * p for w, p in parts)

    got = {x["id"]: x["value"] for x in rasters.bilinear_values(at, tiles, 4, 10.0).collect()}
    for k, x, y in points:
        want = between(x, y) if x is not None else None
        assert got[k] == (pytest.approx(want) if want is not None else None), k
    assert rasters.nearest_values(at, tiles.limit(0), 4).where("value IS NOT NULL").count() == 0


def test_tiled_prediction_goes_on_where_it_stopped(spark, tmp_path):
    points = spark.range(500).select("id", (F.col("id") * 37 % 100).alias("x"), (F.col("id") * 61 % 100).alias("y"))
    grid.write_tiles(points, f"{tmp_path}/in", 20)
    seen = []

    def predict(rows):
        found = re.search(r"PartitionFilters: \[([^\]]*)\]", rows._jdf.queryExecution().executedPlan().toString())
        seen.append(set(re.findall(r"-?\d+_-?\d+", found[1])))
        return rows.withColumn("class", F.col("x") % 3)

    first = rasters.predict_tiles(spark, f"{tmp_path}/in", f"{tmp_path}/out", predict, batch=4, most=2)
    assert len(first) == 8 and rasters.predicted_tiles(spark, f"{tmp_path}/out").select("tile").distinct().count() == 8

    def broken(rows):
        rows.withColumn("class", F.lit(9).cast("long")).write.parquet(f"{tmp_path}/out/part-left-behind")
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        rasters.predict_tiles(spark, f"{tmp_path}/in", f"{tmp_path}/out", broken, batch=4)
    seen.clear()
    second = rasters.predict_tiles(spark, f"{tmp_path}/in", f"{tmp_path}/out", predict, batch=4)
    assert not set(first) & set(second) and seen and all(tiles and tiles <= set(second) for tiles in seen)
    got = sorted((r["id"], r["class"]) for r in rasters.predicted_tiles(spark, f"{tmp_path}/out").collect())
    assert got == sorted((r["id"], r["x"] % 3) for r in points.collect())
    assert rasters.predict_tiles(spark, f"{tmp_path}/in", f"{tmp_path}/out", predict) == []
    with pytest.raises(FileNotFoundError):
        rasters.predicted_tiles(spark, f"{tmp_path}/none")


def test_quadrants_and_executor_memory(spark):
    rows = spark.createDataFrame([(0, 0), (9, 0), (0, 9), (9, 9)], "x int, y int")
    assert [r[0] for r in rows.select(rasters.quadrants(F.col("x"), F.col("y"), 5, 5)).collect()] == [0, 1, 2, 3]
    spark.range(1_000_000).selectExpr("sum(sqrt(id))").collect()
    found = harness.executor_memory(spark)
    assert found["executors"] >= 1 and found["heap_mb"] > 10 and found["rss_mb"] >= 0
