"""Rasters as tiles of arrays, values at points, and tiled prediction that goes on where it stopped.

A tile is a row (tile_x, tile_y, values): size by size pixels of one band, row by row from its lower left corner, null where there is no value.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setcast.operators.grid import cell

#: Tiles that are predicted between two entries of the manifest.
BATCH_TILES = 256


def to_tiles(pixels: DataFrame, size: int, value: str = "value") -> DataFrame:
    """pixels(px, py, value), one row each -> tiles of size by size pixels. A tile's pixels are gathered in a task, and no more. Rows without a place are left out."""
    at = (F.pmod("py", F.lit(size)) * size + F.pmod("px", F.lit(size))).cast("int")
    known = pixels.where("px IS NOT NULL AND py IS NOT NULL").select(cell("px", size).alias("tile_x"), cell("py", size).alias("tile_y"), at.alias("k"), F.col(value).cast("double").alias("v"))
    filled = F.map_from_entries(F.collect_list(F.struct("k", "v")))
    found = known.groupBy("tile_x", "tile_y").agg(filled.alias("m"))
    return found.select("tile_x", "tile_y", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.element_at("m", k)).alias("values"))


def _read(wanted: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """wanted(px, py, ...) with value, null where there is no tile or pixel; an equi-join on tiles, and an offset within."""
    rows = wanted.withColumn("tile_x", cell("px", size)).withColumn("tile_y", cell("py", size)).withColumn("_k", (F.pmod("py", F.lit(size)) * size + F.pmod("px", F.lit(size))).cast("int"))
    joined = rows.join(tiles.select("tile_x", "tile_y", "values"), ["tile_x", "tile_y"], "left")
    return joined.select(*wanted.columns, F.get("values", F.col("_k")).alias("value"))


def nearest_values(points: DataFrame, tiles: DataFrame, size: int, pixel: float = 1.0) -> DataFrame:
    """points(x, y, ...) with value: that of the pixel that holds the point; null outside and for null coordinates."""
    at = points.withColumn("px", cell("x", pixel)).withColumn("py", cell("y", pixel))
    return _read(at, tiles, size).select(*points.columns, "value")


def bilinear_values(points: DataFrame, tiles: DataFrame, size: int, pixel: float = 1.0, key: str = "id") -> DataFrame:
    """points(key, x, y, ...) with value: between the centres of the four pixels around the point, which may lie in up to four tiles. Null if any of those with
    a weight is missing. key is unique; points without one are left out."""
    fx, fy = F.col("x") / pixel - 0.5, F.col("y") / pixel - 0.5
    base = points.where(F.col(key).isNotNull()).select(key, F.floor(fx).alias("bx"), F.floor(fy).alias("by"), (fx - F.floor(fx)).alias("u"), (fy - F.floor(fy)).alias("v"))
    side = lambda c, k: F.col(c) if k else 1 - F.col(c)
    corners = F.array(*(F.struct((F.col("bx") + i).alias("px"), (F.col("by") + j).alias("py"), (side("u", i) * side("v", j)).alias("weight"), F.lit(2 * j + i).alias("corner")) for i in (0, 1) for j in (0, 1)))
    wanted = base.select(key, F.explode(F.filter(corners, lambda c: c["weight"] > 0)).alias("c")).select(key, "c.*")
    found = _read(wanted, tiles, size)
    # Four numbers at most, added up in the order of corners.
    each = F.transform(F.array_sort(F.collect_list(F.struct("corner", (F.col("weight") * F.col("value")).alias("part")))), lambda c: c["part"])
    sums = found.groupBy(key).agg(F.aggregate(each, F.lit(0.0), lambda s, x: s + x).alias("value"))
    return points.join(sums, key, "left").select(*points.columns, "value")


# Tiled prediction


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(tile, part) of the tiles that are finished, part the folder with their rows."""
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], "tile string, part string")
    return spark.read.schema("tile string, part string").json(f"{path}/manifest")


def predict_tiles(spark: SparkSession, source: str, path: str, predict: Callable[[DataFrame], DataFrame], batch: int = BATCH_TILES, most: int | None = None) -> list[str]:
    """Predict the rows of all tiles of source, a table partitioned by tile (see grid.write_tiles), and return the tiles done by this call.

    Tiles are taken in batches. A batch's rows are written to a folder of their own and count once its line is in the manifest, so that a run that is stopped loses
    at most a batch, and the next one reads only tiles that the manifest lacks. most, if given, ends the run after so many batches. predict gets
    the rows with their tile and returns rows with it. The driver holds the names of tiles.
    """
    rows = spark.read.parquet(source).withColumn("tile", F.col("tile").cast("string"))
    finished = {r["tile"] for r in manifest(spark, path).collect()}
    todo = sorted(r["tile"] for r in rows.select("tile").distinct().collect() if r["tile"] not in finished)
    done: list[str] = []
    for k, begin in enumerate(range(0, len(todo), batch)):
        if most is not None and k >= most:
            break
        some, part = todo[begin : begin + batch], f"part-{uuid.uuid4().hex}"
        spark_rows = rows.where(F.col("tile").isin(some))  # prunes partitions: finished tiles are not read
        predict(spark_rows).write.parquet(f"{path}/{part}")
        lines = spark.createDataFrame([(json.dumps({"tile": t, "part": part}),) for t in some], "value string")
        lines.coalesce(1).write.mode("append").text(f"{path}/manifest")
        done += some
    return done


def predicted_tiles(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all finished tiles; what a stopped run left behind is not among them."""
    parts = sorted(r["part"] for r in manifest(spark, path).select("part").distinct().collect())
    if not parts:
        raise FileNotFoundError(f"{path} has no finished tile")
    return spark.read.parquet(*(f"{path}/{p}" for p in parts))


def quadrants(x: Column, y: Column, middle_x: float, middle_y: float) -> Column:
    """0 to 3: which quarter of an area a place is in, to work through it piece by piece."""
    return (x >= middle_x).cast("int") + 2 * (y >= middle_y).cast("int")
