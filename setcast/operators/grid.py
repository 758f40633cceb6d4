"""Operators on gridded points: resampling, clipping, filling, smoothing, comparing with a line, and writing by tile.

Points are rows with integer coordinates x and y; a cell is a square of so many units. All are equi-joins and partial aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(coordinate: str, size: int) -> Column:
    return F.floor(F.col(coordinate) / size).cast("long")


def resample(points: DataFrame, value: str, size: int) -> DataFrame:
    """(cx, cy, n, value): the mean of each cell with a value; null values and coordinates count for none."""
    known = points.where(F.col(value).isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull())
    return known.groupBy(cell("x", size).alias("cx"), cell("y", size).alias("cy")).agg(F.count("*").alias("n"), F.avg(value).alias(value))


def align(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("cx", "cy")) -> DataFrame:
    """Two resampled grids side by side; cells of one alone have nulls for the other."""
    return left.join(right, list(keys), "full")


def clip(points: DataFrame, region: DataFrame, key: str) -> DataFrame:
    """Points whose key is in a region; a region listed twice adds nothing."""
    return points.join(region.select(key), key, "left_semi")


def fill(cells: DataFrame, grid: DataFrame, value: str, background: int = 0, keys: tuple[str, ...] = ("cx", "cy")) -> DataFrame:
    """Every cell of a grid with its value, or the background's where it has none."""
    return grid.select(*keys).distinct().join(cells.select(*keys, value), list(keys), "left").withColumn(value, F.coalesce(F.col(value), F.lit(background)))


def smooth(cells: DataFrame, value: str, sure: Column, reach: int = 1) -> DataFrame:
    """(cx, cy, value) with the value of an unsure cell replaced by the commonest among the sure cells around it, the smallest of several; kept where there is none.

    A cell's surroundings are a fixed number of offsets, so that each cell is sent to as many places and no more.
    """
    offsets = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i or j]
    shift = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets))).alias("o")
    rows = cells.withColumn("_sure", F.coalesce(sure, F.lit(False)))
    near = rows.where("_sure").select("cx", "cy", value, shift).select((F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), value)
    votes = near.groupBy("cx", "cy", value).agg(F.count("*").alias("_n"))
    best = votes.groupBy("cx", "cy").agg(F.max_by(value, F.struct("_n", -F.col(value))).alias("_best"))
    return rows.join(best, ["cx", "cy"], "left").select("cx", "cy", F.when(F.col("_sure"), F.col(value)).otherwise(F.coalesce("_best", value)).alias(value))


def above_line(points: DataFrame, line: DataFrame, key: str, height: str, limit: str) -> DataFrame:
    """points with side: above, below, or null where the height or the line is not known."""
    known = F.when(F.col(height) > F.col(limit), "above").when(F.col(height) <= F.col(limit), "below")
    return points.join(line.select(key, limit), key, "left").withColumn("side", known)


def write_tiles(rows: DataFrame, path: str, size: int) -> None:
    """rows(x, y, ...) as Parquet in a folder for each tile; a tile is written by few tasks, a large one by several."""
    tiled = rows.withColumn("tile", F.concat_ws("_", cell("x", size), cell("y", size)))
    tiled.hint("rebalance", "tile").write.partitionBy("tile").mode("overwrite").parquet(path)
