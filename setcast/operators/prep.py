"""Row operators: exact subsamples, label encoding, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setcast.operators.order import order_statistics


def subsample(df: DataFrame, n: int, key: str = "sample_id", seed: int = 0) -> DataFrame:
    """Exactly min(n, rows) rows without replacement: those with the smallest portable hash of the key. A top-n, not a global sort."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def encode_labels(*labels: DataFrame) -> DataFrame:
    """(code, class_idx): sorted distinct codes of all the given label columns, numbered from 0. Classes are few."""
    return _codes(labels).select("code", (F.row_number().over(Window.orderBy("code")) - 1).alias("class_idx"))


def _codes(labels: tuple[DataFrame, ...]) -> DataFrame:
    codes = labels[0].select("code")
    for more in labels[1:]:
        codes = codes.union(more.select("code"))
    return codes.where("code IS NOT NULL").distinct()


#: Classes that are broadcast, at most.
FEW_CLASSES = 10_000


#: Classes whose codes are looked up in a literal, at most: no join, no broadcast.
LITERAL_CLASSES = 64


def class_table(spark: SparkSession, codes: list[int]) -> DataFrame:
    """(code, class_idx) of sorted distinct codes, to be broadcast if they are few."""
    known = spark.createDataFrame([(c, k) for k, c in enumerate(codes)], "code int, class_idx int")
    return F.broadcast(known) if len(codes) <= FEW_CLASSES else known


def known_classes(*frames: DataFrame) -> tuple[DataFrame, int]:
    """The encoded labels of all frames and their number. Few come to the driver once and are broadcast; of more only their number does."""
    found = sorted(r["code"] for r in _codes(frames).limit(FEW_CLASSES + 1).collect())
    if len(found) > FEW_CLASSES:
        classes = encode_labels(*frames)
        return classes, classes.count()
    return class_table(frames[0].sparkSession, found), len(found)


def _unseen() -> Column:
    return F.raise_error(F.concat(F.lit("unseen label "), F.col("code").cast("string"))).cast("int")


def with_classes(df: DataFrame, classes: DataFrame) -> DataFrame:
    """df with class_idx. A code that was never encoded is an error, raised when the row is read."""
    joined = df.join(classes, "code", "left")
    return joined.withColumn("class_idx", F.when(F.col("class_idx").isNull() & F.col("code").isNotNull(), _unseen()).otherwise(F.col("class_idx")))


def with_codes(df: DataFrame, codes: list[int]) -> DataFrame:
    """The same from the sorted distinct codes themselves."""
    if len(codes) > LITERAL_CLASSES:
        return with_classes(df, class_table(df.sparkSession, codes))
    place = F.array_position(F.array(*(F.lit(c) for c in codes)).cast("array<int>"), F.col("code").cast("int"))
    return df.withColumn("class_idx", F.when(place > 0, (place - 1).cast("int")).when(F.col("code").isNotNull(), _unseen()))


def class_distribution(df: DataFrame, label: str = "code") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("n"), F.max(F.size("features")).cast("long").alias("n_features"), F.countDistinct("code").alias("n_classes"))


def label_fallback(df: DataFrame, fine: str, coarse: str, lookup: DataFrame, key: str) -> DataFrame:
    """The fine label where there is one, else the coarse; then a lookup table, broadcast if Spark finds it small enough."""
    return df.withColumn(key, F.coalesce(fine, coarse)).join(lookup, key, "left")


def zonal_stats(df: DataFrame, zone: str, kind: str, value: str, threshold: float) -> DataFrame:
    """Median, maximum, standard deviation and share above a threshold, per zone and class; the median exact and without gathering a group's values."""
    v, keys = F.col(value), [zone, kind]
    stats = df.groupBy(*keys).agg(F.max(v).alias("max"), F.stddev_pop(v).alias("sd"), F.avg((v > threshold).cast("double")).alias("share_above"), F.count(v).alias("_n"))
    middle = F.explode(F.array(F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1))
    wanted = stats.where("_n > 0").select(*keys, middle.alias("m")).distinct()
    halves = order_statistics(df.select(*keys, v.cast("double").alias("score")), wanted, keys)
    medians = halves.groupBy(*keys).agg(F.avg("score").alias("median"))
    return stats.join(medians, keys, "left").select(*keys, "median", "max", "sd", "share_above")


def merge_zonal(stats: DataFrame, zone: str, kind: str, values: tuple[str, ...], kinds: list) -> DataFrame:
    """One row per zone, a column <value>_<class> for each statistic and class."""
    wide = [F.max(F.when(F.col(kind) == k, F.col(v))).alias(f"{v}_{k}") for k in kinds for v in values]
    return stats.groupBy(zone).agg(*wide)


def area_rollup(df: DataFrame, outer: str, inner: str, area: str) -> DataFrame:
    return df.rollup(outer, inner).agg(F.sum(area).alias("area"))
