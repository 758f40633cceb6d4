"""Classification metrics from (y, pred) rows, by one confusion count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(pred: DataFrame) -> DataFrame:
    return pred.groupBy("y", "pred").agg(F.count("*").alias("n"))


def by_class(pred: DataFrame) -> DataFrame:
    """(k, f1, recall) of the classes in y or pred, by one confusion count: f1 is 0 where undefined, recall null for classes not in y."""
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(F.struct(F.col("y").alias("k"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("told"), hit.alias("hit")), F.struct(F.col("pred").alias("k"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("told"), F.lit(0).cast("long").alias("hit")))
    both = confusion(pred).select(F.explode(sides).alias("c")).select("c.*")
    # truth and told count a class as truth and as prediction: 2 tp + fp + fn
    return both.groupBy("k").agg((2 * F.sum("hit") / (F.sum("truth") + F.sum("told"))).alias("f1"), (F.sum("hit") / F.nullif(F.sum("truth"), F.lit(0))).alias("recall"))


def quality(pred: DataFrame) -> DataFrame:
    """Unweighted mean F1 over the classes in y or pred, and mean recall over those in y."""
    return by_class(pred).agg(F.avg("f1").alias("f1_macro"), F.avg("recall").alias("balanced_accuracy"))


def macro_f1(pred: DataFrame) -> DataFrame:
    return quality(pred).select("f1_macro")


def balanced_accuracy(pred: DataFrame) -> DataFrame:
    return quality(pred).select("balanced_accuracy")
