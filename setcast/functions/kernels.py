"""Array kernels over a row's class probabilities: Column functions without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def class_order(p: Column) -> Column:
    """0-based classes by descending probability; the lower class first among ties."""
    keyed = F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("minus"), i.alias("k"))))
    return F.transform(keyed, lambda e: e["k"])


def class_ranks(p: Column) -> Column:
    """1-based rank of each class, the inverse of class_order."""
    order = class_order(p)
    return F.transform(p, lambda _, i: F.array_position(order, i).cast("int"))


def inverse(order: Column) -> Column:
    return F.transform(order, lambda _, i: F.array_position(order, i).cast("int"))


def sorted_desc(p: Column) -> Column:
    return F.sort_array(p, asc=False)


def prefix_sum(a: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(a, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"] + x)).alias("out")), lambda s: s["out"])


def exclusive_prefix_sum(a: Column) -> Column:
    return F.slice(F.concat(F.array(F.lit(0.0)), prefix_sum(a)), F.lit(1), F.size(a))


def by_rank(sorted_values: Column, ranks: Column) -> Column:
    """The value at each class's rank."""
    return F.transform(ranks, lambda r: F.element_at(sorted_values, r))


def at_label(a: Column, y: Column) -> Column:
    """The entry of the 0-based class y; null beyond the array."""
    return F.get(a, y)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def within(scores: Column, tau: Column) -> Column:
    """Mask of the classes whose score is at most tau."""
    return F.transform(scores, lambda s: s <= tau)


def members(mask: Column) -> Column:
    """0-based classes of a mask."""
    return F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda x: x.isNotNull())


def set_size(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda m: m))


def saps_scores(p: Column, ranks: Column, u: Column, lam: Column) -> Column:
    """p(1) u for the top class, p(1) + (rank - 2 + u) lam for the others."""
    top = F.array_max(p)
    return F.transform(ranks, lambda r: F.when(r == 1, top * u).otherwise(top + (r - 2 + u) * lam))


def aps_scores(p: Column, order: Column, sorted_p: Column, before: Column, u: Column, lam: Column, k_reg: Column) -> Column:
    """Mass ranked before the class plus u times its own, plus lam max(0, rank - k_reg) if lam is positive. Scored in the order of ranks, then put in that of classes:
    a lookup by each class's rank would have the optimizer write the prefix sums into its lambda, to be made again for each class."""
    weight = F.greatest(lam, F.lit(0.0))
    mass = F.zip_with(before, sorted_p, lambda b, v: b + u * v)
    ranked = F.transform(mass, lambda m, i: m + weight * F.greatest(F.lit(0), i + 1 - k_reg))
    return F.transform(F.sort_array(F.zip_with(order, ranked, lambda k, s: F.struct(k.alias("k"), s.alias("score")))), lambda e: e["score"])


def saps_score(p: Column, rank: Column, u: Column, lam: Column) -> Column:
    """That of the class with this rank alone; null for a null rank."""
    top = F.array_max(p)
    return F.when(rank == 1, top * u).when(rank > 1, top + (rank - 2 + u) * lam)


def aps_score(rank: Column, sorted_p: Column, before: Column, u: Column, lam: Column, k_reg: Column) -> Column:
    """That of the class with this rank alone; null for a null rank."""
    return F.get(before, rank - 1) + u * F.get(sorted_p, rank - 1) + F.greatest(lam, F.lit(0.0)) * F.greatest(F.lit(0), rank - k_reg)


def register(spark: SparkSession) -> None:
    """The kernels as SQL functions, which the analyzer puts in place as expressions."""
    order = "transform(array_sort(transform(p, (v, i) -> struct(-v AS minus, i AS k))), e -> e.k)"
    for name, args, kind, body in (
        ("class_order", "p ARRAY<DOUBLE>", "ARRAY<INT>", order),
        ("class_ranks", "p ARRAY<DOUBLE>", "ARRAY<INT>", f"transform(p, (v, i) -> CAST(array_position({order}, i) AS INT))"),
        ("prefix_sum", "a ARRAY<DOUBLE>", "ARRAY<DOUBLE>", "transform(a, (v, i) -> aggregate(slice(a, 1, i + 1), 0D, (s, x) -> s + x))"),
        ("set_size", "scores ARRAY<DOUBLE>, tau DOUBLE", "INT", "size(filter(scores, s -> s <= tau))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
