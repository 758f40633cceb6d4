"""Exact order statistics of groups of any size and distribution, by counting: no task holds a group's values.

A wanted rank's range of values is cut into equal bins as long as it holds many rows, and narrows to the least and largest value of the bin that has the rank;
at the end only the distinct values of small ranges are ordered. A range of equal values needs no cutting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from setcast.sources.tables import settled

#: Rows of a range that are ordered, at most unless they are equal; bins that a larger one is cut into.
BIN_ROWS, MOST_BINS = 1 << 17, 1 << 12


def _bin(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.lit(MOST_BINS - 1), F.floor((value - low) / (high - low) * MOST_BINS)).cast("int")


def order_statistics(values: DataFrame, wanted: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """values(keys, value), wanted(keys, m, ...) -> wanted with the m-th smallest value (1-based) of its group. Nulls are left out.

    wanted is a small table; ranges are tables of its size, written between the passes over the values.
    """
    values = values.where(F.col(value).isNotNull())
    v, ranges = F.col(value), [*keys, "_lo", "_hi"]
    span = values.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))
    state = settled(wanted.join(span, keys).withColumn("_place", F.col("m").cast("long")), "ranges")
    large = (F.col("_n") > BIN_ROWS) & (F.col("_hi") > F.col("_lo"))
    while not state.where(large).isEmpty():
        todo = state.where(large)
        rows = values.join(todo.select(*ranges).distinct(), keys).where((v >= F.col("_lo")) & (v <= F.col("_hi")))
        counts = rows.groupBy(*ranges, _bin(v, F.col("_lo"), F.col("_hi")).alias("_bin")).agg(F.count("*").alias("_c"), F.min(value).alias("_a"), F.max(value).alias("_b"))
        counts = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*ranges).orderBy("_bin")))
        found = todo.join(counts, ranges).where((F.col("_place") <= F.col("_upto")) & (F.col("_place") > F.col("_upto") - F.col("_c")))
        found = found.select(*wanted.columns, F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), F.col("_c").alias("_n"), (F.col("_place") - F.col("_upto") + F.col("_c")).alias("_place"))
        state = settled(found.unionByName(state.where(~large)), "ranges")
    equal = state.where("_hi = _lo").select(*wanted.columns, F.col("_lo").alias(value))
    rest = state.where("_hi > _lo")
    there = values.join(rest.select(*ranges).distinct(), keys).where((v >= F.col("_lo")) & (v <= F.col("_hi"))).groupBy(*ranges, value).agg(F.count("*").alias("_c"))
    upto = there.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*ranges).orderBy(value)))
    found = rest.join(upto, ranges).where((F.col("_place") <= F.col("_upto")) & (F.col("_place") > F.col("_upto") - F.col("_c")))
    return found.select(*wanted.columns, value).union(equal.select(*wanted.columns, value))


def picked(values: DataFrame, spans: dict[int, tuple[int, float, float]], wanted: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """values(cell, score), spans {cell: (rows, least, largest)} -> {(cell, m): the m-th smallest} for the (cell, m) wanted.

    The same method for few wanted ranks, whose ranges the driver holds; a range of BIN_ROWS rows or fewer is not cut at all.
    """
    # (cell, low, high, rows, rows before, ranks wanted)
    ranges = [(c, spans[c][1], spans[c][2], spans[c][0], 0, sorted(m for d, m in wanted if d == c)) for c in sorted({c for c, _ in wanted})]
    within = lambda r: (F.col("cell") == r[0]) & (F.col("score") >= r[1]) & (F.col("score") <= r[2])
    while large := [r for r in ranges if r[3] > BIN_ROWS and r[2] > r[1]]:
        # Ranges of one cell don't overlap.
        at = F.coalesce(*(F.when(within(r), F.struct(F.lit(k).alias("range"), _bin(F.col("score"), F.lit(r[1]), F.lit(r[2])).alias("bin"))) for k, r in enumerate(large)))
        rows = values.select("score", at.alias("at")).where("at IS NOT NULL")
        counts = sorted(rows.groupBy("at.range", "at.bin").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect())
        ranges = [r for r in ranges if r not in large]
        for k, (cell, _, _, _, before, ms) in enumerate(large):
            for _, _, n, low, high in (c for c in counts if c[0] == k):
                if own := [m for m in ms if before < m <= before + n]:
                    ranges.append((cell, low, high, n, before, own))
                before += n
    out = {(r[0], m): r[1] for r in ranges if r[1] == r[2] for m in r[5]}
    rest = [r for r in ranges if r[2] > r[1]]
    if not rest:
        return out
    rows = values.select("score", F.coalesce(*(F.when(within(r), F.lit(k)) for k, r in enumerate(rest))).alias("range")).where("range IS NOT NULL")
    distinct = rows.groupBy("range", "score").agg(F.count("*").alias("n"))
    upto = distinct.withColumn("upto", F.sum("n").over(Window.partitionBy("range").orderBy("score")))
    hit = F.lit(False)
    for k, r in enumerate(rest):
        for m in r[5]:
            hit |= (F.col("range") == k) & (F.col("upto") >= m - r[4]) & (F.col("upto") - F.col("n") < m - r[4])
    for x in upto.where(hit).collect():
        cell, _, _, _, before, ms = rest[x["range"]]
        out |= {(cell, m): x["score"] for m in ms if x["upto"] - x["n"] < m - before <= x["upto"]}
    return out
