"""Conformal prediction sets: APS, RAPS, SAPS and RANK over a grid of levels and penalties.

Ranks, sorted probabilities and prefix sums are computed once per row. Calibration rows are kept while they are read twice: one aggregation
counts and bounds the scores of all cells and the true classes' ranks, another picks the wanted order statistics, exact and
distributed. The few thresholds then are literals of one plan over the test rows, with a single exchange for the metrics.
"""

from __future__ import annotations

import math
import time

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setcast.functions import kernels as K
from setcast.operators.order import order_statistics, picked

__all__ = ["ALPHAS", "COMPARED", "SAPS_LAMS", "compare_methods", "in_cells", "order_statistics", "rank_sets", "rank_thresholds", "ranked", "saps_sweep", "score_sets", "scores", "set_metrics", "thresholds", "timed_comparison"]

ALPHAS = (0.05, 0.1, 0.2)
SAPS_LAMS = (0.02, 0.05, 0.1, 0.2, 0.5)
#: (method, lam, k_reg) cells of the four-method comparison.
COMPARED = (("APS", 0.0, 1), ("RAPS", 0.01, 1), ("SAPS", 0.2, None))
_THRESHOLD = "array<struct<alpha:double,tau:double>>"


def ranked(probs: DataFrame) -> DataFrame:
    """probs(sample_id, split, y, u, p) with ord, ranks, sorted_p and before (mass ranked ahead)."""
    rows = probs.withColumn("ord", K.class_order(F.col("p"))).withColumn("sorted_p", K.sorted_desc(F.col("p")))
    return rows.withColumn("ranks", K.inverse(F.col("ord"))).withColumn("before", K.exclusive_prefix_sum(F.col("sorted_p")))


def scores(method: str, lam: float, k_reg: int | None) -> Column:
    if method == "SAPS":
        return K.saps_scores(F.col("p"), F.col("ranks"), F.col("u"), F.lit(float(lam)))
    return K.aps_scores(F.col("p"), F.col("ord"), F.col("sorted_p"), F.col("before"), F.col("u"), F.lit(float(lam)), F.lit(int(k_reg or 1)))


def label_score(method: str, lam: float, k_reg: int | None) -> Column:
    """The true class's score, without those of the others; null where the class is none."""
    rank = K.at_label(F.col("ranks"), F.col("y"))
    if method == "SAPS":
        return K.saps_score(F.col("p"), rank, F.col("u"), F.lit(float(lam)))
    return K.aps_score(rank, F.col("sorted_p"), F.col("before"), F.col("u"), F.lit(float(lam)), F.lit(int(k_reg or 1)))


def in_cells(rows: DataFrame, cells: tuple) -> DataFrame:
    """A row per sample and (method, lam, k_reg) cell with its scores."""
    each = [F.struct(F.lit(m).alias("method"), F.lit(float(lam)).alias("lam"), F.lit(k).cast("int").alias("k_reg"), scores(m, lam, k).alias("scores")) for m, lam, k in cells]
    return rows.select("sample_id", "y", F.explode(F.array(*each)).alias("c")).select("sample_id", "y", "c.*")


def thresholds(cells: DataFrame, alphas: tuple[float, ...], mode: str = "reference") -> DataFrame:
    """tau of each cell and level: of n calibration scores the min(k + 1, n)-th smallest, k = ceil((n + 1)(1 - alpha)); the k-th in mode textbook."""
    values = cells.select("method", "lam", K.at_label(F.col("scores"), F.col("y")).alias("score"))
    levels = F.explode(F.array(*(F.lit(float(a)) for a in alphas)))
    n = values.groupBy("method", "lam").agg(F.count("*").alias("n")).select("method", "lam", "n", levels.alias("alpha"))
    k = F.ceil((F.col("n") + 1) * (F.lit(1.0) - F.col("alpha")))
    m = F.least(k + (1 if mode == "reference" else 0), F.col("n"))
    found = order_statistics(values, n.select("method", "lam", "alpha", m.alias("m")), ["method", "lam"])
    return found.select("method", "lam", "alpha", F.col("score").alias("tau"))


def calibrated_thresholds(rows: DataFrame, cells: tuple, alphas: tuple[float, ...], mode: str = "reference") -> DataFrame:
    """(method, lam, alpha, tau) of each cell and level, in two passes over the calibration rows."""
    found, _ = _calibrated(rows, cells, alphas, mode, with_rank=False)
    out = [(m, float(lam), a, tau) for k, (m, lam, _) in enumerate(cells) for a, tau in found[k]]
    return rows.sparkSession.createDataFrame(out, "method string, lam double, alpha double, tau double")


def _calibrated(rows: DataFrame, cells: tuple, alphas: tuple[float, ...], mode: str, with_rank: bool) -> tuple[dict[int, list[tuple[float, float]]], list[dict]]:
    """The (alpha, tau) of each cell, by its place in cells; and RANK's stages (see rank_thresholds). Two passes over the calibration rows, which are
    kept meanwhile; the driver gets a row for each cell and class."""
    cal = rows.where("split = 'cal'")
    own = [F.struct(F.lit(k).alias("cell"), label_score(*c).alias("score")) for k, c in enumerate(cells)]
    first_rank = len(cells)  # the cell of rank 0, which no class has
    rank = K.at_label(F.col("ranks"), F.col("y"))
    if with_rank:
        own.append(F.struct((rank + first_rank).alias("cell"), F.lit(0.0).alias("score")))
    kept = cal.select(F.array(*own).alias("own"), *(["sorted_p"] if with_rank else [])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        values = kept.select(F.explode("own").alias("v")).select("v.cell", "v.score")
        spans = {r["cell"]: (r["n"], r["low"], r["high"]) for r in values.where("cell IS NOT NULL").groupBy("cell").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).collect()}
        wanted, places = set(), {}
        for k in range(len(cells)):
            n = spans.get(k, (0,))[0]
            for a in alphas if n else ():
                place = math.ceil((n + 1) * (1.0 - a)) + (1 if mode == "reference" else 0)
                places[k, a] = min(place, n)
                wanted.add((k, places[k, a]))
        stages = _rank_stages({c - first_rank: x[0] for c, x in spans.items() if c > first_rank}, alphas) if with_rank else []
        chosen = values.where(F.col("cell") < first_rank)
        if stages:
            # Probabilities at a rank r are cells of their own, behind the others; they lie in [0, 1].
            levels = sorted({s["r_star"] for s in stages})
            at_rank = F.explode(F.array(*(F.struct(F.lit(first_rank + r).alias("cell"), F.get("sorted_p", F.lit(r - 1)).alias("score")) for r in levels))).alias("v")
            chosen = chosen.union(kept.select(at_rank).select("v.cell", "v.score"))
            spans |= {first_rank + r: (stages[0]["n"], 0.0, 1.0) for r in levels}
            wanted |= {(first_rank + s["r_star"], s["m"]) for s in stages}
        found = picked(chosen, spans, wanted)
    finally:
        kept.unpersist()
    for s in stages:
        p = found[first_rank + s["r_star"], s.pop("m")]
        s["pi_star"] = math.inf if s["k_pick"] <= 0 else -math.inf if s["k_pick"] > s["n"] else p
    return {k: [(a, found[k, places[k, a]]) for a in alphas if (k, a) in places] for k in range(len(cells))}, stages


def _rank_stages(counts: dict[int, int], alphas: tuple[float, ...]) -> list[dict]:
    """Per level from the number of calibration rows by the true class's rank: the rank to stop at, and which probability there decides."""
    n, out = sum(counts.values()), []
    for alpha in map(float, alphas) if n else ():
        floor = math.floor((n + 1) * alpha)
        kth, from_top = max(1, min(floor, n)), 0
        for r in sorted(counts, reverse=True):
            from_top += counts[r]
            if kth <= from_top:
                break
        below = n - from_top
        share = max(0.0, min(1.0, (n - floor - below) / counts[r]))
        k_pick = math.ceil(n * share)
        out.append({"alpha": alpha, "n": n, "r_star": r, "below": below, "n_at": counts[r], "k_pick": k_pick, "m": max(1, min(n - k_pick + 1, n))})
    return out


def set_metrics(sets: DataFrame, by: list[str]) -> DataFrame:
    """sets(by..., size, covered) -> coverage and set-size statistics; null for no rows."""
    share = lambda c: F.avg(c.cast("double"))
    return sets.groupBy(*by).agg(
        share(F.col("covered")).alias("coverage"),
        F.avg("size").alias("avg_set_size"),
        F.median("size").alias("median_set_size"),
        F.max("size").cast("int").alias("max_set_size"),
        share(F.col("size") == 1).alias("pct_singleton"),
        share(F.col("size") == 0).alias("pct_empty"),
    )


def _taus(found: list[tuple[float, float]]) -> Column:
    return F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(t).alias("tau")) for a, t in found)).cast(_THRESHOLD) if found else F.from_json(F.lit("[]"), _THRESHOLD)


def score_sets(rows: DataFrame, cells: tuple, alphas: tuple[float, ...], mode: str = "reference") -> DataFrame:
    """Test sets of APS, RAPS and SAPS cells: (method, lam, k_reg, alpha, tau, sample_id, y, members, size, covered)."""
    found, _ = _calibrated(rows, cells, alphas, mode, with_rank=False)
    each = [F.struct(F.lit(m).alias("method"), F.lit(float(lam)).alias("lam"), F.lit(k).cast("int").alias("k_reg"), scores(m, lam, k).alias("scores"), _taus(found[i]).alias("taus")) for i, (m, lam, k) in enumerate(cells)]
    test = rows.where("split = 'test'").select("sample_id", "y", F.explode(F.array(*each)).alias("c"))
    test = test.select("sample_id", "y", "c.method", "c.lam", "c.k_reg", "c.scores", F.explode("c.taus").alias("t"))
    mask = K.within(F.col("scores"), F.col("t.tau"))
    return test.select("method", "lam", "k_reg", "t.alpha", "t.tau", "sample_id", "y", K.members(mask).alias("members"), K.set_size(mask).alias("size"), F.coalesce(K.at_label(mask, F.col("y")), F.lit(False)).alias("covered"))


def rank_thresholds(rows: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    """RANK's two stages per level: (alpha, n, r_star, below, n_at, k_pick, pi_star); pi_star is infinite for none and minus infinite for all."""
    _, stages = _calibrated(rows, (), alphas, "reference", with_rank=True)
    names = ("alpha", "n", "r_star", "below", "n_at", "k_pick", "pi_star")
    return rows.sparkSession.createDataFrame([tuple(s[c] for c in names) for s in stages], "alpha double, n long, r_star int, below long, n_at long, k_pick long, pi_star double")


def _rank_size(r_star: Column, pi_star: Column) -> Column:
    return F.when(F.element_at("sorted_p", r_star) >= pi_star, r_star).otherwise(r_star - 1)


def rank_sets(rows: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    """Test sets of RANK: the r* likeliest classes if the r*-th probability reaches pi*, else one less; empty where r* = 1 fails."""
    _, stages = _calibrated(rows, (), alphas, "reference", with_rank=True)
    each = F.array(*(F.struct(F.lit(s["alpha"]).alias("alpha"), F.lit(s["r_star"]).alias("r_star"), F.lit(s["pi_star"]).alias("pi_star")) for s in stages))
    each = each if stages else F.from_json(F.lit("[]"), "array<struct<alpha:double,r_star:int,pi_star:double>>")
    test = rows.where("split = 'test'").select("sample_id", "y", "ord", "ranks", "sorted_p", F.explode(each).alias("s"))
    size = _rank_size(F.col("s.r_star"), F.col("s.pi_star"))
    return test.select("s.alpha", "s.r_star", "sample_id", "y", F.slice("ord", F.lit(1), size).alias("members"), size.alias("size"), (K.at_label(F.col("ranks"), F.col("y")) <= size).alias("covered"))


def saps_sweep(rows: DataFrame, alphas: tuple[float, ...] = ALPHAS, lams: tuple[float, ...] = SAPS_LAMS, mode: str = "reference") -> DataFrame:
    sets = score_sets(rows, tuple(("SAPS", lam, None) for lam in lams), alphas, mode).drop("members")
    return set_metrics(sets.withColumn("target_coverage", 1 - F.col("alpha")), ["alpha", "target_coverage", "lam", "tau"])


def compare_methods(rows: DataFrame, alphas: tuple[float, ...] = ALPHAS, cells: tuple = COMPARED, mode: str = "reference", with_rank: bool = True) -> DataFrame:
    """One row per method and level, with its hyper-parameters as hp_...; those that a method lacks are null. All sets of a test row are made at once."""
    found, stages = _calibrated(rows, cells, alphas, mode, with_rank)
    none = F.lit(None)

    def of(method: str, alpha: float, tau: Column, lam: Column, k_reg: Column, r_star: Column, size: Column, covered: Column) -> Column:
        parts = {"method": F.lit(method), "alpha": F.lit(alpha), "tau": tau.cast("double"), "hp_lam": lam.cast("double"), "hp_k_reg": k_reg.cast("int"), "hp_r_star": r_star.cast("int"), "size": size, "covered": covered}
        return F.struct(*(c.alias(name) for name, c in parts.items()))

    test = rows.where("split = 'test'").select("y", "ranks", "sorted_p", *(scores(*c).alias(f"s{k}") for k, c in enumerate(cells)), *(label_score(*c).alias(f"y{k}") for k, c in enumerate(cells)))
    sets = []
    for k, (m, lam, k_reg) in enumerate(cells):
        for alpha, tau in found[k]:
            covered = F.coalesce(F.col(f"y{k}") <= tau, F.lit(False))
            size = F.size(F.filter(f"s{k}", lambda s: s <= tau))  # noqa: B023  called at once
            sets.append(of(m, alpha, F.lit(tau), none if m == "APS" else F.lit(float(lam)), F.lit(k_reg) if m == "RAPS" else none, none, size, covered))
    for s in stages:
        size = _rank_size(F.lit(s["r_star"]), F.lit(s["pi_star"]))
        sets.append(of("RANK", s["alpha"], none, none, none, F.lit(s["r_star"]), size, K.at_label(F.col("ranks"), F.col("y")) <= size))
    test = test.select(F.explode(F.array(*sets)).alias("c")) if sets else test.where("false").select(of("", 0.0, none, none, none, none, F.lit(0), F.lit(False)).alias("c"))
    rows = test.select("c.*").withColumn("target_coverage", 1 - F.col("alpha"))
    return set_metrics(rows, ["method", "alpha", "target_coverage", "tau", "hp_lam", "hp_k_reg", "hp_r_star"])


def timed_comparison(rows: DataFrame, alphas: tuple[float, ...] = ALPHAS, cells: tuple = COMPARED, mode: str = "reference") -> DataFrame:
    """compare_methods() with time_ms: each method at each level is calibrated and scored by itself, over rows that are kept meanwhile."""
    kept, out = rows.persist(StorageLevel.MEMORY_AND_DISK), []
    try:
        kept.count()
        for a in alphas:
            for chosen in [*((c,) for c in cells), ()]:
                began = time.perf_counter()
                found = compare_methods(kept, (a,), chosen, mode, with_rank=not chosen)
                schema = found.schema
                got = found.collect()
                took = round((time.perf_counter() - began) * 1000, 2)
                out += [(*r, took) for r in got]
    finally:
        kept.unpersist()
    fields = [T.StructField(f.name, f.dataType) for f in schema] if alphas else []
    return rows.sparkSession.createDataFrame(out, T.StructType([*fields, T.StructField("time_ms", T.DoubleType())]))
