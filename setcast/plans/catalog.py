"""Named queries over the driver's tables and the SQL that each must agree with.

The embeddings table stands in for the feature tables: its ids give the splits, its labels the classes. Floats are rounded to
six digits in both engines.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setcast.operators import boosting, codes, conformal, grid, metrics, models, polygons, prep, projection, rasters, regions
from setcast.sources import tables

FLAGSHIP = "compare_methods"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def encoded(spark: SparkSession, folder: str, seed: int = 0) -> tuple[DataFrame, int]:
    """Rows with class_idx, and how many classes there are; these are few and come to the driver once."""
    rows = tables.samples(spark, folder, seed=seed)
    classes, k = prep.known_classes(rows)
    return prep.with_classes(rows, classes), k


def probs(spark: SparkSession, folder: str, model: str = "centroid", wanted: str = "split <> 'train'", **options) -> DataFrame:
    """(sample_id, split, y, u, p) of the wanted rows, calibration and test if not told otherwise. seed, if given, decides u as well as the model's draws."""
    if model == "centroid":  # labels and means from one aggregation
        rows = tables.samples(spark, folder, seed=options.get("seed", 0))
        codes_found, centroids = models.encoded_centroids(rows)
        scored = prep.with_codes(rows.where(wanted), codes_found).withColumn("p", centroids.probabilities(F.col("features")))
        return scored.select("sample_id", "split", F.col("class_idx").alias("y"), "u", "p")
    rows, k = encoded(spark, folder, options.get("seed", 0))
    scored = models.with_probabilities(model, rows.where("split = 'train'"), rows.where(wanted), k, **options)
    return scored.select("sample_id", "split", F.col("class_idx").alias("y"), "u", "p")


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    return conformal.ranked(probs(spark, folder))


def _long(df: DataFrame, array: str, name: str) -> DataFrame:
    """A row per class. The outer form, as for the other one Spark asks beforehand whether the array has entries, with all of the expressions that make it."""
    return df.select("sample_id", F.posexplode_outer(array).alias("class_idx", name)).where("class_idx IS NOT NULL")


def _predictions(spark: SparkSession, folder: str, model: str = "centroid", **options) -> DataFrame:
    return probs(spark, folder, model, "split = 'test'", **options).select("y", models.predicted(F.col("p")).alias("pred"))


def load_clean(spark, folder):
    rows = tables.table(spark, folder, "embeddings").select("vec_id", F.expr("CASE WHEN vec_id % 7 = 3 THEN CAST(NULL AS DOUBLE) WHEN vec_id % 11 = 5 THEN CAST('NaN' AS DOUBLE) ELSE vec_id / 4D END AS f"), F.expr("CASE WHEN vec_id % 13 <> 1 THEN 'a' END AS split"), F.expr("label + 0.9D AS code"))
    return tables.load_clean(rows).select("vec_id", "f", "code")


def subsample_exact(spark, folder):
    return prep.subsample(tables.samples(spark, folder).where("split = 'train'"), 100).select("sample_id", "code")


def dummy_predict(spark, folder):
    rows = tables.samples(spark, folder)
    top = rows.where("split = 'train'").groupBy("code").agg(F.count("*").alias("n")).agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("pred"))
    return rows.where("split = 'test'").join(F.broadcast(top), F.lit(True)).select("sample_id", "code", "pred")


def sorted_cumsum(spark, folder):
    rows = _ranked(spark, folder)
    return _rounded(_long(rows, "before", "before").withColumn("rank", F.col("class_idx") + 1).select("sample_id", "rank", "before"))


def _scores(method, lam, k_reg):
    return lambda s, d: _rounded(_long(_ranked(s, d).withColumn("scores", conformal.scores(method, lam, k_reg)), "scores", "score"))


def conformal_tau(spark, folder):
    return _rounded(conformal.calibrated_thresholds(_ranked(spark, folder), conformal.COMPARED, conformal.ALPHAS))


_ZONAL = ("median", "max", "sd", "share_above")


def _metrics_of(method, lam, k_reg):
    def run(spark, folder):
        sets = conformal.score_sets(_ranked(spark, folder), ((method, lam, k_reg),), conformal.ALPHAS)
        return _rounded(conformal.set_metrics(sets, ["alpha", "tau"]))

    return run


def rank_threshold(spark, folder):
    found = conformal.rank_thresholds(_ranked(spark, folder), conformal.ALPHAS)
    shown = F.when(F.abs("pi_star") < float("inf"), F.col("pi_star"))
    return _rounded(found.select("alpha", "n", "r_star", "below", "n_at", "k_pick", shown.alias("pi_star")))


def set_size_hist(spark, folder):
    sets = conformal.score_sets(_ranked(spark, folder), conformal.COMPARED, conformal.ALPHAS)
    return sets.groupBy("method", "alpha", "size").agg(F.count("*").alias("n"), F.sum(F.col("covered").cast("long")).alias("covered"))


def prediction_sets(spark, folder):
    sets = conformal.score_sets(_ranked(spark, folder), (("SAPS", 0.2, None),), (0.1,))
    return sets.select("sample_id", F.explode("members").alias("class_idx"))


def _zoned(spark, folder):
    """(zone, class_idx, p), written once for the passes that the statistics take."""
    rows = _long(probs(spark, folder), "p", "p")
    return tables.settled(rows.select((F.col("sample_id") % 5).alias("zone"), "class_idx", "p"), "zones")


def zonal_stats(spark, folder):
    return _rounded(prep.zonal_stats(_zoned(spark, folder), "zone", "class_idx", "p", 0.1))


def zonal_merged(spark, folder):
    """A column for each statistic and encoded class."""
    rows = _zoned(spark, folder)
    n = rows.agg(F.max("class_idx")).first()[0]
    stats = prep.zonal_stats(rows, "zone", "class_idx", "p", 0.1)
    return _rounded(prep.merge_zonal(stats, "zone", "class_idx", _ZONAL, list(range(0 if n is None else n + 1))))


def label_fallback(spark, folder):
    rows = tables.samples(spark, folder).select("sample_id", F.expr("CASE WHEN sample_id % 3 > 0 THEN code END AS level2"), F.expr("code % 4 AS level1"))
    lookup = tables.table(spark, folder, "nation").select(F.col("n_nationkey").cast("int").alias("code"), F.col("n_name").alias("name"))
    return prep.label_fallback(rows, "level2", "level1", lookup, "code").select("sample_id", "code", "name")


def area_rollup(spark, folder):
    nation, region, customer = (tables.table(spark, folder, t) for t in ("nation", "region", "customer"))
    rows = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return prep.area_rollup(rows.withColumn("area", F.col("c_custkey").cast("long")), "r_name", "n_name", "area")


def stratified_sample(spark, folder):
    """Ten rows of each class, by a hash within the class."""
    h = Window.partitionBy("code").orderBy(F.md5(F.col("sample_id").cast("string")), "sample_id")
    return tables.samples(spark, folder).withColumn("k", F.row_number().over(h)).where("k <= 10").select("sample_id", "code")


def _points(spark, folder):
    """Order lines as points on a plane of 1000 by 1000 units, with a class and a value."""
    kind = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    rows = tables.table(spark, folder, "lineitem")
    return rows.select((F.col("l_orderkey") % 1000).alias("x"), (F.col("l_partkey") % 1000).alias("y"), F.col("l_quantity").alias("value"), F.col("l_suppkey").alias("key"), kind.alias("kind"))


def grid_resample(spark, folder):
    return _rounded(grid.resample(_points(spark, folder), "value", 50))


def grid_align(spark, folder):
    rows = _points(spark, folder)
    one = grid.resample(rows.where("kind = 1"), "value", 20).select("cx", "cy", F.col("value").alias("first"))
    two = grid.resample(rows.where("kind = 3 AND value > 40"), "value", 20).select("cx", "cy", F.col("value").alias("second"))
    return _rounded(grid.align(one, two))


def clip_counts(spark, folder):
    nation, region, customer = (tables.table(spark, folder, t) for t in ("nation", "region", "customer"))
    inside = nation.join(region.where("r_regionkey < 2"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"))
    return grid.clip(customer, inside, "c_nationkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def background_fill(spark, folder):
    rows = _points(spark, folder).withColumn("cx", grid.cell("x", 100)).withColumn("cy", grid.cell("y", 100))
    cells = rows.where("kind = 1 AND value > 45").groupBy("cx", "cy").agg(F.max("kind").alias("kind"))
    return grid.fill(cells, rows, "kind")


def focal_mode(spark, folder):
    """The class of a cell's smallest key; cells with few points are unsure."""
    rows = _points(spark, folder).groupBy(grid.cell("x", 50).alias("cx"), grid.cell("y", 50).alias("cy")).agg(F.min_by("kind", F.struct("key", "kind")).alias("kind"), F.count("*").alias("n"))
    return grid.smooth(rows, "kind", F.col("n") % 2 == 0)


def _kind_cells(spark, folder):
    """Cells of 50 units with the class of their smallest key; not all are there."""
    rows = _points(spark, folder).groupBy(grid.cell("x", 50).alias("cx"), grid.cell("y", 50).alias("cy")).agg(F.min_by("kind", F.struct("key", "kind")).alias("kind"))
    return rows.where("(cx * 7 + cy * 3) % 11 > 0")


#: Cells along a tile's side in the query, so that its regions span tiles.
_QUERY_TILE = 8


def above_line(spark, folder):
    customer = tables.table(spark, folder, "customer")
    line = customer.where("c_nationkey > 2").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("most")).select("c_nationkey", (F.col("most") / 2).alias("line"))
    return grid.above_line(customer, line, "c_nationkey", "c_acctbal", "line").groupBy("side").agg(F.count("*").alias("n"))


def _shapes(spark, folder):
    """A pentagon with a notch for each supplier, some with a hole."""
    corner = lambda x, y: f"struct(CAST(x0 + {x} AS DOUBLE) AS x, CAST(y0 + {y} AS DOUBLE) AS y)"
    ring = lambda points: f"array({', '.join(corner(*p) for p in points)})"
    rows = tables.table(spark, folder, "supplier").selectExpr("s_suppkey AS zone", *(f"{e} AS {c}" for c, e in _SHAPE.items()))
    return rows.selectExpr("zone", f"CASE WHEN zone % 3 = 0 THEN array({ring(_OUTLINE)}, {ring(_HOLE)}) ELSE array({ring(_OUTLINE)}) END AS rings")


#: Corner and size of a supplier's shape, its points as steps from the corner, and points drawn.
_SHAPE = {"x0": "s_suppkey * 37 % 900", "y0": "s_suppkey * 61 % 900", "w": "20 + s_suppkey % 50", "h": "20 + s_suppkey % 40"}
_OUTLINE = (("0", "0"), ("w", "0"), ("w", "h"), ("floor(w / 2)", "floor(h / 3)"), ("0", "h"))
_HOLE = (("floor(w / 4)", "2"), ("floor(w / 2)", "2"), ("floor(w / 4)", "5"))
_DRAWN = 2000


def polygon_points(spark, folder):
    return _rounded(polygons.draw_points(_shapes(spark, folder), _DRAWN))


def zone_areas(spark, folder):
    """Areas that suppliers' L-shapes share with the fields of a 5 by 5 grid, added up by both."""
    point = lambda x, y: f"struct(CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y)"
    corners = (("x0", "y0"), ("x0 + w", "y0"), ("x0 + w", "y0 + floor(h / 2)"), ("x0 + floor(w / 2)", "y0 + floor(h / 2)"), ("x0 + floor(w / 2)", "y0 + h"), ("x0", "y0 + h"))
    towns = tables.table(spark, folder, "supplier").selectExpr("s_suppkey", *(f"{e} AS {c}" for c, e in _SHAPE.items()))
    towns = towns.selectExpr("s_suppkey % 20 AS town", "s_suppkey AS a", f"array(array({', '.join(point(*c) for c in corners)})) AS rings")
    field = (("x", "y"), ("x", "y + 200"), ("x + 200", "y + 200"), ("x + 200", "y"))
    fields = tables.table(spark, folder, "nation").selectExpr("n_nationkey AS b", "n_nationkey % 5 * 200 AS x", "floor(n_nationkey / 5) * 200 AS y").selectExpr("b", f"array(array({', '.join(point(*c) for c in field)})) AS rings")
    found = polygons.overlay_areas(towns, fields, 100.0).join(towns.select("a", "town"), "a")
    return _rounded(prep.area_rollup(found.withColumnRenamed("b", "field"), "town", "field", "area"))


def _customers(spark, folder):
    """Customers as points of zone 32."""
    return tables.table(spark, folder, "customer").selectExpr("c_custkey AS id", "CAST(250000 + c_custkey * 7919 % 300000 AS DOUBLE) AS x", "CAST(6400000 + c_custkey * 104729 % 900000 AS DOUBLE) AS y", "c_nationkey < 5 AS present")


def reprojection(spark, folder):
    rows = projection.reprojected(_customers(spark, folder), 25832, 25833)
    return rows.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def presence_tiles(spark, folder):
    """Points of one kind by 10 km tile of another coordinate system; tiles with none of it have 0."""
    rows = projection.tiled(projection.reprojected(_customers(spark, folder), 25832, 32633))
    return rows.groupBy("tile_x", "tile_y").agg(F.count_if("present").alias("n"))


#: Pixels along a side of a raster's tile in the queries, and units of a pixel.
_RASTER_TILE, _PIXEL = 16, 10


def _raster(spark, folder):
    rows = _points(spark, folder).where("kind = 2")
    pixels = rows.groupBy(grid.cell("x", _PIXEL).alias("px"), grid.cell("y", _PIXEL).alias("py")).agg(F.sum(F.col("value").cast("long")).alias("value"))
    return rasters.to_tiles(pixels, _RASTER_TILE)


def _places(spark, folder):
    return tables.table(spark, folder, "customer").selectExpr("c_custkey AS id", "c_custkey * 7919 % 10000 / 10D AS x", "c_custkey * 104729 % 10007 / 10D AS y")


def nearest_pixel(spark, folder):
    return rasters.nearest_values(_places(spark, folder), _raster(spark, folder), _RASTER_TILE, _PIXEL).select("id", "value")


def bilinear_pixels(spark, folder):
    return _rounded(rasters.bilinear_values(_places(spark, folder), _raster(spark, folder), _RASTER_TILE, _PIXEL).select("id", "value"))


#: Units of a tile's side in the query of tiled prediction, and its tiles between two entries of the manifest.
_PREDICTED_TILE, _PREDICTED_BATCH = 25, 6


def tile_predictions(spark, folder):
    """Classes of test rows that lie on a plane, tile by tile, in a run that is ended after its first batch and a second one that goes on."""
    rows = tables.samples(spark, folder)
    codes_found, centroids = models.encoded_centroids(rows)
    place = f"{tables.shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    test = rows.where("split = 'test'").selectExpr("sample_id", "features", "sample_id * 37 % 100 AS x", "sample_id * 61 % 100 AS y")
    grid.write_tiles(test, f"{place}/in", _PREDICTED_TILE)

    def predict(tiles):
        return tiles.withColumn("p", centroids.probabilities(F.col("features"))).select("sample_id", "tile", models.predicted(F.col("p")).alias("pred"))

    for most in (1, None):
        rasters.predict_tiles(spark, f"{place}/in", f"{place}/out", predict, _PREDICTED_BATCH, most)
    return rasters.predicted_tiles(spark, f"{place}/out")


def _model_metrics(name, **options):
    def run(spark, folder):
        pred = _predictions(spark, folder, name, **options)
        return _rounded(metrics.quality(pred).withColumn("model", F.lit(name)))

    return run


#: The query of histogram boosting: one round on given edges, which SQL can follow.
_EDGES, _ONE_ROUND = (-0.2, -0.1, 0.0, 0.1, 0.2), boosting.Growth(depth=2)
#: Classes of the query over output codes.
_MANY = 22


def _boosted(how, edges=None, rounds=1):
    def run(spark, folder):
        rows, k = encoded(spark, folder)
        model = boosting.fit(rows.where("split = 'train'"), k, rounds, how, [edges] * 64 if edges else None)
        scored = rows.where("split <> 'train'").withColumn("p", model.probabilities(F.col("features")))
        return _rounded(_long(scored, "p", "p"))

    return run


def output_code_probs(spark, folder):
    """The centroid model over output codes, for classes made from labels and ids."""
    rows = tables.samples(spark, folder).withColumn("class_idx", F.expr(f"CAST((code * 3 + sample_id DIV 10) % {_MANY} AS INT)"))
    return _rounded(_long(models.coded_centroids(rows.where("split = 'train'"), rows.where("split <> 'train'"), _MANY, None), "p", "p"))


QUERIES = {
    "load_clean": load_clean,
    "split_sizes": lambda s, d: prep.split_sizes(tables.samples(s, d)),
    "label_encode": lambda s, d: prep.encode_labels(tables.samples(s, d)),
    "class_distribution": lambda s, d: prep.class_distribution(encoded(s, d)[0].where("split = 'train'"), "class_idx"),
    "subsample_exact": subsample_exact,
    "stratified_sample": stratified_sample,
    "grid_resample": grid_resample,
    "grid_align": grid_align,
    "clip_counts": clip_counts,
    "background_fill": background_fill,
    "focal_mode": focal_mode,
    "above_line": above_line,
    "region_components": lambda s, d: regions.regions(_kind_cells(s, d), _QUERY_TILE),
    "region_outlines": lambda s, d: regions.outlines(regions.regions(_kind_cells(s, d), _QUERY_TILE)),
    "polygon_points": polygon_points,
    "zone_areas": zone_areas,
    "reprojection": reprojection,
    "presence_tiles": presence_tiles,
    "tile_predictions": tile_predictions,
    "nearest_pixel": nearest_pixel,
    "bilinear_pixels": bilinear_pixels,
    "dummy_predict": dummy_predict,
    "centroid_probs": lambda s, d: _rounded(_long(probs(s, d), "p", "p")),
    "class_ranks": lambda s, d: _long(_ranked(s, d), "ranks", "rank"),
    "sorted_cumsum": sorted_cumsum,
    "saps_scores": _scores("SAPS", 0.2, None),
    "aps_scores": _scores("APS", 0.0, 1),
    "raps_scores": _scores("RAPS", 0.01, 1),
    "conformal_tau": conformal_tau,
    "prediction_sets": prediction_sets,
    "saps_sweep": lambda s, d: _rounded(conformal.saps_sweep(_ranked(s, d))),
    "aps_metrics": _metrics_of("APS", 0.0, 1),
    "raps_metrics": _metrics_of("RAPS", 0.01, 1),
    "rank_threshold": rank_threshold,
    "rank_metrics": lambda s, d: _rounded(conformal.set_metrics(conformal.rank_sets(_ranked(s, d), conformal.ALPHAS), ["alpha", "r_star"])),
    "compare_methods": lambda s, d: _rounded(conformal.compare_methods(_ranked(s, d))),
    "confusion_matrix": lambda s, d: metrics.confusion(_predictions(s, d)),
    "macro_f1": lambda s, d: _rounded(metrics.macro_f1(_predictions(s, d))),
    "balanced_accuracy": lambda s, d: _rounded(metrics.balanced_accuracy(_predictions(s, d))),
    "set_size_hist": set_size_hist,
    "zonal_stats": zonal_stats,
    "zonal_merged": zonal_merged,
    "label_fallback": label_fallback,
    "area_rollup": area_rollup,
    "logreg_metrics": _model_metrics("linear"),
    "rf_metrics": _model_metrics("rf", n_estimators=500),
    "knn_metrics": _model_metrics("knn"),
    "gbt_metrics": _model_metrics("gbt", n_estimators=3),
    "hist_boost_probs": _boosted(_ONE_ROUND, _EDGES),
    "leaf_boost_probs": _boosted(replace(boosting.LEAF_WISE, leaves=8), rounds=1),
    "symmetric_boost_probs": _boosted(replace(boosting.SYMMETRIC, depth=4), rounds=2),
    "output_code_probs": output_code_probs,
}

# SQL, from common table expressions that build on each other.
_SAMPLES = """samples AS (
  SELECT vec_id AS sample_id, CASE WHEN vec_id % 10 < 6 THEN 'train' WHEN vec_id % 10 < 8 THEN 'cal' ELSE 'test' END AS split,
         embedding AS features, label AS code, CAST((vec_id * 2654435761) % 4294967296 AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS u
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
), classes AS (
  SELECT code, CAST(row_number() OVER (ORDER BY code) - 1 AS INTEGER) AS class_idx FROM (SELECT DISTINCT code FROM samples)
)"""
_PROBS = f"""{_SAMPLES}, dims AS (
  SELECT sample_id, split, class_idx AS y, u, CAST(unnest(features) AS DOUBLE) AS x, generate_subscripts(features, 1) AS d
  FROM samples JOIN classes USING (code)
), centroids AS (
  SELECT y AS class_idx, d, avg(x) AS c FROM dims WHERE split = 'train' GROUP BY y, d
), minus AS (
  SELECT sample_id, split, y, u, class_idx, -10.0 * sum((x - c) * (x - c)) AS z
  FROM dims JOIN centroids USING (d) WHERE split <> 'train' GROUP BY sample_id, split, y, u, class_idx
), powers AS (
  SELECT sample_id, split, y, u, class_idx, exp(z - max(z) OVER (PARTITION BY sample_id)) AS e FROM minus
), known AS (
  SELECT sample_id, split, y, u, class_idx, round(e / sum(e) OVER (PARTITION BY sample_id), 9) AS p FROM powers
), probs AS (
  SELECT s.sample_id, s.split, s.y, s.u, c.class_idx, coalesce(k.p, 0.0) AS p
  FROM (SELECT DISTINCT sample_id, split, y, u FROM known) s CROSS JOIN classes c LEFT JOIN known k ON k.sample_id = s.sample_id AND k.class_idx = c.class_idx
)"""
_RANKED = f"""{_PROBS}, ranked AS (
  SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, coalesce(sum(p) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
         max(p) OVER (PARTITION BY sample_id) AS top
  FROM probs WINDOW w AS (PARTITION BY sample_id ORDER BY p DESC, class_idx)
)"""
_SCORE = {
    "SAPS": "CASE WHEN rank = 1 THEN top * u ELSE top + (rank - 2 + u) * lam END",
    "APS": "before + u * p",
    "RAPS": "before + u * p + greatest(lam, 0) * greatest(0, rank - k_reg)",
}
_ALPHAS = "(VALUES (CAST(0.05 AS DOUBLE)), (CAST(0.1 AS DOUBLE)), (CAST(0.2 AS DOUBLE))) a(alpha)"


def _cells(cells: tuple) -> str:
    values = ", ".join(f"('{m}', CAST({lam} AS DOUBLE), {k or 'CAST(NULL AS INTEGER)'})" for m, lam, k in cells)
    score = " ".join(f"WHEN method = '{m}' THEN {x}" for m, x in _SCORE.items())
    return f"""{_RANKED}, cells(method, lam, k_reg) AS (VALUES {values}), scored AS (
  SELECT method, lam, k_reg, sample_id, split, y, class_idx, CASE {score} END AS score FROM ranked CROSS JOIN cells
), cal AS (
  SELECT method, lam, score, row_number() OVER (PARTITION BY method, lam ORDER BY score) AS m, count(*) OVER (PARTITION BY method, lam) AS n
  FROM scored WHERE split = 'cal' AND class_idx = y
), tau AS (
  SELECT method, lam, alpha, score AS tau FROM cal CROSS JOIN {_ALPHAS} WHERE m = least(ceil((n + 1) * (1 - alpha)) + 1, n)
), sets AS (
  SELECT method, lam, k_reg, alpha, tau, sample_id, sum(CAST(score <= tau AS INTEGER)) AS size, max(CAST(score <= tau AND class_idx = y AS INTEGER)) AS covered
  FROM scored JOIN tau USING (method, lam) WHERE split = 'test' GROUP BY method, lam, k_reg, alpha, tau, sample_id
)"""


_STATS = """round(avg(covered), 6) AS coverage, round(avg(size), 6) AS avg_set_size, round(median(CAST(size AS DOUBLE)), 6) AS median_set_size,
  CAST(max(size) AS INTEGER) AS max_set_size, round(avg(CAST(size = 1 AS INTEGER)), 6) AS pct_singleton, round(avg(CAST(size = 0 AS INTEGER)), 6) AS pct_empty"""
_RANK = f"""{_RANKED}, counts AS (
  SELECT rank AS r, count(*) AS c FROM ranked WHERE split = 'cal' AND class_idx = y GROUP BY rank
), placed AS (
  SELECT r, c, CAST(sum(c) OVER (ORDER BY r) - c AS BIGINT) AS below, CAST(sum(c) OVER (ORDER BY r DESC) AS BIGINT) AS from_top, CAST(sum(c) OVER () AS BIGINT) AS n FROM counts
), floors AS (
  SELECT *, CAST(floor((n + 1) * alpha) AS BIGINT) AS fl FROM placed CROSS JOIN {_ALPHAS}
), stages AS (
  SELECT alpha, n, r AS r_star, below, c AS n_at, CAST(ceil(n * greatest(0.0, least(1.0, CAST(n - fl - below AS DOUBLE) / c))) AS BIGINT) AS k_pick
  FROM floors WHERE greatest(1, least(fl, n)) <= from_top AND greatest(1, least(fl, n)) > from_top - c
), at_r AS (
  SELECT alpha, p, row_number() OVER (PARTITION BY alpha ORDER BY p DESC) AS k FROM ranked JOIN stages ON rank = r_star WHERE split = 'cal'
), stars AS (
  SELECT s.*, CASE WHEN k_pick <= 0 THEN CAST('inf' AS DOUBLE) WHEN k_pick > n THEN CAST('-inf' AS DOUBLE) ELSE a.p END AS pi_star
  FROM stages s LEFT JOIN at_r a ON a.alpha = s.alpha AND a.k = s.k_pick
), sizes AS (
  SELECT alpha, r_star, sample_id, CASE WHEN p >= pi_star THEN r_star ELSE r_star - 1 END AS size FROM ranked JOIN stars ON rank = r_star WHERE split = 'test'
), rank_sets AS (
  SELECT z.alpha, z.r_star, z.sample_id, z.size, CAST(r.rank <= z.size AS INTEGER) AS covered FROM sizes z JOIN ranked r ON r.sample_id = z.sample_id AND r.class_idx = r.y
)"""
_PRED = f"""{_RANKED}, pred AS (SELECT y, class_idx AS pred FROM ranked WHERE split = 'test' AND rank = 1), confusion AS (
  SELECT y, pred, count(*) AS n FROM pred GROUP BY y, pred
)"""
#: The driver's embeddings have ten classes.
_MERGED = ", ".join(f"round({f} FILTER (WHERE class_idx = {k}), 6) AS {name}_{k}" for k in range(10) for name, f in zip(_ZONAL, ("median(p)", "max(p)", "stddev_pop(p)", "avg(CAST(p > 0.1 AS INTEGER))"), strict=True))
_NEIGHBOURS = f"""{_SAMPLES}, support AS (
  SELECT sample_id, code, features, row_number() OVER (ORDER BY md5(CAST(sample_id AS VARCHAR))) AS place FROM samples WHERE split = 'train' QUALIFY place <= {models.SUPPORT}
), a AS (SELECT sample_id, generate_subscripts(features, 1) AS d, CAST(unnest(features) AS DOUBLE) AS x FROM samples WHERE split = 'test'), b AS (
  SELECT place, class_idx, generate_subscripts(features, 1) AS d, CAST(unnest(features) AS DOUBLE) AS x FROM support JOIN classes USING (code)
), near AS (
  SELECT sample_id, class_idx FROM (SELECT sample_id, place, class_idx, sum((a.x - b.x) * (a.x - b.x)) AS s FROM a JOIN b USING (d) GROUP BY sample_id, place, class_idx)
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY s, place) <= {models.NEIGHBOURS}
), votes AS (SELECT sample_id, class_idx, count(*) AS v FROM near GROUP BY sample_id, class_idx), confusion AS (
  SELECT c.class_idx AS y, w.class_idx AS pred, count(*) AS n
  FROM (SELECT sample_id, class_idx FROM votes QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY v DESC, class_idx) = 1) w JOIN samples USING (sample_id) JOIN classes c USING (code) GROUP BY c.class_idx, w.class_idx
), both_sides AS (
  SELECT y AS k, n AS truth, 0 AS told, CASE WHEN y = pred THEN n ELSE 0 END AS hit FROM confusion UNION ALL SELECT pred, 0, n, 0 FROM confusion
), by_class AS (SELECT 2.0 * CAST(sum(hit) AS DOUBLE) / CAST(sum(truth + told) AS DOUBLE) AS f1, CAST(sum(hit) AS DOUBLE) / nullif(CAST(sum(truth) AS DOUBLE), 0) AS recall FROM both_sides GROUP BY k)"""
_LONG = "SELECT sample_id, class_idx, round({score}, 6) AS score FROM (SELECT *, CAST({lam} AS DOUBLE) AS lam, 1 AS k_reg FROM ranked)"
_SWEEP = tuple(("SAPS", lam, None) for lam in conformal.SAPS_LAMS)

_POINTS = """points AS (
  SELECT l_orderkey % 1000 AS x, l_partkey % 1000 AS y, l_quantity AS value, l_suppkey AS key, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS kind FROM lineitem
)"""
_CELL = "CAST(floor(x / {0}.0) AS BIGINT) AS cx, CAST(floor(y / {0}.0) AS BIGINT) AS cy"

_DIMS = f"""{_SAMPLES}, dims AS (
  SELECT sample_id, split, class_idx AS y, CAST(unnest(features) AS DOUBLE) AS x, generate_subscripts(features, 1) - 1 AS d FROM samples JOIN classes USING (code)
)"""


def _level(n: int, nodes: str) -> str:
    """Sums of a level's nodes(sample_id, cls, node), their prefix sums, and each node's best split."""
    won = "({0}) * ({0}) / (({1}) + 1.0)"
    g, h, lg, lh = (f"{c} / 67108864.0::DOUBLE" for c in ("g", "h", "lg", "lh"))
    gained = f"{won.format(lg, lh)} + {won.format(f'{g} - {lg}', f'{h} - {lh}')} - {won.format(g, h)}"
    return f"""sums{n} AS MATERIALIZED (
  SELECT cls, node, d, bin, CAST(sum(g) AS BIGINT) AS g, CAST(sum(h) AS BIGINT) AS h FROM {nodes} JOIN grads USING (sample_id, cls) JOIN bins USING (sample_id) GROUP BY cls, node, d, bin
), upto{n} AS (
  SELECT cls, node, d, bin, CAST(sum(g) OVER w AS BIGINT) AS lg, CAST(sum(h) OVER w AS BIGINT) AS lh, CAST(sum(g) OVER (PARTITION BY cls, node, d) AS BIGINT) AS g, CAST(sum(h) OVER (PARTITION BY cls, node, d) AS BIGINT) AS h
  FROM sums{n} WINDOW w AS (PARTITION BY cls, node, d ORDER BY bin)
), best{n} AS MATERIALIZED (
  SELECT * FROM (SELECT *, {gained} AS won FROM upto{n} WHERE {lh} >= 1 AND {h} - {lh} >= 1) WHERE won > 1e-6
  QUALIFY row_number() OVER (PARTITION BY cls, node ORDER BY won DESC, d, bin) = 1
), totals{n} AS (SELECT DISTINCT cls, node, g, h FROM upto{n})"""


_BOOST = f"""{_DIMS}, bins AS MATERIALIZED (
  SELECT sample_id, split, d, {" + ".join(f"CAST(x > CAST({e} AS DOUBLE) AS INTEGER)" for e in _EDGES)} AS bin FROM dims
), k AS (SELECT CAST(1 AS DOUBLE) / count(*) AS p FROM classes), grads AS MATERIALIZED (
  SELECT sample_id, class_idx AS cls, CAST(round((p - CAST(y = class_idx AS INTEGER)) * 67108864) AS BIGINT) AS g, CAST(round(2 * p * (1 - p) * 67108864) AS BIGINT) AS h
  FROM (SELECT DISTINCT sample_id, y FROM dims WHERE split = 'train') CROSS JOIN classes CROSS JOIN k
), nodes0 AS (SELECT sample_id, class_idx AS cls, 0 AS node FROM samples CROSS JOIN classes), {_level(0, "nodes0")}, nodes1 AS MATERIALIZED (
  SELECT n.sample_id, n.cls, CASE WHEN b.d IS NULL THEN 0 WHEN x.bin <= b.bin THEN 1 ELSE 2 END AS node
  FROM nodes0 n LEFT JOIN best0 b USING (cls) LEFT JOIN bins x ON x.sample_id = n.sample_id AND x.d = b.d
), {_level(1, "nodes1")}, leaves AS (
  SELECT n.sample_id, n.cls, CASE WHEN n.node = 0 OR b.d IS NULL THEN t.g WHEN x.bin <= b.bin THEN b.lg ELSE b.g - b.lg END AS g,
    CASE WHEN n.node = 0 OR b.d IS NULL THEN t.h WHEN x.bin <= b.bin THEN b.lh ELSE b.h - b.lh END AS h
  FROM nodes1 n LEFT JOIN totals1 t USING (cls, node) LEFT JOIN best1 b USING (cls, node) LEFT JOIN bins x ON x.sample_id = n.sample_id AND x.d = b.d
), margins AS (SELECT sample_id, cls, coalesce(-0.3 * (g / 67108864.0::DOUBLE) / (h / 67108864.0::DOUBLE + 1), 0) AS m FROM leaves)"""
_CODED = f"""{_SAMPLES}, many AS (SELECT sample_id, split, (code * 3 + sample_id // 10) % {_MANY} AS y, features FROM samples), dims AS (
  SELECT sample_id, split, y, CAST(unnest(features) AS DOUBLE) AS x, generate_subscripts(features, 1) AS d FROM many
), book(k, j, s) AS (VALUES {", ".join(f"({k}, {j}, {s})" for k, w in enumerate(codes.code_book(_MANY)) for j, s in enumerate(w))}), centroids AS (
  SELECT j, s, d, avg(x) AS c FROM dims JOIN book ON k = y WHERE split = 'train' GROUP BY j, s, d
), minus AS (
  SELECT sample_id, j, s, -10.0 * sum((x - c) * (x - c)) AS z FROM dims JOIN centroids USING (d) WHERE split <> 'train' GROUP BY sample_id, j, s
), powers AS (SELECT sample_id, j, s, exp(z - max(z) OVER (PARTITION BY sample_id, j)) AS e FROM minus), signs AS (
  SELECT sample_id, j, s, e / sum(e) OVER (PARTITION BY sample_id, j) AS p FROM powers
), logs AS (SELECT sample_id, k AS class_idx, sum(ln(greatest(p, 1e-9))) AS z FROM signs JOIN book USING (j, s) GROUP BY sample_id, k)"""

_REGIONS = f"""{_POINTS}, cells AS MATERIALIZED (
  SELECT * FROM (SELECT {_CELL.format(50)}, CAST(arg_min(kind, key * 10 + kind) AS BIGINT) AS kind FROM points GROUP BY cx, cy) WHERE (cx * 7 + cy * 3) % 11 > 0
), reach(x0, y0, cx, cy, kind) AS (
  SELECT cx, cy, cx, cy, kind FROM cells
  UNION SELECT r.x0, r.y0, c.cx, c.cy, c.kind FROM reach r JOIN cells c ON c.kind = r.kind AND abs(c.cx - r.cx) + abs(c.cy - r.cy) = 1
), regions AS MATERIALIZED (
  SELECT cx, cy, kind, min(x0 * 1000 + y0) // 1000 AS region_x, min(x0 * 1000 + y0) % 1000 AS region_y FROM reach GROUP BY cx, cy, kind
)"""
_OUTLINES = f"""{_REGIONS}, sides AS MATERIALIZED (
  SELECT region_x AS rx, region_y AS ry, cx + i AS x, cy + j AS y, way, cx + i2 AS x2, cy + j2 AS y2 FROM regions r
  CROSS JOIN (VALUES (0, 0, 0, 1, 0, 0, -1), (1, 0, 1, 1, 1, 1, 0), (1, 1, 2, 0, 1, 0, 1), (0, 1, 3, 0, 0, -1, 0)) s(i, j, way, i2, j2, nx, ny)
  WHERE NOT EXISTS (SELECT 1 FROM regions o WHERE o.cx = r.cx + nx AND o.cy = r.cy + ny AND o.region_x = r.region_x AND o.region_y = r.region_y)
), numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY rx, ry, x, y, way) AS e FROM sides), linked AS MATERIALIZED (
  SELECT a.e, a.way <> b.way AS corner, b.e AS nxt FROM numbered a JOIN numbered b ON a.rx = b.rx AND a.ry = b.ry AND a.x2 = b.x AND a.y2 = b.y
  QUALIFY count(*) OVER (PARTITION BY a.e) = 1 OR b.way = (a.way + 1) % 4
), walk(first, e, step) AS (
  SELECT e, e, 0 FROM numbered UNION ALL SELECT w.first, l.nxt, w.step + 1 FROM walk w JOIN linked l ON w.e = l.e WHERE l.nxt <> w.first
), rings AS (SELECT first, count(*) AS n FROM walk GROUP BY first HAVING min(e) = first), areas AS (
  SELECT first, n, sum(x * y2 - x2 * y) AS area FROM rings JOIN walk USING (first) JOIN numbered USING (e) GROUP BY first, n
)"""

_SQL_SHAPE = ", ".join(f"{e} AS {c}" for c, e in _SHAPE.items())


def _sql_edges() -> str:
    out = []
    for k, ring in enumerate((_OUTLINE, _HOLE)):
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            point = [f"CAST({c} + {e} AS DOUBLE)" for c, e in (("x0", x1), ("y0", y1), ("x0", x2), ("y0", y2))]
            out.append(f"SELECT zone, {k} AS ring, {point[0]} AS x1, {point[1]} AS y1, {point[2]} AS x2, {point[3]} AS y2 FROM shapes" + " WHERE zone % 3 = 0" * k)
    return " UNION ALL ".join(out)


_DRAWS = f"""shapes AS (SELECT s_suppkey AS zone, {_SQL_SHAPE} FROM supplier), edges AS MATERIALIZED ({_sql_edges()}), areas AS (
  SELECT zone, sum(CASE WHEN ring = 0 THEN a ELSE -a END) AS area FROM (SELECT zone, ring, abs(sum(x1 * y2 - x2 * y1) / 2) AS a FROM edges GROUP BY zone, ring) GROUP BY zone
), quotas AS (
  SELECT zone, area, CAST(floor(upto * {_DRAWN} / total) - floor((upto - area) * {_DRAWN} / total) AS BIGINT) AS quota
  FROM (SELECT zone, area, sum(area) OVER (ORDER BY zone) AS upto, sum(area) OVER () AS total FROM areas)
), boxes AS (
  SELECT zone, min(x1) AS l, min(y1) AS low, greatest(max(x1) - min(x1), max(y1) - min(y1)) / 16 AS side FROM edges GROUP BY zone
), banded AS (
  SELECT zone, l, low, side, b, x1, y1, x2, y2, low + b * side AS bottom, low + (b + 1) * side AS top FROM boxes JOIN edges USING (zone) CROSS JOIN range(16) r(b)
), ends AS (
  SELECT zone, l, low, side, b, CASE WHEN y1 = y2 THEN x1 ELSE x1 + (x2 - x1) * (greatest(least(y, top), bottom) - y1) / (y2 - y1) END AS x
  FROM (SELECT *, unnest([y1, y2]) AS y FROM banded WHERE least(y1, y2) <= top AND greatest(y1, y2) >= bottom)
  UNION ALL SELECT zone, l, low, side, b, unnest([x1, x2]) FROM banded WHERE y1 = y2 AND y1 <= top AND y1 >= bottom
), bands AS (
  SELECT zone, l, low, side, b, floor((min(x) - l) / side) AS first, least(floor((max(x) - l) / side), 15) - floor((min(x) - l) / side) + 1 AS n FROM ends GROUP BY zone, l, low, side, b
), cover AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY zone ORDER BY b) - n AS upto, sum(n) OVER (PARTITION BY zone) AS total FROM bands), digests AS (
  SELECT zone, quota, j, md5('0:' || zone || ':' || j) AS h FROM (SELECT zone, quota, unnest(range(40 * quota + 200)) AS j FROM quotas WHERE quota > 0)
), drawn AS (
  SELECT zone, quota, j, CAST('0x' || substr(h, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS t, CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u, CAST('0x' || substr(h, 17, 8) AS BIGINT) / 4294967296.0::DOUBLE AS v FROM digests
), placed AS MATERIALIZED (
  SELECT zone, quota, j, l + (first + floor(t * total) - upto + u) * side AS x, low + (b + v) * side AS y
  FROM drawn JOIN cover USING (zone) WHERE floor(t * total) >= upto AND floor(t * total) < upto + n
), kept AS (
  SELECT zone, quota, j, x, y FROM placed JOIN edges USING (zone)
  GROUP BY zone, quota, j, x, y HAVING count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x > (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1
)"""


def _sql_series(grid, forward: bool, x: str, y: str) -> tuple[str, str]:
    rows = grid.alpha if forward else grid.beta
    sign = "+" if forward else "-"
    return tuple(f"({first} {sign} ({' + '.join(f'{c!r}::DOUBLE * {f}(2 * {j} * {x}) * {g}(2 * {j} * {y})' for j, c in enumerate(rows, 1))}))" for first, f, g in ((x, "sin", "cosh"), (y, "cos", "sinh")))


def _sql_reprojected(source: int, target: int) -> str:
    """customers(id, x, y, present) in the other system, step by step."""
    a, b = projection.SYSTEMS[source], projection.SYSTEMS[target]
    xi, eta = _sql_series(a, False, "p", "q")
    xi2, eta2 = _sql_series(b, True, "xi", "eta")
    lat = " + ".join(f"{d!r}::DOUBLE * sin(2 * {j} * chi)" for j, d in enumerate(a.delta, 1))
    return f"""customers AS (SELECT c_custkey AS id, 250000 + c_custkey * 7919 % 300000 AS x, 6400000 + c_custkey * 104729 % 900000 AS y, c_nationkey < 5 AS present FROM customer
), s1 AS (SELECT id, present, y / {a.radius!r}::DOUBLE AS p, (x - {a.east!r}::DOUBLE) / {a.radius!r}::DOUBLE AS q FROM customers
), s2 AS (SELECT id, present, {xi} AS xi, {eta} AS eta FROM s1
), s3 AS (SELECT id, present, asin(sin(xi) / cosh(eta)) AS chi, {a.lon0!r}::DOUBLE + degrees(atan2(sinh(eta), cos(xi))) AS lon FROM s2
), s4 AS (SELECT id, present, lon, sin(chi + {lat}) AS s, radians(lon - {b.lon0!r}::DOUBLE) AS turn FROM s3
), s5 AS (SELECT id, present, turn, sinh(atanh(s) - {b.e!r}::DOUBLE * atanh({b.e!r}::DOUBLE * s)) AS t FROM s4
), s6 AS (SELECT id, present, atan2(t, cos(turn)) AS xi, atanh(sin(turn) / sqrt(1 + t * t)) AS eta FROM s5
), s7 AS (SELECT id, present, {b.east!r}::DOUBLE + {b.radius!r}::DOUBLE * {eta2} AS x, {b.radius!r}::DOUBLE * {xi2} AS y FROM s6)"""


_SHARED = "greatest(0, least({1}, f.x + 200) - greatest({0}, f.x)) * greatest(0, least({3}, f.y + 200) - greatest({2}, f.y))"

_PIXELS = f"""{_POINTS}, pixels AS MATERIALIZED (
  SELECT CAST(floor(x / {_PIXEL}.0) AS BIGINT) AS px, CAST(floor(y / {_PIXEL}.0) AS BIGINT) AS py, CAST(sum(CAST(value AS BIGINT)) AS DOUBLE) AS value FROM points WHERE kind = 2 GROUP BY px, py
), places AS (SELECT c_custkey AS id, CAST(c_custkey * 7919 % 10000 AS DOUBLE) / 10 AS x, CAST(c_custkey * 104729 % 10007 AS DOUBLE) / 10 AS y FROM customer)"""

SQL = {
    "tile_predictions": f"""WITH {_RANKED} SELECT sample_id, (sample_id * 37 % 100 // {_PREDICTED_TILE}) || '_' || (sample_id * 61 % 100 // {_PREDICTED_TILE}) AS tile, class_idx AS pred
FROM ranked WHERE split = 'test' AND rank = 1""",
    "knn_metrics": f"WITH {_NEIGHBOURS} SELECT round(avg(f1), 6) AS f1_macro, round(avg(recall), 6) AS balanced_accuracy, 'knn' AS model FROM by_class",
    "nearest_pixel": f"WITH {_PIXELS} SELECT id, value FROM places LEFT JOIN pixels ON px = floor(x / {_PIXEL}) AND py = floor(y / {_PIXEL})",
    "bilinear_pixels": f"""WITH {_PIXELS}, near AS (
  SELECT id, floor(fx) + i AS px, floor(fy) + j AS py, CASE i WHEN 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END * CASE j WHEN 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END AS weight
  FROM (SELECT id, x / {_PIXEL} - 0.5 AS fx, y / {_PIXEL} - 0.5 AS fy FROM places) CROSS JOIN (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) c(i, j)
) SELECT id, CASE WHEN count(*) = count(value) THEN round(sum(weight * value), 6) END AS value FROM near n LEFT JOIN pixels p ON n.px = p.px AND n.py = p.py WHERE weight > 0 GROUP BY id""",
    "polygon_points": f"WITH {_DRAWS} SELECT zone, j AS draw, round(x, 6) AS x, round(y, 6) AS y FROM kept QUALIFY row_number() OVER (PARTITION BY zone ORDER BY j) <= quota",
    "zone_areas": f"""WITH towns AS (SELECT s_suppkey % 20 AS town, {_SQL_SHAPE} FROM supplier), fields AS (SELECT n_nationkey AS field, n_nationkey % 5 * 200 AS x, n_nationkey // 5 * 200 AS y FROM nation), both_areas AS (
  SELECT town, field, {_SHARED.format("x0", "x0 + w", "y0", "y0 + h")} - {_SHARED.format("x0 + w // 2", "x0 + w", "y0 + h // 2", "y0 + h")} AS area FROM towns CROSS JOIN fields f)
SELECT town, field, CAST(sum(area) AS DOUBLE) AS area FROM both_areas WHERE area > 0 GROUP BY ROLLUP (town, field)""",
    "reprojection": f"WITH {_sql_reprojected(25832, 25833)} SELECT id, round(x, 3) AS x, round(y, 3) AS y FROM s7",
    "presence_tiles": f"WITH {_sql_reprojected(25832, 32633)} SELECT CAST(floor(x / 10000) AS BIGINT) AS tile_x, CAST(floor(y / 10000) AS BIGINT) AS tile_y, count(*) FILTER (WHERE present) AS n FROM s7 GROUP BY tile_x, tile_y",
    "region_components": f"WITH RECURSIVE {_REGIONS} SELECT * FROM regions",
    "region_outlines": f"""WITH RECURSIVE {_OUTLINES} SELECT s.rx AS region_x, s.ry AS region_y, f.x AS ring_x, f.y AS ring_y, area < 0 AS hole, CAST((step + 1) % n AS BIGINT) AS place, s.x2 AS x, s.y2 AS y
FROM areas JOIN walk USING (first) JOIN numbered s USING (e) JOIN linked USING (e) JOIN numbered f ON f.e = areas.first WHERE corner""",
    "hist_boost_probs": f"""WITH {_BOOST} SELECT sample_id, cls AS class_idx, round(exp(m) / sum(exp(m)) OVER (PARTITION BY sample_id), 6) AS p
FROM margins JOIN samples USING (sample_id) WHERE split <> 'train'""",
    "output_code_probs": f"WITH {_CODED} SELECT sample_id, class_idx, round(exp(z - top) / sum(exp(z - top)) OVER (PARTITION BY sample_id), 6) AS p FROM (SELECT *, max(z) OVER (PARTITION BY sample_id) AS top FROM logs)",
    "grid_resample": f"WITH {_POINTS} SELECT {_CELL.format(50)}, count(*) AS n, round(avg(value), 6) AS value FROM points GROUP BY cx, cy",
    "grid_align": f"""WITH {_POINTS}, a AS (SELECT {_CELL.format(20)}, avg(value) AS first FROM points WHERE kind = 1 GROUP BY cx, cy), b AS (
  SELECT {_CELL.format(20)}, avg(value) AS second FROM points WHERE kind = 3 AND value > 40 GROUP BY cx, cy)
SELECT cx, cy, round(first, 6) AS first, round(second, 6) AS second FROM a FULL JOIN b USING (cx, cy)""",
    "clip_counts": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) GROUP BY c_mktsegment",
    "background_fill": f"""WITH {_POINTS}, cells AS (SELECT {_CELL.format(100)}, max(CASE WHEN kind = 1 AND value > 45 THEN 1 ELSE 0 END) AS kind FROM points GROUP BY cx, cy)
SELECT cx, cy, CAST(kind AS INTEGER) AS kind FROM cells""",
    "focal_mode": f"""WITH {_POINTS}, cells AS (SELECT {_CELL.format(50)}, arg_min(kind, key * 10 + kind) AS kind, count(*) % 2 = 0 AS sure FROM points GROUP BY cx, cy), near AS (
  SELECT c.cx, c.cy, n.kind, count(*) AS votes FROM cells c JOIN cells n ON n.sure AND abs(c.cx - n.cx) <= 1 AND abs(c.cy - n.cy) <= 1 AND (c.cx <> n.cx OR c.cy <> n.cy) GROUP BY c.cx, c.cy, n.kind
), best AS (SELECT cx, cy, kind AS best FROM near QUALIFY row_number() OVER (PARTITION BY cx, cy ORDER BY votes DESC, kind) = 1)
SELECT cx, cy, CAST(CASE WHEN sure THEN kind ELSE coalesce(best, kind) END AS INTEGER) AS kind FROM cells LEFT JOIN best USING (cx, cy)""",
    "above_line": """WITH line AS (SELECT c_nationkey, max(c_acctbal) / 2 AS line FROM customer WHERE c_nationkey > 2 GROUP BY c_nationkey)
SELECT CASE WHEN c_acctbal > line THEN 'above' WHEN c_acctbal <= line THEN 'below' END AS side, count(*) AS n FROM customer LEFT JOIN line USING (c_nationkey) GROUP BY side""",
    "load_clean": """SELECT vec_id, CAST(f AS FLOAT) AS f, code FROM (SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN NULL WHEN vec_id % 11 = 5 THEN CAST('NaN' AS DOUBLE) ELSE CAST(vec_id AS DOUBLE) / 4 END AS f,
  CASE WHEN vec_id % 13 <> 1 THEN 'a' END AS split, label AS code FROM embeddings) WHERE f IS NOT NULL AND NOT isnan(f) AND split IS NOT NULL AND code IS NOT NULL""",
    "split_sizes": f"WITH {_SAMPLES} SELECT split, count(*) AS n, max(len(features)) AS n_features, count(DISTINCT code) AS n_classes FROM samples GROUP BY split",
    "label_encode": f"WITH {_SAMPLES} SELECT code, class_idx FROM classes",
    "class_distribution": f"WITH {_SAMPLES} SELECT class_idx, count(*) AS n FROM samples JOIN classes USING (code) WHERE split = 'train' GROUP BY class_idx",
    "subsample_exact": f"WITH {_SAMPLES} SELECT sample_id, code FROM samples WHERE split = 'train' ORDER BY md5('0:' || sample_id), sample_id LIMIT 100",
    "stratified_sample": f"WITH {_SAMPLES} SELECT sample_id, code FROM samples QUALIFY row_number() OVER (PARTITION BY code ORDER BY md5(CAST(sample_id AS VARCHAR)), sample_id) <= 10",
    "dummy_predict": f"WITH {_SAMPLES}, top AS (SELECT code FROM samples WHERE split = 'train' GROUP BY code ORDER BY count(*) DESC, code LIMIT 1) SELECT sample_id, s.code, t.code AS pred FROM samples s CROSS JOIN top t WHERE split = 'test'",
    "centroid_probs": f"WITH {_PROBS} SELECT sample_id, class_idx, round(p, 6) AS p FROM probs",
    "class_ranks": f"WITH {_RANKED} SELECT sample_id, class_idx, rank FROM ranked",
    "sorted_cumsum": f"WITH {_RANKED} SELECT sample_id, rank, round(before, 6) AS before FROM ranked",
    "saps_scores": f"WITH {_RANKED} {_LONG.format(score=_SCORE['SAPS'], lam=0.2)}",
    "aps_scores": f"WITH {_RANKED} {_LONG.format(score=_SCORE['APS'], lam=0)}",
    "raps_scores": f"WITH {_RANKED} {_LONG.format(score=_SCORE['RAPS'], lam=0.01)}",
    "conformal_tau": f"WITH {_cells(conformal.COMPARED)} SELECT method, lam, alpha, round(tau, 6) AS tau FROM tau",
    "prediction_sets": f"WITH {_cells((('SAPS', 0.2, None),))} SELECT sample_id, class_idx FROM scored JOIN tau USING (method, lam) WHERE split = 'test' AND alpha = 0.1 AND score <= tau",
    "saps_sweep": f"WITH {_cells(_SWEEP)} SELECT alpha, round(1 - alpha, 6) AS target_coverage, lam, round(tau, 6) AS tau, {_STATS} FROM sets GROUP BY alpha, lam, sets.tau",
    "aps_metrics": f"WITH {_cells((('APS', 0.0, 1),))} SELECT alpha, round(tau, 6) AS tau, {_STATS} FROM sets GROUP BY alpha, sets.tau",
    "raps_metrics": f"WITH {_cells((('RAPS', 0.01, 1),))} SELECT alpha, round(tau, 6) AS tau, {_STATS} FROM sets GROUP BY alpha, sets.tau",
    "rank_threshold": f"WITH {_RANK} SELECT alpha, n, r_star, below, n_at, k_pick, CASE WHEN isfinite(pi_star) THEN round(pi_star, 6) END AS pi_star FROM stars",
    "rank_metrics": f"WITH {_RANK} SELECT alpha, r_star, {_STATS} FROM rank_sets GROUP BY alpha, r_star",
    "compare_methods": f"""SELECT * FROM (WITH {_cells(conformal.COMPARED)} SELECT method, alpha, round(1 - alpha, 6) AS target_coverage, CASE WHEN method <> 'APS' THEN lam END AS hp_lam, CASE WHEN method = 'RAPS' THEN k_reg END AS hp_k_reg,
  round(tau, 6) AS tau, {_STATS}, CAST(NULL AS INTEGER) AS hp_r_star FROM sets GROUP BY method, alpha, sets.lam, sets.k_reg, sets.tau)
UNION ALL SELECT * FROM (WITH {_RANK} SELECT 'RANK', alpha, round(1 - alpha, 6), CAST(NULL AS DOUBLE), CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE), {_STATS}, r_star FROM rank_sets GROUP BY alpha, r_star)""",
    "confusion_matrix": f"WITH {_PRED} SELECT y, pred, n FROM confusion",
    "macro_f1": f"""WITH {_PRED}, both_sides AS (SELECT y AS k, n AS total, CASE WHEN y = pred THEN n ELSE 0 END AS hit FROM confusion UNION ALL SELECT pred, n, 0 FROM confusion)
SELECT round(avg(f1), 6) AS f1_macro FROM (SELECT k, 2.0 * CAST(sum(hit) AS DOUBLE) / CAST(sum(total) AS DOUBLE) AS f1 FROM both_sides GROUP BY k)""",
    "balanced_accuracy": f"WITH {_PRED} SELECT round(avg(recall), 6) AS balanced_accuracy FROM (SELECT y, CAST(sum(CASE WHEN y = pred THEN n ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS recall FROM confusion GROUP BY y)",
    "set_size_hist": f"WITH {_cells(conformal.COMPARED)} SELECT method, alpha, CAST(size AS INTEGER) AS size, count(*) AS n, CAST(sum(covered) AS BIGINT) AS covered FROM sets GROUP BY method, alpha, size",
    "zonal_stats": f"WITH {_PROBS} SELECT sample_id % 5 AS zone, class_idx, round(median(p), 6) AS median, round(max(p), 6) AS max, round(stddev_pop(p), 6) AS sd, round(avg(CAST(p > 0.1 AS INTEGER)), 6) AS share_above FROM probs GROUP BY zone, class_idx",
    "zonal_merged": f"WITH {_PROBS} SELECT sample_id % 5 AS zone, {_MERGED} FROM probs GROUP BY zone",
    "label_fallback": f"WITH {_SAMPLES}, l AS (SELECT sample_id, coalesce(CASE WHEN sample_id % 3 > 0 THEN code END, code % 4) AS code FROM samples) SELECT sample_id, code, n_name AS name FROM l LEFT JOIN nation ON n_nationkey = code",
    "area_rollup": "SELECT r_name, n_name, CAST(sum(c_custkey) AS BIGINT) AS area FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
}
