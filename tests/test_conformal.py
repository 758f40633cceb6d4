"""Hand-checked goldens, properties and edge cases of the conformal operators, metrics and preparation."""

import math
import re

import pytest
from pyspark.sql import functions as F

from setcast.functions import kernels
from setcast.operators import conformal, metrics, models, prep
from setcast.plans import catalog
from setcast.sources import tables

CAL = ["11 3 2 0", "8 5 3 1", "2 9 5 1", "4 7 5 2", "1 2 13 2", "10 4 2 2", "3 12 1 0", "7 6 3 0", "2 3 11 2"]
TEST = ["13 2 1 0", "7 5 4 1", "3 5 8 0", "2 10 4 1"]
CELLS = (("APS", 0.0, 1), ("RAPS", 0.03125, 1), ("SAPS", 0.25, None))


@pytest.fixture(scope="module")
def golden(spark):
    rows = []
    for split, lines in (("cal", CAL), ("test", TEST)):
        for line in lines:
            *p, y = map(int, line.split())
            rows.append((len(rows), split, y, 1.0, [x / 16 for x in p]))
    kept = conformal.ranked(spark.createDataFrame(rows, "sample_id long, split string, y int, u double, p array<double>")).cache()
    yield kept
    kept.unpersist(blocking=True)


@pytest.mark.parametrize(
    ("alpha", "method", "tau", "textbook", "sets", "stats"),
    [
        (0.25, "APS", 1, 0.9375, "012 012 012 012", (1, 3, 3, 3, 0, 0)),
        (0.25, "RAPS", 1.0625, 0.96875, "012 012 012 012", (1, 3, 3, 3, 0, 0)),
        (0.25, "SAPS", 1.125, 1, "01 012 012 012", (1, 2.75, 3, 3, 0, 0)),
        (0.4, "APS", 0.8125, 0.8125, "0 01 12 1", (0.75, 1.5, 1.5, 2, 0.5, 0)),
        (0.4, "RAPS", 0.84375, 0.8125, "0 01 12 1", (0.75, 1.5, 1.5, 2, 0.5, 0)),
        (0.4, "SAPS", 0.8125, 0.75, "0 01 12 1", (0.75, 1.5, 1.5, 2, 0.5, 0)),
        (0.5, "RAPS", 0.8125, 0.78125, "0 01 2 1", (0.75, 1.25, 1, 2, 0.75, 0)),
        (0.5, "SAPS", 0.75, 0.6875, "- 01 12 1", (0.5, 1.25, 1.5, 2, 0.25, 0.25)),
    ],
)
def test_golden_sets(golden, alpha, method, tau, textbook, sets, stats):
    cells = tuple(c for c in CELLS if c[0] == method)
    found = conformal.score_sets(golden, cells, (alpha,))
    rows = found.orderBy("sample_id").collect()
    assert [r["tau"] for r in rows] == [tau] * 4
    assert " ".join("".join(map(str, sorted(r["members"]))) or "-" for r in rows) == sets
    assert tuple(conformal.set_metrics(found, ["alpha"]).drop("alpha").first()) == stats
    assert conformal.thresholds(conformal.in_cells(golden.where("split = 'cal'"), cells), (alpha,), "textbook").first()["tau"] == textbook


@pytest.mark.parametrize(("alpha", "r_star", "k_pick", "pi", "sizes"), [(0.25, 2, 6, 0.1875, [1, 2, 2, 2]), (0.4, 2, 0, math.inf, [1, 1, 1, 1]), (0.5, 1, 8, 0.4375, [1, 1, 1, 1])])
def test_golden_rank(golden, alpha, r_star, k_pick, pi, sizes):
    stage = conformal.rank_thresholds(golden, (alpha,)).first()
    assert (stage["r_star"], stage["k_pick"], stage["pi_star"]) == (r_star, k_pick, pi)
    assert [r["size"] for r in conformal.rank_sets(golden, (alpha,)).orderBy("sample_id").collect()] == sizes


def test_ties_and_sql_functions(spark):
    kernels.register(spark)
    df = spark.createDataFrame([([0.375, 0.375, 0.25],), ([0.2, 0.5, 0.3],)], "p array<double>")
    assert [r[0] for r in df.select(kernels.class_ranks(F.col("p"))).collect()] == [[1, 2, 3], [3, 1, 2]]
    assert [r[0] for r in df.selectExpr("class_ranks(p)").collect()] == [[1, 2, 3], [3, 1, 2]]
    assert df.selectExpr("set_size(p, 0.3D)").collect()[1][0] == 2


def test_order_statistics_any_place(spark):
    values = [((k * 37) % 101) // 3 / 7 for k in range(500)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "g string, score double")
    wanted = spark.createDataFrame([("a", m) for m in (1, 2, 250, 499, 500)] + [("b", 1)], "g string, m long")
    got = {(r["g"], r["m"]): r["score"] for r in conformal.order_statistics(df, wanted, ["g"]).collect()}
    assert got == {**{("a", m): sorted(values)[m - 1] for m in (1, 2, 250, 499, 500)}, ("b", 1): 1.0}


def test_one_score_gives_its_own_threshold(spark):
    rows = conformal.ranked(spark.createDataFrame([(1, "cal", 0, 1.0, [0.5, 0.5])], "sample_id long, split string, y int, u double, p array<double>"))
    assert conformal.thresholds(conformal.in_cells(rows, (("APS", 0.0, 1),)), (0.1,)).first()["tau"] == 0.5
    assert conformal.compare_methods(rows.limit(0)).count() == 0


def test_sets_nest_and_raps_without_penalty_is_aps(spark):
    rows = conformal.ranked(catalog.probs(spark, "/root/testdata/sf0.001")).cache()
    sets = conformal.score_sets(rows, (("APS", 0.0, 1), ("RAPS", -1.0, 1)), (0.05, 0.2)).collect()
    by = {(r["method"], r["alpha"], r["sample_id"]): set(r["members"]) for r in sets}
    for (method, alpha, i), members in by.items():
        assert members == by["APS", alpha, i] and (alpha == 0.05 or members <= by[method, 0.05, i])
    again = conformal.compare_methods(rows.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, conformal.compare_methods(rows).collect()))
    rows.unpersist(blocking=True)


def test_rows_of_classes_ask_for_the_array_once(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25]), (2, []), (3, None), (4, [None, 0.125])], "sample_id long, p array<double>")
    found = catalog._long(df.withColumn("twice", F.transform("p", lambda v: 2 * v)), "twice", "v")
    assert sorted(map(tuple, found.collect())) == [(1, 0, 1.0), (1, 1, 0.5), (4, 0, None), (4, 1, 0.25)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 1


def test_scores_of_all_classes_sum_up_once(spark):
    rows = [(1, 0.5, [0.25, 0.5, 0.25]), (2, 1.0, [0.0, 0.0, 1.0]), (2, 1.0, [0.0, 0.0, 1.0]), (3, 0.5, []), (4, 0.5, None), (5, 0.5, [0.25, None, 0.75]), (6, None, [1.0])]
    df = conformal.ranked(spark.createDataFrame(rows, "sample_id long, u double, p array<double>"))
    shown = lambda *cell: [r["s"] for r in df.select("sample_id", conformal.scores(*cell).alias("s")).orderBy("sample_id").collect()]
    assert shown("APS", 0.0, 1) == [[0.625, 0.25, 0.875], [1.0, 1.0, 1.0], [1.0, 1.0, 1.0], [], None, [None, 0.375, 0.875], [None]]
    assert shown("RAPS", 0.125, 1) == [[0.75, 0.25, 1.125], [1.125, 1.25, 1.0], [1.125, 1.25, 1.0], [], None, [None, 0.375, 1.0], [None]]
    assert shown("RAPS", -1.0, 1) == shown("APS", 0.0, 1)
    plan, around = df.select(conformal.scores("RAPS", 0.125, 1))._jdf.queryExecution().optimizedPlan().toString(), []
    for sign in re.findall(r"\w*\(|\)", plan[: plan.index("aggregate(")]):
        around = around[:-1] if sign == ")" else [*around, sign]
    assert "lambdafunction(" not in around


def test_centroids_read_features_as_they_are(spark):
    centroids, rows = models.Centroids([[0.0, 0.0], None, [1.0, 0.5]]), [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.1, 0.7]), (3, [math.nan, 0.5])]
    df = spark.createDataFrame(rows, "sample_id long, features array<float>").withColumn("p", centroids.probabilities(F.col("features")))
    one, again, two, three = (r["p"] for r in df.orderBy("sample_id").collect())
    x = df.where("sample_id = 2").first()["features"]
    z = [-10.0 * (x[0] ** 2 + x[1] ** 2), -10.0 * ((x[0] - 1.0) ** 2 + (x[1] - 0.5) ** 2)]
    assert one == again == [0.5, 0.0, 0.5] and two == [pytest.approx(1 / (1 + math.exp(z[1] - z[0])), abs=1e-9), 0.0, pytest.approx(1 / (1 + math.exp(z[0] - z[1])), abs=1e-9)]
    assert math.isnan(three[0]) and math.isnan(three[2])
    for odd in ([None, 1.0], [1.0], None):
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            spark.createDataFrame([(1, odd)], "sample_id long, features array<float>").select(centroids.probabilities(F.col("features"))).collect()
    assert "transform(features" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_preparation(spark):
    df = spark.createDataFrame([(1.0, "a", 3.0), (math.nan, "a", 3.0), (1.0, None, 3.0), (1.0, "a", None), (1.0, "a", 3.9)], "f double, split string, code double")
    assert [tuple(r) for r in tables.load_clean(df).collect()] == [(1.0, 3), (1.0, 3)]
    codes = spark.createDataFrame([(c,) for c in (10, 2, 2, 1, 10)], "code int")
    classes = prep.encode_labels(codes)
    assert {r["code"]: r["class_idx"] for r in classes.collect()} == {1: 0, 2: 1, 10: 2}
    with pytest.raises(Exception, match="unseen label"):
        prep.with_classes(spark.createDataFrame([(7,)], "code int"), classes).collect()
    ids = spark.range(3).withColumnRenamed("id", "sample_id")
    assert prep.subsample(ids, 5).count() == 3 and prep.subsample(ids, 2).distinct().count() == 2


def test_metrics(spark):
    frame = lambda y, p: spark.createDataFrame(list(zip(map(int, y), map(int, p), strict=True)), "y int, pred int")
    assert metrics.macro_f1(frame("001122", "011120")).first()[0] == pytest.approx(0.655556, abs=1e-6)
    assert metrics.balanced_accuracy(frame("001122", "011120")).first()[0] == pytest.approx(2 / 3)
    assert metrics.macro_f1(frame("001", "031")).first()[0] == pytest.approx(0.555556, abs=1e-6)
    assert metrics.balanced_accuracy(frame("001", "031")).first()[0] == pytest.approx(0.75)


def test_gbt_fits_the_rounds_asked_for(monkeypatch):
    import inspect
    from types import SimpleNamespace

    from setcast.operators import models

    asked = []

    class Stop(Exception):
        pass

    def fake(**given):
        asked.append(given["maxIter"])
        raise Stop

    monkeypatch.setattr(models, "GBTClassifier", fake)
    for n in (7, 500):
        try:
            models.with_probabilities("gbt", SimpleNamespace(count=lambda: 1), None, 2, n_estimators=n)
        except Stop:
            pass
    assert asked == [7, 500]
    assert inspect.signature(models.with_probabilities).parameters["n_estimators"].default == 500
