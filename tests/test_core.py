"""Grid operators, order statistics, models, harness, cache, run log and command line, on small fixtures."""

import csv
import glob
import math

import pytest
from pyspark.sql import functions as F

from setcast import cli
from setcast.operators import conformal, grid, models, order
from setcast.plans import catalog, harness
from setcast.sources import tables
from setcast.streaming import scoring

FOLDER = "/root/testdata/sf0.001"


def test_grid(spark, tmp_path):
    points = spark.createDataFrame([(0, 0, 1.0, 1), (4, 9, 3.0, 1), (12, 3, 5.0, 2), (None, 3, 5.0, 2), (-1, 0, None, 3), (-1, 0, 7.0, 3)], "x int, y int, value double, kind int")
    got = {(r["cx"], r["cy"]): (r["n"], r["value"]) for r in grid.resample(points, "value", 10).collect()}
    assert got == {(0, 0): (2, 2.0), (1, 0): (1, 5.0), (-1, 0): (1, 7.0)}
    region = spark.createDataFrame([(1,), (1,), (None,)], "kind int")
    assert grid.clip(points, region, "kind").count() == 2
    cells = spark.createDataFrame([(0, 0, 5)], "cx long, cy long, kind int")
    whole = spark.createDataFrame([(0, 0), (0, 1), (0, 1)], "cx long, cy long")
    assert sorted(tuple(r) for r in grid.fill(cells, whole, "kind").collect()) == [(0, 0, 5), (0, 1, 0)]
    rows = [(x, y, 1 if x < 2 else 2, not (x == 1 and y == 1)) for x in range(4) for y in range(4)] + [(9, 9, 7, False)]
    smooth = {(r["cx"], r["cy"]): r["kind"] for r in grid.smooth(spark.createDataFrame(rows, "cx long, cy long, kind int, sure boolean"), "kind", F.col("sure")).collect()}
    assert smooth[1, 1] == 1 and smooth[9, 9] == 7 and len(smooth) == 17
    sides = grid.above_line(points, spark.createDataFrame([(1, 2.0)], "kind int, line double"), "kind", "value", "line").collect()
    assert sorted(str(r["side"]) for r in sides) == ["None"] * 4 + ["above", "below"]
    grid.write_tiles(points.where("x IS NOT NULL"), f"{tmp_path}/tiles", 10)
    assert sorted(p.rsplit("=")[-1] for p in glob.glob(f"{tmp_path}/tiles/tile=*")) == ["-1_0", "0_0", "1_0"]


@pytest.mark.parametrize("rows", [1 << 17, 20])
def test_picked_order_statistics(spark, monkeypatch, rows):
    monkeypatch.setattr(order, "BIN_ROWS", rows)
    values = {0: [((k * 37) % 101) // 3 / 7 for k in range(500)], 1: [2.0] * 50, 2: [k / 3 for k in range(333)]}
    df = spark.createDataFrame([(c, v) for c, vs in values.items() for v in vs], "cell int, score double")
    spans = {c: (len(v), min(v), max(v)) for c, v in values.items()}
    wanted = {(c, m) for c, v in values.items() for m in (1, 2, len(v) // 2, len(v))}
    assert order.picked(df, spans, wanted) == {(c, m): sorted(values[c])[m - 1] for c, m in wanted}
    assert order.picked(df, spans, set()) == {}
    places = spark.createDataFrame([(c, m) for c, m in wanted], "cell int, m long")
    got = {(r["cell"], r["m"]): r["score"] for r in order.order_statistics(df, places, ["cell"]).collect()}
    assert got == {(c, m): sorted(values[c])[m - 1] for c, m in wanted}


def test_order_statistics_of_skewed_values(spark, monkeypatch):
    """Nearly all values in one of the first bins, over many powers of ten: ranges are cut again until they are small."""
    monkeypatch.setattr(order, "BIN_ROWS", 30)
    monkeypatch.setattr(order, "MOST_BINS", 256)
    values = sorted([10.0 ** -(k / 30) for k in range(300)] + [1e-10] * 200 + [5.0])
    df = spark.createDataFrame([(0, v) for v in values], "cell int, score double")
    wanted = {(0, m) for m in (1, 150, 201, 350, 500, 501)}
    assert order.picked(df, {0: (501, values[0], values[-1])}, wanted) == {(c, m): values[m - 1] for c, m in wanted}
    got = order.order_statistics(df, spark.createDataFrame(sorted(wanted), "cell int, m long"), ["cell"]).collect()
    assert {(r["cell"], r["m"]): r["score"] for r in got} == {(c, m): values[m - 1] for c, m in wanted}


def persisted(spark):
    return set(spark.sparkContext._jsc.getPersistentRDDs().keySet())


def test_comparison_is_one_scan_of_test_rows(spark):
    before = persisted(spark)
    rows = conformal.ranked(catalog.probs(spark, FOLDER))
    found = conformal.compare_methods(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") <= 1
    timed = conformal.timed_comparison(rows, (0.1,))
    assert timed.count() == 4 and timed.where("time_ms > 0").count() == 4
    assert sorted(map(str, timed.drop("time_ms").collect())) == sorted(map(str, found.where("alpha = 0.1D").select(timed.drop("time_ms").columns).collect()))
    assert persisted(spark) <= before


@pytest.mark.parametrize(("name", "options"), [("linear", {}), ("rf", {"n_estimators": 3}), ("gbt", {"n_estimators": 2}), ("knn", {}), ("dummy", {}), ("centroid", {})])
def test_models_give_probabilities(spark, name, options):
    rows = [(k, k % 3, [float(k % 3) + (k * 7 % 10) / 40, float(-(k % 3)), 1.0]) for k in range(60)]
    df = spark.createDataFrame(rows, "sample_id long, class_idx int, features array<float>")
    got = models.with_probabilities(name, df, df, 4, **options).withColumn("pred", models.predicted(F.col("p"))).collect()
    assert len(got) == 60 and all(len(r["p"]) == 4 and sum(r["p"]) == pytest.approx(1, abs=1e-6) and r["p"][3] == 0 for r in got)
    if name != "dummy":
        assert sum(r["pred"] == r["class_idx"] for r in got) >= 57
    with pytest.raises(ValueError, match="unknown model"):
        models.with_probabilities("other", df, df, 4)


def test_seeded_uniforms(spark):
    u = lambda seed: [r["u"] for r in tables.samples(spark, FOLDER, seed=seed).orderBy("sample_id").limit(50).collect()]
    assert u(0) == u(0) and u(0) != u(1) and all(0 <= x < 1 for x in u(1))
    assert spark.range(1).select(tables.uniform(F.lit((1 << 62) + 12345), 3)).first()[0] < 1


def test_harness_logs_each_model(spark, tmp_path):
    log, out, before = f"{tmp_path}/log", f"{tmp_path}/csv", persisted(spark)
    for _ in range(2):
        found = harness.benchmark(spark, FOLDER, ["dummy", "tabicl", "centroid"], log, max_train=90, max_val=40, csv=out).collect()
        assert [r["model"] for r in found] == ["dummy", "tabicl", "centroid"] and found[1]["error"] and found[2]["f1_macro"] >= 0 and found[0]["n_train_used"] == 90
    logged = spark.read.parquet(log)
    assert logged.count() == 6 and logged.select("run").distinct().count() == 2 and spark.read.parquet(f"{log}-config").count() == 2
    (file,) = glob.glob(f"{out}/*.csv")
    assert len(list(csv.DictReader(open(file)))) == 3
    harness.benchmark(spark, FOLDER, ["dummy"], f"{tmp_path}/none", tracking="disabled")
    assert not glob.glob(f"{tmp_path}/none*") and persisted(spark) <= before


def test_cache_is_keyed_by_configuration(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    for config, refit, want in (({"a": 1}, False, 1), ({"a": 1}, False, 1), ({"a": 2}, False, 2), ({"a": 1}, True, 3)):
        assert tables.cached(spark, str(tmp_path), config, make, refit).count() == want
    one, two = spark.range(3), spark.range(4)
    assert tables.data_print(one) == tables.data_print(one.repartition(3)) != tables.data_print(two)


@pytest.mark.parametrize("command", ["benchmark", "saps", "compare"])
def test_command_line(spark, tmp_path, command):
    args = [command, "--data", FOLDER, "--out", str(tmp_path), "--models", "dummy", "--alpha", "0.1, ,0.2", "--deterministic", "--tracking-mode", "offline"]
    cli.main(args)
    (file,) = glob.glob(f"{tmp_path}/{command}/*.csv")
    rows = list(csv.DictReader(open(file)))
    assert len(rows) == {"benchmark": 1, "saps": 6, "compare": 8}[command]
    if command == "compare":
        assert {"target_coverage", "time_ms", "hp_lam", "hp_k_reg", "hp_r_star"} <= set(rows[0])
    with pytest.raises(SystemExit):
        cli.main([command, "--device", "tpu"])


def test_sets_over_a_stream_agree_with_those_of_a_batch(spark, tmp_path):
    rows = [(k, 1.0, [0.5, 0.3, 0.2] if k % 2 else [0.1, 0.1, 0.8]) for k in range(10)]
    spark.createDataFrame(rows, "sample_id long, u double, p array<double>").write.parquet(f"{tmp_path}/in")
    want = sorted(map(str, scoring.stream_sets(spark.read.parquet(f"{tmp_path}/in"), 0.7).collect()))
    stream = scoring.stream_sets(spark.readStream.schema("sample_id long, u double, p array<double>").parquet(f"{tmp_path}/in"), 0.7)
    run = stream.writeStream.format("memory").queryName("sets").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(map(str, spark.sql("SELECT * FROM sets").collect())) == want and len(want) == 10


def test_gbt_probabilities_of_large_margins(spark):
    rows = [(k, k % 2, [1000.0 * (k % 2)]) for k in range(40)]
    df = spark.createDataFrame(rows, "sample_id long, class_idx int, features array<double>")
    got = models.with_probabilities("gbt", df, df, 2, n_estimators=30).collect()
    assert all(math.isfinite(x) for r in got for x in r["p"])
