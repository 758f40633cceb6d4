"""Random forests against plain computations."""

import math

import numpy as np
import pytest

from setcast.operators import boosting, forest, models


def table(spark, n=240, seed=4, noise=0.6):
    r = np.random.default_rng(seed)
    y = r.integers(0, 3, n)
    x = (r.normal(size=(n, 5)) * noise + y[:, None] * [1.0, -0.5, 0, 0.3, 0]).round(2)
    rows = [(k, int(c), [float(v) for v in row]) for k, (c, row) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "sample_id long, class_idx int, features array<double>").repartition(3), x, y


def shares(df):
    return {r["sample_id"]: r["p"] for r in df.collect()}


def plain_leaf(x, y, w, bins, row, tree, how):
    """Class shares where a row ends in a tree that is grown along its way alone."""
    node, rows = 1, [k for k in range(len(y)) if w[k]]
    counts = lambda own: [sum(int(w[k]) for k in own if y[k] == c) for c in range(how.n_classes)]
    purity = lambda own: sum(c * c for c in counts(own)) / sum(counts(own))
    while node < 1 << how.depth:
        best = None
        for f in forest.features_of(np.array([node]), tree, how)[0]:
            for b in sorted({bins[k, f] for k in rows}):
                left, right = [k for k in rows if bins[k, f] <= b], [k for k in rows if bins[k, f] > b]
                if left and right and (won := purity(left) + purity(right) - purity(rows)) > 1e-9 and (best is None or won > best[0] + 1e-9):
                    best = won, f, b, left, right
        if best is None:
            break
        goes_left = bins[row, best[1]] <= best[2]
        node, rows = 2 * node + (not goes_left), best[3] if goes_left else best[4]
    return np.array(counts(rows)) / sum(counts(rows))


@pytest.mark.parametrize("small", [1 << 16, 25])
def test_trees_match_plain_ones(spark, monkeypatch, small):
    monkeypatch.setattr(forest, "SMALL", small)
    df, x, y = table(spark, n=90)
    got = shares(forest.with_probabilities(df, df, 3, trees=3, depth=5, seed=7, max_bin=8))
    how = forest.Forest(boosting.quantile_edges(df, 8), 3, 3, 5, 7)
    bins = boosting.Model(how.edges, 3).bins(x)
    key = {r["sample_id"]: r["k"] for r in df.selectExpr("sample_id", "xxhash64(sample_id, class_idx, features) AS k").collect()}
    weights = [forest.drawn(np.array([key[k] for k in range(90)]), t, 7) for t in range(3)]
    for k in range(0, 90, 9):
        want = np.mean([plain_leaf(x, y, weights[t], bins, k, t, how) for t in range(3)], axis=0)
        assert got[k] == pytest.approx(want, abs=1e-6)


def test_small_nodes_passes_and_partitions_have_no_influence(spark, monkeypatch):
    df, _, y = table(spark)
    want = shares(models.with_probabilities("rf", df, df, 3, n_estimators=12))
    assert len(want) == 240 and np.mean([np.argmax(want[k]) == y[k] for k in want]) > 0.9
    assert shares(models.with_probabilities("rf", df.repartition(7), df.coalesce(1), 3, n_estimators=12)) == want
    for name, value in (("SMALL", 30), ("CELLS", 2000), ("RECORD", 3), ("AT_ONCE", 50), ("HANDED", 1000), ("SCORES", 100)):
        monkeypatch.setattr(forest, name, value)
    assert shares(models.with_probabilities("rf", df, df, 3, n_estimators=12)) == want


def test_a_forest_of_many_deep_trees_takes_few_jobs(spark):
    """The number of jobs doesn't grow with depth or trees while nodes are small."""
    df, _, _ = table(spark, noise=30.0)  # classes that cannot be told apart make deep trees
    spark.sparkContext.setJobGroup("forest", "")
    try:
        assert len(shares(models.with_probabilities("rf", df, df, 3, n_estimators=200))) == 240
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("forest")) < 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_odd_tables(spark, monkeypatch):
    df, x, y = table(spark, n=60)
    odd = df.union(spark.createDataFrame([(900, None, x[0].tolist()), (901, 1, None), (902, 1, [math.nan] * 5)], df.schema))
    for small in (1 << 16, 5):
        monkeypatch.setattr(forest, "SMALL", small)
        got = forest.with_probabilities(odd, odd, 4, trees=20).collect()
        assert len(got) == 63 and all(len(r["p"]) == 4 and r["p"][3] == 0 for r in got)
        assert all(sum(r["p"]) == pytest.approx(0 if r["features"] is None else 1, abs=1e-6) for r in got)
        one = forest.with_probabilities(df.where("class_idx = 1"), df, 3, trees=4).collect()
        assert all(r["p"] == [0, 1, 0] for r in one)
    assert all(r["p"] == [0, 0, 0] for r in forest.with_probabilities(df.limit(0), df, 3, trees=2).collect())
    assert forest.with_probabilities(df, df.limit(0), 3, trees=2).collect() == []


def test_bags_and_subsets(spark):
    w = forest.drawn(np.arange(100_000), 3, 0)
    assert w.mean() == pytest.approx(1, abs=0.02) and (w == 0).mean() == pytest.approx(math.exp(-1), abs=0.01)
    assert np.corrcoef(w, forest.drawn(np.arange(100_000), 4, 0))[0, 1] == pytest.approx(0, abs=0.02)
    f = forest.features_of(np.arange(1, 5001), 2, forest.Forest([np.zeros(1)] * 64, 2, 1, 20, 0))
    assert f.shape == (5000, 8) and all(len(set(r)) == 8 for r in f)
    assert np.bincount(f.ravel(), minlength=64) == pytest.approx(5000 / 8, rel=0.25)
