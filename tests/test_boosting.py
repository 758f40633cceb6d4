"""Histogram boosting and output codes against plain computations."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from setcast.operators import boosting, codes, models

UNIT = 1 << boosting.BITS


def table(spark, n=300, dims=4, classes=3, seed=1, noise=1.0):
    r = np.random.default_rng(seed)
    y = r.integers(0, classes, n)
    x = (r.normal(size=(n, dims)) * noise + y[:, None] * [1.0, -0.5, 0, 0][:dims]).round(2)
    x[:20] = x[20:40]
    rows = [(k, int(c), [float(v) for v in row]) for k, (c, row) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "sample_id long, class_idx int, features array<double>").repartition(3), x, y


def plain_best(bins, g, h, how, rows):
    """(gain, -feature, -bin) of the best split of these rows."""
    best, total = None, (int(g[rows].sum()), int(h[rows].sum()))
    score = lambda a, b: (a / UNIT) ** 2 / (b / UNIT + how.lam)
    for f in range(bins.shape[1]):
        for b in sorted(set(bins[rows, f])):
            left = [k for k in rows if bins[k, f] <= b]
            lg, lh = int(g[left].sum()), int(h[left].sum())
            if lh / UNIT < how.least_child or (total[1] - lh) / UNIT < how.least_child:
                continue
            won = score(lg, lh) + score(total[0] - lg, total[1] - lh) - score(*total)
            if won > boosting.LEAST_GAIN and (best is None or (won, -f, -int(b)) > best):
                best = (won, -f, -int(b))
    return best


def plain_tree(bins, g, h, how):
    """Leaves as (sorted rows, value), level by level or leaf by leaf."""
    value = lambda rows: -how.eta * (g[rows].sum() / UNIT) / (h[rows].sum() / UNIT + how.lam)
    leaves = [(list(range(len(bins))), 0)]
    while True:
        found = [(plain_best(bins, g, h, how, rows), k) for k, (rows, depth) in enumerate(leaves) if depth < how.depth]
        found = [x for x in found if x[0]]
        if not found or how.kind == "leaf" and len(leaves) >= how.leaves:
            return sorted((tuple(rows), round(value(rows), 9)) for rows, _ in leaves)
        (_, f, b), k = max(found, key=lambda x: (x[0][0], -x[1]))
        rows, depth = leaves[k]
        left = [i for i in rows if bins[i, -f] <= -b]
        leaves[k : k + 1] = [(left, depth + 1), (sorted(set(rows) - set(left)), depth + 1)]


def leaves_of(tree, bins):
    at = tree.leaf_of(bins)
    return sorted((tuple(np.flatnonzero(at == n)), round(tree.value[n], 9)) for n in set(at))


@pytest.mark.parametrize("how", [boosting.Growth(depth=3, max_bin=16), boosting.Growth("leaf", depth=9, leaves=5, max_bin=16, lam=0.5)])
def test_trees_match_plain_ones(spark, how):
    df, x, y = table(spark)
    model = boosting.fit(df, 3, 2, how)
    bins, margins = model.bins(x), np.zeros((len(x), 3))
    for trees in model.rounds:
        g, h = boosting.gradients(margins, y)
        for c, tree in enumerate(trees):
            assert leaves_of(tree, bins) == plain_tree(bins, g[:, c], h[:, c], how)
            assert how.kind != "leaf" or sum(f < 0 for f in tree.feature) <= how.leaves
        margins = boosting._added([trees], bins, margins, None)
    p = {r["sample_id"]: r["p"] for r in df.withColumn("p", model.probabilities(F.col("features"), 9)).collect()}
    e = np.exp(margins) / np.exp(margins).sum(1, keepdims=True)
    assert all(np.allclose(p[k], e[k], atol=1e-8) for k in p) and (e.argmax(1) == y).mean() > 0.6


def test_symmetric_trees_match_plain_ones(spark):
    how = boosting.Growth("symmetric", depth=3, max_bin=12, lam=3.0, least_child=0.0, eta=0.2)
    df, x, y = table(spark, n=150, classes=2)
    model = boosting.fit(df, 2, 2, how)
    bins = model.bins(x)
    rows = boosting._prepared(df, boosting.Model(model.edges, 2), how).orderBy("key").collect()
    block = np.array([r["block"] for r in rows])
    assert len(set(block)) > 4
    margins = np.zeros((len(x), 2))
    score = lambda a, b: (a / UNIT) ** 2 / (b / UNIT + how.lam)
    for trees in model.rounds:
        g, h = boosting.gradients(margins, y)
        for c, tree in enumerate(trees):
            nodes = [list(range(len(x)))]
            for _ in range(how.depth):
                best = None
                for f in range(x.shape[1]):
                    for b in sorted(set(bins[:, f])):
                        won = 0.0
                        for n in nodes:
                            left = [k for k in n if bins[k, f] <= b]
                            lg, lh, tg, th = (int(v.sum()) for v in (g[left, c], h[left, c], g[n, c], h[n, c]))
                            won += score(lg, lh) + score(tg - lg, th - lh) - score(tg, th)
                        if best is None or won > best[0] + 1e-9:
                            best = (won, f, b)
                if best[0] <= boosting.LEAST_GAIN:
                    break
                nodes = [part for n in nodes for part in ([k for k in n if bins[k, best[1]] <= best[2]], [k for k in n if bins[k, best[1]] > best[2]]) if part]
            at = tree.leaf_of(bins)
            assert sorted(tuple(n) for n in nodes) == sorted(tuple(np.flatnonzero(at == n)) for n in set(at))
            for n in nodes:
                leaf = at[n[0]]
                assert tree.value[leaf] == pytest.approx(-how.eta * g[n, c].sum() / (h[n, c].sum() + how.lam * UNIT))
                for k in n:  # from rows of earlier blocks alone
                    before = [i for i in n if block[i] < block[k]]
                    assert tree.by_block[leaf][block[k]] == pytest.approx(-how.eta * g[before, c].sum() / (h[before, c].sum() + how.lam * UNIT))
        margins = boosting._added([trees], bins, margins, block)


def test_gradient_sampling_keeps_large_gradients(spark):
    df, x, y = table(spark, n=2000, noise=0.25)  # classes that can nearly be told apart
    how = boosting.Growth("leaf", leaves=4, max_bin=16, eta=0.5, share_large=0.2, share_small=0.1, seed=3)
    model = boosting.fit(df, 3, 4, how)
    assert (model.margins(x).argmax(1) == y).mean() > 0.9
    assert all(sum(f < 0 for f in t.feature) <= 4 for trees in model.rounds for t in trees)
    g, key = np.array([[5], [1], [1], [1]] * 5000), np.arange(20_000)
    w = boosting._kept(key, g, (4.0, 0.125, 8.0, 1))
    assert (w[::4] == 1).all() and set(w) == {0.0, 1.0, 8.0} and w.sum() == pytest.approx(20_000, rel=0.1)


def test_sketches_merge(spark):
    r = np.random.default_rng(2)
    x, w = r.normal(size=20_000), r.uniform(0.1, 3, 20_000)
    df = spark.createDataFrame([([float(a), float(k % 5)], float(b)) for k, (a, b) in enumerate(zip(x, w, strict=True))] + [([math.nan, math.inf], 1.0), (None, 1.0)], "features array<double>, w double").repartition(7)
    edges = boosting.quantile_edges(df, 32, F.col("w"))
    order = np.argsort(x)
    upto = np.cumsum(w[order]) / w.sum()
    places = [upto[np.searchsorted(x[order], e)] for e in edges[0]]
    assert len(edges[0]) == 31 and max(abs(p - k / 32) for k, p in enumerate(places, 1)) < 0.01
    assert list(edges[1]) == [0.5, 1.5, 2.5, 3.5]
    assert boosting.quantile_edges(df.limit(0)) == []


def test_odd_tables_and_margins_written_between(spark, monkeypatch):
    df, x, y = table(spark, n=80)
    odd = df.union(spark.createDataFrame([(900, None, x[0].tolist()), (901, 1, None), (902, 1, [math.nan] * 4)], df.schema))
    one = boosting.fit(odd, 4, 3, boosting.Growth(depth=2, max_bin=8))
    monkeypatch.setattr(boosting, "EVERY", 1)
    assert one.rounds == boosting.fit(odd.repartition(5), 4, 3, boosting.Growth(depth=2, max_bin=8)).rounds
    assert boosting.fit(df.limit(0), 3, 2).rounds == []
    got = models.with_probabilities("xgboost", df, odd.where("features IS NOT NULL"), 4, n_estimators=2).collect()
    assert len(got) == 82 and all(sum(r["p"]) == pytest.approx(1, abs=1e-6) for r in got)


def test_what_a_worker_holds_does_not_grow_with_its_batches(spark, monkeypatch):
    model, peaks = boosting.Model([np.arange(15.0)] * 16, 2), []
    run = boosting._sums(model, 0, [boosting.Tree(), boosting.Tree()], {(0, 0): None, (1, 0): None}, None, False)
    for n in (4_000, 40_000):
        bins, y = [np.full(16, k % 16, np.uint16).tobytes() for k in range(n)], pa.array(np.arange(n) % 2)
        batch = pa.RecordBatch.from_arrays([y, y, pa.array(np.zeros(n, np.int64)), pa.array(bins), pa.array([bytes(16)] * n)], ["key", "y", "block", "bins", "margins"])
        tracemalloc.start()
        assert sum(sum(b.column("h").to_pylist()) for b in run(iter([batch]))) == 2 * 16 * n << boosting.BITS - 1
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]
    df, _, _ = table(spark, n=120)
    fitted = lambda: boosting.fit(df, 3, 2, boosting.Growth(depth=2, max_bin=8))
    shown = lambda m: df.select("sample_id", m.probabilities(F.col("features"), 9).alias("p")).orderBy("sample_id").collect()
    want = fitted()
    rows = shown(want)
    monkeypatch.setattr(boosting, "AT_ONCE", 7)
    assert fitted().rounds == want.rounds and shown(want) == rows


def test_code_books():
    for n in (11, 22, 100, 150):
        book = codes.code_book(n)
        assert len(set(book)) == n and codes.distance(book) >= codes.REDUNDANCY and all(0 <= s < codes.ALPHABET for w in book for s in w)
    assert codes.code_book(1) == [(0,)]


def test_output_codes_tell_many_classes_apart(spark):
    rows = [(k, k % 22, [math.cos(k % 22) + k % 7 / 900, math.sin(k % 22), (k % 22) / 11]) for k in range(220)]
    df = spark.createDataFrame(rows, "sample_id long, class_idx int, features array<double>")
    got = models.with_probabilities("coded-knn", df, df, 22).withColumn("pred", models.predicted(F.col("p"))).collect()
    assert all(len(r["p"]) == 22 and sum(r["p"]) == pytest.approx(1, abs=1e-6) for r in got)
    assert sum(r["pred"] == r["class_idx"] for r in got) > 200
    few = models.with_probabilities("coded-centroid", df.where("class_idx < 5"), df, 5)
    assert few.columns == [*df.columns, "p"] and len(few.first()["p"]) == 5
