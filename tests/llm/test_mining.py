"""License scans, centroid clusters and hard negatives against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from setcast.llm import clusters, licenses, negatives

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def slow_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) > 0x7F:
            word += c
        else:
            out += [word] if word else []
            word = ""
    return out


def slow_scan(text):
    words = slow_words(text)
    places = sorted((k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
    base, best, more = {x for _, x in places}, 0.0, set()
    for b in range(0, max(1, len(words)), licenses.STRIDE):
        held = set(words[b : b + licenses.BLOCK])
        for label, notice in licenses.TEMPLATES:
            tokens = set(slow_words(notice)) - licenses.STOP
            share = len(tokens & held) / len(tokens)
            if len(tokens & held) >= math.ceil(licenses.THRESHOLD * len(tokens)):
                more, best = more | {label}, max(best, share)
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if at else best


def test_license_scans_match_brute_force(spark):
    r = random.Random(4)
    common = [f"word{k}" for k in range(40)] + ["the", "under", "mit", "software", "license", "use"]
    texts = [None, "", " ,.;\n", "x", "MIT License", "mit-license MIT LICENSE mit license", "the general\npublic  license; General Public License", "MİT license ſ", "é mit licenseé", "license mit", "mit", "public license", "a" * 70000]
    for _, notice in licenses.TEMPLATES:
        words = notice.split()
        texts += [notice, notice.upper(), " ".join(r.choices(common, k=r.randrange(300))) + "\n" + notice + "\n" + " ".join(r.choices(common, k=150))]
        for drop in (1, 2, 3, 5):
            kept = sorted(r.sample(range(len(words)), max(1, len(words) - drop)))
            texts.append(" ".join(r.choices(common, k=r.randrange(200)) + [words[k] for k in kept]))
        far = [x for w in words for x in [w, *r.choices(common, k=12)]]  # spread over several blocks
        texts.append(" ".join(far))
    texts += [" ".join(r.choices(common, k=9000)), "mit license " * 5000]
    rows = [(k if k != 9 else None, t, 1, "clash") for k, t in enumerate(texts)] + [(4, texts[4], 1, "again"), (4, texts[4], 1, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, hits string")
    got = sorted(map(str, (tuple(x) for x in licenses.op11(df).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect())))
    assert got == sorted(str((x[0], *slow_scan(x[1]))) for x in rows)
    assert {x.split(", ")[-2] for x in got} >= {"'mit'", "'cc-by-nc'", "''", "'bsd'"}
    assert licenses.op11(df.limit(0)).collect() == [] and licenses.license_blocks(df.limit(0)).collect() == []
    blocks = {(x["doc_id"], x["label"]) for x in licenses.license_blocks(df).collect()}
    assert (13, "mit") in blocks and all(d != 0 for d, _ in blocks)


def test_license_scans_stay_in_the_jvm(spark):
    df = spark.createDataFrame([(1, "MIT License")], "doc_id long, text string")
    plan = licenses.op11(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


def slow_clusters(rows, dim, k, rounds):
    kept = [(i, tuple(max(-clusters.LIMIT, min(clusters.LIMIT, math.floor(256 * x))) for x in v)) for i, v, _ in rows if v is not None and len(v) == dim and fine(v)]
    first = sorted(kept, key=lambda x: (x[0] is None, hashlib.sha256(f"2:{x[0]}".encode()).hexdigest() if x[0] is not None else "", x[1]))
    centres = [x for _, x in first[:k]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [place(v)[1] for _, v in kept]
        for c in set(own):
            inside = [v for (_, v), n in zip(kept, own, strict=True) if n == c]
            centres[c] = tuple(sum(x) // len(inside) for x in zip(*inside, strict=True))
    found = [place(v) for _, v in kept]
    inertia = Counter()
    for s, n in found:
        inertia[n] += s
    return sorted(str((i, n, s, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())) for (i, _), (s, n) in zip(kept, found, strict=True))


def test_clusters_match_brute_force(spark):
    r = np.random.default_rng(8)
    rows = [(k, [float(x) for x in r.normal(size=64) * (0.01 if k % 3 else 1)], 1) for k in range(150)]
    rows += [(200 + k, rows[0][1], None) for k in range(5)] + [(3, rows[7][1], 1), (None, rows[8][1], 2), (201, rows[0][1], 1), (300, [0.0] * 64, 0), (301, [1e300] * 64, 0), (302, [-0.001] * 64, 0)]
    odd = [(400, None, 1), (401, [], 1), (402, [1.0] * 63, 1), (403, [math.nan] * 64, 1), (404, [None] + [1.0] * 63, 1), (405, [math.inf] * 64, 1)]
    df = spark.createDataFrame(rows + odd, VECTORS).selectExpr("*", "1 AS v", "'x' AS cluster")
    names = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    got = lambda df, **o: sorted(str(tuple(x)) for x in clusters.clusters(df, **o).select(*names).collect())
    assert got(df) == slow_clusters(rows, 64, 40, 5)
    few = spark.createDataFrame([(k, [float(k % 4), 0.0], 0) for k in range(9)], VECTORS)  # ties, and centroids that stay empty
    assert got(few, dim=2, k=6) == slow_clusters([(k, [float(k % 4), 0.0], 0) for k in range(9)], 2, 6, 5)
    assert got(spark.createDataFrame(odd, VECTORS)) == [] and clusters.op12(df.limit(0)).columns == list(names)


def test_nearest_is_exact_with_ties():
    r = np.random.default_rng(1)
    for dim in (1, 5, 64, 70):
        x, c = r.integers(-3, 4, (400, dim)), r.integers(-3, 4, (30, dim))
        c[7] = c[3]
        full = np.square(x[:, None].astype(np.int64) - c).sum(2)
        number, distance = clusters.nearest(x, c, r.permutation(dim))
        assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()


def slow_negatives(rows):
    kept = [(n, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for n, (i, v, label) in enumerate(rows) if label is not None and fine(v)]
    order, out = lambda x: (-x[0], x[1] is None, x[1] or 0), []
    for n, i, label, v in kept:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=True)), j, other) for m, j, other, w in kept if m != n and len(w) == len(v)]
        for p, j, _ in sorted((x for x in scored if x[2] == label), key=order)[:5]:
            hard = sorted((x for x in scored if x[2] != label and 30 * p <= 100 * x[0] <= 90 * p), key=order)[:10]
            out += [(i, j, k, y, p, s) for k, (s, y, _) in enumerate(hard, 1)]
    return sorted(map(str, out))


def test_hard_negatives_match_brute_force(spark):
    r = np.random.default_rng(6)
    centre = r.normal(size=(12, 16))
    rows = [(k, [float(x) for x in centre[k % 12] * 0.2 + r.normal(size=16) * 0.1], int(r.integers(0, 10))) for k in range(700)]
    rows += [(1000 + k, rows[0][1], k % 3) for k in range(60)] + [(100, rows[100][1], rows[100][2]), (100, rows[3][1], 4), (None, rows[0][1], 1), (None, rows[0][1], 2)]
    rows += [(2000 + 100 * k, [float(x) for x in r.normal(size=3) * 900], k) for k in range(9)] + [(3000, [], 1), (3001, [], 1), (3002, [], 2), (-100, rows[5][1], -3), (3100, [0.0] * 16, 1)]
    odd = [(4000, None, 1), (4100, [math.nan] * 16, 1), (4200, [None] * 16, 1), (4300, [math.inf] * 16, 1), (4400, rows[0][1], None)]
    df = spark.createDataFrame(rows + odd, VECTORS).selectExpr("*", "1 AS v", "'x' AS key", "2 AS anchor_id")
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    want = slow_negatives(rows)
    assert len(want) > 300
    for numbers in (negatives.BLOCK_NUMBERS, 16 * 90, 16 * 3):
        got = sorted(str(tuple(x)) for x in negatives.hard_negatives(df, block_numbers=numbers).select(*names).collect())
        assert got == want, numbers
    assert negatives.op13(df.limit(0)).collect() == [] and negatives.op13(spark.createDataFrame(odd, VECTORS)).collect() == []


def test_intervals_drop_rows_early_and_hold_the_score():
    r = np.random.default_rng(2)
    x, a = r.integers(-256, 257, (5000, 64)), r.integers(-256, 257, (3, 64))
    part = pa.table({"key": range(5000), "vec_id": range(5000), "label": [0] * 5000, "v": pa.array(list(x), pa.list_(pa.int64()))})
    rows = negatives._Rows(part, 64)
    total, missing = negatives._scores(a, rows)
    assert missing > 0
    for k in range(3):
        exact, looked = x @ a[k], []

        def stays(s, low, high):
            looked.append(len(s))
            keep = s >= negatives._cut(s, 5) - (high - low)
            if len(s) == 5000:
                assert (s + low <= exact).all() and (exact <= s + high).all()  # noqa: B023
            return keep

        left, score = negatives._narrowed(a[k], rows, np.arange(5000), total[k], missing, stays)
        assert (score == exact[left]).all() and set(np.argsort(-exact)[:5]) <= set(left)
        assert looked[0] == 5000 and min(looked) < 500


def test_few_rows_are_picked_for_single_anchors(monkeypatch):
    r = np.random.default_rng(5)
    x = np.rint(r.normal(size=(4000, 64)) * 40).astype(np.int64)
    x[1], x[2], x[7], label = x[1] * 1000, 0, x[6], np.arange(4000) % 10
    given = {"key": range(4000), "vec_id": [None if k == 8 else k for k in range(4000)], "label": label, "v": pa.array(list(x), pa.list_(pa.int64()))}
    part, narrowed, left, scores = pa.table(given), negatives._narrowed, [], x @ x.T

    def watched(a, rows, at, score, missing, stays):
        looked = []
        out = narrowed(a, rows, at, score, missing, lambda *s: looked.append(stays(*s)) or looked[-1])
        left.append(np.count_nonzero(looked[0]))
        return out

    def best(k, places, n):
        return sorted(places, key=lambda m: (-scores[k, m], part["vec_id"][int(m)].as_py() is None, m))[:n]

    monkeypatch.setattr(negatives, "_narrowed", watched)
    anchors = part.take(pa.array(range(0, 60, 2)))
    found = negatives._cell(False)((pa.scalar(64),), part, anchors).to_pylist()
    own = {k: best(k, [m for m in range(4000) if m != k and label[m] == label[k]], 5) for k in anchors["key"].to_pylist()}
    assert [(f["anchor_key"], f["score"]) for f in found] == [(k, scores[k, m]) for k, ms in own.items() for m in ms]
    known = [[{"id": m, "score": int(scores[k, m])} for m in own[k][:3]] + [{"id": 0, "score": -7}] for k in own]
    hard = negatives._cell(True)((pa.scalar(64),), part, anchors.append_column("positives", pa.array(known))).to_pylist()
    want = []
    for k, (_, ps) in zip(own, enumerate(known), strict=True):
        for place, p in enumerate(ps):
            fits = [m for m in range(4000) if label[m] != label[k] and 30 * p["score"] <= 100 * scores[k, m] <= 90 * p["score"]]
            want += [(k, place, part["vec_id"][int(m)].as_py(), scores[k, m]) for m in best(k, fits, 10)]
    assert [(h["anchor_key"], h["place"], h["id"], h["score"]) for h in hard] == want and len(want) > 500
    assert len(left) == 60 and np.mean(left) < 4000 / 8
