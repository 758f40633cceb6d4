"""SimHash and embedding near-duplicates against brute force."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import types as T

from setcast.llm import embedding, simhash


def groups(ids, linked):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def slow_print(text):
    out, word, words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""), "", []
    for c in out + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_matches_brute_force(spark):
    r = random.Random(5)
    base = [[f"w{r.randrange(300)}" for _ in range(r.randrange(30, 90))] for _ in range(25)]
    texts = [None, "", " \n\t", "One", "ONE", "Éa É b", "x y z", "ab " * 9000]
    for b in base:
        texts += [" ".join(b), " ".join(b).upper()]
        for _ in range(6):
            c = list(b)
            c[r.randrange(len(c))] = "swap"
            texts.append(" ".join(c))
    texts.append(" ".join(f"u{r.randrange(10**6)}" for _ in range(40000)))
    rows = [(i * 3 % 1009, t, "clash", 1) for i, t in enumerate(texts)] + [(7, texts[8], "again", 1), (7, texts[8], "again", 1), (None, texts[9], "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    prints = [slow_print(t) for _, t, _, _ in rows]
    want = groups([x[0] for x in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    got = sorted((str(x.doc_id), x.fingerprint, x.component_id) for x in simhash.op3(df).collect())
    assert got == sorted((str(x[0]), f"{p:016x}", w) for x, p, w in zip(rows, prints, want, strict=True))
    assert simhash.op3(df.limit(0)).collect() == []


def test_every_pair_within_four_bits_is_linked(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    have = {0, (1 << 64) - 1}
    for b in base:
        for k in range(6):
            have.add(b ^ sum(1 << x for x in r.sample(range(64), k)))
    have = sorted(h - (1 << 64) if h >> 63 else h for h in have)
    for plan in simhash.PLANS:
        got = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(h,) for h in have], "fp long"), plan).collect()}
        assert got == {(a, b) for a in have for b in have if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert simhash.plan(10**6) == simhash.PLANS[0] and simhash.plan(10**10) == simhash.PLANS[1]
    assert sorted(simhash.ball(4, 2)) == sorted(x for x in range(16) if x.bit_count() <= 2)


def test_embeddings_match_brute_force(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = []
    for i in range(60):
        v = r.normal(size=16)
        for k in range(r.integers(1, 9)):
            w = v + r.normal(size=16) * 0.05 * k
            rows.append((len(rows), [float(x) for x in (w / np.linalg.norm(w) * r.uniform(0.1, 9)).astype("f4")], int(i % 3) if i % 7 else None))
    rows += [(900 + k, rows[0][1], 1) for k in range(30)]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [None] * 16, 1), (1003, [math.nan] * 16, 1), (1004, [math.inf] * 16, 1), (1005, [1.0], 1), (1006, [1.0], 1), (1007, [], 1), (901, rows[0][1], 1)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
    df = spark.createDataFrame(rows, schema).selectExpr("*", "'x' AS node", "1 AS cell", "2 AS n_links")

    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        (_, a, p), (_, b, q) = rows[i], rows[j]
        if p is None or p != q or not fine(a) or not fine(b) or len(a) != len(b):
            return False
        a, b = np.array(a, "f8"), np.array(b, "f8")
        return a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.98

    want = groups([x[0] for x in rows], linked)
    counts = [sum(linked(i, j) for j in range(len(rows)) if i != j) for i in range(len(rows))]
    expected = sorted((x[0], n, c, x[0] == c) for x, n, c in zip(rows, counts, want, strict=True))
    assert sum(counts) > 200
    for numbers, share in ((embedding.BLOCK_NUMBERS, 1 << 15), (7 * 16, 1 << 15), (20 * 16, 13)):
        monkeypatch.setattr(embedding, "SHARE_ROWS", share)
        got = sorted(tuple(x) for x in embedding.near_duplicates(df, block_numbers=numbers).select("vec_id", "n_links", "component_id", "kept").collect())
        assert got == expected
    assert embedding.op4(df.limit(0)).collect() == []


def test_one_of_two_cells_sends_visitors():
    cells = np.arange(9)
    sends = np.array([embedding._visits(np.full(9, k), cells) for k in cells])
    assert all(sends[i, j] != sends[j, i] for i in cells for j in cells if i != j)


def test_embeddings_of_every_length_are_linked(spark):
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.normal(size=8)], 1) for k in range(40)]
    wide = [[float(x) for x in r.normal(size=16)] for _ in range(20)]
    rows += [(100 + k, v, 1) for k, v in enumerate(wide)] + [(200 + k, [2 * x for x in v], 1) for k, v in enumerate(wide)]
    rows += [(1005, [1.0], 1), (1006, [1.0], 1), (1007, [1.0], 2), (1008, [], 1), (1009, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in embedding.op4(df).collect()}
    assert len(got) == len(rows) and all(got[100 + k] == got[200 + k] == (1, 100 + k) for k in range(20))
    assert got[1005] == got[1006] == (1, 1005)
    assert all(got[k] == (0, k) for k in [*range(40), 1007, 1008, 1009])


def test_vectors_are_kept_once_however_many_cells_they_meet(spark, monkeypatch):
    """Vectors in all directions meet a good part of all cells: a copy for each would fill a worker's memory and many times the input's disk."""
    r = np.random.default_rng(11)
    v = r.normal(size=(3000, 32))
    v[:400] = v[0] + v[:400] * 0.14
    v[2900:] = v[2800:2900]
    label = r.integers(0, 2, 3000)
    label[2900:] = label[2800:2900]
    df = spark.createDataFrame([(k, [float(x) for x in v[k]], int(label[k])) for k in range(3000)], "vec_id long, embedding array<float>, label int")
    tables = {}

    def seen(table, tag, write=embedding.written):
        out = write(table, tag)
        tables.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(embedding, "written", seen)
    monkeypatch.setattr(embedding, "LEAST_NUMBERS", 1 << 12, raising=False)
    got = sorted(tuple(x) for x in embedding.near_duplicates(df, block_numbers=1 << 14).collect())
    assert sum(tables["cells"]) == len(np.unique(v.astype("f4"), axis=0))
    assert len(tables["found"]) > 1
    x = v.astype("f4").astype("f8")
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = (x @ x.T >= 0.98) & (label[:, None] == label) & ~np.eye(3000, dtype=bool)
    least = np.arange(3000)
    while (now := np.where(hit, least, 3000).min(1, initial=3000)).tolist() and (np.minimum(now, least) != least).any():
        least = np.minimum(now, least)
    assert hit.sum() > 10_000
    assert got == sorted((k, int(hit[k].sum()), int(least[k]), bool(least[k] == k)) for k in range(3000))


def test_a_block_does_not_hold_its_visitors():
    r = np.random.default_rng(2)

    def rows(role, n):
        v = r.normal(size=(n, 64)).astype("f4")
        return pa.RecordBatch.from_pydict({"role": pa.array([role] * n, pa.int32()), "cell": pa.array([0] * n, pa.int32()), "node": pa.array(range(n), pa.int64()), "copies": pa.array([1] * n, pa.int64()), "v": pa.array(list(v), pa.list_(pa.float32()))})

    peaks = []
    for visitors in (40, 400):
        block, batch = embedding._Block(0.98, 0.2), rows(2, 256)
        list(block.add(rows(1, 64)))
        tracemalloc.start()
        for _ in range(visitors):
            list(block.add(batch))
        list(block.end())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0]
