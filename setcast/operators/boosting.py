"""Gradient boosting of trees over histograms, with second-order gains and all classes of a round at once.

Features become bins by mergeable weighted quantile sketches. Gradients and hessians of the softmax loss become integers (BITS binary digits), so that
their sums, hence splits and leaves, are the same whatever the partitions. A step is one pass over the rows: tasks add up integers per class, node,
feature and bin, Spark adds up the tasks, and of two siblings only the one with less hessian is counted, the other being the parent less it.
Prefix sums over bins and the best split of each node are plain aggregations; the driver gets one row per class and node.

Three ways to grow: by level (every node that gains), by leaf (the leaf that gains most, up to a number of leaves, with gradient-based sampling of
rows if asked for), and symmetric (one split for all nodes of a level, with gradients from prefixes of a permutation).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setcast.sources.tables import removed, settled

#: Binary digits of gradients and hessians behind the point: sums of 2^36 rows fit 64 bits.
BITS = 26
#: Points of a quantile sketch for each bin, and groups that sketches are merged in at first.
POINTS, GROUPS = 8, 256
#: Rounds after which margins are written; until then trees are applied again in every pass.
EVERY = 8
#: Blocks of the permutation: each is as long as all before it.
BLOCKS = 12
#: Rows that a Python worker looks at together: what it holds doesn't grow with the table, nor with the batches that Spark sends.
AT_ONCE = 2048
#: Least gain of a split.
LEAST_GAIN = 1e-6
_KEYS = ("cls", "node", "feature", "bin")


@dataclass
class Tree:
    """feature[n] is -1 for a leaf, else rows with a bin of at most cut[n] go left. value[n] is what a leaf adds, or a row for each block."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    by_block: list[list[float]] | None = None

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        two = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, *two
        for values, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            values += [x, x]
        return two

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        feature, cut, left, right = map(np.array, (self.feature, self.cut, self.left, self.right))
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (inner := feature[at] >= 0).any():
            goes_left = bins[rows, np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
        return at


@dataclass
class Model:
    """rounds: a tree per class each."""

    edges: list[np.ndarray]
    n_classes: int
    rounds: list[list[Tree]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """How many edges of each feature lie below the value; NaN counts as the largest."""
        out = np.empty(x.shape, np.uint16)
        for k, edges in enumerate(self.edges):
            out[:, k] = np.searchsorted(edges, x[:, k], side="left")
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        return _added(self.rounds, self.bins(x), np.zeros((len(x), self.n_classes)), None)

    def probabilities(self, features: Column, digits: int | None = None) -> Column:
        k = self.n_classes

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                out = np.empty((len(batch), k))
                for first in range(0, len(batch), AT_ONCE):
                    part = batch.slice(first, AT_ONCE)
                    p = _softmax(self.margins(_numbers(part).reshape(len(part), len(self.edges))))
                    out[first : first + len(part)] = p if digits is None else np.round(p, digits)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * k, pa.int32()), pa.array(out.ravel()))

        return scored(features)


def _numbers(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """All values of a column of lists, one after another; nulls among them are NaN."""
    return pc.list_flatten(lists).to_numpy(**({} if isinstance(lists, pa.ChunkedArray) else {"zero_copy_only": False})).astype(np.float64)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(first, AT_ONCE)


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(1, keepdims=True, initial=-np.inf))
    return e / e.sum(1, keepdims=True)


def _added(rounds: list[list[Tree]], bins: np.ndarray, margins: np.ndarray, block: np.ndarray | None) -> np.ndarray:
    for trees in rounds:
        for c, tree in enumerate(trees):
            at = tree.leaf_of(bins)
            margins[:, c] += np.array(tree.by_block)[at, block] if tree.by_block and block is not None else np.array(tree.value)[at]
    return margins


# Bins


def _summary(values: np.ndarray, weights: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their weights; of more than so many, those at equal steps of weight, with the weight up to them."""
    values, place = np.unique(values, return_inverse=True)
    weights = np.bincount(place, weights, len(values))
    if len(values) <= points:
        return values, weights
    upto = np.cumsum(weights)
    chosen = np.unique(np.append(np.searchsorted(upto, upto[-1] * np.arange(1, points) / points), len(values) - 1))
    return values[chosen], np.diff(upto[chosen], prepend=0.0)


def _sketches(points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in _sliced(batches):
            x = _numbers(batch.column("features")).reshape(batch.num_rows, -1)
            w = batch.column("weight").to_numpy(zero_copy_only=False).astype(np.float64)
            for k in range(x.shape[1]):
                fine = np.isfinite(x[:, k]) & (w > 0)
                before = found.get(k, (np.zeros(0), np.zeros(0)))
                found[k] = _summary(np.append(before[0], x[fine, k]), np.append(before[1], w[fine]), points)
        pid = TaskContext.get().partitionId() % GROUPS
        yield _sketch_rows([(k, pid, v, w) for k, (v, w) in found.items()])

    return run


def _sketch_rows(rows: list) -> pa.RecordBatch:
    doubles = pa.list_(pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([list(r[2]) for r in rows], doubles), pa.array([list(r[3]) for r in rows], doubles)], ["feature", "part", "v", "w"])


def _merged(points: int):
    def run(part: pa.Table) -> pa.Table:
        v, w = (_numbers(part[c]) for c in ("v", "w"))
        return pa.Table.from_batches([_sketch_rows([(part["feature"][0].as_py(), 0, *_summary(v, w, points))])])

    return run


def quantile_edges(rows: DataFrame, max_bin: int = 256, weight: Column | None = None) -> list[np.ndarray]:
    """rows(features) -> for each feature at most max_bin - 1 edges at equal steps of weight; all midway values if there are few distinct ones.

    Sketches of tasks merge in two levels, each holding POINTS points a bin: an edge is off by a few parts in POINTS * max_bin of the weight
    at most. The driver gets the last sketch of each feature. Null and infinite values make no edges; without rows there are none.
    """
    points, schema = POINTS * max_bin, "feature int, part int, v array<double>, w array<double>"
    found = rows.select("features", (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight")).where("features IS NOT NULL").mapInArrow(_sketches(points), schema)
    found = found.groupBy("feature", "part").applyInArrow(_merged(points), schema).groupBy("feature").applyInArrow(_merged(points), schema)
    edges: dict[int, np.ndarray] = {}
    for r in found.collect():
        v, upto = np.array(r["v"]), np.cumsum(r["w"])
        if len(v) <= max_bin:
            edges[r["feature"]] = (v[:-1] + v[1:]) / 2
        else:
            edges[r["feature"]] = np.unique(v[np.searchsorted(upto, upto[-1] * np.arange(1, max_bin) / max_bin)])
    return [edges.get(k, np.zeros(0)) for k in range(max(edges, default=-1) + 1)]


# Sums of gradients


def _read(batch: pa.RecordBatch, n_features: int, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint16).reshape(n, n_features)
    margins = np.frombuffer(b"".join(batch.column("margins").to_pylist()), np.float64).reshape(n, n_classes).copy()
    return bins, batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64), margins, batch.column("block").to_numpy(zero_copy_only=False).astype(np.int64)


def gradients(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the softmax loss, per row and class, as integers."""
    p = _softmax(margins)
    g, h = p.copy(), np.maximum(2 * p * (1 - p), 1e-16)
    g[np.arange(len(y)), y] -= 1
    return np.rint(g * (1 << BITS)).astype(np.int64), np.rint(h * (1 << BITS)).astype(np.int64)


def _kept(key: np.ndarray, g: np.ndarray, sampling: tuple[float, float, float, int] | None) -> np.ndarray:
    """The weight of each row: 1 for rows with large gradients; of the others, a share by a hash of the key counts for all."""
    if sampling is None:
        return np.ones(len(g))
    limit, share, weight, seed = sampling
    large = np.abs(g).sum(1) >= limit
    draw = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1B54A32D192ED03 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(large, 1.0, np.where((draw >> np.uint64(11)).astype(np.float64) / (1 << 53) < share, weight, 0.0))


def _sums(model: Model, since: int, trees: list[Tree], build: dict[tuple[int, int], int | None], sampling, blocks: bool):
    """Per class and node to build: integers g and h of each feature and bin, or, with blocks, of each block of the permutation. build names each node's
    sibling, if any, which gets the same sums with the other sign."""
    n_features, n_classes = len(model.edges), model.n_classes
    slots: list[dict[int, int]] = [{} for _ in range(n_classes)]
    for c, node in build:
        slots[c][node] = len(slots[c])
    n_bins = max((len(e) for e in model.edges), default=0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in _sliced(batches):
            bins, y, margins, block = _read(batch, n_features, n_classes)
            g, h = gradients(_added(model.rounds[since:], bins, margins, block), y)
            weight = _kept(batch.column("key").to_numpy(zero_copy_only=False), g, sampling)
            if sampling is not None:
                g, h = (np.rint(x * weight[:, None]).astype(np.int64) for x in (g, h))
            for c, own in enumerate(slots):
                if not own:
                    continue
                slot = np.full(len(trees[c].feature), -1)
                slot[list(own)] = list(own.values())
                at = slot[trees[c].leaf_of(bins)]
                rows = ((at >= 0) & (weight > 0)).nonzero()[0]
                if blocks:
                    index, width = at[rows] * BLOCKS + block[rows], BLOCKS
                    repeat = 1
                else:
                    index, width = ((at[rows, None] * n_features + np.arange(n_features)) * n_bins + bins[rows]).ravel(), n_features * n_bins
                    repeat = n_features
                sums = total.setdefault(c, [np.zeros(len(own) * width, np.int64) for _ in range(2)])
                for out, x in zip(sums, (g, h), strict=True):
                    # sums of a batch are below 2^53, hence exact
                    out += np.bincount(index, np.repeat(x[rows, c], repeat), len(out)).astype(np.int64)
        out = []
        for c, (g, h) in total.items():
            node = np.array(list(slots[c]))
            at = (h != 0).nonzero()[0]
            columns = (node[at // BLOCKS], np.zeros(len(at)), at % BLOCKS) if blocks else (node[at // (n_features * n_bins)], at // n_bins % n_features, at % n_bins)
            out.append((np.full(len(at), c), *columns, g[at], h[at]))
            if any(build[c, n] is not None for n in slots[c]):
                sibling = np.zeros(max(slots[c]) + 1, np.int64)
                sibling[list(slots[c])] = [build[c, n] for n in slots[c]]
                out.append((np.full(len(at), c), sibling[columns[0]], *columns[1:], -g[at], -h[at]))
        columns = [np.concatenate([x[k] for x in out]) if out else np.zeros(0) for k in range(6)]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64), t) for x, t in zip(columns, (pa.int32(),) * 4 + (pa.int64(),) * 2, strict=True)], [*_KEYS, "g", "h"])

    return run


def _summed(rows: DataFrame, how: tuple, parents: DataFrame | None = None) -> DataFrame:
    """Sums of the nodes to build. parents, already under the names of siblings, with the siblings' negative parts make the siblings' sums: one shuffle for both."""
    parts = rows.mapInArrow(_sums(*how), "cls int, node int, feature int, bin int, g long, h long")
    parts = parts.union(parents) if parents is not None else parts
    return parts.groupBy(*_KEYS).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).where("h <> 0")


def _renamed(sums: DataFrame, names: list[list[int | None]]) -> DataFrame:
    """names[class][node] instead of each node; nodes without a new name are left out."""
    found = F.get(F.get(F.from_json(F.lit(json.dumps(names)), "array<array<int>>"), F.col("cls")), F.col("node"))
    return sums.withColumn("node", found).where("node IS NOT NULL")


def gain(g: Column, h: Column, lam: float) -> Column:
    return g * g / (h + lam)


def best_splits(sums: DataFrame, lam: float, least_child: float) -> DataFrame:
    """sums(cls, node, feature, bin, g, h) -> for each class and node its sums and its best split: (gain, feature, cut, and the left side's sums), null if none gains.
    Among equal gains the first feature, then the first bin."""
    unit = float(1 << BITS)
    upto = Window.partitionBy("cls", "node", "feature").orderBy("bin")
    rows = sums.select("cls", "node", "feature", "bin", F.sum("g").over(upto).alias("lg"), F.sum("h").over(upto).alias("lh"), F.sum("g").over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("g"), F.sum("h").over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("h"))
    lg, lh, g, h = (F.col(c) / unit for c in ("lg", "lh", "g", "h"))
    won = gain(lg, lh, lam) + gain(g - lg, h - lh, lam) - gain(g, h, lam)
    fits = (lh >= least_child) & (h - lh >= least_child) & (won > LEAST_GAIN)
    best = F.max(F.when(fits, F.struct(won.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "lg", "lh"))).alias("best")
    return rows.groupBy("cls", "node").agg(F.first("g").alias("g"), F.first("h").alias("h"), best)


def _symmetric_splits(sums: DataFrame, lam: float) -> DataFrame:
    """The split of each class that gains most over all its nodes together, in the same form: a row for each node."""
    unit, by_node = float(1 << BITS), Window.partitionBy("cls", "node", "feature")
    nodes = sums.select("cls", "node").distinct()
    grid = sums.select("cls", "feature", "bin").distinct().join(nodes, "cls").select(*_KEYS, F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("h"))
    upto = by_node.orderBy("bin")
    rows = sums.select(*grid.columns).union(grid).groupBy(*_KEYS).agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    rows = rows.select(*_KEYS, F.sum("g").over(upto).alias("lg"), F.sum("h").over(upto).alias("lh"), F.sum("g").over(by_node).alias("g"), F.sum("h").over(by_node).alias("h"))
    lg, lh, g, h = (F.col(c) / unit for c in ("lg", "lh", "g", "h"))
    won = gain(lg, lh, lam) + gain(g - lg, h - lh, lam) - gain(g, h, lam)
    each = F.sort_array(F.collect_list(F.struct("node", "g", "h", "lg", "lh", won.alias("won"))))  # the nodes of one level
    total = F.aggregate(F.col("nodes"), F.lit(0.0), lambda s, x: s + x["won"])
    rows = rows.groupBy("cls", "feature", "bin").agg(each.alias("nodes")).select("cls", F.struct(total.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "nodes").alias("s"))
    best = rows.groupBy("cls").agg(F.max("s").alias("s")).select("cls", "s", F.explode("s.nodes").alias("n"))
    split = F.when(F.col("s.gain") > LEAST_GAIN, F.struct(F.col("s.gain").alias("gain"), F.col("s.f").alias("f"), F.col("s.b").alias("b"), F.col("n.lg").alias("lg"), F.col("n.lh").alias("lh")))
    return best.select("cls", F.col("n.node").alias("node"), F.col("n.g").alias("g"), F.col("n.h").alias("h"), split.alias("best"))


@dataclass(frozen=True)
class Growth:
    """How a round's trees grow. kind: level, leaf or symmetric; share_large and share_small: of rows that are kept for their gradients and of the
    others, 1 and 0 for all rows."""

    kind: str = "level"
    depth: int = 6
    leaves: int = 31
    eta: float = 0.3
    lam: float = 1.0
    least_child: float = 1.0
    max_bin: int = 256
    share_large: float = 1.0
    share_small: float = 0.0
    seed: int = 0


#: What the well-known libraries do by default, by the names the command line takes.
LEVEL_WISE = Growth()
LEAF_WISE = Growth("leaf", depth=64, eta=0.1, lam=0.0, least_child=1e-3, max_bin=255)
SYMMETRIC = Growth("symmetric", eta=0.1, lam=3.0, least_child=0.0, max_bin=254)


def _round(rows: DataFrame, model: Model, since: int, how: Growth, number: int) -> list[Tree]:
    """One tree per class."""
    trees = [Tree() for _ in range(model.n_classes)]
    unit = float(1 << BITS)
    sampling = _sampling(rows, model, since, how, number)
    sums_of = lambda build, parents=None, blocks=False: _summed(rows, (model, since, trees, build, sampling, blocks), parents)
    splits = lambda sums: {(r["cls"], r["node"]): r for r in (_symmetric_splits(sums, how.lam) if how.kind == "symmetric" else best_splits(sums, how.lam, how.least_child)).collect()}
    weight = lambda g, h: -how.eta * (g / unit) / (h / unit + how.lam) if h / unit + how.lam > 0 else 0.0
    sums = sums_of({(c, 0): None for c in range(model.n_classes)}).persist()
    known, depth, leaves = splits(sums), {(c, 0): 0 for c in range(model.n_classes)}, [1] * model.n_classes
    for (c, node), r in known.items():
        trees[c].value[node] = weight(r["g"], r["h"])
    open_nodes = {k: r for k, r in known.items() if r["best"] is not None}
    try:
        while open_nodes:
            chosen = list(open_nodes)
            if how.kind == "leaf":  # of each class the leaf that gains most, the first among ties
                chosen = [max((k for k in open_nodes if k[0] == c), key=lambda k: (open_nodes[k]["best"]["gain"], -k[1])) for c in sorted({k[0] for k in open_nodes})]
            build: dict[tuple[int, int], int | None] = {}
            names: list[list[int | None]] = [[None] * len(t.feature) for t in trees]
            for c, node in sorted(chosen):
                r = open_nodes.pop((c, node))
                best = r["best"]
                two = trees[c].split(node, -best["f"], -best["b"])
                side = [(best["lg"], best["lh"]), (r["g"] - best["lg"], r["h"] - best["lh"])]
                for child, (g, h) in zip(two, side, strict=True):
                    trees[c].value[child] = weight(g, h)
                    depth[c, child] = depth[c, node] + 1
                leaves[c] += 1
                if depth[c, two[0]] < how.depth and (how.kind != "leaf" or leaves[c] < how.leaves):
                    small = int(side[1][1] < side[0][1])
                    build[c, two[small]] = names[c][node] = two[1 - small]
            if how.kind == "leaf":
                open_nodes = {k: r for k, r in open_nodes.items() if leaves[k[0]] < how.leaves}
            if not build:
                continue
            for c, node in open_nodes:
                names[c][node] = node
            then = sums_of(build, _renamed(sums, names)).persist()
            fresh = {(c, n) for (c, a), b in build.items() for n in (a, b)}
            only = [[n if (c, n) in fresh else None for n in range(len(t.feature))] for c, t in enumerate(trees)]
            found = splits(_renamed(then, only) if open_nodes else then)
            sums.unpersist()
            sums = then
            open_nodes |= {k: r for k, r in found.items() if r["best"] is not None}
    finally:
        sums.unpersist()
    if how.kind == "symmetric":
        _ordered_values(trees, sums_of({(c, n): None for c, t in enumerate(trees) for n, f in enumerate(t.feature) if f < 0}, blocks=True), weight)
    return trees


def _sampling(rows: DataFrame, model: Model, since: int, how: Growth, number: int) -> tuple[float, float, float, int] | None:
    """The size of gradients from which all rows are kept, the share of the others and their weight."""
    if how.share_large >= 1:
        return None
    n_features, n_classes, later = len(model.edges), model.n_classes, model.rounds[since:]

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            bins, y, margins, block = _read(batch, n_features, n_classes)
            g, _ = gradients(_added(later, bins, margins, block), y)
            yield pa.RecordBatch.from_arrays([pa.array(np.abs(g).sum(1))], ["size"])

    limit = rows.mapInArrow(sizes, "size long").agg(F.percentile_approx("size", 1 - how.share_large, 10_000)).first()[0]
    share = min(1.0, how.share_small / (1 - how.share_large))
    return (float(limit or 0), share, 1 / share if share else 0.0, how.seed * 1_000_003 + number)


def _ordered_values(trees: list[Tree], sums: DataFrame, weight) -> None:
    """Values of leaves for each block of the permutation, from the blocks before it alone: 0 for the first."""
    for c, tree in enumerate(trees):
        tree.by_block = [[0.0] * BLOCKS for _ in tree.feature]
    held = {(r["cls"], r["node"], r["bin"]): (r["g"], r["h"]) for r in sums.collect()}  # a row for each leaf and block
    for c, tree in enumerate(trees):
        for node in range(len(tree.feature)):
            g = h = 0
            for block in range(BLOCKS):
                tree.by_block[node][block] = weight(g, h)
                more = held.get((c, node, block), (0, 0))
                g, h = g + more[0], h + more[1]


def _prepared(train: DataFrame, model: Model, how: Growth) -> DataFrame:
    """key, y, block, bins and margins of each row, as a settled table. Rows without features or class are left out."""
    n_classes = model.n_classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            n = batch.num_rows
            x = _numbers(batch.column("features")).reshape(n, len(model.edges))
            zero = np.zeros(n_classes).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), batch.column("block"), pa.array([r.tobytes() for r in model.bins(x)], pa.binary()), pa.array([zero] * n, pa.binary())], ["key", "y", "block", "bins", "margins"])

    # A row's place in the permutation is a hash of what it holds; a block is as long as all before it.
    place = F.shiftrightunsigned(F.xxhash64(F.lit(how.seed), "features", "class_idx", "key"), 11) / F.lit(float(1 << 53))
    block = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(place, F.lit(1e-12)) * (1 << (BLOCKS - 1))))).cast("int")
    rows = train.where("features IS NOT NULL AND class_idx IS NOT NULL").select((F.col("sample_id") if "sample_id" in train.columns else F.monotonically_increasing_id()).cast("long").alias("key"), F.col("class_idx").cast("int").alias("y"), F.col("features"), "class_idx")
    rows = rows.select("key", "y", block.alias("block"), "features")
    return settled(rows.mapInArrow(run, "key long, y int, block int, bins binary, margins binary"), "boosting")


def _advanced(rows: DataFrame, model: Model, since: int) -> DataFrame:
    n_features, n_classes, later = len(model.edges), model.n_classes, model.rounds[since:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            bins, _, margins, block = _read(batch, n_features, n_classes)
            margins = _added(later, bins, margins, block)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "y", "block", "bins")] + [pa.array([m.tobytes() for m in margins], pa.binary())], ["key", "y", "block", "bins", "margins"])

    return settled(rows.mapInArrow(run, rows.schema), "boosting")


def fit(train: DataFrame, n_classes: int, rounds: int = 500, how: Growth = LEVEL_WISE, edges: list | None = None) -> Model:
    """train(features, class_idx[, sample_id]) -> a model of so many rounds; edges, if given, take the place of sketches.

    A feature's missing values count as its largest. Features are of one length; rows without features or class are left out; without rows
    all classes are alike.
    """
    usable = train.where("features IS NOT NULL AND class_idx IS NOT NULL")
    found = [np.asarray(e, np.float64) for e in edges] if edges is not None else quantile_edges(usable, how.max_bin)
    model = Model(found, n_classes)
    if not found or not n_classes:
        return model
    rows, since = _prepared(train, model, how), 0
    for number in range(rounds):
        trees = _round(rows, model, since, how, number)
        model.rounds.append(trees)
        if len(model.rounds) - since >= EVERY and number < rounds - 1:
            then = _advanced(rows, model, since)
            removed(rows)
            rows, since = then, len(model.rounds)
    removed(rows)
    return model
