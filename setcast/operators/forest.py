"""Random forests: trees over Poisson bags, a random subset of features at each node, Gini impurity, class shares in the leaves.

Nodes with many rows are split by histograms that tasks count and Spark adds up. Once a node holds few rows, these and the rows to be scored there go to
one task, which grows the rest of the subtree and scores by it at once: no tree is ever gathered, and a task holds the training rows of one small node.
Bags and subsets are hashes of row, tree and node, and counts and shares are integers, so that results depend neither on partitions nor on which nodes are small.
Nodes are numbered as in a heap: those below n are 2 n and 2 n + 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setcast.operators.boosting import Model, quantile_edges
from setcast.sources.tables import removed, settled

#: Weight of the largest node that one task may grow, and such a node's counts by row and class.
SMALL, SMALL_COUNTS = 1 << 16, 1 << 20
#: Counts that a task holds for the nodes of one pass.
CELLS = 1 << 23
#: Rows that a task looks at together, rows of a record that is dealt out, bytes of records handed on at once, scores added up before they are.
AT_ONCE, RECORD, HANDED, SCORES = 2048, 64, 4 << 20, 1 << 17
#: A leaf's shares are integers of so many binary digits.
BITS = 30
_BAGS = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1)) for k in range(16)])
Splits = tuple[np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Forest:
    """What is to be grown."""

    edges: list[np.ndarray]
    n_classes: int
    trees: int
    depth: int
    seed: int

    @property
    def bins(self) -> int:
        return max(len(e) for e in self.edges) + 1

    @property
    def subset(self) -> int:
        return int(np.ceil(np.sqrt(len(self.edges))))

    @property
    def small(self) -> int:
        return max(1, min(SMALL, SMALL_COUNTS // self.n_classes))


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits."""
    x = x.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def drawn(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's bag holds each row: Poisson with mean 1."""
    u = (_mixed(_mixed(key, tree), seed) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.searchsorted(_BAGS, u, side="right")


def features_of(nodes: np.ndarray, tree: int, how: Forest) -> np.ndarray:
    """The sorted features that each node may split by."""
    d = len(how.edges)
    draws = _mixed(_mixed(nodes[:, None] * d + np.arange(d), tree), ~how.seed & 0xFFFFFFFF)
    return np.sort(np.argsort(draws, axis=1, kind="stable")[:, : how.subset], axis=1)


def walked(splits: Splits, node: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Where rows at these nodes end. splits: sorted nodes, their features, and their cuts: rows with a bin of at most the cut go left."""
    inner, feature, cut = splits
    node = node.copy()
    while len(inner):
        at = np.minimum(np.searchsorted(inner, node), len(inner) - 1)
        rows = (inner[at] == node).nonzero()[0]
        if not len(rows):
            break
        node[rows] = 2 * node[rows] + (bins[rows, feature[at[rows]]] > cut[at[rows]])
    return node


def gains(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How much purer rows are with these class counts to the left; 0 where a side is empty."""
    right = total - left
    n, m = left.sum(1), right.sum(1)
    square = lambda x, k: (x.astype(np.float64) ** 2).sum(1) / np.maximum(k, 1)
    return np.where((n > 0) & (m > 0), square(left, n) + square(right, m) - square(total, n + m), 0.0)


#: Least gain, above what rounding makes.
_LEAST = 1e-9


def _best(at: np.ndarray, y: np.ndarray, w: np.ndarray, bins: np.ndarray, total: np.ndarray, features: np.ndarray, n_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: none gains) and cut of each node. at: the node of each row, ascending. Among equal gains the first feature, then the first cut."""
    n, (nodes, k) = len(at), total.shape
    gain, feature, cut = np.full(nodes, _LEAST), np.full(nodes, -1), np.zeros(nodes, np.int64)
    start = np.searchsorted(at, np.arange(nodes))
    for j in range(features.shape[1]):
        value = bins[np.arange(n), features[at, j]].astype(np.int64)
        order = np.argsort(at * n_bins + value, kind="stable")
        value, counts = value[order], np.zeros((n + 1, k), np.int64)
        counts[np.arange(1, n + 1), y[order]] = w[order]
        upto = np.cumsum(counts, axis=0)
        ends = np.append((np.diff(at * n_bins + value) != 0).nonzero()[0], n - 1)
        of = at[ends]
        won = gains(upto[ends + 1] - upto[start[of]], total[of])
        most = np.maximum.reduceat(won, np.searchsorted(of, np.arange(nodes)))
        first = (won == most[of]).nonzero()[0]
        first = first[np.unique(of[first], return_index=True)[1]]
        better = most > gain
        gain[better], feature[better], cut[better] = most[better], features[better, j], value[ends[first]][better]
    return feature, cut


def grown(root: int, tree: int, y: np.ndarray, w: np.ndarray, bins: np.ndarray, how: Forest) -> tuple[Splits, np.ndarray, np.ndarray]:
    """The subtree of a node's rows, level by level: splits, leaves in order, and their class counts."""
    splits, leaves, counts = [], [], []
    node, k = np.full(len(y), root, np.int64), how.n_classes
    while len(node):
        order = np.argsort(node, kind="stable")
        node, y, w, bins = node[order], y[order], w[order], bins[order]
        nodes, at = np.unique(node, return_inverse=True)
        total = np.bincount(at * k + y, w, len(nodes) * k).astype(np.int64).reshape(-1, k)
        feature, cut = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64)
        mixed = (total.max(1) < total.sum(1)) & (nodes < 1 << how.depth)
        if mixed.any():
            rows, place = mixed[at], np.cumsum(mixed) - 1
            feature[mixed], cut[mixed] = _best(place[at[rows]], y[rows], w[rows], bins[rows], total[mixed], features_of(nodes[mixed], tree, how), how.bins)
        split = feature >= 0
        splits.append((nodes[split], feature[split], cut[split]))
        leaves.append(nodes[~split])
        counts.append(total[~split])
        rows = split[at].nonzero()[0]
        y, w, bins, at = y[rows], w[rows], bins[rows], at[rows]
        node = 2 * node[rows] + (bins[np.arange(len(rows)), feature[at]] > cut[at])
    if not leaves:
        return (np.zeros(0, np.int64),) * 3, np.array([root]), np.zeros((1, k), np.int64)
    leaf, order = np.concatenate(leaves), np.argsort(np.concatenate(leaves))
    return tuple(np.concatenate(x) for x in zip(*splits, strict=True)), leaf[order], np.concatenate(counts)[order]


def _shares(counts: np.ndarray) -> np.ndarray:
    return np.rint(counts / np.maximum(counts.sum(1, keepdims=True), 1) * (1 << BITS)).astype(np.int64)


# Tables


def _binned(how: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, d = Model(how.edges, how.n_classes), len(how.edges)
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, d)
            bins = np.ascontiguousarray(model.bins(x).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("scored", "key", "y")), _records(bins, np.arange(len(bins) + 1))], ["scored", "key", "y", "bins"])

    return run


def _records(rows: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values of the rows between two ends each."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * rows.shape[1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """All bytes of a column of binary values, as rows of so many."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _pieces(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for whole in batches:
        for first in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(first, AT_ONCE)
            scored, key, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("scored", "key", "y"))
            yield scored.astype(bool), key.astype(np.int64), y.astype(np.int64), _bytes(batch.column("bins"), d)


def _counted(tops: list[Splits], nodes: list[tuple[int, int]], how: Forest):
    """Rows' weights per tree, node, feature of its subset, bin and class, for the given nodes."""
    of_tree = {t: np.array(sorted(n for s, n in nodes if s == t)) for t in {t for t, _ in nodes}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, b, k = how.subset, how.bins, how.n_classes
        features = {t: features_of(own, t, how) for t, own in of_tree.items()}
        sums = {t: np.zeros(len(own) * m * b * k, np.int64) for t, own in of_tree.items()}
        for _, key, y, bins in _pieces(batches, len(how.edges)):
            for t, own in of_tree.items():
                w, node = drawn(key, t, how.seed), walked(tops[t], np.ones(len(key), np.int64), bins)
                at = np.minimum(np.searchsorted(own, node), len(own) - 1)
                rows = ((own[at] == node) & (w > 0)).nonzero()[0]
                at = at[rows]
                index = ((at[:, None] * m + np.arange(m)) * b + bins[rows[:, None], features[t][at]]) * k + y[rows, None]
                sums[t] += np.bincount(index.ravel(), np.repeat(w[rows], m), len(sums[t])).astype(np.int64)
        for t, found in sums.items():
            at = found.nonzero()[0]
            columns = (np.full(len(at), t), of_tree[t][at // (m * b * k)], at // (b * k) % m, at // k % b, at % k)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(found[at])], ["tree", "node", "slot", "bin", "cls", "n"])

    return run


def _decided(how: Forest):
    """A node's class counts, the feature and cut of its best split (feature -1: none gains) and the counts to the left."""

    def run(part: pa.Table) -> pa.Table:
        tree, node = part["tree"][0].as_py(), part["node"][0].as_py()
        slot, value, cls, n = (part[c].to_numpy() for c in ("slot", "bin", "cls", "n"))
        counts = np.zeros((how.subset, how.bins, how.n_classes), np.int64)
        counts[slot, value, cls] = n
        total, feature, cut, left, most = counts[0].sum(0), -1, 0, np.zeros(how.n_classes, np.int64), _LEAST
        for j, f in enumerate(features_of(np.array([node]), tree, how)[0]):
            upto = np.cumsum(counts[j], axis=0)
            won = np.where(counts[j].any(1), gains(upto, np.broadcast_to(total, upto.shape)), 0.0)
            if won.max() > most:
                cut = int(won.argmax())
                most, feature, left = won[cut], int(f), upto[cut]
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "feature": pa.array([feature], pa.int32()), "cut": pa.array([cut], pa.int32()), "total": [total.tolist()], "left": [left.tolist()]})

    return run


def _tops(rows: DataFrame, how: Forest) -> tuple[list[Splits], dict[tuple[int, int], np.ndarray]]:
    """The splits of all nodes that are not small, and the leaves among their children with their class counts."""
    splits: list[dict[int, tuple[int, int]]] = [{} for _ in range(how.trees)]
    arrays = lambda own: tuple(np.array(x, np.int64) for x in (sorted(own), *([own[n][k] for n in sorted(own)] for k in (0, 1))))
    leaves: dict[tuple[int, int], np.ndarray] = {}
    waiting = [(t, 1) for t in range(how.trees)] if rows.count() > how.small else []
    at_once = max(1, CELLS // (how.subset * how.bins * how.n_classes))
    while waiting:
        nodes, waiting = waiting[:at_once], waiting[at_once:]
        counts = rows.mapInArrow(_counted([arrays(s) for s in splits], nodes, how), "tree int, node int, slot int, bin int, cls int, n long")
        counts = counts.repartition("tree", "node").groupBy("tree", "node", "slot", "bin", "cls").agg(F.sum("n").alias("n"))
        found = counts.groupBy("tree", "node").applyInArrow(_decided(how), "tree int, node int, feature int, cut int, total array<long>, left array<long>").collect()
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            t, n, total, left = r["tree"], r["node"], np.array(r["total"]), np.array(r["left"])
            if r["feature"] < 0:
                leaves[t, n] = total
                continue
            splits[t][n] = r["feature"], r["cut"]
            for child, own in ((2 * n, left), (2 * n + 1, total - left)):
                if own.max() == own.sum() or child >= 1 << how.depth:
                    leaves[t, child] = own
                elif own.sum() > how.small:
                    waiting.append((t, child))
    return [arrays(s) for s in splits], leaves


def _dealt(tops: list[Splits], leaves: dict[tuple[int, int], np.ndarray], how: Forest):
    """Rows for each tree and node where its top ends, in records: those of its bag (class, weight, bins) unless it is a leaf, and those to be scored (key, bins)."""
    closed = [np.array(sorted(n for s, n in leaves if s == t), np.int64) for t in range(how.trees)]

    def records(t: int, scored: int, node: np.ndarray, data: np.ndarray):
        order = np.argsort(node, kind="stable")
        node, data = node[order], data[order]
        first = np.append(True, np.diff(node) != 0).nonzero()[0] if len(node) else np.zeros(0, np.int64)
        begin = ((np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))) % RECORD == 0).nonzero()[0]
        ends = np.append(begin, len(node)) if len(node) else np.zeros(1, np.int64)
        columns = np.full(len(begin), t), node[begin], np.full(len(begin), scored)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), _records(data, ends)], ["tree", "node", "scored", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        size = 0
        for scored, key, y, bins in _pieces(batches, len(how.edges)):
            taught, asked = (~scored).nonzero()[0], scored.nonzero()[0]
            own = np.ascontiguousarray(key[asked].astype("<i8")).view(np.uint8).reshape(-1, 8)
            questions = np.concatenate([own, bins[asked]], axis=1)
            classes = np.ascontiguousarray(y[taught].astype("<u4")).view(np.uint8).reshape(-1, 4)
            for t in range(how.trees):
                node = walked(tops[t], np.ones(len(key), np.int64), bins)
                w = drawn(key[taught], t, how.seed)
                rows = ((w > 0) & ~np.isin(node[taught], closed[t])).nonzero()[0]
                lessons = np.concatenate([classes[rows], w[rows, None].astype(np.uint8), bins[taught[rows]]], axis=1)
                for batch in (records(t, 0, node[taught[rows]], lessons), records(t, 1, node[asked], questions)):
                    out.append(batch)
                    size += batch.nbytes
                if size > HANDED:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, size = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return run


def _answered(leaves: dict[tuple[int, int], np.ndarray], how: Forest):
    """Records in order of tree, node and scored -> the shares of each row to be scored, added up over some trees."""
    d, k = len(how.edges), how.n_classes

    def handed(keys: list[np.ndarray], shares: list[np.ndarray]) -> pa.RecordBatch:
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums, order = np.concatenate(shares), np.argsort(place, kind="stable")
        sums = np.add.reduceat(sums[order], np.searchsorted(place[order], np.arange(len(found))))
        return pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(np.ascontiguousarray(sums[:, c])) for c in range(k))], ["key", *(f"c{c}" for c in range(k))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lessons, subtree = None, [], None
        keys: list[np.ndarray] = []
        shares: list[np.ndarray] = []
        for batch in batches:
            tree, node, scored = (batch.column(c).to_numpy() for c in ("tree", "node", "scored"))
            bounds = np.append(np.append(0, ((np.diff(tree) != 0) | (np.diff(node) != 0) | (np.diff(scored) != 0)).nonzero()[0] + 1), len(tree)) if len(tree) else [0]
            for first, last in zip(bounds[:-1], bounds[1:], strict=True):
                here = int(tree[first]), int(node[first])
                if here != at:
                    at, lessons, subtree = here, [], None
                data = batch.column("data").slice(first, last - first)
                if not scored[first]:
                    lessons.append(_bytes(data, d + 5))
                    continue
                if subtree is None:
                    rows = np.concatenate(lessons) if lessons else np.zeros((0, d + 5), np.uint8)
                    lessons = []
                    if here in leaves:
                        subtree = (np.zeros(0, np.int64),) * 3, np.array([here[1]]), _shares(leaves[here][None])
                    else:
                        y = np.ascontiguousarray(rows[:, :4]).view("<u4").ravel().astype(np.int64)
                        splits, ends, counts = grown(here[1], here[0], y, rows[:, 4].astype(np.int64), rows[:, 5:], how)
                        subtree = splits, ends, _shares(counts)
                splits, ends, found = subtree
                rows = _bytes(data, d + 8)
                keys.append(np.ascontiguousarray(rows[:, :8]).view("<i8").ravel())
                shares.append(found[np.searchsorted(ends, walked(splits, np.full(len(rows), here[1], np.int64), rows[:, 8:]))])
                if sum(map(len, keys)) >= SCORES:
                    yield handed(keys, shares)
                    keys, shares = [], []
        if keys:
            yield handed(keys, shares)

    return run


def with_probabilities(train: DataFrame, score: DataFrame, n_classes: int, trees: int = 500, depth: int = 20, seed: int = 0, max_bin: int = 32) -> DataFrame:
    """train(features, class_idx[, sample_id]), score(features, ...) -> score with p: the mean class shares of the leaves where a row ends.

    Features are of one length; NaN counts as the largest value. Training rows without features or class are left out; without any, and for rows
    without features, every probability is 0. At most 256 bins. The result reads a table that stays in the shared folder.
    """
    usable = train.where("features IS NOT NULL AND class_idx IS NOT NULL")
    how = Forest(quantile_edges(usable, max_bin), n_classes, trees, depth, seed)
    if not how.edges or not n_classes:
        return score.withColumn("p", F.array_repeat(F.lit(0.0), n_classes))
    numbered = settled(score.withColumn("_row", F.monotonically_increasing_id()), "forest-rows")
    identity = F.col("sample_id") if "sample_id" in train.columns else F.monotonically_increasing_id()
    taught = usable.select(F.lit(0).alias("scored"), F.xxhash64(identity, "class_idx", "features").alias("key"), F.col("class_idx").cast("int").alias("y"), "features")
    asked = numbered.where("features IS NOT NULL").select(F.lit(1).alias("scored"), F.col("_row").alias("key"), F.lit(0).alias("y"), "features")
    schema = "scored int, key long, y int, bins binary"
    rows = settled(taught.union(asked).mapInArrow(_binned(how), schema), "forest")
    tops, leaves = _tops(rows.where("scored = 0"), how)
    session = score.sparkSession
    parts = max(2 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.mapInArrow(_dealt(tops, leaves, how), "tree int, node int, scored int, data binary")
    dealt = dealt.repartition(parts, "tree", "node").sortWithinPartitions("tree", "node", "scored")
    columns = [f"c{c}" for c in range(n_classes)]
    answers = dealt.mapInArrow(_answered(leaves, how), ", ".join(["key long", *(f"{c} long" for c in columns)])).groupBy("key").agg(*(F.sum(c).alias(c) for c in columns))
    answers = settled(answers, "forest-shares")
    removed(rows)
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    p = F.array(*(F.coalesce(F.col(c) / F.nullif(total, F.lit(0)), F.lit(0.0)) for c in columns))
    return numbered.join(answers, F.col("_row") == F.col("key"), "left").select(*score.columns, p.alias("p"))
