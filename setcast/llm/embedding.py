"""Near-duplicate embeddings: an exact metric range join within equal labels and lengths.

Unit vectors with cosine >= c lie within r = sqrt(2 - 2c) of each other. Vectors go to the cell of the nearest pivot of their own label and length; a label's
pivots, about twice the square root of its vectors, meet shares of these in tasks, so that neither the driver nor a broadcast holds them.
For a pair x, y within r the triangle inequality gives d(x, p) <= d(x, own) + 2r for y's pivot p, and, in
Euclidean space, x lies within r of the plane between the two pivots: (d(x, p)^2 - d(x, own)^2) / (2 d(p, own)) <= r, which includes the former.
x meets just the cells that pass. Neighbouring cells make up a block, and x is sent to a block once, however many of its cells it meets: in many dimensions
these are some tenth of all, and a copy for each would take many times the input. Of two blocks only one sends visitors to the other, so that a pair meets in one block.
A task holds the vectors of one block and reads its visitors as they come, so that its memory does not depend on how many these are. Cells that meet are compared by a
few leading dimensions and the length of the rest, which bound the cosine from above; what passes is compared in double precision. Equal vectors are one vector with a
multiplicity; a block with too many vectors is cut into parts. Blocks meet their visitors in rounds, so that no more than a few times the vectors are under way at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import collected, components, dropped, hash01, small_batches, written

COSINE = 0.98
#: Numbers in a block of vectors: at most; and at least, if a label has so many. In between a label has as many blocks as this.
BLOCK_NUMBERS, LEAST_NUMBERS, BLOCKS = 1 << 24, 1 << 19, 8
#: Vectors of a label and length that meet its pivots in a task, about; fewer if they have more than 64 numbers.
SHARE_ROWS = 1 << 15
#: Times the vectors that are on their way to blocks in one round, about.
ROUND = 2
#: Distances to pivots computed at once.
_AT_ONCE = 1 << 21
_SLACK = 1e-9
#: Leading dimensions that bound a cosine, with the length of the rest; what single precision may take from a bound, and for each dimension of a product.
_LEADING, _ROUNDING, _EACH = 20, 1e-5, 5e-7
#: Vectors compared with visitors at once, and visitors; numbers in either, at most.
_STRIP, _CHUNK, _NUMBERS = 1024, 4096, 1 << 19
#: Links that wait to be united.
_PENDING = 1 << 16


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _single(vectors: np.ndarray) -> np.ndarray:
    return _unit(vectors.astype(np.float64)).astype(np.float32)


def _matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _valid(v: str) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(v).isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _visits(own: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Whether a vector of the block own visits another: of any two blocks, one does."""
    return ((own + blocks) % 2 == 1) == (blocks < own)


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, at least, whatever single precision takes."""
    return np.sqrt(np.maximum(0, 2 - 2 * a @ b.T) + np.float32(2 * _EACH * a.shape[1] + _ROUNDING))


def _near(products: np.ndarray, most: np.ndarray, gaps: np.ndarray, radius: float, dim: int) -> np.ndarray:
    """Whether vectors can have a neighbour in cells: products with the cells' pivots, with the pivots of their own cells, and the distances between these pivots."""
    return products >= most[:, None] - np.float32(radius) * gaps - np.float32(_EACH * dim + _ROUNDING)


def _ordered(chosen: pa.Table) -> pa.Table:
    """A label's pivots, numbered so that neighbours have near numbers."""
    chosen = chosen.sort_by([("key", "ascending"), ("key2", "ascending")])
    p = _single(_matrix(chosen["v"]))
    order = (p @ p[: math.isqrt(len(p) - 1) + 1].T).argmax(1).argsort(kind="stable")
    return chosen.select(["label", "dim", "v"]).take(pa.array(order)).append_column("cell", pa.array(np.arange(len(p), dtype=np.int32)))


def _cells(radius: float):
    """A share of a label's vectors and its pivots: each vector's cell and block, and the blocks it visits. Without pivots there is one cell."""

    def assign(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        n, k = rows.num_rows, pivots.num_rows
        cell, block, visits, sizes = np.zeros(n, np.int32), np.zeros(n, np.int32), [], np.zeros(n, np.int32)
        if n and k:
            x, p = _matrix(rows["v"]), _single(_matrix(pivots.sort_by("cell")["v"]))
            blocks = min(k, rows["blocks"][0].as_py())
            of = np.arange(k) * blocks // k
            starts, step = np.searchsorted(of, np.arange(blocks)), max(16, _AT_ONCE // k)
            for at in range(0, n, step):
                products = _single(x[at : at + step]) @ p.T
                own = products.argmax(1)
                near = _near(products, products[np.arange(len(own)), own], _gaps(p[own], p), radius, p.shape[1])
                sent = np.logical_or.reduceat(near, starts, 1) & _visits(of[own][:, None], np.arange(blocks))
                sent[np.arange(len(own)), of[own]] = False
                cell[at : at + step], block[at : at + step], sizes[at : at + step] = own, of[own], sent.sum(1)
                visits.append(sent.nonzero()[1].astype(np.int32))
        visits = pa.ListArray.from_arrays(pa.array(np.append(0, sizes.cumsum()).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *visits])))
        rows = rows.select(["label", "dim", "most", "node", "copies", "v"])
        return rows.append_column("cell", pa.array(cell)).append_column("block", pa.array(block)).append_column("visits", visits)

    return assign


def _codes(x: np.ndarray, directions: np.ndarray | None) -> np.ndarray:
    """Numbers whose products are at least the cosines: some dimensions of a rotation, and the length of the others."""
    if directions is None:
        return x.astype(np.float32)
    lead = x @ directions
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", lead, lead)))
    return np.column_stack([lead, rest]).astype(np.float32)


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Have a and b the same root, the smallest of their group; root holds each group's root throughout."""
    while len(a):
        a, b = root[a], root[b]
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        np.minimum.at(root, b, a)
        while (root[root] != root).any():
            root[:] = root[root]


class _Block:
    """A block in a task: its pivots come first, then its own vectors by cell, which meet one another, then its visitors. Links of vectors, and one vector of each's group."""

    def __init__(self, cosine: float, radius: float):
        self.cosine, self.radius = cosine, radius
        self.pivots, self.parts, self.strips, self.visitors, self.waiting, self.met = [], [], [], [], 0, False
        self.links, self.pending = [], 0

    def add(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        role = rows.column("role").to_numpy()
        first, last = np.searchsorted(role, (1, 2))
        v = _matrix(rows.column("v"))
        self.strip, self.chunk = (max(16, min(x, _NUMBERS // v.shape[1])) for x in (_STRIP, _CHUNK))
        cell, node, copies = (rows.column(c).to_numpy() for c in ("cell", "node", "copies"))
        if first:
            self.pivots.append(v[:first].copy())
        for x, at, to in ((self._own, first, last), (self._visit, last, len(role))):
            if at < to:
                yield from x(cell[at:to].copy(), node[at:to].copy(), copies[at:to].astype(np.float64), v[at:to].copy())

    def _own(self, *rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Vectors of the block, in strips of one cell."""
        cuts = [0, *(np.flatnonzero(np.diff(rows[0])) + 1), len(rows[0])]
        for at, to in zip(cuts, cuts[1:], strict=False):
            if self.parts and self.parts[0][0][0] != rows[0][at]:
                self._strip()
            self.parts.append([x[at:to] for x in rows])
            if sum(len(x[0]) for x in self.parts) >= self.strip:
                self._strip()
        return iter(())

    def _strip(self) -> None:
        self.strips.append([np.concatenate(x) for x in zip(*self.parts, strict=True)])
        self.parts = []

    def _visit(self, *rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.visitors.append(rows)
        self.waiting += len(rows[0])
        if self.waiting >= self.chunk:
            yield from self._flush()

    def _meet_own(self) -> None:
        if self.parts:
            self._strip()
        self.met = True
        if not self.strips:
            return
        dim = self.strips[0][3].shape[1]
        self.directions = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, _LEADING - 1)))[0] if dim > _LEADING else None
        self.p = _single(np.concatenate(self.pivots)) if self.pivots else None
        self.nodes, self.copies = (np.concatenate([s[x] for s in self.strips]) for x in (1, 2))
        self.starts = np.append(0, np.cumsum([len(s[1]) for s in self.strips]))
        self.cells, self.cell_of = np.unique([s[0][0] for s in self.strips], return_inverse=True)
        self.gaps = None if self.p is None else _gaps(self.p, self.p[self.cells])
        self.counts, self.root = np.zeros(len(self.nodes)), np.arange(len(self.nodes))
        self.codes = []
        for k, (cell, _, copies, v) in enumerate(self.strips):
            x, at = _unit(v.astype(np.float64)), slice(self.starts[k], self.starts[k + 1])
            self.codes.append(_codes(x, self.directions))
            self._meet(x, cell, copies, np.arange(at.start, at.stop), self.counts[at], k + 1, True)

    def _flush(self) -> Iterator[pa.RecordBatch]:
        if not self.met:
            self._meet_own()
        if self.visitors and self.strips:
            cell, node, copies, v = (np.concatenate(x) for x in zip(*self.visitors, strict=True))
            for at in range(0, len(node), self.chunk):
                part = slice(at, at + self.chunk)
                first, counts = np.full(len(node[part]), -1), np.zeros(len(node[part]))
                self._meet(_unit(v[part].astype(np.float64)), cell[part], copies[part], first, counts, len(self.strips), False)
                if (any_ := first >= 0).any():
                    yield self._batch(node[part][any_], counts[any_], self.nodes[first[any_]])
        self.visitors, self.waiting = [], 0

    def _meet(self, x: np.ndarray, cell: np.ndarray, copies: np.ndarray, first: np.ndarray, counts: np.ndarray, strips: int, own: bool) -> None:
        """Vectors x and so many strips of the block: counts of links of either side; first gets a vector of the block that x links to. own: x is the last of the strips."""
        near = None
        if self.p is not None:
            single = x.astype(np.float32)
            near = _near(single @ self.p[self.cells].T, np.einsum("ij,ij->i", single, self.p[cell]), self.gaps[cell], self.radius, x.shape[1])
            near = np.ascontiguousarray(near.T)
        codes, most = _codes(x, self.directions), self.cosine - _ROUNDING
        for k in range(strips):
            itself = own and k == strips - 1
            cols = np.arange(len(x)) if near is None or itself else np.flatnonzero(near[self.cell_of[k]])
            if not len(cols):
                continue
            hit = self.codes[k] @ (codes if len(cols) == len(x) else codes[cols]).T >= most
            if itself:
                hit = np.triu(hit, 1)
            if not (n := np.count_nonzero(hit)):
                continue
            rows, met = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
            if 4 * n > len(rows) * len(met):
                hit = hit[np.ix_(rows, met)]
                hit &= _unit(self.strips[k][3][rows].astype(np.float64)) @ x[cols[met]].T >= self.cosine
                self._many(rows + self.starts[k], cols[met], hit, copies, first, counts)
            else:
                a, b = hit.nonzero()
                for at in range(0, n, self.chunk):
                    i, j = a[at : at + self.chunk], cols[b[at : at + self.chunk]]
                    fine = np.einsum("ij,ij->i", _unit(self.strips[k][3][i].astype(np.float64)), x[j]) >= self.cosine
                    self._some(i[fine] + self.starts[k], j[fine], copies, first, counts)

    def _some(self, p: np.ndarray, q: np.ndarray, copies: np.ndarray, first: np.ndarray, counts: np.ndarray) -> None:
        np.add.at(self.counts, p, copies[q])
        np.add.at(counts, q, self.copies[p])
        new = first[q] < 0
        first[q[new]] = p[new]
        self._link(first[q], p)

    def _many(self, p: np.ndarray, q: np.ndarray, hit: np.ndarray, copies: np.ndarray, first: np.ndarray, counts: np.ndarray) -> None:
        numbers = hit.astype(np.float64)
        self.counts[p] += numbers @ copies[q]
        counts[q] += self.copies[p] @ numbers
        new = (first[q] < 0) & hit.any(0)
        first[q[new]] = p[hit.argmax(0)[new]]
        a, b = (hit & (self.root[p][:, None] != self.root[first[q]])).nonzero()
        self._link(first[q[b]], p[a])

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        apart = self.root[a] != self.root[b]
        self.links.append((a[apart], b[apart]))
        self.pending += 1 + apart.sum()
        if self.pending > _PENDING:
            self._unite()

    def _unite(self) -> None:
        if self.links:
            _unite(self.root, *(np.concatenate(x) for x in zip(*self.links, strict=True)))
        self.links, self.pending = [], 0

    def _batch(self, node: np.ndarray, n: np.ndarray, tree: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "n": pa.array(n.astype(np.int64)), "tree": pa.array(tree, pa.int64())})

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self._flush()
        if self.strips:
            self._unite()
            linked = (self.counts > 0) | (self.root != np.arange(len(self.root)))
            yield self._batch(self.nodes[linked], self.counts[linked], self.nodes[self.root[linked]])


def _block_links(cosine: float, radius: float):
    """Tasks, one after another: how many vectors each vector links to in a task, and a vector of its group."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, task = None, None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in ("task", "task2")])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)] if len(keys) else []
            for at, to in zip(cuts, cuts[1:], strict=False):
                if task != (now := tuple(keys[at])):
                    if block:
                        yield from block.end()
                    block, task = _Block(cosine, radius), now
                yield from block.add(batch.slice(at, to - at))
        if block:
            yield from block.end()

    return match


def _tasks(once: DataFrame, radius: float, block_numbers: int) -> tuple[DataFrame, int]:
    """Rows for the tasks, (task, task2, role, cell, node, copies, v): pivots (role 0), a block's vectors (1) and visitors (2); how many rounds they take."""
    label_type, v_type, dims = once.schema["label"].dataType.simpleString(), once.schema["v"].dataType.simpleString(), F.greatest("dim", F.lit(1))
    task = [F.xxhash64("label", "dim", "block", "part").alias("task"), F.xxhash64(F.lit(17), "part", "block", "dim", "label").alias("task2")]
    columns = ["role", "cell", "node", "copies", "v"]
    # A label's vectors of one length, if they fill more than a block, are dealt into shares, and each share meets all pivots of its label, chosen by a hash and
    # numbered once. Fewer vectors are one cell. There are few such labels, as each has many vectors.
    numbers = F.col("n") * dims
    most = F.least(F.lit(block_numbers), F.greatest(F.lit(LEAST_NUMBERS), F.ceil(numbers / BLOCKS))).cast("long")
    sizes = once.groupBy("label", "dim").agg(F.count("*").alias("n")).withColumn("most", most).where(numbers > F.col("most"))
    sizes = sizes.select("label", "dim", "n", "most", F.ceil(F.col("n") * F.greatest(dims, F.lit(64)) / 64 / SHARE_ROWS).cast("int").alias("shares"), F.floor(F.sqrt("n") * 2).alias("k"), F.ceil(numbers / F.col("most")).cast("int").alias("blocks"))
    sizes = written(sizes, "sizes")  # read thrice
    alone = [F.lit(0).alias("block"), F.lit(0).alias("part"), F.lit(1).alias("role"), F.lit(0).alias("cell")]
    if sizes.isEmpty():
        dropped(sizes)
        return once.select("label", "dim", "node", "copies", "v", *alone).select(*task, *columns), 1
    few = once.join(F.broadcast(sizes), ["label", "dim"], "left_anti")
    many = once.join(F.broadcast(sizes), ["label", "dim"])
    chosen = many.where(hash01("key", "key2", seed=7) < F.col("k") / F.col("n")).select("label", "dim", "v", "key", "key2")
    pivots = written(chosen.groupBy("label", "dim").applyInArrow(_ordered, f"label {label_type}, dim int, v {v_type}, cell int"), "pivots")
    by = ["label", "dim", "share"]
    shared = pivots.join(F.broadcast(sizes), ["label", "dim"]).select("label", "dim", "cell", "v", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    many = many.select("label", "dim", F.pmod(F.xxhash64("node", F.lit(5)), F.col("shares")).cast("int").alias("share"), "most", "blocks", "node", "copies", "v")
    schema = f"label {label_type}, dim int, most long, node long, copies long, v {v_type}, cell int, block int, visits array<int>"
    placed = many.groupBy(*by).cogroup(shared.groupBy(*by)).applyInArrow(_cells(radius), schema)
    placed = written(placed.unionByName(few.select("label", "dim", F.lit(None).cast("long").alias("most"), "node", "copies", "v", F.lit(0).alias("cell"), F.lit(0).alias("block"), F.lit(None).cast("array<int>").alias("visits"))), "cells")
    dropped(once)
    dropped(sizes)
    collected(once.sparkSession)
    # Blocks of half as many vectors again as they should have are cut into parts; vectors of one part visit others as those of blocks do.
    parts = F.greatest(F.lit(1), F.ceil(F.count("*") * F.first(dims) / F.first("most") / 1.5)).cast("int")
    parts = written(placed.where("most IS NOT NULL").groupBy("label", "dim", "block").agg(parts.alias("parts")), "parts")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    own = placed.join(F.broadcast(parts), ["label", "dim", "block"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    own = own.withColumn("part", F.explode(F.filter(every, lambda o: (o == F.col("own")) | (((o + F.col("own")) % 2 == 1) == (o < F.col("own"))))))
    own = own.withColumn("role", F.when(F.col("part") == F.col("own"), 1).otherwise(2))
    visitors = placed.where("most IS NOT NULL").select("label", "dim", F.explode("visits").alias("block"), "cell", "node", "copies", "v")
    visitors = visitors.join(F.broadcast(parts), ["label", "dim", "block"]).withColumn("part", F.explode(every)).withColumn("role", F.lit(2))
    leading = pivots.join(F.broadcast(parts), ["label", "dim"]).withColumn("part", F.explode(every)).select("label", "dim", "block", "part", F.lit(0).alias("role"), "cell", F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("copies"), "v")
    tasks = own.select("dim", *task, *columns).union(visitors.select("dim", *task, *columns)).union(leading.select("dim", *task, *columns))
    sent = tasks.agg(F.sum(dims)).first()[0] / placed.agg(F.sum(dims)).first()[0]
    return tasks.drop("dim"), math.ceil(sent / ROUND)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept (vec_id = component_id).

    A vector that is null, zero, or with null or non-finite components, and one without a label, has no links and is
    its own component; vectors link to those of their own length. Repeated rows link to each other as equal vectors;
    rows without an id count as vectors but are left out of the smallest id, so that a group of such rows alone has
    a null component and is not kept. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    element = vectors.schema[vector_col].dataType
    kind = "array<float>" if isinstance(element, T.ArrayType) and isinstance(element.elementType, T.FloatType) else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"), F.col(label_col).alias("label"))
    rows = rows.withColumn("v", F.when(_valid("v") & F.col("label").isNotNull(), F.col("v")))
    small_batches(spark)
    # 128 bits tell vectors apart.
    rows = written(rows.withColumn("key", F.xxhash64("label", "v")).withColumn("key2", F.xxhash64(F.lit(17), "v", "label")), "vectors")
    unlinked = lambda r: r.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = lambda r: r.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    usable = rows.where("v IS NOT NULL")
    if usable.isEmpty():
        return kept(unlinked(rows))
    once = usable.groupBy("key", "key2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    once = written(once.withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    # Vectors are kept once at a time: what the result needs besides them goes into tables of its own.
    ids = written(rows.select("vec_id", "key", "key2", F.col("v").isNull().alias("alone")), "ids")
    dropped(rows)
    nodes = written(once.select("node", "key", "key2", "copies", "first_id"), "nodes")
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK
    tasks, rounds = _tasks(once, radius, block_numbers)
    found = None
    for k in range(rounds):
        ready = tasks.where(F.pmod("task", F.lit(rounds)) == k).repartition("task", "task2").sortWithinPartitions("task", "task2", "role", "cell")
        part = written(ready.mapInArrow(_block_links(cosine, radius), "node long, n long, tree long"), "found")
        found = part if found is None else found.union(part)
        del ready
        if rounds > 1:
            collected(spark)
    dropped(tasks)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.where("tree <> node").select(F.col("node").alias("a"), F.col("tree").alias("b")))
    group = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = group.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_node = group.join(least, "root").join(counts, "node", "left").select("key", "key2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = ids.where("NOT alone").join(by_node, ["key", "key2"]).select("vec_id", "n_links", "component_id")
    return kept(linked.union(unlinked(ids.where("alone"))))


def op4(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
