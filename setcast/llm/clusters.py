"""Centroid clustering of integer vectors by partial-distance search.

Components become integers, so that distances, sums and means are exact and reruns agree. A vector's squared distance to a centroid is
accumulated over a few dimensions at a time, those of the highest variance first. The centroid that is nearest after the first of them is
finished at once and is the best so far; every other one is abandoned as soon as its partial distance is strictly above that, and those left at the
end have all their dimensions, so that ties are seen and go to the smaller number. A round is one pass over the vectors: tasks hold the
centroids (a fixed number of them) and return sums per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Components of a vector, centroids, rounds; what a component is multiplied by.
DIM, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
SEED = 2
#: Dimensions between two looks at the best distance, rows at once.
STEP, ROWS = 8, 2048
#: Integers are cut off there, so that a squared distance fits 64 bits.
LIMIT = 1 << 27
_LONG = (1 << 63) - 1


def integers(v: Column | str, limit: int = LIMIT) -> Column:
    """array<int>: floor(SCALE * x) of each component, at most limit from zero."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.lit(-float(limit)), F.least(F.lit(float(limit)), x.cast("double") * SCALE))).cast("int"))


def all_finite(v: Column | str) -> Column:
    """No component is null, NaN or infinite; null for a null array."""
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest centroid, among ties the smallest, and the squared distance; order: the dimensions as they are looked at."""
    x, c = x[:, order].astype(np.int64), centroids[:, order]
    number, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), ROWS):
        rows = x[at : at + ROWS]
        start = np.zeros((len(rows), len(c)), np.int64)
        for d in range(min(STEP, x.shape[1])):
            start += np.square(rows[:, d, None] - c[:, d])
        guess = start.argmin(1)
        best = np.square(rows - c[guess]).sum(1)
        row, one = (start <= best[:, None]).nonzero()
        partial = start[row, one]
        for d in range(STEP, x.shape[1], STEP):
            partial += np.square(rows[row, d : d + STEP] - c[one, d : d + STEP]).sum(1)
            left = partial <= best[row]
            row, one, partial = row[left], one[left], partial[left]
        by = np.lexsort((one, partial, row))
        _, first = np.unique(row[by], return_index=True)  # each row has a survivor: its guess
        number[at : at + ROWS], distance[at : at + ROWS] = one[by][first], partial[by][first]
    return number, distance


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def _sums(centroids: np.ndarray, order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            x = _matrix(batch, centroids.shape[1])
            number, _ = nearest(x, centroids, order)
            for c in np.unique(number):
                own = x[number == c]
                n[c] += len(own)
                total[c] += own.sum(0, dtype=np.int64)
        held = n.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held]), pa.array(list(total[held]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _placed(centroids: np.ndarray, order: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = nearest(_matrix(batch, centroids.shape[1]), centroids, order)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def _moved(rows: DataFrame, centroids: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The centroids after a round. The driver gets one number per centroid and dimension."""
    sums = rows.select("v").mapInArrow(_sums(centroids, order), "cluster long, n long, sums array<long>")
    means = sums.select("cluster", "n", F.posexplode("sums").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    moved = centroids.copy()
    for r in means.collect():
        moved[r["cluster"], r["d"]] = int(r["x"]) // r["n"]
    return moved


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly dim components, none null or non-finite; other rows get none, and an empty table gives an empty result. The first centroids
    are the k vectors whose ids have the smallest hashes (all, if fewer); among rows of one id the smallest vector comes first, and rows without an id come
    last. Repeated rows are clustered each. Integers are cut off at LIMIT from zero, sums of distances at the largest long. Other columns
    are ignored.
    """
    rows = vectors.where((F.size(vector_col) == dim) & all_finite(vector_col)).select(F.col(id_col).cast("long").alias("vec_id"), integers(vector_col).alias("v"))
    rows = written(rows, "vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(rank.asc_nulls_last(), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long"
    if not chosen:
        return rows.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    centroids = np.array([r["v"] for r in chosen], np.int64)
    spread = rows.agg(*(F.var_pop(F.get("v", F.lit(d)).cast("double")) for d in range(dim))).first()
    order = np.argsort(-np.array(spread, np.float64), kind="stable")
    for _ in range(rounds):
        centroids = _moved(rows, centroids, order)
    placed = written(rows.mapInArrow(_placed(centroids, order), schema), "clusters")
    held = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.element_at(F.array(*(F.lit(x) for x in values)), F.col("cluster") + 1)
    inertia = F.lit(min(_LONG, sum(held.values()))).cast("long").alias("inertia")
    return placed.select("*", of([min(_LONG, held.get(c, 0)) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"), inertia, of(prints).alias("centroid_sha256"))


def op12(vectors: DataFrame) -> DataFrame:
    return clusters(vectors)


def _sql() -> str:
    """The same in SQL: every distance is computed in full."""
    near = "SELECT vec_id, arg_min(c, (s, c)) AS c, min(s) AS s FROM (SELECT p.vec_id, q.c, sum((p.x - q.x) * (p.x - q.x)) AS s FROM points p JOIN {0} q USING (d) GROUP BY ALL) GROUP BY vec_id"
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})",
        "points AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS d FROM kept)",
        f"firsts AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c, vec_id FROM kept ORDER BY 1 LIMIT {CENTROIDS})",
        "cent0 AS MATERIALIZED (SELECT c, d, x FROM firsts JOIN points USING (vec_id))",
    ]
    for r in range(ROUNDS):
        parts.append(f"near{r} AS MATERIALIZED ({near.format(f'cent{r}')})")
        parts.append(f"mean{r} AS MATERIALIZED (SELECT c, d, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM near{r} JOIN points USING (vec_id) GROUP BY c, d)")
        # // cuts off towards zero: a remainder below zero takes one more
        floor = "(t // n) - CASE WHEN t % n < 0 THEN 1 ELSE 0 END"
        parts.append(f"cent{r + 1} AS MATERIALIZED (SELECT q.c, q.d, coalesce({floor}, q.x) AS x FROM cent{r} q LEFT JOIN mean{r} m ON q.c = m.c AND q.d = m.d)")
    parts.append(f"placed AS MATERIALIZED ({near.format(f'cent{ROUNDS}')})")
    parts.append(f"prints AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS h FROM cent{ROUNDS} GROUP BY c)")
    sums = "CAST(sum(s) OVER (PARTITION BY placed.c) AS BIGINT) AS cluster_inertia, CAST(sum(s) OVER () AS BIGINT) AS inertia"
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(placed.c AS INTEGER) AS cluster, CAST(s AS BIGINT) AS distance, {sums}, h AS centroid_sha256 FROM placed JOIN prints ON placed.c = prints.c"


SQL = _sql()
