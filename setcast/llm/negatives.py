"""Hard-negative mining by bit-sliced integer products.

Anchors are scored against all rows by the inner product of integer vectors, in cells of a block of anchors and a block of rows. A row's components
are taken apart into bit-planes (two's complement). The planes' products with the anchor are added most significant first; what the planes still
missing can add lies between the sum of the anchor's negative components and that of its positive ones, times the planes' weight, so that every row has an interval
that its score lies in and that narrows with each plane. A row goes once its interval shows that it cannot qualify: for positives, when its upper end
is below the lower ends of enough others; for negatives, when its interval misses the score ranges of all positives, or is beaten within them by
enough rows that are sure to lie there. Survivors have all planes: exact scores. The best of each cell then meet per anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .clusters import all_finite, integers
from .common import written

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LEAST, MOST = 30, 90
#: Anchors are the rows whose id this number divides; every so-manyth row gets another label.
ANCHOR, RELABELLED, LABELS = 100, 7, 10
#: Numbers in a block of rows or anchors, so that it takes some MB whatever the vectors' length; anchors that are scored at once.
BLOCK_NUMBERS, AT_ONCE = 1 << 20, 256
#: Integers are cut off there: scores of vectors up to 16,384 components long are exact in 64 bits, and so are their hundredfold.
LIMIT = 1 << 20
_NO_ID = np.iinfo(np.int64).max
_RESULT = "anchor_key long, anchor_id long, place int, positive_id long, positive_score long, id long, score long"


class _Rows:
    """A cell's rows: ids, labels and bit-planes."""

    def __init__(self, part: pa.Table, dim: int):
        self.keys = part["key"].to_numpy()
        self.known = np.asarray(part["vec_id"].is_valid())
        self.ids = part["vec_id"].fill_null(_NO_ID).to_numpy()
        self.labels = part["label"].to_numpy()
        x = _matrix(part, dim)
        self.bits = int(max(x.max(initial=0), -1 - x.min(initial=0))).bit_length()
        self.planes = [((x >> k) & 1).astype(np.float32) for k in range(self.bits + 1)]  # the last has the sign

    def weight(self, k: int) -> int:
        return -(1 << k) if k == self.bits else 1 << k


def _matrix(part: pa.Table, dim: int) -> np.ndarray:
    return part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim).astype(np.int64)


def _spread(scores: np.ndarray) -> np.ndarray:
    """Mean distance from the mean, of each line; a few outliers hardly matter."""
    off = scores - scores.mean(1, keepdims=True)
    return np.abs(off, out=off).mean(1)


def _scores(a: np.ndarray, rows: _Rows):
    """For each anchor of a its partial scores with all rows and how many planes are missing: as soon as the intervals of most anchors are no wider than the scores'
    mean distance from their mean. Before that a good part of the rows would stay, and one product for all of them costs less than picking them for each anchor."""
    kind = np.float32 if np.abs(a).sum(1).max(initial=0) < 1 << 24 else np.float64  # sums of this many bits are exact
    a_t = a.astype(kind)
    total = np.zeros((len(a), len(rows.ids)), np.int64)
    for k in range(rows.bits, -1, -1):
        product = (a_t @ rows.planes[k].astype(kind, copy=False).T).astype(np.int64)
        product *= rows.weight(k)
        total += product
        del product  # as large as the scores: not beside the next one
        if 2 * np.count_nonzero(((1 << k) - 1) * np.abs(a).sum(1) <= _spread(total)) >= len(a):
            break
    return total, k


def _narrowed(a: np.ndarray, rows: _Rows, left: np.ndarray, score: np.ndarray, missing: int, stays) -> tuple[np.ndarray, np.ndarray]:
    """The rows left after all planes and their scores; stays(score, low, high) tells those that can still qualify if low to high may be added."""
    below, above = int(a[a < 0].sum()), int(a[a > 0].sum())
    a_f = a.astype(np.float64)
    while True:
        rest = (1 << missing) - 1
        keep = stays(score, rest * below, rest * above)
        left, score = left[keep], score[keep]
        if not missing or not len(left):
            return left, score
        missing -= 1
        score = score + (rows.planes[missing][left] @ a_f).astype(np.int64) * rows.weight(missing)


def _cut(score: np.ndarray, n: int) -> int:
    """The n-th largest."""
    return np.partition(score, len(score) - n)[len(score) - n]


def _first(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n best, the highest score first, among ties the smallest id."""
    if len(score) > 4 * n:
        near = (score >= _cut(score, n)).nonzero()[0]
        return near[np.lexsort((ids[near], -score[near]))[:n]]
    return np.lexsort((ids, -score))[:n]


def _positives(a, key, label, rows: _Rows, score, missing):
    def stays(s, low, high):
        return s >= _cut(s, POSITIVES) - (high - low) if len(s) > POSITIVES else np.ones(len(s), bool)

    left = ((rows.labels == label) & (rows.keys != key)).nonzero()[0]
    left, exact = _narrowed(a, rows, left, score[left], missing, stays)
    best = _first(exact, rows.ids[left], POSITIVES)
    return left[best], exact[best]


def _ranges(scores: list[int]) -> list[tuple[int, int]]:
    """The least and largest score of a negative to each positive."""
    return [(-(-LEAST * p // 100), MOST * p // 100) for p in scores]


def _negatives(a, label, rows: _Rows, score, missing, ranges):
    some = [r for r in ranges if r[0] <= r[1]]

    def stays(s, low, high):
        out = np.zeros(len(s), bool)
        if some:  # most rows are out of reach of all ranges
            near = ((s >= min(x for x, _ in some) - high) & (s <= max(x for _, x in some) - low)).nonzero()[0]
            s, kept = s[near], out[near]
            for least, most in some:
                may = (s >= least - high) & (s <= most - low)
                sure = s[(s >= least - low) & (s <= most - high)]
                if len(sure) > NEGATIVES:
                    may &= s >= _cut(sure, NEGATIVES) - (high - low)
                kept |= may
            out[near] = kept
        return out

    left = (rows.labels != label).nonzero()[0]
    left, exact = _narrowed(a, rows, left, score[left], missing, stays)
    for place, (least, most) in enumerate(ranges):
        fits = ((exact >= least) & (exact <= most)).nonzero()[0]
        best = fits[_first(exact[fits], rows.ids[left[fits]], NEGATIVES)]
        yield place, left[best], exact[best]


def _cell(negatives: bool):
    """A block of rows and a block of anchors, both of one length: each anchor's best rows of the cell."""

    def run(cell: tuple[pa.Scalar, ...], part: pa.Table, anchors: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in _RESULT.split(", ")}
        dim = cell[0].as_py()
        if len(part) and len(anchors):
            rows, matrix = _Rows(part, dim), _matrix(anchors, dim)
            told = anchors.select([c for c in anchors.column_names if c != "v"]).to_pylist()
            for at in range(0, len(told), AT_ONCE):
                block = matrix[at : at + AT_ONCE]
                scores, missing = _scores(block, rows)
                for a, anchor, score in zip(block, told[at : at + AT_ONCE], scores, strict=True):
                    key, label, known = anchor["key"], anchor["label"], anchor.get("positives") or []
                    if negatives:
                        found = _negatives(a, label, rows, score, missing, _ranges([p["score"] for p in known]))
                    else:
                        found = [(0, *_positives(a, key, label, rows, score, missing))]
                    for place, best, exact in found:
                        n, positive = len(best), known[place] if negatives else {"id": None, "score": None}
                        same = (key, anchor["vec_id"], place, positive["id"], positive["score"])
                        for column, value in zip(out.values(), same, strict=False):
                            column += [value] * n
                        out["id"] += [i if k else None for i, k in zip(rows.ids[best].tolist(), rows.known[best].tolist(), strict=True)]
                        out["score"] += exact.tolist()
        return pa.table({c: pa.array(v, pa.int32() if c == "place" else pa.int64()) for c, v in out.items()})

    return run


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor, its positives and each one's negatives.

    Rows with a null label or vector, or with a null or non-finite component, take no part. Rows are compared with anchors of their own length, so that others are
    no positives or negatives. A row without an id is no anchor, comes last among ties and is returned with a null id. Repeated rows
    are rows of their own: an anchor's copy may be its positive, and a repeated anchor is one anchor for each row. A positive whose score is negative has
    no negatives. Integers are cut off at LIMIT from zero; empty vectors score 0. Other columns are ignored; an empty table gives an empty result.
    """
    vec_id, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    given = F.when(vec_id % RELABELLED == 0, (label + 1) % LABELS).otherwise(label)
    rows = vectors.where(label.isNotNull() & all_finite(vector_col)).select(F.monotonically_increasing_id().alias("key"), vec_id.alias("vec_id"), given.alias("label"), integers(vector_col, LIMIT).alias("v"))
    rows = written(rows.withColumn("dim", F.size("v")), "vectors")
    is_anchor = F.coalesce(F.col("vec_id") % ANCHOR == 0, F.lit(False))
    size = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors"), F.max("dim").alias("dim")).first()
    each = max(1, block_numbers // max(1, size["dim"] or 0))
    down, across = -(-size["n"] // each) or 1, -(-size["anchors"] // each) or 1
    block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cells = rows.withColumn("row_block", block(down)).withColumn("anchor_block", every(across)).groupBy("dim", "anchor_block", "row_block")
    anchors = rows.where(is_anchor).withColumn("anchor_block", block(across)).withColumn("row_block", every(down))

    def best(of: DataFrame, negatives: bool, keep: int) -> DataFrame:
        of = of.select(*(F.col(c).alias(c) for c in of.columns))  # names of its own, as both sides come from one table
        found = cells.cogroup(of.groupBy("dim", "anchor_block", "row_block")).applyInArrow(_cell(negatives), _RESULT)
        order = Window.partitionBy("anchor_key", "place").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)

    positives = written(best(anchors, False, POSITIVES).select("anchor_key", "rank", "id", "score"), "positives")
    known = positives.groupBy(F.col("anchor_key").alias("key")).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("positives"))  # a few each
    found = best(anchors.join(known, "key"), True, NEGATIVES)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13(vectors: DataFrame) -> DataFrame:
    return hard_negatives(vectors)


SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % {RELABELLED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (SELECT vec_id, label, len(v) AS n, unnest(v) AS x, unnest(range(len(v))) AS d FROM kept),
scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, any_value(a.label) = any_value(b.label) AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM points a JOIN points b ON a.d = b.d AND a.n = b.n AND a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR} = 0 GROUP BY a.vec_id, b.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scores s USING (anchor_id)
WHERE NOT s.same AND {LEAST} * positive_score <= 100 * s.score AND 100 * s.score <= {MOST} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= {NEGATIVES}
"""
