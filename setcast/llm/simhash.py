"""SimHash near-duplicates by multi-index hashing.

Fingerprints within `DISTANCE` = 4 bits differ by little in at least one segment: if the segments' radii r fulfil the sum of (r + 1) > 4,
then by the pigeonhole principle every such pair has a segment whose values lie within its radius. Few fingerprints take three
segments of 22, 21 and 21 bits with radii 1, 1 and 0, many take two of 32 bits with radii 2 and 1: whichever looks up less, so that a segment value is
shared by few fingerprints at any size. Each distinct fingerprint is stored once under each of its segments and
looks up the small Hamming ball around each segment; a match is verified over all 64 bits inside the join, so
that only true links leave it. Equal texts share one fingerprint and never make pairs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, small_batches, written

DISTANCE = 4
#: (lowest bit, bits, radius) of each segment.
PLANS = (((0, 22, 1), (22, 21, 1), (43, 21, 0)), ((0, 32, 2), (32, 32, 1)))
SHINGLE = 4
SEED = 42
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a whole text; 0 for null or no word."""
    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())  # bytes.lower: A-Z only
    if not words:
        return 0
    n, ones = max(1, len(words) - shingle + 1), np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):  # bounded memory for any length
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[k : k + shingle]), SEED) for k in range(at, min(n, at + _BLOCK))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def ball(bits: int, radius: int) -> list[int]:
    """All values of so many bits with at most `radius` of them set."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)]


def plan(n: int) -> tuple:
    """The segments that cost n fingerprints the fewest lookups and candidates."""
    return min(PLANS, key=lambda segments: sum(len(ball(bits, radius)) * (1 + n / (1 << bits)) for _, bits, radius in segments))


def links(prints: DataFrame, segments: tuple = PLANS[0]) -> DataFrame:
    """prints(fp), distinct: every pair (a, b), a < b, within DISTANCE bits, found once or more."""
    long = lambda n: F.lit(n).cast("long")
    stored, asked = [], []
    for k, (low, bits, radius) in enumerate(segments):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(long((1 << bits) - 1)).bitwiseOR(long(k << 32))
        around = F.from_json(F.lit(json.dumps(ball(bits, radius))), "array<bigint>")
        stored.append(value)
        asked.append(F.transform(around, lambda x: value.bitwiseXOR(x)))  # noqa: B023  called at once
    have = prints.select(F.col("fp").alias("b"), F.explode(F.array(*stored)).alias("key"))
    ask = prints.select(F.col("fp").alias("a"), F.explode(F.concat(*asked)).alias("key"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    return ask.join(have, (ask["key"] == have["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, fp, row) of every document, row its columns if they are carried; and (fp, component_id, key) of every fingerprint, key
    the first document of its group: the smallest known id, then the smallest hash of the whole row."""
    small_batches(docs.sparkSession)
    row = F.struct(*docs.columns) if carry else F.lit(None).cast("string")
    tie = F.xxhash64(*docs.columns) if carry else F.lit(0).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp"), tie.alias("tie"), row.alias("row"))
    rows = written(rows, "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "tie", "key"))
    prints = written(rows.groupBy("fp").agg(first.alias("first")), "prints")
    roots = components(links(prints.select("fp"), plan(prints.count()))).withColumnRenamed("node", "fp")
    group = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = group.groupBy("root").agg(F.min("first").alias("first"))
    return rows, group.select("fp", "root").join(least, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first_key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (smallest id reachable by links, itself included).

    Null and wordless texts have fingerprint 0 and link like any other; a null id keeps its row and takes the smallest
    known id of its group (null if there is none); repeated rows are all returned; texts of any length count whole; other columns are ignored;
    an empty table gives an empty result.
    """
    rows, groups = _grouped(docs, id_col, text_col, carry=False)
    return rows.join(groups, "fp").select("doc_id", "fp", "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates: that with the smallest known id, among several of that id the one with the
    smallest hash of its columns, so that reruns agree. Documents without an id stand behind all others. All columns stay; other cases as above."""
    rows, groups = _grouped(docs, id_col, text_col, carry=True)
    first = groups.select(F.col("first_key").alias("key")).distinct()
    return rows.join(first, "key", "left_semi").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op3(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
