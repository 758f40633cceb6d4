"""Multi-party perspective rotation: one rendering of a dialogue for each of its speakers.

In a speaker's rendering its own turns are the assistant's and alone carry loss; every other speaker is a named user; system
turns stay system turns and never speak. A rendering longer than `SEGMENT` turns goes on over several rows, with offsets that run
on, so that their texts joined are the rendering and no row is without a bound. DataFrame functions only.

Turns are numbered by one sort over all dialogues, in ranges of their whole keys, so that a dialogue of any size, with any turn numbers, is
spread over tasks; ranges count a dialogue's turns, and its few counts are summed up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: The markers of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM, UNKNOWN = "system", "unknown"
#: Turns of a row.
SEGMENT = 1024


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, name, text, place): a dialogue's turns numbered from 0 in the order of turn, nulls last, role and text."""
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(UNKNOWN)).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    keys = ["conv_id", F.col("turn").isNull(), "turn", "name", "text"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("conv_id", "name", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    ordered = written(ordered, "turns")  # so that ranges and numbers hold
    counts = ordered.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    joined = ordered.join(counts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return joined.select("conv_id", "name", "text", (F.col("id") + F.col("shift")).alias("place"))


def perspectives(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """From turns(conv_id, turn, role, text): a rendering per dialogue and speaker, in rows of so many turns.

    Columns: conv_id, perspective, segment (from 0), start (where the row's text begins in the rendering), n_turns, text, mask (spans
    "start:end" of the rendering that carry loss, in code points, comma-joined), n_masked (code points).
    A speaker is a role other than system; a null role speaks as "unknown", a null text is empty; ties in turn go by
    role, then text, null turns last; repeated rows are repeated turns; a null conv_id is a dialogue of its
    own. A dialogue without a speaker gives no row. Texts of any length stay whole. Other columns are ignored; an empty table gives an empty result.
    """
    places = numbered(turns).withColumn("segment", F.floor(F.col("place") / segment).cast("long"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "name", "text")))
    parts = written(places.groupBy("conv_id", "segment").agg(ordered.alias("turns")), "segments")
    names = parts.select("conv_id", F.explode(F.array_distinct(F.transform("turns", lambda t: t["name"]))).alias("name"))
    speakers = names.where(F.col("name") != SYSTEM).select(F.col("conv_id").alias("own_conv"), F.col("name").alias("perspective")).distinct()
    joined = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("own_conv")))
    own = lambda t: t["name"] == F.col("perspective")
    head = lambda t: F.concat(F.lit(OPEN), F.when(own(t), "assistant").when(t["name"] == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), t["name"])), F.lit("\n"))
    body = lambda t: F.concat(t["text"], F.lit(CLOSE))
    length = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + F.length(head(t)) + F.length(body(t)))
    # Where a segment begins: lengths alone, so that what a dialogue's window holds is a number for each segment.
    sizes = joined.select("conv_id", "perspective", "segment", length.alias("length"))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("segment").alias("s"), F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("start"))
    joined = joined.join(begins, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("segment") == F.col("s")))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), body(t).alias("body"), own(t).alias("own")))
    lengths = F.transform("pieces", lambda p: F.struct(F.length(p["head"]).alias("h"), F.length(p["body"]).alias("b"), p["own"].alias("own")))
    begin = F.struct(F.col("start").alias("at"), F.lit(0).cast("long").alias("masked"), F.array().cast("array<string>").alias("spans"))

    def step(s, p):
        low, high = s["at"] + p["h"], s["at"] + p["h"] + p["b"]
        span = F.array(F.concat_ws(":", low.cast("string"), high.cast("string")))
        return F.struct(high.alias("at"), (s["masked"] + F.when(p["own"], p["b"]).otherwise(0)).alias("masked"), F.when(p["own"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    rendered = joined.select("conv_id", "perspective", "segment", "start", F.size("turns").cast("long").alias("n_turns"), pieces.alias("pieces"))
    rendered = rendered.withColumn("m", F.aggregate(lengths, begin, step))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    return rendered.select("conv_id", "perspective", "segment", "start", "n_turns", text.alias("text"), F.array_join("m.spans", ",").alias("mask"), F.col("m.masked").alias("n_masked"))


def op5(turns: DataFrame) -> DataFrame:
    return perspectives(turns)


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS text FROM conversations
), n AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, name, text) - 1) AS place FROM t
), s AS (
  SELECT DISTINCT conv_id AS own_conv, name AS perspective FROM t WHERE name <> 'system'
), r AS (
  SELECT n.conv_id, s.perspective, n.place, n.place // 1024 AS segment, n.name = s.perspective AS own,
         '<|im_start|>' || CASE WHEN n.name = s.perspective THEN 'assistant' WHEN n.name = 'system' THEN 'system'
                                ELSE 'user name=' || n.name END || chr(10) AS head,
         n.text || '<|im_end|>' || chr(10) AS body
  FROM n JOIN s ON n.conv_id IS NOT DISTINCT FROM s.own_conv
), o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM r
)
SELECT conv_id, perspective, CAST(segment AS BIGINT) AS segment, CAST(min(upto - length(head) - length(body)) AS BIGINT) AS start,
       count(*) AS n_turns, string_agg(head || body, '' ORDER BY place) AS text,
       coalesce(string_agg(CAST(upto - length(body) AS BIGINT) || ':' || CAST(upto AS BIGINT), ',' ORDER BY place) FILTER (WHERE own), '') AS mask,
       CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS n_masked
FROM o GROUP BY conv_id, perspective, segment
"""
