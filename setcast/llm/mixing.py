"""Mixing sources to target weights, in fixed-length blocks of words. DataFrame functions only.

Each source's documents are laid end to end and cut into blocks of `BLOCK` words. The mix is a number of output shards of `SHARD_SLOTS` slots each;
every slot draws its source, so that a shard's counts of sources are multinomial, with the targets as weights. A
source's slots are numbered through the shards, and its slot k takes block perm(k mod blocks), perm a pseudorandom permutation of that
source's block numbers (swap-or-not rounds, a bijection on any number of blocks). Every block is thus taken equally
often, give or take one. No block is taken more than `LIMIT` times: what a source is drawn beyond that, which happens where its target is the
limit itself, is drawn anew among the sources below theirs. Slots, blocks and documents meet in joins by (source, block).

Documents are placed, and shards numbered, by prefix sums in levels: within buckets of a source, then over its buckets, so that a source of any
size is spread over tasks.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hash01, written

BLOCK = 32
SHARE = 1.5
WEIGHTS = (3, 1, 2)
LIMIT = 2.0
SHARD_SLOTS = 4096
#: Sources whose bounds are compared one by one, at most.
CHAIN = 32
#: Sources whose numbers are broadcast, at most.
FEW_SOURCES = 10_000
#: Documents of a bucket, and buckets or shards of a group of them, about.
BUCKET, GROUP = 500, 1024
_ROUNDS = 12


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, limit: float = LIMIT) -> DataFrame:
    """sizes(source, source_size) with target, slots wanted and number: water-filling with a limit for each source.

    Sources in order of code points, null last, have the weights in turn. When limits are met in order of
    limit / weight, the level is that of the first source that need not stop. Sources are few beside documents, and one
    window holds a row for each.
    """
    everything = Window.partitionBy(F.lit(0))
    in_order = everything.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("number") % len(weights)) + 1).cast("int"))
    rows = sizes.withColumn("number", F.row_number().over(in_order) - 1).withColumn("weight", weight)
    rows = rows.withColumn("most", limit * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(everything))
    by_level = everything.orderBy(F.col("most") / F.col("weight"), "number")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weight_left)
    level = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "number", "level"))).over(everything)
    rows = rows.withColumn("met", level["level"])
    return rows.select("source", "number", "source_size", F.when(F.col("met").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("met"))).alias("target"))


def permuted(index: Column, count: Column, key: Column, rounds: int = _ROUNDS) -> Column:
    """A pseudorandom permutation of 0 .. count - 1 that depends on key."""

    def step(x: Column, r: Column) -> Column:
        pivot = F.pmod(F.xxhash64(key, r), count)
        other = F.pmod(pivot - x, count)
        swap = F.xxhash64(key, r, F.greatest(x, other)).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, step)


def before(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """rows(by, order, value), one for each by and order, with name: the sum of value at smaller numbers in order. Two levels, so that no
    window holds more than some GROUP rows, or one for each group."""
    rows = rows.withColumn("_group", F.floor(F.col(order) / GROUP))
    groups = rows.groupBy(by, "_group").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(by).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(F.col(by).alias("_by"), F.col("_group").alias("_at"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(by, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = rows.join(groups, (F.col(by) == F.col("_by")) & (F.col("_group") == F.col("_at")))
    return joined.withColumn(name, (F.col("_own") + F.col("_base")).cast("long")).drop("_group", "_own", "_by", "_at", "_base")


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, source, size, tie, ...) -> the rows with bucket and at (words of its bucket before it), and per bucket its first word in the source."""
    count = docs.count()
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(max(1, count // BUCKET))))
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = docs.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    by_bucket = docs.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    return rows, before(by_bucket, "source", "bucket", "words", "first_word").select("source", "bucket", "first_word")


def drawn(slots: DataFrame, weights: list[tuple[int, float]], seed: int) -> DataFrame:
    """slots(id) -> (shard, number, count): each slot draws a source by weights(number, weight), and the draws of a shard are counted.

    The source is the first whose upper bound in (0, 1] exceeds a hash of the slot: a chain of comparisons for few sources, for many found by halving.
    """
    total, upto, bounds = sum(w for _, w in weights), 0.0, []
    for _, w in weights:
        upto += w
        bounds.append(upto / total)
    counted = lambda rows: rows.groupBy("shard", "number").agg(F.count("*").alias("count"))
    if len(weights) <= CHAIN:
        number = F.lit(weights[-1][0])
        for (n, _), bound in reversed(list(zip(weights[:-1], bounds, strict=False))):
            number = F.when(F.col("u") < bound, n).otherwise(number)
        rows = slots.select(F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), hash01("id", seed=seed).alias("u"))
        return counted(rows.select("shard", number.alias("number")))
    limits = F.from_json(F.lit(json.dumps(bounds[:-1])), "array<double>")
    numbers = F.from_json(F.lit(json.dumps([n for n, _ in weights])), "array<int>")
    u = hash01("id", seed=seed)

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        above = F.get(limits, middle) <= u
        halved = F.struct(F.when(above, middle + 1).otherwise(s["low"]).alias("low"), F.when(above, s["high"]).otherwise(middle).alias("high"))
        return F.when(s["low"] < s["high"], halved).otherwise(s)

    start = F.struct(F.lit(0).alias("low"), F.lit(len(weights) - 1).alias("high"))
    place = F.aggregate(F.sequence(F.lit(1), F.lit(len(weights).bit_length())), start, halve, lambda s: s["low"])
    rows = slots.select(F.floor(F.col("id") / SHARD_SLOTS).alias("shard"), F.get(numbers, place).alias("number"))
    return counted(rows)


class Mix:
    """The plan of a mix. docs: (doc_id, number, size, first, row), first being the first word's place in the source and row all
    columns of the input if they are carried; sources: (source, number, source_size, target, blocks, slots)."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, seed: int = 0, carry: bool = False):
        self.block, self.seed, self._counts = block, seed, None
        row = F.struct(*docs.columns) if carry else F.lit(None).cast("string")
        sized = docs.select("doc_id", "source", size(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), row.alias("row"))
        sized = sized if carry else written(sized, "sizes")
        totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        blocks = F.ceil(F.col("source_size") / block).cast("long")
        slots = F.least(F.round(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1))).cast("long"), int(LIMIT) * F.col("blocks"))
        self.sources = written(targets(totals).withColumn("blocks", blocks).withColumn("slots", slots), "sources")
        self.few = self.sources.count() <= FEW_SOURCES
        numbers = self.sources.select(F.col("source").alias("name"), "number")
        numbered = sized.join(numbers, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", F.col("number").alias("source"), "size", "tie", "row")
        rows, firsts = placed(numbered)
        self.docs = written(rows.join(firsts, ["source", "bucket"]).select("doc_id", F.col("source").alias("number"), "size", (F.col("at") + F.col("first_word")).alias("first"), "row"), "placed")

    def counts(self) -> DataFrame:
        """(shard, number, count, first): a shard's slots of a source, and how many the source has in the shards before. Made once.

        A source whose count would pass its most is cut off there; as many slots as are so left over are drawn again, in shards behind, among
        the sources with room, until none is left over or none has room. The driver holds a row for each source.
        """
        if self._counts is not None:
            return self._counts
        spark = self.sources.sparkSession
        held = [(r["number"], float(r["slots"]), int(LIMIT) * r["blocks"]) for r in self.sources.where("slots > 0").orderBy("number").collect()]
        tables, room, open_slots, first_shard, again = [], {n: most for n, _, most in held}, round(sum(w for _, w, _ in held)), 0, 0
        empty = spark.createDataFrame([], "shard long, number int, count long, first long")
        taken = dict.fromkeys(room, 0)
        while open_slots > 0 and (weights := [(n, w) for n, w, _ in held if room[n] > 0]):
            tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), open_slots >> 20)
            found = drawn(spark.range(0, open_slots, 1, min(tasks, -(-open_slots // SHARD_SLOTS))), weights, self.seed * 1000 + 1 + again)
            found = before(found.withColumn("shard", (F.col("shard") + first_shard).cast("long")), "number", "shard", "count", "first")
            if len(weights) <= CHAIN:
                of = lambda held: F.element_at(F.create_map(*(F.lit(x) for n, _ in weights for x in (n, held[n]))), F.col("number"))  # noqa: B023,E731  called at once
                left, earlier = of(room), of(taken)
            else:  # many sources' numbers are a table, not a part of the plan
                rooms = spark.createDataFrame([(n, room[n], taken[n]) for n, _ in weights], "n int, room long, taken long")
                found = found.join(F.broadcast(rooms) if len(weights) <= FEW_SOURCES else rooms, F.col("number") == F.col("n"))
                left, earlier = F.col("room"), F.col("taken")
            found = found.withColumn("count", F.greatest(F.lit(0), F.least("count", left - F.col("first"))).cast("long"))
            found = written(found.select("shard", "number", "count", (F.col("first") + earlier).cast("long").alias("first")).where("count > 0"), "shards")
            tables.append(found)
            got = {r["number"]: r["n"] for r in found.groupBy("number").agg(F.sum("count").alias("n")).collect()}
            for n, k in got.items():
                room[n] -= k
                taken[n] += k
            first_shard += -(-open_slots // SHARD_SLOTS)
            open_slots -= sum(got.values())
            again += 1
        self._counts = reduce(DataFrame.union, tables, empty) if tables else empty
        return self._counts

    def slots(self) -> DataFrame:
        """(number, slot, shard, place, block): the block that each slot takes, and its place in its shard. Shards are dealt out over tasks."""
        spark, counts = self.sources.sparkSession, self.counts()
        within = Window.partitionBy("shard").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("begin", F.coalesce(F.sum("count").over(within), F.lit(0)))
        about = F.broadcast(self.sources.select(F.col("number").alias("n"), "blocks")) if self.few else self.sources.select(F.col("number").alias("n"), "blocks")
        total = counts.agg(F.sum("count")).first()[0] or 0
        # Counts are few bytes but much work: a fixed number of tasks keeps them from being merged into one.
        tasks = max(1, min(-(-total // SHARD_SLOTS), max(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 20)))
        rows = counts.join(about, F.col("number") == F.col("n")).repartition(tasks, "shard", "number")
        rows = rows.select("number", "shard", "begin", "first", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("slot"))
        key = F.xxhash64(F.lit(self.seed), "number", F.floor(F.col("slot") / F.col("blocks")))
        block = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), key)
        return rows.select("number", "slot", "shard", (F.col("begin") + F.col("slot") - F.col("first")).alias("place"), block.alias("block"))

    def pieces(self) -> DataFrame:
        """(doc_id, number, first, block, low, high): words [low, high) of a document lie in a block of its source."""
        last = F.floor((F.col("first") + F.col("size") - 1) / self.block)
        rows = self.docs.where("size > 0").select("doc_id", "number", "first", "size", F.explode(F.sequence(F.floor(F.col("first") / self.block), last)).alias("block"))
        low = F.greatest(F.col("block") * self.block - F.col("first"), F.lit(0))
        high = F.least((F.col("block") + 1) * self.block - F.col("first"), F.col("size"))
        return rows.select("doc_id", "number", "first", "block", low.alias("low"), high.alias("high"))

    def _times(self) -> DataFrame:
        # Its size is that of the mix, which the planner cannot tell from the few chunks it starts with: never to be broadcast.
        return self.slots().groupBy("number", "block").agg(F.count("*").alias("times")).hint("merge")

    def taken(self) -> DataFrame:
        """(doc_id, size, source, source_size, target, taken) for every document; one with words is known by its source and first word."""
        words = ((F.col("high") - F.col("low")) * F.col("times")).alias("words")
        used = self.pieces().join(self._times(), ["number", "block"]).select("number", "first", words).groupBy("number", "first").agg(F.sum("words").alias("taken"))
        docs = self.docs.drop("row")
        rows = docs.where("size > 0").join(used, ["number", "first"], "left").unionByName(docs.where("size = 0"), allowMissingColumns=True)
        about = self.sources.select("number", "source", "source_size", "target")
        return rows.join(about, "number").select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def order(self) -> DataFrame:
        """The mix itself: (shard, place, number, slot, doc_id, low, high), the words [low, high) of a document in each slot of each output shard."""
        return self.slots().hint("merge").join(self.pieces(), ["number", "block"]).select("shard", "place", "number", "slot", "doc_id", "low", "high")

    def texts(self) -> DataFrame:
        """Needs carry: the input's columns, text now the words that the mix takes (see mixed_texts)."""
        passes = self.pieces().join(self._times(), ["number", "block"]).select("number", "first", "low", "high", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("pass"))
        ranges = passes.groupBy("number", "first", "pass").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("ranges"))
        rows = self.docs.where("size > 0").select("number", "first", "row").join(ranges, ["number", "first"])
        words = F.regexp_extract_all("row.text", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
        # The lambda's variable holds the words: a column that is used once inside a lambda would be computed anew for every range.
        taken = lambda w: F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice(w, r["low"].cast("int") + 1, (r["high"] - r["low"]).cast("int")))), "")
        text = F.element_at(F.transform(F.array(words), taken), 1)
        given = self.docs.schema["row"].dataType.names
        rows = rows.withColumn("new_text", text)
        return rows.select(*((F.col("new_text") if c == "text" else F.length("new_text").cast("long") if c == "n_chars" else F.col("row")[c]).alias(c) for c in given))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> Mix:
    """Plan a mix of docs(doc_id, text, source).

    A null text has size 0, a null source is a source (the last); documents of size 0 take 0 words; repeated rows and ids are
    documents of their own, in the order of a hash of their texts; other columns are ignored; an empty table
    gives an empty mix; texts of any length, and a source that dominates all others, are taken like any. Reruns agree: all draws are hashes. A
    source's taken words lie about its target as the draws do: with n slots of a share p, by about sqrt(n p (1 - p)) slots.
    """
    return Mix(docs, block, seed)


def mixed_texts(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """docs as the mix takes them: a row for each document and pass (a second one for words taken twice), whose text is
    the words taken, each with the white space after it, and whose n_chars, where there is such a column, follows the text. Other columns stay.
    Documents of which nothing is taken go. Nulls, ties and empty tables as in mix().
    """
    return Mix(docs, block, seed, carry=True).texts()


def op9(docs: DataFrame) -> DataFrame:
    return mix(docs).taken().select("doc_id", "size", "source_size", "target", "taken")
