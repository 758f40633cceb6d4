"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a fixed lexicon and of a learned one, their nearness to the second person, capitals,
punctuation and obfuscation. The learned lexicon, the trees and the calibration come from a bounded sample of
labelled rows, about `SAMPLE` of them chosen by a hash of the id; calibration rows never train the trees.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, hash01, small_batches, written

SAMPLE = 20_000
#: A learned word is in so many sampled documents, that many times likelier toxic than others, and one of the so many strongest.
LEARNED_DOCS, LEARNED_ODDS, LEARNED_WORDS = 5, 3.0, 200
#: Words of abuse, and pronouns of the second person.
ABUSE = frozenset("idiot idiots moron morons stupid dumb fool fools loser losers scum trash garbage pathetic worthless clown clowns imbecile vermin filth filthy disgusting ugly bitch bastard asshole shit fuck fucking damn crap jerk creep coward liar pig rat hate kill die dumbass retard".split())
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vos".split())
_NEAR = 5
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
_TRIM = "\"'()[]{}<>.,;:!?#$%&*|-_~/\\"
_UPPER, _LOWER, _MARKS = bytes(range(65, 91)), bytes(range(97, 123)), b"!?"
FEATURES = ("abuse_density", "abuse_count", "learned_density", "learned_count", "learned_weight", "second_density", "near_density", "near_count", "capital_share", "mark_rate", "obfuscated_rate", "obfuscated_abuse", "log_words")


def _words(text: str | None) -> list[tuple[str, bool]]:
    """Lower-case words without outer punctuation; and whether letters are mixed with other signs inside."""
    out = []
    for token in _TOKEN.findall(text or ""):
        word = token.strip(_TRIM).lower()
        if word.isalpha() or not word:
            out.append((word, False))
        else:
            mixed = any(c.isalpha() for c in word) and any(c in "013457@$!*" for c in word)
            out.append((word.translate(_PLAIN) if mixed else word, mixed))
    return out


def features(text: str | None, learned: dict[str, float]) -> list[float]:
    words = _words(text)
    n, raw = max(1, len(words)), (text or "").encode("utf-8", "surrogatepass")
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    abuse = second = near = obfuscated = hidden = hits = 0
    weight, last_you, last_hit = 0.0, -1000, -1000
    for k, (word, mixed) in enumerate(words):
        obfuscated += mixed
        bad, strength = word in ABUSE, learned.get(word)
        if bad or strength:
            abuse += bad
            hits += strength is not None
            weight += strength or 0.0
            hidden += mixed
            near += k - last_you <= _NEAR
            last_hit = k
        if word in SECOND:
            second += 1
            near += k - last_hit <= _NEAR
            last_you = k
    upper = without(_UPPER)
    return [abuse / n, abuse, hits / n, hits, weight / math.sqrt(n), second / n, near / n, near, upper / max(1, upper + without(_LOWER)), without(_MARKS) / n, obfuscated / n, hidden, math.log1p(len(words))]


@F.udf(T.ArrayType(T.StringType()), useArrow=True)
def _distinct_words(text):
    return sorted({w for w, _ in _words(text) if w})


def held_out() -> Column:
    """Rows whose labels are never read; false for a null id, whose rows have no labels."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """sample(text, toxic) -> {word: log odds}, at most LEARNED_WORDS."""
    sums = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    words = sample.select("toxic", F.explode(_distinct_words("text")).alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    odds = ((F.col("t") + 0.5) / (sums["t"] + 1)) / ((F.col("n") - F.col("t") + 0.5) / (sums["n"] - sums["t"] + 1))
    strong = words.where(F.col("t") >= LEARNED_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEARNED_ODDS)
    return {r["word"]: math.log(r["odds"]) for r in strong.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "word").limit(LEARNED_WORDS).collect()}


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and score for every row of docs(doc_id, text), learned from labels(doc_id, toxic) outside the held-out rows.

    Null and empty texts are scored like any other, as texts without words. A document labelled twice is toxic if any label
    says so; null labels and ids teach nothing. With no label of either class, every score is the share of toxic labels, 0 if there is none.
    Repeated rows are scored alike; a score of 0.5 is predicted toxic; texts of any length count whole; other columns are ignored; an empty table gives an empty result.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    seen = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    small_batches(docs.sparkSession)
    marks = written(marks.where(hash01("doc_id", seed=23) < sample / max(1, seen["n"])), "toxic-marks")
    few = F.broadcast(marks) if marks.count() <= 4 * sample else marks  # an id and a number each: texts stay where they are
    plain = docs.select("doc_id", "text")
    texts = written(plain.join(few, "doc_id").select("doc_id", "text", "toxic"), "toxic-sample")
    spread = texts.agg(F.min("toxic"), F.max("toxic")).first()
    if spread[0] == spread[1]:
        return plain.select("doc_id", F.lit(seen["t"] / max(1, seen["n"])).alias("score"))
    learned = learn_lexicon(texts.where(hash01("doc_id", seed=29) < 0.5))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def dense(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[float(x) for x in features(t, learned)] for t in batch], dtype=object)

    ready = written(texts.select("doc_id", "toxic", dense("text").alias("x")), "toxic-features")
    vectors = ready
    ready = ready.select("doc_id", F.col("toxic").cast("double").alias("label"), array_to_vector("x").alias("features"))
    for_trees = hash01("doc_id", seed=31) < 0.7
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, maxBins=32, seed=1).fit(ready.where(for_trees).repartition(4))
    chance = lambda df: trees.transform(df).withColumn("p", vector_to_array("probability")[1])
    isotonic = IsotonicRegression(featuresCol="p").fit(chance(ready.where(~for_trees)).select("label", "p"))
    for used in (marks, texts, vectors):
        dropped(used)
    scored = isotonic.transform(chance(plain.select("doc_id", array_to_vector(dense("text")).alias("features"))).select("doc_id", "p"))
    return scored.select("doc_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "prediction")).alias("score"))


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = toxicity(docs, labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
