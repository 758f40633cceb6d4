"""Hierarchical language identification.

The language family is predicted first, by multinomial logistic regression; within the family, one-versus-one linear
support vector machines separate its languages, the most votes winning. Both use hashed character 1- to 3-grams of
whole texts (letters alone, lower case, square-rooted counts of unit length). Training takes a bounded
sample of labelled rows: about `PER_LANGUAGE` of each language, chosen by a hash of the id.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, hash01, small_batches, written

PER_LANGUAGE = 500
DIM = 2048
#: Families of ISO 639-1 codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa ur",
    "turkic": "az kk ky tr tt ug uz",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTERS = re.compile(r"[^\W\d_]+")  # and number signs such as ½, which letters() leaves out
_BLOCK = 1 << 18
#: Rows of an Arrow batch of vectors, 1 MB: the usual thousands would take hundreds of MB in each worker.
_ROWS = 64


def family(code: str) -> str:
    return _FAMILY.get(code.lower().split("-")[0].split("_")[0], f"only {code}")


def letters(text: str | None) -> list[str]:
    """Lower-case runs of letters (Unicode's, without digits and other number signs)."""
    found = _LETTERS.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return " ".join("".join(c if c.isalpha() else " " for c in run) for run in found).split()


def features(text: str | None, dim: int = DIM) -> np.ndarray | None:
    """Unit vector of hashed 1- to 3-grams; None if there is no letter. dim: a power of two."""
    words = letters(text)
    if not words:
        return None
    codes = np.frombuffer(f"  {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    shift, counts = np.uint64(64 - dim.bit_length() + 1), np.zeros(dim)
    for at in range(2, len(codes), _BLOCK):  # bounded memory for any length
        c = codes[at : at + _BLOCK]
        b, a = codes[at - 1 : at - 1 + len(c)], codes[at - 2 : at - 2 + len(c)]
        one = c * np.uint64(0x9E3779B97F4A7C15)
        two = (one ^ b + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        three = (two ^ a + np.uint64(2)) * np.uint64(0x165667B19E3779F9)
        for h in (one, two, three):
            counts += np.bincount((h >> shift).astype(np.int64), minlength=dim)
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang and features of rows with a letter, in small batches."""
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            part = batch.iloc[at : at + _ROWS]
            x = pd.Series([features(t) for t in part["text"]], index=part.index, dtype=object)
            yield pd.DataFrame({"lang": part["lang"], "x": x})[x.notna()]


class Model:
    """Weights of the family stage and of each pair of languages; small: (families + pairs) x DIM numbers.

    The language with the most votes of its family's pairs wins; among ties the one with the larger sum of votes' certainty, then the
    one that sorts first. Among equally likely families the one that sorts first is taken.
    """

    def __init__(self, families: list[str], weights: np.ndarray, bias: np.ndarray, languages: dict[str, list[str]], pairs: dict[tuple[str, str], tuple[np.ndarray, float]]):
        self.families, self.weights, self.bias, self.languages, self.pairs = families, weights, bias, languages, pairs

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or (x := features(text)) is None:
            return "und", 0.0
        z = self.weights @ x + self.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        votes: dict[str, list[float]] = defaultdict(list)
        for a, b in combinations(self.languages[self.families[best]], 2):
            w, c = self.pairs[a, b]
            sure = 1 / (1 + np.exp(-np.clip(2 * (w @ x + c), -30, 30)))
            votes[b].append(sure)
            votes[a].append(1 - sure)
        if not votes:
            return self.languages[self.families[best]][0], float(p[best])
        lang = max(sorted(votes), key=lambda k: (sum(s > 0.5 for s in votes[k]), sum(votes[k])))
        return lang, float(p[best] * np.mean(votes[lang]))


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """From labelled(doc_id, text, lang); rows with a null or without a letter are left out."""
    rows = labelled.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    # A row per language, as few as the models of their pairs, which the driver holds in any case.
    counts = rows.groupBy("lang").count().collect()
    rate = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["count"])))) if counts else F.create_map().cast("map<string,double>")
    sample = rows.where(hash01("doc_id", seed=11) < F.element_at(rate, F.col("lang")))
    sample = written(sample.select("lang", "text").mapInPandas(_vectors, "lang string, x array<double>"), "langid")
    codes = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    languages: dict[str, list[str]] = defaultdict(list)
    for code in codes:
        languages[family(code)].append(code)
    families = sorted(languages)
    data = sample.select("lang", array_to_vector("x").alias("features"))

    def fitted(rows: DataFrame, estimator):
        return estimator.fit(rows.repartition(4))

    as_label = lambda of: F.element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), F.col("lang")).cast("double")
    weights, bias, pairs = np.zeros((len(families), DIM)), np.zeros(len(families)), {}
    if len(families) > 1:
        m = fitted(data.withColumn("label", as_label({c: families.index(family(c)) for c in codes})), LogisticRegression(family="multinomial", maxIter=40, regParam=1e-4, standardization=False))
        weights, bias = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
    for own in languages.values():
        for a, b in combinations(own, 2):
            m = fitted(data.where(F.col("lang").isin(a, b)).withColumn("label", as_label({a: 0, b: 1})), LinearSVC(maxIter=40, regParam=1e-4, standardization=False))
            pairs[a, b] = m.coefficients.toArray(), float(m.intercept)
    dropped(sample)
    return Model(families, weights, bias, dict(languages), pairs)


def predictions(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """row, all columns of docs, and found: (lang_pred, score)."""

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["lang_pred", "score"]).astype({"score": "float64"})

    small_batches(docs.sparkSession)
    return docs.select(F.struct(*docs.columns).alias("row"), predict(F.col(text_col)).alias("found"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score in place of any such columns; `und` and 0 for a text that is null or has no letter, or if nothing was learned."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return predictions(docs, model).select(*(F.col("row")[c].alias(c) for c in keep), "found.lang_pred", "found.score")


def held_out():
    """The rows that training never sees; false for a null id, whose rows are never learned from either."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """Train on docs(doc_id, text, lang) outside the held-out rows, then predict every row; other columns stay.

    A null text or one without a letter is `und` with score 0, number signs being no letters; null languages and ids teach nothing, texts of any
    length count whole, columns named lang_pred or score are replaced, repeated rows are predicted alike; an empty table gives an empty result.
    """
    return identify(docs, learned(docs))


def learned(docs: DataFrame) -> Model:
    """The model of docs(doc_id, text, lang) outside the held-out rows."""
    small_batches(docs.sparkSession)
    return train(docs.where(~held_out()))


def op2(docs: DataFrame) -> DataFrame:
    return language_id(docs).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
