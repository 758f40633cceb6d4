"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose value exceeds a cutoff. Cutoffs are chosen on labelled holdout documents, per
stratum (length band): going from the loosest cutoff of a fixed grid to stricter ones, a cutoff is accepted while the
exact binomial (Clopper-Pearson) upper bound on the share of good documents that it rejects stays within the rule's
share of `ALPHA`. The grid is tested in a fixed sequence that stops at the first failure, and the
error probability `DELTA` is divided by rules and strata (Bonferroni), so that with probability 1 - DELTA every
stratum loses at most ALPHA of its good documents over all rules together.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, small_batches, written

ALPHA = 0.02
DELTA = 0.05
WINDOW = 5
#: Loosest first.
GRID = (*(k / 100 for k in range(95, 5, -5)), *(k / 100 for k in range(5, 0, -1)))
_WORD = re.compile(WORD)
#: Windows from which repeated ones are told by sorting numbers, for their memory.
_LARGE = 4096
_SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER, _SHOUT = bytes(range(65, 91)), bytes(range(97, 123)), b"!?"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_shout")


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words in windows of so many words that the text has twice or more, the first included."""
    n = len(words) - window + 1
    if n > _LARGE:
        # Numbers in place of words; windows of k + 1 words from those of k, exact and in a few arrays of n numbers.
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        code = ids[:n]
        for k in range(1, window):
            code = np.unique(code * len(number) + ids[k : k + n], return_inverse=True)[1]
        again = (np.bincount(code)[code] > 1).astype(np.int64)
        inside = np.zeros(len(words) + 1, np.int64)
        inside[:n] += again
        inside[window : n + window] -= again
        return int((np.cumsum(inside) > 0).sum())
    grams = list(zip(*(words[k:] for k in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts, covered, end = Counter(grams), 0, 0
    for at, gram in enumerate(grams):
        if counts[gram] > 1:
            covered += at + window - max(end, at)
            end = at + window
    return covered


def text_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words, raw = _WORD.findall(text), text.encode("utf-8", "surrogatepass")
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (len(words), sum(map(len, words)), without(_SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), without(_UPPER), without(_LOWER), without(_SHOUT))


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS]))
def _text_counts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([text_counts(t) for t in batch], columns=_COUNTS, dtype="int64")


def _ratio(a: Column | str, b: Column | str) -> Column:
    return F.col(a) / F.greatest(F.col(b) if isinstance(b, str) else b, F.lit(1))


def rules() -> dict[str, Column]:
    """Each rule's value, larger the worse the text, from the counts alone."""
    return {
        "symbol_share": _ratio("n_symbols", "word_chars"),
        "repeated_line_share": _ratio("n_dup_lines", "n_lines"),
        "repeated_word_share": _ratio("n_repeat_words", "n_words"),
        "capital_share": _ratio("n_upper", F.col("n_upper") + F.col("n_lower")),
        "shout_share": _ratio("n_shout", "n_words"),
    }


def stratum() -> Column:
    return F.when(F.col("n_words") < 50, "short").when(F.col("n_words") < 200, "medium").when(F.col("n_words") < 1000, "long").otherwise("very_long")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial: the Clopper-Pearson upper bound for k of n is at most p just if this is at most delta."""
    if k >= n * p:
        return 1.0  # about a half or more: beyond any delta
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total = term
    while k > 0 and term > total * 1e-17:
        term *= k / (n - k + 1) * (1 - p) / p
        total += term
        k -= 1
    return total


def calibrate(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """{stratum: {rule: cutoff}} from counts and labels(doc_id, quality); a rule without an acceptable cutoff is absent.

    A document that is labelled twice is good only if all its labels say so. Copies of a text (by a 128-bit digest) are one draw of the
    holdout, good only if every labelled copy is: the binomial bound wants independent draws. The driver gets one number per stratum,
    rule and place in the grid.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    values = F.array(*(F.struct(F.lit(name).alias("rule"), sum((v > c).cast("int") for c in GRID).alias("over")) for name, v in rules().items()))
    texts = counts.join(marks, "doc_id").groupBy("digest").agg(F.min("quality").alias("quality"), *(F.first(c).alias(c) for c in _COUNTS)).where("quality = 1")
    held = texts.select(stratum().alias("stratum"), F.explode(values).alias("x")).groupBy("stratum", "x.rule", "x.over").count().collect()
    strata, found = {r["stratum"] for r in held}, {}
    for s in strata:
        for rule in rules():
            over = Counter({r["over"]: r["count"] for r in held if r["stratum"] == s and r["rule"] == rule})
            n = sum(over.values())
            for k, cutoff in enumerate(GRID, 1):
                rejected = sum(m for o, m in over.items() if o >= k)
                if binomial_tail(rejected, n, alpha / len(rules())) > delta / (len(rules()) * len(strata)):
                    break
                found.setdefault(s, {})[rule] = cutoff
    return found


def judged(counts: DataFrame, cutoffs: dict[str, dict[str, float]]) -> DataFrame:
    """counts with base_failed and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rejected = F.lit(False)
    for s, by_rule in cutoffs.items():
        for rule, cutoff in by_rule.items():
            rejected |= (stratum() == s) & (rules()[rule] > cutoff)
    return counts.withColumn("base_failed", base).withColumn("kept", ~base & ~rejected)


def quality(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of docs(doc_id, text).

    A null or empty text has no words and fails; repeated rows are judged alike; rows without an id or label are
    judged but don't calibrate; without labels only the base rules reject; texts of any length count whole; a value equal to its cutoff
    passes; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    counts = written(docs.select("doc_id", F.md5("text").alias("digest"), _text_counts("text").alias("c")).select("doc_id", "digest", "c.*"), "quality")
    return judged(counts, calibrate(counts, labels, alpha, delta))


def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
