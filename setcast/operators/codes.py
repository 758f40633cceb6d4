"""Many classes by output codes: a word over a small alphabet for each class, a model for each place of the words, decoding by likelihood.

For models that tell only a few classes apart. With no more classes than signs, the model itself is used.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signs of the alphabet; places for each place that would just tell classes apart; least probability of a sign.
ALPHABET, REDUNDANCY, LEAST = 10, 4, 1e-9
DIGITS = 9
Base = Callable[[DataFrame, DataFrame, int], DataFrame]


def _word(k: int, length: int, alphabet: int, attempt: int) -> tuple[int, ...]:
    return tuple(int(hashlib.md5(f"{attempt}:{k}:{j}".encode()).hexdigest()[:8], 16) % alphabet for j in range(length))


def code_book(n_classes: int, alphabet: int = ALPHABET, redundancy: int = REDUNDANCY) -> list[tuple[int, ...]]:
    """A word for each class. Any two differ in at least redundancy places, and every place has two signs or more; words come from hashes, a class taking the
    first of its words that keeps the distance."""
    if n_classes < 2:
        return [(0,)] * n_classes
    needed = 1
    while alphabet**needed < n_classes:
        needed += 1
    length = needed * redundancy
    while True:
        book: list[tuple[int, ...]] = []
        for k in range(n_classes):
            words = (_word(k, length, alphabet, attempt) for attempt in range(64))
            found = next((w for w in words if all(sum(a != b for a, b in zip(w, other, strict=True)) >= redundancy for other in book)), None)
            if found is None:
                break
            book.append(found)
        if len(book) == n_classes and all(len({w[j] for w in book}) > 1 for j in range(length)):
            return book
        length += 1


def signs(book: list[tuple[int, ...]], place: int) -> tuple[list[int], int]:
    """The sign of each class at a place, numbered from 0 without gaps, and how many there are."""
    known = {s: k for k, s in enumerate(sorted({w[place] for w in book}))}
    return [known[w[place]] for w in book], len(known)


def decoded(places: list[Column], book: list[tuple[int, ...]], digits: int | None = DIGITS) -> Column:
    """Probabilities of the classes from those of the signs at each place: the likelihood of a class's word, over the sum of all."""
    own = [signs(book, j)[0] for j in range(len(places))]
    of_class = F.from_json(F.lit(json.dumps([[s[k] for s in own] for k in range(len(book))])), "array<array<int>>")
    logs = F.array(*(F.transform(p, lambda v: F.log(F.greatest(v, F.lit(LEAST)))) for p in places))
    # An array of one element holds what its lambda uses several times.
    sums = F.transform(F.array(logs), lambda all_logs: F.transform(of_class, lambda word: F.aggregate(F.zip_with(all_logs, word, lambda l, s: F.get(l, s)), F.lit(0.0), lambda a, x: a + x)))
    powers = F.transform(sums, lambda s: F.transform(s, lambda v: F.exp(v - F.array_max(s))))
    shown = lambda v: v if digits is None else F.round(v, digits)
    return F.element_at(F.transform(powers, lambda e: F.transform(e, lambda v: shown(v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)))), 1)


def with_probabilities(base: Base, train: DataFrame, score: DataFrame, n_classes: int, alphabet: int = ALPHABET, redundancy: int = REDUNDANCY) -> DataFrame:
    """score with p over all classes; base(train, score, n) adds p over n classes to score, from train(class_idx, features).

    Classes without training rows have words as well, and with them a probability. Ties and empty tables are the base's matter.
    """
    if n_classes <= alphabet:
        return base(train, score, n_classes)
    book, out = code_book(n_classes, alphabet, redundancy), score
    for j in range(len(book[0])):
        own, n = signs(book, j)
        recoded = train.withColumn("class_idx", F.get(F.array(*(F.lit(s) for s in own)), F.col("class_idx").cast("int")))
        out = base(recoded, out, n).withColumnRenamed("p", f"_p{j}")
    p = decoded([F.col(f"_p{j}") for j in range(len(book[0]))], book)
    return out.withColumn("p", p).select(*score.columns, "p")


def distance(book: list[tuple[int, ...]]) -> int:
    """The least number of places in which two words differ."""
    pairs = ((a, b) for k, a in enumerate(book) for b in book[:k])
    return min((sum(x != y for x, y in zip(a, b, strict=True)) for a, b in pairs), default=math.inf)
