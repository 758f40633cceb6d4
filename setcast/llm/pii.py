"""Personal data: base patterns, and bootstrapped contextual extraction.

Base patterns find emails, IP addresses, card and phone numbers. Their values are seeds. Of long hexadecimal values that stand in an
assignment (`name = "..."`) a part, chosen by a hash of the value, are seeds of the kind secret, which is no base kind; the others look like seeds, speak neither for
nor against a pattern, and are found only if confident patterns hold them, as are values of any other look. The words around a seed make lexical patterns: the two
words before it; in an assignment, the name; the word before and the word after; each with the signs that stand directly before the value and with its shape.
The edges between patterns and the distinct values seen in them, over all documents, are a bipartite graph that Spark scores in
rounds: a pattern's confidence in a kind is the share of its values, without those that merely look like seeds, already accepted as that kind, given enough of them;
a value that a confident pattern holds is accepted, and so supports further patterns. In the end the occurrences
of confident patterns that no base span touches become spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, small_batches, written

#: The base kinds in their order, and their patterns.
BASE = ("email", "ip", "card", "phone")
SECRET = len(BASE)
KINDS = (*BASE, "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# No match begins within a run of digits: the one before would have taken the run.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_MARK = re.compile(r"[0-9@]")
#: Groups of digits joined by single spaces, dots or hyphens, each group perhaps in parentheses; a bracket may stand for a joint.
_RUN = re.compile(r"(?<![0-9])[+(]{0,2}[0-9]+(?:(?:\)[\x20.-]?\(?|[\x20.-]\(?|\()[0-9]+)+\)?")

#: A pattern counts with so many distinct accepted values, and that share of all its values.
SUPPORT = 4
CONFIDENCE = 0.75
ROUNDS = 3
#: An identifier has so many digits, or an @.
DIGITS = 5
#: A secret's seed: hexadecimal, of so many signs or more, some of them letters and some digits.
_SEED = re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]{32,}")
#: Of so many such values, by a hash, one is a seed; a kind above all kinds marks the others.
SEED_SHARE = 2
ALIKE = len(KINDS)
#: Confident patterns are broadcast up to so many, of some hundred bytes each.
BROADCAST_PATTERNS = 100_000
_STOPS = frozenset(" \t\n\r\x0b\x0c\"'<>()[]{}=,;:|")
_TRIM = ".,!?*#$%&-/\\"
_WORDS = re.compile(r"[^\W_]+")
_SHORT = 64


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << k % 2
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from each @ outwards, which is linear where a search from the left is not."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            floor = host.end()
        at = text.find("@", max(floor, at + 1))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, order of kind, end) of all base spans, sorted."""
    text = text or ""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _MARK.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


def _shape(value: str) -> str:
    return "@" if "@" in value else "a" if any(c.isalpha() for c in value) else "9"


def _name(text: str) -> str:
    """text in lower case, or a digest of it if it is long."""
    return text.lower() if len(text) <= _SHORT else f"#{xxhash.xxh3_128_hexdigest(text.lower().encode('utf-8', 'surrogatepass'))}"


class _Words:
    """The words of a text and what stands around a value."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, [], []
        for m in _WORDS.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def word(self, k: int) -> str:
        return _name(self.text[self.starts[k] : self.ends[k]]) if 0 <= k < len(self.starts) else ""

    def signs(self, start: int) -> str:
        """The signs directly before a value, without white space."""
        k = bisect_right(self.ends, start) - 1
        return "".join(self.text[self.ends[k] if k >= 0 else 0 : start].split())[-4:]

    def contexts(self, start: int, end: int, shape: str) -> list[str]:
        k, after = bisect_right(self.ends, start) - 1, bisect_left(self.starts, end)
        one, two, right, signs = self.word(k), self.word(k - 1), self.word(after), self.signs(start)
        out = [f"{shape}<{two} {one}{signs}"] * bool(one and two) + [f"{shape}{one}{signs}_{right}"] * bool(one and right)
        return out + [f"{shape}<{one}{signs}"] * bool(one and ("=" in signs or ":" in signs))


def _runs(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Identifiers written as several groups of digits, clear of taken spans and of words."""
    out, k = [], 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        if text[b - 1] == ")" and text.count("(", a, b) < text.count(")", a, b):
            b -= 1  # the bracket closes one before the run
        if text[a] == "(" and text.count("(", a, b) > text.count(")", a, b):
            a += 1
        if sum("0" <= c <= "9" for c in text[a:b]) < DIGITS:
            continue
        if a > 0 and (text[a - 1] not in _STOPS and text[a - 1] not in _TRIM) or b < len(text) and (text[b] not in _STOPS and text[b] not in _TRIM):
            continue  # part of a word: left to the tokens
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not any(s < b and a < e for s, e in taken[max(0, k - 4) : k + 4]):
            out.append((a, b))
    return out


def instances(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str, int | None, list[str]]]]:
    """The base spans, and (start, end, value, kind or None, patterns) of base spans and of other identifier-like tokens."""
    text, spans = text or "", base_spans(text)
    mark = _MARK.search(text)
    if not mark:
        return spans, []
    words = _Words(text)
    out = [(a, b, _name(text[a:b]), kind, words.contexts(a, b, _shape(text[a:b]))) for a, kind, b in spans]
    taken, k = [(a, b) for a, _, b in spans], 0
    runs = _runs(text, taken)
    for a, b in runs:
        out.append((a, b, _name(text[a:b]), None, words.contexts(a, b, "9")))
    taken = sorted(taken + runs)
    while mark:
        start = end = mark.start()
        while start > 0 and text[start - 1] not in _STOPS:
            start -= 1
        while end < len(text) and text[end] not in _STOPS:
            end += 1
        mark = _MARK.search(text, end)
        a, b = start, end
        while a < b and text[a] in _TRIM:
            a += 1
        while b > a and text[b - 1] in _TRIM:
            b -= 1
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if any(s < b and a < e for s, e in taken[max(0, k - 4) : k + 4]):
            continue
        value = text[a:b].lower()
        if "@" in value or sum("0" <= c <= "9" for c in value) >= DIGITS:
            signs = words.signs(a)
            secret = ("=" in signs or ":" in signs) and _SEED.fullmatch(value)
            kind = None if not secret else SECRET if xxhash.xxh64_intdigest(value, 6) % SEED_SHARE == 0 else ALIKE
            out.append((a, b, _name(value), kind, words.contexts(a, b, _shape(value))))
    return spans, out


_SPAN = [T.StructField("start", T.LongType()), T.StructField("kind", T.LongType()), T.StructField("end", T.LongType())]
_FOUND = T.StructType(
    [
        T.StructField("spans", T.ArrayType(T.StructType(_SPAN))),
        T.StructField("instances", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType()), T.StructField("kind", T.LongType()), T.StructField("patterns", T.ArrayType(T.StringType()))]))),
    ]
)


@F.udf(_FOUND, useArrow=True)
def _found(text):
    spans, out = instances(text)
    return spans, out


def patterns(edges: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """edges(pattern, value, kind), kind null but for seeds and ALIKE for what looks like one -> (pattern, kind, confidence) of the confident ones, after
    so many rounds.

    Scores are over distinct values, so that copies of a document don't add to them; a value of several kinds counts for each. Values that look like seeds count
    once they are accepted, and not against a pattern before.
    """
    if rounds < 1:
        raise ValueError("rounds must be at least 1")
    accepted = written(edges.where(F.col("kind") < ALIKE).select("value", "kind").distinct(), "accepted")
    # A pattern with fewer values than it needs can never count: most go at once.
    pairs = edges.groupBy("pattern", "value").agg(F.min(F.coalesce(F.col("kind") == ALIKE, F.lit(False))).alias("alike"))
    totals = written(pairs.groupBy("pattern").agg(F.count("*").alias("all"), F.count_if(~F.col("alike")).alias("n")).where(F.col("all") >= support).drop("all"), "totals")
    pairs = written(pairs.join(totals, "pattern", "left_semi"), "graph")
    for k in range(rounds):
        held = pairs.join(accepted, "value").groupBy("pattern", "kind").agg(F.count("*").alias("held"), F.count_if(~F.col("alike")).alias("counted")).where(F.col("held") >= support)
        sure = held.join(totals, "pattern").select("pattern", "kind", (F.col("held") / (F.col("n") - F.col("counted") + F.col("held"))).alias("confidence")).where(F.col("confidence") >= confidence)
        if k == rounds - 1:
            break
        more = pairs.join(sure, "pattern").groupBy("value", "kind").agg(F.max("confidence")).select("value", "kind")
        then = written(accepted.union(more).distinct(), "accepted")
        dropped(accepted)
        accepted = then
    found = written(sure, "patterns")
    for used in (accepted, pairs, totals):
        dropped(used)
    return found


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*(F.lit(x) for x in KINDS)), (k + 1).cast("int"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end), sorted, kind an index of KINDS, base ones among spans; with carry
    also row, all columns of docs.

    Null and empty texts have no spans. A null id and repeated rows are rows like any other; equal texts get equal spans. An occurrence
    that confident patterns of several kinds hold is of the most confident kind, among ties the first. Texts, values and words of any length
    count whole. Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    row = F.struct(*docs.columns) if carry else F.lit(None).cast("string")
    # Numbered before they are written, so that the numbers hold.
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"), _found(F.col(text_col)).alias("f"), row.alias("row"))
    rows = written(rows.select("key", "doc_id", "f.spans", "f.instances", "row"), "pii")
    seen = rows.select(F.explode("instances").alias("i"))
    sure = patterns(seen.select(F.explode("i.patterns").alias("pattern"), "i.value", "i.kind"))
    sure = F.broadcast(sure) if sure.count() <= BROADCAST_PATTERNS else sure
    # Only rows with an occurrence that is no base span need what the patterns say.
    is_open = lambda i: i["kind"].isNull() | (i["kind"] >= SECRET)
    has_open = F.exists("instances", is_open)
    unseen = rows.where(has_open).select("key", F.explode(F.filter("instances", is_open)).alias("i"))
    unseen = unseen.select("key", "i.start", "i.end", F.explode("i.patterns").alias("pattern"))
    best = unseen.join(sure, "pattern").groupBy("key", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    extra = best.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("extra"))
    told = rows.where(has_open).join(extra, "key", "left")
    told = told.select("doc_id", F.col("spans").alias("base"), F.array_sort(F.concat("spans", F.coalesce("extra", F.expr("slice(spans, 1, 0)")))).alias("spans"), "row")
    return told.union(rows.where(~has_open).select("doc_id", F.col("spans").alias("base"), "spans", "row"))


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets (overlapping ones by the first's), n_chars following; other columns stay.

    Null texts stay null; ties, repeated rows and empty tables as in personal_data().
    """
    rows = personal_data(docs, carry=True)
    place = F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    text = F.col("row.text")

    def step(s, x):
        begin, end = x["start"] + 1, x["end"] + 1
        name = F.concat(F.lit("["), F.upper(F.element_at(F.array(*(F.lit(k) for k in KINDS)), (x["kind"] + 1).cast("int"))), F.lit("]"))
        part = F.concat(s["parts"], F.array(F.substring(text, s["at"].cast("int"), (begin - s["at"]).cast("int")), name))
        return F.when(begin < s["at"], F.struct(F.greatest(s["at"], end).alias("at"), s["parts"].alias("parts"))).otherwise(F.struct(end.alias("at"), part.alias("parts")))

    whole = F.aggregate("spans", place, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"].cast("int"), F.length(text))))
    rows = rows.withColumn("new_text", F.when(F.size("spans") == 0, text).otherwise(whole))
    return rows.select(*((F.col("new_text") if c == "text" else F.length("new_text").cast("long") if c == "n_chars" else F.col("row")[c]).alias(c) for c in docs.columns))


def op6(docs: DataFrame) -> DataFrame:
    rows = personal_data(docs)
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
