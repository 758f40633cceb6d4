"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A vocabulary's ranks are one constant, an array of numbers: each piece that others are joined to has a row of it, and the rank of both stands in that row at
the second piece's number; rows lie in each other's gaps, so that an entry also tells its row. A rank takes two array accesses and no bytes. A word is
folded from its bytes: the neighbours whose joined bytes have the lowest rank, leftmost first, are merged until no two have a rank. The state of a fold
is one array, an entry for each piece with its place, its id and, above them, the rank of it joined to the next piece; the next merge is the array's minimum.

Only distinct words are folded: the commonest of a bounded sample once for all texts, the others once for each text. Texts are cut into words
in Python, by the vocabulary's own pattern, and the commonest words' numbers stand for them until their ids are put in. By that pattern no word
holds white space behind another sign, so that texts can be cut before such white space and a stretch's words found once for many texts. Which words are
sampled, and which texts share a batch, has no influence on any result. Words beyond `LONG` bytes, where a fold's work would grow with the square of
their length, are merged with a heap. Decoding looks up each id's bytes and joins these binary pieces; where only digests are wanted, ids are encoded, decoded and
digested in one pass, without a way back through Spark.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import os
import random
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import constant, dropped, hash01, short_plans, small_batches, written

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words folded once beforehand, at most, and about as many documents they are counted in; they bear on speed alone.
CACHED_WORDS = 3 << 17
SAMPLED_DOCS = 1 << 16
_CACHED_LENGTH = 64
#: Bytes of the longest word that is folded by higher-order functions.
LONG = 256
#: An entry of a fold's state: the id of a piece joined to the next, or none; 12 bits with its place; 20 bits with its id.
_RANK, _PLACE = 32, 20
_ID = (1 << _PLACE) - 1
#: Distinct words that a worker counts before it hands the counts on.
_FLUSH = 1 << 18
#: Ids that are decoded at once for digests.
_AT_ONCE = 1 << 18
_DIGESTS = (("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"))
#: Signs that are no letters, digits, white space or apostrophes.
_SIGNS = frozenset(".,;:!?()[]{}<>#*$%&|/+-=_")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def displaced(rows: dict[int, list[int]], room: int) -> dict[int, int]:
    """Where each row begins, so that no two rows' places, each so far behind its row's begin, are the same; the begins are below room, or not far above."""
    draw, taken, begins = random.Random(1), set(), {}
    for row, places in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        while True:
            begin = draw.randrange(room)
            for k in places:
                if begin + k in taken:
                    break
            else:
                break
            room += room >> 16  # ever more, so that an end is sure
        taken.update(begin + k for k in places)
        begins[row] = begin
    return begins


class _Table:
    """What folds look up: where the row of each id begins, the 256 bytes' ids, and the rows of ranks. As text, from which a session gets it once (see constant()).

    Ids are ranks and 1 here, so that an empty place, 0, is no row's. Bytes without a rank have ids of their own from unknown on, below the end;
    none: above all ids; alone: pieces with a rank that merges don't lead to.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.unknown = max(ranks.values(), default=-1) + 2
        self.end = self.unknown + 256
        self.bits = self.end.bit_length()
        self.none = 1 << self.bits
        if self.none > _ID:
            raise ValueError(f"Ranks may be {(_ID >> 1) - 257} at most")
        single = [ranks.get(bytes([k]), self.unknown + k - 1) + 1 for k in range(256)]
        ids = {bytes([k]): x - 1 for k, x in enumerate(single)} | ranks
        rows: dict[int, list[int]] = defaultdict(list)
        joined = {}
        for w, r in ranks.items():
            for k in range(1, len(w)):
                if (a := ids.get(w[:k])) is not None and (b := ids.get(w[k:])) is not None:
                    rows[a + 1].append(b + 1)
                    joined[a + 1, b + 1] = r + 1
        self.bytes = self.end + 1
        first = self.bytes + 256
        begins = displaced(rows, 4 * len(joined) + 1)
        numbers = [first] * self.bytes + single + [0] * (max(begins.values(), default=0) + self.bytes)
        for a, begin in begins.items():
            numbers[a] = first + begin
        for (a, b), r in joined.items():
            numbers[first + begins[a] + b] = a << self.bits | r
        self.numbers = json.dumps(numbers, separators=(",", ":"))
        self.alone = {w: r for w, r in ranks.items() if merged(w, ids) != [r]}
        self.whole = all(bytes([k]) in ranks for k in range(256))


@lru_cache(1)
def _vocabulary(path: str, changed: int) -> tuple[dict[bytes, int], _Table]:
    ranks = read_ranks(path)
    return ranks, _Table(ranks)


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _int(c: Column) -> Column:
    return c.cast("int")


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of so many bytes each, one after another in data."""
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(_offsets(sizes).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _lists(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch, and how many each row has; a null has none."""
    return ids.flatten().to_numpy().astype(np.int64), pc.list_value_length(ids).fill_null(0).to_numpy().astype(np.int64)


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """A word's ids by the same merges, in n log n steps for n bytes."""
    ends, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))  # of the piece that begins at a place; 0: no more
    heap = [(r, k, k + 2) for k in range(len(word) - 1) if (r := ranks.get(word[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, end = heapq.heappop(heap)
        middle = ends[k]
        if not middle or middle == len(word) or ends[middle] != end:
            continue
        ends[k], ends[middle] = end, 0
        if end < len(word):
            before[end] = k
            if (r := ranks.get(word[k : ends[end]])) is not None:
                heapq.heappush(heap, (r, k, ends[end]))
        if before[k] >= 0 and (r := ranks.get(word[before[k] : end])) is not None:
            heapq.heappush(heap, (r, before[k], end))
    out, k = [], 0
    while k < len(word):
        out.append(ranks[word[k : ends[k]]])
        k = ends[k]
    return out


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts cut at every space, and where each one's parts begin."""
    lists = pc.split_pattern(texts.cast(pa.string()).fill_null(""), " ")
    return lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... as many as size[0] tells, then the same from begin[1], and so on."""
    return np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())


def _offsets(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int64)


def cut(texts: pa.Array, find, number, whole: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes, offsets, others) of a batch: each text's words in turn as numbers, or as -1 - k for others[k].

    Words are found once for each distinct stretch of the batch, a stretch being a space and what follows up to the next, and not at all for one
    that is a numbered word itself. That holds where each space but a text's first stretch follows a sign other than white space; other texts,
    and all if `whole`, are searched as they are.
    """
    parts, at = _parts(texts)
    encoded = parts.dictionary_encode()
    place, distinct = encoded.indices.to_numpy().astype(np.int64), _strings(encoded.dictionary)
    count, firsts = len(distinct), at[:-1]
    odd = np.array([not p or p[-1].isspace() for p in distinct] + [True], bool)
    plain = np.zeros(len(texts), bool) if whole or not len(texts) else np.add.reduceat(odd[place].astype(np.int64), firsts) == 0
    place[firsts] = count + np.arange(len(texts))  # a text's first stretch has no space before it; odd texts have no other
    used = np.repeat(plain, np.diff(at))
    used[firsts] = True
    place = np.where(used, place, count + len(texts))
    needed = np.zeros(count + len(texts) + 1, bool)
    needed[place] = True
    stretches = [f" {p}" for p in distinct]
    single = list(map(number, stretches))
    # The codes of stretch k are flat[begin[k] :][: size[k]]; those that are one word stand at k.
    flat = [0 if c is None else c for c in single]
    begin, size = np.arange(count + len(texts) + 1), np.ones(count + len(texts) + 1, np.int64)
    size[-1] = 0
    own: dict[str, int] = {}

    def add(k: int, words: list[str]) -> None:
        begin[k], size[k] = len(flat), len(words)
        for w in words:
            c = number(w)
            flat.append(-1 - own.setdefault(w, len(own)) if c is None else c)

    for k in [k for k, c in enumerate(single) if c is None]:
        if needed[k]:
            part, stretch = distinct[k], stretches[k]
            if part.isalpha():  # letters are one word
                flat[k] = -1 - own.setdefault(stretch, len(own))
            elif part[-1] in _SIGNS and part[:-1].isalpha():  # and a sign behind them another
                add(k, [stretch[:-1], part[-1]])
            else:
                add(k, find(stretch))
    starts = _strings(parts.take(pa.array(firsts)))
    for j, ok in enumerate(plain.tolist()):
        add(count + j, find(starts[j] if ok else texts[j].as_py() or ""))
    codes = np.array(flat, np.int64)[_spread(begin[place], size[place])] if flat else np.zeros(0, np.int64)
    return codes, _offsets(np.add.reduceat(size[place], firsts) if len(texts) else []), list(own)


def _decoded(ids: np.ndarray, pieces: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that ids stand for, one after another, and where each id's begin."""
    length = np.diff(offsets)[ids]
    return pieces[_spread(offsets[ids], length)], _offsets(length)


def _digested(ids: np.ndarray, of_row: np.ndarray, pieces: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """SHA-256 of each row's ids as little-endian unsigned 32-bit integers, and of the bytes that they stand for."""
    packed, both = memoryview(ids.astype("<u4").tobytes()), []
    bounds, first = of_row.tolist(), 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(of_row, bounds[first] + _AT_ONCE, "right")) - 1)  # rows that fit, one at least
        if last == first + 1:  # a row of any length, piece by piece
            one, two = hashlib.sha256(packed[4 * bounds[first] : 4 * bounds[last]]), hashlib.sha256()
            for at in range(bounds[first], bounds[last], _AT_ONCE):
                two.update(_decoded(ids[at : min(bounds[last], at + _AT_ONCE)], pieces, offsets)[0])
            both.append((one.hexdigest(), two.hexdigest()))
        else:
            data, at = _decoded(ids[bounds[first] : bounds[last]], pieces, offsets)
            data, ends = memoryview(np.ascontiguousarray(data)), at[of_row[first : last + 1] - bounds[first]].tolist()
            for k in range(first, last):
                one, two = packed[4 * bounds[k] : 4 * bounds[k + 1]], data[ends[k - first] : ends[k - first + 1]]
                both.append((hashlib.sha256(one).hexdigest(), hashlib.sha256(two).hexdigest()))
        first = last
    return pa.array([x for x, _ in both], pa.string()), pa.array([x for _, x in both], pa.string())


_DICTS: dict[str, dict[str, int]] = {}


def _numbers(known, key: str) -> dict[str, int]:
    """The common words' numbers; a worker makes this dictionary once."""
    if key not in _DICTS:
        _DICTS.clear()
        _DICTS[key] = {w: k for k, w in enumerate(_strings(known.value[0]))}
    return _DICTS[key]


class Tokenizer:
    """Encodes and decodes by the ranks in a .tiktoken file, words split by a pattern."""

    def __init__(self, path: str | None = None, pattern: str | None = None):
        path = str(path or public_tokenizers.path(VOCABULARY))
        self.ranks, self._table = _vocabulary(path, os.stat(path).st_mtime_ns)
        self.pattern = pattern or public_tokenizers.PATTERN
        by_id = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for piece, rank in self.ranks.items():
            by_id[rank] = piece
        self._pieces = np.frombuffer(b"".join(by_id), np.uint8), _offsets([len(p) for p in by_id])
        self._known = pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def fold(self, word: Column, spark: SparkSession | None = None) -> Column:
        """A word's ids: array<int>; empty for an empty word. For plans of this session, or of the active one."""
        lists, end = self._table, self._table.end

        def folded(table: Column) -> Column:
            id_of = lambda x: x.bitwiseAND(_long(_ID))

            def entry(a: Column, b: Column, low: Column) -> Column:
                """Of a piece a before a piece b. What stands where the rank would may be another row's: it differs above the rank then, and counts as none."""
                found = F.get(table, F.get(table, a) + b).bitwiseXOR(F.shiftleft(a, lists.bits))
                return F.shiftleft(F.least(found, _long(lists.none)), _RANK).bitwiseOR(low)

            def merge(v: Column, best: Column, i: Column) -> Column:
                """Entry i (from 1), best, takes in the next; its id, its rank and the rank of the one before are new."""
                new, before = F.shiftright(best, _RANK), F.get(v, i - 2)
                left = entry(id_of(before), new, before.bitwiseAND(_long((1 << _RANK) - 1)))
                own = entry(new, id_of(F.get(v, i + 1)), best.bitwiseAND(_long((1 << _RANK) - 1 - _ID)).bitwiseOR(new))
                return F.flatten(F.array(F.slice(v, F.lit(1), i - 2), F.array(left, own), F.slice(v, i + 2, F.size(v))))

            def step(v: Column, _: Column) -> Column:
                merged = lambda best: _let(_int(F.array_position(v, best)), lambda i: merge(v, best, i))
                return _let(F.array_min(v), lambda best: F.when(best >= lists.none << _RANK, v).otherwise(merged(best)))

            def done(v: Column) -> Column:
                found = F.slice(v, F.lit(2), F.size(v) - 2)
                return F.transform(found, lambda x: _let(_int(id_of(x)), lambda k: F.when(k < lists.unknown, k - 1)) if not lists.whole else _int(id_of(x)) - 1)

            def ids(signs: Column) -> Column:
                """An end stands before and behind the pieces; joined to them it has no rank."""

                id_at = lambda c: F.get(table, F.ascii(c) + lists.bytes)
                place = lambda k: F.shiftleft(k.cast("bigint"), _PLACE)
                ends = F.array(_long((lists.none << _RANK) + end))
                start = _let(F.transform(signs, id_at), lambda pieces: F.transform(pieces, lambda a, k: entry(a, F.get(pieces, k + 1), place(k).bitwiseOR(a))))
                start = F.flatten(F.array(ends, start, ends))
                return F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(signs))), start, step, done)

            # Each byte as a character.
            signs = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")
            found = _let(signs, ids)
            if lists.alone:  # words with a rank that merges don't lead to
                alone = F.create_map(*(F.lit(x) for w, r in lists.alone.items() for x in (w.hex().upper(), r)))
                found = _let(F.element_at(alone, F.hex(word.cast("binary"))), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(found))
            return F.when(word == "", F.array().cast("array<int>")).otherwise(found)

        return _let(constant(spark or SparkSession.active(), lists.numbers, "array<bigint>"), folded)

    def learn(self, docs: DataFrame, text_col: str = "text", words: int = CACHED_WORDS, sampled: int = SAMPLED_DOCS) -> Tokenizer:
        """Fold the commonest distinct words of about `sampled` documents beforehand. At most `words` words and their ids come to the driver."""
        spark, pattern = docs.sparkSession, self.pattern
        small_batches(spark)
        rate = sampled / max(1, docs.count())
        rows = docs.where(hash01(text_col, seed=17) < rate) if rate < 1 else docs

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find, counts = regex.compile(pattern).findall, Counter()
            for batch in batches:
                found = _parts(batch.column(0))[0].value_counts()
                for part, n in zip(_strings(found.field("values")), found.field("counts").to_numpy().tolist(), strict=True):
                    for w in find(f" {part}"):
                        counts[w] += n
                if len(counts) > _FLUSH:
                    yield pa.RecordBatch.from_pydict({"w": list(counts), "n": list(counts.values())})
                    counts.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["w", "n"])

        found = rows.select(F.col(text_col).alias("text")).mapInArrow(counted, "w string, n long").where(F.octet_length("w") <= _CACHED_LENGTH)
        common = found.groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(words).select("w")
        parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
        # Written first, and folded in a plan without an exchange.
        common = written(common.repartition(parts, "w"), "words")
        short_plans(spark)
        table = common.select("w", self.fold(F.col("w"), spark).alias("ids")).toArrow()
        dropped(common)
        ids = table["ids"].combine_chunks()
        if len(table):
            self._known = table["w"].combine_chunks(), ids.offsets.to_numpy().astype(np.int64), ids.values.to_numpy()
        return self

    def encoders(self, spark: SparkSession, with_ids: bool = True, digests: bool = False):
        """From texts to word numbers and other words; from these numbers and the others' ids to all ids, their digests, or both (see encoded)."""
        pattern = self.pattern
        known = spark.sparkContext.broadcast(self._known)
        ranks, key = spark.sparkContext.broadcast(self.ranks), uuid.uuid4().hex
        other = T.StructType([T.StructField("word", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
        shape = T.StructType([T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("others", T.ArrayType(other))])

        @F.arrow_udf(shape)
        def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            """Each word's number, or, from -1 down, its place among the text's other distinct words."""
            find, number = regex.compile(pattern).findall, _numbers(known, key).get
            for texts in batches:
                codes, at, words = cut(texts, find, number, pattern != public_tokenizers.PATTERN)
                rare = np.flatnonzero(codes < 0)
                text = np.repeat(np.arange(len(texts)), np.diff(at))[rare]
                pairs, back = np.unique(text * (len(words) + 1) + (-1 - codes[rare]), return_inverse=True)
                first = np.searchsorted(pairs, np.arange(len(texts) + 1) * (len(words) + 1))
                codes[rare] = -1 - (back - first[text])
                long = [merged(b, ranks.value) if len(w) > LONG // 4 and len(b := w.encode()) > LONG else None for w in words]
                which = pa.array(pairs % (len(words) + 1), pa.int64())
                own = pa.StructArray.from_arrays([pa.array(words, pa.string()).take(which), pa.array(long, pa.list_(pa.int32())).take(which)], ["word", "ids"])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(codes, pa.int32())), pa.ListArray.from_arrays(pa.array(first, pa.int32()), own)
                yield pa.StructArray.from_arrays(lists, ["codes", "others"])

        pieces = self._pieces
        result = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField(c, T.LongType() if t == "long" else T.StringType()) for c, t in _DIGESTS] * digests)

        @F.arrow_udf(result)
        def filled(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            """The ids in place of the numbers."""
            _, offsets, flat = known.value
            for numbers, folded in batches:
                codes, size = numbers.flatten().to_numpy().astype(np.int64), pc.list_value_length(numbers).to_numpy().astype(np.int64)
                lists = folded.flatten()
                own, starts = lists.flatten().to_numpy(), _offsets(pc.list_value_length(lists).to_numpy())
                of_text = np.repeat(_offsets(pc.list_value_length(folded).to_numpy())[:-1], size)
                common = codes >= 0
                low, high = np.where(common, codes, 0), np.where(common, 0, of_text - 1 - codes)
                begin = np.where(common, offsets[low], starts[high])
                length = np.where(common, offsets[np.minimum(low + 1, len(offsets) - 1)], starts[np.minimum(high + 1, len(starts) - 1)]) - begin
                at, from_common = _spread(begin, length), np.repeat(common, length)
                ids = np.empty(len(at), np.int32)
                ids[from_common] = flat[at[from_common]]
                ids[~from_common] = own[at[~from_common]]
                of_row = _offsets(length)[_offsets(size)]
                columns = [pa.ListArray.from_arrays(pa.array(of_row, pa.int32()), pa.array(ids, pa.int32()))] if with_ids else []
                if digests:
                    columns += [pa.array(np.diff(of_row)), *_digested(ids, of_row, *pieces)]
                yield pa.StructArray.from_arrays(columns, result.names)

        return coded, filled

    def packed(self, ids: Column) -> Column:
        """ids as little-endian unsigned 32-bit integers: binary; empty for null."""

        @F.arrow_udf(T.BinaryType())
        def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                flat, sizes = _lists(batch)
                yield _binaries(flat.astype("<u4").view(np.uint8), 4 * sizes)

        return pack(ids)

    def decode(self, ids: Column) -> Column:
        """The bytes that ids stand for, their binary pieces one after another; empty for null."""
        pieces, offsets = self._pieces

        @F.arrow_udf(T.BinaryType())
        def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                flat, sizes = _lists(batch)
                data, at = _decoded(flat, pieces, offsets)
                yield _binaries(data, np.diff(at[_offsets(sizes)]))

        return join(ids)


def encoded(docs: DataFrame, tokenizer: Tokenizer, text_col: str = "text", with_ids: bool = True, digests: bool = False) -> DataFrame:
    """docs with ids (array<int>) in place of any such column; other columns stay, whatever their names. With digests also n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers) and decoded_sha256 (of the bytes that the ids decode to), without ids these alone.

    Null and empty texts have no ids; repeated rows are encoded alike; texts and words of any length are encoded whole; ties between
    equal pairs go to the leftmost; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    short_plans(docs.sparkSession)
    added = ["ids"] * with_ids + [c for c, _ in _DIGESTS] * digests
    keep = [c for c in docs.columns if c not in added]
    coded, filled = tokenizer.encoders(docs.sparkSession, with_ids, digests)
    rows = docs.select(F.struct(*(F.col(c) for c in keep)).alias("row"), coded(F.col(text_col)).alias("c"))
    folded = F.transform("c.others", lambda o: F.coalesce(o["ids"], tokenizer.fold(o["word"], docs.sparkSession)))
    # The array of one is exploded to keep the fold out of the arguments of a Python function, where Spark would not evaluate it.
    rows = rows.select("row", F.explode(F.array(F.struct("c.codes", folded.alias("folded")))).alias("c"))
    rows = rows.select("row", filled("c.codes", "c.folded").alias("f"))
    return rows.select(*(F.col("row")[c].alias(c) for c in keep), *(F.col("f")[c].alias(c) for c in added))


def op10(docs: DataFrame, path: str | None = None) -> DataFrame:
    docs = docs.select("doc_id", "text")
    tokenizer = Tokenizer(path).learn(docs)
    return encoded(docs, tokenizer, with_ids=False, digests=True).select("doc_id", *(c for c, _ in _DIGESTS))
