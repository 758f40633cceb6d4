"""License scans: an exact set-similarity join of license templates with the blocks of every text.

A block is a window of `BLOCK` words, a new one every `STRIDE`. A template matches a block that holds at least the share `THRESHOLD` of its distinct tokens.
Tokens are ordered by how many documents hold them, the rarest first, over the whole corpus. A template of n tokens that needs o of them and a
block with m tokens of the templates' vocabulary can only match if m >= o (length filter), if the first n - o + 1 of the template and the first
m - o + 1 of the block share a token (prefix filter), and if the matches in these prefixes and what lies behind the last of them on either side
make up o (positional filter). What is left is verified. Words outside the vocabulary are in no template and are dropped before anything is
shuffled. Templates are a fixed, small table, so that their side of the join is broadcast; the corpus is read once.

DataFrame functions only.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# What separates words, letters that change case, phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices of well-known licenses.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
)
# Words of notices that say nothing of a license.
STOP = frozenset("a all an and any are as be by for in is it of on or the this to under will with you".split())
THRESHOLD = 0.85
#: Words of a block and from one block's start to the next's: every run of BLOCK - STRIDE + 1 words lies in one block.
BLOCK, STRIDE = 128, 64


def _tokens(text: str) -> list[str]:
    """Distinct tokens of a template."""
    return sorted({w for w in re.split(SEPARATORS, text.lower()) if w and w not in STOP})


_TEMPLATES = [(label, _tokens(text)) for label, text in TEMPLATES]
VOCABULARY = sorted({w for _, words in _TEMPLATES for w in words} | {w for phrase in PHRASES for w in phrase.split()})


def needed(n: int) -> int:
    """Of n tokens of a template, how many a block must hold."""
    return math.ceil(THRESHOLD * n)


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, doc_id, n_words and hits (at, word), the words of the vocabulary in their order, as a written table."""
    pieces = F.split(F.translate(F.coalesce(text_col, F.lit("")), _UPPER, _LOWER), SEPARATORS)
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"), pieces.alias("pieces"))
    empty_first = (F.get("pieces", F.lit(0)) == "").cast("int")
    empty_last = ((F.size("pieces") > 1) & (F.element_at("pieces", -1) == "")).cast("int")
    hit = lambda w, k: F.when(w.isin(VOCABULARY), F.struct((k - F.col("before")).alias("at"), w.alias("word")))
    rows = rows.withColumn("before", empty_first)
    return written(rows.select("key", "doc_id", (F.size("pieces") - F.col("before") - empty_last).cast("long").alias("n_words"), F.array_compact(F.transform("pieces", hit)).alias("hits")), "licenses")


def _places() -> Column:
    """(at, label) of all places where a phrase's words stand one after another, in their order. All their words are in the vocabulary."""

    def starts(x: Column, k: Column) -> Column:
        out = F.lit(None)
        for phrase, label in PHRASES.items():
            words = phrase.split()
            here = x["word"] == words[0]
            for j, w in enumerate(words[1:], 1):
                there = F.get("hits", k + j)
                here = here & F.coalesce((there["word"] == w) & (there["at"] == x["at"] + j), F.lit(False))
            out = F.when(here, F.struct(x["at"].cast("long").alias("at"), F.lit(label).alias("label"))).otherwise(out)
        return out

    return F.array_compact(F.transform("hits", starts))


def _matches(rows: DataFrame) -> DataFrame:
    """rows of _scanned() -> (key, block, template, label, containment) of every block that a template matches."""
    spark = rows.sparkSession
    words = rows.select(F.explode(F.array_distinct("hits.word")).alias("word"))
    held = {r["word"]: r["count"] for r in words.groupBy("word").count().collect()}  # one number per word of the vocabulary
    rank = {w: k for k, w in enumerate(sorted(VOCABULARY, key=lambda w: (held.get(w, 0), w)))}
    ranked = [(label, sorted(rank[w] for w in words)) for label, words in _TEMPLATES]
    least = min(needed(len(t)) for _, t in ranked)
    index = [{"rank": t[i], "template": k, "label": label, "tokens": t, "need": needed(len(t)), "i": i} for k, (label, t) in enumerate(ranked) for i in range(len(t) - needed(len(t)) + 1)]
    schema = "array<struct<rank:int,template:int,label:string,tokens:array<int>,need:int,i:int>>"
    index = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(index)), schema)))
    number = F.create_map(*(F.lit(x) for w in VOCABULARY for x in (w, rank[w])))
    enough = F.size(F.array_distinct("hits.word")) >= least
    last = F.floor(F.col("x.at") / STRIDE).cast("int")  # the last block with this word; the one before has it too
    seen = rows.where(enough).select("key", F.explode("hits").alias("x")).select("key", F.explode(F.array_distinct(F.array(*(F.greatest(last - k, F.lit(0)) for k in range(BLOCK // STRIDE))))).alias("block"), F.element_at(number, F.col("x.word")).alias("rank"))
    blocks = seen.groupBy("key", "block").agg(F.array_sort(F.collect_set("rank")).alias("held")).where(F.size("held") >= least)
    prefix = blocks.select("key", "block", "held", F.posexplode(F.slice("held", 1, F.size("held") - least + 1)).alias("j", "rank"))
    behind = F.size("held") - F.col("need")
    both = prefix.join(F.broadcast(index), "rank").where((behind >= 0) & (F.col("j") <= behind))
    groups = both.groupBy("key", "block", "template").agg(F.first("label").alias("label"), F.first("need").alias("need"), F.first("tokens").alias("tokens"), F.first("held").alias("held"), F.count("*").alias("n"), F.max("i").alias("i"), F.max("j").alias("j"))
    possible = groups.where(F.col("n") + F.least(F.size("tokens") - F.col("i"), F.size("held") - F.col("j")) - 1 >= F.col("need"))
    shared = F.size(F.array_intersect("held", "tokens"))
    return possible.where(shared >= F.col("need")).select("key", "block", "template", "label", (shared / F.size("tokens")).alias("containment"))


def license_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, template, first_word, containment) of every block that a template matches; first_word is the block's first. Cases as in scanned()."""
    rows = _scanned(docs, id_col, text_col)
    return rows.select("key", "doc_id").join(_matches(rows), "key").select("doc_id", "label", "template", (F.col("block") * STRIDE).cast("long").alias("first_word"), "containment")


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest containment of a template that matches, 1 where a phrase stands, else 0. Null, empty and wordless texts have no words, no
    labels and the score 0. Repeated rows and rows without an id are rows of their own; texts and words of any length count whole; equal containments
    give the same score, and labels are distinct and sorted, so that ties don't matter. Other columns are ignored; an empty table gives an empty result.
    """
    rows = _scanned(docs, id_col, text_col)
    found = _matches(rows).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))  # labels are few
    rows = rows.select("key", "doc_id", "n_words", _places().alias("places")).join(found, "key", "left")
    base, ats = F.array_sort(F.array_distinct("places.label")), F.col("places.at")
    labels = F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), (F.size("places") > 0).cast("double"))
    return rows.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(ats).alias("first_word"), F.array_max(ats).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op11(docs: DataFrame) -> DataFrame:
    return scanned(docs)


def _sql() -> str:
    """The same in SQL: every block against every template, without filters."""
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    values = ", ".join(f"({k}, '{label}', [{quoted(words)}], {needed(len(words))})" for k, (label, words) in enumerate(_TEMPLATES))
    places = " UNION ALL ".join(
        f"SELECT w0.rid, w0.pos, '{label}' AS label FROM words w0 " + " ".join(f"JOIN words w{j} ON w{j}.rid = w0.rid AND w{j}.pos = w0.pos + {j} AND w{j}.word = '{w}'" for j, w in enumerate(phrase.split()) if j) + f" WHERE w0.word = '{phrase.split()[0]}'"
        for phrase, label in PHRASES.items()
    )
    return f"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
words AS MATERIALIZED (SELECT * FROM (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS pos FROM texts) WHERE word IN ({quoted(VOCABULARY)})),
templates(template, label, tokens, need) AS (VALUES {values}),
places AS (SELECT rid, count(*) AS n, min(pos) AS low, max(pos) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM ({places}) GROUP BY rid),
blocks AS (SELECT rid, block, list(DISTINCT word) AS held FROM (SELECT rid, word, unnest(range(greatest(pos // {STRIDE} - {BLOCK // STRIDE - 1}, 0), pos // {STRIDE} + 1)) AS block FROM words) GROUP BY rid, block),
found AS (SELECT rid, label, len(list_intersect(held, tokens)) / len(tokens) AS containment FROM blocks, templates WHERE len(list_intersect(held, tokens)) >= need),
best AS (SELECT rid, max(containment) AS best FROM found GROUP BY rid),
labels AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS names FROM (SELECT rid, label FROM found UNION ALL SELECT rid, label FROM ({places})) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(low AS BIGINT) AS first_word, CAST(high AS BIGINT) AS last_word,
  coalesce(places.names, '') AS base_labels, coalesce(labels.names, '') AS labels, CAST(CASE WHEN n > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM texts LEFT JOIN places USING (rid) LEFT JOIN best USING (rid) LEFT JOIN labels USING (rid)
"""


SQL = _sql()
