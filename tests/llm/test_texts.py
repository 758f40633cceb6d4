"""Text operators against brute force, exact round trips and held-out accuracy, on small fixtures with odd rows."""

import base64
import hashlib
import json
import math
import random
import re
import struct

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from setcast.llm import bpe, chat, common, html, langid, mixing, pii, quality, toxicity

ODD = [None, "", " \n\t\x0b ", "a", "é", "🙂🙂 x", "   b", "it's   we'll  \n\n x1y2 ", "a" * 3000 + " b", "0" * 500, "x y z v w x y z v w\nx y z v w"]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "clash") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")


def test_quality_counts_and_bounds(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice("abcdefg") for _ in range(r.randrange(60))) + r.choice(["", "\nq q\nq q\n\nq q", " #*$ <b>"]), None, None) for k in range(40)] + [(None if k == 3 else 100 + k, t, None, None) for k, t in enumerate(ODD)]

    def slow(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)} if len(windows) < 500 else set()
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = sum(x in lines[:k] for k, x in enumerate(lines))
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed

    labels = spark.createDataFrame([(k, 1, "x") for k in range(40)] + [(1, 1, "x"), (None, 1, "x")], "doc_id long, quality int, n_words string")
    got = sorted(map(str, quality.op1(docs(spark, rows), labels).drop("kept").collect()))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted("Row(doc_id={}, {})".format(x[0], ", ".join(f"{n}={v}" for n, v in zip(names, slow(x[1]), strict=True))) for x in rows)
    assert quality.op1(docs(spark, rows).limit(0), labels).count() == 0
    for n, k, p in ((30, 2, 0.2), (200, 0, 0.01), (500, 3, 0.02)):
        exact = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(exact)


def test_quality_rejects_bad_and_spares_good(spark):
    good = [(k, " ".join(f"word{(k * 31 + j) % 3001}" for j in range(60)), None, None) for k in range(3000)]
    bad = [(5000 + k, " ".join(f"w{k}{j}###%%%" for j in range(60)), None, None) for k in range(50)]
    labels = spark.createDataFrame([(x[0], 1) for x in good] + [(x[0], 0) for x in bad], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality.op1(docs(spark, good + bad), labels).collect()}
    assert not any(got[x[0]] for x in bad) and sum(not got[x[0]] for x in good) <= 0.02 * len(good)


def test_personal_data_base_and_discovered(spark):
    base = {
        "mail a.b+c@x-y.example.org, ok": "email:5:26",
        "a@b@c.d x@y": "email:2:7",
        "1.2.3.4.5 and 256.1.1.1": "ip:0:7",
        "4111 1111 1111 1111 1": "",
        "pay 4111-1111-1111-1111.": "card:4:23",
        "call +1 (212) 555-0100 now": "phone:5:22",
        "x" * 5000 + "@": "",
    }
    rows = [(k, t, None, None) for k, t in enumerate(base)] + [(None, None, None, None), (50, "", None, None)]
    got = {r["doc_id"]: r for r in pii.op6(docs(spark, rows)).collect()}
    for k, want in enumerate(base.values()):
        assert got[k]["spans"] == want, k
        assert got[k]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert got[0]["n_email"] == 1 and got[4]["n_card"] == 1 and got[2]["n_ip"] == 1 and got[5]["n_phone"] == 1
    seeds = [(100 + k, f"word {k} lorem card on file {card(k)} expires soon", None, None) for k in range(12)]
    unseen = [(200, "ipsum card on file 9990001112223 expires soon", None, None), (201, "the number 9990001112223777 alone", None, None)]
    got = {r["doc_id"]: r["spans"] for r in pii.op6(docs(spark, seeds + unseen)).collect()}
    assert got[200] == "card:19:32" and got[201] == ""
    masked = {r["doc_id"]: r for r in pii.masked(docs(spark, rows + seeds + unseen)).collect()}
    assert masked[200]["text"] == "ipsum card on file [CARD] expires soon" and masked[200]["n_chars"] == 38 and masked[None]["text"] is None
    assert pii.op6(docs(spark, rows).limit(0)).count() == 0


def test_personal_data_in_groups_of_digits(spark):
    seeds = [(100 + k, f"word {k} lorem card on file {card(k)} expires soon", None, None) for k in range(40)]
    numbers = ["555 123 4567", "30 12 34 56", "4111 1111 1111", "(017) 555-7713", "017.555.7713", "4111-1111-1111-1"]
    unseen = [(200 + k, f"ipsum card on file {x} expires soon", None, None) for k, x in enumerate(numbers)] + [(300, "on 30 12 34 56 alone", None, None), (301, "card on file 12 34 expires soon", None, None)]
    got = {r["doc_id"]: r["spans"] for r in pii.op6(docs(spark, seeds + unseen)).collect()}
    for k, x in enumerate(numbers):
        assert got[200 + k] == f"card:19:{19 + len(x)}", x
    assert got[300] == got[301] == ""


def card(k):
    body = f"4{k:014d}"
    return next(f"{body}{d}" for d in range(10) if pii._luhn(f"{body}{d}"))


def test_bpe_agrees_with_the_library(spark):
    r = random.Random(4)
    texts = ODD + ["".join(r.choice("ab é🙂\n1'st Ωж") for _ in range(r.randrange(200))) for _ in range(40)]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = docs(spark, [(k, t, None, None) for k, t in enumerate(texts)] + [(3, "a", None, None)])
    got = bpe.op10(df).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        text = texts[row["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert row["n_tokens"] == len(ids), text
        assert row["ids_sha256"] == hashlib.sha256(b"".join(struct.pack("<I", k) for k in ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.op10(df.limit(0)).count() == 0


def test_digests_of_rows_of_any_length(monkeypatch):
    tokenizer, r = bpe.Tokenizer(), random.Random(3)
    import numpy as np

    rows = [[r.randrange(50_000) for _ in range(n)] for n in (0, 5, 0, 1, 40, 7, 300, 0, 2, 2)]
    ids, ends = np.array([i for row in rows for i in row], np.int32), np.cumsum([0, *map(len, rows)])
    pieces = {rank: piece for piece, rank in tokenizer.ranks.items()}
    want = [(hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest(), hashlib.sha256(b"".join(pieces[i] for i in x)).hexdigest()) for x in rows]
    for at_once in (1, 6, 50, 1 << 18):
        monkeypatch.setattr(bpe, "_AT_ONCE", at_once)
        one, two = bpe._digested(ids, ends, *tokenizer._pieces)
        assert list(zip(one.to_pylist(), two.to_pylist(), strict=True)) == want


def test_bpe_cuts_whole_words():
    import regex

    r, find = random.Random(15), regex.compile(public_tokenizers.PATTERN).findall
    known = {" a": 0, "a": 1, " ": 2, "é": 3, "'s": 4}
    names = {v: k for k, v in known.items()}
    for k in range(400):
        texts = ["".join(r.choice("   \n\t\xa0\u2003\x1c\x85a1é.'sT日½" if j % 2 else "a .1é ', ") for _ in range(r.randrange(12))) for j in range(r.randrange(40))] + [None, ""]
        for whole in (False, True):
            codes, at, others = bpe.cut(pa.array(texts, pa.string()), find, known.get, whole)
            for j, text in enumerate(texts):
                assert [names[c] if c >= 0 else others[-1 - c] for c in codes[at[j] : at[j + 1]]] == find(text or ""), repr(text)
            assert len(set(others)) == len(others) and known.keys().isdisjoint(others)
    assert bpe.cut(pa.array([], pa.string()), find, known.get)[1].tolist() == [0]


def test_bpe_folds_every_word_alike(spark):
    """With and without words folded beforehand; unbroken words of any length; the heap and the fold agree."""
    from pyspark.sql import functions as F

    r = random.Random(14)
    tokenizer = bpe.Tokenizer()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenizer.ranks, special_tokens={})
    texts = ["".join(r.choice(s) for _ in range(n)) for s, n in (("ab", 64), ("ab", 65), ("a", 100), ("abcé", 255), ("xyz", 256), ("xyz", 257), ("é日", 700), ("thein", 100_000), ("日本語", 20_000), ("0123", 5_000))]
    words = [w for t in texts for w in tiktoken._educational.regex.findall(public_tokenizers.PATTERN, t)] if hasattr(tiktoken, "_educational") else texts
    for w in words:
        assert bpe.merged(w.encode(), tokenizer.ranks) == library.encode_ordinary(w) or w not in texts
    df = docs(spark, [(k, f"{t} the end {t[:40]}", None, None) for k, t in enumerate(texts)])
    short = df.where("length(text) < 400").select(F.col("text"), tokenizer.fold(F.substring("text", 1, 12)).alias("ids"))
    for row in short.collect():
        assert row["ids"] == bpe.merged(row["text"][:12].encode(), tokenizer.ranks)
    for some in (tokenizer, bpe.Tokenizer().learn(df, words=3)):
        got = {x["doc_id"]: x for x in bpe.encoded(df.withColumn("ids", F.lit(1)), some).withColumn("back", some.decode(F.col("ids"))).collect()}
        for k, t in enumerate(texts):
            text = f"{t} the end {t[:40]}"
            assert got[k]["ids"] == library.encode_ordinary(text), k
            assert bytes(got[k]["back"]) == text.encode()


def test_bpe_ranks_take_two_array_accesses(spark, tmp_path):
    """Ranks of joined pieces, of all other pairs none; vocabularies without some bytes, and with pieces that merges don't lead to."""
    from pyspark.sql import functions as F

    lists, r = bpe.Tokenizer()._table, random.Random(21)
    ranks = bpe.Tokenizer().ranks
    numbers, words = json.loads(lists.numbers), sorted(ranks, key=ranks.get)
    assert len(lists.numbers) < 3_000_000  # in every plan that the driver keeps

    def looked_up(a, b):
        found = numbers[numbers[a + 1] + b + 1] ^ (a + 1) << lists.bits
        return found - 1 if found < lists.none else None

    for w in r.sample(words, 3000):
        for k in range(1, len(w)):
            if w[:k] in ranks and w[k:] in ranks:
                assert looked_up(ranks[w[:k]], ranks[w[k:]]) == ranks[w]
        a, b = r.choice(words), r.choice(words)
        assert looked_up(ranks[a], ranks[b]) == ranks.get(a + b)
    small = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"abc": 4, b"bc": 5, b"cab": 7, b"abab": 6, b"aaaa": 8}
    path = tmp_path / "small.tiktoken"
    path.write_text("".join(f"{base64.b64encode(w).decode()} {k}\n" for w, k in small.items()))
    tokenizer = bpe.Tokenizer(path)
    assert tokenizer._table.alone == {b"aaaa": 8} and not tokenizer._table.whole
    words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 14))) for _ in range(300)} | {"aaaa", "cab", "aaaaa"})
    got = spark.createDataFrame([(w,) for w in [*words, "", "xab", "é"]], "w string").select("w", tokenizer.fold(F.col("w")).alias("ids")).collect()
    want = {w: [small[w.encode()]] if w.encode() in small else bpe.merged(w.encode(), small) for w in words} | {"": [], "xab": [None, 3], "é": [None, None]}
    assert {x["w"]: x["ids"] for x in got} == want


def test_bpe_plans_that_the_driver_keeps_are_short(spark):
    spark.conf.unset("spark.sql.maxPlanStringLength")
    rows = bpe.op10(docs(spark, [(1, "the end", None, None), (2, "zzqx", None, None)]))
    assert rows.count() == 2 and len(rows.collect()) == 2
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    kept = spark._jsparkSession.sharedState().statusStore().executionsList()
    assert max(len(kept.apply(k).physicalPlanDescription()) for k in range(kept.size() - 3, kept.size())) < 200_000


def test_bpe_ranks_are_not_spelled_out_in_what_the_driver_keeps_of_plans(spark):
    rows = bpe.op10(docs(spark, [(1, "the end", None, None), (2, "zzqx", None, None)]))
    query = rows._jdf.queryExecution()
    assert all(len(plan.toString()) < 200_000 for plan in (query.analyzed(), query.optimizedPlan(), query.executedPlan()))
    assert rows.count() == 2 and len(rows.collect()) == 2
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    kept = store.executionsList()
    graphs = [store.planGraph(kept.apply(k).executionId()).allNodes() for k in range(max(0, kept.size() - 8), kept.size())]
    assert max(len(nodes.apply(k).desc()) for nodes in graphs for k in range(nodes.size())) < 200_000


def test_bpe_ranks_are_held_once_for_each_session(spark):
    from pyspark.sql import functions as F

    words, tokenizer = ["the", " end", "zzqx", ""], bpe.Tokenizer()
    want = [bpe.merged(w.encode(), tokenizer.ranks) for w in words]
    for session in (spark, spark.newSession()):
        rows = session.createDataFrame(list(enumerate(words)), "k int, w string").orderBy("k")
        for _ in range(2):
            assert [x["ids"] for x in rows.select(tokenizer.fold(F.col("w"), session).alias("ids")).collect()] == want
        text = tokenizer._table.numbers
        first, again = (session.range(1).select(F.size(common.constant(session, x, "array<bigint>"))) for x in (text, text))
        assert first._jdf.queryExecution().analyzed().toString().split("variablereference(")[1].split("=")[0] in again._jdf.queryExecution().analyzed().toString()
        assert session.range(1).select(common.constant(session, "[3,null]", "array<bigint>").alias("x")).first()["x"] == [3, None]


def test_mixing_keeps_its_promises(spark):
    r = random.Random(6)
    rows = [(k, " " * (k % 2) + " ".join(f"w{k}_{j}" for j in range(r.randrange(1, 300))), None, r.choice(["a", "a", "a", "a", "b", "c", None])) for k in range(300)]
    rows += [(500 + k, t, None, "b") for k, t in enumerate(ODD[:3])] + [rows[0], rows[0], (None, "x y", None, "zero")]
    df = docs(spark, rows)
    got = [tuple(x) for x in mixing.op9(df).collect()]
    assert sorted(map(str, got)) == sorted(str(tuple(x)) for x in mixing.op9(df.repartition(7)).collect())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(x[0]), x[1]) for x in got) == sorted((str(x[0]), size(x[1])) for x in rows)
    sizes = {s: sum(size(x[1]) for x in rows if x[3] == s) for s in ("a", "b", "c", "zero", None)}
    weights, left, want = dict(zip(sizes, (3, 1, 2, 3, 1), strict=True)), 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in want]
        over = [s for s in free if left * weights[s] / sum(weights[f] for f in free) > 2 * sizes[s]]
        if not over:
            want.update({s: left * weights[s] / sum(weights[f] for f in free) for s in free})
            break
        for s in over:
            want[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(want.values())
    source = {str(x[0]): x[3] for x in rows}
    for s, total in sizes.items():
        own = [x for x in got if source[str(x[0])] == s]
        assert all(x[2] == total and x[3] == pytest.approx(want[s]) and x[4] <= 2 * x[1] for x in own)
        p, n = want[s] / sum(want.values()), sum(want.values()) / mixing.BLOCK
        assert abs(sum(x[4] for x in own) - want[s]) <= mixing.BLOCK * (2 + 5 * math.sqrt(n * p * (1 - p)))  # the draws are multinomial
    texts = mixing.mixed_texts(df).collect()
    assert sum(size(x["text"]) for x in texts) == sum(x[4] for x in got)
    assert mixing.op9(df.limit(0)).count() == 0 and mixing.mixed_texts(df.limit(0)).columns == df.columns


def test_mixing_of_many_sources(spark):
    """More sources than are compared one by one: every word is known by its source, and nothing is taken more than twice."""
    rows = [(k, " ".join(["w"] * (200 + k % 7)), None, f"s{k % 150:03d}") for k in range(600)]
    got = mixing.op9(docs(spark, rows)).collect()
    assert len(got) == 600 and all(0 <= x["taken"] <= 2 * x["size"] for x in got)
    size, taken = sum(x["size"] for x in got), sum(x["taken"] for x in got)
    assert abs(taken - 1.5 * size) <= 0.03 * size
    heavy = [x["taken"] / x["size"] for x in got if x["doc_id"] % 150 % 3 == 0]  # weight 3
    light = [x["taken"] / x["size"] for x in got if x["doc_id"] % 150 % 3 == 1]  # weight 1
    assert sum(heavy) / len(heavy) > 1.8 > 1.2 > sum(light) / len(light)


def test_mixing_slot_by_slot(spark, monkeypatch):
    """Shards, draws, permutations and words recomputed slot by slot from the library's hashes; one source dominates, one text is very long."""
    from collections import Counter

    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    monkeypatch.setattr(mixing, "GROUP", 4)
    monkeypatch.setattr(mixing, "BUCKET", 10)
    r = random.Random(16)
    rows = [(k, " ".join("w" for _ in range(r.randrange(1, 90))), None, r.choice("aaaaaaaabc")) for k in range(150)] + [(900, "long " * 5000, None, "a"), (901, None, None, "b"), (902, "", None, None)]
    plan = mixing.mix(docs(spark, rows))
    about = {x["number"]: x for x in plan.sources.collect()}
    counts = [tuple(x) for x in plan.counts().select("shard", "number", "count", "first").collect()]
    slots = plan.slots().collect()
    total = sum(x["slots"] for x in about.values())
    assert len(slots) == sum(c for _, _, c, _ in counts) == total
    # The draws: every slot's source by its hash; no redraw if all have room.
    bounds, upto = [], 0.0
    drawn = [n for n in sorted(about) if about[n]["slots"] > 0]
    for n in drawn:
        upto += about[n]["slots"] / total
        bounds.append(upto)
    us = [x[0] for x in spark.range(total).orderBy("id").select(mixing.hash01("id", seed=1)).collect()]
    want = Counter((k // 64, drawn[sum(b <= u for b in bounds[:-1])]) for k, u in enumerate(us))
    room, seen = {n: 2 * about[n]["blocks"] for n in drawn}, Counter()
    for (shard, n), c in sorted(want.items()):
        want[shard, n] = max(0, min(c, room[n] - seen[n]))
        seen[n] += c
    first = [x for x in counts if x[0] < -(-total // 64)]
    assert {(s, n): c for s, n, c, _ in first} == {k: c for k, c in want.items() if c}
    for n in drawn:  # slots numbered through the shards without a gap
        spans = sorted((f, c) for _, m, c, f in counts if m == n)
        assert all(f + c == g for (f, c), (g, _) in zip(spans, spans[1:], strict=False)) and (not spans or spans[0][0] == 0)
        own = [x for x in slots if x["number"] == n]
        passes = Counter(x["slot"] // about[n]["blocks"] for x in own)
        assert sorted(x["slot"] for x in own) == list(range(len(own))) and set(passes) <= {0, 1}
        assert all(len({x["block"] for x in own if x["slot"] // about[n]["blocks"] == k}) == passes[k] for k in passes)
    assert all(sorted(x["place"] for x in slots if x["shard"] == s) == list(range(sum(c for t, _, c, _ in counts if t == s))) for s in {x["shard"] for x in slots})
    # Words: documents end to end, blocks of 32, each slot adds those of its block.
    taken, at = Counter(), {(x["number"], x["first"]): x for x in plan.docs.where("size > 0").collect()}
    for x in slots:
        for (n, f), d in at.items():
            if n == x["number"]:
                taken[d["doc_id"]] += max(0, min(f + d["size"], (x["block"] + 1) * 32) - max(f, x["block"] * 32))
    got = {x["doc_id"]: x["taken"] for x in plan.taken().collect()}
    assert got == {k: taken[k] for k, *_ in rows}
    order = plan.order().groupBy("doc_id").agg(F.sum(F.col("high") - F.col("low")).alias("n")).collect()
    assert {x["doc_id"]: x["n"] for x in order} == {k: n for k, n in taken.items() if n}


def test_draws_of_few_and_many_sources_agree(spark, monkeypatch):
    r = random.Random(17)
    weights = [(3 * n, r.random()) for n in range(30)]
    draw = lambda: {tuple(x) for x in mixing.drawn(spark.range(20_000), weights, 5).collect()}
    few = draw()
    monkeypatch.setattr(mixing, "CHAIN", 0)
    assert few == draw() and sum(x[2] for x in few) == 20_000 and {x[1] for x in few} == {n for n, _ in weights}


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 64, 1000):
        got = [x[0] for x in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5))).collect()]
        assert sorted(got) == list(range(n)) and (n < 50 or got != list(range(n)))


def test_languages_held_out(spark):
    r = random.Random(8)
    parts = {"en": "th er in ed and ing", "de": "sch ein ung der ch ge", "fr": "eau ou é que oi ê", "es": "ción os la ñ ar ez"}
    say = lambda lang: " ".join("".join(r.choice(parts[lang].split()) for _ in range(3)) for _ in range(40))
    rows = [(k, say(lang), lang, None) for k, lang in enumerate(r.choice(list(parts)) for _ in range(400))] + [(900 + k, t, "en", None) for k, t in enumerate(ODD)] + [(None, "thing and", None, None)]
    got = langid.op2(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    held = [x for x in got if x["held_out"] and x["doc_id"] < 900]
    truth = {x[0]: x[2] for x in rows}
    assert len(held) > 60 and sum(x["lang_pred"] == truth[x["doc_id"]] for x in held) >= 0.97 * len(held)
    und = {x["doc_id"] for x in got if x["lang_pred"] == "und"}
    assert und == {900, 901, 902, 909}
    assert all(0 <= x["score"] <= 1 for x in got)
    assert langid.op2(docs(spark, rows).limit(0)).count() == 0


def test_language_training_is_whole_and_in_small_batches():
    import pandas as pd

    assert langid.PER_LANGUAGE >= 500 and langid.DIM >= 2048 and len(langid.features("abc")) == langid.DIM
    texts = ["ab cd", None, "12"] * 100
    parts = list(langid._vectors(iter([pd.DataFrame({"lang": ["en"] * 300, "text": texts})])))
    assert sum(map(len, parts)) == 100 and max(map(len, parts)) <= 64
    assert all((x == langid.features("ab cd")).all() for p in parts for x in p["x"])


def test_toxicity_held_out(spark):
    r = random.Random(9)
    say = lambda bad: " ".join([r.choice("the of and in over under tree house sky".split()) for _ in range(40)] + ["you idiot", "pathetic scum", "zorgl zorgl"] * bad)
    rows = [(k, say(k % 4 == 0), None, None) for k in range(600)] + [(900 + k, t, None, None) for k, t in enumerate(ODD)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(600)] + [(4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.op7(docs(spark, rows), labels).collect()
    held = [x for x in got if x["held_out"] and x["doc_id"] < 600]
    assert len(got) == len(rows) and sum(x["predicted"] == (x["doc_id"] % 4 == 0) for x in held) >= 0.97 * len(held)
    assert all(0 <= x["score"] <= 1 for x in got)
    assert {x["score"] for x in toxicity.op7(docs(spark, rows), labels.limit(0)).collect()} == {0.0}


def test_main_text(spark):
    body = '<div class="post-{}"><h1>T &amp; t</h1><p>One <b>two\n three</b><p>four<br>five</p><ul><li>six</div>'
    page = '<html><head><title>x</title><style>p{}</style></head><body><nav><a href="/">menu</a></nav><div class="ad">buy</div>' + body + '<div id="comments"><p>first!</p></div><form>f</form><footer>foot</footer>'
    rows = [(k, f"https://h.example/{k}", page.replace("post-{}", f"post-{k}")) for k in range(4)] + [(10, "https://h.example/z", "<p>bare</p>"), (11, None, None), (12, "x", ""), (12, "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS host")
    got = sorted((x["page_id"], x["text"], x["n_chars"]) for x in html.op8(df).collect())
    want = "T & t\n\nOne two three\n\nfour five\n\nsix"
    assert got == [(k, want, len(want)) for k in range(4)] + [(10, "bare", 4), (11, "", 0), (12, "", 0), (12, "", 0)]
    assert html.op8(df.limit(0)).count() == 0


def test_main_text_is_whole(spark):
    long, lead = "Long body text. " * 40, "A lead of the story."
    nested = f"<body><article><h1>Title</h1><p>{lead}</p><div class=content><p>{long}</p></div></article>"
    split = f"<body><div class=post><h1>Title</h1><div class=intro><p>{lead * 5}</p></div><div class=body><p>{long}</p></div></div>"
    other = f"<body><article><div class=content>Share it</div></article><div class=story><p>{long}</p></div>"
    rows = [(k, "https://a.example/", nested) for k in range(9)] + [(9, "https://a.example/", other), (10, "https://b.example/", split), (11, "https://b.example/", split)]
    got = {x["page_id"]: x["text"] for x in html.op8(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == f"Title\n\n{lead}\n\n{long.strip()}"
    assert long.strip() in got[9]
    assert got[10] == got[11] == f"Title\n\n{lead * 5}\n\n{long.strip()}"


def test_pages_of_any_depth():
    import time

    began = time.process_time()
    assert html.extract("<body>" + "<div class=a1>" * 8000 + "<p>deep text here</p>", None) == "deep text here"
    got = html.extract("<body>" + "".join(f"<div class=a{k}>text {k} " for k in range(3000)), None)
    assert got.startswith("text 0") and got.endswith("text 2999") and got.count("text") == 3000
    assert html.extract("<body><p>" + "<b>x" * 20_000 + "</i>" * 20_000 + "</p><p>end</p>", None) == "x" * 20_000 + "\n\nend"
    assert html.extract("<body>" + "<p>a" * 20_000, None).count("a") == 20_000
    assert html.extract("<body><i><div>" + "<b>" * 20_000 + "</i>" * 20_000 + "z", None) == "z"
    assert len(html.extract("<article>" + "<p>word</p>" * 50_000 + "</article>", None)) == 50_000 * 6 - 2
    assert time.process_time() - began < 30


def test_articles_keep_their_parts():
    """An article's sections, a lead beside the body and a table among prose all belong to it; ties go to the path that sorts first."""
    prose, cells = "Some prose of the story. " * 8, "".join(f"<tr><td>cell {k} of the long table</td><td>{k}</td></tr>" for k in range(60))
    page = "<body><article><h1>T</h1><section class=intro><p>In.</p></section><section class=body><p>" + prose * 5 + "</p></section><section class=end><p>Out.</p></section></article>"
    got = html.extract(page, None)
    assert got.startswith("T\n\nIn.\n\nSome prose") and got.endswith("Out.")
    assert html.extract(f"<main><div class=lead><h1>Head</h1></div><div class=content><p>{prose}</p></div></main>", None) == f"Head\n\n{prose.strip()}"
    got = html.extract(f"<body><article><p>{prose}</p><table>{cells}</table><p>After it.</p></article><div class=ad>buy</div>", None)
    assert prose.strip() in got and "cell 59" in got and got.endswith("After it.")
    assert html.votes(html.parsed("<div class=b><p>same</p></div><div class=a><p>same</p></div>"))[0][0] == ">div.a"


def test_layouts_named_like_boilerplate_are_not_hidden():
    article = "<article><p>The long story of the day, told in full.</p></article>"
    for wrap in ("<div class='layout no-sidebar'>{}</div>", "<div id='content-with-sidebar'>{}</div>", "<div class='has-comments'>{}</div>", "<form>{}</form>", "<div class='sidebar'>{}</div>"):
        assert html.extract(f"<body>{wrap.format(article)}<div class='ad'>buy</div>", None) == "The long story of the day, told in full.", wrap
        assert html.extract(f"<body>{wrap.format(article.replace('article', 'div'))}<div class='ad'>buy</div>", None).startswith("The long"), wrap
    page = f"<body>{article}<div id='comments'><article class='comment-body'><p>{'first! ' * 50}</p></article></div><form>f</form><div class='related-posts'>more</div>"
    assert html.extract(page, None) == "The long story of the day, told in full."
    assert html.extract("<body><div>a <span class='share'>tweet</span> b</div>", None) == "a b"


def test_perspectives_agree_with_sql(spark):
    """Repeated rows, null turns and roles, and dialogues beyond a row's turns, some with one turn number for all."""
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 2000, "ann", "🙂"), (2, None, None, "x"), (None, 0, "c", "y"), (3, 0, "system", "alone"), (1, None, "bob", "")]
    rows += [(4, k if k % 3 else None, "ann" if k % 2 else "bob", f"t{k}") for k in range(2500)] + [(5, 7, "eve", "same")] * 1500 + [(6, 0, "eve", "long " * 50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    names = ["conv_id", "perspective", "segment", "start", "n_turns", "text", "mask", "n_masked"]
    got = chat.op5(df.selectExpr("*", "1 AS mask", "2 AS place", "3 AS part")).select(*names).collect()
    con = duckdb.connect()
    con.register("rows", pa.table({c: [r[k] for r in rows] for k, c in enumerate(("conv_id", "turn", "role", "text"))}))
    con.sql("CREATE TABLE conversations AS SELECT * FROM rows")
    assert sorted(map(str, map(tuple, got))) == sorted(str(x) for x in con.sql(chat.SQL).select(*names).fetchall())
    whole = "".join(x["text"] for x in sorted(got, key=lambda x: x["segment"]) if x["conv_id"] == 4 and x["perspective"] == "ann")
    spans = [tuple(map(int, s.split(":"))) for x in got if x["conv_id"] == 4 and x["perspective"] == "ann" for s in x["mask"].split(",")]
    assert len(spans) == 1250 and all(whole[: a].endswith("<|im_start|>assistant\n") and whole[a:b].endswith("<|im_end|>\n") for a, b in spans)
    assert chat.op5(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(3)
    texts = [" ".join(r.choice(["thing", "and", "over", "tree", "sky", "lamp", "rock"]) + str(r.choice("abc")) for _ in range(80)) for _ in range(30)]
    rows = [(k, t, "en", "s1", len(t)) for k, t in enumerate(texts)] + [(100 + k, t, "en", "s2", 1) for k, t in enumerate(texts[:5])] + [(200, "123 456", "en", "s1", 7), (201, None, None, None, None), (202, texts[7] + " me@x.example", "en", "s1", 1), (203, "½ ① ²³", "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    plain = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clashing = plain.selectExpr("*", "'kept' AS score", "'kept' AS lang_pred", "'kept' AS _lang", "'kept' AS row", "'kept' AS found", "'kept' AS key", "'kept' AS fp", "'kept' AS c", "'kept' AS spans")
    for docs in (plain, clashing, clashing.limit(0)):
        found = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, found, str(tmp_path))
            assert found.dtypes == docs.dtypes, name
        kept = found.collect()
        if docs is clashing:
            assert len(kept) >= 29 and all(x[c] == "kept" for x in kept for c in docs.columns[5:])
    assert kept == [] and corpus_pipeline.STAGES[-1][1](spark, found, str(tmp_path)).collect() == []
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in got} <= set(range(30)) | {202} and len({x["doc_id"] for x in got}) >= 29


def test_pipeline_keeps_one_of_each_group(spark):
    """Several texts of one id are told apart; which of them stay does not depend on the order of rows."""
    import corpus_pipeline

    long = [" ".join(f"w{k}_{j}" for j in range(50)) for k in range(6)]
    rows = [(1, long[0], "a"), (1, long[1], "b"), (1, long[1], "c"), (2, long[0], "d"), (None, long[2], "e"), (None, long[2], "f"), (3, None, "g"), (4, "", "h"), (5, long[3], "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert sorted(str(x["text"])[:5] for x in got) == sorted(["w0_0 ", "w1_0 ", "w2_0 ", "None", "w3_0 "])
    assert {x["source"] for x in got if x["doc_id"] not in (1, None)} == {"g", "i"} and {"a"} <= {x["source"] for x in got}
    for parts in (1, 7):
        assert sorted(map(str, corpus_pipeline.near_duplicates(spark, df.repartition(parts, "source"), "").collect())) == sorted(map(str, got))


def test_number_signs_are_no_letters(spark):
    assert [langid.letters(t) for t in ("½ ②x² Ⅷ", "été_1a", None, "²³ ①")] == [["x"], ["été", "a"], [], []]
    assert langid.features("²³ ½ ①") is None


def test_language_votes_by_hand(spark):
    """Predictions recomputed from the model's weights, with features counted gram by gram."""
    import numpy as np

    r = random.Random(18)
    parts = {"en": "th er in ed", "de": "sch ein ung der", "nl": "ij oe een van", "fr": "eau ou é que", "es": "ción os la ñ"}
    rows = [(k, " ".join(r.choice(parts[lang].split()) + r.choice("abc") for _ in range(20)), lang, None) for k, lang in enumerate(r.choice(list(parts)) for _ in range(150))]
    model = langid.train(docs(spark, rows))
    assert sorted(model.languages["germanic"]) == ["de", "en", "nl"] and sorted(model.languages["romance"]) == ["es", "fr"]

    def slow(text):
        s, mask, counts = "  " + " ".join(langid.letters(text)) + " ", (1 << 64) - 1, np.zeros(langid.DIM)
        for k in range(2, len(s)):
            h = ord(s[k]) * 0x9E3779B97F4A7C15 & mask
            for f in (lambda h: h, lambda h: (h ^ ord(s[k - 1]) + 1) * 0xC2B2AE3D27D4EB4F & mask, lambda h: (h ^ ord(s[k - 2]) + 2) * 0x165667B19E3779F9 & mask):
                h = f(h)
                counts[h >> 64 - langid.DIM.bit_length() + 1] += 1
        x = np.sqrt(counts) / np.linalg.norm(np.sqrt(counts))
        own = model.languages[model.families[int(np.argmax(model.weights @ x + model.bias))]]
        wins = {a: 0 for a in own}
        for a in own:
            for b in own:
                if a < b:
                    w, c = model.pairs[a, b]
                    wins[b if w @ x + c > 0 else a] += 1
        return {a for a in own if wins[a] == max(wins.values())}

    for _, text, _, _ in rows[:60]:
        assert model.predict(text)[0] in slow(text)
    assert langid.Model([], np.zeros((0, 1)), np.zeros(0), {}, {}).predict("abc") == ("und", 0.0)


def test_quality_of_very_long_texts_and_copies(spark):
    r = random.Random(21)
    words = [r.choice("abcdef") for _ in range(9000)]
    plain = quality._LARGE
    try:
        got = quality.repeated_words(words), quality.repeated_words(words[:5000] + [f"u{k}" for k in range(5000)]), quality.repeated_words(["x"] * 300_000)
        quality._LARGE = 1 << 60
        assert got == (quality.repeated_words(words), quality.repeated_words(words[:5000] + [f"u{k}" for k in range(5000)]), 300_000)
    finally:
        quality._LARGE = plain
    # A thousand copies of one good document are one draw: no bound can be told from it, so no rule rejects.
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(k, text, None, None) for k in range(1000)] + [(2000, " ".join(f"w{k}###" for k in range(60)), None, None)]
    labels = spark.createDataFrame([(k, 1) for k in range(1000)], "doc_id long, quality int")
    assert all(x["kept"] for x in quality.op1(docs(spark, rows), labels).collect())


def test_toxicity_features_by_hand():
    learned = {"zorgl": 2.0}
    text = "You IDIOT! y0u id1ot zorgl tree tree tree tree tree tree fool"
    words = "you idiot you idiot zorgl tree tree tree tree tree tree fool".split()
    n, bad = len(words), [w in toxicity.ABUSE or w in learned for w in words]
    near = sum(any(words[j] in toxicity.SECOND for j in range(max(0, k - 5), k)) for k in range(n) if bad[k]) + sum(any(bad[j] for j in range(max(0, k - 5), k)) for k in range(n) if words[k] in toxicity.SECOND)
    got = dict(zip(toxicity.FEATURES, toxicity.features(text, learned), strict=True))
    assert got["abuse_count"] == 3 and got["learned_count"] == 1 and got["second_density"] == 2 / n and got["near_count"] == near
    assert got["learned_weight"] == 2 / math.sqrt(n) and got["obfuscated_rate"] == 2 / n and got["obfuscated_abuse"] == 1 and got["mark_rate"] == 1 / n
    assert got["log_words"] == math.log1p(n) and got["capital_share"] == 6 / sum(c.isascii() and c.isalpha() for c in text)
    assert toxicity.features(None, {}) == toxicity.features("", {}) == [0.0] * len(toxicity.FEATURES)
    assert toxicity.features("you idiot " * 200_000, learned)[1] == 200_000


def test_secrets_are_discovered_from_assignments(spark):
    """Seeds in assignments induce patterns that reach values of another shape; long hexadecimal values elsewhere stay alone."""
    r = random.Random(12)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(38)) + "a1" for _ in range(30)]
    rows = [(k, f"word{k} x{k}y token = \"{h}\" more{k}", None, None) for k, h in enumerate(hexes)]
    rows += [(100, 'q token = "short-12345-x" z', None, None), (101, f"commit {hexes[0][::-1]} of b", None, None), (102, 'TOKEN = "' + "ab1" * 200 + '"!! Z!!', None, None), (103, "x" * 200 + "12345" * 40 + " alone", None, None)]
    got = {x["doc_id"]: x for x in pii.op6(docs(spark, rows)).collect()}
    for k, (_, text, _, _) in enumerate(rows[:30]):
        start = text.index('"') + 1
        assert got[k]["spans"] == f"secret:{start}:{start + 40}" and got[k]["n_card"] == 0
    assert got[100]["spans"] == "secret:11:24" and got[102]["spans"] == "secret:9:609" and got[101]["spans"] == got[103]["spans"] == ""
    assert all(x["base_sha256"] == hashlib.sha256(b"").hexdigest() for x in got.values())


def test_pattern_rounds_by_brute_force(spark):
    r = random.Random(30)
    edges = [(f"p{r.randrange(25)}", f"v{r.randrange(60)}", r.choice([None, None, 0, 2])) for _ in range(500)]
    accepted = {(v, k) for _, v, k in edges if k is not None}
    values = {}
    for p, v, _ in edges:
        values.setdefault(p, set()).add(v)
    for rounds in (1, 2, 3):
        held = set(accepted)
        for k in range(rounds):
            sure = {(p, kind, n / len(vs)) for p, vs in values.items() for kind in (0, 2) if (n := sum((v, kind) in held for v in vs)) >= 4 and n / len(vs) >= 0.6}
            held |= {(v, kind) for p, kind, _ in sure for v in values[p]}
        got = {tuple(x) for x in pii.patterns(spark.createDataFrame(edges, "pattern string, value string, kind long"), 4, 0.6, rounds).collect()}
        assert {(p, k, round(c, 9)) for p, k, c in got} == {(p, k, round(c, 9)) for p, k, c in sure}
    assert pii.patterns(spark.createDataFrame([], "pattern string, value string, kind long")).count() == 0
    # What looks like a seed speaks for nothing until it is accepted: 4 seeds of 4 + 8 values that count, 4 of 4 beside 8 that look like them.
    rows = [("p", f"s{k}", 4) for k in range(4)] + [("p", f"x{k}", None) for k in range(8)] + [("q", f"s{k}", 4) for k in range(4)] + [("q", f"y{k}", pii.ALIKE) for k in range(8)]
    got = pii.patterns(spark.createDataFrame(rows, "pattern string, value string, kind long"), 4, 0.75, 2).collect()
    assert [tuple(x) for x in got] == [("q", 4, 1.0)]


def test_half_of_the_secrets_are_found_by_the_other_half(spark):
    """Values that are no seeds themselves: precision and recall of what patterns find, among long hexadecimal values of no secret."""
    r = random.Random(14)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(38)) + "a1" for _ in range(200)]
    rows = [(k, f"word{k} of the text; api_key = \"{h}\" and more{k}", None, None) for k, h in enumerate(hexes)]
    rows += [(1000 + k, f"commit {h[::-1]} in build{k} of {h[5:]}", None, None) for k, h in enumerate(hexes)]
    seeds = {k for k, h in enumerate(hexes) if any(i[3] == pii.SECRET for i in pii.instances(rows[k][1])[1])}
    assert 70 < len(seeds) < 130
    got = {x["doc_id"]: x["spans"] for x in pii.op6(docs(spark, rows)).collect()}
    found = {k for k, s in got.items() if s}
    assert found == set(range(200)) and all(got[k] == f"secret:{rows[k][1].index(hexes[k])}:{rows[k][1].index(hexes[k]) + 40}" for k in set(range(200)) - seeds)


def test_base_spans_by_plain_patterns():
    """The contract's patterns as they stand, on random strings of the signs that matter."""
    email, ip = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    card, phone = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"
    digits = lambda x: re.sub("[^0-9]", "", x)
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    fine = (lambda m: True, lambda m: all(int(x) <= 255 for x in m.split(".")), lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 10 <= len(digits(m)) <= 15)
    r = random.Random(40)
    for k in range(4000):
        alphabet = r.choice(["ab@.- 1", "0123456789. ", "0123456789 -", "+0123456789 ().-", "a1@.+- ()"])
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
        want = sorted((m.start(), kind, m.end()) for kind, p in enumerate((email, ip, card, phone)) for m in re.finditer(p, text) if fine[kind](m[0]))
        assert pii.base_spans(text) == want, text
    long = "1.2.3.4 a@b.c " * 20_000
    assert len(pii.instances(long)[0]) == 40_000


def test_written_tables_are_released(spark):
    from setcast.llm import common

    before = common.left()
    one, two = common.written(spark.range(3), "one"), common.written(spark.range(4), "two")
    assert len(common.left() - before) == 2
    common.release(spark, common.left() - before, reading=one.where("id > 0"))
    assert one.count() == 3 and len(common.left() - before) == 1
    common.dropped(one)
    assert common.left() == before
    with pytest.raises(Exception, match="(?i)exist|found"):
        two.count()


def test_results_of_stages_stay_readable_side_by_side(spark):
    """A stage deletes nothing that another stage's result still reads; run() leaves only what its result reads."""
    import corpus_pipeline
    from setcast.llm import common

    one = docs(spark, [(k, f"some words of text number {k} in one table", "en", "a") for k in range(20)])
    two = docs(spark, [(k, f"other words for text {k} in a second table", "en", "b") for k in range(30)])
    a, b = corpus_pipeline.near_duplicates(spark, one, ""), corpus_pipeline.near_duplicates(spark, two, "")
    c = corpus_pipeline.personal_data(spark, a, "")
    assert a.count() == c.count() > 0 and b.count() > 0


def test_stages_begin_with_a_driver_that_lets_go_of_what_is_finished(spark, monkeypatch):
    import weakref

    import corpus_pipeline
    from setcast.llm import common

    held = [spark.range(3)]
    held.append(held)  # a cycle, as closures make them
    seen = weakref.ref(held[0])
    del held
    common.collected(spark)
    assert seen() is None
    calls = []
    monkeypatch.setattr(corpus_pipeline, "collected", calls.append)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    for name in ("near_duplicates", "personal_data", "mixture"):
        getattr(corpus_pipeline, name)(spark, docs, "")
    assert calls == [spark] * 3
