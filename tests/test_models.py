"""Donors, generation, BPE and compression on hand-made rows, against plain Python."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomline.operators import models as M
from loomline.operators import ngrams as N
from loomline.operators import pairs as P


def test_donors_are_of_other_groups_and_enough(spark):
    rows = [(i, "big" if i < 60 else f"g{i % 7}") for i in range(100)]
    got = P.donors(spark.createDataFrame(rows, "name long, g string"), "name", "g", 3, 1).collect()
    of = dict(rows)
    by = {}
    for r in got:
        by.setdefault(r.name, []).append(r.donor)
        assert of[r.name] != of[r.donor]
    assert set(by) == set(of) and all(len(set(x)) == len(x) == 3 for x in by.values())
    most = [(i, "big" if i < 990 else "rest") for i in range(1000)] + [(2000, None)]
    got = Counter(r.name for r in P.donors(spark.createDataFrame(most, "name long, g string").repartition(5), "name", "g", 4, 1).collect())
    assert got == dict.fromkeys([i for i, _ in most], 4)  # eleven pairs of other groups are enough for a group of 990
    few = P.donors(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "name long, g string"), "name", "g", 3, 1).collect()
    assert sorted((r.name, r.donor) for r in few if r.name < 3) == [(1, 3), (2, 3)] and {r.donor for r in few if r.name == 3} == {1, 2}


def test_default_budget_is_that_of_the_shortest_summary(spark):
    df = spark.createDataFrame([(1, "a b c d", "x y z"), (2, "a b", "x y"), (3, "a b c", ""), (4, None, "x y z w")], "k int, source string, summary string")
    got = P.judge(df, F.col("source"), F.col("summary"), 3)
    assert {r.k: r.reason for r in got.collect()} == {1: None, 2: "short source", 3: "no summary", 4: "no source"} and got.columns == ["k", "source", "summary", "reason"]


def test_generation_rolls_its_context(spark):
    text = "a b c a b d a b c e b c a"
    one = spark.createDataFrame([(text,)], "text string")
    pick = lambda counts: M.selection(M.probabilities(counts), 1.0, 2, 0.9)
    models = [pick(M.trigram_counts(one)), pick(M.bigram_counts(one))]
    got = {}
    for r in M.generate(spark.createDataFrame([(i, "a") for i in range(6)] + [(9, "zz")], "name long, tok string"), models, 4, 3).orderBy("step").collect():
        got.setdefault(r.name, []).append(r.tok)
    w = text.split()
    counts = {n: Counter((" ".join(w[i : i + n]), w[i + n]) for i in range(len(w) - n)) for n in (1, 2)}
    for name in range(6):
        said = ["a"]
        for step in range(1, 5):
            u = int(hashlib.md5(f"3|{name}|{step}".encode()).hexdigest()[:7], 16) / (1 << 28)
            for n in (2, 1):
                ctx = " ".join(said[-n:])
                seen = sorted(((-c, t) for (x, t), c in counts[n].items() if x == ctx and len(said) >= n))
                if seen:
                    break
            if not seen:
                break
            total = -sum(c for c, _ in seen)
            seen, kept, mass = seen[:2], [], 0.0
            for c, t in seen:
                if mass < 0.9 - 1e-9:
                    kept.append((-c, t))
                mass += -c / total
            whole, cum = sum(c for c, _ in kept), 0.0
            for c, t in kept:
                cum += c / whole
                if cum > min(u, 1 - 1e-12):
                    said.append(t)
                    break
        assert got[name] == said, name
    assert got[9] == ["zz"]


def test_experts_must_share_their_vocabulary(spark):
    a, b = (M.letter_model(spark.createDataFrame([(t,)], "text string"), "ab ") for t in ("ab ba", "aab"))
    M.same_vocabulary(a, b)
    assert all(abs(r.s - 1) < 1e-12 for r in a.groupBy("ctx").agg(F.sum("p").alias("s")).collect())
    with pytest.raises(M.VocabularyMismatch):
        M.same_vocabulary(a, b.where("tok <> 'b'"))


def plain_bpe(words, most):
    seqs, merges = {w: [f"{b:02X}" for b in (" " + w).encode()] for w in words}, []
    for _ in range(most):
        pairs = Counter()
        for w, s in seqs.items():
            for p in zip(s, s[1:]):
                pairs[p] += words[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append(best)
        for w, s in seqs.items():
            out, i = [], 0
            while i < len(s):
                hit = tuple(s[i : i + 2]) == best
                out.append(s[i] + s[i + 1] if hit else s[i])
                i += 1 + hit
            seqs[w] = out
    return merges, seqs


def test_bpe_against_a_plain_one(spark):
    words = {"low": 5, "lower": 2, "newest": 6, "widest": 3, "é": 4, "aaaaa": 3, "aaaab": 2, "abab": 6, "ababab": 1, "bcbcd": 6, "xyxyxy": 2, "q": 1}
    df = spark.createDataFrame(list(words.items()), "word string, c long")
    for n in (6, 30, 500):  # the last one merges all there is
        want, seqs = plain_bpe(words, n)
        merges = M.train_bpe(df, M.FIRST_MERGED + n)
        assert merges == want
    symbols = {a + b: 257 + i for i, (a, b) in enumerate(merges)}
    got = {r.word: list(r.ids) for r in M.encode_bpe(df, merges).collect()}
    for w in words:
        assert len(got[w]) == len(seqs[w]) and all(symbols.get(s, i) == i for s, i in zip(seqs[w], got[w]))
    assert M.encode_bpe(spark.createDataFrame([("!",)], "word string"), merges).first().ids == [221, 1]


def test_rounds_of_many_merges_are_those_of_a_plain_trainer(spark, monkeypatch):
    rng = random.Random(4)
    words = Counter("".join(rng.choice(["th", "e", "in", "er", "on", "a", "st", "qu"]) for _ in range(rng.randint(1, 5))) for _ in range(3000))
    df = spark.createDataFrame(list(words.items()), "word string, c long")
    want, _ = plain_bpe(words, 60)
    for known, ahead in ((1000, (12, 200)), (25, (3, 8))):
        monkeypatch.setattr(M, "KNOWN", known)
        monkeypatch.setattr(M, "AHEAD", ahead)
        rounds, plain_round = [], M._round
        monkeypatch.setattr(M, "_round", lambda *a, f=plain_round, n=rounds: n.append(1) or f(*a))
        assert M.train_bpe(df, M.FIRST_MERGED + 60) == want
        monkeypatch.setattr(M, "_round", plain_round)
        assert len(rounds) <= 25


def test_encoded_documents_and_coverage(spark):
    docs = [(1, "Low lower, lowest! low", "en"), (2, None, "en"), (3, "", "fr"), (4, "newest low x", None), (None, "it's", "fr")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    merges = M.train_bpe(N.word_counts(df), M.FIRST_MERGED + 8)
    coded = {r.word: list(r.ids) for r in M.encode_bpe(N.word_counts(df), merges).collect()}
    said = lambda t: re.findall("[a-z']+", (t or "").lower())
    assert {r.doc_id: (r.n_words, list(r.ids)) for r in M.encode_documents(df, merges).collect()} == {k: (len(said(t)), [i for w in said(t) for i in coded[w]]) for k, t, _ in docs}
    got = {(r.lang, r.vocabulary): (r.n_words, r.n_chars, r.n_tokens) for r in M.coverage(df, merges, [257, 265], "lang").collect()}
    en = said(docs[0][1])
    assert got["en", 257] == (4, sum(map(len, en)) + 4, sum(map(len, en)) + 4) and got["en", 265] == (4, sum(map(len, en)) + 4, sum(len(coded[w]) for w in en))


def test_compression_ladder(spark):
    texts = ["a" * 100, "abcd" * 30 + "é"]
    got = N.ladder(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert got[0].order0 == 0 and abs(got[1].order0 - sum(c / 121 * math.log(121 / c) for c in Counter(texts[1]).values())) < 1e-12
    assert [r.gzip for r in got] == [8 * len(gzip.compress(t.encode(), 9)) * math.log(2) / len(t) for t in texts]
    assert all(0 < r.xz < 8 for r in got)


def test_slices_against_the_rest_of_their_text(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "sea", "is", "cold", "Salt's", "wide", "grey"]) for _ in range(90)) for _ in range(4)] + ["a b c", "", "x " * 60 + "the end", None]
    rows = [(i, k, t, 1 + 37 * k % max(1, len(t or "") - 80)) for i, t in enumerate(texts) for k in range(4)]
    got = {(r.i, r.k): r for r in N.against_rest(spark.createDataFrame(rows, "i int, k int, text string, start int"), ["i", "k"], "text", "start", 80).collect()}
    assert len(got) == len(rows)
    cut = lambda t: re.findall("[a-z']+", t.lower())
    bag = lambda w, n: list(zip(*(w[j:] for j in range(n)), strict=False))
    for i, k, t, start in rows:
        r, w = got[i, k], cut((t or "")[start - 1 : start + 79])
        if len(w) < 12:
            assert (r.words, r.self_repeat, r.verb3, r.verb5, r.novel_words, r.ttr) == (None,) * 6
            continue
        rest = cut(t[: start - 1] + t[start + 79 :])
        met = [sum(g in set(bag(rest, n)) for g in bag(w, n)) / max(1, len(w) - n + 1) for n in (3, 5)]
        want = (len(w), 1 - len(set(bag(w, 4))) / (len(w) - 3), *met, len(set(w) - set(rest)) / len(set(w)), len(set(w)) / len(w))
        assert all(abs(a - b) < 1e-12 for a, b in zip((r.words, r.self_repeat, r.verb3, r.verb5, r.novel_words, r.ttr), want, strict=True))
