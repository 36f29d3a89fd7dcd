"""Packing: plans against what a plan must be, pieces and sequences against the tokenizers library."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import packing

own = np.random.default_rng(3)


def lengths(kind):
    x = np.exp(own.normal(6.3, 1.0, 4000)).astype(int) + 1
    return {
        "wide": Counter((x[x < 4096]).tolist()), "one": {7: 1}, "ones": {1: 9000}, "thirds": {1400: 700, 1300: 500}, "none": {},
        "large": Counter(own.integers(2049, 4096, 3000).tolist()), "hot": {812: 5000, 4096: 30, 33: 200}, "waste": {3000: 1000},
    }[kind]


@pytest.mark.parametrize("kind", ["wide", "one", "ones", "thirds", "none", "large", "hot", "waste"])
def test_plan_places_each_token_once(kind):
    counts = lengths(kind)
    plan = packing.Plan(counts)
    length = np.repeat(list(counts), list(counts.values())).astype(np.int64)
    rank = np.concatenate([np.arange(c) for c in counts.values()] or [np.zeros(0, int)]).astype(np.int64)
    item, start, n, sequence, offset, whole = plan.place(length, rank)
    for group, at, size in ((item, start, length), (sequence, offset, None)):
        by = np.lexsort((at, group))
        g, s, k = group[by], at[by], n[by]
        first = np.r_[True, g[1:] != g[:-1]][: len(g)]
        assert (s[first] == 0).all() and (s[1:][~first[1:]] == (s + k)[:-1][~first[1:]]).all()  # no gap, no overlap
        if size is not None:
            assert (np.bincount(group, n, len(length)) == size).all()
    sizes = np.bincount(sequence, n).astype(int)
    assert len(sizes) == plan.sequences and (sizes > 0).all() and (sizes <= 4096).all()
    padding = sum(0 if x & (x - 1) == 0 else 4096 - x for x in sizes.tolist())
    assert padding <= 0.005 * length.sum()
    assert (n > 0).all() and (start[whole] == 0).all() and (n[whole] == length[item[whole]]).all()


def test_columns_are_generated_where_first_fit_is_poor():
    width, demand = np.array([506, 262, 256, 238]), np.array([600, 600, 600, 1200])  # greedy takes eleven ninths of the best
    greedy = sum(t for _, t in packing.first_fit(width, demand, 1000, whole=True))
    found, bound = packing.patterns(width, demand, 1000)
    used = sum(t for _, t in found)
    assert (sum(n * t for n, t in found) == demand).all() and all(width @ n <= 1000 for n, _ in found)
    assert bound <= used + 1e-6 and used <= bound + len(width) and used <= 904 and greedy >= 1090


def test_knapsack_against_all_choices():
    for _ in range(20):
        w, v, room = own.integers(1, 9, 4), own.random(4), 17
        best = np.zeros(room + 1)
        for c in range(1, room + 1):
            best[c] = max([best[c - 1], *(best[c - a] + b for a, b in zip(w, v) if a <= c)])
        value, n = packing.knapsack(w, v, room)
        assert abs(value - best[room]) < 1e-12 and w @ n <= room and abs(v @ n - value) < 1e-12


ODD = ["", None, "Hello WORLD's don't we'll", "tab\tline\n\x0bform\x0cx", "a\x1cb \x1d\x1e c\x1fd", "\xa0nbsp em　wide​zero", "é ́x ö", "ΣΑΣ ΟΔΟΣ İstanbul", "x<|endoftext|>y <|startoftext|>", "12345 3.14 a1b2", "漢字 かな ✓ 🙂🙂", "\x00 nul", "word" * 300, " ogham  line para \x85next"]


def test_ids_are_the_librarys():
    pytest.importorskip("public_tokenizers")
    words, plain = packing.Words(packing.vocabulary_path()), library()
    signs = [*map(chr, range(0x20, 0x250)), "́", "漢", "'s", "'LL", "<|", "|>", "<|endoftext|>", "ﬁ", "Σ"]
    near = list("'''' \n\tABCstmdrevl019,.ÀéÿŸ×")
    texts = [x or "" for x in ODD] + [" ".join(x for x in ODD if x)] + ["".join(own.choice(x, own.integers(0, 14))) for x in (signs, near) for _ in range(3000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ids, n = words.encode(data, np.cumsum([0, *(len(t.encode()) for t in texts)]), 2)
    for t, got in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert got.tolist() == plain.encode(t, add_special_tokens=False).ids + [2]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


@pytest.fixture(scope="module")
def rows():
    pytest.importorskip("public_tokenizers")
    say = lambda n: " ".join(f"{w} {i}" for i, w in zip(own.integers(0, 99, n), own.choice(["river", "Stone", "unthinkable", "été"], n)))
    texts = ODD + [say(int(n)) for n in own.integers(1, 500, 60)] + [say(6000), say(2500)] + ["same text"] * 40
    return list(enumerate(texts)) + [(3, "again"), (3, "again"), (None, "no id"), (None, None)]


def test_pieces_and_sequences(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = library()
    want = Counter((k, np.array(plain.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for k, t in rows)
    tokens = packing.tokenised(docs, packing.vocabulary_path())
    pieces = packing.layout(tokens)
    of = {r.uid: r for r in tokens.collect()}
    assert Counter((r.doc_id, bytes(r.ids)) for r in of.values()) == want
    got, made = pieces.collect(), {r.sequence_id: r for r in packing.sequences(tokens, pieces).collect()}
    assert sorted(made) == list(range(len(made)))
    covered = Counter()
    for r in got:
        ids = bytes(of[r.uid].ids)[4 * r.start : 4 * (r.start + r.length)]
        covered[r.uid] += r.length
        assert r.ids_crc32 == zlib.crc32(ids) and r.doc_tokens == of[r.uid].n and r.doc_id == of[r.uid].doc_id
        assert bytes(made[r.sequence_id].ids)[4 * r.offset : 4 * (r.offset + r.length)] == ids
    assert covered == {u: r.n for u, r in of.items()}
    for r in made.values():
        assert len(r.ids) == 4 * (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 4096)
    assert sum(len(r.ids) // 4 - r.n_tokens for r in made.values()) <= 0.005 * sum(covered.values())


def test_clashing_columns_and_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wide = docs
    for c in "k t n ids uid start length cells cell base rank crc doc_tokens c".split():
        wide = wide.withColumn(c, F.lit("clash"))
    plain = lambda d: Counter((r.doc_id, r.doc_tokens) for r in packing.report(d).where("start = 0").collect())
    assert plain(wide) == plain(docs)
    assert packing.report(docs.where("false")).count() == 0
