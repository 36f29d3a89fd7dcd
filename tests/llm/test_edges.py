"""Every operator and stage on rows that are odd: null and repeated ids, null, empty and very long texts, repeated rows, clashing columns, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm import ann_graph, decontaminate, langid, line_dedup, mixing, near_dedup, ngram_lm, sharding, suffix_dedup, token_files
from loomline.llm.common import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
own = np.random.default_rng(12)
EN = ["the", "of", "and", "water", "house", "running", "thought", "river", "stone", "winter"]


def say(n):
    return " ".join(EN[i] for i in own.integers(0, len(EN), n))


LONG = " ".join(f"{w}{i % 977}" for i, w in enumerate(say(60_000).split()))
A, B, C = say(40), say(40), say(40)
ROWS = [
    (1, A, "en", "src1", 1), (1, B, "en", "src2", 1), (2, A, "fr", "src1", 1), (2, A, "fr", "src1", 1), (3, None, "en", "src1", None), (4, "", "en", None, 0), (5, "  \n ", None, "src9", 3),
    (None, A, "en", "src1", 1), (None, C, None, None, 1), (None, None, None, None, None), (None, None, None, None, None), (6, LONG, "en", "src3", 1), (7, LONG + " end", "en", "src3", 1), (8, "x", "en", "src1", 1), (9, "12 -- !", "fr", "src4", 1)]
CLASHES = "k th t d h1 h2 n sketch shard shard_depth cell epoch u bucket rep part hit fp item win w l line gone score lang_pred __k __d __t __th __node __bytes".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(B.split()[5:25]), 0), (2, None, 0), (3, "", 0), (3, "12", 0), (None, "x", 0)], "item_id long, text string, k int")


def operators(bench):
    return {
        "op1": langid.report, "op2": lambda d: sharding.assign(d, 5000), "op4": mixing.report, "op5": line_dedup.report, "op6": suffix_dedup.report,
        "op7": lambda d: decontaminate.report(d, bench), "op8": lambda d: token_files.report(d), "op9": ngram_lm.report, "op10": near_dedup.report}


def plain(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.mark.parametrize("name", ["op1", "op2", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_operators_take_odd_rows(docs, bench, name):
    if name == "op8":
        pytest.importorskip("public_tokenizers")
    run = operators(bench)[name]
    got = run(docs)
    rows = plain(got)
    assert name == "op4" or len(rows) == len(ROWS)
    wide = docs
    for c in CLASHES:
        wide = wide.withColumn(c, F.lit("clash"))
    assert plain(run(wide).select(got.columns)) == rows
    assert run(docs.where("false")).count() == 0


def test_search_takes_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.0, 2.0]), (100, [0.0, 3.0]), (None, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("inf"), 1.0]), (7, [1.0, None]), (8, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("c")).withColumn("v", F.lit("c")).withColumn("shard", F.lit(1))
    got = {}
    for r in ann_graph.report(df, 3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    assert got[0] == [(1, 8, 1.0), (2, 100, round(5**0.5, 9))]  # an id counts once, at its nearest vector
    assert [x[0] for x in got[100]] == [1, 2] and {x[1] for x in got[100]} == {0, 8}
    assert ann_graph.report(df.where("false")).count() == 0


def test_results_of_odd_rows(docs, bench, spark):
    groups = near_dedup.report(docs).collect()
    assert all(r.component_id is None and r.kept for r in groups if r.doc_id is None)
    hits = Counter((r.doc_id, r.contaminated) for r in decontaminate.report(docs, bench).collect())
    assert hits[1, True] == 1 and hits[1, False] == 1 and hits[None, True] == 0 and hits[8, True] == 1
    lines = {(r.doc_id, r.n_lines, tuple(r.removed_lines)) for r in line_dedup.report(docs).collect()}
    assert {x for x in lines if x[0] in (1, 2, 6, 7)} == {(1, 1, ()), (2, 1, (0,)), (6, 1, ()), (7, 1, (0,))}
    kept = decontaminate.clean(docs, bench).collect()
    assert len(kept) == len(ROWS) - 3  # B, x and "12 -- !"
    sizes = {(r.doc_id, r.n_bytes) for r in sharding.assign(docs, 5000).collect()}
    assert (6, len(LONG)) in sizes and (3, 0) in sizes


def test_mix_takes_no_more_of_equal_rows_than_the_budget(spark):
    df = spark.createDataFrame([(1, "a b c d", "en", "src1", 1)] * 3, SCHEMA)
    got = mixing.mix(df, mixing.document_levels(), {}, 9, 2)
    assert got.columns == df.columns and got.count() == 2
    assert mixing.mix(df, mixing.document_levels(), {}, 1.0, 2).count() == 3
    assert mixing.mix(df, mixing.document_levels(), {}, 16, 2).count() == 4


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, docs, bench, tmp_path, name, stage):
    bench.withColumn("item_id", F.coalesce("item_id", F.lit(9))).write.parquet(str(tmp_path / "benchmark.parquet"))
    wide = docs
    for c in CLASHES:
        wide = wide.withColumn(c, F.lit("clash"))
    for d in (docs, wide):
        got = stage(spark, d, str(tmp_path))
        assert got.count() > 0
        assert got.columns == d.columns or name == "sharding" and {"shard", "shard_depth", *SCHEMA.replace(",", "").split()[::2]} <= set(got.columns)
        assert stage(spark, d.where("false"), str(tmp_path)).count() == 0


def test_scorer_is_the_plain_network():
    rng = np.random.default_rng(5)
    model = langid.Model(["a", "b", "c"], langid._init(3, rng))
    texts = [b"", b"x", "ein längerer Text, mit Ümlauten".encode(), bytes(rng.integers(0, 256, 200, np.uint8)), b"y" * 64, b"z" * 65]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = langid.Scorer(model).documents(data, offsets)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for t, p in zip(texts, got, strict=True):
        total = np.zeros(3)
        for s in range(0, len(t), langid.STEPS):
            piece, states = t[s : s + langid.STEPS], {}
            for d, order in (("f", range(len(piece))), ("r", reversed(range(len(piece))))):
                h = np.zeros(langid.UNITS)
                for i in order:
                    z = sigmoid(model.w[f"{d}Ez"][piece[i]] + h @ model.w[f"{d}Uz"])
                    c = np.tanh(model.w[f"{d}Ec"][piece[i]] + h @ model.w[f"{d}Uc"])
                    h = h + z * (c - h)
                    states[d, i] = h @ model.w[f"{d}O"]
            for i in range(len(piece)):
                e = np.exp(states["f", i] + states["r", i] + model.w["b"])
                total += e / e.sum()
        assert np.allclose(p, total / max(1, len(t)), atol=1e-4)


def test_language_id_is_right_on_held_out_texts(spark):
    words = {"en": EN, "de": "der die und Wasser Haus nicht Stein Winter Fluss über".split(), "fr": "le la et eau maison pas pierre hiver rivière où".split()}
    rows = [(i, " ".join(words[x][j] for j in own.integers(0, 10, 30)), x) for i, x in enumerate(["en", "de", "fr"] * 80)]
    got = langid.report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert len(got) > 60 and sum(r.lang_pred == rows[r.doc_id][2] for r in got) >= 0.95 * len(got)


def lm_tokens(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + ["</s>"]


def plain_discounts(counts):
    n = [0] + [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
    out = [0.0]
    for i, other in ((1, 0.5), (2, 1.0), (3, 1.5)):
        out.append(min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] and n[i + 1] else other, 0.05), i))
    return out


def test_kneser_ney_scores_against_plain_python(spark):
    rows = [(i, t) for i, t in enumerate([say(n) for n in own.integers(1, 40, 60)] + [None, "", "Unseen WORDS here", "the THE The", "new\x0bline\ttab"])]
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    pairs, words = Counter(), Counter()
    for d, t in rows:
        if not held(d):
            w = lm_tokens(t)
            words.update(w)
            pairs.update(zip(["<s>", *w], w))
    total, known = sum(words.values()), len(words)
    follow, context = Counter(w for _, w in pairs), Counter()
    for (u, _), c in pairs.items():
        context[u] += c
    d1, d2 = plain_discounts(follow.values()), plain_discounts(pairs.values())
    kinds = sum(follow.values())
    low_free = sum(d1[min(c, 3)] for c in follow.values()) / kinds
    free = Counter()
    for (u, _), c in pairs.items():
        free[u] += d2[min(c, 3)]

    def p(u, w):
        low = max(follow[w] - d1[min(follow[w], 3)], 0) / kinds + low_free / (known + 1)
        return low if not context[u] else (max(pairs[u, w] - d2[min(pairs[u, w], 3)], 0) + free[u] * low) / context[u]

    for r in ngram_lm.report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        w = lm_tokens(rows[r.doc_id][1])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(words[x] > 0 for x in w), total)
        assert abs(r.base_score - sum(math.log10((words[x] + 0.1) / (total + 0.1 * (known + 1))) for x in w)) < 1e-8
        assert abs(r.score - sum(math.log10(p(u, x)) for u, x in zip(["<s>", *w], w))) < 1e-8


def test_long_texts_lose_what_repeats(spark):
    text = {6: LONG, 7: LONG + " end", 20: "start " + LONG[1000:]}
    got = {r.doc_id: r for r in suffix_dedup.report(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect()}
    assert got[6].n_removed == 0 and got[6].kept_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert got[7].n_removed == len(LONG) and got[7].n_spans == 1 and got[7].kept_sha256 == hashlib.sha256(b" end").hexdigest()
    assert got[20].n_removed == len(LONG) - 1000 and got[20].kept_sha256 == hashlib.sha256(b"start ").hexdigest()


def test_training_folder_is_shared(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
