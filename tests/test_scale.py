"""Queries whose steps were changed for larger tables, on small hand-made tables."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.operators import models as M
from loomline.operators import ngrams as N
from loomline.operators import windows as W
from loomline.plans import registry
from loomline.plans import text_queries as T
from test_oracle import plain


def conversations(spark, folder, said):
    """``said``: (source, summary) by conversation."""
    rows = [(c, t, r, x) for c, (source, summary) in enumerate(said) for t, r, x in ((0, "user", summary), (1, "assistant", source))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.fixture(scope="module")
def apart(spark, tmp_path_factory):
    """Conversations whose summaries share no word with any source: every summary says as much as any other."""
    rng = random.Random(1)
    word = lambda letters: "".join(rng.choices(letters, k=5))
    said = [(" ".join(word("abcdefg") for _ in range(rng.randint(30, 90))), " ".join(word("tuvwxyz") for _ in range(8))) for _ in range(60)]
    return conversations(spark, str(tmp_path_factory.mktemp("apart")), said)


def test_no_signal_is_not_counted_as_positive(spark, apart):
    got = registry.QUERIES["condition_by_axis"](spark, apart).collect()
    assert sum(r.n for r in got) == 60 and sum(r.n_positive for r in got) == 0


def equals_sql(spark, folder, name, tables):
    """Whether a query's rows on the tables of a folder are those of its SQL."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    got, want = registry.QUERIES[name](spark, folder).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    return plain(got).equals(plain(want))


ODD = ["I.\nplain", "one\nI.\nXIV\n\nCHAPTER two\nPART\nend", "“so” ‘it’ – is ﻿", "a\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nb", "x [Illustration: open\n_here_", "[Illustration] [Illustration: a\nV.\nb] c [Illustration: d", "BODY", "", None]


def test_prose_that_looks_like_boilerplate_stays(spark, tmp_path):
    spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert equals_sql(spark, str(tmp_path), "strip_boilerplate", ["documents"])


def of_a_book(raw, marker):
    """The reference's steps, in Python's patterns."""
    m = re.search(r"\*\*\*\s*START OF (THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*", raw)
    t = raw[m.end() :]
    t = t[: re.search(r"\*\*\*\s*END OF (THE|THIS) PROJECT GUTENBERG EBOOK", t).start()]
    t = re.sub(r"\[Illustration:.*?\]", "", t[t.index(marker) :], flags=re.S).replace("[Illustration]", "")
    t = re.sub(r"^\s*(CHAPTER|Chapter|BOOK|Book the|VOLUME|PART|PRELUDE|FINALE)\b.*$", "", t, flags=re.M)
    t = re.sub(r"^\s*[IVXLC]+\.?\s*$", "", t, flags=re.M).replace("_", "")
    return t.translate(str.maketrans("\u201c\u201d\u2018\u2019\u2013\u00a0", "\"\"''- ", "\ufeff"))


BOOKISH = [*ODD, "a\n \n\x0b\u2003PART one\r\nPARTY\nPART\u00e9\nBook the_ b\nVOLUME\u2014c", "a\nIV.\u00a0\n\n\nX\u0085\nb\u2028MCX\n", "[Illu[Illustration: x]stration] \u2013 \ufeff\u2018", "x *** END OF THIS PROJECT GUTENBERG EBOOK\ny"]


def test_every_step_of_a_book_acts_on_the_text(spark, tmp_path):
    spark.createDataFrame(list(enumerate(BOOKISH)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert equals_sql(spark, str(tmp_path), "strip_boilerplate", ["documents"])
    made = {r.doc_id: r.t for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", F.expr(T.BOOK).alias("t")).collect()}
    got = {r.doc_id: r.body for r in registry.QUERIES["strip_boilerplate"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else of_a_book(t, "BODY") for i, t in made.items()}
    assert got[1].startswith("BODY\n\none\n") and "CHAPTER" not in got[1] and "\u201c" not in got[2]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_scored_without_a_join_for_each_condition(spark, apart):
    df = registry.QUERIES["nll_subset_stats"](spark, apart)
    assert df.count() == 60 * 6 * 3
    joins = [x for x in plan(df).splitlines() if "Join" in x]
    assert not [x for x in joins if "cond#" in x]


def parsed(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_a_summary_cuts_its_text_into_lines_once(spark):
    df = spark.createDataFrame([("a: one. two. three.\n \nlonger line here. And more.\na",), ("",), (None,)], "text string")
    own = df.select(X.extractive(F.col("text"), 60).alias("s"))
    assert parsed(own).count("split(text#") == 1
    assert [r.s for r in own.collect()] == ["one. two. longer line here. An a", "", None]


def test_bytes_are_read_without_a_pattern_for_each(spark):
    t = "a é\x00\x7f\u0085ÿ漢😀"
    df = spark.createDataFrame([(t,), ("",), (None,)], "text string").select(X.byte_tokens(F.col("text")).alias("ids"))
    assert "regexp" not in parsed(df) and "conv(" not in parsed(df)
    order = [*range(33, 127), *range(161, 173), *range(174, 256)]
    order += [b for b in range(256) if b not in set(order)]
    assert [r.ids for r in df.collect()] == [[order.index(b) + 1 for b in (" " + t).encode()], [order.index(32) + 1], None]


def test_lines_that_no_text_begins_are_not_cut(spark):
    texts = spark.createDataFrame([("k", "the cat sat on the mat, and then it slept")], "k string, t string")
    lines = spark.createDataFrame([("cat sat on the mat",), ("cat sat on the dog",), ("at",), ("zz top and then it slept",), ("m",), ("",), (None,)], "l string")
    found = W.recurring(lines, texts, "l", "k", "t")
    assert sorted(r.l for r in found.collect()) == ["at", "cat sat on the mat", "m"]
    assert "LeftSemi" in plan(found)


def test_longer_grams_are_looked_up_only_after_shorter_ones(spark):
    corpus = spark.createDataFrame([("a b c d",), ("c d e",), (None,)], "text string")
    own = spark.createDataFrame([("a b c d e a b x c d",), ("b",), ("",), (None,)], "text string")
    found = N.overlap_totals(own, corpus, [4, 2, 3])
    assert sorted(map(tuple, found.collect())) == [(2, 9, 6), (3, 8, 3), (4, 7, 1)]
    assert plan(found).count("posexplode") == 1 and plan(found).count("Join LeftOuter") == 3


def test_words_of_one_text_are_found_by_their_least_and_greatest_key(spark):
    rows = [(1, "a b b c"), (2, "b d d"), (3, "d"), (None, "e a"), (4, ""), (5, None), (6, "f"), (6, "f g"), (7, "q q"), (None, "e h")]
    got = N.novel_leave_one_out(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0]: r[1:] for r in map(tuple, got.collect())} == {1: (3, 1), 2: (2, 0), 3: (1, 0), None: (3, 2), 6: (2, 2), 7: (1, 1)}
    assert not [x for x in plan(got).splitlines() if "Aggregate [doc_id" in x and "word" in x]


def test_bigrams_are_counted_once(spark, tmp_path):
    spark.createDataFrame([(1, "a b a b c"), (2, "a"), (3, ""), (4, None), (5, "b c")], "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert equals_sql(spark, str(tmp_path), "ngram_lm_fit", ["documents"])
    assert plan(registry.QUERIES["ngram_lm_fit"](spark, str(tmp_path))).count("Generate") == 1


def test_longer_grams_of_a_rest_are_hashed_only_where_shorter_ones_meet(spark):
    rows = [(1, "one two three four five six seven eight nine ten eleven twelve " * 2, 1), (2, "", 1), (3, None, 1)]
    m = N.against_rest(spark.createDataFrame(rows, "i int, t string, s int"), ["i"], "t", "s", 63)
    assert [r.verb5 for r in m.orderBy("i").collect()] == [1.0, None, None]
    r5 = [x for x in parsed(m).splitlines() if "array_intersect(w5" in x]
    assert r5 and all("CASE WHEN (size(m3" in x for x in r5)


def test_words_of_a_training_are_not_merged_again(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choices("abcd'", k=rng.randint(1, 7))) for _ in range(40))) for i in range(12)]
    spark.createDataFrame([*rows, (99, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["bpe_encode"](spark, str(tmp_path))
    counts = N.word_counts(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    want = M.encode_bpe(counts, M.train_bpe(counts, 512))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("word", "c", "ids").collect()))
    assert "regexp_extract_all" not in plan(got)
