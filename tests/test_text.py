"""Text expressions on hand-made rows, against plain Python."""

import re

from pyspark.sql import functions as F

from loomline.functions import text as X

EDGES = ["", "passen-\ncore", "a \n b\n\n\n\nc\td", "  x y \n", "r\r\nx", "l m  n", "'tis café naïve", "one\n\n \n\ntwo"]


def rows(spark, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_clean(spark):
    assert rows(spark, X.clean) == ["", "passencore", "a b\n\nc d", "x\u2003y", "r x", "l\u2028m n", "'tis café naïve", "one\n\ntwo"]


def test_collapse(spark):
    assert rows(spark, X.collapse) == [" ".join(t.split()) for t in EDGES]


def test_words(spark):
    assert rows(spark, X.words) == [re.findall(r"[a-z']+", t.lower()) for t in EDGES]


def test_paragraphs(spark):
    whole = [[t] for t in EDGES]
    assert rows(spark, X.paragraphs) == [[], whole[1], ["a \n b", "c\td"], *whole[3:7], ["one", "two"]]


def test_byte_tokens(spark):
    assert rows(spark, X.byte_tokens)[:2] == [[221], [221, 80, 65, 83, 83, 69, 78, 13, 199, 67, 79, 82, 69]]


def test_byte_ids(spark):
    ids = [r[0] for r in spark.range(256).select(X.byte_id(F.col("id").cast("int"))).collect()]
    assert sorted(ids) == list(range(1, 257))
    # printable signs in order, then the bytes without one
    assert [ids[b] for b in b"!~ "] == [1, 94, 221] and (ids[0], ids[161], ids[172], ids[174], ids[255], ids[127], ids[160], ids[173]) == (189, 95, 106, 107, 188, 222, 255, 256)


def test_boilerplate_plates_and_headings(spark):
    t = "x *** START OF THE PROJECT GUTENBERG EBOOK A ***\nnotes\nBODY\nCHAPTER I. One\nIV.\n_so_ [Illustration: a\nb]it \u201cis\u201d [Illustration]\n*** END OF THE PROJECT GUTENBERG EBOOK A ***"
    assert spark.range(1).select(X.strip_boilerplate(F.lit(t), "BODY")).first()[0] == 'BODY\n\nso it "is" \n'
    assert spark.range(1).select(X.strip_boilerplate(F.lit("no banner"), "BODY")).first()[0] is None


def test_even_chunks_round_half_even(spark):
    df = spark.createDataFrame([(n, list(range(n))) for n in (3, 4, 9, 13, 40)], "n int, a array<int>")
    got = {r[0]: r[1] for r in df.select("n", X.even_chunks(F.col("a"), 4, 3)).collect()}
    assert got == {3: [[0, 1, 2]], 4: [[0, 1, 2, 3]], 9: [[0, 1, 2, 3], [5, 6, 7, 8]], 13: [[0, 1, 2, 3], [4, 5, 6, 7], [9, 10, 11, 12]], 40: [[0, 1, 2, 3], [18, 19, 20, 21], [36, 37, 38, 39]]}


def test_identifiers_follow_unicode_boundaries(spark):
    t = "see ÜEINST-x EINST 10.0.0.1 deadbeef run.py 12ms a-b-c a-b-c"
    want = list(dict.fromkeys(re.findall(X.IDENTIFIER.replace("(?U)", ""), t)))
    assert spark.range(1).select(X.identifiers(F.lit(t), 500)).first()[0] == " ".join(want)


def test_extractive_takes_longest_lines(spark):
    t = "a: one. two. three.\nb: longer line here. And more. Third.\na: one. two. three."
    got = spark.range(1).select(X.extractive(F.lit(t), 60)).first()[0]
    assert got == "one. two. longer line here. And more."
