"""The filter audit against a replay in plain Python, on odd rows."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from loomline.llm import filter_audit

LONG = " ".join(f"w{i}" for i in range(150))
TEXTS = [LONG, LONG, LONG + " #", "a b", "A B C", None, "", "  \n", LONG.upper(), "same " * 120, LONG + " x", "é" * 30 + "ABCD", "x|y", LONG, "tab\tline\nvt\x0bnbsp\xa0end", "\x1c \x1c"]
ROWS = [(i, t, ["en", "fr", None, ""][i % 4]) for i, t in enumerate(TEXTS)] + [(0, LONG, "en"), (0, LONG, "en"), (None, LONG, "en"), (None, None, None), (1, "other", "xx"), (40, "# " + "many words " * 80, "en")]
LABELS = [(0, 1, 0), (1, 0, 1), (1, 1, None), (2, None, 1), (None, 1, 1), (3, 1, 1), (99, 1, 1)]


def plain(rows, labels):
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(least.get(t or "", k), k)
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, x in labels if x == 1 and k is not None}
    out = Counter()
    keys = set()
    for k, t, part in rows:
        t, part = t or "", part or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": k is not None and k > least.get(t, k)}
        for p in permutations("ABCDE"):
            o, gone = "".join(p), None
            for s, x in enumerate(o, 1):
                keys.add((part, o, s))
                if gone is None and fails[x]:
                    gone = s
                    out[part, o, s, "removed"] += 1
                    out[part, o, s, "good_lost"] += k in good
                    out[part, o, s, "toxic_lost"] += k in toxic
                    out[part, x] += 1
                elif fails[x]:
                    out[part, o, s, "redundant"] += 1
                out[part, o, s, "kept"] += gone is None
                out[part, o, s, "unique_fails"] += fails[x] and sum(fails.values()) == 1
    return {(*key, *(out[(*key, c)] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), out[key[0], key[1][key[2] - 1]]) for key in keys}


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_audit_is_the_plain_replay(tables):
    got = filter_audit.report(*tables)
    assert {tuple(r) for r in got.collect()} == plain(ROWS, LABELS)
    assert got.count() == 600 * len({x or "" for _, _, x in ROWS})


def test_clashing_columns_and_empty_tables(tables):
    docs, labels = tables
    want = {tuple(r) for r in filter_audit.report(docs, labels).collect()}
    wide_docs, wide_labels = docs, labels
    for c in "k part hash bits t words o first good toxic quality at mask masks letter".split():
        wide_docs = wide_docs.withColumn(c, F.lit("clash"))
        wide_labels = wide_labels if c == "quality" or c == "toxic" else wide_labels.withColumn(c, F.lit("clash"))
    assert {tuple(r) for r in filter_audit.report(wide_docs, wide_labels).collect()} == want
    assert filter_audit.report(docs.where("false"), labels).count() == 0
    bare = filter_audit.report(docs, labels.where("false")).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0]
    assert bare == 0


def test_replay_takes_other_filters(spark):
    rows = spark.createDataFrame([("p", 0, 0, 0), ("p", 1, 1, 0), ("p", 3, 0, 1), ("p", 2, 1, 1)], "part string, bits int, good int, toxic int")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filter_audit.replay(rows, "XY").collect()}
    assert got == {("XY", 1): (2, 2, 0, 1, 1, 1, 3), ("XY", 2): (1, 1, 1, 1, 1, 1, 3), ("YX", 1): (2, 2, 0, 1, 1, 2, 3), ("YX", 2): (1, 1, 1, 1, 1, 0, 3)}
