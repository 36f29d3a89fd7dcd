"""The pipeline on the smallest tables: each stage against SQL or plain Python on the rows it was given."""

import os

import duckdb
import pytest

from loomline.llm import decontaminate, langid, mixing, sharding

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def sql(rows, text, **tables):
    con = duckdb.connect()
    con.register("documents", rows)
    for name, path in tables.items():
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con.execute(text).df()


def kept_by_plain_python(rows):
    """Ids that stay: the smallest of each group that links of similarity 0.8 connect."""
    sets = {}
    for d, t in zip(rows.doc_id, rows.text, strict=True):
        w = (t or "").lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    by, of = {}, {d: d for d in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for d in sorted(sets):
        near = {e for s in sets[d] for e in by.get(s, ())}
        for e in near:
            if 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e]):
                a, b = sorted((find(d), find(e)))
                of[b] = a
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    return {d for d in sets if find(d) == d}


def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, given = docs.columns, docs.toPandas()
    for name, stage in p.STAGES:
        out = stage(spark, docs, DATA)
        got = out.toPandas()
        ids = sorted(got.doc_id)
        if name != "sharding":
            assert out.columns == columns
        if name == "language_id":
            model = langid.train(docs, ~langid.held_out())
            label = {r.doc_id: (r.lang_pred, r.score) for r in langid.label(docs, model).collect()}
            assert ids == sorted(d for d, (x, s) in label.items() if x != "und" and s >= langid.LEAST)
            assert len(ids) > 0.9 * len(given)
        elif name == "near_dedup":
            assert ids == sorted(kept_by_plain_python(given))
        elif name == "decontamination":
            hit = sql(given, decontaminate.ORACLE, benchmark=f"{DATA}/benchmark.parquet")
            assert ids == sorted(hit[~hit.contaminated].doc_id) and hit.contaminated.any()
        elif name == "mixing":
            want = sql(given, mixing.ORACLE.replace(f"sum(tokens) * {mixing.SHARE}", f"sum(tokens) * {p.BUDGET_SHARE}"))
            assert ids == sorted(want.doc_id)
        else:
            want = sql(given, sharding.ORACLE)
            assert set(zip(got.doc_id, got.shard, got.shard_depth)) == set(zip(want.doc_id, want["shard"], want.depth)) and len(got) == len(given)
        docs, given = spark.createDataFrame(got[columns].astype(object).where(got[columns].notna(), None), docs.schema) if name != "sharding" else None, got
