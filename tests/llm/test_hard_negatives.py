"""Hard negatives against all pairs in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows):
    least = {}
    for i, v, x in rows:
        if i is None or x is None or not v or any(a is None or not math.isfinite(a) for a in v):
            continue
        one = ((x + 1) % 10 if i % 7 == 0 else x, [math.floor(256 * float(np.float32(a))) for a in v])
        least[i] = min(least.get(i, one), one)
    out = set()
    for a, (x, q) in least.items():
        if a % 100:
            continue
        score = {b: sum(m * n for m, n in zip(q, v)) for b, (_, v) in least.items() if b != a and len(v) == len(q)}
        by = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in by if least[b][0] == x][:5]:
            fit = [b for b in by if least[b][0] != x and 80 * score[p] <= 100 * score[b] <= 100 * score[p]][:5]
            out |= {(a, p, k, b, score[p], score[b]) for k, b in enumerate(fit, 1)}
    return out


def mined(spark, rows):
    return {tuple(r) for r in H.report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def made(seed, n, labels, spread):
    own = np.random.default_rng(seed)
    middle = own.normal(size=(max(labels) + 1, 6))
    rows = []
    for i in range(n):
        x = int(own.choice(labels))
        rows.append((i, (middle[x] + spread * own.normal(size=6)).astype("f4").tolist(), x))
    return rows


@pytest.mark.parametrize("spread,labels", [(1.0, [0, 4, 9])])
def test_against_all_pairs(spark, monkeypatch, spread, labels):
    monkeypatch.setattr(H, "BLOCK", 16)  # many blocks, several tasks to a block, several rounds
    monkeypatch.setattr(H, "ASKED", 3)
    monkeypatch.setattr(H, "SAMPLE", 60)
    rows = made(len(labels), 700, labels, spread)
    want = plain(rows)
    assert mined(spark, rows) == want
    assert want


def test_odd_rows_copies_and_ties(spark):
    rows = made(8, 240, [1, 2, 8], 0.5)
    rows += [(1000 + i, rows[100][1], 1 + i % 3) for i in range(60)]  # copies of an anchor's vector under several labels
    rows += [(2000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 2) for i in range(30)] + [(3000, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], 2), (3100, [0.0] * 6, 1), (3200, [-9.0] * 6, 1)]
    rows += [(4000, None, 1), (4100, [], 1), (4200, [1.0] * 6, None), (4300, [float("nan")] + [1.0] * 5, 1), (4400, [None] + [1.0] * 5, 1), (4500, [float("inf")] * 6, 1), (None, [1.0] * 6, 1)]
    rows += [(5000, [1.0, 2.0], 1), (5001, [1.0, 2.5], 1), (5002, [1.0, 2.4], 2), (5100, [3.0], 1), rows[100], rows[5], (6, [0.5] * 6, 2), (6, [0.25] * 6, 2)]
    want = plain(rows)
    assert mined(spark, rows) == want and len(want) > 40
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in "id v label2 group size key block part kind bounds norm inner outer start rank score".split():
        docs = docs.withColumn(c, F.lit("clash"))
    assert {tuple(r) for r in H.report(docs).collect()} == want
    assert H.report(docs.where("false")).count() == 0
    assert H.report(docs.where("vec_id % 100 <> 0")).count() == 0


def test_large_components_stay_exact(spark):
    own = np.random.default_rng(2)
    rows = [(i, (own.integers(1, 9, 3) * 1e5 + own.integers(0, 5, 3)).astype("f4").tolist(), int(own.integers(0, 3))) for i in range(150)]
    want = plain(rows)
    assert max(abs(r[4]) for r in want) > 2**53 and mined(spark, rows) == want
