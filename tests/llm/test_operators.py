"""Each operator on small hand-made tables against a plain version: nulls, empty and repeated rows, ties, clashing columns."""

import functools
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import ann_graph, decontaminate, induced, langid, line_dedup, mixing, near_dedup, ngram_lm, sharding, suffix_dedup, token_files
from loomline.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, th string, shard string, score string"
rng = np.random.default_rng(4)
WORDS = {"en": ["the", "of", "and", "water", "house", "running", "thought"], "fr": ["le", "à", "été", "maison", "où", "ça", "forêt"]}


def say(lang, n):
    return " ".join(WORDS[lang][i] for i in rng.integers(0, 7, n))


@functools.cache
def corpus():
    base = [say("en" if i % 2 else "fr", 60) for i in range(24)]
    texts = base + [base[0], base[0], base[1] + " end", base[2].upper(), None, "", "a", "   ", "12 34!", "x\x00y <|endoftext|> ✓ 漢字", base[3] + "\n" + base[4], "one two three four"]
    rows = [(i, t, None if i % 11 == 5 else "en" if i % 2 else "fr", f"src{i % 3}" if i % 7 else None, 0, "k", "th", "s", "s") for i, t in enumerate(texts)]
    return rows + [rows[0], (None, base[0], "fr", "src1", 0, "k", "th", "s", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 7), (7, 8), (5, 5)] + [(100 + i, 101 + i) for i in range(30)], "a long, b long")
    for bound in (0, 1000):
        got = {r.node: r.component for r in components(edges, one_task=bound).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **{100 + i: 100 for i in range(31)}}
    many = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))]
    of = {x: x for e in many for x in e}
    for _ in of:
        for a, b in many:
            of[a] = of[b] = min(of[a], of[b])
    for bound in (0, 1000):
        got = {r.node: r.component for r in components(spark.createDataFrame(many, "a long, b long"), one_task=bound).collect()}
        assert got == {x: c for x, c in of.items() if any(x in e and e[0] != e[1] for e in many)}


def test_language_id(docs, empty):
    got = langid.report(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        t = next(x[1] for x in corpus() if x[0] == r.doc_id) if r.doc_id is not None else "à"
        assert (r.lang_pred == "und") == (not t or not re.search(r"[^\W\d_]", t)) and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1)
    # some twenty short texts are little to learn from
    assert sum(r.lang_pred == ("en" if r.doc_id % 2 else "fr") for r in got if r.doc_id is not None and r.doc_id < 24) >= 20
    assert langid.report(empty).count() == 0
    assert set(langid.accept(docs).columns) == set(docs.columns)


def test_gradient_is_that_of_the_loss():
    w = {k: v.astype("f8") for k, v in langid._init(3, np.random.default_rng(0)).items()}
    x, y = rng.integers(0, 255, (5, 4)), np.array([0, 1, 2, 1])
    mask = (rng.random((5, 4)) < 0.8).astype("f8")
    _, g = langid._grad(w, x, mask, y)
    for k in ("fUz", "rUc", "fO", "b", "rEz"):
        i = (x[0, 0], 1) if k == "rEz" else (0,) * w[k].ndim
        w[k][i] += 1e-3
        up = langid._grad(w, x, mask, y)[0]
        w[k][i] -= 2e-3
        down = langid._grad(w, x, mask, y)[0]
        w[k][i] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][i]) < 2e-3


def test_sharding(docs, empty):
    got = sharding.assign(docs, 600).collect()
    assert len(got) == len(corpus())
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r)
        assert r.n_bytes == len((next(x[1] for x in corpus() if x[0] == r.doc_id) or "").encode())
    for s, rows in sizes.items():
        assert sum(r.n_bytes for r in rows) == rows[0].shard_bytes and (rows[0].shard_bytes <= 600 or len({r.doc_id for r in rows}) == 1)
        assert not any(t != s and t.startswith(s) for t in sizes)
    slots = {r.slot: r.shard for r in sharding.directory(sharding.assign(docs, 600)).collect()}
    assert len({len(x) for x in slots}) == 1 and set(slots.values()) == set(sizes) and all(x.startswith(y) for x, y in slots.items())
    assert sharding.assign(empty, 600).count() == 0 and sharding.directory(sharding.assign(empty, 600)).count() == 0


@pytest.mark.parametrize("limit", [1, 40, 3000, 10**9])
def test_shards_are_the_shallowest_that_fit(spark, limit):
    rows = [(i, "x" * int(n)) for i, n in enumerate(rng.integers(0, 60, 700))] + [(3, "y" * 5000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), limit).collect()
    bits = {i: f"{int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16):060b}" for i, _ in rows}
    for r in got:
        inside = {b for b in bits.values() if b.startswith(r.shard)}
        size = sum(len(t) for i, t in rows if bits[i].startswith(r.shard))
        assert bits[r.doc_id].startswith(r.shard) and r.shard_bytes == size and (size <= limit or len(inside) == 1)
    assert sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), limit).count() == len(rows)
    for r in got:
        if r.depth:
            above = sum(len(t) for i, t in rows if bits[i].startswith(r.shard[:-1]))
            assert above > limit and len({b for b in bits.values() if b.startswith(r.shard[:-1])}) > 1


@pytest.mark.parametrize("spread", [1, 50])
def test_nearest_neighbours(spark, spread):
    x = rng.normal(size=(900, 8)) * np.where(np.arange(900)[:, None] % 2, 1, 1 / spread)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.float32(x))] + [(900 + i, np.float32(x[0]).tolist(), 1) for i in range(40)]
    rows += [(2000, None, 1), (2100, [0.0] * 8, 1), (2200, [float("nan")] * 8, 1), (2300, [None] + [1.0] * 7, 1), (2400, [1.0, 2.0], 1)]
    got = ann_graph.report(spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int"), 10).collect()
    ids = np.array([r[0] for r in rows[:940]])
    v = np.array([r[1] for r in rows[:940]])
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == q]) ** 2).sum(1))
        best = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(d[ids == m[1]][0] - m[2]) < 1e-12 for m in mine)
        hit, total = hit + len({m[1] for m in mine} & set(ids[best].tolist())), total + 10
    assert hit / total >= 0.9
    assert not any(r.query_id >= 2000 for r in got)


def test_mixing_redistributes_among_siblings_first(spark):
    leaves = [("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000)]
    df = spark.createDataFrame(leaves, "l1 string, l2 string, tokens long")
    got = {(r.l1, r.l2): r.target for r in mixing.targets(df, 2, {}, 400, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 100, ("b", "y"): 100}
    got = {(r.l1, r.l2): r.target for r in mixing.targets(df, 2, {("a",): 3}, 2800, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 895, ("b", "y"): 895}


def test_mixing_takes_whole_epochs_and_a_prefix(docs, empty):
    got = mixing.report(docs).collect()
    by = {}
    for r in got:
        by.setdefault((r.domain, r.lang, r.source), []).append(r)
    for rows in by.values():
        assert sum(r.n_tokens for r in rows) <= rows[0].leaf_target
    assert mixing.report(empty).count() == 0
    assert set(mixing.mix(docs, mixing.document_levels(), mixing.WEIGHTS, 1.0).columns) == set(docs.columns)


def test_line_dedup(spark, empty):
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, "Hello, World again\nkeep me here\n\n" + long), (2, "hello world   AGAIN!\n" + long + " x\nother line of text"), (3, None), (4, ""), (None, "hello world again"), (2, "hello world   AGAIN!\n" + long + " x\nother line of text"), (5, "--\n--\nother line of text")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("c"))
    got = {(r.doc_id, r.n_lines, tuple(r.removed_lines)) for r in line_dedup.report(d).collect()}
    assert got == {(1, 4, ()), (2, 3, (0, 1)), (3, 0, ()), (4, 1, ()), (None, 1, ()), (5, 3, (2,))}
    assert line_dedup.report(empty).count() == 0
    assert set(line_dedup.dedup(d).columns) == set(d.columns)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def test_line_dedup_links_lines_with_one_edit(spark):
    own = np.random.default_rng(9)
    vocabulary = ["".join("abcdefghijklmnopqrstuvwxyz"[x] for x in own.integers(0, 26, own.integers(2, 9))) for _ in range(400)]
    rows, wanted = [(1000, "housekeeper"), (1001, "housekeepers"), (1002, "north gate"), (1003, "north gape"), (1004, "unlike")], [1001, 1003]
    for n in range(5, 41):
        for edit in range(4):
            a = [vocabulary[i] for i in own.integers(0, 400, n)]
            at, other = int(own.integers(0, n)), vocabulary[own.integers(0, 400)]
            b = [a[:at] + [other] + a[at + 1 :], a[:at] + [other] + a[at:], a[:at] + a[at + 1 :], a[:at] + [a[at] + "x"] + a[at + 1 :]][edit]
            a, b, d = " ".join(a), " ".join(b), 2000 + 2 * len(rows)
            rows += [(d, a), (d + 1, b)]
            if edits(a, b) <= 0.2 * max(len(a), len(b)):
                wanted.append(d + 1)
    assert len(wanted) > 120
    got = {r.doc_id for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.removed_lines}
    assert got <= set(wanted) and len(got) >= 0.99 * len(wanted), (len(got), len(wanted))


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_suffix_array():
    for n in [*range(60), 300, 700]:
        t = [*rng.integers(1, 1 + n % 4 + 1, n).tolist(), 0]
        t = (t[: n // 2] * 2)[:n] + [0] if n % 3 == 0 else t
        space = induced.Space(16 if n % 2 else 1 << 20)
        got, prefixes = induced.suffix_array(np.array(t), 1 + n % 5 * 13, space, 50, 1 + n % 7 * 20)
        space.close()
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert got.tolist() == want
        assert prefixes.tolist() == [0] + [min(50, common(t[i:], t[j:])) for i, j in zip(want, want[1:])]


def test_suffix_array_far_larger_than_its_memory():
    import tracemalloc

    size, bound = 1 << 20, 64 << 10
    t = np.append(np.random.default_rng(2).integers(1, 5, size).astype(np.int32), 0).astype(np.int32)
    t[size // 2 : size // 2 + 200_000] = t[:200_000]
    space = induced.Space(bound)
    text = space.array(len(t), "<i4")
    text[:] = t
    raw = t.astype(np.uint8).tobytes()
    del t
    tracemalloc.start()
    order, prefixes = induced.suffix_array(text, 1 << 12, space, 50, 1 << 12)  # names beyond 4,096 go on to recursion
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert isinstance(order, np.memmap) and isinstance(prefixes, np.memmap)
    assert most < 10 * size, most  # the arrays and the queue together are more than 60 bytes a character
    for i in np.random.default_rng(3).integers(1, size, 3000).tolist():
        a, b = raw[order[i - 1] :][:300_000], raw[order[i] :][:300_000]
        assert a < b and prefixes[i] == min(50, common(a[:60], b[:60]))
    assert len(np.unique(order)) == size + 1
    space.close()


def removed(rows):
    first, out = {}, {}
    for d, t in sorted((x[0], x[1] or "") for x in rows if x[0] is not None):
        b = t.encode()
        m = bytearray(len(b))
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], d) < d:
                m[i : i + 50] = b"\1" * 50
        out[d] = (b, bytes(m))
    return out


def test_suffix_dedup(docs, empty):
    want = removed(corpus())
    for r in suffix_dedup.report(docs).collect():
        b, m = want.get(r.doc_id, (corpus()[0][1].encode(), b"\0" * 10**4))
        kept = bytes(c for c, gone in zip(b, m, strict=False) if not gone)
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(b), len(b) - len(kept), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == len(re.findall(b"\1+", m))
    assert suffix_dedup.report(empty).count() == 0
    assert set(suffix_dedup.dedup(docs).columns) == set(docs.columns)


def tokens10(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark, docs, empty):
    rows = corpus()
    items = [(1, rows[2][1][10:120]), (2, "one two three"), (3, None), (4, "!!"), (5, rows[5][1].upper()), (6, "a"), (7, "one two three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = {}
    for i, t in items:
        w = tokens10(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    for r in decontaminate.report(docs, bench).collect():
        w = tokens10(next(x[1] for x in rows if x[0] == r.doc_id))
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    assert decontaminate.report(empty, bench).count() == 0
    assert not decontaminate.report(docs, bench.where("item_id = 3")).where("contaminated").count()


def test_decontamination_keeps_clean_rows_of_a_repeated_or_null_id(spark):
    window = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, window)], "item_id long, text string")
    rows = [(1, window), (1, "clean text"), (2, "x " + window), (2, None), (None, window), (None, "other clean text"), (None, None), (3, "clean text"), (3, "clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit("c"))
    got = decontaminate.clean(docs, bench)
    assert got.columns == docs.columns
    left = [r for r in rows if window not in (r[1] or "")]
    assert sorted(map(repr, left)) == sorted(repr((r.doc_id, r.text)) for r in got.collect())


def test_perfect_hash():
    ids = rng.integers(-(1 << 62), 1 << 62, 5000)
    h = token_files.PerfectHash.build(ids, np.zeros(5000, np.int64))
    assert sorted(h.slots(ids, np.zeros(5000, np.int64)).tolist()) == list(range(5000))
    assert (h.slots(ids + 1, np.zeros(5000, np.int64)) >= 0).sum() <= 2


def test_token_files(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = sorted(((x[0] if x[0] is not None else -1, x[1] or "") for x in corpus()))
    start, want = 0, []
    for d, t in rows:
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.report(docs).collect())
    assert got == sorted(want)
    assert token_files.report(empty).count() == 0


def test_kneser_ney_sums_to_one(spark, docs, empty):
    got = ngram_lm.report(docs).collect()
    assert len(got) == len(corpus()) and all(r.score <= 0 and r.base_score <= 0 for r in got)
    assert all(r.n_tokens == 1 + len((next(x[1] for x in corpus() if x[0] == r.doc_id) or "").encode().split()) for r in got)
    one = spark.createDataFrame([("a b a c b a",), ("b a",), (None,)], "text string")
    from loomline.llm.common import scratch_path

    m = ngram_lm.Mapped(ngram_lm.fit(one, F.lit(True), scratch_path(spark, "lm")))
    kinds = ["a", "b", "c", "zz"]  # every known token, one unknown, and the end
    for ctx in ("a", "b", "c", "unseen"):
        total = 0.0
        for k in kinds:
            t, n = ngram_lm.tokens(np.frombuffer(f"{ctx} {k}".encode(), np.uint8), np.array([0, len(f"{ctx} {k}")]))
            total += 10 ** m.logs(t, n)[0][1]
        t, n = ngram_lm.tokens(np.frombuffer(ctx.encode(), np.uint8), np.array([0, len(ctx)]))
        total += 10 ** m.logs(t, n)[0][1]
        assert abs(total - 1) < 1e-9
    assert ngram_lm.report(empty).count() == 0


def test_sketches_merge_and_estimate():
    a, b = (np.unique(rng.integers(0, 1 << 63, 2000, np.uint64)) for _ in range(2))
    x, y = np.concatenate([a, b[:200]]), np.concatenate([a, b[200:400]])
    sk = near_dedup.sketch(np.concatenate([x, y, np.concatenate([x, y])]), np.cumsum([0, len(x), len(y), len(x) + len(y)]))
    assert (np.maximum(sk[0], sk[1]) == sk[2]).all()
    j = near_dedup.compare(sk[:1], sk[1:2], np.array([len(x)]), np.array([len(y)]))[0]
    assert abs(j - len(a) / (len(a) + 400)) < 0.1


def test_near_duplicates(docs, empty):
    sets, ids = {}, {}
    for d, t, *_ in corpus():
        w = (t or "").encode().lower().split()
        if d is not None:
            ids[d] = sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    group = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    got = near_dedup.report(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), group[r.doc_id], group[r.doc_id] == r.doc_id)
    assert near_dedup.report(empty).count() == 0
    kept = [r.doc_id for r in near_dedup.keep_one(docs, percent=85).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(d for d in group if group[d] == d)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcde")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (3, d.upper()), (4, ""), (4, None), (5, ""), (6, c + " end"), (None, a), (None, a), (None, e), (None, None)]
    got = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted((r.doc_id, (r.text or "").lower()) for r in got if r.doc_id is not None)
    assert kept == [(1, a), (2, b), (3, c), (3, d), (4, ""), (5, "")]
    assert sorted(r.text or "" for r in got if r.doc_id is None) == ["", a, a, e]
