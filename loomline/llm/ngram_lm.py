"""Interpolated modified Kneser-Ney word bigrams: counted in Spark, scored from memory-mapped arrays.

Tokens are runs of bytes other than blanks (space, tab to carriage return), A-Z lower-cased, and one
end token for each text; a token is known by a 64-bit hash of its bytes. The first token's context is a
fixed start mark.

Counting: each map task sums its own pairs (context, token) and sends blocks of sorted arrays, dealt by
context; a reducer merges its blocks, writes the pairs and the contexts it owns, and sends for each
token the number of contexts and of occurrences, dealt by token; the second reducers merge those and
write the unigrams. Only counts of counts (a few numbers from each reducer) reach the driver.

Model files are arrays sorted by hash: pairs -> count; contexts -> total and the numbers of successors
seen once, twice, more often; tokens -> contexts and count. Workers map them and search them with
sorted queries. P(w|u) = max(c - D(c), 0) / c(u) + g(u) P(w), P(w) = max(k - D(k), 0) / K + g / (V + 1), with
k the number of contexts of w, K their sum, V the number of distinct training tokens.

Defined results: null text is empty and has the end token alone; with nothing to learn from, every
token has probability 1/(V + 1) = 1; repeated rows count each time; ids and other columns only decide
the fold. Counts cover all training documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, scratch_path, store
from .files import map_arrays, write_arrays
from .langid import buffers, held_out, slices
from .token_files import mix

END, START = np.uint64(0x656E64), np.uint64(0x7374617274)
#: Pairs that a map task gathers before it sums and sends them.
GATHER = 2_000_000
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_rng = np.random.default_rng(20)
LETTER = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
LETTER[ord("A") : ord("Z") + 1] = LETTER[ord("a") : ord("z") + 1]
BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, at least n of each."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            a = np.full(max(n, 1 << 21), b, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, END after each text, and the number of tokens of each text."""
    n = len(data)
    blank = BLANK[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = ~blank
    begins[1:] &= blank[:-1] | cut[1:n]
    ends = ~blank
    ends[:-1] &= blank[1:] | cut[1:n]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER[data] * up[:n])])
        h = mix((sums[e] - sums[s]) * down[s], 5)
    of = np.searchsorted(offsets, s, "right") - 1  # texts that are empty own no token
    counts = np.bincount(of, minlength=len(offsets) - 1) + 1
    out = np.full(len(h) + len(counts), END, np.uint64)
    out[np.arange(len(h)) + of] = h
    return out, counts


def contexts(t: np.ndarray, counts: np.ndarray) -> np.ndarray:
    u = np.empty_like(t)
    u[1:] = t[:-1]
    u[np.cumsum(counts) - counts] = START
    return u


def pair_key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(u * np.uint64(0xD1342543DE82EF95) + w, 9)


def total(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sorted distinct keys (compared one after another) and their summed values."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]) if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]


def by_part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def block(*arrays: np.ndarray) -> bytes:
    """A count, then the arrays; small integers at the least width."""
    out = [np.array([len(arrays[0])], "<u8").tobytes()]
    for a in arrays:
        if a.dtype != np.uint64:
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        out.append(np.array([a.dtype.itemsize], "<u8").tobytes() + a.tobytes())
    return b"".join(out)


def unblock(b: bytes, n_arrays: int) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(b, "<u8", 1)[0]), 8, []
    for _ in range(n_arrays):
        width = int(np.frombuffer(b, "<u8", 1, at)[0])
        out.append(np.frombuffer(b, f"<u{width}", n, at + 8).astype(np.uint64))
        at += 8 + n * width
    return out


def _send(parts: np.ndarray, arrays: list[np.ndarray], n_parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows of each part; parts must not fall."""
    edges = np.searchsorted(parts, np.arange(n_parts + 1))
    own = np.flatnonzero(np.diff(edges))
    for k in own.tolist():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block(*(a[edges[k] : edges[k + 1]] for a in arrays))], pa.binary())], ["part", "block"])


def _gathered(batches: Iterator[pa.RecordBatch], n_arrays: int) -> dict[int, list[list[np.ndarray]]]:
    found: dict[int, list[list[np.ndarray]]] = {}
    for b in batches:
        for k, x in zip(b.column("part").to_pylist(), b.column("block"), strict=True):
            found.setdefault(k, []).append(unblock(x.as_buffer(), n_arrays))
    return found


def fit(docs: DataFrame, learn: Column, out_dir: str, text: str = "text", parts: int | None = None) -> dict:
    """Count the rows where ``learn`` holds and write the model under ``out_dir``; returns its small part, for ``score``."""
    spark = docs.sparkSession
    parts = parts or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    src = docs.where(learn).select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            u, w = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            (u, w), (c,) = total([u, w], [np.ones(len(u), np.uint64)])
            p = by_part(u, parts)  # the part follows the order of u
            yield from _send(p, [u, w, c], parts)

        for whole in batches:
            for b in slices(whole, "t"):
                t, n = tokens(*buffers(b.column("t")))
                held.append((contexts(t, n), t))
                if sum(len(x[1]) for x in held) >= GATHER:
                    yield from flush()
        if held:
            yield from flush()

    @lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, blocks in _gathered(batches, 3).items():
            (u, w), (c,) = total([np.concatenate([x[i] for x in blocks]) for i in (0, 1)], [np.concatenate([x[2] for x in blocks])])
            order = np.argsort(key := pair_key(u, w))
            write_arrays(path := f"{out_dir}/pairs-{k:05d}-{uuid.uuid4().hex[:12]}", [key[order], c[order].astype("<u4")])
            (own,), (sums, *kinds) = total([u], [c, *((c == x).astype(np.uint64) for x in (1, 2)), (c >= 3).astype(np.uint64)])
            write_arrays(path.replace("pairs-", "contexts-"), [own, sums, *(x.astype("<u4") for x in kinds)])
            (words,), (cc, n) = total([w], [np.ones(len(w), np.uint64), c])
            kinds_of = np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - k], pa.int32()), pa.array([path.encode()], pa.binary()), pa.array([kinds_of[1:5].tolist()], pa.list_(pa.int64()))], ["part", "block", "kinds"])
            for b in _send(by_part(words, parts), [words, cc, n], parts):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.list_(pa.int64()))], ["part", "block", "kinds"])

    @lean
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, blocks in _gathered(batches, 3).items():
            (w,), (cc, n) = total([np.concatenate([x[0] for x in blocks])], [np.concatenate([x[i] for x in blocks]) for i in (1, 2)])
            write_arrays(path := f"{out_dir}/words-{k:05d}-{uuid.uuid4().hex[:12]}", [w, cc.astype("<u4"), n])
            row = [len(w), int(n.sum()), int(cc.sum()), int((cc >= 3).sum()), *np.bincount(np.minimum(cc, 5).astype(np.int64), minlength=6)[1:5].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([path]), pa.array([row], pa.list_(pa.int64()))], ["part", "path", "sums"])

    sent = src.mapInArrow(count, "part int, block binary").repartition(parts, "part")
    merged = store(sent.mapInArrow(merge, "part int, block binary, kinds array<long>"), "lm-merged")
    words = store(merged.where("part >= 0").select("part", "block").repartition(parts, "part").mapInArrow(finish, "part int, path string, sums array<long>"), "lm-words").collect()
    pairs = merged.where("part < 0").select((-1 - F.col("part")).alias("part"), F.col("block").cast("string").alias("path"), "kinds").collect()
    sums = np.array([r["sums"] for r in words], np.int64).reshape(-1, 8).sum(0).tolist()
    kinds = np.array([r["kinds"] for r in pairs], np.int64).reshape(-1, 4).sum(0).tolist()
    return {
        "parts": parts, "pairs": {r["part"]: r["path"] for r in pairs}, "words": {r["part"]: r["path"] for r in words},
        "V": sums[0], "N": sums[1], "K": sums[2], "kinds": [sums[4], sums[5], sums[3]], "D2": discounts(kinds), "D1": discounts(sums[4:]),
    }


def discounts(n: list[int]) -> list[float]:
    """Discounts of counts 0, 1, 2 and 3 or more, from the numbers of grams seen 1 to 4 times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    rough = [1 - 2 * y * n2 / n1 if n1 and n2 else 0.5, 2 - 3 * y * n3 / n2 if n2 and n3 else 1.0, 3 - 4 * y * n4 / n3 if n3 and n4 else 1.5]
    return [0.0, *(min(max(d, 0.05), k) for k, d in enumerate(rough, 1))]


class Mapped:
    """A model's files, mapped on first use."""

    def __init__(self, model: dict):
        self.m, self.open = model, {}

    def part(self, kind: str, k: int) -> list[np.ndarray] | None:
        if (kind, k) not in self.open:
            path = self.m["words" if kind == "words" else "pairs"].get(k)
            self.open[kind, k] = path and map_arrays(path.replace("pairs-", "contexts-") if kind == "contexts" else path)
        return self.open[kind, k]

    def find(self, kind: str, part: np.ndarray, key: np.ndarray, n_values: int) -> list[np.ndarray]:
        """Values of each key, 0 where it isn't there; keys in order of part and key."""
        out = [np.zeros(len(key), np.int64) for _ in range(n_values)]
        edges = np.searchsorted(part, np.arange(self.m["parts"] + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            if (arrays := self.part(kind, k)) is not None and len(arrays[0]):
                own = slice(edges[k], edges[k + 1])
                at = np.minimum(np.searchsorted(arrays[0], key[own]), len(arrays[0]) - 1)
                hit = arrays[0][at] == key[own]
                for o, a in zip(out, arrays[1:], strict=True):
                    o[own] = np.where(hit, a[at], 0)
        return out

    def logs(self, t: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token log10 of its model probability, of its base probability, and whether it is known."""
        m = self.m
        d1, d2 = np.array(m["D1"]), np.array(m["D2"])
        u = contexts(t, counts)
        words, of = np.unique(t, return_inverse=True)
        cc, c = self.find("words", by_part(words, m["parts"]), words, 2)
        k1, k2, k3 = m["kinds"]
        low = np.full(len(words), 1 / (m["V"] + 1))
        if m["K"]:
            low = (np.maximum(cc - d1[np.minimum(cc, 3)], 0) + (d1[1] * k1 + d1[2] * k2 + d1[3] * k3) / (m["V"] + 1)) / m["K"]
        base = np.log10((c + 0.1) / (m["N"] + 0.1 * (m["V"] + 1)))
        us, uof = np.unique(u, return_inverse=True)
        sums, *kinds = self.find("contexts", by_part(us, m["parts"]), us, 4)
        # with the unseen part of each context
        free = np.where(sums > 0, (d2[1] * kinds[0] + d2[2] * kinds[1] + d2[3] * kinds[2]) / np.maximum(sums, 1), 1.0)
        key, kof = np.unique(pair_key(u, t), return_inverse=True)
        first = np.empty(len(key), np.int64)
        first[kof] = np.arange(len(kof))
        p = by_part(u[first], m["parts"])
        order = np.lexsort((key, p))
        n = np.empty(len(key), np.int64)
        n[order] = self.find("pairs", p[order], key[order], 1)[0]
        n = n[kof]
        prob = np.maximum(n - d2[np.minimum(n, 3)], 0) / np.maximum(sums, 1)[uof] + free[uof] * low[of]
        return np.log10(prob), base[of], c[of] > 0


def score(docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with n_tokens, n_known, base_score and score of each whole text; one pass, no shuffle."""
    src = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__bytes"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped = Mapped(model)
        for whole in batches:
            for b in slices(whole, "__bytes"):
                t, n = tokens(*buffers(b.column("__bytes")))
                at = np.cumsum(n) - n
                own, base, known = mapped.logs(t, n)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in keep), pa.array(n), pa.array(np.add.reduceat(known.astype(np.int64), at)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(own, at))],
                    [*keep, "n_tokens", "n_known", "base_score", "score"])

    return src.mapInArrow(run, f"{schema}, n_tokens long, n_known long, base_score double, score double")


def report(docs: DataFrame) -> DataFrame:
    fold = held_out("doc_id", 10, 0)
    model = fit(docs, ~fold, scratch_path(docs.sparkSession, "lm"))
    scored = score(docs.select("doc_id", fold.alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model["N"]).cast("long").alias("train_tokens"), "base_score", "score")
