"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Each direction keeps a state h of H units: z = sigmoid(E_z[byte] + h U_z), c = tanh(E_c[byte] + h U_c),
h <- h + z (c - h). Both states label every byte by a softmax over the languages; a document's
probabilities are the means over all of its bytes. Texts are cut into pieces of STEPS bytes that run side
by side, each from a zero state, so no byte is left out and memory is bounded by the piece table.

Training is backpropagation through time with Adam on the driver, on one piece from each of at most
``max_train`` documents a language; that bound is the only sample taken. Which documents may be learnt
from is the caller's choice. Prediction sees the text alone.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no labelled row
to learn from, all are ``und``; labels that are null are not learnt; ties go to the smaller label.
Other columns pass through; results are named by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, sheltered

UNITS, STEPS, ROWS = 8, 64, 2048
#: Documents of each language that are learnt from, at most.
MAX_TRAIN = 1500


@dataclass
class Model:
    langs: list[str]
    w: dict[str, np.ndarray]


def _init(n_langs: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    w: dict[str, np.ndarray] = {"b": np.zeros(n_langs, "f4")}
    for d in "fr":
        for g in "zc":
            w[f"{d}E{g}"] = rng.normal(0, 0.3, (256, UNITS)).astype("f4")
            w[f"{d}U{g}"] = (rng.normal(0, 1, (UNITS, UNITS)) / np.sqrt(UNITS)).astype("f4")
        w[f"{d}O"] = (rng.normal(0, 1, (UNITS, n_langs)) / np.sqrt(UNITS)).astype("f4")
        w[f"{d}Ez"] -= 1
    return w


def _grad(w: dict[str, np.ndarray], x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the masked positions of x [steps, rows], and its gradient by backpropagation through time."""
    steps, rows = x.shape
    kept, logits = {}, np.zeros((steps, rows, len(w["b"])), "f4") + w["b"]
    for d in "fr":
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        h, trace = np.zeros((rows, UNITS), "f4"), []
        for t in order:
            z = 1 / (1 + np.exp(-(w[f"{d}Ez"][x[t]] + h @ w[f"{d}Uz"])))
            c = np.tanh(w[f"{d}Ec"][x[t]] + h @ w[f"{d}Uc"])
            m = mask[t][:, None]
            new = h + m * z * (c - h)
            trace.append((t, h, z, c, new))
            h = new
            logits[t] += h @ w[f"{d}O"]
        kept[d] = trace
    logits -= logits.max(2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(2, keepdims=True)
    n = max(1.0, mask.sum())
    loss = -(np.log(p[:, np.arange(rows), y] + 1e-9) * mask).sum() / n
    dl = p
    dl[:, np.arange(rows), y] -= 1
    dl *= (mask / n)[:, :, None]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["b"] = dl.sum((0, 1))
    for d in "fr":
        dh = np.zeros((rows, UNITS), "f4")
        for t, h, z, c, new in reversed(kept[d]):
            m = mask[t][:, None]
            dh = dh + dl[t] @ w[f"{d}O"].T
            g[f"{d}O"] += new.T @ dl[t]
            az = dh * m * (c - h) * z * (1 - z)
            ac = dh * m * z * (1 - c * c)
            np.add.at(g[f"{d}Ez"], x[t], az)
            np.add.at(g[f"{d}Ec"], x[t], ac)
            g[f"{d}Uz"] += h.T @ az
            g[f"{d}Uc"] += h.T @ ac
            dh = dh * (1 - m * z) + az @ w[f"{d}Uz"].T + ac @ w[f"{d}Uc"].T
    return float(loss), g


def fit(texts: list[bytes], labels: list[str], iterations: int = 500, batch: int = 96, seed: int = 7) -> Model:
    """Learn from pieces of text; each is cut to STEPS bytes."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    w = _init(len(langs), rng)
    if len(langs) < 2:
        return Model(langs, w)
    x, mask = np.zeros((len(texts), STEPS), np.uint8), np.zeros((len(texts), STEPS), "f4")
    for i, t in enumerate(texts):
        b = np.frombuffer(t[:STEPS], np.uint8)
        x[i, : len(b)], mask[i, : len(b)] = b, 1
    y = np.array([langs.index(v) for v in labels])
    by = [np.flatnonzero(y == k) for k in range(len(langs))]
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    for i in range(1, iterations + 1):
        own = rng.integers(0, len(langs), batch)
        pick = np.array([by[k][rng.integers(len(by[k]))] for k in own])
        _, g = _grad(w, x[pick].T, mask[pick].T, y[pick])
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = 0.02 * (1 - i / (iterations + 1)) + 0.001
        for k in w:
            a = g[k] * min(1, 1 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            w[k] -= rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-6)
    return Model(langs, w)


class Scorer:
    """Applies a model to byte pieces, ROWS side by side, with buffers kept between calls."""

    def __init__(self, model: Model):
        self.n = max(1, len(model.langs))
        self.w = {k: np.ascontiguousarray(a * (0.5 if k[1:] in ("Ez", "Uz") else 1), "f4") for k, a in model.w.items()}
        self.ones = np.ones((self.n, 1), "f4")

    def sums(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums over its bytes of each piece's label probabilities; x [STEPS, rows]; pieces in order of falling length."""
        w, rows = self.w, x.shape[1]
        steps = int(lengths[0])
        live = [int(np.searchsorted(-lengths, -t, "left")) for t in range(steps)]  # pieces with more than t bytes
        out = np.zeros((rows, self.n), "f4")
        logits = np.empty((steps, rows, self.n), "f4")
        h, z, c, u = (np.zeros((rows, UNITS), "f4") for _ in range(4))
        for d in "rf":
            h[:] = 0
            for t in range(steps - 1, -1, -1) if d == "r" else range(steps):
                r = live[t]
                hh, zz, cc, uu, xx = h[:r], z[:r], c[:r], u[:r], x[t, :r]
                np.take(w[f"{d}Ez"], xx, 0, zz, "clip")
                np.take(w[f"{d}Ec"], xx, 0, cc, "clip")
                zz += np.matmul(hh, w[f"{d}Uz"], uu)
                cc += np.matmul(hh, w[f"{d}Uc"], uu)
                np.tanh(zz, zz)
                zz *= 0.5
                zz += 0.5
                np.tanh(cc, cc)
                cc -= hh
                cc *= zz
                hh += cc
                if d == "r":
                    np.matmul(hh, w["rO"], logits[t, :r])
                else:
                    e = logits[t, :r]
                    e += hh @ w["fO"]
                    e += w["b"]
                    np.clip(e, -30, 30, e)
                    np.exp(e, e)
                    e /= e @ self.ones
                    out[:r] += e
        return out

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean label probabilities [documents, languages] of texts that lie in ``data`` between ``offsets``."""
        size = np.diff(offsets)
        pieces = -(-size // STEPS)
        of = np.repeat(np.arange(len(size)), pieces)
        k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[:-1][of] + k * STEPS
        length = np.minimum(STEPS, offsets[1:][of] - start)
        total = np.zeros((len(size), self.n))
        order = np.argsort(-length, kind="stable")
        steps = np.arange(STEPS)[:, None]
        last = max(0, len(data) - 1)
        for at in range(0, len(order), ROWS):
            own = order[at : at + ROWS]
            x = data[np.minimum(start[own][None, :] + steps, last)].astype(np.intp)
            sums = self.sums(x, length[own])
            for j in range(self.n):
                total[:, j] += np.bincount(of[own], sums[:, j], len(size))
        return total / np.maximum(size, 1)[:, None]


def sample(docs: DataFrame, may_learn: Column, text: str, lang: str, key: str, max_train: int) -> list:
    """(lang, piece) rows: of each language one piece from each of the ``max_train`` documents whose hashes are least, at most."""
    h = F.xxhash64(F.col(key), F.xxhash64(F.col(text)))
    rows = docs.where(may_learn & F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).alias("lang"), F.pmod(h, F.lit(1 << 30)).alias("u"), F.col(text).alias("t"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    # few more than wanted pass the first sieve, and only those are ranked
    limits = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, (max_train + 6 * max_train**0.5) / n) * (1 << 30)))])
    found = rows.where(F.col("u") <= limits[F.col("lang")]).select("lang", "u", F.expr(f"substring(t, 1 + cast(pmod(u, greatest(1, length(t) - {STEPS})) as int), {STEPS})").alias("piece"))
    ranked = found.withColumn("r", F.expr("row_number() over (partition by lang order by u, piece)")).where(F.col("r") <= max_train)
    return [(r["lang"], r["piece"]) for r in ranked.orderBy("u", "piece").collect()]


def train(docs: DataFrame, may_learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", max_train: int = MAX_TRAIN) -> Model:
    rows = sample(docs, may_learn, text, lang, key, max_train)
    return fit([p.encode() for _, p in rows], [k for k, _ in rows])


def label(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``pred`` and ``score``, which replace any of those names. One pass, no shuffle."""
    rest = [c for c in docs.columns if c not in (pred, score)]
    src = docs.select(*rest, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__bytes"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    fields = [f for f in docs.schema.fields if f.name in rest]
    schema = T.StructType([*fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    langs, w = model.langs, model.w

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(langs, w))
        for whole in batches:
            for b in slices(whole, "__bytes"):
                data, offsets = buffers(b.column("__bytes"))
                letters = b.column("__letters").to_numpy(zero_copy_only=False).astype(bool) & (len(langs) > 0)
                p = scorer.documents(data, offsets) if len(langs) > 1 else np.ones((b.num_rows, 1))
                best = p.argmax(1)
                names = pa.array([langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)], pa.string())
                top = np.where(letters, np.clip(p[np.arange(len(best)), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), names, pa.array(top, pa.float64())], [*rest, pred, score])

    return src.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` that hold about ``most`` bytes of a binary column each, or one row."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and its offsets, counted from 0, without copying the bytes."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds == fold


def report(docs: DataFrame) -> DataFrame:
    model = train(docs, ~held_out())
    own = docs.select("doc_id", held_out().alias("held_out"), "text")
    return label(own, model).drop("text")


#: Documents whose best language gets less than this are rejected by the pipeline.
LEAST = 0.4


@sheltered
def accept(docs: DataFrame, key: str = "doc_id", least: float = LEAST) -> DataFrame:
    """The rows whose text the model takes for one of its languages; their own columns."""
    model = train(docs, ~held_out(key))
    return label(docs, model, pred="__pred", score="__score").where((F.col("__pred") != "und") & (F.col("__score") >= least)).drop("__pred", "__score")
