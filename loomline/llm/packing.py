"""Packing of documents into sequences by cutting stock: column generation over the histogram of lengths.

Texts are encoded in tasks and stored. What must be packed are items: whole documents of up to ``capacity`` tokens, and the
full pieces and the rest of longer ones. Only the histogram of their lengths, at most ``capacity`` rows, comes to the driver.

1. The linear program: fewest sequences so that each length class (GRAIN tokens wide, rounded up) is used as often as it
   occurs. Columns are patterns, how many items of each class a sequence holds. Columns are those of a fractional
   first fit and, from then on, the pattern that a knapsack by dynamic programming prices best under the duals of the basis,
   until none improves or the bound by the duals says that under GAP is left.
2. Rounding: patterns are used a whole number of times, what is left is put together by first fit, and each class pattern is
   split into patterns of exact lengths.
3. Gaps of at least LEAST_FILL tokens are filled by cutting: the worst-filled sequences are taken apart, as many as it needs, and
   their documents, one after another as a stream, fill the gaps of the others; what remains of the stream makes full
   sequences and then some whose lengths are powers of two, which need no padding.
4. Documents are ranked within their length and the n-th of a length takes the n-th place that the plan has for it, by
   arithmetic: a plan row covers a range of ranks. The plan has at most some rows for each length and pattern, whatever the number of
   documents. Ranks are counted in hash cells and then within a cell, so a length that a third of all documents share is never in one task.

Defined results: null text is empty and has the end id alone; rows that repeat an id, or have none, are documents of
their own; an empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, scratch_path, small, store
from .langid import buffers, slices
from .token_files import Encoder

CAPACITY, END_ID = 4096, 2
#: Width of a length class, relative gap at which the program ends, shortest gap that is worth a cut.
GRAIN, GAP, LEAST_FILL = 4, 1e-4, 16
#: Rows of a length in a cell at least, and cells of all lengths together, about.
CELL_ROWS, CELLS = 200, 20_000


class Words(Encoder):
    """Ids of whole texts for a vocabulary that lowers case, drops white space and encodes words, digits and runs of signs one by one.

    As for a byte-level vocabulary texts of plain letters are cut here, a batch at once, and each distinct piece is encoded
    once; here white space goes before the pieces are looked up, and the library's model encodes new ones.
    """

    #: Bytes as the letters of a byte-level vocabulary: those that Latin-1 doesn't print follow from U+0100 on.
    LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}

    def __init__(self, path: str):
        super().__init__(path)
        self.special = [*self.special, "İ".encode()]  # its small letter is two
        self.model, self.inside = self.library.model, False

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.begin

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which bytes begin a piece, and which are white. Of an apostrophe that begins one s, t, m, d, re, ve and ll end it."""
        n, kind = len(data), self.KIND[data]
        sign = np.flatnonzero(data[:-1] == 0xC3) if n > 1 else np.zeros(0, np.int64)
        sign = sign[(data[sign + 1] == 0x97) | (data[sign + 1] == 0xB7)]  # the signs for times and divided by
        kind[sign] = kind[sign + 1] = 5
        white = (kind == 3) | (kind == 4)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start = edge[:n] & ~white
        start[1:] |= ~white[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        at = np.flatnonzero(start & (data == ord("'")))
        if len(at):
            end = offsets[np.searchsorted(offsets, at, "right")]
            one, two = (np.where(at + k < end, data[np.minimum(at + k, n - 1)], 0) for k in (1, 2))
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            start[at[short | long] + 1] = False
            for some, k in ((short, 2), (long, 3)):
                after = at[some] + k
                after = after[after < end[some]]
                start[after[~white[after]]] = True
        return start, white

    def _plain(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.frombuffer(data.tobytes().decode().lower().encode(), np.uint8)
        start, white = self.pieces(low, offsets)
        place = np.concatenate([[0], np.cumsum(~white)])
        self.begin, self.inside = place[np.flatnonzero(start)], True
        try:
            return super()._plain(low[~white], place[offsets], end)
        finally:
            self.inside = False

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.inside:
            return super()._ids(pieces)
        found = [[t.id for t in self.model.tokenize(x if x.isascii() else x.encode().decode("latin-1").translate(self.LETTERS))] for x in pieces]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes


def tokenised(docs: DataFrame, vocabulary: str, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, doc_id, n, ids): a stored row for each document; ids are little-endian 32-bit, the end id last."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(vocabulary)
        for batch in batches:
            for part in slices(batch, "t"):
                ids, n = words.encode(*buffers(part.column("t")), end_id)
                flat = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
                offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(4 * n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(n, pa.int64()), pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, flat])], ["doc_id", "n", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).mapInArrow(run, "doc_id long, n long, ids binary")
    path = scratch_path(docs.sparkSession, "pack-ids")
    rows.select(F.monotonically_increasing_id().alias("uid"), "*").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema("uid long, doc_id long, n long, ids binary").parquet(path)


def knapsack(width: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable numbers of items of these widths that fit."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    by = np.argsort(width, kind="stable")
    w, v = width[by], value[by]
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        n = np.searchsorted(w, c, "right")
        if n:
            gain = best[c - w[:n]] + v[:n]
            i = int(gain.argmax())
            if gain[i] > best[c]:
                best[c], last[c] = gain[i], by[i]
    out, c = np.zeros(len(width), np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= int(width[last[c]])
    return float(best[room]), out


def first_fit(width: np.ndarray, left: np.ndarray, room: int, whole: bool) -> Iterator[tuple[np.ndarray, float]]:
    """Patterns filled with the widest items first, and how often each; fractions of times unless ``whole``."""
    left = left.astype(np.int64 if whole else float).copy()
    by = np.argsort(-width, kind="stable")
    while (left > 0).any():
        n, space = np.zeros(len(width), np.int64), room
        for i in by[left[by] > 0]:
            if width[i] <= space:
                n[i] = min(space // width[i], int(np.ceil(left[i])))
                space -= n[i] * width[i]
        used = np.flatnonzero(n)
        times = (left[used] // n[used] if whole else left[used] / n[used]).min()
        out = used[left[used] <= times * n[used]]
        left[used] -= times * n[used]
        left[out] = 0
        left[left < 1e-6] = 0
        yield n, times


def patterns(width: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, rounds: int = 6000) -> tuple[list[tuple[np.ndarray, int]], float]:
    """Patterns and how often each is used, exactly the demand together; and a lower bound of the number of sequences.

    The simplex starts from sequences of one class each. The patterns of a first fit are priced first, the knapsack when none of
    them improves. Any basis is a right plan, so ``rounds`` bounds only how good it is.
    """
    m = len(width)
    if not m:
        return [], 0.0
    pool = np.array([n for n, _ in first_fit(width, demand, room, whole=False)], float)
    a = np.diag((room // width).astype(float))
    inverse, need, bound = np.diag(1 / np.diag(a)), demand.astype(float), float(width @ demand) / room  # widths are dual prices
    x, y, good = inverse @ need, inverse.sum(0), a.copy()
    for k in range(1, rounds + 1):
        values = pool @ y
        price, n = float(values.max()), pool[int(values.argmax())]
        if price <= 1 + 1e-7:
            price, n = knapsack(width, np.maximum(y, 0), room)
            bound = max(bound, float(np.maximum(y, 0) @ need) / max(price, 1))
        if price <= 1 + 1e-9 or x.sum() - bound <= max(gap * x.sum(), 0.5):
            break
        u = inverse @ n
        ratio = np.where(u > 1e-6, np.maximum(x, 0) / np.where(u > 1e-6, u, 1), np.inf)
        r = int(np.where(ratio <= ratio.min() * (1 + 1e-9) + 1e-9, u, 0).argmax())  # of equal ones the largest pivot
        row = inverse[r] / u[r]
        y += (1 - price) * row
        inverse -= np.multiply.outer(u, row)
        inverse[r] = row
        x -= u * ratio[r]
        x[r] = ratio[r]
        a[:, r] = n
        if k % 200 == 0:  # the arithmetic drifts
            inverse = np.linalg.inv(a)
            if np.abs(inverse @ (a @ np.ones(m)) - 1).max() > 1e-5:
                break
            x, y, good = inverse @ need, inverse.sum(0), a.copy()
    x = np.linalg.lstsq(a, need, rcond=None)[0] if np.linalg.matrix_rank(a) < m else np.linalg.solve(a, need)
    if np.abs(a @ x - need).max() > 1e-3 or x.min() < -1e-3:
        a, x = good, np.linalg.solve(good, need)
    counts = a.astype(np.int64)
    times = np.floor(np.maximum(x, 0) + 1e-7).astype(np.int64)
    rest = demand - counts @ times
    while (rest < 0).any():  # rounding of the arithmetic
        over = np.flatnonzero((counts[np.flatnonzero(rest < 0)[0]] > 0) & (times > 0))[0]
        times[over] -= 1
        rest = demand - counts @ times
    used = [(counts[:, i], int(times[i])) for i in np.flatnonzero(times)]
    return used + [(n, int(t)) for n, t in first_fit(width, rest, room, whole=True)], bound


def exact(found: list[tuple[np.ndarray, int]], width: np.ndarray, counts: Mapping[int, int], grain: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """The class patterns as patterns of lengths: [(length, how many)] and times."""
    left: dict[int, list[list[int]]] = {}
    for n in sorted(counts):
        left.setdefault(-(-n // grain), []).append([n, counts[n]])
    for pattern, times in found:
        used = np.flatnonzero(pattern)
        while times:
            own, most = [], times
            for i in used:
                want = int(pattern[i])
                lengths = left[int(width[i])]
                at = len(lengths) - 1
                while want:
                    n, there = lengths[at]
                    take = min(want, there)
                    most = min(most, there // take)
                    own.append((n, take))
                    want, at = want - take, at - 1
            yield own, most
            for n, take in own:
                lengths = left[-(-n // grain)]
                lengths[next(k for k, x in enumerate(lengths) if x[0] == n)][1] -= take * most
            for i in used:
                left[int(width[i])] = [x for x in left[int(width[i])] if x[1]]
            times -= most


class Plan:
    """Where the n-th item of each length goes: arrays over ranges of ranks, and over the gaps that the stream fills."""

    SHIFT = 45

    def __init__(self, counts: Mapping[int, int], capacity: int = CAPACITY, grain: int = GRAIN, least_fill: int = LEAST_FILL):
        if grain > capacity or capacity % grain:
            raise ValueError("the capacity must be a multiple of the grain")
        classes: dict[int, int] = {}
        for n, c in counts.items():
            classes[-(-n // grain)] = classes.get(-(-n // grain), 0) + c
        width, demand = (np.array(x, np.int64) for x in (sorted(classes), [classes[w] for w in sorted(classes)]))
        found, self.bound = patterns(width, demand, capacity // grain)
        made = [(own, times, sum(n * k for n, k in own)) for own, times in exact(found, width, counts, grain)]
        padded = lambda size: 0 if size & (size - 1) == 0 else capacity - size
        made.sort(key=lambda p: -padded(p[2]))
        need, stream, parted = sum(t * padded(s) for _, t, s in made if padded(s) >= least_fill), 0, []
        for own, times, size in made:  # the worst first: a sequence taken apart brings its tokens and no longer has a gap
            take = min(times, -(-(need - stream) // capacity)) if padded(size) >= least_fill and need > stream else 0
            need, stream = need - take * padded(size), stream + take * size
            parted.append(take)
        used, rows, gaps, sequence, at, filled = dict.fromkeys(counts, 0), [], [], 0, 0, 0
        for (own, times, size), apart in zip(made, parted, strict=True):
            keep, offset = times - apart, 0
            for n, k in own:
                if keep:
                    rows.append((n, used[n], k, sequence, offset, 0))
                    used[n] += k * keep
                offset += n * k
            for n, k in own:
                if apart:
                    rows.append((n, used[n], k, at, 0, 1))
                    used[n] += k * apart
                    at += n * k * apart
            if keep and padded(size) >= least_fill:
                gaps.append((filled, padded(size), keep, sequence, size))
                filled += padded(size) * keep
            sequence += keep
        rest = stream - filled
        for size in [capacity, *(1 << b for b in reversed(range(capacity.bit_length())) if 1 << b < capacity)]:
            if n := rest // size if size == capacity else int(rest >= size):
                gaps.append((filled, size, n, sequence, 0))
                sequence, filled, rest = sequence + n, filled + n * size, rest - n * size
        if rest:  # only where the capacity is no power of two
            gaps.append((filled, rest, 1, sequence, 0))
            sequence += 1
        rows.sort()
        self.sequences, self.capacity = sequence, capacity
        self.length, self.low, self.many, self.to, self.offset, self.streamed = np.array(rows, np.int64).reshape(-1, 6).T.copy()
        self.gap_at, self.gap, self.gap_times, self.gap_to, self.gap_offset = np.array(gaps, np.int64).reshape(-1, 5).T.copy()
        self.gap_first = np.cumsum(self.gap_times) - self.gap_times

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, start in it, length, sequence, offset, whole) of each piece of the rank-th items of these lengths."""
        at = np.searchsorted((self.length << self.SHIFT) + self.low, (length << self.SHIFT) + rank, "right") - 1
        nth = rank - self.low[at]
        whole = np.flatnonzero(self.streamed[at] == 0)
        w, k = at[whole], nth[whole]
        out = [(whole, np.zeros_like(whole), length[whole], self.to[w] + k // self.many[w], self.offset[w] + k % self.many[w] * length[whole], np.ones(len(whole), bool))]
        cut = np.flatnonzero(self.streamed[at])
        if len(cut):
            begin = self.to[at[cut]] + nth[cut] * length[cut]
            end = begin + length[cut]

            def gap_of(pos: np.ndarray) -> np.ndarray:
                q = np.searchsorted(self.gap_at, pos, "right") - 1
                return self.gap_first[q] + (pos - self.gap_at[q]) // self.gap[q]

            first, last = gap_of(begin), gap_of(end - 1)
            n = last - first + 1
            item = np.repeat(np.arange(len(cut)), n)
            g = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
            q = np.searchsorted(self.gap_first, g, "right") - 1
            start = self.gap_at[q] + (g - self.gap_first[q]) * self.gap[q]
            a, b = np.maximum(begin[item], start), np.minimum(end[item], start + self.gap[q])
            out.append((cut[item], a - begin[item], b - a, self.gap_to[q] + g - self.gap_first[q], self.gap_offset[q] + a - start, np.zeros(len(item), bool)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def layout(tokens: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """(uid, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): where each piece of each document goes."""
    spark = tokens.sparkSession
    items = tokens.withColumn("start", F.explode(F.expr(f"transform(sequence(0L, (n - 1) div {capacity}), i -> i * {capacity})")))
    items = items.withColumn("length", F.expr(f"least({capacity}L, n - start)"))
    items = items.select("uid", "doc_id", "start", "length", F.crc32(F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))")).alias("crc"), F.col("n").alias("doc_tokens"))
    items = store(items, "pack-items")
    counts = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # at most ``capacity`` lengths
    plan = Plan(counts, capacity, grain)
    each = max(CELL_ROWS, sum(counts.values()) // CELLS)
    dealt = spark.createDataFrame([(n, 1 + c // each) for n, c in counts.items()], "length long, cells long")
    placed = items.join(F.broadcast(dealt), "length").withColumn("cell", F.expr("pmod(xxhash64(uid, start), cells)"))
    cells = placed.groupBy("length", "cell").agg(F.count("*").alias("c"))
    cells = cells.selectExpr("length", "cell", "sum(c) over (partition by length order by cell) - c as base")
    ranked = placed.join(small(store(cells, "pack-cells"), 2 * CELLS), ["length", "cell"]).withColumn("rank", F.expr("base + row_number() over (partition by length, cell order by uid, start) - 1"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item, begin, length, sequence, offset, whole = plan.place(*(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank")))
            of = b.take(pa.array(item))
            start = of.column("start").to_numpy() + begin
            crc = pa.array(of.column("crc").to_numpy(), pa.int64(), mask=~whole)
            arrays = [of.column("uid"), of.column("doc_id"), *(pa.array(x, pa.int64()) for x in (start, length)), crc, of.column("doc_tokens"), *(pa.array(x, pa.int64()) for x in (sequence, offset))]
            yield pa.RecordBatch.from_arrays(arrays, ["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    pieces = ranked.select("uid", "doc_id", "start", "length", "crc", "doc_tokens", "rank").mapInArrow(run, "uid long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    pieces = store(pieces, "pack-pieces")
    cut = pieces.where("ids_crc32 is null").drop("ids_crc32")
    known = F.crc32(F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))"))
    summed = tokens.select("uid", "ids").join(small(cut, 200_000), "uid").withColumn("ids_crc32", known)
    return pieces.where("ids_crc32 is not null").unionByName(summed.select(pieces.columns))


def sequences(tokens: DataFrame, pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences themselves, padded unless their length is a power of two."""
    own = tokens.select("uid", "ids").join(pieces, "uid").select("sequence_id", F.struct("offset", F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))").alias("ids")).alias("piece"), "length")
    one = own.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list("piece")).alias("pieces"))  # at most ``capacity`` tokens
    pad = np.array([pad_id], "<u4").tobytes().hex()
    blank = F.expr(f"unhex(repeat('{pad}', cast(if(n_tokens & (n_tokens - 1) = 0, 0, {capacity} - n_tokens) as int)))")
    return one.select("sequence_id", "n_tokens", F.concat(F.expr("aggregate(pieces, cast('' as binary), (a, p) -> concat(a, p.ids))"), blank).alias("ids"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def report(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return layout(tokenised(docs, vocabulary or vocabulary_path()), capacity).drop("uid")
