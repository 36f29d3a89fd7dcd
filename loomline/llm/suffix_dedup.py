"""Removal of byte strings that repeat across documents, by external induced sorting of suffixes.

Every LENGTH-byte string that also starts in a document with a smaller id is removed, wherever it
occurs in a later one; overlaps count and strings are judged on the input.

1. Each string's anchor is the leftmost of its GRAM-byte grams of least hash, so equal strings have equal
   anchors. Anchors that occur in two documents are found by shuffling their hashes, and written as sorted
   arrays that workers map. No other string can repeat.
2. The bytes of all strings of one occurrence of such an anchor (a snippet) go to the anchor's shard; of equal snippets one
   is sent, with the least and the greatest document that has it. Occurrences themselves never travel, so
   a passage that very many documents share is no more work than another.
3. A shard sorts the suffixes of its distinct snippets with ``induced.suffix_array``: recursive induction with
   disk-backed priority queues whose tuples carry common prefixes. Suffixes whose common prefixes reach LENGTH
   bytes form groups; the smallest document of a group keeps its string. Snippets that have too
   little around their anchor in common with any other need no sorting. What must go is written by the snippet's hash, as sorted arrays.
4. Documents are read once more, look their snippets up in the mapped arrays and are cut; texts are never shuffled.

The number of shards grows with the root of the input, and so does their size; the sorter works beyond memory.

Defined results: null text is empty; texts under LENGTH bytes lose nothing; rows that repeat an id are
one document and remove nothing from each other; rows without id take no part; very long texts are read in pieces;
an empty table gives no rows. Other columns take no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, scratch_path, store
from .files import exists, map_arrays, mounted, write_arrays
from .induced import Space, suffix_array
from .langid import buffers, slices
from .ngram_lm import by_part
from .token_files import mix

LENGTH, GRAM = 50, 24
WINDOW = LENGTH - GRAM + 1
#: Bytes of text that a task works on at once, and of snippets or anchors that it gathers before it sends them.
PIECE, GATHER = 96 << 10, 3 << 20
#: Bytes of text whose anchors are looked up at once: a look-up goes through all parts, whose number grows with the input.
LOOK = 2 << 20
#: Snippets are sorted if they have LENGTH - STEP + 1 bytes in common with another, at one of every STEP places around the anchor.
STEP = 3
#: Tuples that the sorter takes at once, and bytes of an array that it keeps in memory.
BATCH, KEEP = 1 << 16, 16 << 20
_rng = np.random.default_rng(6)
BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _sliding(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    k = 1
    while 2 * k <= width:
        values = np.minimum(values[:-k], values[k:])
        k *= 2
    return np.minimum(values[: len(values) - (width - k)], values[width - k :]) if k < width else values


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, start, end, document, place) of all anchors: the bytes from ``start`` to ``end`` are those of the anchor's strings."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none, none
    with np.errstate(over="ignore"):
        h = BYTE[data]
        for k in (1, 2, 4, 8):
            h = h[:-k] * np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1) + h[k:]
            h ^= h >> np.uint64(29)
        h = h[: len(h) - (GRAM - 16)] * np.uint64(0xD1342543DE82EF95) + h[GRAM - 16 :]
    h = mix(h, 41)
    # the least of a window by the upper half of its hash; of equal ones the leftmost, by the place in the lower half
    least = _sliding((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), WINDOW)
    whole = np.zeros(len(least) + 1, np.int64)
    ok = np.diff(offsets) >= LENGTH
    np.add.at(whole, offsets[:-1][ok], 1)
    np.add.at(whole, offsets[1:][ok] - LENGTH + 1, -1)
    string = np.flatnonzero(np.cumsum(whole)[:-1] > 0)
    if not len(string):
        return none.astype(np.uint64), none, none, none, none
    at = (least[string] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = string[np.append(new[1:], len(at)) - 1]
    return h[at[new]], string[new], last + LENGTH, np.searchsorted(offsets, string[new], "right") - 1, at[new]


def place(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and 32-bit remainder of each hash, hashed again, as those of anchors are small ones."""
    h = mix(h, 43)
    return by_part(h, parts), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _blocks(part: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    edges = np.searchsorted(part, np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, slice(edges[k], edges[k + 1])


def _by_part(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], kinds: tuple[type, ...]) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    """The blocks of each part in turn; rows come in order of part, so one part is held at a time."""
    last, held = None, []
    for b in batches:
        part = b.column("part").to_pylist()
        for i, k in enumerate(part):
            if k != last and held:
                yield last, held
                held = []
            last = k
            held.append([np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in zip(columns, kinds, strict=True)])
    if held:
        yield last, held


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + sizes[i] - 1 of all i, one after another."""
    to = np.cumsum(sizes)
    total = int(to[-1]) if len(to) else 0
    kind = np.int32 if total < 1 << 31 and (not len(starts) or int(starts.max()) < 1 << 30) else np.int64
    out = np.repeat((starts - to + sizes).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte of ``raw``, zeros after its end."""
    return np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(16, np.uint8)]), strides=(1,))


def content(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each of the strings that begin ``at`` bytes of ``raw``, eight bytes at a time."""
    low = int(at.min()) if len(at) else 0
    words, at = eights(raw[low : int((at + size).max())] if len(at) else raw[:0]), at - low
    one, two = size.astype(np.uint64), ~size.astype(np.uint64)
    left = np.arange(len(size))
    while len(left):
        n = size[left]
        w = words[at[left]] & MASK[np.minimum(n, 8)]
        with np.errstate(over="ignore"):
            one[left] = mix(one[left] * np.uint64(0x9E3779B97F4A7C15) + w, 50)
            two[left] = mix(two[left] * np.uint64(0xD1342543DE82EF95) + w, 51)
        size = size - 8
        at = at + 8
        left = left[n > 8]
    return one, two


def twice(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Which of the strings of ``n`` bytes, a multiple of eight, that begin ``at`` places occur more than once, by their hashes."""
    h = np.zeros(len(at), np.uint64)
    for k in range(0, n, 8):
        with np.errstate(over="ignore"):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[at + k], 52)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(at), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def kin(gram: np.ndarray, at: np.ndarray, size: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Which of the distinct snippets, with their anchors ``gram`` bytes after their beginnings, can share a string with another one.

    The anchor lies at one place of a shared string. Of the LENGTH - GRAM bytes beside it x come before, and with i = x - x % STEP both
    snippets have the LENGTH - STEP + 1 bytes that begin i before the anchor.
    """
    words, out = eights(raw), np.zeros(len(at), bool)
    own = np.flatnonzero(twice(words, at + gram, GRAM))
    most = LENGTH - STEP + 1
    for i in range(0, WINDOW, STEP):
        some = own[(gram[own] >= i) & (gram[own] - i + most <= size[own])]
        out[some[twice(words, at[some] + gram[some] - i, most)]] = True
    return out


def distinct(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its kind, and of each kind a row; kinds in order of the keys."""
    order = np.lexsort(keys[::-1])
    new = np.concatenate([[True], np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return kind, order[new]


def merged(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ranges, in order."""
    if not len(d):
        return d, s, e
    order = np.lexsort((s, d))
    d, s, e = d[order], s[order], e[order]
    doc = np.cumsum(np.concatenate([[0], d[1:] != d[:-1]]))
    far = np.int64(max(int(e.max()), 0) + 2)
    reach = np.maximum.accumulate(e + doc * far)
    new = np.concatenate([[True], (s + doc * far)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return d[at], s[at], np.maximum.reduceat(e, at)


def _pieces(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))


def stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[np.ndarray]]:
    """The ``anchors`` of the texts, those of about LOOK bytes at once; a long text is read in pieces that share LENGTH - 1 bytes, so each string is in one."""
    size = np.diff(offsets)
    if not len(size):
        return
    far, block = size > 2 * PIECE, offsets[:-1] // PIECE
    edges = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | far[1:] | far[:-1], [True]])).tolist()
    held, n = [], 0
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        a, z = int(offsets[i]), int(offsets[j])
        step = PIECE if far[i] else max(z - a, 1)
        for s in range(a, z - LENGTH + 1, step):
            to = min(z, s + step + LENGTH - 1)
            h, start, end, of, place_ = anchors(data[s:to], np.array([0, to - s]) if far[i] else offsets[i : j + 1] - a)
            held.append((h, start + s, end + s, of + i, place_ + s))
            n += to - s
            if n >= LOOK:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, n = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def repeated(docs: DataFrame, out_dir: str, parts: int, key: str, text: str) -> None:
    """Write the sorted anchors of each part that occur in two documents or more."""

    @lean
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, d = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            p, low = place(h, parts)
            k = p.astype(np.uint64) << np.uint64(32) | low
            order = np.argsort(k, kind="stable")
            k, d = k[order], d[order]
            new = np.concatenate([[True], k[1:] != k[:-1]])
            at = np.flatnonzero(new)
            many = np.maximum.reduceat(np.concatenate([[0], (~new[1:] & (d[1:] != d[:-1])).astype(np.uint8)]), at)
            k, first = k[at], d[at]
            p, low = (k >> np.uint64(32)).astype(np.int64), k.astype(np.uint32)
            for x, own in _blocks(p, parts):
                cells = [low[own], np.packbits(many[own]), first[own]]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], ["part", "low", "many", "first"])

        for whole in batches:
            for b in slices(whole, "t", LOOK):
                d = b.column("d").to_numpy()
                for h, _, _, of, _ in stretches(*buffers(b.column("t"))):
                    if len(h):
                        held.append((h, d[of]))
                    if sum(len(x[0]) for x in held) > GATHER // 8:
                        yield from flush()
        if held:
            yield from flush()

    @lean
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, blocks in _by_part(batches, ("low", "many", "first"), (np.uint32, np.uint8, np.int64)):
            low, first = (np.concatenate([x[i] for x in blocks]) for i in (0, 2))
            many = np.concatenate([np.unpackbits(x[1])[: len(x[0])] for x in blocks])
            order = np.argsort(low, kind="stable")
            low, many, first = low[order], many[order], first[order]
            twice = np.concatenate([(low[1:] == low[:-1]) & (first[1:] != first[:-1]), [False]])
            write_arrays(f"{out_dir}/anchors-{k:06d}", [np.unique(low[twice | (many > 0)])])
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32())], ["part"])

    sent = _pieces(docs, key, text).mapInArrow(send, "part int, low binary, many binary, first binary").repartition(parts, "part").sortWithinPartitions("part")
    store(sent.mapInArrow(merge, "part int"), "anchors")


class Files:
    """The arrays that the parts of a step have written, mapped on first use; a part without a file has none."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name, self.open = folder, name, {}

    def part(self, k: int) -> list[np.ndarray] | None:
        if k not in self.open:
            path = f"{self.folder}/{self.name}-{k:06d}"
            self.open[k] = map_arrays(path) if exists(path) else None
        return self.open[k]


def occurrences(data: np.ndarray, offsets: np.ndarray, files: Files, parts: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(part, anchor's place in the snippet, text, start, size) of the snippets of repeated anchors."""
    for h, s, e, of, at in stretches(data, offsets):
        p, low = place(h, parts)
        order = np.argsort(p.astype(np.min_scalar_type(parts)), kind="stable")
        hit = np.zeros(len(h), bool)
        for x, own in _blocks(p[order], parts):
            found = files.part(x)
            if found and len(found[0]):
                mine = low[order[own]]
                hit[order[own]] = found[0][np.minimum(np.searchsorted(found[0], mine), len(found[0]) - 1)] == mine
        if hit.any():
            yield p[hit], (at - s)[hit], of[hit], s[hit], (e - s)[hit]


def snippets(docs: DataFrame, out_dir: str, parts: int, key: str, text: str) -> DataFrame:
    """(part, gram, least, most, size, bytes): blocks of distinct snippets, with the place of the repeated anchor in each and the least and greatest document."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held = Files(out_dir, "anchors"), []

        def flush() -> Iterator[pa.RecordBatch]:
            p, gram, d, size, raw = (np.concatenate([x[i] for x in held]) for i in range(5))
            held.clear()
            starts = np.cumsum(size) - size
            kind, heads = distinct([p, *content(raw, starts, size)])
            least, most = np.full(len(heads), np.iinfo(np.int64).max), np.full(len(heads), np.iinfo(np.int64).min)
            np.minimum.at(least, kind, d)
            np.maximum.at(most, kind, d)
            for x, own in _blocks(p[heads], parts):
                mine = heads[own]
                cells = [gram[mine].astype(np.uint8), least[own], most[own], size[mine].astype(np.uint8), raw[ragged(starts[mine], size[mine])]]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], ["part", "gram", "least", "most", "size", "bytes"])

        for whole in batches:
            for b in slices(whole, "t", LOOK):
                d = b.column("d").to_numpy()
                data, offsets = buffers(b.column("t"))
                for p, gram, of, s, size in occurrences(data, offsets, files, parts):
                    held.append((p, gram, d[of], size, data[ragged(s, size)]))
                    if sum(len(x[4]) for x in held) > GATHER:
                        yield from flush()
        if held:
            yield from flush()

    return _pieces(docs, key, text).mapInArrow(run, "part int, gram binary, least binary, most binary, size binary, bytes binary")


def shared(size: np.ndarray, raw: np.ndarray, least: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): what of each distinct snippet also lies in one with a smaller least document; 0, 0 for nothing."""
    n = size.astype(np.int64)
    first = np.cumsum(n + 1) - (n + 1)
    text = space.array(int((n + 1).sum()) + 1, "<i4")
    text[:] = 1
    text[-1] = 0
    text[ragged(first, n)] = raw.astype(np.int32) + 2
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
    order, common = suffix_array(text, BATCH, space, LENGTH)
    low, high = np.full(len(n), 255, np.int64), np.zeros(len(n), np.int64)
    held, tied, at = np.zeros(0, np.int64), np.zeros(0, np.uint8), 0
    while at < len(order):  # whole groups at a time
        to = min(len(order), at + (1 << 18))
        sa, lcp = np.concatenate([held, order[at:to]]), np.concatenate([tied, common[at:to]])
        at = to
        starts = np.flatnonzero(lcp < LENGTH)
        end = len(sa) if at == len(order) or not len(starts) else int(starts[-1])
        if at < len(order) and (not len(starts) or end == 0):
            held, tied = sa, lcp
            continue
        held, tied = sa[end:], lcp[end:]
        sa, starts = sa[:end], starts[starts < end]
        size_of = np.diff(np.append(starts, end))
        many = np.repeat(size_of > 1, size_of)
        if not many.any():
            continue
        sa = sa[many]
        own = owner[np.minimum(sa, len(owner) - 1)]
        groups = size_of[size_of > 1]
        smallest = np.repeat(np.minimum.reduceat(least[own], np.cumsum(groups) - groups), groups)
        gone = (smallest < least[own]) & (sa - first[own] <= n[own] - LENGTH)  # not across the end of a snippet
        where = (sa - first[own])[gone]
        np.minimum.at(low, own[gone], where)
        np.maximum.at(high, own[gone], where + LENGTH)
    return np.where(high > 0, low, 0), high


def resolve(gram: np.ndarray, least: np.ndarray, most: np.ndarray, size: np.ndarray, raw: np.ndarray, under: str | None = None) -> list[np.ndarray]:
    """(hash, second hash, least, low, high) of the snippets of one shard that remove something, by hash."""
    size = size.astype(np.int64)
    starts = np.cumsum(size) - size
    hashes = content(raw, starts, size)
    kind, heads = distinct(list(hashes))
    low_doc, high_doc = np.full(len(heads), np.iinfo(np.int64).max), np.full(len(heads), np.iinfo(np.int64).min)
    np.minimum.at(low_doc, kind, least)
    np.maximum.at(high_doc, kind, most)
    sort = np.flatnonzero(kin(gram[heads].astype(np.int64), starts[heads], size[heads], raw))
    low, high = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
    if len(sort):
        mine = heads[sort]
        space = Space(KEEP, under)
        try:
            low[sort], high[sort] = shared(size[mine], raw[ragged(starts[mine], size[mine])], low_doc[sort], space)
        finally:
            space.close()
    some = np.flatnonzero((high > 0) | (high_doc > low_doc))
    by = some[np.argsort(hashes[0][heads][some], kind="stable")]
    return [hashes[0][heads][by], (hashes[1][heads][by] >> np.uint64(32)).astype(np.uint32), low_doc[by], low[by].astype(np.uint8), high[by].astype(np.uint8)]


def find(docs: DataFrame, out_dir: str, key: str = "doc_id", text: str = "text") -> int:
    """Write what must go of which snippets under ``out_dir``; the number of parts."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    parts = max(12, math.ceil(4 * math.sqrt(total / (1 << 20))))
    repeated(docs, out_dir, parts, key, text)

    @lean
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, blocks in _by_part(batches, ("gram", "least", "most", "size", "bytes"), (np.uint8, np.int64, np.int64, np.uint8, np.uint8)):
            columns = [np.concatenate([x[i] for x in blocks]) for i in range(5)]
            blocks.clear()
            write_arrays(f"{out_dir}/gone-{k:06d}", resolve(*columns, mounted(out_dir)))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32())], ["part"])

    shards = snippets(docs, out_dir, parts, key, text).repartition(parts, "part").sortWithinPartitions("part")
    store(shards.mapInArrow(sort, "part int"), "suffix-parts")
    return parts


def runs_of(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, known: Files, gone: Files, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end): the maximal runs of bytes to remove from the texts."""
    rows, low, high = [], [], []
    for p, _, of, s, size in occurrences(data, offsets, known, parts):
        h, again = content(data, s, size)
        order = np.argsort(p, kind="stable")
        for x, own in _blocks(p[order], parts):
            found = gone.part(x)
            if not found or not len(found[0]):
                continue
            mine = order[own]
            at = np.minimum(np.searchsorted(found[0], h[mine]), len(found[0]) - 1)
            hit = (found[0][at] == h[mine]) & (found[1][at] == (again[mine] >> np.uint64(32)).astype(np.uint32))
            mine, at = mine[hit], at[hit]
            d = ids[of[mine]]
            later = d > found[2][at]
            a, z = np.where(later, 0, found[3][at].astype(np.int64)), np.where(later, size[mine], found[4][at].astype(np.int64))
            some = z > a
            start = s[mine] - offsets[of[mine]]
            rows.append(of[mine][some])
            low.append((start + a)[some])
            high.append((start + z)[some])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return merged(np.concatenate(rows), np.concatenate(low), np.concatenate(high))


def cut(docs: DataFrame, out_dir: str, parts: int, key: str, text: str, digest: bool) -> DataFrame:
    """The rows of ``docs`` without what must go: digests, or all columns with the remaining bytes as text."""
    names = [key] if digest else [c for c in docs.columns if c != text]
    src = docs.select(F.col(key).cast("long").alias("__d"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("__t"), F.col(text).isNull().alias("__none"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)])
    kept = [T.StructField(c, docs.schema[c].dataType) for c in names]
    made = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())] if digest else [T.StructField(text, T.BinaryType())]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gone = Files(out_dir, "anchors"), Files(out_dir, "gone")
        for whole in batches:
            for b in slices(whole, "__t", LOOK):
                data, offsets = buffers(b.column("__t"))
                # a row without id is before all others, so nothing is taken from it
                ids = b.column("__d").fill_null(np.iinfo(np.int64).min).to_numpy()
                row, s, e = runs_of(data, offsets, ids, known, gone, parts)
                has_id = ~b.column("__d").is_null().to_numpy(zero_copy_only=False)
                ok = has_id[row]
                row, s, e = row[ok], s[ok], e[ok]
                edges = np.searchsorted(row, np.arange(len(ids) + 1))
                texts, removed = [], np.zeros(len(ids), np.int64)
                np.add.at(removed, row, e - s)
                for i in range(len(ids)):
                    t = data[offsets[i] : offsets[i + 1]]
                    x, y = edges[i], edges[i + 1]
                    if x == y:
                        texts.append(t)
                    else:
                        bounds = np.concatenate([[0], np.stack([s[x:y], e[x:y]], 1).ravel(), [len(t)]]).tolist()
                        texts.append(b"".join(t[a:z].tobytes() for a, z in zip(bounds[::2], bounds[1::2], strict=True)))
                own = [b.column(f"__{i}") for i in range(len(names))]
                if digest:
                    own += [pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.diff(edges)), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
                else:
                    own.append(pa.array([None if none else bytes(x) for x, none in zip(texts, b.column("__none").to_pylist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(own, [*names, *(f.name for f in made)])

    return src.mapInArrow(run, T.StructType([*kept, *made]))


def report(docs: DataFrame) -> DataFrame:
    out_dir = scratch_path(docs.sparkSession, "suffix")
    return cut(docs, out_dir, find(docs, out_dir), "doc_id", "text", True)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated strings removed from the texts, which become binary: a cut may part a character."""
    out_dir = scratch_path(docs.sparkSession, "suffix")
    return cut(docs, out_dir, find(docs, out_dir, key, text), key, text, False).select(*docs.columns)
