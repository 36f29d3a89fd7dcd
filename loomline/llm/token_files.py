"""Token-id files with a minimal perfect hash index over document keys.

A shard file holds raw little-endian ids (16 bits where the vocabulary allows, else 32) one document
after another, then the index: a cascade of bit arrays in which each key owns one bit of the first
array where it collides with no other; the rank of that bit is the key's slot. For each slot the file
stores a 32-bit fingerprint, the document's offset and its number of ids. A lookup hashes the key,
tests a few bits, compares the fingerprint and reads one range: constant time, with no key stored.

Documents are range-partitioned by key, so shards and their contents are in ascending key order. Every
attempt of a task writes a file of its own and only the file that a finished task names is read, so a
lost executor leaves at most an orphan.

Keys are (doc_id, occurrence): rows that repeat a doc_id are kept, told apart by their order in the
shard. Null text is empty and yields the end id alone; a null doc_id sorts first. An empty table gives
no files and no rows. Other columns take no part.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, scratch_path, small, store
from .files import open_fs
from .langid import buffers, slices

MAGIC = 0x4C4F4F4D494453
EMPTY_KEY = -(1 << 63)


def mix(a: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer over uint64."""
    with np.errstate(over="ignore"):
        a = (a ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        a = (a ^ (a >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return a ^ (a >> np.uint64(29))


def spread(ids: np.ndarray, nth: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(ids.astype(np.int64).view(np.uint64) + mix(nth.astype(np.uint64), seed + 1), seed)


class PerfectHash:
    """Minimal perfect hash over distinct (id, occurrence) keys, with fingerprints."""

    GAMMA = 2

    def __init__(self, levels: list[np.ndarray], prints: np.ndarray):
        self.levels, self.prints = levels, prints
        ones = [np.concatenate([[0], np.cumsum(x)]) for x in levels]
        self.base = np.concatenate([[0], np.cumsum([x[-1] for x in ones])]).astype(np.int64)
        self.rank = ones

    @classmethod
    def build(cls, ids: np.ndarray, nth: np.ndarray) -> PerfectHash:
        levels, left = [], np.arange(len(ids))
        while len(left):
            size = cls.GAMMA * len(left) + 1
            at = (spread(ids[left], nth[left], 16 + len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        out = cls(levels, np.zeros(len(ids), np.uint32))
        slot = out.slots(ids, nth, check=False)
        out.prints[slot] = cls.fingerprint(ids, nth)
        return out

    @staticmethod
    def fingerprint(ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
        return (spread(ids, nth, 3) >> np.uint64(32)).astype(np.uint32)

    def slots(self, ids: np.ndarray, nth: np.ndarray, check: bool = True) -> np.ndarray:
        """The slot of each key; -1 for what the fingerprints show not to be a key."""
        out, left = np.full(len(ids), -1, np.int64), np.arange(len(ids))
        for k, bits in enumerate(self.levels):
            if not len(left):
                break
            at = (spread(ids[left], nth[left], 16 + k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.base[k] + self.rank[k][at[hit]]
            left = left[~hit]
        if check and len(out):
            known = out >= 0
            known[known] = self.prints[out[known]] == self.fingerprint(ids[known], nth[known])
            out[~known] = -1
        return out


class Encoder:
    """Ids of whole texts, equal to the tokenizers library's on every text.

    A byte-level BPE without a normalizer cuts a text into pieces and encodes each by itself, so each
    distinct piece is encoded by the library once and remembered. Texts of printable ASCII, tab, line ends and the letters
    from U+00C0 to U+017F (on which all regex engines agree) are cut here, a whole batch of them at once; the
    library encodes any other text, and any that spells an added token, whole.

    Known pieces lie in an open hash table. A piece of up to 8 bytes is its own key; a longer one is compared
    by a 64-bit hash, its first 8 bytes and its length.
    """

    MOST, SLOTS, LONGEST = 800_000, 21, 256
    #: Kinds of bytes: 1 letter, 2 digit, 3 blank, 4 other white space, 5 the rest, 0 not cut here.
    KIND = np.zeros(256, np.uint8)
    KIND[0x21:0x7F] = 5
    KIND[[ord("\t"), ord("\n"), ord("\r")]] = 4
    KIND[ord(" ")] = 3
    KIND[ord("0") : ord("9") + 1] = 2
    for _a, _b in ((ord("A"), ord("Z")), (ord("a"), ord("z")), (0x80, 0xBF), (0xC3, 0xC5)):
        KIND[_a : _b + 1] = 1
    MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.clear()

    def clear(self) -> None:
        self.slots, self.at, self.known = np.zeros(1 << self.SLOTS, np.uint64), np.zeros(1 << self.SLOTS, np.int32), 0
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.start, self.size, self.head, self.length = (np.zeros(1 << 16, t) for t in (np.int64, np.int64, np.uint64, np.int64))

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def _keep(self, flat: np.ndarray, sizes: np.ndarray, head: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Numbers of new pieces with these ids, sizes, first bytes and lengths."""
        to, n = self.used + len(flat), self.known + len(sizes)
        while to > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.start):
            self.start, self.size, self.head, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.size, self.head, self.length))
        self.flat[self.used : to] = flat
        own = slice(self.known, n)
        self.start[own], self.size[own], self.head[own], self.length[own] = self.used + np.cumsum(sizes) - sizes, sizes, head, length
        self.used, self.known = to, n
        return np.arange(own.start, n)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """The number of the piece of each key, -1 where it isn't known."""
        out, todo, mask = np.full(len(key), -1, np.int64), np.arange(len(key)), (1 << self.SLOTS) - 1
        pos = (key >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        while len(todo):
            there = self.slots[pos]
            hit = there == key[todo]
            out[todo[hit]] = self.at[pos[hit]]
            on = ~hit & (there != 0)
            todo, pos = todo[on], pos[on] + 1 & mask
        return out

    def _insert(self, key: np.ndarray, number: np.ndarray) -> None:
        pos, mask = (key >> np.uint64(64 - self.SLOTS)).astype(np.int64), (1 << self.SLOTS) - 1
        while len(key):
            free = np.flatnonzero(self.slots[pos] == 0)
            _, first = np.unique(pos[free], return_index=True)
            own = free[first]
            self.slots[pos[own]], self.at[pos[own]] = key[own], number[own]
            left = np.ones(len(key), bool)
            left[own] = False
            key, number, pos = key[left], number[left], pos[left]
            pos = np.where(self.slots[pos] == 0, pos, pos + 1 & mask)

    @classmethod
    def cuts(cls, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pieces of the texts begin.

        Words, numbers and runs of other signs take one blank before them along; of longer white space the last character
        is parted from the others; after an apostrophe that begins a piece s, t, m, d, re, ve and ll end it.
        """
        n, kind = len(data), cls.KIND[data]
        sign = np.flatnonzero(data[:-1] == 0xC3) if n > 1 else np.zeros(0, np.int64)
        sign = sign[(data[sign + 1] == 0x97) | (data[sign + 1] == 0xB7)]  # the signs for times and divided by
        kind[sign] = kind[sign + 1] = 5
        white, blank = (kind == 3) | (kind == 4), kind == 3
        kind[white] = 3
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start = edge[:n].copy()
        inner = ~edge[1:n]
        start[1:] |= inner & (kind[1:] != kind[:-1]) & ~(blank[:-1] & ~white[1:])
        start[:-1] |= inner & white[:-1] & ~white[1:]
        at = np.flatnonzero(start & (data == ord("'")))
        if len(at):
            end = offsets[np.searchsorted(offsets, at, "right")]
            one, two = (np.where(at + k < end, data[np.minimum(at + k, n - 1)], 0) for k in (1, 2))
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            start[at[short | long] + 1] = False
            for some, k in ((short, 2), (long, 3)):
                after = at[some] + k
                start[after[after < end[some]]] = True
        return np.flatnonzero(start)

    def _plain(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts of bytes that have a kind, ``end`` after each, and the number of ids of each."""
        s = self.cuts(data, offsets)
        e = np.append(s[1:], len(data))
        size = e - s
        words = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(16, np.uint8)]), strides=(1,))
        head = words[s] & self.MASK[np.minimum(size, 8)]
        key = mix(head, 61)
        more, k = np.flatnonzero((size > 8) & (size <= self.LONGEST)), 8
        while len(more):
            with np.errstate(over="ignore"):
                key[more] = mix(key[more] * np.uint64(0x9E3779B97F4A7C15) + (words[s[more] + k] & self.MASK[np.minimum(size[more] - k, 8)]), 62)
            k += 8
            more = more[size[more] > k]
        key[key == 0] = 1
        if self.known > self.MOST:
            self.clear()
        number = self._find(key)
        known = np.flatnonzero(number >= 0)
        clash = known[(self.head[number[known]] != head[known]) | (self.length[number[known]] != size[known])]
        number[clash] = -2
        number[size > self.LONGEST] = -2
        new = np.flatnonzero(number == -1)
        if len(new):
            keys, first, of = np.unique(key[new], return_index=True, return_inverse=True)
            own = new[first]
            alike = (head[new] == head[own][of]) & (size[new] == size[own][of])
            raw = data.tobytes()
            made = self._keep(*self._ids([raw[a:b].decode() for a, b in zip(s[own].tolist(), e[own].tolist(), strict=True)]), head[own], size[own])
            self._insert(keys, made)
            number[new] = np.where(alike, made[of], -2)
        odd = np.flatnonzero(number == -2)
        if len(odd):  # pieces too long to keep, or whose key is another's
            number[odd] = self._keep(*self._ids([data[a:b].tobytes().decode() for a, b in zip(s[odd].tolist(), e[odd].tolist(), strict=True)]), head[odd], np.int64(0))
        n, of = self.size[number], np.searchsorted(offsets, s, "right") - 1
        counts = np.bincount(of, n, len(offsets) - 1).astype(np.int64) + 1
        to = np.cumsum(n)
        total = int(to[-1]) if len(to) else 0
        out = np.full(total + len(counts), end, np.uint32)
        shift = np.repeat(of, n)
        out[np.arange(total) + shift] = self.flat[np.repeat(self.start[number] - to + n, n) + np.arange(total)]
        return out, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts that lie in ``data`` between ``offsets``, ``end`` after each, and the number of ids of each text."""
        odd = np.concatenate([[0], np.cumsum(self.KIND[data] == 0)])
        whole = odd[offsets[1:]] > odd[offsets[:-1]]
        raw = data.tobytes()
        for x in self.special:
            at = raw.find(x)
            while at >= 0:
                whole[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(x, at + 1)
        if not whole.any():
            return self._plain(data, offsets, end)
        some = np.flatnonzero(~whole)
        size = np.diff(offsets)
        inside = np.repeat(~whole, size)
        ids, counts = self._plain(data[inside], np.concatenate([[0], np.cumsum(size[some])]), end)
        texts = [raw[offsets[i] : offsets[i + 1]].decode() for i in np.flatnonzero(whole).tolist()]
        rest, n = self._ids(texts)
        parts = [np.append(x, np.uint32(end)) for x in np.split(rest, np.cumsum(n)[:-1])]
        flat, all_counts = np.concatenate([ids, *parts]), np.zeros(len(size), np.int64)
        all_counts[some], all_counts[whole] = counts, n + 1
        starts = np.zeros(len(size), np.int64)
        starts[some] = np.cumsum(counts) - counts
        starts[whole] = len(ids) + np.cumsum(n + 1) - (n + 1)
        to = np.cumsum(all_counts)
        return flat[np.repeat(starts - to + all_counts, all_counts) + np.arange(int(to[-1]))], all_counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack_shard(hashes: PerfectHash, starts: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The arrays of the index of a shard file."""
    sizes = np.array([len(x) for x in hashes.levels], np.int64)
    bits = np.packbits(np.concatenate(hashes.levels) if hashes.levels else np.zeros(0, bool), bitorder="little")
    return [sizes, bits, hashes.prints, starts.astype(np.int64), counts.astype(np.uint32)]


def write(docs: DataFrame, out_dir: str, tokenizer: str, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shard files under ``out_dir``; returns (shard, path, doc_id, nth, shard_tokens), a stored table with a row for each document."""
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    src = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "t")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, stream, enc = TaskContext.get().partitionId(), None, encoder(tokenizer)
        keys, counts = [], []
        dtype = np.dtype(f"<u{enc.width}")
        uri = f"{out_dir}/shard-{shard:06d}-{uuid.uuid4().hex[:12]}.ids"
        for whole in batches:
            for b in slices(whole, "t"):
                if stream is None:
                    disk, path = open_fs(uri)
                    disk.create_dir(path.rpartition("/")[0], recursive=True)
                    stream = disk.open_output_stream(path)
                data, offsets = buffers(b.column("t"))
                ids, n = enc.encode(data, offsets, end)
                stream.write(ids.astype(dtype).tobytes())
                keys.append(b.column("doc_id").fill_null(EMPTY_KEY).to_numpy())
                counts.append(n)
        if stream is None:
            return
        ids, n = np.concatenate(keys), np.concatenate(counts)
        first = np.maximum.accumulate(np.where(np.concatenate([[True], ids[1:] != ids[:-1]]), np.arange(len(ids)), 0))
        nth, starts = np.arange(len(ids)) - first, np.cumsum(n) - n
        hashes = PerfectHash.build(ids, nth)
        slot = hashes.slots(ids, nth)
        by_slot = np.empty(len(ids), np.int64)
        by_slot[slot] = np.arange(len(ids))
        arrays = pack_shard(hashes, starts[by_slot], n[by_slot])
        for a in arrays:
            stream.write(a.tobytes())
        stream.write(np.array([MAGIC, enc.width, int(n.sum()), *(a.nbytes for a in arrays)], "<i8").tobytes())
        stream.close()
        for at in range(0, len(ids), 10_000):
            own = slice(at, at + 10_000)
            m = len(ids[own])
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * m, pa.int32()), pa.array([uri] * m), pa.array(ids[own], mask=ids[own] == EMPTY_KEY), pa.array(nth[own]), pa.array([int(n.sum())] * m, pa.int64())],
                ["shard", "path", "doc_id", "nth", "shard_tokens"])

    return store(src.mapInArrow(run, "shard int, path string, doc_id long, nth long, shard_tokens long"), "token-keys")


class ShardFile:
    """Keyed access to the documents of one shard file."""

    FOOTER = 8 * 8

    def __init__(self, uri: str):
        disk, path = open_fs(uri)
        self.file = disk.open_input_file(path)
        size = self.file.size()
        magic, self.width, self.n_tokens, *sizes = np.frombuffer(self.file.read_at(self.FOOTER, size - self.FOOTER), "<i8").tolist()
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        blob, at, parts = self.file.read_at(sum(sizes), size - self.FOOTER - sum(sizes)), 0, []
        for n, dtype in zip(sizes, ("<i8", "u1", "<u4", "<i8", "<u4"), strict=True):
            parts.append(np.frombuffer(blob[at : at + n], dtype))
            at += n
        levels, bits, prints, self.starts, self.counts = parts
        flat = np.unpackbits(bits, bitorder="little")[: int(levels.sum())].astype(bool)
        self.hashes = PerfectHash(np.split(flat, np.cumsum(levels)[:-1]) if len(levels) else [], prints)

    def find(self, ids: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of ids of each key in this shard; -1 and 0 where it has none."""
        slot = self.hashes.slots(ids, nth)
        known = slot >= 0
        return np.where(known, self.starts[slot] if len(self.starts) else -1, -1), np.where(known, self.counts[slot] if len(self.counts) else 0, 0).astype(np.int64)

    def ids(self, start: int, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(n * self.width, start * self.width), f"<u{self.width}").astype("<u4")


def read(keys: DataFrame) -> DataFrame:
    """(shard, doc_id, offset, n_tokens, ids_crc32) of keys (shard, path, doc_id, nth), each looked up in its shard file."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file = None, None
        for b in batches:
            paths = b.column("path").to_pylist()
            at = 0
            while at < len(paths):
                to = at + 1
                while to < len(paths) and paths[to] == paths[at]:
                    to += 1
                if paths[at] != uri:
                    uri = paths[at]
                    file = ShardFile(uri)
                own = b.slice(at, to - at)
                start, n = file.find(own.column("doc_id").fill_null(EMPTY_KEY).to_numpy(), own.column("nth").to_numpy())
                crc = [zlib.crc32(file.ids(s, k).tobytes()) for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own.column("shard"), own.column("doc_id"), pa.array(start), pa.array(n), pa.array(crc, pa.int64())], ["shard", "doc_id", "offset", "n_tokens", "ids_crc32"])
                at = to

    return keys.select("shard", "path", "doc_id", "nth").mapInArrow(run, "shard int, doc_id long, offset long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    keys = write(docs, scratch_path(docs.sparkSession, "token-files"), tokenizer)
    shards = keys.groupBy("shard").agg(F.max("shard_tokens").alias("n")).orderBy("shard").collect()  # a row for each file
    base, rows = 0, []
    for s, n in shards:
        rows.append((s, base))
        base += n
    bases = docs.sparkSession.createDataFrame(rows, "shard int, base long")
    return read(keys).join(small(bases, 1_000_000), "shard").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
