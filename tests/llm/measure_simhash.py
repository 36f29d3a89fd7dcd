"""How far apart similar lines lie in SimHash, by kind of features; prints one row a radius. Run: python -m tests.llm.measure_simhash DIR.

All pairs of distinct normalised lines of up to 600 characters are compared. Blocks are the radius plus one, as pigeonhole needs;
``met`` counts the pairs, per line, that share a block.
"""

import itertools
import re
import sys
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq


def features(line, kind):
    if kind == "words":
        w = line.split(" ")
        return [f"{a} {b}" for a, b in itertools.pairwise(w)] or w
    return [line[i : i + 4] for i in range(max(1, len(line) - 3))]


def simhash(line, kind):
    hs = np.array([zlib.crc32(x.encode()) | zlib.crc32(b"\1" + x.encode()) << 32 for x in set(features(line, kind))], np.uint64)
    bits = (hs[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    return int(sum(1 << int(i) for i in np.flatnonzero(bits.sum(0) * 2 > len(hs))))


def main():
    texts = pq.read_table(f"{sys.argv[1]}/documents.parquet", columns=["text"])["text"].to_pylist()
    split = (re.sub(r"[^\w\n]+|_+", " ", t.lower()).split("\n") for t in texts if t)
    lines = sorted({x.strip() for t in split for x in t} - {""})
    lines = [x for x in lines if len(x) <= 600]
    n = np.array([len(x) for x in lines])
    marks = sorted({c for x in lines for c in x})
    bag = np.array([[x.count(c) for c in marks] for x in lines], np.int16)
    a, b = [], []
    for i in range(len(lines)):  # letters that differ bound the edit distance from below
        most = 0.2 * np.maximum(n[i], n[i + 1 :])
        gap = bag[i + 1 :] - bag[i]
        j = np.flatnonzero(np.maximum(np.where(gap > 0, gap, 0).sum(1), np.where(gap < 0, -gap, 0).sum(1)) <= most + 1e-9)
        a += [i] * len(j)
        b += (j + i + 1).tolist()
    near = duckdb.sql("select unnest($1) as a, unnest($2) as b", params=[a, b]).df()  # noqa: F841
    own = duckdb.sql("select unnest($1) as i, unnest($2) as t", params=[list(range(len(lines))), lines]).df()  # noqa: F841
    links = duckdb.sql("select a, b, 1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t)) as s from near join own x on x.i = a join own y on y.i = b").df()
    links = links[links.s >= 0.8]
    low = links[links.s < 0.9]
    print(f"{len(lines)} lines, {len(links)} similar pairs, {len(low)} of 0.8 to 0.9")
    for kind in ("words", "characters"):
        code = np.array([simhash(x, kind) for x in lines], np.uint64)
        apart = lambda t: np.array([(int(code[x]) ^ int(code[y])).bit_count() for x, y in zip(t.a, t.b, strict=True)])  # noqa: E731, B023
        for radius in (3, 7, 11, 15):
            edges = np.linspace(0, 64, radius + 2).astype(int)
            met = 0
            for lo, hi in itertools.pairwise(edges):
                _, c = np.unique(code >> np.uint64(lo) & np.uint64((1 << int(hi - lo)) - 1), return_counts=True)
                met += int((c * (c - 1) // 2).sum())
            print(f"{kind}, radius {radius}, {radius + 1} blocks: {(apart(links) <= radius).sum()} of {len(links)} similar pairs, {(apart(low) <= radius).sum()} of {len(low)} of 0.8 to 0.9; met {met / len(lines):.0f} a line, of {len(lines) // 2}")


if __name__ == "__main__":
    main()
