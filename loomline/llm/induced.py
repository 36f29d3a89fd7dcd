"""External induced sorting of suffixes, with common prefixes.

A suffix is S-type where it is smaller than the next one, else L-type; S*-suffixes are S-type after an
L-type. S*-substrings are sorted by inducing, named, and the string of names is sorted by the same
procedure (recursion) where names repeat; the order of S*-suffixes induces that of L-suffixes, and that
the order of S-suffixes.

Inducing takes suffix tuples from a disk-backed priority queue in ascending order of their key, (first character, rank of
the following suffix), ranks them and pushes the tuples of the suffixes before them. The queue hands out
as many tuples at once as surely come before all that they push, which is told from the keys. A tuple also carries
the common prefix of its suffix and the one pushed before it with the same first character: one more than the least of
the common prefixes ranked between the suffixes that follow the two, which is kept for each character as
ranks are given. Those of neighbours of different type or of seeds are compared directly. Values are cut to a byte.

The text, its orders, common prefixes, names and the queue's sorted runs lie in files of a task's temporary
folder beyond a bound; they are never read by another task, and the folder is deleted in the end. Batches are
bounded, so a string may be far larger than memory. What stays in memory is a byte and a few numbers for each
character of the alphabet.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

MOST_PREFIX = 255


class Space:
    """Arrays that lie in memory up to ``most`` bytes each and in files of a temporary folder beyond, made in the folder ``under``.

    Files are mapped and taken out of the folder at once, so what is no longer used takes no room, even after a crash.
    """

    def __init__(self, most: int, under: str | None = None):
        self.most, self.under, self.folder, self.n = most, under, None, 0

    def file(self) -> str:
        if self.folder is None:
            self.folder = tempfile.mkdtemp(prefix="induced-", dir=self.under)
        self.n += 1
        return os.path.join(self.folder, str(self.n))

    def array(self, n: int, dtype: str, beyond: bool = False) -> np.ndarray:
        if not beyond and n * np.dtype(dtype).itemsize <= self.most:
            return np.empty(n, dtype)
        path = self.file()
        out = np.memmap(path, dtype, "w+", shape=(n,))
        os.remove(path)  # its blocks are freed with the array
        return out

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


class PriorityQueue:
    """Tuples of a key, which is distinct, a position and a common prefix, in ascending order of their keys.

    What is pushed is held as sorted runs of growing length; beyond a bound all of them are merged to one run
    on disk. ``peek`` merges the heads of the runs, ``drop`` moves past what was taken. Positions and common prefixes
    are packed to one number.
    """

    def __init__(self, space: Space):
        self.space, self.runs, self.files, self.held = space, [], [], 0

    def push(self, key: np.ndarray, pos: np.ndarray, low: np.ndarray) -> None:
        if not len(key):
            return
        by = np.argsort(key)
        self.runs.append([key[by], (pos.astype(np.uint64) << np.uint64(8) | low.astype(np.uint64))[by], 0])
        self.held += len(key)
        while len(self.runs) > 1 and 2 * self._left(self.runs[-1]) > self._left(self.runs[-2]):
            self.runs[-2:] = [self._merge(self.runs[-2:])]
        if 16 * self.held > 2 * self.space.most:
            whole = self._merge(self.runs)
            self.held = len(whole[0])
            self.runs = [whole]
            if 16 * self.held > self.space.most:
                for i in (0, 1):
                    kept = self.space.array(len(whole[i]), "<u8", True)
                    kept[:] = whole[i]
                    whole[i] = kept
                self.files.append(whole)
                self.runs, self.held = [], 0

    @staticmethod
    def _left(run: list) -> int:
        return len(run[0]) - run[2]

    @staticmethod
    def _merge(runs: list) -> list:
        key, value = (np.concatenate([r[i][r[2] :] for r in runs]) for i in (0, 1))
        by = np.argsort(key, kind="stable")
        return [key[by], value[by], 0]

    def peek(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and packed values of the n smallest tuples, or of all."""
        heads = [(r[0][r[2] : r[2] + n], r[1][r[2] : r[2] + n]) for r in (*self.files, *self.runs)]
        if not heads:
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        if len(heads) == 1:
            return heads[0]
        key, value = (np.concatenate([x[i] for x in heads]) for i in (0, 1))
        by = np.argsort(key, kind="stable")[:n]
        return key[by], value[by]

    def drop(self, last: int) -> None:
        """Move past all tuples of a key up to ``last``."""
        gone = False
        for r in (*self.files, *self.runs):
            if r[0][r[2]] <= last:
                r[2] += int(r[0][r[2] :].searchsorted(np.uint64(last), "right"))
                gone |= r[2] == len(r[0])
        if gone:
            self.files, self.runs = ([r for r in runs if self._left(r)] for runs in (self.files, self.runs))


def agreement(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many characters, up to ``most``, the suffixes at a and at b share."""
    out, left, last = np.zeros(len(a), np.uint8), np.arange(len(a)), len(text) - 1
    for k in range(most):
        x, y = a[left] + k, b[left] + k
        left = left[(x < last) & (y < last) & (text[np.minimum(x, last)] == text[np.minimum(y, last)])]
        if not len(left):
            break
        out[left] = k + 1
    return out


def range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first .. last] for each pair."""
    table = [values]
    while 2 << len(table) - 1 <= len(values):
        half = 1 << len(table) - 1
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    size = last - first + 1
    level = np.frexp(size.astype("f8"))[1] - 1
    out = np.empty(len(first), values.dtype)
    for k in np.unique(level).tolist():
        own = level == k
        out[own] = np.minimum(table[k][first[own]], table[k][last[own] - (1 << k) + 1])
    return out


def induce(text: np.ndarray, seeds: np.ndarray, near: np.ndarray | None, up: bool, space: Space, batch: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes induced by ``seeds``, in the order of induction, and their common prefixes with the one before.

    ``up``: L-suffixes in ascending order from S*-suffixes, else S-suffixes in descending order from all L-suffixes.
    near: the common prefix of each seed with the seed before; None where common prefixes are not wanted.
    """
    top = int(text.max()) if len(text) else 0
    kind = "<i4" if len(text) < 1 << 31 else "<i8"
    order, common, filled = space.array(len(text), kind), space.array(len(text) if near is not None else 0, "u1"), 0
    queue = PriorityQueue(space)
    rank_of_char = (lambda c: c.astype(np.uint64)) if up else (lambda c: np.uint64(top) - c.astype(np.uint64))
    pending = np.full(top + 1, most, np.uint8)  # least common prefix since the last push, for each character
    at = rank = 0
    size, before, before_seed, before_char = 1024, -1, False, -1
    while True:
        got, packed = queue.peek(size)
        # seeds are taken along from their own sorted list; those of a character come after what it induced
        own = np.asarray(seeds[at : at + size])
        seed_key = (rank_of_char(text[own]) << np.uint64(33)) | np.uint64(1 << 32) | np.arange(at, at + len(own), dtype=np.uint64)
        key = np.concatenate([got, seed_key])
        if not len(key):
            break
        take = np.argsort(key, kind="stable")
        # beyond the end of either list nothing is known yet
        limit = min(int(x[-1]) for x in (got, seed_key) if len(x) == size) if size in (len(got), len(own)) else None
        if limit is not None:
            take = take[key[take] <= np.uint64(limit)]
        key = key[take]
        pos = np.concatenate([(packed >> np.uint64(8)).astype(np.int64), own])[take]
        is_seed = take >= len(got)
        low = np.concatenate([packed.astype(np.uint8), near[at : at + len(own)]])[take] if near is not None else None
        char = key >> np.uint64(33)
        prior = np.maximum(pos - 1, 0)
        prior_char = rank_of_char(text[prior])
        pushes = (pos > 0) & ((prior_char > char) | (prior_char == char) & ~is_seed)
        made = np.where(pushes, prior_char << np.uint64(33) | np.arange(rank, rank + len(pos), dtype=np.uint64), np.uint64((1 << 64) - 1))
        late = np.flatnonzero(key[1:] > np.minimum.accumulate(made)[:-1])
        m = int(late[0]) + 1 if len(late) else len(key)
        size = min(2 * size, batch) if m == len(key) else max(64, min(2 * m, batch))
        key, pos, is_seed, char, made, pushes, prior, prior_char = (x[:m] for x in (key, pos, is_seed, char, made, pushes, prior, prior_char))
        low = low[:m] if low is not None else None
        queue.drop(int(key[-1]))
        at += int(is_seed.sum())
        src = np.flatnonzero(pushes)
        carried = np.zeros(len(src), np.uint8)
        if near is not None:
            last_pos, last_seed = np.concatenate([[before], pos[:-1]]), np.concatenate([[before_seed], is_seed[:-1]])
            same = char == np.concatenate([[before_char], char[:-1].astype(np.int64)]).astype(np.uint64) if before_char >= 0 else np.concatenate([[False], char[1:] == char[:-1]])
            lcp = np.where(same, np.where(is_seed, low, np.minimum(low.astype(np.int64) + 1, most)), 0).astype(np.uint8)
            turn = np.flatnonzero(same & is_seed & ~last_seed)
            if len(turn):
                lcp[turn] = agreement(text, last_pos[turn], pos[turn], most)
            if len(src):
                by = np.argsort(prior_char[src], kind="stable")
                s, c = src[by], prior_char[src][by].astype(np.int64)
                first = np.concatenate([[True], c[1:] != c[:-1]])
                values = np.empty(len(s), np.uint8)
                values[first] = np.minimum(pending[c[first]], np.minimum.accumulate(lcp)[s[first]])
                rest = np.flatnonzero(~first)
                if len(rest):
                    values[rest] = range_min(lcp, s[rest - 1] + 1, s[rest])
                carried[by] = values
                ends = np.concatenate([first[1:], [True]])
                after = np.concatenate([np.minimum.accumulate(lcp[::-1])[::-1], [most]])
                np.minimum(pending, lcp.min(), out=pending)
                pending[c[ends]] = np.minimum(after[s[ends] + 1], most)
            else:
                np.minimum(pending, lcp.min(), out=pending)
            common[filled : filled + m - int(is_seed.sum())] = lcp[~is_seed]
        queue.push(made[src], prior[src], carried)
        mine = pos[~is_seed]
        order[filled : filled + len(mine)] = mine
        filled += len(mine)
        rank += m
        before, before_seed, before_char = int(pos[-1]), bool(is_seed[-1]), int(char[-1])
    return order[:filled], common[:filled]


def types(text: np.ndarray, space: Space) -> np.ndarray:
    """Which suffixes are S-type; the last is."""
    n = len(text)
    out = space.array(n, "?")
    out[n - 1], step, falls = True, 1 << 17, True
    for e in range(n - 1, 0, -step):  # backwards, piece by piece
        s = max(0, e - step)
        x, y = np.asarray(text[s:e]), np.asarray(text[s + 1 : e + 1])
        change = np.append(np.flatnonzero(x != y), e - s)
        kinds = np.append(x[change[:-1]] < y[change[:-1]], falls)
        own = kinds[np.searchsorted(change, np.arange(e - s))]
        out[s:e] = own
        falls = bool(own[0])
    return out


def _pieces(n: int, step: int = 1 << 16) -> Iterator[slice]:
    for s in range(0, n, step):
        yield slice(s, min(n, s + step))


def _select(values: np.ndarray, keep, space: Space) -> np.ndarray:
    """The values for which ``keep`` of a piece of them holds, in order."""
    count = sum(int(keep(np.asarray(values[own])).sum()) for own in _pieces(len(values)))
    out, at = space.array(count, values.dtype.str), 0
    for own in _pieces(len(values)):
        x = np.asarray(values[own])
        x = x[keep(x)]
        out[at : at + len(x)] = x
        at += len(x)
    return out


def _ordered_stars(text: np.ndarray, s_type: np.ndarray, space: Space, batch: int, base: int) -> np.ndarray:
    """The S*-suffixes in ascending order."""
    n = len(text)
    kind = "<i4" if n < 1 << 31 else "<i8"
    is_star = space.array(n, "?")
    is_star[0] = False
    for own in _pieces(n - 1):
        is_star[own.start + 1 : own.stop + 1] = s_type[own.start + 1 : own.stop + 1] & ~s_type[own]
    star = space.array(sum(int(is_star[own].sum()) for own in _pieces(n)), kind)
    count, at = np.zeros(int(text.max()) + 2, np.int64), 0
    for own in _pieces(n):
        x = np.flatnonzero(is_star[own]) + own.start
        star[at : at + len(x)] = x
        at += len(x)
        count[1:] += np.bincount(text[x], minlength=len(count) - 1)
    order, to = space.array(len(star), kind), np.cumsum(count)  # first by the first character
    for own in _pieces(len(star)):
        x = np.asarray(star[own])
        c = text[x]
        by = np.argsort(c, kind="stable")
        x, c = x[by], c[by]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.append(first, len(c)))
        order[to[c] + np.arange(len(c)) - np.repeat(first, size)] = x
        to[c[first]] += size
    if len(star) == 1:
        return order
    large, _ = induce(text, order, None, True, space, batch, 0)
    small, _ = induce(text, large[::-1], None, False, space, batch, 0)
    # S*-substrings in order; the end, which nothing induces, is the least
    order[0] = n - 1
    order[1:] = _select(small[::-1], lambda p: is_star[p], space)
    length = space.array(n, kind)  # of the substring that begins at a star
    for own in _pieces(len(star)):
        x = np.asarray(star[own.start : own.stop + 1])
        length[x[: own.stop - own.start]] = np.diff(np.append(x, n - 1))[: own.stop - own.start] + 1
    names, level = space.array(n, kind), 0
    names[order[0]] = 0
    for own in _pieces(len(order) - 1):
        a, b = np.asarray(order[own]).astype(np.int64), np.asarray(order[own.start + 1 : own.stop + 1]).astype(np.int64)
        same = length[a] == length[b]
        left, k = np.flatnonzero(same), 0
        while len(left):
            x, y = a[left] + k, b[left] + k
            differs = text[np.minimum(x, n - 1)] != text[np.minimum(y, n - 1)]
            same[left[differs]] = False
            k += 1
            left = left[~differs & (length[a[left]] > k)]
        number = level + np.cumsum(~same)
        names[b] = number
        level = int(number[-1])
    if level + 1 < len(order):  # some names repeat: the string of names decides
        short = space.array(len(star), kind)
        for own in _pieces(len(star)):
            short[own] = names[star[own]]
        inner, _ = suffix_array(short, batch, space, base=base)
        for own in _pieces(len(star)):
            order[own] = star[inner[own]]
    return order


#: Strings of names up to so long are sorted in memory.
BASE = 1 << 19


def _doubled(text: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a short string by prefix doubling."""
    _, rank = np.unique(text, return_inverse=True)
    k = 1
    while True:
        key = (rank.astype(np.int64) << 32) + np.concatenate([rank[k:] + 1, np.zeros(min(k, len(rank)), rank.dtype)])
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
        if rank[order[-1]] == len(key) - 1:
            return order
        k *= 2


def suffix_array(text: np.ndarray, batch: int = 1 << 16, space: Space | None = None, most: int = 0, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): positions of all suffixes in ascending order and, up to ``most``, the common prefix of each with the one before.

    ``text`` is of integers and ends with 0, its only 0. Without ``most`` there are no common prefixes.
    """
    own = space or Space(1 << 24)
    most = min(most, MOST_PREFIX)
    try:
        n = len(text)
        if n == 1:
            return np.zeros(1, np.int64), np.zeros(1 if most else 0, np.uint8)
        if not most and n <= base:
            return _doubled(np.asarray(text)), np.zeros(0, np.uint8)
        s_type = types(text, own)
        stars = _ordered_stars(text, s_type, own, batch, base)
        near = None
        if most:
            near = own.array(len(stars), "u1")
            near[0] = 0
            for k in _pieces(len(stars) - 1):
                near[k.start + 1 : k.stop + 1] = agreement(text, np.asarray(stars[k]).astype(np.int64), np.asarray(stars[k.start + 1 : k.stop + 1]).astype(np.int64), most)
        large, large_common = induce(text, stars, near, True, own, batch, most)
        # downwards, the common prefix of a suffix with the one before it is that of its successor upwards
        turned = own.array(len(large), "u1") if most else None
        if most:
            turned[:1] = 0
            turned[1:] = large_common[:0:-1]
        small, small_common = induce(text, large[::-1], turned, False, own, batch, most)
        out, common = own.array(n, large.dtype.str), own.array(n if most else 0, "u1")
        out[0] = n - 1  # the end, which nothing induces, is the least
        if most:
            common[0] = 0
        top = int(text.max())  # merge by first character, L-suffixes first
        in_large, in_small = np.zeros(top + 1, np.int64), np.zeros(top + 1, np.int64)
        for part, count in ((large, in_large), (small, in_small)):
            for k in _pieces(len(part)):
                count += np.bincount(text[part[k]], minlength=top + 1)
        begin = 1 + np.cumsum(in_large + in_small) - in_large - in_small  # of each character in the result
        shift = begin - (np.cumsum(in_large) - in_large)
        for k in _pieces(len(large)):
            to = shift[text[large[k]]] + np.arange(k.start, k.stop)
            out[to] = large[k]
            if most:
                common[to] = large_common[k]
        shift = begin + in_large - (np.cumsum(in_small) - in_small)
        for k in _pieces(len(small)):  # these stand the other way round
            own = small[len(small) - k.stop : len(small) - k.start][::-1]
            to = shift[text[own]] + np.arange(k.start, k.stop)
            out[to] = own
            if most:
                near_next = np.asarray(small_common[len(small) - k.stop + 1 : len(small) - k.start + 1])
                common[to] = np.append(near_next, [0] * (len(to) - len(near_next)))[::-1]
        if most:
            heads = np.flatnonzero(in_small)
            first = (begin + in_large)[heads]
            both = in_large[heads] > 0
            common[first] = 0
            common[first[both]] = agreement(text, np.asarray(out[first[both] - 1]).astype(np.int64), np.asarray(out[first[both]]).astype(np.int64), most)
            common[begin[np.flatnonzero(in_large)]] = 0
        return out, common
    finally:
        if space is None:
            own.close()
