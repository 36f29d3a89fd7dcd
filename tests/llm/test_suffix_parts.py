"""How much op6 looks up and sorts, and that nothing that repeats is left out of it."""

import numpy as np

from loomline.llm import suffix_dedup

rng = np.random.default_rng(8)
LETTERS = np.frombuffer(b"abcdefghij ", np.uint8)


def snippets_of(texts):
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    h, s, e, of, at = (x for x in next(suffix_dedup.stretches(data, offsets)))
    found = {}
    for i in range(len(h)):
        found.setdefault(bytes(data[s[i] : e[i]]), (at[i] - s[i], of[i]))
    raw = list(found)
    size = np.array([len(x) for x in raw])
    return raw, np.array([g for g, _ in found.values()]), np.array([d for _, d in found.values()]), size, np.cumsum(size) - size


def test_only_what_can_repeat_is_sorted(monkeypatch):
    phrase = rng.choice(LETTERS, 34).tobytes()
    drawn = [rng.choice(LETTERS, 60).tobytes() + phrase + rng.choice(LETTERS, 60).tobytes() for _ in range(200)]
    drawn += [t[:k] + b"#" + t[k + 1 :] for t, k in zip(drawn[:60], rng.integers(0, 154, 60).tolist(), strict=True)]
    raw, gram, least, size, at = snippets_of(drawn)
    seen = []
    shared = suffix_dedup.shared
    monkeypatch.setattr(suffix_dedup, "shared", lambda n, *more: seen.append(len(n)) or shared(n, *more))
    suffix_dedup.resolve(gram.astype(np.uint8), least, least, size.astype(np.uint8), np.frombuffer(b"".join(raw), np.uint8))

    strings = [{x[i : i + 50] for i in range(len(x) - 49)} for x in raw]
    owners = {}
    for i, own in enumerate(strings):
        for x in own:
            owners.setdefault(x, set()).add(i)
    must = {i for own in owners.values() if len(own) > 1 for i in own}
    kept = suffix_dedup.kin(gram, at, size, np.frombuffer(b"".join(raw), np.uint8))
    assert must and must <= set(np.flatnonzero(kept).tolist())
    # the snippets of the phrase, 200 and more, share 34 bytes only
    assert sum(phrase[5:29] in x for x in raw) >= 200 and sum(seen) <= len(must) + 20, (seen, len(must))


def test_parts_are_gone_through_once_for_many_texts():
    texts = [rng.choice(LETTERS, 3000).tobytes() for _ in range(500)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    asked = []

    class Files:
        def part(self, k):
            asked.append(k)

    assert not list(suffix_dedup.occurrences(data, offsets, Files(), 300))
    assert len(asked) == len(set(asked)) == 300


def test_pieces_of_long_texts_have_all_strings():
    texts = [rng.choice(LETTERS, n).tobytes() for n in (10, 250_000, 49, 50, 3000, 0, 200_000, 70)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = np.zeros(len(data), np.int64)
    for _, s, e, of, at in suffix_dedup.stretches(data, offsets):
        assert ((offsets[of] <= s) & (e <= offsets[of + 1]) & (s <= at) & (at + 24 <= e)).all()
        for a, z in zip(s.tolist(), e.tolist(), strict=True):
            whole[a : z - 49] += 1
    want = np.zeros(len(data), np.int64)
    for a, z in zip(offsets[:-1], offsets[1:], strict=True):
        want[a : max(z - 49, a)] = 1
    assert (whole == want).all()
