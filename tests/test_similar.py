"""Similar titles, block by block, against all pairs."""

from __future__ import annotations

import random

import pytest

from plazalake.operators import similar as S


def some_titles(seed):
    r = random.Random(seed)
    words = "alpha beta release of new engine data lake 数据 湖 é".split()
    out = {"a", "b", "ab", "abc", "ab" * 60}
    for base in [" ".join(r.choices(words, k=r.choice([1, 2, 5, 8, 20]))) for _ in range(12)]:
        for _ in range(8):
            t = list(base)
            for _ in range(r.randint(0, 8)):
                at = r.randrange(len(t) + 1)
                t[at : at + r.randint(0, 1)] = r.choice(["", "x", " ", "数"])
            out.add("".join(t))
    return sorted(t for t in out if t)


def pairs(a, b):
    return {(i, j) for i, s in enumerate(a) for j, t in enumerate(b) if max(S.ratio(s, t), S.ratio(t, s)) >= S.THRESHOLD}


def test_bounds_lose_no_pair():
    titles = some_titles(1)
    found = {(i, j) for p, q in S.near_pairs(titles) for i, j in zip(p.tolist(), q.tolist(), strict=True)}
    assert found >= {(i, j) for i, j in pairs(titles, titles) if i < j} and all(i < j for i, j in found)
    a, b = titles[::2], titles[1::2]
    assert {(i, j) for p, q in S.near_pairs(a, b) for i, j in zip(p.tolist(), q.tolist(), strict=True)} >= pairs(a, b)
    r = random.Random(3)
    other = ["".join(r.choice("etaoin shr") for _ in range(40)) for _ in range(400)]
    assert sum(len(p) for p, _ in S.near_pairs(other)) < 80  # of 79,800


def test_a_common_beginning_is_the_first_block():
    r = random.Random(4)
    for _ in range(4000):
        head = "".join(r.choice("ab c") for _ in range(r.randint(0, 24)))
        s, t = (head + "".join(r.choice("ab c") for _ in range(r.randint(0, 9))) for _ in range(2))
        assert S.similar(s, t) == (S.SequenceMatcher(None, s, t).ratio() >= S.THRESHOLD)


@pytest.mark.parametrize("most", [20, 2048])
def test_blocks_lose_no_pair(spark, monkeypatch, most):
    titles = some_titles(2)
    monkeypatch.setattr(S, "BLOCK", (most, most))
    got = S.similar_titles(spark.createDataFrame([(t,) for t in titles], "t string")).collect()
    want = {(s, t) for s in titles for t in titles if S.ratio(s, t) >= S.THRESHOLD}
    assert {(r.new, r.old) for r in got} == want and len(got) == len(want)


def test_titles_meet_a_block_not_each_other():
    rows, groups = S._meetings({11: 100_000, 12: 30_000, 20: 5})
    assert [r[0] for r in rows] == [11, 12, 20] and [r[2] for r in rows] == [10, 3, 1]
    assert rows[0][3:] == (0, 13) and rows[1][3:] == (0, 13) and rows[2][3:] == (13, 14) and groups == 55 + 30 + 6 + 1


def test_a_longer_block_after_the_beginning_goes_first():
    s, t = "abX" + "c" * 9, "abYabX" + "c" * 9
    assert S.similar(s, t) == (S.SequenceMatcher(None, s, t).ratio() >= S.THRESHOLD)


def short_titles(seed):
    return [t for t in some_titles(seed) if len(t) <= S.WORD] + ["the th th the th th" + x for x in ("", "e", " the", "th th")]


@pytest.mark.parametrize("tile", [(4, 8), (64, 2048)])
def test_words_of_bits_lose_no_pair(monkeypatch, tile):
    monkeypatch.setattr(S, "SIGNS", tile)
    monkeypatch.setattr(S, "PAIRS", 64)
    for seed in range(5, 9):
        titles = short_titles(seed)
        found = [(i, j) for p, q in S._by_signs(*[S._Side(titles)] * 2) for i, j in zip(p.tolist(), q.tolist(), strict=True)]
        assert set(found) >= {(i, j) for i, j in pairs(titles, titles) if i < j} and len(found) == len(set(found)) and all(i < j for i, j in found)
        a, b = titles[::2], titles[1::2]
        assert {(i, j) for p, q in S._by_signs(S._Side(a), S._Side(b)) for i, j in zip(p.tolist(), q.tolist(), strict=True)} >= pairs(a, b)


def test_tiles_far_apart_are_skipped(monkeypatch):
    r = random.Random(6)
    titles = ["".join(r.choice(kind) for _ in range(40)) for kind in ("etaoin shr", "ulmdcy wfg") for _ in range(1000)]
    seen, around = [], S._Strips.around
    monkeypatch.setattr(S._Strips, "around", lambda *args: seen.append(around(*args)) or seen[-1])
    list(S._by_signs(S._Side(titles), S._Side(titles)))
    assert 0 < sum(map(len, seen)) * S.SIGNS[0] < 0.6 * len(titles) ** 2  # half are of the same letters


def test_many_pairs_are_compared_at_once():
    r = random.Random(7)
    a = ["".join(r.choice("ab c") for _ in range(r.randint(1, 64))) for _ in range(3000)]
    b = ["".join(c for c in t if r.random() < 0.76) + r.choice(["", "ab", "c"]) or "a" for t in a]
    a, b = zip(*[(s, t) for s, t in zip(a, b, strict=True) if len(t) <= S.WORD], strict=True)
    x, y = S._Side(a), S._Side(b)
    kinds = S.np.unique(S.np.concatenate([x.codes, y.codes]))
    got = S._alike(x.characters(kinds), y.characters(kinds), x.size, y.size).tolist()
    want = [S.SequenceMatcher(None, s, t).ratio() >= S.THRESHOLD for s, t in zip(a, b, strict=True)]
    assert got == want and 300 < sum(want) < len(want) - 300


def test_pairs_are_those_of_keys(spark):
    titles = some_titles(8)
    got = S.similar_titles(spark.createDataFrame(list(enumerate(titles)), "k long, t string"), "k", itself=False).collect()
    assert {(r.new, r.old) for r in got} == {(i, j) for i, s in enumerate(titles) for j, t in enumerate(titles) if i != j and S.ratio(s, t) >= S.THRESHOLD}
    assert S.similar_titles(spark.createDataFrame([], "k long, t string"), "k", itself=False).collect() == []
