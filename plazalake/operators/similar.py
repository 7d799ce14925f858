"""All pairs of similar titles: blocks of titles meet in tasks, and bounds that lose no pair go before the comparison.

Characters that two titles share at all bound the characters that they share in order, 64
pairs of positions a step, and these the matching blocks, which are found for many pairs at
once. Short titles are laid out by two sums of their counts, so that tiles too far apart are
skipped; within the others a word of bits for each title stands for its counts, a longer one
for its pairs of neighbours. Long titles take a small matrix product instead. Every pair of
blocks whose lengths permit it is one group of two blocks.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazalake.sources.shared import cut

THRESHOLD = 0.85
#: Of the length of a title, the least length of a partner: M <= min(a, b) and 2M >= t(a + b).
SHORTEST = THRESHOLD / (2 - THRESHOLD)
#: Least and most titles of a block, and blocks that are aimed at between these.
BLOCK, BLOCKS = (2048, 65536), 12
#: Most groups of two blocks that get a partition of their own.
PARTS = 4096
#: Frequent characters with a place of their own, and places for all others: in counts and in positions.
COUNTED, PLACED = (24, 8), (96, 31)
#: Most counts of a character that are told apart, and the share of titles that has no more than are.
MOST, SHARE = 32, 90
#: Titles of a tile, at either side; pairs that are held against each other in order at once.
TILE, PAIRS = (512, 2048), 1 << 15
#: The same for words of bits: places of their own and for others, titles and pairs of them looked at to deal out the bits, words for pairs of neighbours.
SIGNED, LOOKED, NEIGHBOURS = (22, 8), (4096, 1 << 15), 8
#: Titles of a tile for words of bits, at either side; pairs that are compared at once.
SIGNS, COMPARED = (64, 2048), 1 << 14
#: Length from which SequenceMatcher ignores popular characters.
POPULAR = 200
#: Length up to which positions fit into a word.
WORD = 64


def ratio(new: str, old: str) -> float:
    """Matching-blocks ratio of lower-case titles, in this order; 0 where an upper bound is below the threshold."""
    m = SequenceMatcher(None, new, old)
    return m.ratio() if m.real_quick_ratio() >= THRESHOLD and m.quick_ratio() >= THRESHOLD else 0.0


def similar(new: str, old: str) -> bool:
    """ratio(new, old) >= THRESHOLD, of texts that have that many characters in common in order.

    A common beginning that is the longest common block is the first matching block, so only what
    follows is left to compare. Not for texts of which SequenceMatcher ignores popular characters.
    """
    if max(len(new), len(old)) >= POPULAR:
        return ratio(new, old) >= THRESHOLD
    n = len(commonprefix((new, old)))
    if n and not any(new[i : i + n + 1] in old for i in range(len(new) - n)):
        rest = sum(block.size for block in SequenceMatcher(None, new[n:], old[n:]).get_matching_blocks())
        return 2.0 * (n + rest) / (len(new) + len(old)) >= THRESHOLD
    return SequenceMatcher(None, new, old).ratio() >= THRESHOLD


def _in_order(a: str, b: str) -> int:
    """The most characters that two texts of any length have in common in order."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class _Side:
    """The titles of a block as codes of their characters."""

    def __init__(self, titles: list[str]):
        self.titles = [t.lower() for t in titles]
        self.size = np.array([len(t) for t in self.titles], np.int64)
        self.codes = np.frombuffer("".join(self.titles).encode("utf-32-le", "surrogatepass"), "<u4")
        self.row = np.repeat(np.arange(len(titles)), self.size)

    def places(self, frequent: np.ndarray, others: int) -> np.ndarray:
        """Of each character its place: its own, or that of all with its code modulo others."""
        at = np.minimum(np.searchsorted(frequent, self.codes), len(frequent) - 1)
        return np.where(frequent[at] == self.codes, at, len(frequent) + self.codes % others)

    def counts(self, frequent: np.ndarray, others: int) -> np.ndarray:
        wide = len(frequent) + others
        return np.bincount(self.row * wide + self.places(frequent, others), minlength=len(self.size) * wide).reshape(-1, wide)

    def positions(self, frequent: np.ndarray, others: int) -> tuple[np.ndarray, np.ndarray]:
        """Of titles of WORD characters at most: the places in order, those after the end one beyond the others; and a word of positions for each place."""
        wide, places = len(frequent) + others, self.places(frequent, others)
        column = np.arange(len(self.codes)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        fits = self.size[self.row] <= WORD
        row, place, column = self.row[fits], places[fits], column[fits]
        order = np.full((len(self.size), WORD), wide, np.uint8)
        order[row, column] = place
        words = np.zeros((len(self.size), wide + 1), np.uint64)
        np.bitwise_or.at(words, (row, place), np.uint64(1) << column.astype(np.uint64))
        return order, words


    def neighbours(self) -> np.ndarray:
        """Of each title NEIGHBOURS words: which remainders its two neighbours, those that come again by their number, have an odd number of times."""
        inside = self.row[:-1] == self.row[1:]
        pair = (self.codes[:-1].astype(np.uint64) << np.uint64(32) | self.codes[1:])[inside] * np.uint64(0x9E3779B97F4A7C15)
        # a number of 32 bits stands for the two, below that of the title
        known = np.sort(self.row[:-1][inside].astype(np.uint64) << np.uint64(32) | (pair ^ pair >> np.uint64(29)) >> np.uint64(32))
        row, start = (known >> np.uint64(32)).astype(np.int64), np.flatnonzero(np.append(True, known[1:] != known[:-1])[: len(known)])
        again = np.arange(len(known)) - np.repeat(start, np.diff(np.append(start, len(known))))
        mixed = (known & np.uint64(0xFFFFFFFF) | again.astype(np.uint64) << np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        bit = ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(64 * NEIGHBOURS)
        words = np.zeros((len(self.size), NEIGHBOURS), np.uint64)
        np.bitwise_xor.at(words, (row, (bit // np.uint64(64)).astype(np.int64)), np.uint64(1) << bit % np.uint64(64))
        return words

    def characters(self, kinds: np.ndarray) -> np.ndarray:
        """The first WORD characters of each title as their places in kinds, from 2 on; 0 after the end."""
        column = np.arange(len(self.codes)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        first = column < WORD
        out = np.zeros((len(self.size), WORD), np.uint16 if len(kinds) < (1 << 16) - 2 else np.uint32)
        out[self.row[first], column[first]] = np.searchsorted(kinds, self.codes[first]) + 2
        return out


def _frequent(sides: list[_Side], most: int) -> np.ndarray:
    codes, times = np.unique(np.concatenate([s.codes for s in sides]), return_counts=True)
    return np.sort(codes[np.argsort(-times, kind="stable")[:most]])


def _factors(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matrices whose product is at least the characters shared, less those needed for THRESHOLD.

    min(x, y) is the number of k with x >= k and y >= k; beyond a bound on k it is taken to be
    all that a has, if b has more than the bound too.
    """
    most = np.maximum(a.max(0), b.max(0))
    told = np.minimum(np.minimum(np.maximum(np.percentile(a, SHARE, axis=0).astype(np.int64), 1), MOST), most)
    steps, over = [(j, k) for j in range(len(told)) for k in range(1, told[j] + 1)], np.flatnonzero(most > told)
    place, least = np.array([j for j, _ in steps]), np.array([k for _, k in steps])
    need = THRESHOLD / 2
    left = [a[:, place] >= least, np.maximum(a[:, over] - told[over], 0), -need * a_size[:, None], np.ones((len(a), 1))]
    right = [b[:, place] >= least, b[:, over] > told[over], np.ones((len(b), 1)), -need * b_size[:, None]]
    return np.concatenate([x.astype(np.float32) for x in left], 1), np.concatenate([x.astype(np.float32) for x in right], 1)


def _dealt(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Bits of each place, 64 in all: where one more adds most to the differences of some pairs of rows of these counts."""
    r = np.random.default_rng(0)
    i, j = r.integers(0, len(a), LOOKED[1]), r.integers(0, len(b), LOOKED[1])
    apart = np.abs(a[i] - b[j])

    def told(at, k):
        rest = apart[:, at] % (2 * k)
        return float(np.minimum(rest, 2 * k - rest).mean())

    bits = [1] * a.shape[1]
    now = [told(at, 1) for at in range(len(bits))]
    more = [told(at, 2) for at in range(len(bits))]
    while sum(bits) < 64:
        at = max(range(len(bits)), key=lambda at: more[at] - now[at])
        bits[at] += 1
        now[at], more[at] = more[at], told(at, bits[at] + 1)
    return bits


def _signs(counts: np.ndarray, bits: list[int]) -> np.ndarray:
    """A word for each row: of k bits for a count, x and y differ in at most |x - y|, in as many up to k."""
    out, at = np.zeros(len(counts), np.uint64), 0
    for count, k in zip(counts.T, bits, strict=True):
        turn = count % (2 * k)
        for step in range(k):
            out |= ((turn > step) & (turn <= step + k)).astype(np.uint64) << np.uint64(at)
            at += 1
    return out


def _sums(counts: np.ndarray) -> np.ndarray:
    """Two rows of weights, none above 1/2: sums by them differ by half as much as the counts at most, and spread far."""
    spread = np.cov(counts.T.astype(np.float64))
    out = []
    for _ in range(2):
        w = np.linalg.eigh(spread)[1][:, -1]
        for _ in range(20):
            w = np.where(spread @ w < 0, -0.5, 0.5)
        out.append(w)
        along = spread @ w
        if (much := w @ along) > 0:
            spread = spread - np.outer(along, along) / much
    return np.array(out)


class _Strips:
    """Rows in strips by a first sum, within a strip by a second."""

    def __init__(self, sums: np.ndarray):
        n = len(sums)
        strips = max(1, round((n / SIGNS[0]) ** 0.5))
        strip = np.empty(n, np.int64)
        strip[np.argsort(sums[:, 0], kind="stable")] = np.arange(n) * strips // n
        self.order = np.lexsort((sums[:, 1], strip))
        self.first, self.second = sums[self.order].T
        self.ends = np.searchsorted(strip[self.order], np.arange(strips + 1))
        spans = [self.first[s:e] for s, e in zip(self.ends[:-1], self.ends[1:], strict=True)]
        self.low, self.high = np.array([x.min() for x in spans]), np.array([x.max() for x in spans])

    def around(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places in order whose second sum is between these, in strips whose first sums may be."""
        out = []
        for k in np.flatnonzero((self.high >= low[0]) & (self.low <= high[0])).tolist():
            s, e = self.ends[k], self.ends[k + 1]
            out.append(np.arange(s + np.searchsorted(self.second[s:e], low[1], "left"), s + np.searchsorted(self.second[s:e], high[1], "right")))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _apart(size: np.ndarray) -> np.ndarray:
    """Of two lengths together, the most characters that aren't in common in order for THRESHOLD."""
    return size - 2 * np.ceil(THRESHOLD / 2 * size - 1e-9).astype(np.int64)


def _by_signs(left: _Side, right: _Side):
    """Candidates (i, j), or with i < j of one side, of titles of WORD characters at most, as arrays."""
    frequent = _frequent([left] if left is right else [left, right], SIGNED[0])
    some = lambda x: x[:: -(-len(x) // LOOKED[0])]
    a, b = left.counts(frequent, SIGNED[1]), right.counts(frequent, SIGNED[1])
    bits, weights = _dealt(some(a), some(b)), _sums(np.concatenate([some(a), some(b)]))
    rows = _Strips(a @ weights.T)
    columns = rows if left is right else _Strips(b @ weights.T)
    x, y = _signs(a, bits)[rows.order], _signs(b, bits)[columns.order]
    longest = int(right.size.max())
    # a word at a time, in the order of the strips
    by_pairs = [np.ascontiguousarray(side.neighbours()[by.order].T) for side, by in ((left, rows), (right, columns))]
    sizes = left.size[rows.order], right.size[columns.order]
    # a character more or less changes three pairs of neighbours at most
    changed = 3 * _apart(np.arange(2 * WORD + 1))
    words, count = np.empty(SIGNS, np.uint64), np.empty(SIGNS, np.uint8)
    held, n = [], 0

    def kept():
        p, q = map(np.concatenate, zip(*held, strict=True))
        most, found = changed.take(sizes[0].take(p) + sizes[1].take(q)), 0
        for half in np.array_split(np.arange(NEIGHBOURS), 2):
            for k in half:
                found = found + np.bitwise_count(by_pairs[0][k].take(p) ^ by_pairs[1][k].take(q)).astype(np.int16)
            good = np.flatnonzero(found <= most)
            p, q, most, found = p[good], q[good], most[good], found[good]
        i, j = rows.order[p], columns.order[q]
        return (np.minimum(i, j), np.maximum(i, j)) if left is right else (i, j)

    for k in range(len(rows.ends) - 1):
        for at in range(rows.ends[k], rows.ends[k + 1], SIGNS[0]):
            to = min(at + SIGNS[0], rows.ends[k + 1])
            # no pair of this tile may differ by more
            most = int(0.5 + 1e-6 + (1 - THRESHOLD) * (int(left.size[rows.order[at:to]].max()) + longest))
            reach = most / 2 + 1e-6
            sums = rows.first[at:to], rows.second[at:to]
            near = columns.around(np.array([s.min() for s in sums]) - reach, np.array([s.max() for s in sums]) + reach)
            if left is right:
                near = near[near > at]
            for part in range(0, len(near), SIGNS[1]):
                other = near[part : part + SIGNS[1]]
                w, c = words[: to - at, : len(other)], count[: to - at, : len(other)]
                np.bitwise_xor(x[at:to, None], y[None, other], out=w)
                np.bitwise_count(w, out=c)
                p, q = np.divmod(np.flatnonzero(c <= most), len(other))
                p, q = p + at, other[q]
                if left is right:
                    p, q = p[p < q], q[p < q]
                held.append((p, q))
                n += len(p)
                if n >= PAIRS:
                    yield kept()
                    held, n = [], 0
    if held:
        yield kept()


def _by_product(left: _Side, right: _Side):
    """Candidates (i, j), or with i < j of one side, of titles of any length, as arrays."""
    frequent = _frequent([left] if left is right else [left, right], COUNTED[0])
    x, y = _factors(left.counts(frequent, COUNTED[1]), right.counts(frequent, COUNTED[1]), left.size, right.size)
    slack = 1e-3 + 1e-5 * float(max(left.size.max(), right.size.max()))
    turned = np.ascontiguousarray(y.T)
    held, n = [], 0
    for at in range(0, len(x), TILE[0]):
        for to in range(at if left is right else 0, len(y), TILE[1]):
            found = np.flatnonzero((x[at : at + TILE[0]] @ turned[:, to : to + TILE[1]]).ravel() >= -slack)
            i, j = np.divmod(found, min(TILE[1], len(y) - to))
            i, j = i + at, j + to
            if left is right:
                i, j = i[i < j], j[i < j]
            held.append((i, j))
            n += len(i)
            if n >= PAIRS:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def near_pairs(a: list[str], b: list[str] | None = None):
    """(i, j) of titles a[i] and b[j], or of a with i < j, with enough characters in common in order, as arrays."""
    left = _Side(a)
    yield from _near(left, left if b is None else _Side(b))


def _near(left: _Side, right: _Side):
    if not len(left.codes) or not len(right.codes):
        return
    frequent = _frequent([left] if left is right else [left, right], PLACED[0])
    words, order = left.positions(frequent, PLACED[1])[1], np.ascontiguousarray(right.positions(frequent, PLACED[1])[0].T)
    wide = words.shape[1]

    def in_order(i, j):
        need = np.ceil(THRESHOLD / 2 * (left.size[i] + right.size[j]) - 1e-9)
        short = left.size[i] <= WORD
        short &= right.size[j] <= WORD
        good = np.zeros(len(i), bool)
        p, q = i[short] * wide, j[short]
        v = np.full(len(p), ~np.uint64(0))
        for k in range(int(right.size[q].max(initial=0))):
            u = v & words.take(p + order[k].take(q))
            v = (v + u) | (v - u)
        size = left.size[i[short]].astype(np.uint64)
        # characters in common in order are the zeros among the first ones
        good[short] = np.bitwise_count(~v & (~np.uint64(0) >> (np.uint64(WORD) - size))) >= need[short]
        for at in np.flatnonzero(~short):
            good[at] = _in_order(left.titles[i[at]], right.titles[j[at]]) >= need[at]
        return i[good], j[good]

    short = max(left.size.max(), right.size.max()) <= WORD
    for i, j in (_by_signs if short else _by_product)(left, right):
        yield in_order(i, j)


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and places of the longest common block of the columns of a and b, of those the first in a, then in b."""
    wide, n = a.shape
    run, key, same = np.zeros((wide + 1, n), np.uint16), np.empty((wide, n), np.uint16), np.empty((wide, n), np.uint16)
    best, end = np.zeros(n, np.uint16), np.zeros(n, np.int64)
    back = (WORD - 1 - np.arange(wide, dtype=np.uint16))[:, None]
    for at in range(wide):
        # the lengths of blocks that end here, times WORD
        np.add(run[:-1], np.uint16(WORD), out=key)
        np.copyto(same, b == a[at])
        np.multiply(key, same, out=run[1:])
        np.add(run[1:], back, out=key)
        top = key.max(0)
        better = top >> 6 > best >> 6
        np.copyto(best, top, where=better)
        end[better] = at
    size = (best // WORD).astype(np.int64)
    return size, end + 1 - size, WORD - (best % WORD).astype(np.int64) - size


def _alike(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """similar() of each two rows of characters, WORD of them at most: all pairs go from block to block together."""
    n = len(a)
    done, total = np.zeros(n, np.int64), (a_size + b_size).astype(np.float64)
    zero = np.zeros(n, np.int64)
    parts = np.stack([np.arange(n), zero, a_size, zero, b_size])
    while True:
        parts = parts[:, (parts[1] < parts[2]) & (parts[3] < parts[4])]
        hope = np.bincount(parts[0], np.minimum(parts[2] - parts[1], parts[4] - parts[3]), n)
        undecided = (2.0 * done / total < THRESHOLD) & (2.0 * (done + hope) / total >= THRESHOLD)
        parts = parts[:, undecided[parts[0]]]
        if not parts.shape[1]:
            return 2.0 * done / total >= THRESHOLD
        width = -(-np.maximum(parts[2] - parts[1], parts[4] - parts[3]) // 4) * 4
        following = []
        for wide in np.unique(width):
            same = parts[:, width == wide]
            for at in range(0, same.shape[1], 1024):
                pair, alo, ahi, blo, bhi = same[:, at : at + 1024]
                step = np.arange(wide)[:, None]
                x = np.where(step + alo < ahi, a[pair, np.minimum(step + alo, WORD - 1)], 0)
                y = np.where(step + blo < bhi, b[pair, np.minimum(step + blo, WORD - 1)], 1)
                size, i, j = _longest(x, y)
                np.add.at(done, pair, size)
                i, j, some = i + alo, j + blo, size > 0
                following += [np.stack([pair, alo, i, blo, j])[:, some], np.stack([pair, i + size, ahi, j + size, bhi])[:, some]]
        parts = np.concatenate(following, 1)


def similar_pairs(left: _Side, right: _Side):
    """(i, j), (j, i) of titles whose ratio in this order is THRESHOLD at least: arrays of places on the left, of those on the right, whether the left one is first."""
    kinds = np.unique(np.concatenate([left.codes, right.codes]))
    rows = left.characters(kinds), right.characters(kinds)

    def compared(i, j):
        short = (left.size[i] <= WORD) & (right.size[j] <= WORD)
        p, q = i[short], j[short]
        for first in (True, False):
            x, y = (rows[0][p], rows[1][q]) if first else (rows[1][q], rows[0][p])
            sizes = (left.size[p], right.size[q]) if first else (right.size[q], left.size[p])
            good = np.zeros(len(i), bool)
            good[short] = _alike(x, y, *sizes)
            for at in np.flatnonzero(~short):
                s, t = left.titles[i[at]], right.titles[j[at]]
                good[at] = similar(s, t) if first else similar(t, s)
            yield i[good], j[good], first

    held, n = [], 0
    for i, j in _near(left, right):
        held.append((i, j))
        n += len(i)
        if n >= COMPARED:
            yield from compared(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield from compared(*map(np.concatenate, zip(*held, strict=True)))


def _meetings(sizes: dict[int, int]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Of each class of lengths: its first block, how many it has, the first block that is met from it and the first beyond those; and the pairs of blocks.

    A class meets itself and its neighbours, and blocks are numbered by class.
    """
    most = min(max(-(-sum(sizes.values()) // BLOCKS), BLOCK[0]), BLOCK[1])
    count = {k: -(-n // most) for k, n in sizes.items()}
    first = {k: sum(count[m] for m in count if m < k) for k in count}
    rows = [(k, first[k], count[k], first.get(k - 1, first[k]), first[k] + count[k] + count.get(k + 1, 0)) for k in sorted(count)]
    return rows, sum(n * (n + 1) // 2 + n * count.get(k + 1, 0) for k, n in count.items())


def similar_titles(titles: DataFrame, key: str = "t", itself: bool = True) -> DataFrame:
    """new, old: keys of all pairs of different lower-case titles t with a ratio of THRESHOLD at least, and of each with itself too.

    No pair is lost. Titles are dealt by length, so that only those of one class or of
    neighbouring classes can be similar, and within a class by a hash to blocks. Each pair of
    blocks is a group: its size is bounded, while their number grows with the square of the titles.
    """
    kind = F.floor(F.log(F.greatest(F.char_length("t"), F.lit(1))) / (1e-9 - math.log(SHORTEST))).cast("int")
    known = cut(titles.select("t", F.col(key).alias("key"), kind.alias("kind")), "titles")
    each = known.select(F.col("key").alias("new"), F.col("key").alias("old"))
    # a row for each class of lengths
    rows, pairs = _meetings({r["kind"]: r["n"] for r in known.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()})
    if not rows:
        return each if itself else each.limit(0)
    classes = titles.sparkSession.createDataFrame(rows, "kind int, first int, count int, start int, until int")
    dealt = known.join(F.broadcast(classes), "kind").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("t"), F.col("count"))).cast("int"))
    a = dealt.select(F.col("t").alias("s"), F.col("key").alias("new"), F.col("block").alias("i"), F.explode(F.sequence("block", F.col("until") - 1)).alias("j"))
    b = dealt.select("t", F.col("key").alias("old"), F.explode(F.sequence("start", "block")).alias("k"), F.col("block").alias("m"))

    def meet(ij, a, b):
        found = []
        if len(a) and len(b):
            one = ij[0].as_py() == ij[1].as_py()
            left, x = _Side(a.column("s").to_pylist()), a.column("new").combine_chunks()
            right, y = (left, x) if one else (_Side(b.column("t").to_pylist()), b.column("old").combine_chunks())
            for i, j, first in similar_pairs(left, right):
                s, t = x.take(pa.array(i)), y.take(pa.array(j))
                found.append(pa.table({"new": s, "old": t} if first else {"new": t, "old": s}))
        return pa.concat_tables(found) if found else pa.table({"new": a.column("new").slice(0, 0), "old": b.column("old").slice(0, 0)})

    a, b = (side.repartition(min(pairs, PARTS), *keys).groupBy(*keys) for side, keys in ((a, "ij"), (b, "km")))
    found = a.cogroup(b).applyInArrow(meet, each.schema)
    return found.union(each) if itself else found
