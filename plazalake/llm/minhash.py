"""Near-duplicates by b-bit MinHash.

Documents with the same set of shingles are one class from the start, a numbered
node. Bands of minima give candidates; packed signatures that retain the low BITS
bits of every minimum, compared by bit counts and corrected for chance collisions,
weed them; full sets confirm links. Within a bucket all members are first held
against the most central one. Only buckets in which more than one component is
left then compare members of different components, by pairs of blocks: signatures
first, then the full sets of members that may have a link. So a large group of copies
costs no pairs of copies, a task holds two blocks whatever the bucket's size, and no
link between components is missed for want of a candidate.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, discard, hold, join_hot, slices
from .components import connected_components

SHINGLE = 5
ROWS = 6
#: A pair at the threshold shares no band with this probability at most.
MISSED = 2e-6


def bands_of(percent: int) -> int:
    """Bands of ROWS minima for a threshold: 28 at 85, 44 at 80."""
    return 1 if percent >= 100 else math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** ROWS)))


#: Of the usual threshold.
PERCENT = 85
MINIMA = bands_of(PERCENT) * ROWS
#: Low bits kept of each minimum; chance collisions 1/16.
BITS = 4
#: How far below the threshold an estimate may be; five standard errors of 168 minima and more.
SLACK = 0.16
#: Members of a bucket that are compared at once.
BLOCK = 1024
#: Words whose hashes a worker remembers.
CACHE = 300_000
_PLACES = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


@functools.cache
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of n hash functions."""
    rng = np.random.default_rng(20240501)
    multiply = rng.integers(1, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    return multiply, rng.integers(0, 1 << 63, n, dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word):
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _mix(h):
    h = h ^ h >> np.uint64(31)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; empty without words."""
    words = text.encode().translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    known = hold("minhash", _Words)
    if len(known) > CACHE:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = _mix(out + h[i : i + n] * _PLACES[i % 5])
    return np.unique(out)


def minima(h: np.ndarray, n: int = MINIMA) -> np.ndarray:
    """n minima of a set that isn't empty."""
    multiply, add = _hashes(n)
    low = np.full(n, np.iinfo(np.uint64).max)
    for i in range(0, len(h), 512):
        low = np.minimum(low, (h[i : i + 512, None] * multiply + add).min(0))
    return _mix(low)


def pack(low: np.ndarray) -> bytes:
    """BITS planes of as many 64-bit words as the minima take."""
    bits = np.zeros((BITS, -(-len(low) // 64) * 64), np.uint8)
    bits[:, : len(low)] = low >> np.arange(BITS, dtype=np.uint64)[:, None] & np.uint64(1)
    return np.packbits(bits, axis=1, bitorder="little").tobytes()


def estimate(one: np.ndarray, many: np.ndarray, n: int = MINIMA) -> np.ndarray:
    """Collision-corrected similarity of signature one to each of many, of n minima, as (BITS, lanes) words."""
    differ = np.bitwise_or.reduce(one ^ many, axis=-2)
    agree = 1 - np.bitwise_count(differ).sum(-1) / n
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def _unpack(signatures: list[bytes]) -> np.ndarray:
    lanes = len(signatures[0]) // (8 * BITS) if signatures else 1
    return np.frombuffer(b"".join(signatures), np.uint64).reshape(-1, BITS, lanes)


def sketch(docs: DataFrame, id_col: str, text_col: str, n_bands: int) -> DataFrame:
    """id, hash (of the text), n_shingles, and of sets that aren't empty: same (what stands for the set), bands, signature."""

    def run(batches):
        for batch in slices(batches, 2):
            n, same, bands, packed = [], [], [], []
            for text in batch.column(2).to_pylist():
                h = shingles(text)
                n.append(len(h))
                if len(h):
                    low = minima(h, n_bands * ROWS)
                    raw = low.reshape(n_bands, ROWS)
                    same.append(xxhash.xxh3_128_digest(h.tobytes()))
                    bands.append([xxhash.xxh64_intdigest(x.tobytes(), seed=i) - (1 << 63) for i, x in enumerate(raw)])
                    packed.append(pack(low))
                else:
                    same.append(None)
                    bands.append(None)
                    packed.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                names=["id", "hash", "n_shingles", "same", "bands", "signature"],
            )

    rows = _keyed(docs, id_col, text_col)
    return rows.mapInArrow(run, "id long, hash long, n_shingles long, same binary, bands array<long>, signature binary")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.col(text_col).alias("text"))


def sets_of(docs: DataFrame, id_col: str, text_col: str, need: DataFrame) -> DataFrame:
    """node, shingles (sorted 64-bit words) of the classes in need (node, id, hash, same), from their first document."""

    def run(batches):
        for batch in slices(batches, 2):
            sets = [shingles(t).tobytes() for t in batch.column(2).to_pylist()]
            right = [xxhash.xxh3_128_digest(x) == same for x, same in zip(sets, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"]).filter(pa.array(right, pa.bool_()))

    rows, need = _keyed(docs, id_col, text_col), need.select("node", "same", F.col("id").alias("first"), F.col("hash").alias("own"))
    found = rows.join(need, rows["id"].eqNullSafe(need["first"]) & (rows["hash"] == need["own"])).select("node", "same", "text")
    return found.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"])


def _sides(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """a, b, x, y: pairs with a column of both nodes. Many pairs may have the same a."""
    left, right = table.select(F.col("node").alias("a"), F.col(column).alias("x")), table.select(F.col("node").alias("b"), F.col(column).alias("y"))
    return join_hot(pairs, left, "a").join(right, "b").select("a", "b", "x", "y")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of (a, b) with 100 * intersection >= percent * union on full sets."""

    def run(batches):
        for batch in batches:
            sides = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sides]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _sides(pairs, sets, "shingles").mapInArrow(run, "a long, b long")


def _weed(pairs: DataFrame, classes: DataFrame, least: float, n: int) -> DataFrame:
    """Pairs whose estimated similarity is at least `least`."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = estimate(_unpack(batch.column(2).to_pylist()), _unpack(batch.column(3).to_pylist()), n)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near >= least))

    return _sides(pairs, classes, "signature").mapInArrow(run, "a long, b long")


def _centres(placed: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """bucket, a: the member that the others are held against.

    In buckets of over three, the one that agrees most with the majority bits of its
    block, which in a group of copies is the original; in small ones the least node.
    """

    def run(key, table):
        nodes, signs = table["node"].to_numpy(), _unpack(table["signature"].to_pylist())
        bits = np.unpackbits(signs.view(np.uint8).reshape(len(nodes), -1), axis=1)
        majority = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(nodes)).view(np.uint64).reshape(signs.shape[1:])
        near = estimate(majority, signs, n)
        best = int(np.lexsort((nodes, -near))[0])
        return pa.table({"bucket": [key[0].as_py()], "node": [int(nodes[best])], "near": [float(near[best])]})

    few = placed.where("n <= 3").groupBy("bucket").agg(F.min("node").alias("a"))
    many = placed.where("n > 3").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)))
    many = many.join(classes.select("node", "signature"), "node").select("bucket", "block", "node", "signature")
    best = many.groupBy("bucket", "block").applyInArrow(run, "bucket long, node long, near double")
    return few.union(best.groupBy("bucket").agg(F.min(F.struct((-F.col("near")).alias("near"), "node"))["node"].alias("a")))


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _across(members: DataFrame, classes: DataFrame, sets: DataFrame, least: float, percent: int, n: int) -> DataFrame:
    """Links between different components in the same bucket, confirmed on full sets.

    members: bucket, i, j, small, node, component. In a group (bucket, i, j) the
    members of block i meet those of block j whose component isn't the bucket's
    largest. Signatures tell which may have a link; sets of those alone are fetched.
    A component that has been linked isn't compared with its new part again, so
    what comes out of a group is at most a tree; every pair that stays apart has
    been estimated, and confirmed to be none if the estimate was high.
    """

    def candidates(table):
        """For each small row, the near ones of other components among the rest, best first."""
        comp, small = table["component"].to_numpy().copy(), table["small"].to_numpy(zero_copy_only=False)
        signs, rest = _unpack(table["signature"].to_pylist()), np.flatnonzero(~small)
        for i in np.flatnonzero(small).tolist():
            other = rest[comp[rest] != comp[i]]
            if len(other):
                near = estimate(signs[i], signs[other], n)
                yield i, other[np.argsort(-near, kind="stable")][: int((near >= least).sum())], comp

    def flag(table):
        hit = np.zeros(table.num_rows, bool)
        for i, near, _ in candidates(table):
            if len(near):
                hit[i] = hit[near] = True
        return table.filter(pa.array(hit))

    def link(table):
        nodes, sets, a, b = table["node"].to_pylist(), [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()], [], []
        for i, near, comp in candidates(table):
            for j in near.tolist():
                if comp[j] != comp[i] and _linked(sets[i], sets[j], percent):
                    a.append(min(nodes[i], nodes[j]))
                    b.append(max(nodes[i], nodes[j]))
                    comp[comp == comp[j]] = comp[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = members.join(classes.select("node", "signature"), "node").select("bucket", "i", "j", "small", "node", "component", "signature")
    flagged = cut(rows.groupBy("bucket", "i", "j").applyInArrow(flag, rows.schema), "flagged")
    with_sets = flagged.join(sets, "node").select(*rows.columns, "shingles")
    links = cut(with_sets.groupBy("bucket", "i", "j").applyInArrow(link, "a long, b long").distinct(), "across")
    discard(flagged)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept, text_hash, component.

    A set: distinct shingles of SHINGLE lower-cased words (A-Z only); with fewer
    words, all of them as one. Documents are linked if 100 * intersection >= percent *
    union. Without words a document is linked with nothing: its component_id is its
    own id and it has no component, the number of those that are linked. A null id is
    larger than any other; where there is no other, component_id is null. kept: the
    id is component_id, so of rows that repeat an id all or none of a component are.
    No rows for no documents.
    """
    n_bands = bands_of(percent)
    n = n_bands * ROWS
    all_rows = cut(sketch(docs, id_col, text_col, n_bands).withColumn("run", F.spark_partition_id()), "sketches")
    rows = all_rows.where("same is not null")
    # a class: all documents with the same set
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("hash").alias("hash"))).alias("first")
    classes = rows.groupBy("same").agg(first, F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "same", "first.id", "first.hash", "bands", "signature"), "classes")
    placed = classes.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("bucket"))
    sizes = cut(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    placed = cut(join_hot(placed, sizes, "bucket", sizes), "buckets")
    threshold = percent / 100 - SLACK
    stars = join_hot(placed.select("node", "bucket"), _centres(placed, classes, n), "bucket", sizes)
    stars = cut(_weed(stars.where("node <> a").select("a", F.col("node").alias("b")).distinct(), classes, threshold, n), "stars")
    # sets of the members of buckets with more than one, and of no others
    need = classes.select("node", "id", "hash", "same").join(placed.select("node").distinct(), "node", "left_semi")
    sets = cut(sets_of(docs, id_col, text_col, need), "sets")
    edges = cut(confirmed(stars, sets, percent), "links")
    found = connected_components(edges)
    # buckets in which more than one component is left
    members = placed.select("bucket", "node").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    parts = members.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("total"), F.max(F.struct("n", "component")).alias("top")).where("parts > 1")
    mixed = mixed.select("bucket", F.col("top.component").alias("largest"), F.ceil(F.col("total") / BLOCK).cast("int").alias("blocks"))
    members = join_hot(members, mixed, "bucket", sizes).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    place = lambda i, j, small: F.struct(i.alias("i"), j.alias("j"), F.lit(small).alias("small"))
    meets = F.transform(every, lambda k: place(F.col("own"), k, False))
    meets = F.when(F.col("component") == F.col("largest"), meets).otherwise(F.concat(meets, F.transform(every, lambda k: place(k, F.col("own"), True))))
    members = members.select("bucket", "node", "component", F.explode(meets).alias("at")).select("bucket", "at.*", "node", "component")
    more = _across(members, classes, sets, threshold, percent, n)
    for done in (placed, sizes, stars, sets):
        discard(done)
    if more.take(1):
        discard(found)
        found = connected_components(edges.union(more))
    for done in (edges, more):
        discard(done)
    # from components to classes, then to the rows of a class run by run, as one class may be that of most rows
    roots = classes.join(found, "node", "left").select("same", "id", F.coalesce("component", "node").alias("component"))
    roots = cut(join_hot(roots.drop("id"), roots.groupBy("component").agg(F.min("id").alias("component_id")), "component"), "roots")
    for done in (classes, found):
        discard(done)
    by_run = rows.select("run", "same").distinct().join(roots, "same")
    linked = rows.select("run", "same", "id", "hash", "n_shingles").join(by_run, ["run", "same"])
    alone = all_rows.where("same is null").select("id", "hash", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id"))
    return linked.select(alone.columns).union(alone).select(
        F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("hash").alias("text_hash"), "component"
    )
