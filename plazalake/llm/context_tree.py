"""Language model scoring by context-tree weighting.

A text is the sequence of its lower-cased words, each but the first after a
space, and an end byte. Every byte is decomposed into eight binary decisions; each
decision has a tree over the DEPTH preceding bytes, whose nodes hold
Krichevsky-Trofimov estimates of the counts of the whole training corpus and are
mixed over all depths by context-tree weighting.

Counts are made per chunk of documents and summed by gram (DEPTH context bytes
and the byte they lead to). What a chunk has for a bucket of grams or words travels
as one packed row; the number of buckets follows from the number of different grams
and words, so rows grow with the chunks alone. They are summed in a tree, FAN chunks
at a time. A branch of the tree of contexts, all with the same BRANCH newest bytes,
holds 2^24 grams at the very most and is weighted in one group with others; the
nodes above the branches are summed from theirs. The code lengths of grams then go
back to the chunks in which the grams occur, as many chunks at a time as need about
NEEDS times what a bucket holds: no task holds the model, what is copied of it is a share
of what the chunks hold, and the driver has only the nodes of contexts shorter than BRANCH.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, discard, fold

HELD_OUT, FOLDS = 1, 5
DEPTH = 5
BRANCH = 3
#: Grams that are weighted together, in whole branches.
GROUP_GRAMS = 1 << 20
END = b"\n"
#: Bytes of text per chunk, and per step within a chunk.
CHUNK_BYTES, STEP_BYTES = 16 << 20, 2 << 20
#: Different grams, or words, per bucket; hashes by which their number is estimated.
BUCKET_GRAMS, BUCKET_WORDS, LOWEST = 1 << 18, 1 << 17, 256
#: Chunks whose rows for a bucket meet in one group.
FAN = 32
#: Keys of a group of chunks for each key of the bucket that they are looked up in.
NEEDS = 4
_U = np.uint64

_LN_PI = math.log(math.pi)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(LOWER).split() if text else []


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of x >= 0.5, by Stirling's series after seven steps up."""
    y = x.astype(np.float64)
    shift = np.zeros_like(y)
    for _ in range(7):
        shift += np.log(y)
        y += 1
    inv = 1 / y
    series = inv * (1 / 12 - inv**2 * (1 / 360 - inv**2 * (1 / 1260 - inv**2 / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to these counts."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - _LN_PI


def grams_of(texts: list[list[bytes]]):
    """Of documents as words: the gram of each byte, newest context byte first, and each document's number of bytes.

    Before a document stand DEPTH end bytes.
    """
    parts = [b" ".join(w) + END for w in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    raw = np.frombuffer(END * DEPTH + b"".join([p + END * DEPTH for p in parts]), np.uint8)
    key = np.zeros(len(raw) - DEPTH, _U)
    for back in range(1, DEPTH + 1):
        key = key << _U(8) | raw[DEPTH - back : len(raw) - back].astype(_U)
    key = key << _U(8) | raw[DEPTH:].astype(_U)
    real = np.ones(len(key), bool)
    ends = (sizes + DEPTH).cumsum()
    for i in range(1, DEPTH + 1):
        real[ends - i] = False
    return key[real], sizes


class Level:
    """Nodes of one depth, for each of the eight bits of the next byte."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int):
        self.key = key >> _U(8 * (DEPTH + 1 - depth)) << _U(8) | key & _U(255)
        self.own, inverse = np.unique(self.key, return_inverse=True)
        self.at, self.n = inverse, np.bincount(inverse, n, len(self.own))
        self.node, self.counts, self.weighted, self.log_beta = [], [], [], []
        for bit in range(8):
            prefix = self.own >> _U(8 - bit)
            node = np.append(0, (prefix[1:] != prefix[:-1]).cumsum())
            one = (self.own >> _U(7 - bit) & _U(1)).astype(bool)
            size = int(node[-1]) + 1
            self.node.append(node)
            self.counts.append((np.bincount(node[~one], self.n[~one], size), np.bincount(node[one], self.n[one], size)))

    def weigh(self, below: Level | None) -> None:
        """Log weighted probability of each node; log ratio of its own estimate to its children's."""
        parent = None if below is None else self.own.searchsorted(below.own >> _U(16) << _U(8) | below.own & _U(255))
        for bit in range(8):
            own = kt_log(*self.counts[bit])
            if below is None:
                self.weighted.append(own)
                self.log_beta.append(np.full(len(own), np.inf))
                continue
            first = np.flatnonzero(np.append(True, np.diff(below.node[bit]) > 0))
            children = np.bincount(self.node[bit][parent[first]], below.weighted[bit], len(own))
            self.weighted.append(np.logaddexp(own, children) - math.log(2))
            self.log_beta.append(own - children)

    def mix(self, bit: int, deeper, one: np.ndarray, pick):
        """Probability of the bit at this depth, mixed with that of deeper ones."""
        node = self.node[bit][pick]
        n0, n1 = self.counts[bit]
        return mixed(n0[node], n1[node], self.log_beta[bit][node], deeper, one)


def mixed(n0, n1, log_beta, deeper, one):
    p = (np.where(one, n1, n0) + 0.5) / (n0 + n1 + 1)
    if deeper is None:
        return p
    weight = 1 / (1 + np.exp(-np.clip(log_beta, -700, 700)))
    return weight * p + (1 - weight) * deeper


def branch_levels(key: np.ndarray, n: np.ndarray) -> dict[int, Level]:
    """Depths DEPTH to BRANCH of whole branches, weighted."""
    levels, below = {}, None
    for depth in range(DEPTH, BRANCH - 1, -1):
        levels[depth] = Level(key, n, depth)
        levels[depth].weigh(below)
        below = levels[depth]
    return levels


def _total(node: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    own, at = np.unique(node, return_inverse=True)
    return [own, *[np.bincount(at, v, len(own)) for v in values]]


def branch_roots(key: np.ndarray, n: np.ndarray) -> pa.Table:
    """What the nodes above need of branches: (node, n0, n1, weighted), summed by parent.

    A node's number: its context, then the bits of the next byte so far after a 1.
    """
    top, node, n0, n1, w = branch_levels(key, n)[BRANCH], [], [], [], []
    for bit in range(8):
        own = top.own[np.flatnonzero(np.append(True, np.diff(top.node[bit]) > 0))].astype(np.int64)
        node.append(own >> 16 << 8 | (own & 255) >> (8 - bit) | 1 << bit)
        n0.append(top.counts[bit][0])
        n1.append(top.counts[bit][1])
        w.append(top.weighted[bit])
    return pa.table(dict(zip(("node", "n0", "n1", "weighted"), _total(*map(np.concatenate, (node, n0, n1, w))), strict=True)))


class Upper:
    """Depths BRANCH - 1 to 0: the numbers of nodes, their counts and log ratios."""

    def __init__(self, node, n0, n1, below):
        order = node.argsort()
        node, n0, n1, below = node[order], n0[order], n1[order], below[order]
        self.depths = {}
        for depth in range(BRANCH - 1, -1, -1):
            own = kt_log(n0, n1)
            self.depths[depth] = (node, n0, n1, own - below)
            node, n0, n1, below = _total(node >> 16 << 8 | node & 255, n0, n1, np.logaddexp(own, below) - math.log(2))

    def mix(self, depth: int, context: np.ndarray, prefix: np.ndarray, deeper, one):
        node, n0, n1, log_beta = self.depths[depth]
        at = node.searchsorted(context << 8 | prefix)
        return mixed(n0[at], n1[at], log_beta[at], deeper, one)


def gram_logs(key: np.ndarray, n: np.ndarray, upper: Upper) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context."""
    levels, out = branch_levels(key, n), np.zeros(len(key))
    byte = (key & _U(255)).astype(np.int64)
    contexts = {d: (key >> _U(8 * (DEPTH + 1 - d))).astype(np.int64) if d else np.zeros(len(key), np.int64) for d in range(BRANCH)}
    for bit in range(8):
        one = (byte >> (7 - bit) & 1).astype(bool)
        p = None
        for depth in range(DEPTH, BRANCH - 1, -1):
            p = levels[depth].mix(bit, p, one, levels[depth].at)
        prefix = byte >> (8 - bit) | 1 << bit
        for depth in range(BRANCH - 1, -1, -1):
            p = upper.mix(depth, contexts[depth], prefix, p, one)
        out += np.log10(p)
    return out


class GramTable:
    """Looks up values by gram: open addressing, all keys at once."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(len(key) * 2).bit_length())
        size = 1 << self.bits
        self.key, self.value = np.full(size, np.iinfo(_U).max), np.zeros(size)
        at, left = self._home(key), np.arange(len(key))
        self.steps = 0
        while len(left):
            self.steps += 1
            free = self.key[at] == np.iinfo(_U).max
            slot, first = np.unique(at[free], return_index=True)
            done = np.flatnonzero(free)[first]
            self.key[slot], self.value[slot] = key[left[done]], value[left[done]]
            rest = np.ones(len(left), bool)
            rest[done] = False
            left, at = left[rest], (at[rest] + 1) & (size - 1)

    def _home(self, key):
        return (key * _U(0x9E3779B97F4A7C15) >> _U(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        at = self._home(key)
        out = self.value[at]
        wrong = np.flatnonzero(self.key[at] != key)
        at = at[wrong]
        for _ in range(self.steps):
            if not len(wrong):
                return out
            at = (at + 1) & (len(self.key) - 1)
            out[wrong] = self.value[at]
            off = self.key[at] != key[wrong]
            wrong, at = wrong[off], at[off]
        if len(wrong):
            raise KeyError("a gram that wasn't counted")
        return out


def _steps(texts: list) -> list[tuple[int, int]]:
    """Ranges of documents of about STEP_BYTES."""
    out, begin, held = [], 0, 0
    for i, t in enumerate(texts):
        if i > begin and held + len(t or "") > STEP_BYTES:
            out.append((begin, i))
            begin, held = i, 0
        held += len(t or "")
    return [*out, (begin, len(texts))] if len(texts) > begin else out


_zstd, _unzstd = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _squeeze(values: np.ndarray) -> bytes:
    """Of little-endian values first all lowest bytes, and so on."""
    return _zstd.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _expand(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(_unzstd.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def _pack_grams(key: np.ndarray) -> bytes:
    return _squeeze(np.diff(key, prepend=_U(0)))


def _unpack_grams(data: bytes) -> np.ndarray:
    return _expand(data, "<u8").cumsum(dtype=_U)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key * _U(0xD6E8FEB86659FD93) >> _U(32)) % _U(buckets)).astype(np.int32)


def _lowest(hashes: np.ndarray) -> bytes:
    return np.sort(np.partition(hashes, LOWEST)[:LOWEST] if len(hashes) > LOWEST else hashes).astype("<i8").tobytes()


CHUNKS = "chunk int, words boolean, keys binary, counts binary, low binary"
PACKED = "chunk int, words boolean, bucket int, keys binary, counts binary"
SUMS = "words boolean, bucket int, chunks int, keys binary, counts binary"


def _count_chunk(table: pa.Table) -> pa.Table:
    """Two rows, of the grams and the words of the chunk with their counts in training texts, and their lowest hashes.

    The end token is the empty word.
    """
    chunk, texts, training = table["chunk"][0].as_py(), table["text"].to_pylist(), table["training"].to_pylist()
    words: Counter = Counter()
    other: set[bytes] = {b""}
    keys, counts = [], []
    for begin, end in _steps(texts):
        for learn in (True, False):
            docs = [words_of(t) for t, x in zip(texts[begin:end], training[begin:end], strict=True) if x is learn]
            if not docs:
                continue
            if learn:
                for d in docs:
                    words.update(d)
                words[b""] += len(docs)
            else:
                for d in docs:
                    other.update(d)
            key = grams_of(docs)[0]
            key.sort()
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            keys.append(key[first])
            counts.append(np.diff(np.append(first, len(key))) if learn else np.zeros(len(first), np.int64))
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(inverse, np.concatenate(counts), len(key)).astype("<u4")
    for w in other.difference(words):
        words[w] = 0
    order = sorted(words)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, order), _U, len(order))
    return pa.table(
        {
            "chunk": pa.array([chunk] * 2, pa.int32()),
            "words": [False, True],
            "keys": [_pack_grams(key), _zstd.compress(END.join(order))],
            "counts": [_squeeze(n), _squeeze(np.array([words[w] for w in order], "<u4"))],
            "low": [_lowest((key * _U(0x9E3779B97F4A7C15) ^ key >> _U(29)).view(np.int64)), _lowest(hashes.view(np.int64))],
        }
    )


def _distinct(counted: DataFrame, words: bool) -> float:
    """How many different grams, or words, there are in all chunks, by the LOWEST lowest of their hashes."""

    def spread(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"h": np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8")})

    rows = counted.where(F.col("words") == words).select("low").mapInArrow(spread, "h long").distinct().orderBy("h").limit(LOWEST).collect()
    return len(rows) if len(rows) < LOWEST else (LOWEST - 1) / ((rows[-1][0] + 2.0**63) / 2.0**64)


def _split(batches, buckets: int):
    """PACKED rows of the rows of chunks."""
    types = [pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()]
    for batch in batches:
        for chunk, words, keys, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            n, out = _expand(counts, "<u4"), []
            if words:
                key = _unzstd.decompress(keys).split(END)
                home = np.fromiter(map(zlib.crc32, key), np.int64, len(key)) % buckets
            else:
                key = _unpack_grams(keys)
                home = _bucket(key, buckets)
            order = home.argsort(kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
                packed = _zstd.compress(END.join([key[i] for i in at.tolist()])) if words else _pack_grams(key[at])
                out.append((chunk, words, int(home[at[0]]), packed, _squeeze(n[at].astype("<u8"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["chunk", "words", "bucket", "keys", "counts"])


def _merge(key: tuple, table: pa.Table) -> pa.Table:
    """One row of the sums of a bucket's rows."""
    words, bucket, chunks = (k.as_py() for k in key)
    counts = [_expand(x, "<u8") for x in table["counts"].to_pylist()]
    if words:
        total: Counter = Counter()
        for keys, n in zip(table["keys"].to_pylist(), counts, strict=True):
            for w, c in zip(_unzstd.decompress(keys).split(END), n.tolist(), strict=True):
                total[w] += c
        order = sorted(total)
        packed, sums = _zstd.compress(END.join(order)), np.fromiter(map(total.__getitem__, order), "<u8", len(order))
    else:
        own, inverse = np.unique(np.concatenate([_unpack_grams(x) for x in table["keys"].to_pylist()]), return_inverse=True)
        packed, sums = _pack_grams(own), np.bincount(inverse, np.concatenate(counts), len(own)).astype("<u8")
    columns = {"words": pa.array([words]), "bucket": pa.array([bucket], pa.int32()), "chunks": pa.array([chunks], pa.int32()), "keys": [packed], "counts": [_squeeze(sums)]}
    return pa.table(columns)


def _sums(packed: DataFrame, chunks: int) -> DataFrame:
    """The sums of all chunks: a row for each bucket of grams and of words."""
    rows = packed.withColumnRenamed("chunk", "chunks")
    while True:
        rows = rows.withColumn("chunks", F.floor(F.col("chunks") / FAN).cast("int"))
        rows = cut(rows.groupBy("words", "bucket", "chunks").applyInArrow(_merge, SUMS), "sums", "uncompressed")
        chunks = -(-chunks // FAN)
        if chunks <= 1:
            return rows


def _word_totals(batches):
    for batch in batches:
        n = [_expand(x, "<u8") for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_pydict({"tokens": pa.array([int(x.sum()) for x in n], pa.int64()), "kinds": pa.array([int((x > 0).sum()) for x in n], pa.int64())})


def _open_grams(batches):
    """gram, n of packed sums."""
    for batch in batches:
        for keys, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            yield pa.RecordBatch.from_pydict({"gram": _unpack_grams(keys).astype(np.int64), "n": _expand(counts, "<u8").astype(np.int64)})


def _packed_logs(key: np.ndarray, value: np.ndarray, buckets: int) -> pa.Table:
    """The log10 probabilities of grams, a row for each bucket."""
    home = _bucket(key, buckets)
    order = np.lexsort((key, home))
    at = np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(key) else []
    return pa.table({"bucket": pa.array([int(home[x[0]]) for x in at], pa.int32()), "keys": pa.array([_pack_grams(key[x]) for x in at], pa.binary()), "counts": pa.array([_squeeze(value[x].astype("<f4")) for x in at], pa.binary())})


def _join_logs(key: tuple, table: pa.Table) -> pa.Table:
    """All rows of a bucket as one."""
    gram = np.concatenate([_unpack_grams(x) for x in table["keys"].to_pylist()])
    value = np.concatenate([_expand(x, "<f4") for x in table["counts"].to_pylist()])
    order = gram.argsort()
    return pa.table({"words": [False], "bucket": pa.array([key[0].as_py()], pa.int32()), "keys": [_pack_grams(gram[order])], "counts": [_squeeze(value[order])]})


def _give_back(rows: pa.Table, found: pa.Table) -> pa.Table:
    """The rows of some chunks for a bucket with the values of the whole corpus: counts of words, logs of grams."""
    if not rows.num_rows:
        return rows.select(["chunk", "words", "keys"]).append_column("values", pa.array([], pa.binary()))
    keys, counts = found["keys"][0].as_py(), found["counts"][0].as_py()
    if rows["words"][0].as_py():
        total = dict(zip(_unzstd.decompress(keys).split(END), _expand(counts, "<u8").tolist(), strict=True))
        values = [_squeeze(np.array([total[w] for w in _unzstd.decompress(x).split(END)], "<u8")) for x in rows["keys"].to_pylist()]
    else:
        gram, value = _unpack_grams(keys), _expand(counts, "<f4")
        values = [_squeeze(value[gram.searchsorted(_unpack_grams(x))]) for x in rows["keys"].to_pylist()]
    return pa.table([rows["chunk"], rows["words"], rows["keys"], pa.array(values, pa.binary())], names=["chunk", "words", "keys", "values"])


def _score_chunk(docs: pa.Table, model: pa.Table, tokens: int, distinct: int) -> pa.Table:
    below = math.log10(tokens + 0.5 * (distinct + 1))
    base: dict[bytes, tuple[float, bool]] = {}
    keys, values = [], []
    for words, key, value in zip(model["words"].to_pylist(), model["keys"].to_pylist(), model["values"].to_pylist(), strict=True):
        if words:
            n = _expand(value, "<u8")
            base.update(zip(_unzstd.decompress(key).split(END), zip((np.log10(n + 0.5) - below).tolist(), (n > 0).tolist(), strict=True), strict=True))
        else:
            keys.append(_unpack_grams(key))
            values.append(_expand(value, "<f4").astype(np.float64))
    table = GramTable(np.concatenate(keys), np.concatenate(values))
    texts = docs["text"].to_pylist()
    n_tokens, n_known, base_score, score, n_bytes = [], [], [], [], []
    for begin, end in _steps(texts):
        parts = [words_of(t) for t in texts[begin:end]]
        key, sizes = grams_of(parts)
        score += np.add.reduceat(table.get(key), sizes.cumsum() - sizes).tolist()
        n_bytes += sizes.tolist()
        for p in parts:
            found = [base[w] for w in (*p, b"")]
            n_tokens.append(len(found))
            n_known.append(sum(k for _, k in found))
            base_score.append(math.fsum(s for s, _ in found))
    training = docs["training"].to_pylist()
    columns = {
        "id": docs["id"],
        "held_out": pa.array([not x for x in training], pa.bool_()),
        "n_tokens": pa.array(n_tokens, pa.int64()),
        "n_known": pa.array(n_known, pa.int64()),
        "train_tokens": pa.array([tokens] * len(texts), pa.int64()),
        "base_score": pa.array(base_score, pa.float64()),
        "score": pa.array(score, pa.float64()),
        "bits_per_byte": pa.array([-s * math.log2(10) / n for s, n in zip(score, n_bytes, strict=True)], pa.float64()),
    }
    return pa.table(columns)


def _by_branch(counts: DataFrame, run, schema: str) -> DataFrame:
    """run(key, n) on groups of whole branches."""

    def each(table):
        return run(table["gram"].to_numpy().astype(_U), table["n"].to_numpy().astype(np.float64))

    return counts.groupBy("part").applyInArrow(each, schema)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    bits_per_byte is the code length of the text by the model, over the bytes that are coded.

    Learns from rows whose crc32 of the id, modulo folds, isn't held_out. A null text
    is empty: its only token is the end. Rows that repeat count as often as they
    stand. With no training rows all counts are 0 and nothing is known. No rows
    for no documents.
    """
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (fold(id_col, folds) != held_out).alias("training"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(size / chunk_bytes))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))
    counted = cut(rows.groupBy("chunk").applyInArrow(_count_chunk, CHUNKS), "chunk-counts", "uncompressed")
    buckets = max(1, math.ceil(max(_distinct(counted, False) / BUCKET_GRAMS, _distinct(counted, True) / BUCKET_WORDS)))
    packed = counted.select("chunk", "words", "keys", "counts").mapInArrow(lambda batches: _split(batches, buckets), PACKED)
    packed = cut(packed, "packed", "uncompressed")
    discard(counted)
    sums = _sums(packed, chunks)
    totals = sums.where("words").select("counts").mapInArrow(_word_totals, "tokens long, kinds long")
    tokens, distinct = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    grams = cut(sums.where("not words").select("keys", "counts").mapInArrow(_open_grams, "gram long, n long"), "grams")
    parts = max(1, math.ceil(grams.count() / GROUP_GRAMS))
    branch = F.shiftright("gram", 8 * (DEPTH + 1 - BRANCH))
    grams = grams.withColumn("part", F.pmod(F.xxhash64(branch), F.lit(parts)).cast("int"))
    # contexts of under BRANCH bytes by 255 nodes
    roots = _by_branch(grams, branch_roots, "node long, n0 double, n1 double, weighted double")
    above = roots.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "weighted")]).toArrow()
    upper = Upper(*[above[c].to_numpy().astype(np.float64 if c != "node" else np.int64) for c in ("node", "n0", "n1", "weighted")])
    shared = docs.sparkSession.sparkContext.broadcast(upper)

    def logs(k, n):
        return _packed_logs(k, gram_logs(k, n, shared.value), buckets)

    values = _by_branch(grams, logs, "bucket int, keys binary, counts binary")
    values = values.groupBy("bucket").applyInArrow(_join_logs, "words boolean, bucket int, keys binary, counts binary")
    values = sums.where("words").select("words", "bucket", "keys", "counts").union(values)
    # a group of chunks needs about NEEDS times a whole bucket, so what is copied stays a share of what it meets
    size_of = lambda rows: rows.where("not words").agg(F.sum(F.octet_length("keys"))).first()[0] or 1
    groups = min(chunks, max(1, math.ceil(size_of(packed) / (NEEDS * size_of(sums)))))
    fan = -(-chunks // groups)
    values = values.withColumn("chunks", F.explode(F.sequence(F.lit(0), F.lit((chunks - 1) // fan))))
    at = ["words", "bucket", "chunks"]
    mine = packed.withColumn("chunks", F.floor(F.col("chunk") / fan).cast("int"))
    back = mine.groupBy(*at).cogroup(values.groupBy(*at)).applyInArrow(_give_back, "chunk int, words boolean, keys binary, values binary")
    schema = f"id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    scored = rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(lambda d, m: _score_chunk(d, m, tokens, distinct), schema)
    return scored.withColumnRenamed("id", id_col)
