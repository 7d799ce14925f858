"""Byte-level BPE: corpus-level merge replay over the distinct words of a batch.

All new words of a batch lie in one array of symbols with links to the next and
the previous one. An inverted index leads from a merge's rank to the positions
where its token pair stands. Merges are applied in rank order, each at all its
positions at once; only the pairs with the touched neighbours are looked up again.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from .common import hold, slices

#: Bytes that a worker's memory of pieces and their ids may take, and what an entry takes beside its piece.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 200


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = keys.argsort()
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.values = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], -1)

    def _rank(self, left, right):
        """Rank of the merge of each pair; -1 where there is none."""
        key = left << 32 | right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def one(self, word: bytes) -> list[int]:
        """The same by definition, a merge at a time."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(words)
        rest = []
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif word:
                rest.append(i)
            else:
                out[i] = b""
        for i, ids in zip(rest, self._replay([words[i] for i in rest]) if rest else (), strict=True):
            out[i] = ids
        return out

    def _replay(self, words: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = sizes.cumsum()
        n = int(ends[-1])
        sym = np.append(self.single[np.frombuffer(b"".join(words), np.uint8)], -1)  # the last one stands for "none"
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        nxt[ends - 1] = n
        prv[ends - sizes] = n
        odd: set[int] = set()
        index: dict[int, list] = {}
        queue: list[int] = []

        def add(at, now):
            """Index the pairs that begin at these positions."""
            rank = self._rank(sym[at], sym[nxt[at]])
            keep = rank >= 0
            at, rank = at[keep], rank[keep]
            if not len(at):
                return
            if (early := rank < now).any():  # a merge that should have come before: these words are done by definition
                odd.update(ends.searchsorted(at[early], "right").tolist())
            order = rank.argsort(kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(queue, r)

        first = np.arange(n)
        add(first[nxt[:n] < n], -1)
        while queue:
            r = heapq.heappop(queue)
            found = index.pop(r)
            at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
            at = at[sym[at] >= 0]
            at = at[nxt[at] < n]
            at = at[self._rank(sym[at], sym[nxt[at]]) == r]
            if not len(at):
                continue
            right = nxt[at]
            joined = np.append(False, right[:-1] == at[1:])
            if joined.any():  # of overlapping pairs every second one, from the left
                place = np.arange(len(at))
                since = np.maximum.accumulate(np.where(joined, 0, place))
                keep = (place - since) % 2 == 0
                at, right = at[keep], right[keep]
            after = nxt[right]
            sym[at], sym[right] = r, -1
            nxt[at], prv[after] = after, at
            nxt[n], prv[n], sym[n] = n, n, -1
            before = prv[at]
            touched = np.concatenate((before[before < n], at[after < n]))
            if len(touched):
                add(np.unique(touched), r)
        alive = sym[:n] >= 0
        counts = np.add.reduceat(alive, ends - sizes, dtype=np.int64)
        raw, stops = sym[:n][alive].astype("<u4").tobytes(), (counts.cumsum() * 4).tolist()
        out = [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        for i in odd:
            out[i] = np.array(self.one(words[i]), "<u4").tobytes()
        return out


class Encoder:
    """Splits texts by the pattern and replays merges over the words not seen before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay, self.pattern = MergeReplay(ranks), regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.held = 0

    #: A space before another white space, or at the end: runs that must not be parted.
    RUN = regex.compile(r" \s| \Z")

    def pieces(self, text: str) -> list[str]:
        """Parts of the text that the pattern matches independently of each other.

        A space before something that isn't white space always begins a match.
        """
        if self.RUN.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.pieces(t) for t in texts]
        new = {p for x in parts for p in x}.difference(self.known)
        self.held += sum(map(len, new)) + ENTRY_BYTES * len(new)
        if self.held > CACHE_BYTES and self.known:
            self.known = {}
            new = {p for x in parts for p in x}
            self.held = sum(map(len, new)) + ENTRY_BYTES * len(new)
        split = {p: self.pattern.findall(p) for p in new}
        words = list({w for x in split.values() for w in x})
        ids = dict(zip(words, self.replay.encode([w.encode() for w in words]), strict=True))
        self.known.update((p, b"".join([ids[w] for w in x])) for p, x in split.items())
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encoder(name: str, pattern: str) -> Encoder:
    return hold(("byte_bpe", name, pattern), lambda: Encoder(read_ranks(SparkFiles.get(name)), pattern))


def ship(spark, path: str) -> str:
    """Let every executor have the vocabulary file; returns the name it has there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with one more column: the ids of text_col as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. All other columns pass through unchanged,
    whatever their names, except one named like out_col, which is replaced.
    """
    name = ship(docs.sparkSession, ranks_path)
    kept = docs.drop(out_col)
    at = kept.columns.index(text_col)

    def encode(batches):
        encoder = _encoder(name, pattern)
        for batch in slices(batches, at):
            ids = encoder.encode([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, out_col])

    return kept.mapInArrow(encode, StructType([*kept.schema.fields, StructField(out_col, BinaryType())]))


def bpe_decode(rows: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with one more column: the bytes that ids_col stands for; null ids give null."""
    name = ship(rows.sparkSession, ranks_path)
    kept = rows.drop(out_col)
    at = kept.columns.index(ids_col)

    def decode(batches):
        encoder = _encoder(name, pattern)
        for batch in slices(batches, at):
            data = [None if x is None else encoder.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, out_col])

    return kept.mapInArrow(decode, StructType([*kept.schema.fields, StructField(out_col, BinaryType())]))


def bpe_encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids", exact_col: str = "exact") -> DataFrame:
    """docs with out_col as bpe_encode has it, and exact_col: whether the ids decode to the text's bytes.

    Columns of docs that are named like either are replaced.
    """
    name = ship(docs.sparkSession, ranks_path)
    kept = docs.drop(out_col, exact_col)
    at = kept.columns.index(text_col)

    def encode(batches):
        encoder = _encoder(name, pattern)
        for batch in slices(batches, at, 4 << 20):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            ids = encoder.encode(texts)
            exact = [encoder.decode(x) == t.encode() for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(exact, pa.bool_())], names=[*batch.schema.names, out_col, exact_col])

    return kept.mapInArrow(encode, StructType([*kept.schema.fields, StructField(out_col, BinaryType()), StructField(exact_col, BooleanType())]))


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids: id, n_tokens, ids_sha256, decoded_sha256 per row of docs.

    Both run in one pass, so that an executor holds one encoder per core and neither
    texts nor ids go back to the JVM.
    """
    name, key = ship(docs.sparkSession, ranks_path), docs.schema[id_col].dataType.simpleString()

    def digest(batches):
        encoder = _encoder(name, pattern)
        for batch in slices(batches, 1, 4 << 20):
            ids = encoder.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(digest, f"{id_col} {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")
