"""Token ids as binary output: bundles of independent zstandard frames.

Documents are range partitioned by id and sorted, so bundles follow each other in
ascending order. A frame holds the ids of consecutive documents; the index gives
every document its frame, the offset in it and its number of tokens. Bundles are
rows of a table in the shared folder, (shard, bundle, first_id, last_id, n_docs,
n_tokens, content), which Spark writes and reads wherever that folder is.
"""

from __future__ import annotations

import os
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import ship
from .common import cut, hold, slices
from .seekable import BundleReader, BundleWriter

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 4 << 20
#: Up to so many bundles their starts, 24 bytes each, are broadcast.
BROADCAST_BUNDLES = 500_000
#: Pieces whose ids a worker remembers between tasks.
CACHE = 800_000
#: Pieces that are encoded as the lines of one text.
LINES = 5_000
#: A document in the index. has_id 0: its id is null.
ENTRY = np.dtype([("has_id", "u1"), ("id", "<i8"), ("frame", "<u4"), ("offset", "<u4"), ("n", "<u8")])


class PieceTokenizer:
    """Encodes with a byte-level tokenizer of the tokenizers library, each distinct piece of text once.

    A space before something that isn't white space always begins a word of the
    byte-level pre-tokenizer, a single line feed is one of its own, and so are signs
    after letters, so pieces that are cut there are independent. A text with other
    white space together, or with an added token of the vocabulary, goes to the library
    as it is. Pieces that came back are remembered longest.
    """

    #: White space together that mustn't be parted.
    RUN = re.compile(r"[ \n](?:(?<= )(?:\s|\Z)|(?<=\n)[^\S ]|(?<=[^\S \n]\n))")
    #: White space other than what stands between lines of pieces.
    ODD = re.compile(r"[^\S\n ]")
    #: Signs that may follow letters; the apostrophe, which may begin a word, isn't one.
    MARKS = string.punctuation.replace("'", "")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._added = re.compile("|".join(added)) if added else None
        self._feed = self._encode(["\n"])[0]
        #: ids by piece: after a line feed, which it begins with, or without the space before it
        self.known: dict[str, bytes] = {"": b""}
        #: pieces that were met again
        self.again: set[str] = set()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(x, "<u4").tobytes() for x in self._encode(texts)]

    def _lines(self, pieces: list[str], space: str) -> None:
        """Learn pieces as the lines of one text: each after a space, or beginning with a line feed."""
        for begin in range(0, len(pieces), LINES):
            part = pieces[begin : begin + LINES]
            text = "".join(part) if not space else "\n" + space + ("\n" + space).join(part)
            ids = np.array(self._encode([text])[0], "<u4") if not self.ODD.search(text) else np.zeros(0, "<u4")
            starts = (np.flatnonzero(ids == self._feed[0]) * 4).tolist()
            if len(starts) == len(part):
                raw, skip = ids.tobytes(), 4 if space else 0
                self.known.update((p, raw[a + skip : b]) for p, a, b in zip(part, starts, [*starts[1:], len(raw)], strict=True))
            else:
                self.known.update(zip(part, self._alone([space + p for p in part]), strict=True))

    def _learn(self, new: set[str]) -> None:
        known, order = self.known, list(new)
        words = [p.rstrip(self.MARKS) for p in order]
        whole = {p for p, word in zip(order, words, strict=True) if len(p) == len(word)}
        marked = []
        for p, word in zip(order, words, strict=True):
            if len(word) < len(p):
                if word.isalpha() or word[:1] == "\n" and word[1:].isalpha():
                    marked.append((p, word, p[len(word) :]))
                    if word not in known:
                        whole.add(word)
                else:
                    whole.add(p)
        begin = [p for p in whole if p[0] == "\n"]
        after = [p for p in whole if p[0] != "\n"]
        self._lines(after, " ")
        self._lines(begin, "")
        marks = list({m for *_, m in marked})
        ids = dict(zip(marks, self._alone(marks), strict=True))
        known.update([(p, known[word] + ids[m]) for p, word, m in marked])

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [len(self._feed) > 1 or bool(self.RUN.search(t) or self._added and self._added.search(t)) for t in texts]
        # as if after a line feed, whose id is taken off again
        parts = [[] if w else ("\n" + t).replace("\n", " \n").split(" ") for t, w in zip(texts, whole, strict=True)]
        seen = set().union(*parts)
        new = seen.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known = {p: self.known[p] for p in self.again} if len(self.again) < CACHE // 2 else {}
            self.known[""] = b""
            self.again = set()
            new = seen.difference(self.known)
        self.again |= seen - new
        self._learn(new)
        get, rest = self.known.__getitem__, iter(self._alone([t for t, w in zip(texts, whole, strict=True) if w]))
        return [next(rest) if w else b"".join(map(get, x))[4:] for x, w in zip(parts, whole, strict=True)]


def _tokenizer(name: str) -> PieceTokenizer:
    return hold(("token_frames", name), lambda: PieceTokenizer(SparkFiles.get(name)))


class _Shard:
    """Collects documents in order and gives out bundles."""

    def __init__(self, frame_bytes: int, bundle_bytes: int):
        self.frame_bytes, self.bundle_bytes, self.number = frame_bytes, bundle_bytes, 0
        self._begin()

    def _begin(self):
        self.writer, self.frame, self.held, self.entries = BundleWriter(), [], 0, []

    def _flush(self):
        if self.frame:
            self.writer.add(b"".join(self.frame))
            self.frame, self.held = [], 0

    def add(self, doc_id, ids: bytes):
        """Returns a bundle if one is full."""
        if self.held and self.held + len(ids) > self.frame_bytes:
            self._flush()
        self.entries.append((doc_id is not None, doc_id or 0, len(self.writer._table), self.held, len(ids) // 4))
        self.frame.append(ids)
        self.held += len(ids)
        return self.close() if self.writer.size >= self.bundle_bytes else None

    def close(self):
        if not self.entries:
            return None
        self._flush()
        index = np.array(self.entries, ENTRY)
        ids = index["id"][index["has_id"] == 1]
        row = (self.number, int(ids[0]) if len(ids) else None, int(ids[-1]) if len(ids) else None, len(index), int(index["n"].sum()), self.writer.finish(index.tobytes()))
        self.number += 1
        self._begin()
        return row


BUNDLES = "shard int, bundle int, first_id long, last_id long, n_docs long, n_tokens long, content binary"


def write_bundles(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """The table of bundles. A null text is empty, so it has the end id alone.

    Order: ascending id, null ids first, equal ids by a hash of the text. Ids must be integers.
    """
    name = ship(docs.sparkSession, tokenizer_path)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the range is sampled by id and a hash, so that no text reaches the driver
    rows = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange("id", "hash").sortWithinPartitions("id", "hash", "text")
    rows = rows.select("id", "text", F.spark_partition_id().alias("shard"))
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        tokenizer, shard, number = _tokenizer(name), _Shard(frame_bytes, bundle_bytes), None
        to_batch = lambda full: pa.RecordBatch.from_pydict(dict(zip(schema.names, [[x] for x in (number, *full)], strict=True)), schema=schema)
        for batch in slices(batches, 1):
            number = batch.column(2)[0].as_py()
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encode(batch.column(1).to_pylist()), strict=True):
                if full := shard.add(doc_id, ids + end):
                    yield to_batch(full)
        if full := shard.close():
            yield to_batch(full)

    schema = pa.schema([("shard", pa.int32()), ("bundle", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("content", pa.binary())])
    return cut(rows.mapInArrow(encode, BUNDLES), "token-bundles", "uncompressed")


def documents_in(bundle: bytes, wanted: set | None = None):
    """(id, ids as bytes) of the documents of a bundle in order; with wanted, only frames that hold those are opened."""
    reader = BundleReader(bundle)
    frame, content = -1, b""
    for has_id, doc_id, number, offset, n in np.frombuffer(reader.index, ENTRY).tolist():
        doc_id = doc_id if has_id else None
        if wanted is not None and doc_id not in wanted:
            continue
        if number != frame:
            frame, content = number, reader.frame(number)
        yield doc_id, content[offset : offset + 4 * n]


def find_documents(bundles: DataFrame, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """id, ids (as bytes) of the documents with these ids, a stated query set.

    first_id and last_id prune the bundles by the statistics of the files; of a
    bundle that is left, only the frames that hold a wanted document are decompressed.
    """
    wanted = sorted(set(ids))
    if not wanted:
        return bundles.select(F.col("first_id").alias(id_col), F.col("content").alias("ids")).where("false")
    inside = F.exists(F.array(*map(F.lit, wanted)), lambda i: (i >= F.col("first_id")) & (i <= F.col("last_id")))
    rows = bundles.where((F.col("last_id") >= wanted[0]) & (F.col("first_id") <= wanted[-1])).where(inside)

    def find(batches):
        look = set(wanted)
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                found = list(documents_in(bundle, look))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=[id_col, "ids"])

    return rows.select("content").mapInArrow(find, f"{id_col} long, ids binary")


def read_bundles(bundles: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document from the files: id, start, n_tokens, ids_crc32.

    start counts the ids of all documents before it. Sums go from shards (one row
    each) to the bundles of a shard to the documents of a bundle.
    """
    shards = bundles.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("bundle").rowsBetween(Window.unboundedPreceding, -1)
    starts = bundles.select("shard", "bundle", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside")).join(shards, "shard")
    if bundles.count() <= BROADCAST_BUNDLES:  # then the contents needn't be shuffled
        starts = F.broadcast(starts)
    rows = bundles.select("shard", "bundle", "content").join(starts, ["shard", "bundle"]).select(F.col("base") + F.col("inside"), "content")

    def decode(batches):
        for batch in batches:
            for base, bundle in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                who, at, n, crc = [], [], [], []
                for doc_id, ids in documents_in(bundle):
                    who.append(doc_id)
                    at.append(base)
                    n.append(len(ids) // 4)
                    crc.append(zlib.crc32(ids))
                    base += n[-1]
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(decode, f"{id_col} long, start long, n_tokens long, ids_crc32 long")
