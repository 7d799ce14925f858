"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are windows of consecutive words of benchmark items. A fixed table,
addressed by a hash of a block of two words, says how far a position can be
skipped; where it says zero, the bucket of that suffix block holds the ends of
windows, which are compared word by word. Windows are kept as positions in the
items' words, so a matcher takes some 10 words of memory per item word.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import cut, discard, hold, slices

WINDOW = 10
#: Benchmark text per broadcast; a larger benchmark passes over the documents block by block.
BLOCK_BYTES = 16 << 20
#: Word bytes: 0-9, a-z and every byte of a non-ASCII character; A-Z become lower case.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORDS).split() if text else []


class Matcher:
    """Windows of one length in the words of items of that length at least."""

    def __init__(self, items: list[tuple[str, list[bytes]]], length: int):
        self.length, self.block = length, min(2, length)
        self.names = [name for name, _ in items]
        sizes = np.array([len(w) for _, w in items])
        self.words = [w for _, found in items for w in found]
        self.starts = sizes.cumsum() - sizes
        #: where blocks end in the words of all, and how many words of their item that makes
        ends = np.concatenate([np.arange(a + self.block, a + n + 1) for a, n in zip(self.starts, sizes, strict=True)])
        inside = np.concatenate([np.arange(self.block, n + 1) for n in sizes])
        self.mask = (1 << max(10, int(4 * len(ends)).bit_length())) - 1
        words = self.words
        slot = np.fromiter((self.slot(words, e) for e in ends.tolist()), np.int64, len(ends))
        away = np.maximum(0, length - inside)
        shift = np.full(self.mask + 1, length - self.block + 1, np.uint8)
        np.minimum.at(shift, slot, away.astype(np.uint8))
        self.shift = shift.tobytes()
        slot, ends = slot[away == 0], ends[away == 0]
        order = slot.argsort(kind="stable")
        self.ends, self.first = ends[order], slot[order].searchsorted(np.arange(self.mask + 2)).astype(np.int32)

    def slot(self, words: list[bytes], end: int) -> int:
        """Of the block of words before end."""
        return (crc32(words[end - 1], crc32(words[end - 2]) if self.block == 2 else 0)) & self.mask

    def find(self, words: list[bytes]):
        """(start, item) of every occurrence, overlapping ones too."""
        length, shift, slot, at, n = self.length, self.shift, self.slot, self.length, len(words)
        while at <= n:
            key = slot(words, at)
            away = shift[key]
            if away:
                at += away
                continue
            here = words[at - length : at]
            for end in self.ends[self.first[key] : self.first[key + 1]].tolist():
                if self.words[end - length : end] == here:
                    yield at - length, self.names[int(self.starts.searchsorted(end, "left")) - 1]
            at += 1


def build(items: list[tuple[str, str]], size: int = WINDOW) -> list[Matcher]:
    by_length: dict[int, list] = defaultdict(list)
    interned: dict[bytes, bytes] = {}
    for item, text in items:
        if words := [interned.setdefault(w, w) for w in words_of(text)]:
            by_length[min(size, len(words))].append((item, words))
    return [Matcher(found, n) for n, found in sorted(by_length.items())]


def scan(text: str | None, matchers: list[Matcher]) -> tuple[int, list[list[int]], set]:
    """Number of words, merged [start, end) spans that are hit, items that occur."""
    words, found, items = words_of(text), set(), set()
    for m in matchers:
        for start, who in m.find(words):
            found.add((start, start + m.length))
            items.add(who)
    spans: list[list[int]] = []
    for start, end in sorted(found):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return len(words), spans, items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str):
    """Broadcasts of (item, text) pairs of BLOCK_BYTES each, with a name."""
    context, block, held = benchmark.sparkSession.sparkContext, [], 0
    for row in benchmark.select(F.col(item_col).cast("string"), text_col).where(f"{item_col} is not null and {text_col} is not null").toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1])
        if held >= BLOCK_BYTES:
            yield context.broadcast(block), uuid.uuid4().hex
            block, held = [], 0
    yield context.broadcast(block), uuid.uuid4().hex


def _pass(rows: DataFrame, block, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Run a pass: its result as a table, twice; the block that was broadcast for it goes, and so does the table it read."""
    table = cut(rows, "searched")
    block.destroy()
    if before is not None:
        discard(before)
    return table, table


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: id, n_words, spans (word positions, merged), item_ids (sorted as text).

    A window is `window` consecutive words of an item; an item of fewer, but not
    none, is one window. A null or wordless text has n_words 0 and no hits. Items
    with a null id or text are left out; items that repeat count once. No rows for no
    documents; an empty benchmark hits nothing. The benchmark is the query set:
    blocks of BLOCK_BYTES of it are broadcast, and every block passes over all
    documents; from the second on, they are read from a table that the pass before wrote.
    """
    key = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<start:int,end:int>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumns(
        {"n_words": F.lit(0), "spans": F.lit(None).cast(spans), "item_ids": F.lit(None).cast("array<string>")}
    )
    blocks, last, table = 0, None, None
    for shared, token in _blocks(benchmark, item_col, item_text_col):
        if last is not None:
            rows, table = _pass(rows, last, table)
        blocks, last = blocks + 1, shared

        def search(batches, shared=shared, token=token):
            matchers = hold(("wu_manber", token), lambda: build(shared.value, window))
            for batch in slices(batches, 1):
                n_words, all_spans, all_items = [], [], []
                for text, before, items in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                    n, found, who = scan(text, matchers)
                    n_words.append(n)
                    all_spans.append((before or []) + [{"start": a, "end": b} for a, b in found])
                    all_items.append(sorted(who.union(items or ())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n_words, pa.int32()), pa.array(all_spans, batch.schema.field(3).type), pa.array(all_items, batch.schema.field(4).type)],
                    schema=batch.schema,
                )

        rows = rows.mapInArrow(search, f"id {key}, text string, n_words int, spans {spans}, item_ids array<string>")
    merged = F.col("spans")
    if blocks > 1:  # spans of several blocks may touch
        acc = F.array().cast(spans)
        merged = F.aggregate(
            F.array_sort("spans"),
            acc,
            lambda a, x: F.when(
                (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= x["start"]),
                F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end")))),
            ).otherwise(F.concat(a, F.array(x))),
        )
    return rows.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), merged.alias("spans"), "item_ids")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no window of an item occurs."""
    at = docs.columns.index(text_col)
    last, table = None, None
    for shared, token in _blocks(benchmark, item_col, item_text_col):
        if last is not None:
            docs, table = _pass(docs, last, table)
        last = shared

        def run(batches, shared=shared, token=token):
            matchers = hold(("wu_manber", token), lambda: build(shared.value, window))
            for batch in slices(batches, at):
                hit = [any(True for m in matchers for _ in m.find(words)) for words in map(words_of, batch.column(at).to_pylist())]
                yield batch.filter(pa.array([not x for x in hit], pa.bool_()))

        docs = docs.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in docs.schema]))
    return docs
