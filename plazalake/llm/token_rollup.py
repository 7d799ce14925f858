"""Token counts as rollups that signed deltas maintain.

Totals by source, language and tokenizer version are sums, so an insert adds a
document's count, a delete takes it away and a revised count does both. A batch is
aggregated to one row per key before it is written, under its own id; a batch
that is there already isn't written again, whoever repeats it. Totals add up all
committed batches; compact() folds them into one and keeps their ids.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import CACHE_BYTES, ENTRY_BYTES, Encoder, MergeReplay, read_ranks, ship
from .common import hold, slices
from .word_bpe import SMALL, TOGETHER, fill_rows, merge_rows, tree_size

KEYS = ["source", "lang", "version"]
DELTAS = "source string, lang string, version string, n_docs long, n_tokens long"


def _times(rows: DataFrame) -> Column:
    """How many documents a row stands for: its column times, else one."""
    return F.col("times").cast("long") if "times" in rows.columns else F.lit(1).cast("long")


def inserts(counts: DataFrame) -> DataFrame:
    """Deltas of (source, lang, version, n_tokens) rows, times each, that come to the corpus."""
    n = _times(counts)
    return counts.select(*KEYS, n.alias("n_docs"), (F.col("n_tokens").cast("long") * n).alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Deltas of rows that leave."""
    return inserts(counts).select(*KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))


def revisions(changes: DataFrame) -> DataFrame:
    """Deltas of (source, lang, version, old_tokens, new_tokens) rows, times each: documents stay, counts change."""
    change = (F.col("new_tokens") - F.col("old_tokens")).cast("long") * _times(changes)
    return changes.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), change.alias("n_tokens"))


class Rollup:
    """A folder of committed batches, on any file system that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _state(self) -> tuple[str | None, set[str], list[str]]:
        """The newest compaction, the ids folded into it, and the ids of batches beside it; one listing of the folder."""
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))] if self._fs.exists(self._path(self.path)) else []
        base = max((x for x in found if x.startswith("base=")), key=lambda x: int(x.removeprefix("base=")), default=None)
        folded = {r[0] for r in self.spark.read.schema("id string").parquet(f"{self.path}/{base}/ids").collect()} if base else set()
        return base, folded, [x for x in sorted(unquote(y.removeprefix("batch=")) for y in found if y.startswith("batch=")) if x not in folded]

    def _at(self, batch_id: str) -> str:
        """The folder of a batch; an id may hold any characters."""
        return f"{self.path}/batch={quote(batch_id, safe='')}"

    def has(self, batch_id: str) -> bool:
        """Whether that id was committed; ids that were folded are looked up in their table, not gathered."""
        if self._fs.exists(self._path(self._at(batch_id))):
            return True
        if not self._fs.exists(self._path(self.path)):
            return False
        bases = [x for x in (s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))) if x.startswith("base=")]
        newest = max(bases, key=lambda x: int(x.removeprefix("base=")), default=None)
        return bool(newest) and bool(self.spark.read.schema("id string").parquet(f"{self.path}/{newest}/ids").where(F.col("id") == batch_id).take(1))

    def committed(self) -> list[str]:
        """Ids of all batches, compacted ones too."""
        _, folded, beside = self._state()
        return sorted(folded.union(beside))

    def _place(self, aside: str, target: str) -> bool:
        """Rename a folder into place. False, and it goes, if another writer was first.

        Some file systems move a folder into one that is there; a mark inside tells.
        """
        mark = f"_mark-{uuid.uuid4().hex}"
        self._fs.create(self._path(f"{aside}/{mark}")).close()
        done = not self._fs.exists(self._path(target)) and self._fs.rename(self._path(aside), self._path(target))
        if done and self._fs.exists(self._path(f"{target}/{mark}")):
            return True
        for left in (aside, f"{target}/{aside.rsplit('/', 1)[-1]}"):
            self._fs.delete(self._path(left), True)
        return False

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch once. False, without running anything, if that id is there.

        Written aside and renamed, so that a batch is seen whole or not at all; of two
        writers with the same id the second one's rows go.
        """
        if self.has(batch_id):
            return False
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.where("n_docs <> 0 or n_tokens <> 0").write.parquet(aside)
        return self._place(aside, self._at(batch_id))

    def _totals(self, base: str | None, beside: list[str]) -> DataFrame:
        paths = [self._at(x) for x in beside] + ([f"{self.path}/{base}/sums"] if base else [])
        rows = self.spark.read.schema(DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], DELTAS)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens; keys with neither documents nor tokens are left out."""
        base, _, beside = self._state()
        return self._totals(base, beside)

    def compact(self) -> bool:
        """Fold all batches into a new base; their ids stay known, then their files go.

        What is folded is what one listing found, so a batch that is committed meanwhile
        stays beside the base. False, with nothing deleted, if the base couldn't be
        placed. A reader that began before must read again.
        """
        base, folded, beside = self._state()
        number = int(base.removeprefix("base=")) + 1 if base else 0
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        self._totals(base, beside).coalesce(1).write.parquet(f"{aside}/sums")
        self.spark.createDataFrame([(x,) for x in sorted(folded.union(beside))], "id string").coalesce(1).write.parquet(f"{aside}/ids")
        if not self._place(aside, f"{self.path}/base={number}"):
            return False
        for x in [self._at(x) for x in beside] + ([f"{self.path}/{base}"] if base else []):
            self._fs.delete(self._path(x), True)
        return True


def token_counts(replay: MergeReplay, words: list[bytes]) -> list[int]:
    """How many tokens each word has: one if it is one, else by trees of words of a size, stepped together; long words by replay."""
    byte = np.arange(256)
    pairs = np.full((257, 257), -1)  # of bytes; the last row and column stand for the end
    pairs[:256, :256] = replay._rank(replay.single[byte][:, None], replay.single[byte][None, :])
    made, out, groups = np.arange(len(replay.tokens)), [1] * len(words), {}  # a pair merges to the token of its rank
    for i, word in enumerate(words):
        if word not in replay.ranks:
            groups.setdefault(min(tree_size(len(word)), 2 * SMALL), []).append(i)
    for size, members in groups.items():
        if size > SMALL:
            for i, ids in zip(members, replay.encode([words[i] for i in members]), strict=True):
                out[i] = len(ids) // 4
            continue
        step = max(1, TOGETHER // (2 * size))
        for at in range(0, len(members), step):
            part = members[at : at + step]
            data = [words[i] for i in part]
            raw = fill_rows(data, np.arange(256), size)
            merged = merge_rows(np.where(raw >= 0, replay.single[raw], -1), np.fromiter(map(len, data), np.int64, len(data)), size, replay._rank, made, pairs[raw[:, :size], raw[:, 1 : size + 1]])
            for i, n in zip(part, (merged >= 0).sum(1).tolist(), strict=True):
                out[i] = n
    return out


class Counter:
    """Numbers of tokens under several vocabularies; texts are split once, and a piece seen before is looked up once."""

    #: Bits that the count of one vocabulary takes in the packed sum of a text.
    BITS = 40

    def __init__(self, encoders: list[Encoder]):
        self.encoders, self.pattern = encoders, encoders[0].pattern
        self.known: dict[str, int] = {}
        self.held = 0

    def count(self, texts: list[str]) -> np.ndarray:
        """One row per vocabulary, one column per text."""
        parts = [self.encoders[0].pieces(t) for t in texts]
        new = {p for x in parts for p in x}.difference(self.known)
        self.held += sum(map(len, new)) + ENTRY_BYTES * len(new)
        if self.held > CACHE_BYTES and self.known:
            self.known = {}
            new = {p for x in parts for p in x}
            self.held = sum(map(len, new)) + ENTRY_BYTES * len(new)
        split = {p: self.pattern.findall(p) for p in new}
        words = list({w for x in split.values() for w in x})
        raw, packed = [w.encode() for w in words], [0] * len(words)
        for i, encoder in enumerate(self.encoders):
            packed = [n + (k << i * self.BITS) for n, k in zip(packed, token_counts(encoder.replay, raw), strict=True)]
        sizes = dict(zip(words, packed, strict=True))
        self.known.update((p, sum(map(sizes.__getitem__, x))) for p, x in split.items())
        get, mask = self.known.__getitem__, (1 << self.BITS) - 1
        sums = [sum(map(get, x)) for x in parts]
        return np.array([[n >> i * self.BITS & mask for n in sums] for i in range(len(self.encoders))], np.int64)


def _counter(names: tuple[str, ...], pattern: str) -> Counter:
    return hold(("token_rollup", names, pattern), lambda: Counter([Encoder(read_ranks(SparkFiles.get(n)), pattern) for n in names]))


def count_versions(docs: DataFrame, versions: dict[str, str], pattern: str, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """source, lang, version, n_tokens and revised_tokens per row of docs and version; texts are read once.

    versions: the vocabulary file of each version. revised_tokens counts the text
    without white space at its ends. A null text has no tokens; null sources and
    languages are keys of their own.
    """
    names = tuple(ship(docs.sparkSession, path) for path in versions.values())

    def count(batches):
        counter = _counter(names, pattern)
        for batch in slices(batches, 0, 4 << 20):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            n = counter.count(texts)
            short = [i for i, t in enumerate(texts) if t != t.strip()]
            revised = n.copy()
            revised[:, short] = counter.count([texts[i].strip() for i in short])
            for i, version in enumerate(versions):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), batch.column(2), pa.array([version] * len(texts), pa.string()), pa.array(n[i]), pa.array(revised[i])],
                    names=["source", "lang", "version", "n_tokens", "revised_tokens"],
                )

    rows = docs.select(F.col(text_col).alias("_text"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"))
    return rows.mapInArrow(count, "source string, lang string, version string, n_tokens long, revised_tokens long")


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, version: str, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """count_versions of one version."""
    return count_versions(docs, {version: ranks_path}, pattern, text_col, source_col, lang_col)
