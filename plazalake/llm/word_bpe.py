"""BPE with word ends: a segment tree over the ranks of adjacent pairs of a word.

A leaf holds the rank of the pair that begins at its symbol, and its place; a node
holds the least of its two children. So the root is the leftmost merge of the lowest
rank. A merge changes three leaves (the pair before, the pair itself, the pair that
is swallowed) and their ancestors; it ends when the root holds no mergeable pair.
The trees of all new short words of a batch are stepped together as one array.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .byte_bpe import ship
from .common import hold, slices

#: Bytes that a worker's memory of chunks and their ids may take, and what an entry takes beside its chunk.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 200
#: A pair that can't be merged.
NONE = 1 << 62
#: Leaves of the trees that are stepped together, and entries of all those trees.
SMALL, TOGETHER = 64, 1 << 21
#: White space by the Unicode property; str.split() also parts at these four.
SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
#: Letters whose case and class no version of Unicode has changed, and which NFC leaves alone.
SETTLED = regex.compile(r"[\x00-\u024f]*")


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where it can be printed, else the next one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in printed)}
    return [chr(rest.get(b, b)) for b in range(256)]


def tree_size(symbols: int) -> int:
    """Leaves of the tree of a word: a power of two, at least its pairs."""
    return 1 << max(symbols - 2, 0).bit_length()


def fill_rows(words: list[bytes], single: np.ndarray, size: int) -> np.ndarray:
    """A row of symbols for each word of at most size + 1 bytes, then -1."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    sym = np.full((len(words), size + 2), -1, np.int64)
    sym[np.arange(size + 2) < sizes[:, None]] = single[np.frombuffer(b"".join(words), np.uint8)]
    return sym


def merge_rows(sym: np.ndarray, sizes: np.ndarray, size: int, rank, made: np.ndarray, ranks: np.ndarray | None = None) -> np.ndarray:
    """sym with all merges done, one of each row at a time: swallowed symbols are -1.

    rank gives the ranks of pairs, -1 where there is none; made the symbol that a rank leads to;
    ranks, if known, those of the pairs that begin at each of the first `size` places.
    """
    w, wide = sym.shape
    nxt = np.minimum(np.arange(1, wide + 1)[None, :], sizes[:, None])
    prv = np.broadcast_to(np.arange(-1, wide - 1), (w, wide)).copy()
    tree = np.full((w, 2 * size), NONE, np.int64)
    if ranks is None:
        ranks = rank(sym[:, :size], sym[:, 1 : size + 1])
    tree[:, size:] = np.where((ranks >= 0) & (sym[:, 1 : size + 1] >= 0), ranks * size + np.arange(size), NONE)
    level = size
    while level > 1:
        tree[:, level // 2 : level] = tree[:, level : 2 * level].reshape(w, level // 2, 2).min(2)
        level //= 2
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        r, p = np.divmod(tree[rows, 1], size)
        q = nxt[rows, p]
        after = nxt[rows, q]
        new = made[r]
        sym[rows, p], sym[rows, q] = new, -1
        nxt[rows, p], prv[rows, after] = after, p  # the place after the last symbol takes what nobody reads
        before = prv[rows, p]
        first = np.maximum(before, 0)
        right = rank(new, np.where(after < sizes[rows], sym[rows, after], -1))
        left = rank(np.where(before >= 0, sym[rows, first], -1), new)
        inside = q < size
        tree[rows[inside], size + q[inside]] = NONE
        inside = p < size
        tree[rows[inside], size + p[inside]] = np.where(right >= 0, right * size + p, NONE)[inside]
        has = before >= 0
        tree[rows[has], size + before[has]] = np.where(left >= 0, left * size + before, NONE)[has]
        changed, node = np.concatenate((rows, rows, rows)), size + np.minimum(np.concatenate((q, p, first)), size - 1)
        while node[0] > 1:
            node >>= 1
            tree[changed, node] = np.minimum(tree[changed, 2 * node], tree[changed, 2 * node + 1])
        rows = rows[tree[rows, 1] < NONE]
    return sym


class WordBPE:
    """The tokenizer of a file: special strings, NFC, lower case, split, byte characters, merges with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        steps = [s["type"] for s in spec["normalizer"]["normalizers"]] + [s["type"] for s in before]
        if steps != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None:
            raise ValueError(f"not a word BPE of the known kind: {path}")
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        self.source = before[0]["pattern"]["Regex"]
        self.pattern = regex.compile(self.source)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = token
        chars = byte_chars()
        self.inner, self.last = (np.array([vocab[c + s] for c in chars], np.int64) for s in ("", end))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.rank = {}
        for k, (a, b) in enumerate(pairs):
            self.rank.setdefault(vocab[a] << 32 | vocab[b], k)
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = keys.argsort()
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(self.rank.values(), np.int64, len(keys))[order], -1)
        self.known: dict[str, bytes] = {}
        self.held = 0
        self._other = None

    # words

    def symbols(self, word: str) -> np.ndarray:
        raw = np.frombuffer(word.encode(), np.uint8)
        ids = self.inner[raw]
        ids[-1] = self.last[raw[-1]]
        return ids

    def one(self, word: str) -> bytes:
        """The ids of a word by a tree of its own."""
        sym = array("q", self.symbols(word).tobytes())
        n = len(sym)
        size = tree_size(n)
        nxt, prv = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        tree = array("q", [NONE]) * (2 * size)
        rank = self.rank
        for i in range(n - 1):
            r = rank.get(sym[i] << 32 | sym[i + 1])
            if r is not None:
                tree[size + i] = r * size + i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while (top := tree[1]) < NONE:
            r, p = divmod(top, size)
            q = nxt[p]
            after = nxt[p] = nxt[q]
            sym[p], sym[q] = int(self.made[r]), -1
            changed = [(q, NONE)]
            found = rank.get(sym[p] << 32 | sym[after]) if after < n else None
            changed.append((p, NONE if found is None else found * size + p))
            if after < n:
                prv[after] = p
            if (before := prv[p]) >= 0:
                found = rank.get(sym[before] << 32 | sym[p])
                changed.append((before, NONE if found is None else found * size + before))
            for at, key in changed:
                node = size + at
                if node >= 2 * size:
                    continue
                tree[node] = key
                while node > 1:
                    node >>= 1
                    least = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == least:
                        break
                    tree[node] = least
        return np.array([s for s in sym if s >= 0], "<u4").tobytes()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def _together(self, words: list[str], size: int) -> list[bytes]:
        """The ids of words of at most size + 1 symbols."""
        data = [word.encode() for word in words]
        sym = fill_rows(data, self.inner, size)
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        sym[np.arange(len(data)), sizes - 1] = self.last[raw[sizes.cumsum() - 1]]
        alive = merge_rows(sym, sizes, size, self._rank, self.made) >= 0
        flat, ends = sym[alive].astype("<u4").tobytes(), (alive.sum(1).cumsum() * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word (no empty ones) as little-endian unsigned 32-bit integers."""
        out: list = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            n = len(word) if word.isascii() else len(word.encode())
            groups.setdefault(tree_size(n), []).append(i)
        for size, members in groups.items():
            if size > SMALL:
                for i in members:
                    out[i] = self.one(words[i])
                continue
            step = max(1, TOGETHER // (2 * size))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self._together([words[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    # texts

    def _words(self, chunk: str) -> list:
        """The words of a run without white space; special strings stand as bytes, their id."""
        out: list = []
        for part in self.parts.split(chunk) if self.parts else [chunk]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out.extend(self._plain(part))
        return out

    def _plain(self, part: str) -> list[str]:
        if SETTLED.fullmatch(part):
            return self.pattern.findall(part.lower())
        # letters of later versions of Unicode than this Python has: the file's library knows its own tables
        if self._other is None:
            from tokenizers import Regex, normalizers, pre_tokenizers

            self._other = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]), pre_tokenizers.Split(Regex(self.source), "removed", invert=True)
        norm, split = self._other
        return [w for w, _ in split.pre_tokenize_str(norm.normalize_str(part))]

    def chunks(self, text: str) -> list[str]:
        """Runs without white space: no word reaches over it, nor does a normal form."""
        if SEPARATORS.search(text):
            return [c for c in SPACE.split(text) if c]
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.chunks(t) for t in texts]
        new = {c for x in parts for c in x}.difference(self.known)
        self.held += sum(map(len, new)) + ENTRY_BYTES * len(new)
        if self.held > CACHE_BYTES and self.known:
            self.known = {}
            new = {c for x in parts for c in x}
            self.held = sum(map(len, new)) + ENTRY_BYTES * len(new)
        words_of = self._words if any(s in t for s in self.special for t in texts) else self._plain
        split = {c: words_of(c) for c in new}
        words = list({w for x in split.values() for w in x if isinstance(w, str)})
        ids: dict = dict(zip(words, self.merge(words), strict=True))
        self.known.update((c, b"".join([w if isinstance(w, bytes) else ids[w] for w in x])) for c, x in split.items())
        get = self.known.__getitem__
        return [b"".join(map(get, x)) for x in parts]

    def decode(self, ids: bytes) -> str:
        """Without a decoder in the file the tokens are joined by spaces, special ones too."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _tokenizer(name: str) -> WordBPE:
    return hold(("word_bpe", name), lambda: WordBPE(SparkFiles.get(name)))


def word_encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with one more column: the ids of text_col by the tokenizer file at path, as little-endian unsigned 32-bit integers.

    Null, empty and blank texts have no ids. Other columns pass through, whatever
    their names, except one named like out_col, which is replaced. Repeated rows
    stay; no row meets another, so ties don't arise.
    """
    name = ship(docs.sparkSession, path)
    kept = docs.drop(out_col)
    at = kept.columns.index(text_col)

    def encode(batches):
        tokenizer = _tokenizer(name)
        for batch in slices(batches, at, 4 << 20):
            ids = tokenizer.encode([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, out_col])

    return kept.mapInArrow(encode, StructType([*kept.schema.fields, StructField(out_col, BinaryType())]))


def word_decode(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """rows with one more column: the text that ids_col stands for, special tokens kept; null ids give null."""
    name = ship(rows.sparkSession, path)
    kept = rows.drop(out_col)
    at = kept.columns.index(ids_col)

    def decode(batches):
        tokenizer = _tokenizer(name)
        for batch in slices(batches, at, 4 << 20):
            texts = [None if x is None else tokenizer.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return kept.mapInArrow(decode, StructType([*kept.schema.fields, StructField(out_col, StringType())]))


def word_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids: id, n_tokens, ids_sha256, decoded_sha256 per row of docs, in one pass.

    A null text counts as the empty one; no ids decode to the empty text.
    """
    name, key = ship(docs.sparkSession, path), docs.schema[id_col].dataType.simpleString()

    def digest(batches):
        tokenizer = _tokenizer(name)
        for batch in slices(batches, 1, 4 << 20):
            ids = tokenizer.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(tokenizer.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(digest, f"{id_col} {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")
