"""Language identification as mixture inference over n-gram likelihoods.

A language's model is a byte trigram model of padded words with interpolated
counts. A document is a mixture of languages, word by word: expectation
maximisation estimates the proportions, for all documents of a batch at once, and
languages are dropped as long as the likelihood, penalised by half the logarithm
of the number of words for every language, doesn't fall. Words of a document that
are equal are one row with a weight, so a long text needs no more memory than its
distinct words.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import crc_fold, hold, slices

HELD_OUT = 2
FOLDS = 4
UNKNOWN = "und"
PRIOR = 8.0
FIRST_ROUNDS, NEXT_ROUNDS = 12, 6
#: Distinct languages that may be learned; a column with more isn't one of languages, and learning from it fails.
MOST_LANGS = 2_000
#: Words times languages of a matrix, and of the likelihoods that a worker remembers.
CELLS, KNOWN_CELLS = 1 << 20, 1_200_000
LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters, lower-cased, and bytes of other characters stay; the rest parts words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with letters; none if it has no letter."""
    # the pattern also takes letter-like numbers, which are no letters
    if not text or not any(m.group().isalpha() for m in LETTER.finditer(text)):
        return []
    return text.lower().encode().translate(WORDS).split()


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of all trigrams of the words, each after two spaces and before one: its three bytes as a number, the word's number."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    raw = np.frombuffer(b"  " + b"".join([w + b" " for w in words]), np.uint8).astype(np.int64)
    a, b, c = raw[:-2].copy(), raw[1:-1].copy(), raw[2:]
    starts = sizes.cumsum() - sizes
    a[starts] = b[starts] = 32
    a[starts[sizes > 1] + 1] = 32
    return a << 16 | b << 8 | c, np.repeat(np.arange(len(words)), sizes)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, held_out: int = HELD_OUT) -> dict:
    """Counts of the trigrams of every language, from rows with a text and a lang that aren't held out: {lang: (grams, counts)}.

    What reaches the driver is a row per language: the trigrams of its words, 2^24 at the very most.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")

    def count(batches):
        total: dict[str, Counter] = {}
        for batch in slices(batches, 1):
            words: dict[str, Counter] = {}
            for doc_id, text, lang in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if crc_fold(doc_id, folds) != held_out:
                    words.setdefault(lang, Counter()).update(words_of(text))
            for lang, found in words.items():
                into = total.setdefault(lang, Counter())
                if found:
                    gram, word = _grams(list(found))
                    own, at = np.unique(gram, return_inverse=True)
                    n = np.bincount(at, np.fromiter(found.values(), np.float64, len(found))[word])
                    into.update(dict(zip(own.tolist(), n.astype(np.int64).tolist(), strict=True)))
        for lang, counts in total.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(counts), pa.string()), "gram": pa.array(list(counts), pa.int32()), "n": pa.array(counts.values(), pa.int64())})

    found = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    packed = found.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("c"))
    model = {}
    for lang, pairs in packed.toLocalIterator():
        if len(model) == MOST_LANGS:
            raise ValueError(f"more than {MOST_LANGS} languages: {lang_col} doesn't hold languages")
        table = np.array(sorted((r[0], r[1]) for r in pairs), np.int64).reshape(-1, 2)
        model[lang] = table[:, 0], table[:, 1]
    return model


class Model:
    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        self._tables = []
        for lang in self.langs:
            gram, n = counts[lang]
            pair, at = np.unique(gram >> 8, return_inverse=True)
            last = (np.bincount(gram & 255, n, 256) + 0.5) / (n.sum() + 128)
            stop = np.iinfo(np.int64).max
            self._tables.append((np.append(gram, stop), np.append(n, 0), np.append(pair, stop), np.append(np.bincount(at, n, len(pair)), 0), last))
        self._most = max(1, KNOWN_CELLS // max(1, len(self.langs)))
        self._reset()

    def _reset(self):
        self._known: dict[bytes, int] = {}
        self._likely = np.zeros((self._most, len(self.langs)))

    def log_likelihoods(self, words: list[bytes]) -> np.ndarray:
        """Of each word, with its end, under each language."""
        gram, word = _grams(words)
        out = np.empty((len(words), len(self.langs)))
        for i, (grams, n, pairs, n_pair, last) in enumerate(self._tables):
            at, two = grams.searchsorted(gram), pairs.searchsorted(gram >> 8)
            three = np.where(grams[at] == gram, n[at], 0)
            p = (three + PRIOR * last[gram & 255]) / (np.where(pairs[two] == gram >> 8, n_pair[two], 0) + PRIOR)
            out[:, i] = np.bincount(word, np.log(p), len(words))
        return out

    def likelihoods(self, words: list[bytes]) -> np.ndarray:
        """The same, divided by the best of each word."""
        out = self.log_likelihoods(words)
        return np.exp(out - out.max(1, keepdims=True))

    def rows(self, docs: list[Counter]) -> np.ndarray:
        """A row of likelihoods for each distinct word of all docs."""
        new = {w for x in docs for w in x}.difference(self._known)
        if len(self._known) + len(new) > self._most:
            self._reset()
            new = {w for x in docs for w in x}
        if len(new) > self._most:  # too many to remember
            return self.likelihoods([w for x in docs for w in x])
        if new:
            order, begin = list(new), len(self._known)
            self._likely[begin : begin + len(order)] = self.likelihoods(order)
            self._known.update(zip(order, range(begin, begin + len(order)), strict=True))
        get, n = self._known.__getitem__, sum(map(len, docs))
        return self._likely[np.fromiter((get(w) for x in docs for w in x), np.int64, n)]

    def mixtures(self, docs: list[Counter]) -> np.ndarray:
        """Proportions of languages of each document, a count of words; every document has words."""
        distinct = np.array([len(x) for x in docs])
        starts, like = distinct.cumsum() - distinct, self.rows(docs)
        times = np.fromiter((n for x in docs for n in x.values()), np.float64, len(like))
        sizes = np.add.reduceat(times, starts)

        def run(share, rounds):
            for _ in range(rounds):
                each = like * np.repeat(share, distinct, axis=0)
                each *= (times / np.maximum(each.sum(1), 1e-300))[:, None]
                share = np.add.reduceat(each, starts, axis=0) / sizes[:, None]
            mixed = np.maximum((like * np.repeat(share, distinct, axis=0)).sum(1), 1e-300)
            return share, np.add.reduceat(times * np.log(mixed), starts)

        def penalised(share, fit):
            return fit - 0.5 * np.log(sizes + 1) * (share > 0).sum(1)

        share, fit = run(np.full((len(docs), len(self.langs)), 1 / len(self.langs)), FIRST_ROUNDS)
        # a language of under half a word can't pay for itself
        for _ in range(len(self.langs)):
            least = np.where(share > 0, share, np.inf)
            drop = (least * sizes[:, None] < 0.5) & (share < share.max(1, keepdims=True))
            drop[np.arange(len(docs)), len(self.langs) - 1 - least[:, ::-1].argmin(1)] = True  # the last of equals
            drop[(share > 0).sum(1) <= 1] = False
            if not drop.any():
                break
            fewer = np.where(drop, 0, share)
            next_share, next_fit = run(fewer / fewer.sum(1, keepdims=True), NEXT_ROUNDS)
            better = drop.any(1) & (penalised(next_share, next_fit) >= penalised(share, fit))
            if not better.any():
                break
            share, fit = np.where(better[:, None], next_share, share), np.where(better, next_fit, fit)
        return share

    def groups(self, docs: list[Counter]):
        """Ranges of documents whose matrices stay near CELLS; a document of more stands alone."""
        begin, held = 0, 0
        for i, x in enumerate(docs):
            if i > begin and held + len(x) * len(self.langs) > CELLS:
                yield begin, i
                begin, held = i, 0
            held += len(x) * len(self.langs)
        if docs:
            yield begin, len(docs)

    def predict(self, texts: list[str | None]) -> tuple[list, list, list]:
        """lang_pred, score and (language, proportion) pairs of each text."""
        words = [words_of(t) for t in texts]
        some = [i for i, x in enumerate(words) if x and self.langs]
        best, score, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        counts = [Counter(words[i]) for i in some]
        for begin, end in self.groups(counts):
            for i, share in zip(some[begin:end], self.mixtures(counts[begin:end]), strict=True):
                top = int(share.argmax())
                best[i], score[i] = self.langs[top], min(1.0, float(share[top]))
                shares[i] = [(self.langs[k], float(share[k])) for k in np.flatnonzero(share)]
        return best, score, shares


def identify(docs: DataFrame, counts: dict, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score, languages (language to proportion).

    lang_pred is the language of the largest proportion, which is the score; ties go
    to the first by name. A text that is null, empty or without letters, or letters
    of no word, is `und` with score 0, and so is every text if nothing was learned.
    """
    key = docs.schema[id_col].dataType.simpleString()
    shared, token = docs.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex

    def predict(batches):
        model = hold(("lang_mixture", token), lambda: Model(shared.value))
        for batch in slices(batches, 1, 4 << 20):
            best, score, shares = model.predict(batch.column(1).to_pylist())
            held = [crc_fold(x, folds) == held_out for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held, pa.bool_()), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                names=[id_col, "held_out", "lang_pred", "score", "languages"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(predict, f"{id_col} {key}, held_out boolean, lang_pred string, score double, languages map<string,double>")


def keep_known(docs: DataFrame, counts: dict, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in whose text a language can be told."""
    shared, token, at = docs.sparkSession.sparkContext.broadcast(counts), uuid.uuid4().hex, docs.columns.index(text_col)

    def run(batches):
        model = hold(("lang_mixture", token), lambda: Model(shared.value))
        for batch in slices(batches, at, 4 << 20):
            best = model.predict(batch.column(at).to_pylist())[0]
            yield batch.filter(pa.array([x != UNKNOWN for x in best], pa.bool_()))

    return docs.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in docs.schema]))
