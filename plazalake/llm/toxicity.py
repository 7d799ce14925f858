"""Toxicity by a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned: prefixes and whole words whose document frequency is
higher in toxic training texts than in others, each grown as long as no support is
lost; a longer term that tells more stands beside its prefix. The trie of its terms, intersected with a Levenshtein automaton, is one
machine that is made deterministic as words drive it. Every hit is weighed by its
context: in quotation marks, in a quoted line or next to a word of reporting it
counts less, next to a second person more. A logistic regression on sums of
hits turns that into a score.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, cut, fold, hold, slices

HELD_OUT, FOLDS = 2, 4
#: Labelled rows that the model is fitted on, at most; chosen by a hash of the id.
SAMPLE = 30_000
#: Toxic documents that a term must occur in, how much more likely it is in them, and by how many standard errors.
SUPPORT, RATIO, ERRORS = 5, 2.5, 3.0
#: A longer term stands beside the prefix it has if its log odds are higher by this.
STEP = 0.7
#: Letters of a prefix that is a term; words that are terms have no upper bound.
SHORTEST, LONGEST = 3, 24
#: States of the machine that are kept; it starts anew beyond that.
STATES = 60_000
#: Tokens before and after a hit that are its context; tokens in which hits add up.
CONTEXT, SPAN = 4, 40
CACHE = 400_000
THRESHOLD = 0.3
#: A word: letters, digits and signs that stand for letters; the rest parts words.
WORD = r"[\w@$]+"
WORDS = re.compile(WORD)
TOKEN = re.compile(WORD + r"|[\"“”„«»]|^\s*>|\n", re.M)
MARKS = frozenset('"“”„«»')
REPORTING = frozenset("said says called calls quote quoted quotes wrote writes word term phrase sagte nannte zitat schrieb wort dit disait cite citation mot dijo llamó cita palabra".split())
SECOND = frozenset("you your youre u ur du dich dir ihr dein deine tu toi te ton ta vous votre tú usted tus vosotros".split())
FEATURES = 6


def _plain(text: str) -> str:
    """In lower case; an underscore parts words, too."""
    return text.lower().replace("_", "\0")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(_plain(text)) if text else []


def tokens_of(text: str) -> list[str]:
    """The same words, quotation marks, beginnings of quoted lines and line ends."""
    return TOKEN.findall(_plain(text))


def edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 8 else 2


class Automaton:
    """The trie of terms (text, whole word?, weight) under edits, determinised lazily.

    A state is a set of (trie node, edits so far); dead is the empty one.
    """

    def __init__(self, terms: list[tuple[str, bool, float]], fuzzy: list[float] | None = None):
        self.terms, self.fuzzy = terms, fuzzy
        # where a misspelling has no weight, it needn't be found
        self.most = [edits(len(text)) if fuzzy is None or fuzzy[i] > 0 else 0 for i, (text, _, _) in enumerate(terms)]
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.room = [0]
        for number, (text, _, _) in enumerate(terms):
            node, most = 0, self.most[number]
            self.room[0] = max(self.room[0], most)
            for char in text:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.room.append(0)
                node = self.children[node][char]
                self.room[node] = max(self.room[node], most)
            self.ends[node].append(number)
        self._known: dict[str, tuple | None] = {}
        self._begin()

    def _begin(self) -> None:
        self._states: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._next: list[dict[str, int]] = []
        self._prefix: list[tuple | None] = []
        self._whole: list[tuple | None] = []
        self.start = self._state({0: 0})

    def _state(self, least: dict[int, int]) -> int:
        """The number of the state with these nodes, and all that deletions lead to."""
        room, children, todo = self.room, self.children, list(least.items())
        while todo:
            node, e = todo.pop()
            if least[node] < e:
                continue
            e += 1
            for child in children[node].values():
                if e <= room[child] and least.get(child, 99) > e:
                    least[child] = e
                    todo.append((child, e))
        key = frozenset(least.items())
        if key not in self._states:
            self._states[key] = len(self._sets)
            self._sets.append(key)
            self._next.append({})
            hits = [(e, -len(self.terms[number][0]), number) for node, e in key for number in self.ends[node] if e <= self.most[number]]
            self._prefix.append(min((h for h in hits if not self.terms[h[2]][1]), default=None))
            self._whole.append(min((h for h in hits if self.terms[h[2]][1]), default=None))
        return self._states[key]

    def _step(self, state: int, char: str) -> int:
        room, children, least = self.room, self.children, {}
        for node, e in self._sets[state]:
            below = children[node]
            if (child := below.get(char)) is not None and e <= room[child] and least.get(child, 99) > e:
                least[child] = e
            e += 1
            if e <= room[node] and least.get(node, 99) > e:  # an insertion
                least[node] = e
            for child in below.values():  # a substitution
                if e <= room[child] and least.get(child, 99) > e:
                    least[child] = e
        self._next[state][char] = out = self._state(least)
        return out

    def match(self, word: str):
        """(edits, term) of the nearest term that the word is, or begins with; the longest of equals."""
        found = self._best(word)
        return found and (found[0], found[2])

    def _best(self, word: str):
        if len(self._sets) > STATES:
            self._begin()
        state, best = self.start, None
        for char in word:
            following = self._next[state].get(char)
            state = self._step(state, char) if following is None else following
            if not self._sets[state]:
                return best
            if (hit := self._prefix[state]) is not None and (best is None or hit < best):
                best = hit
        if (hit := self._whole[state]) is not None and (best is None or hit < best):
            best = hit
        return best

    def lookup(self, words: set[str]) -> dict[str, tuple]:
        """Of these words, the hits."""
        known = self._known
        if len(known) > CACHE:
            known.clear()
        out = {}
        for w in words:
            hit = known.get(w, 0)
            if hit == 0:
                hit = known[w] = self.match(w) if self.terms else None
            if hit is not None:
                out[w] = hit
        return out

    def weight(self, hit: tuple) -> float:
        e, number = hit
        if e == 0:
            return self.terms[number][2]
        return self.fuzzy[number] / e if self.fuzzy else 0.0


def features(text: str | None, machine: Automaton) -> list[float]:
    """Of a text: all hits by weight, as they stand in context, per 100 words, best span, edited ones, quoted ones."""
    words = words_of(text)
    hits = machine.lookup(set(words)) if words else {}
    if not any(machine.weight(h) for h in hits.values()):
        return [0.0] * FEATURES
    inside, line, n, marks = False, False, 0, []
    stream: list[tuple[str, bool]] = []
    for t in tokens_of(text):
        if t in MARKS:
            inside = not inside
        elif t == "\n":
            inside = line = False
        elif t.endswith(">"):
            line = True
        else:
            stream.append((t, inside or line))
    total = in_context = edited = quoted = 0.0
    for i, (t, is_quoted) in enumerate(stream):
        hit = hits.get(t)
        weight = machine.weight(hit) if hit else 0.0
        if not weight:
            continue
        near = {x for x, _ in stream[max(0, i - CONTEXT) : i + CONTEXT + 1]}
        said = is_quoted or bool(near & REPORTING)
        factor = (0.25 if said else 1.0) * (1.25 if near & SECOND else 1.0)
        n += 1
        total += weight
        in_context += weight * factor
        quoted += weight * said
        edited += weight * (hit[0] > 0)
        marks.append((i, weight * factor))
    best, begin, held = 0.0, 0, 0.0
    for i, w in marks:
        held += w
        while marks[begin][0] <= i - SPAN:
            held -= marks[begin][1]
            begin += 1
        best = max(best, held)
    return [math.log1p(total), math.log1p(in_context), 100 * in_context / max(1, len(stream)), math.log1p(best), math.log1p(edited), math.log1p(quoted)]


def _log_odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def grow(found: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> list[tuple[str, bool, float]]:
    """Terms from accepted keys; a key that ends in a space is a whole word."""
    odds = {k: _log_odds(*n, n_toxic, n_clean) for k, n in found.items()}
    by_parent: dict[str, list[str]] = {}
    for key in found:
        by_parent.setdefault(key[:-1], []).append(key)
    best: dict[str, float] = {}  # of a key and all between it and the term it became
    out = {}
    for key in sorted(found, key=lambda k: (len(k), k)):
        above = max((best[key[:i]] for i in range(SHORTEST, len(key) + 1) if key[:i] in best), default=None)
        if key in best or above is not None and odds[key] < above + STEP:
            continue
        top = key
        while longer := [k for k in by_parent.get(top, ()) if found[k][0] >= 0.97 * found[key][0]]:
            top = max(longer, key=lambda k: (found[k][0], k))
        for i in range(len(key), len(top) + 1):
            best[top[:i]] = odds[top]
        out[top] = odds[top]
    return sorted(((k.rstrip(" "), k.endswith(" "), w) for k, w in out.items()), key=lambda t: (-t[2], t[0]))


def keys_of(text: str | None) -> set[str]:
    """Prefixes of the words, up to LONGEST letters, and whole words with a space after them."""
    out = set()
    for w in set(words_of(text)):
        out.update([w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1)])
        if len(w) >= SHORTEST:
            out.add(w + " ")
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients, the constant last, and scales; Newton steps on the penalised likelihood."""
    scale = np.maximum(x.std(0), 1e-9) if len(x) else np.ones(x.shape[1])
    z = np.hstack((x / scale, np.ones((len(x), 1))))
    w, penalty = np.zeros(z.shape[1]), ridge * len(x) * np.append(np.full(z.shape[1] - 1, 0.01), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6)
        step = np.linalg.solve(hess, z.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w, scale


def _machine(token: str, terms: list, fuzzy: list | None) -> Automaton:
    return hold(("toxicity", token, fuzzy is None), lambda: Automaton(terms, fuzzy))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> dict:
    """The model. Fitted on at most `sample` labelled rows that aren't held out, broadcast by id.

    Rows of labels with a null id or label are left out; an id with both labels is toxic.
    """
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    ids = ids.where(fold("id", folds) != held_out).groupBy("id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").select("text", "toxic")
    rows = cut(rows, "labelled")
    n_clean, n_toxic = (rows.where(F.col("toxic") == x).count() for x in (0, 1))
    model = {"terms": [], "fuzzy": [], "weights": None, "scale": None}
    if not n_toxic or not n_clean:
        return model | {"constant": float(n_toxic > 0)}

    def count(batches):
        total: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[1 if toxic else 0].update(keys_of(text))
                if len(total[0]) > 1_000_000:
                    yield from give(total)
        yield from give(total)

    def give(total):
        for toxic, found in total.items():
            keys = list(found)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                n = np.array([found[k] for k in part])
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(n * toxic, pa.int64()), pa.array(n * (1 - toxic), pa.int64())], names=["key", "toxic", "clean"])
            found.clear()

    support = max(SUPPORT, int(0.002 * n_toxic))
    odds = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    found = rows.mapInArrow(count, "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    found = found.where((F.col("toxic") >= support) & (odds >= RATIO) & (F.log(odds) >= ERRORS * error))
    model["terms"] = terms = grow({r[0]: (r[1], r[2]) for r in found.collect()}, n_toxic, n_clean)
    shared, token = docs.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex

    def fuzzy(batches):
        machine, total = _machine(token, shared.value, None), {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits = machine.lookup(set(words_of(text))).values()
                total[1 if toxic else 0].update({number for e, number in hits if e})
        for toxic, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int32()), pa.array([x * toxic for x in n.values()], pa.int64()), pa.array([x * (1 - toxic) for x in n.values()], pa.int64())], names=["term", "toxic", "clean"])

    near = rows.mapInArrow(fuzzy, "term int, toxic long, clean long").groupBy("term").agg(F.sum("toxic"), F.sum("clean")).collect()
    near = {r[0]: (r[1], r[2]) for r in near}
    for number, (_, _, weight) in enumerate(terms):
        toxic, clean = near.get(number, (0, 0))
        # a misspelling counts for half; less, or nothing, where such words occur in clean texts as well
        seen = _log_odds(toxic, clean, n_toxic, n_clean) if toxic + clean >= 3 else weight / 2
        model["fuzzy"].append(max(0.0, min(weight / 2, seen)) if seen > 1 else 0.0)
    weighed = docs.sparkSession.sparkContext.broadcast(model["fuzzy"])

    def measure(batches):
        machine = _machine(token, shared.value, weighed.value)
        for batch in batches:
            x = [features(t, machine) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    seen = rows.mapInArrow(measure, "x array<double>, toxic int").toArrow()
    x = np.array(seen["x"].to_pylist()).reshape(-1, FEATURES)
    model["weights"], model["scale"] = fit_logistic(x, (seen["toxic"].to_numpy() > 0).astype(float))
    return model


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    A null or empty text scores like one without hits. If only one label was
    learned, every score is that label; if none, 0.
    """
    key = docs.schema[id_col].dataType.simpleString()
    shared, token = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        m = shared.value
        machine = _machine(token, m["terms"], m["fuzzy"])
        for batch in slices(batches, 1):
            ids = batch.column(0).to_pylist()
            if m["weights"] is None:
                p = np.full(len(ids), m["constant"])
            else:
                x = np.array([features(t, machine) for t in batch.column(1).to_pylist()]).reshape(-1, FEATURES)
                p = 1 / (1 + np.exp(-np.clip(np.hstack((x / m["scale"], np.ones((len(x), 1)))) @ m["weights"], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([crc_fold(i, folds) == held_out for i in ids], pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                names=[id_col, "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"{id_col} {key}, held_out boolean, score double, predicted int")
