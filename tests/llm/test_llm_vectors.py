"""Word BPE against the library; whitening and vector codes against brute force."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from plazalake.llm import vector_codes, whitening, word_bpe
from plazalake.llm.q_op13 import ORACLES, op13_vector_codes

FILE = P.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<float>, label int"


# 11


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(FILE)
    found.no_truncation()
    found.no_padding()
    return found


def same_as_library(library, texts):
    own = word_bpe.WordBPE(FILE)
    for text, ids, want in zip(texts, own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text[:100]
        assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_word_bpe_on_odd_texts(library):
    texts = ["", "  ", " a\x1cb\x1f", "Hi<|endoftext|>World <|startoftext|>'s it's IT'S", "ΑΣ ΣΑΣ İstanbul é <|endoftext|>́x"]
    texts += ["​x﻿ a\u0085b c", "x" * 3000, "ab" * 900, "!?" * 800, "日本語 123 ４５", "👩‍👩‍👧 🏽", "K Å Ω ǆ Ǆ ß ẞ ﬁ", *["z" * n for n in (63, 64, 65, 66, 67)]]
    same_as_library(library, texts)


def test_word_bpe_on_every_character(library):
    same_as_library(library, ["a" + chr(c) + "1" for c in range(0x20000) if not 0xD800 <= c < 0xE000])


def test_word_bpe_on_random_texts(library):
    random.seed(11)
    letters = [chr(c) for c in range(0x250)] + [chr(c) for c in (*range(0x300, 0x370), *range(0x1E00, 0x1F00), 0x1100, 0x1161, 0x11A8)]
    same_as_library(library, ["".join(random.choices(letters, k=random.randint(1, 60))) for _ in range(3000)])
    same_as_library(library, ["".join(random.choices("the andring", k=random.randint(1, 300))) for _ in range(500)])


def test_trees_together_and_alone_agree():
    random.seed(12)
    own = word_bpe.WordBPE(FILE)
    words = ["".join(random.choices("aeinrst", k=random.randint(1, 60))) for _ in range(500)] + ["a", "aaaa", "é", "ééé"]
    assert own.merge(words) == [own.one(w) for w in words]


def test_word_bpe_columns(spark):
    docs = spark.createDataFrame([(1, None, "k"), (1, None, "k"), (2, "", "k"), (None, "Some words here", None), (3, "x " * 50_000, "k")], "doc_id long, text string, ids string")
    rows = word_bpe.word_decode(word_bpe.word_encode(docs, FILE), FILE).collect()
    assert len(rows) == 5 and {r.doc_id: r.decoded for r in rows if r.doc_id in (1, 2)} == {1: "", 2: ""}
    digests = {r.doc_id: r for r in word_bpe.word_digest(docs, FILE).collect()}
    assert digests[3].n_tokens == 50_000 and digests[1].n_tokens == 0 and digests[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert next(r.decoded for r in rows if r.doc_id is None) == "some</w> words</w> here</w>"
    assert word_bpe.word_digest(docs.limit(0), FILE).count() == 0


# 12


def usable(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


def whitened_by_force(rows, components=16):
    kept = [(r[0], [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]]) for r in usable(rows)]
    x = np.array(sorted({tuple(v) for _, v in kept}), dtype=object)
    n, s = len(x), x.sum(0)
    centred = (n * x - s).astype(float) / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    out = []
    for i, v in kept:
        y = n * np.array(v, dtype=object) - s
        out.append((i, n, int((y * y).sum()), (y.astype(float) / n) @ u[:, :k] / np.sqrt(e[:k])))
    return out, e[:k] / e.sum()


def check_whitening(spark, rows, components=16, free_basis=False):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    want, explained = whitened_by_force(rows, components)
    got: dict = {}
    for r in whitening.whiten(df, components).collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    k = len(explained)
    assert {c for _, c in got} == set(range(1, k + 1)) and sum(map(len, got.values())) == len(want) * k
    found = np.array([[got[i, c + 1][0].whitened for c in range(k)] for i, *_ in want])
    for (i, n, deviation, _), _row in zip(want, found, strict=True):
        for c in range(k):
            r = got[i, c + 1][0]
            assert (r.n, r.deviation) == (n, deviation) and r.explained == pytest.approx(explained[c], rel=1e-9) and r.identity_error < 1e-9
    if not free_basis:
        force = np.array([w for *_, w in want])
        assert np.abs(found * np.sign((found * force).sum(0)) - force).max() < 1e-8


def test_whitening_by_force(spark):
    rng = np.random.default_rng(3)
    scale = np.linspace(1, 4, 12)
    rows = [(i, [float(x) for x in rng.standard_normal(12) * scale]) for i in range(150)]
    rows += [(900, None), (901, [None] * 12), (902, [float("inf")] * 12), (903, rows[0][1]), (904, rows[0][1]), (None, rows[1][1]), (905, []), (906, [1.0, 2.0])]
    check_whitening(spark, [r for r in rows if r[1] != [] and r[0] != 906], 5)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).selectExpr("*", "1 as x", "2 as component")
    assert whitening.whiten(df, 2).count() == 2 * 153  # other lengths go


def test_whitening_of_fewer_dimensions(spark):
    rng = np.random.default_rng(4)
    base = np.round(rng.standard_normal((3, 7)) * 16) / 16
    check_whitening(spark, [(i, [float(x) for x in rng.integers(0, 4, 3) @ base]) for i in range(60)])


def test_whitening_finds_repeated_variances(spark):
    check_whitening(spark, [(i, [float(x) for x in np.eye(6)[i % 6]]) for i in range(12)], free_basis=True)


def test_whitening_of_little(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], VECTORS)
    assert whitening.whiten(same).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 2.0], 0), (2, [1.0, 5.0], 0), (3, [2.0, 3.0], 0)], VECTORS)).collect()
    assert huge and all(r.deviation is None for r in huge if r.vec_id == 1)


# 13


def codes_by_force(rows, parts=16, entries=64, rounds=2):
    kept = sorted(((i, v, label) for i, v, label in usable(rows)), key=lambda r: (r[0] is None, r[0] or 0, [math.floor(256 * float(np.float32(c))) for c in r[1]]))
    whole = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v, _ in kept]
    wide = -(-len(whole[0]) // parts)
    whole = [w + [0] * (wide * parts - len(w)) for w in whole]
    cut_up = [[w[p * wide : (p + 1) * wide] for w in whole] for p in range(parts)]
    books = [c[:entries] for c in cut_up]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members: dict = {}
            for v in cut_up[p]:
                members.setdefault(near(v, books[p])[1], []).append(v)
            books[p] = [[sum(x) // len(members[k]) for x in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, totals = [], {}
    for at, (i, _, label) in enumerate(kept):
        found = [near(cut_up[p][at], books[p]) for p in range(parts)]
        error = sum(e for e, _ in found)
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
        totals[label] = totals.get(label, 0) + error
    return sorted(((i, c, e, totals[label], digest) for i, c, e, label in out), key=str)


@pytest.mark.parametrize(("size", "parts", "scale"), [(16, 4, 1), (16, 16, 30), (10, 4, 3), (8, 2, 1e6)])
def test_codes_by_force(spark, size, parts, scale):
    rng = np.random.default_rng(size)
    rows = [(i // 2 if i % 9 else None, [float(x) for x in rng.standard_normal(size) * scale], int(i % 4) if i % 5 else None) for i in range(160)]
    rows += [(500, None, 1), (501, [None] * size, 1), (502, [float("nan")] * size, None), rows[0], rows[0]]
    got = sorted((tuple(r) for r in vector_codes.compress(spark.createDataFrame(rows, VECTORS).repartition(5), parts=parts).collect()), key=str)
    assert got == codes_by_force(rows, parts)


def test_codes_of_ties_and_little(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(0, 2, 8)], 1) for i in range(30)]
    got = sorted((tuple(r) for r in vector_codes.compress(spark.createDataFrame(rows, VECTORS), parts=4).collect()), key=str)
    assert got == codes_by_force(rows, 4)
    assert vector_codes.compress(spark.createDataFrame([], VECTORS)).count() == 0
    far = vector_codes.compress(spark.createDataFrame([(i, [1e30 * (i % 3 - 1), 1.0], 0) for i in range(70)], VECTORS), parts=2, entries=2).collect()
    assert len(far) == 70 and any(r.error is None for r in far)


def test_exact_products():
    rng = np.random.default_rng(2)
    for top in (3, 1 << 20, 1 << 26, 1 << 29):
        x, y = rng.integers(-top, top, (3, 40, 5)), rng.integers(-top, top, (3, 20, 5))
        assert (vector_codes.exact_products(x, y) == np.matmul(x, y.swapaxes(1, 2))).all()
        assert (sum(limb.astype(np.int64) << (20 * i) for i, limb in enumerate(vector_codes.limbs(x, 20))) == x).all()


def test_codes_lead_back(spark):
    rows = [(i, [float(i % 5), 1.0, 2.0, 3.0], 0) for i in range(40)]
    df = spark.createDataFrame(rows, VECTORS)
    whole = df.selectExpr("vec_id", "transform(cast(embedding as array<double>), e -> cast(floor(256 * e) as long)) as x")
    book = vector_codes.train(whole, 4, "vec_id", 2)
    back = {r.vec_id: r.decoded for r in vector_codes.decode(vector_codes.encode(whole, 4, book), book, 4).collect()}
    assert all(back[i] == v for i, v, _ in rows)


def test_codes_same_as_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({ORACLES['op13_vector_codes']})").fetchall()
    got = [tuple(r) for r in op13_vector_codes(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(got) == sorted(want) and len(got) == 500
