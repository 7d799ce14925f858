"""Very frequent keys, odd names, and counts held against the public library."""

from __future__ import annotations

import base64
from collections import Counter

import public_tokenizers as P
import tiktoken

from plazalake.llm import common, token_rollup, warc_bundles, wu_manber

MULTI = P.path("byte_bpe_multi_50k.tiktoken")
COUNTS = "source string, lang string, version string, n_tokens long, times long"


def test_a_row_that_stands_for_very_many_documents(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([("s", "en", "v", 3, 5_000_000_000), ("s", "en", "v", 0, 7), ("t", None, "v", 2, 1)], COUNTS)
    rollup.commit("load", token_rollup.inserts(rows))
    rollup.commit("trim", token_rollup.revisions(rows.where("n_tokens = 3").selectExpr("source", "lang", "version", "3 as old_tokens", "2 as new_tokens", "times")))
    rollup.commit("drop", token_rollup.deletes(rows.where("n_tokens = 0")))
    assert sorted(map(tuple, rollup.totals().collect())) == [("s", "en", "v", 5_000_000_000, 10_000_000_000), ("t", None, "v", 1, 2)]


def test_batches_of_any_name(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, f"file://{tmp_path}/r")
    rows = spark.createDataFrame([("s", "en", "v", 3, 1)], COUNTS)
    names = ["a/b", "a%2Fb", "x y=z", "..", "ü", "a:b", "base=7"]
    for name in names:
        assert not rollup.has(name) and rollup.commit(name, token_rollup.inserts(rows)) and rollup.has(name)
    assert rollup.committed() == sorted(names)
    assert rollup.compact() and rollup.committed() == sorted(names)
    assert not any(rollup.commit(name, token_rollup.inserts(rows)) for name in names)
    assert [(r.n_docs, r.n_tokens) for r in rollup.totals().collect()] == [(len(names), 3 * len(names))]


def test_counts_of_the_other_vocabulary_are_the_library_s(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", " padded  text ", "the quick brown fox", "über den Fluß", "日本語 テキスト", "naïve 12345 !!", "x" * 500, "a\n\n b"] * 3
    docs = spark.createDataFrame([(t, f"s{i % 2}", "en") for i, t in enumerate(texts)], "text string, source string, lang string")
    got = token_rollup.count_versions(docs, {"m": MULTI, "b": P.path("byte_bpe_50k.tiktoken")}, P.PATTERN).where("version = 'm'").collect()
    want = Counter((f"s{i % 2}", len(library.encode_ordinary(t)), len(library.encode_ordinary(t.strip()))) for i, t in enumerate(texts))
    assert Counter((r.source, r.n_tokens, r.revised_tokens) for r in got) == want


def test_a_payload_of_very_many_pages(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 50)
    pages = [(i, "u", "" if i % 3 else f"page {i % 9}") for i in range(600)] + [(None, "u", ""), (7, "u", "")]
    rows = warc_bundles.plan_records(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    last = {}
    for i, _, html in pages:
        if i is not None:
            last[html] = max(i, last.get(html, -1))
    assert len(rows) == len(pages)
    assert all(r.refers_to == (None if r.id is None or last[r.html] == r.id else last[r.html]) for r in rows)


def test_passes_leave_one_table_behind(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wu_manber, "BLOCK_BYTES", 1)
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    docs = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2}") for i in range(20)], "doc_id long, text string")
    items = spark.createDataFrame([(f"i{k}", f"w{k} w{k + 1} w{k + 2}") for k in range(4)], "item_id string, text string")
    hit = {r.doc_id for r in wu_manber.decontaminate(docs, items).where("size(item_ids) > 0").collect()}
    assert hit == {0, 1, 2, 3} and len([p for p in tmp_path.iterdir() if p.name.startswith("plazalake-")]) == 1
    assert {r.doc_id for r in wu_manber.keep_clean(docs, items).collect()} == set(range(4, 20))


def test_counts_by_trees_and_by_replay_agree():
    import random

    from plazalake.llm.byte_bpe import MergeReplay, read_ranks

    random.seed(3)
    replay = MergeReplay(read_ranks(MULTI))
    words = ["".join(random.choices("aeinrst üß日", k=random.randint(1, 90))).encode() for _ in range(2000)] + [b"a", b"aa", b" the", "日".encode()]
    assert token_rollup.token_counts(replay, words) == [len(ids) // 4 for ids in replay.encode(words)]


def test_near_duplicates_leave_two_tables(spark, tmp_path, monkeypatch):
    import random

    from plazalake.llm import minhash

    random.seed(7)
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    base = [f"w{random.randint(0, 900)}" for _ in range(80)]
    rows = [(i, " ".join(base[: 80 - i % 3] + [f"x{i}"])) for i in range(40)] + [(100 + i, f"alone {i} " * 3) for i in range(20)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 60 and sum(r.kept for r in got) == 21
    assert sorted(p.name.split("-")[1] for p in tmp_path.iterdir() if p.name.startswith("plazalake-")) == ["roots", "sketches"]


def test_code_length_per_byte(spark):
    from plazalake.llm import context_tree

    docs = spark.createDataFrame([(i, "the cat and the hat " * 20) for i in range(12)] + [(50, None), (51, "Zq")], "doc_id long, text string")
    got = {r.doc_id: r for r in context_tree.score_texts(docs).collect()}
    import math

    n = len(("the cat and the hat " * 20).strip()) + 1
    assert abs(got[0].bits_per_byte + got[0].score * math.log2(10) / n) < 1e-9 and got[0].bits_per_byte < 1
    assert abs(got[50].bits_per_byte + got[50].score * math.log2(10)) < 1e-9 and got[51].bits_per_byte > got[0].bits_per_byte


def test_a_column_that_holds_no_languages(spark, monkeypatch):
    import pytest

    from plazalake.llm import lang_mixture

    monkeypatch.setattr(lang_mixture, "MOST_LANGS", 3)
    docs = spark.createDataFrame([(i, "some words here", f"l{i}") for i in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 3 languages"):
        lang_mixture.train(docs)
