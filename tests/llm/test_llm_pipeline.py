import pytest

import corpus_pipeline
from plazalake.llm import byte_bpe, minhash
from plazalake.llm.registry import queries

SF = "/root/testdata/sf0.001"


def test_pipeline_by_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        assert docs.select("doc_id").distinct().count() == docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_all_numbered_queries_are_registered():
    assert {n.split("_")[0] for n in queries()} == {f"op{i}" for i in range(1, 14)}


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3), (None, "c d", None, "s", 3)]])
def test_pipeline_edges(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in docs.collect()) == (["3", "None"] if rows else [])


def test_pipeline_rows_of_one_id(spark):
    """Verdicts go by row; columns that clash with the operators' own pass through."""
    long = "viele Wörter ohne Ende " * 20_000
    rows = [(1, None), (1, "a good text of one"), (3, "short text"), (3, "short text  "), (3, "quite another text"), (None, "no id here"), (None, "no id here"), (None, "12 34"), (5, long), (6, long + " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' as lang", "'s' as source", "7L as n_chars", "doc_id as _same", "1 as kept", "2 as id", "'h' as hash", "3 as row", "4 as node", "5 as own", "6 as keep_id", "7 as component", "8 as exact", "9 as run"
    )
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    got = sorted((str(r.doc_id), (r.text or "").strip(), r._same, r.row) for r in docs.collect())
    assert got == sorted([("1", "a good text of one", 1, 3), ("3", "short text", 3, 3), ("3", "quite another text", 3, 3), ("None", "no id here", None, 3), ("6", long.strip(), 6, 3)])
    assert all(r.exact for r in corpus_pipeline.encode(spark, docs, SF).collect())


def test_pipeline_by_force(spark, tmp_path):
    """run() against a plain reckoning of all five stages."""
    import random
    import re

    import numpy as np
    import public_tokenizers as P
    import tiktoken

    random.seed(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    base = [random.choices(words, k=60) for _ in range(40)]
    items = [" ".join(random.choices(words, k=14)) for _ in range(3)]
    texts = [" ".join(x) for x in base] + [" ".join(x) + " \n" for x in base[:5]] + [" ".join([*x[:59], "zz"]) for x in base[5:15]]
    texts += [t + " " + items[i % 3] for i, t in enumerate(map(" ".join, base[20:24]))] + [None, "", "12 34 !", "ab", " ab"]
    rows = [(i * 7 % 101, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")

    left = {i: t for i, t, *_ in rows if t and re.search("[A-Za-z]", t)}
    groups = {}
    for i, t in left.items():
        groups.setdefault(re.sub(r"\s", "", t), []).append((-len(t), i))
    left = {min(g)[1]: left[min(g)[1]] for g in groups.values()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in left.items() for w in [t.lower().split()]}
    root = {i: i for i in left}
    for a in sorted(left):
        for b in sorted(left):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = sorted((root[a], root[b]))[::-1]
                root = {i: new if r == old else r for i, r in root.items()}
    left = {i: t for i, t in left.items() if root[i] == i}
    windows = {tuple(w[k : k + 10]) for w in map(str.split, items) for k in range(5)}
    left = {i: t for i, t in left.items() if not any(tuple(w[k : k + 10]) in windows for w in [t.split()] for k in range(len(w)))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {i: library.encode_ordinary(t) for i, t in left.items()}
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == want and len(got) == len(want) < len(rows)
    assert all(r.exact and r.n_tokens == len(want[r.doc_id]) for r in got)


def test_near_stage_links_from_0_8(spark):
    words = [f"w{i}x" for i in range(200)]
    other = [f"changed{i}" if i in (20, 70, 120, 170) else w for i, w in enumerate(words)]
    x, y = (minhash.shingles(" ".join(w)) for w in (words, other))
    both = len(set(x.tolist()) & set(y.tolist()))
    assert 80 <= 100 * both / (len(x) + len(y) - both) < 85
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join(other), "en", "s", 1), (3, "another text of other words altogether", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, SF).collect()) == [1, 3]


def test_bands_miss_few_at_any_threshold():
    assert (minhash.bands_of(85), minhash.bands_of(80)) == (28, 44)
    assert all((1 - (p / 100) ** minhash.ROWS) ** minhash.bands_of(p) <= 2e-6 for p in range(50, 101))
