"""The pipeline's stages one by one against brute force, and the SQL of the queries that have it."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from stratal.llm import langid, queries, spviterbi
from tests.conftest import DATA
from tests.llm.test_llm import brute_components, brute_matches, brute_removed, words
from tests.test_catalogue import rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output, through Parquet."""
    docs, out = queries.table(spark, DATA, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        path = "file://" + str(tmp_path_factory.mktemp(name) / "t")
        f(spark, docs, DATA).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, stages):
    assert [n for n, _, _ in stages] == ["language", "near_duplicates", "repeated_passages", "benchmark_leaks", "encoding"]
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes
    _, before, after = stages[0]
    assert set(texts(before)) - set(texts(after)) == set()
    _, before, after = stages[1]
    assert set(texts(after)) == {i for i, (_, c) in brute_components(list(texts(before).items())).items() if i == c}
    _, before, after = stages[2]
    a, b = texts(before), texts(after)
    want = {i: n for i, n, gone, _ in brute_removed(list(a.items()), 50) if gone < n or not n}
    assert set(b) == set(want)
    gone = {i: g for i, _, g, _ in brute_removed(list(a.items()), 50)}
    assert all(len(words(b[i])) == want[i] - gone[i] and (gone[i] or a[i] == b[i]) for i in b)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect() if gone[r["doc_id"]])
    _, before, after = stages[3]
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, DATA, "benchmark").collect()]
    leaked = {d for d, _ in brute_matches(list(texts(before).items()), items)}
    assert leaked and set(texts(after)) == set(texts(before)) - leaked
    _, before, after = stages[4]
    back = spviterbi.decode(after, queries.tokenizer_path("piece_bpe_32k.model"))
    assert texts(back) == texts(before)


def test_run(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "n_tokens").collect())) == sorted(map(tuple, stages[-1][2].select("doc_id", "n_tokens").collect()))


def test_language_stage_rejects(spark):
    docs = queries.table(spark, DATA, "documents")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "123 456 !!", "en", "s", 10), (10**6 + 2, "ъыьэюя жзийкл мнопрс " * 20, "en", "s", 400)], docs.schema)
    kept = corpus_pipeline.language(spark, docs.unionByName(odd), DATA)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def folder(tmp_path, spark, docs, items):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    items.write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}"


def test_whole_run_against_brute_force(spark, tmp_path):
    """All five stages over a table with copies, shared passages, leaks, odd rows and repeated ids, against plain Python."""
    rng = random.Random(11)
    vocabulary = {"aa": ["bale", "mino", "taru", "sepa", "lodi", "gane"], "bb": ["krusht", "zwolf", "schrat", "prumm", "strick"]}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) + str(rng.randrange(60)) * (rng.random() < 0.8) for _ in range(n))
    items = [(i, text("aa", 20)) for i in range(4)] + [(9, None), (None, "lost words")]
    passage, rows = text("bb", 60), []
    for i in range(40):
        lang = rng.choice(["aa", "bb"])
        t = text(lang, rng.randint(10, 80))
        if i % 5 == 1:
            t = t + " " + passage
        if i % 7 == 2:
            t = items[i % 4][1] + " " + t
        if i % 6 == 3:
            t = rows[rng.randrange(len(rows))][1]
        rows.append((i, t, lang))
    rows += [(50, None, "aa"), (51, "", None), (52, "12 34 !!", "bb"), (3, "mino taru once more " * 9, "aa"), (None, text("aa", 70), "aa"), (60, " ".join(words(passage)[:52]), "bb")]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    docs = spark.createDataFrame([(i, t, l, "s", len(t) if t else None) for i, t, l in rows], schema)
    path = folder(tmp_path, spark, docs, spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, path).collect()}

    profiles = langid.learn(docs)
    kept = [(i, t) for i, t, _ in rows if t and (p := profiles.predict(t))[0] != "und" and p[2] >= langid.LEAST]
    assert {50, 51, 52}.isdisjoint(i for i, _ in kept) and len(kept) == len(rows) - 3
    # a doc_id with two texts: each row is judged by its own set; so brute force takes rows by number
    numbered = dict(enumerate(sorted((x for x in kept if x[0] is not None), key=lambda x: x[0])))
    component = brute_components([(n, t) for n, (_, t) in numbered.items()])
    kept = [numbered[n] for n, (_, c) in component.items() if c == n] + [x for x in kept if x[0] is None]
    left = []
    first = {}
    for i, t in kept:
        w = words(t)
        for j in range(len(w) - 49):
            if i is not None:
                first[tuple(w[j : j + 50])] = min(i, first.get(tuple(w[j : j + 50]), i))
    for i, t in kept:
        w, gone = words(t), set()
        for j in range(len(w) - 49):
            if i is not None and first[tuple(w[j : j + 50])] < i:
                gone.update(range(j, j + 50))
        if len(gone) < len(w):
            left.append((i, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t))
    named = {n: t for n, (_, t) in enumerate(left)}
    leaked = {n for n, _ in brute_matches(list(named.items()), [x for x in items if None not in x])}
    assert leaked and len(left) < len(kept)
    codec = spviterbi.Codec(queries.tokenizer_path("piece_bpe_32k.model"))
    want = {(i, tuple(np.frombuffer(x, codec.pieces.width).tolist())) for (i, _), x in zip([left[n] for n in named if n not in leaked], codec.encode([named[n] for n in named if n not in leaked]), strict=True)}
    assert got == want


def test_run_on_empty_tables(spark, tmp_path):
    docs, items = queries.table(spark, DATA, "documents"), queries.table(spark, DATA, "benchmark")
    one, two = tmp_path / "one", tmp_path / "two"
    assert corpus_pipeline.run(spark, folder(one, spark, docs.limit(0), items)).count() == 0
    some = docs.where("doc_id < 30")
    kept = corpus_pipeline.run(spark, folder(two, spark, some, items.limit(0)))
    assert 0 < kept.count() <= some.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    got = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())
