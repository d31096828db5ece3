"""Lexical search, top-k search and whitening against brute force, and on odd rows."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from stratal.llm import kdtree, lexical, queries, textkernel, whiten
from stratal.llm.vectors import Form
from tests.conftest import DATA

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranked(docs, items, k):
    """(item, rank, doc_id, score) by the contract, document by document."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, l = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n // l if l else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(terms(text)) if b[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return out


def listed(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


DOCS = [
    (1, "The cat sat on the mat."), (2, None), (3, ""), (4, " \t--!!"), (5, "the CAT the cat"), (5, "the CAT the cat"), (None, "cat and dog"), (6, "Ünï 日本 cat_dog x1"),
    (7, "dog " * 30_000 + "cat"), (8, "mat " * 300), (9, "zebra"), (10, "the cat sat on the mat."),
]
ITEMS = [(1, "cat mat"), (1, "cat mat"), (2, None), (3, ""), (4, "unknown words only"), (None, "dog 日本 cat"), (5, "Zebra zebra ZEBRA the")]
EXTRA = ", item long, term long, rank int, score string, shard int, words string"


def with_extra(spark, rows, schema):
    return spark.createDataFrame([(*r, 1, 2, 3, "s", 4, "w") for r in rows], schema + EXTRA)


@pytest.mark.parametrize("small", [False, True])
def test_ranked_on_odd_rows(spark, monkeypatch, small):
    if small:  # many shards, several blocks of items, all terms indexed
        monkeypatch.setattr(lexical, "SHARD_DOCS", 3)
        monkeypatch.setattr(lexical, "ITEMS", 2)
        monkeypatch.setattr(lexical, "TERMS", 0)
    docs, items = with_extra(spark, DOCS, "doc_id long, text string").coalesce(1), with_extra(spark, ITEMS, "item_id long, text string")
    got = listed(lexical.ranked(docs, items, 4))
    assert got == sorted(brute_ranked(DOCS, ITEMS, 4), key=str)
    if not small:
        assert lexical.ranked(docs.where("false"), items).count() == 0 and lexical.ranked(docs, items.where("false")).count() == 0


def test_ranked_needs_no_text_in_utf8(spark):
    docs = spark.sql("SELECT id AS doc_id, concat('a ', CAST(unhex('C3') AS STRING), ' b') AS text FROM range(3)")
    items = spark.sql("SELECT 1L AS item_id, concat('x ', CAST(unhex('C3') AS STRING)) AS text")
    assert lexical.ranked(docs, items).count() == 0 or lexical.ranked(docs, items).count() == 3


def test_blocks_are_the_best_cut():
    """Against every way to cut short lists."""
    rng = np.random.default_rng(5)
    lists = [rng.integers(0, 50, n) for n in (1, 2, 7, 9, 4, 1)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    docs = [np.sort(rng.choice(30, len(x), replace=False)) for x in lists]
    ends, begin = lexical.block_ends(np.concatenate(docs), np.concatenate(lists), first, most=4, cost=0.7)

    def cost(i, cut):
        x, d = lists[i], docs[i]
        parts = [(x[a:b], d[b - 1] + 1 - d[a]) for a, b in zip([0, *cut], [*cut, len(x)], strict=True)]
        return sum(n * p.max() - p.sum() + 0.7 * max(1e-9, x.max()) for p, n in parts) if all(len(p) <= 4 for p, _ in parts) else math.inf

    for i, x in enumerate(lists):
        own = ends[begin[i] : begin[i + 1]] - first[i]
        assert own[-1] == len(x) and (np.diff(own) > 0).all()
        best = min(cost(i, cut) for n in range(len(x)) for cut in combinations(range(1, len(x)), n))
        assert math.isclose(cost(i, own[:-1].tolist()), best, rel_tol=1e-9, abs_tol=1e-6)


def test_search_skips_blocks():
    """A rare term of high weight decides: most postings of the frequent one are not read, and the result is whole."""
    n = 20_000
    rng = np.random.default_rng(1)
    length = rng.integers(20, 400, n).astype("<u4")
    rare = np.sort(rng.choice(n, 80, replace=False)).astype("<u2")
    head = {"docs": np.arange(n, dtype=np.int64).tobytes(), "counts": length.tobytes(), "many": np.ones(n, np.uint8).tobytes()}
    rows = [{"term": t, "df": len(d), "docs": d.tobytes(), "counts": np.ones(len(d), np.uint8).tobytes(), "many": b""} for t, d in ((1, np.arange(n, dtype="<u2")), (2, rare))]
    s = lexical.Shard.of(head, rows, n, int(length.sum()))
    read = []
    gather = textkernel.ranges

    def spy(starts, counts):
        out = gather(starts, counts)
        read.append(len(out))
        return out

    textkernel.ranges, before = spy, textkernel.ranges
    try:
        doc, score = s.search(np.array([1, 2]), np.array([10, 5000]), 50)
    finally:
        textkernel.ranges = before
    assert sum(read[1:]) < n // 2
    m = 50 + 50 * length.astype(np.int64) * n // int(length.sum())
    want = (10 + 5000 * np.isin(np.arange(n), rare)) * (10**9 // (1000 + 20 * m))
    order = np.lexsort((np.arange(n), -want))[:50]
    assert doc.tolist() == order.tolist() and score.tolist() == want[order].tolist()


# --- top-k by KD-trees


def brute_top(rows, k, every):
    ok = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    ok = sorted(set(ok))
    out = {}
    for i, x in ok:
        if i % every == 0:
            for j, y in ok:
                if i != j:
                    score = sum(a * b for a, b in zip(x, y, strict=False))
                    out.setdefault(i, set()).add((-score, j, y, x))
    return sorted((i, r + 1, j, -s) for i, c in out.items() for r, (s, j, _, _) in enumerate(sorted(c)[:k]))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, q long, score long, x string")


@pytest.mark.parametrize("spread", [1.0, 40.0, 1e6])
def test_top_k(spark, monkeypatch, spread):
    """Clusters in few dimensions (bounds that skip), ties, copies; numbers of 16, 32 and 64 bits."""
    monkeypatch.setattr(kdtree, "LEAF", 4)
    monkeypatch.setattr(kdtree, "TREE", 32)
    monkeypatch.setattr(kdtree, "BLOCK", 7)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(400, 3)) * spread) / 4
    x[50:80] = x[50]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    got = sorted(tuple(r) for r in kdtree.top_k(vectors(spark, rows), 5, 10).collect())
    assert got == brute_top(rows, 5, 10)


def test_top_k_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [1.0]), (50, [0.5, 0.5]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [9.0, 9.0]),
        (100, []), (7, [-0.001, 0.0]), (8, [1.0, 2.0]), (-50, [1.0, 2.0]),
    ]
    df = vectors(spark, rows)
    got = kdtree.top_k(df, 3, 50).collect()
    lists = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 50, 100, -50)}
    same = 256 * 256 + 512 * 512
    assert lists[0] == [(-50, same), (1, same), (8, same)] and lists[-50] == [(0, same), (1, same), (8, same)]
    assert lists[100] == [(-50, 0), (0, 0), (1, 0)] and len(lists[50]) == 3 and 50 not in [v for v, _ in lists[50]]
    assert {r["query_id"] for r in got} == {0, 50, 100, -50}
    assert kdtree.top_k(df.where("false")).count() == 0 and kdtree.top_k(df.where("vec_id = 1")).count() == 0
    assert kdtree.top_k(df.where("vec_id = 0")).count() == 0


def test_traversal_leaves_out_boxes():
    """With separated clusters only few points are compared, and no neighbour is lost."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 4)) * 1000
    x = np.concatenate([c + rng.normal(size=(100, 4)) for c in centres]).astype(np.int64)
    x = x[kdtree.median_order(x, 16)]
    tree = kdtree.Tree.of(x, 16)
    assert tree.end[tree.left < 0].sum() - tree.start[tree.left < 0].sum() == len(x)
    ids = np.full((len(x), 6), kdtree.LAST)
    ids[:, 0] = np.arange(len(x))
    who, own, score = kdtree.search(tree, ids, x[:50], np.full(50, kdtree.NONE), 6, np.dtype(np.float64))
    want = x[:50] @ x.T
    for q in range(50):
        order = np.lexsort((np.arange(len(x)), -want[q]))[:6]
        assert own[who == q].tolist() == order.tolist() and score[who == q].tolist() == want[q][order].tolist()
    bound = kdtree.reach(x[:50], tree.low, tree.high, np.dtype(np.float64))
    leaves = tree.left < 0
    kth = np.array([score[who == q].min() for q in range(50)])
    assert (bound[:, leaves] >= kth[:, None]).mean() < 0.3
    assert (bound[:, 0] >= want.max(1)).all()


def test_top_k_of_the_table(spark, duck):
    got = sorted(tuple(r) for r in queries.op12_kdtree(spark, DATA).collect())
    assert got == sorted(duck.sql(queries.OP12_SQL).fetchall())


# --- whitening


def test_whitening(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 6)) * [3, 2, 1, 0.7, 0.2, 0.1] + 5
    base[100:160] = base[100]
    rows = [(i, v.tolist()) for i, v in enumerate(base.astype(np.float32).astype(float))]
    odd = [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (None, rows[3][1])]
    got = whiten.whitened(vectors(spark, rows + odd), 4).collect()
    ids = {i for i, _ in rows} | {None}
    assert len(got) == 301 * 4 and {r["vec_id"] for r in got} == ids and len({r["identity_error"] for r in got}) == 1
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    once = np.unique(x, axis=0)
    n, s = len(once), once.sum(0)
    v = np.cov(once.T.astype(float), bias=True)
    e, d = np.linalg.eigh(v)
    e, d = e[::-1], d[:, ::-1]
    for r in got:
        i = 3 if r["vec_id"] is None else r["vec_id"]
        assert r["n"] == n and r["deviation"] == int(((n * x[i] - s) ** 2).sum()) == int(r["deviation_exact"]) and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], e[r["component"] - 1] / np.trace(v), rel_tol=1e-9)
    for c in range(4):
        w = np.array([r["whitened"] for r in sorted((r for r in got if r["component"] == c + 1 and r["vec_id"] is not None), key=lambda r: r["vec_id"])])
        want = (x - s / n) @ d[:, c] / np.sqrt(e[c])
        assert min(np.abs(w - want).max(), np.abs(w + want).max()) < 1e-9


def test_whitening_without_variance(spark):
    df = vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert whiten.whitened(df).count() == 0 and whiten.whitened(df.where("false")).count() == 0 and whiten.whitened(vectors(spark, [(1, [])])).count() == 0
    one = whiten.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.5, 2.0]), (3, [1.5])])).collect()
    assert {r["component"] for r in one} == {1, 2} and all(r["identity_error"] < 1e-9 for r in one)


def test_deviations_beyond_64_bits():
    """Exact in Python's integers, and null as long."""
    c = whiten.Centre(Form(2, 1 << 30), 10**9, (5, 7))
    x = np.array([[1 << 30, -(1 << 30)]], "<i8")
    d = [10**9 * (1 << 30) - 5, -(10**9) * (1 << 30) - 7]
    assert c.apart(x).tolist() == [d] and c.deviation(c.apart(x)).tolist() == [d[0] ** 2 + d[1] ** 2]
