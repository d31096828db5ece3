"""Each training-data operator against brute force, a round trip or held-out accuracy, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratal.llm import components, decontam, gru_lm, langid, ngram_join, quality, queries, rlz, sharding, spotsigs, spviterbi, textkernel, token_store
from tests.conftest import DATA

ODD = [
    (1, "the cat sat on the mat and the dog ran to the house with a ball", "en"), (2, None, "en"), (3, "", "en"), (4, "   \t\n ", None),
    (5, "the cat sat on the mat and the dog ran to the house with a ball", "en"), (5, "the cat sat on the mat and the dog ran to the house with a ball", "en"),
    (None, "the cat sat on the mat and the dog ran to the house with a ball", "en"), (6, "one two", None), (7, "word " * 5000, "en"), (8, "x" * 70_000, "en"),
    (-9, "Ünïcode ▁ text 日本 𝄞\r\nline", "de"), (10, "12345 !!! ???", None),
]
SCHEMA = "doc_id long, text string, lang string, score string, n int, cid string, row string, mark string, rest string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, l, "s", 1, "c", "r", "m", "x", len(t) if t else None) for i, t, l in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return queries.table(spark, DATA, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# --- the text kernel


def test_words_and_runs():
    data = ["a bb  ccc\n", None, "", "  ", "x" * 100 + " y", "A\x0bB\x0cC", "é è\xa0z"]
    for column in (pa.array(data), pa.array(["skip", *data])[1:]):
        w = textkernel.split_words(column)
        got = [[w.word(i).decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        assert got == [words(t) for t in data]
    rng = random.Random(1)
    w = textkernel.split_words(pa.array([" ".join(rng.choice("abcd") * rng.randint(1, 20) for _ in range(300))]))
    h = w.hashes()
    assert len({w.word(i) for i in range(300)}) == len(set(h.tolist()))
    for k in (1, 2, 5, 50):
        runs = textkernel.runs_of(h, k)
        seqs = [tuple(h[i : i + k].tolist()) for i in range(len(h) - k + 1)]
        assert len(runs) == len(seqs) and len(set(seqs)) == len(set(runs.tolist())) == len(set(zip(seqs, runs.tolist(), strict=True)))
    assert textkernel.sliding_min(np.array([3, 1, 2, 5, 4]), 3).tolist() == [1, 1, 2]
    assert rlz.first_least(np.array([3, 1, 1, 5, 1], np.uint64), 3).tolist() == [1, 1, 2]


# --- 1 language identification


def test_language_held_out_accuracy(spark, docs):
    rows = queries.op1_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(held) > 20 and sum(held) / len(held) > 0.95


def test_profile_counts_against_brute_force():
    text = "Ab, abc! x" + "é" * 3
    grams = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        marked = f"_{word}_"
        grams.update(word)
        grams.update(marked[i : i + 2] for i in range(len(marked) - 1))
        grams.update(marked[i : i + 3] for i in range(len(marked) - 2))
    codes, counts = langid.gram_counts(text)

    def decode(c):
        out = ""
        while c:
            out, c = ("_" if c & 0x1FFFFF == 1 else chr((c & 0x1FFFFF) - 1)) + out, c >> 21
        return out

    got = Counter({decode(int(c)): int(n) for c, n in zip(codes, counts, strict=True)})
    assert got == grams


def brute_grams(text):
    """Counts of the n-grams, with word ends marked; the code of one orders as the signs do, the mark before letters."""
    grams = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        marked = f"\0{word}\0"
        grams.update(word)
        grams.update(marked[i : i + 2] for i in range(len(marked) - 1))
        grams.update(marked[i : i + 3] for i in range(len(marked) - 2))
    return grams


def brute_ranked(grams, size):
    code = lambda g: sum((1 if c == "\0" else 1 + ord(c)) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def test_distances_and_predictions_against_brute_force(spark, texts):
    rng = random.Random(2)
    train = [(i, " ".join(rng.choice(v) for _ in range(30)), lang) for i, (lang, v) in enumerate((l, v) for l, v in (("aa", ["ab", "bab", "abba"]), ("bb", ["cd", "dcd"]), ("cc", ["ef", "abef"])) for _ in range(4))]
    profiles = langid.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"), size=25)
    of = {lang: brute_ranked(sum((brute_grams(t) for _, t, x in train if x == lang), Counter()), 25) for lang in ("aa", "bb", "cc")}
    for text in [*(t for t in list(texts.values())[:20] if t), "abba cd ef", "ab", "zz Zq"]:
        mine = brute_ranked(brute_grams(text), 25)
        if not mine:
            continue
        far = {l: sum(abs(r - p.index(g)) if g in p else 25 for r, g in enumerate(mine)) / (25 * len(mine)) for l, p in of.items()}
        best = min(far, key=lambda l: (far[l], l))
        second = sorted(far.values())[1]
        lang, score, near = profiles.predict(text)
        assert lang == best and math.isclose(near, 1 - far[best], abs_tol=1e-12)
        assert math.isclose(score, second / (second + far[best]) if second + far[best] else 0.5, abs_tol=1e-12)


def test_a_tie_of_two_languages(spark):
    rows = [(1, "same words here", "zz"), (2, "same words here", "aa"), (3, "other things", "mm")]
    profiles = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert profiles.predict("same words here")[:2] == ("aa", 0.5)


def test_language_odd_rows(spark, odd, empty):
    profiles = langid.learn(odd)
    got = langid.predict(odd, profiles).collect()
    assert len(got) == len(ODD)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {2, 3, 4, 10}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.keep(odd, profiles, 0).columns == odd.columns
    nothing = langid.learn(empty)
    assert {r["lang_pred"] for r in langid.predict(odd, nothing).collect()} == {"und"} and langid.predict(empty, profiles).count() == 0


# --- 2 n-gram Jaccard join


def brute_sets(rows):
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return sets


def brute_components(rows):
    sets = brute_sets(rows)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed=3, groups=6, size=40):
    """Groups of edited copies, a passage that many share, and short texts: large blocks and chains."""
    rng = random.Random(seed)
    rows, n = [], 0
    shared = " ".join(f"s{i}" for i in range(60))
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.randint(30, 200))]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    for i in range(60):
        rows.append((n, shared + " " + " ".join(f"u{i}x{j}" for j in range(rng.randint(5, 40)))))
        n += 1
    rows += [(n + i, t) for i, t in enumerate(["a b c", "a b c", "a b", "", None, "A B C"])]
    rng.shuffle(rows)
    return rows


def test_components_against_brute_force(spark):
    rows = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("limits", [{"TILE": 16}, {"TILE": 7, "SMALL": 2, "PIECE": 40}, {"HOT": 32, "HOT_SHARE": 1, "TILE": 64}, {"SMALL": 0, "GROUPS": 4, "LEAF": 2}])
def test_large_blocks_in_tiles(spark, monkeypatch, limits):
    """Blocks cut into tiles and pieces, hot keys dealt to several tasks, and a weak bound change no result."""
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = near_copies(seed=9, groups=3, size=60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if "HOT" in limits:
        _, found = ngram_join.join_classes(docs)
        assert found.members.count()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs).collect()}
    assert got == brute_components(rows)


def test_links_against_brute_force(spark):
    rows = near_copies(seed=5, groups=3, size=30)
    members, links = ngram_join.class_links(spark.createDataFrame(rows, "doc_id long, text string"))
    of = {r["doc_id"]: r["class_id"] for r in members.collect()}
    sets = brute_sets(rows)
    assert of.keys() == {d for d, s in sets.items() if s} and all(sets[d] == sets[c] for d, c in of.items())
    reps = sorted(set(of.values()))
    want = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    got = [tuple(r) for r in links.collect()]
    assert sorted(got) == sorted(want) and want


def points(sets):
    return ngram_join.points_of([ngram_join.point(s) for s in sets])


def test_tree_keeps_every_pair_that_can_link():
    """The tree gives the same pairs as comparing all points; boxes and sizes leave out most of them."""
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(12):
        base = np.unique(rng.integers(0, 2**63, int(rng.integers(20, 300))).astype(np.uint64))
        sets += [np.unique(np.concatenate([base[rng.random(len(base)) < 0.93], rng.integers(0, 2**63, int(rng.integers(0, 9))).astype(np.uint64)])) for _ in range(20)]
    order = rng.permutation(len(sets))
    p = points([sets[i] for i in order])
    n, group = p.sum(1), rng.integers(0, 200, len(p))
    left = n - rng.integers(0, 4, len(p))
    want = {
        (a, b) for a in range(len(p)) for b in range(a + 1, len(p))
        if group[a] != group[b] and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b]) and 180 * min(np.minimum(p[a], p[b]).sum(), left[a], left[b]) >= 80 * (n[a] + n[b])
    }
    tree = ngram_join.RTree(p, n, left, group)
    got = [(min(int(a), int(b)), max(int(a), int(b))) for i, j, _ in tree.meet(tree) for a, b in zip(i, j, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want and want
    assert len(tree.levels) > 3 and all((top >= tree.points[lo:hi]).all() for (top, *_), edges in zip(tree.levels, tree.edges, strict=True) for top, lo, hi in zip(top, edges[:-1], edges[1:], strict=True))
    halves = [ngram_join.RTree(p[s::2], n[s::2], left[s::2], group[s::2]) for s in (0, 1)]
    both = {tuple(sorted((2 * int(a), 2 * int(b) + 1))) for i, j, _ in halves[0].meet(halves[1]) for a, b in zip(i, j, strict=True)}
    assert both == {x for x in want if (x[0] + x[1]) % 2}


@pytest.mark.parametrize("groups", [1, 4, 512])
def test_counts_keep_every_link(monkeypatch, groups):
    """Also where groups hold more than a byte counts."""
    monkeypatch.setattr(ngram_join, "GROUPS", groups)
    rng = np.random.default_rng(groups)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    rows, links = [], []
    for i in range(60):
        n = int(rng.integers(5, 2000))
        a = np.unique(rng.choice(pool, n))
        b = np.unique(np.concatenate([a[: int(len(a) * rng.uniform(0.7, 1))], rng.choice(pool, int(rng.integers(1, 1 + n // 6)))]))
        rows.append((i, i, ngram_join.point(a), ngram_join.point(b)))
        links.append(180 * len(np.intersect1d(a, b)) >= 80 * (len(a) + len(b)))
    batch = pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["a", "b", "va", "vb"])
    kept = {i for out in ngram_join._bound(iter([batch])) for i in out.column("a").to_pylist()}
    assert kept >= {i for i, link in enumerate(links) if link} and any(links)
    assert groups < 512 or len(kept) < 60


def test_rows_without_a_partner_leave_their_block():
    rng = np.random.default_rng(6)
    for _ in range(60):
        block = np.sort(rng.integers(0, 4, 40))
        n = rng.integers(1, 30, 40)
        order = np.lexsort((n, block))
        n, left = n[order], np.maximum(n[order] - rng.integers(0, 5, 40), 0)
        start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        want = [
            any(j != i and block[i] == block[j] and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j]) and 180 * left[i] >= 80 * (n[i] + n[j]) for j in range(40))
            for i in range(40)
        ]
        assert ngram_join.partnered(start, np.diff(np.append(start, 40)), n, left).tolist() == want


def test_one_of_each_where_a_doc_id_repeats(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, "p"), (5, a + " z", "q"), (5, b, "r"), (5, b + " y", "s"), (5, "", "t"), (9, b, "u")]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, many_id string")).collect()
    assert sorted((r["doc_id"], r["many_id"]) for r in kept if r["many_id"] not in "rs") == [(1, "p"), (5, "t")]
    assert len([r for r in kept if r["many_id"] in "rs"]) == 1


def test_join_odd_rows(spark, odd, empty):
    got = ngram_join.ngram_components(odd).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["component_id"] == 1 and by[2]["component_id"] == 2 and by[3]["n_shingles"] == 0 and by[None]["component_id"] is None and by[6]["n_shingles"] == 1
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == sorted((i is None, i) for i in (1, 2, 3, 4, None, 6, 7, 8, -9, 10))
    assert ngram_join.ngram_components(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (200, 170)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 150: 150, 170: 150, 200: 150}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 3 token files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))


def test_elias_fano():
    rng = random.Random(4)
    for n in (0, 1, 2, 255, 256, 257, 2000):
        for top in (1, 5, 1000, 10**9, 2**40):
            v = sorted(rng.randrange(top) for _ in range(n))
            e = token_store.EliasFano.from_bytes(token_store.EliasFano.of(v).to_bytes())
            assert e.to_array().tolist() == v and all(e.select(i) == v[i] for i in range(0, n, 7))
            if n == 2000 and top == 10**9:
                assert len(e.to_bytes()) * 8 < n * (2 + math.log2(top / n) + 1.5)
    with pytest.raises(IndexError):
        token_store.EliasFano.of([1]).select(1)


def expected_tokens(rows, tokenizer):
    start, out = 0, []
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, docs, texts, tokenizer, tmp_path):
    path = f"file://{tmp_path}/t"
    token_store.write_tokens(docs, path, queries.tokenizer_path("word_bpe_49k.json"), 2, block_bytes=20_000)
    assert len(list((tmp_path / "t").glob("block=*"))) > 5
    got = sorted(tuple(r) for r in token_store.read_tokens(spark, path).collect())
    assert got == expected_tokens(sorted(texts.items()), tokenizer)
    some = sorted(texts)[17]
    assert token_store.read_document(spark, path, some) == [tokenizer.encode(texts[some], add_special_tokens=False).ids + [2]]
    assert token_store.read_document(spark, path, -5) == []


def test_token_files_end_by_bytes(spark, docs, texts, tokenizer, tmp_path, monkeypatch):
    """Few blocks, which hold many segments in many files: what is read is the same, and a file ends with the segment that fills it."""
    monkeypatch.setattr(token_store, "MAX_BLOCKS", 2)
    token_store.write_tokens(docs, f"file://{tmp_path}/t", queries.tokenizer_path("word_bpe_49k.json"), 2, block_bytes=1_000, segment_ids=150, file_bytes=1_500)
    files = list((tmp_path / "t").glob("block=*/part=*/part-*"))
    assert len(list((tmp_path / "t").glob("block=*"))) == 2 and len(files) > 22  # parts of two digits
    for f in files:
        sizes = [s.size for s in token_store.segments(f.read_bytes())]
        assert sum(sizes[:-1]) < 1_500
    assert len({len(list(token_store.segments(f.read_bytes()))) for f in files}) > 1
    assert sorted(tuple(r) for r in token_store.read_tokens(spark, f"file://{tmp_path}/t").collect()) == expected_tokens(sorted(texts.items()), tokenizer)


def test_token_files_odd_rows(spark, odd, empty, tokenizer, tmp_path):
    p = queries.tokenizer_path("word_bpe_49k.json")
    more = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(20, "a<|endoftext|>b <|ENDOFTEXT|> It's, x1. Ǆ İI"), (21, "...!? 'S")], "doc_id long, text string"))
    token_store.write_tokens(more, f"file://{tmp_path}/o", p, 2)
    got = token_store.read_tokens(spark, f"file://{tmp_path}/o").collect()
    rows = [(r["doc_id"], r["text"]) for r in more.collect()]
    want = expected_tokens(sorted(rows, key=lambda r: (r[0] is not None, r[0])), tokenizer)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    token_store.write_tokens(empty, f"file://{tmp_path}/e", p, 2)
    assert token_store.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


# --- 4 sharding


def check_shards(rows, n):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by.get(s, [])) for s in range(n)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards(spark, docs, texts):
    rows = queries.op4_hash_ring(spark, DATA).collect()
    check_shards(rows, 40)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items())


def brute_shards(cells, n, room, vnodes, bits):
    """Row by row: (cell, rank) to its place on the ring; rows that find it full go on clockwise, in the order of their cells."""
    points = sharding.ring(n, vnodes, bits)
    home = lambda cell: next((i for i, (c, _) in enumerate(points) if c >= cell), 0)
    used, out, over = [0] * n, {}, []
    for row in sorted(cells):
        s = points[home(row[0])][1]
        if used[s] < room[s]:
            used[s] += 1
            out[row] = s
        else:
            over.append(row)
    for row in over:
        at = home(row[0])
        clockwise = [points[(at + k) % len(points)][1] for k in range(1, len(points) + 1)] + list(range(n))
        s = next(s for s in clockwise if used[s] < room[s])
        used[s] += 1
        out[row] = s
    return out


@pytest.mark.parametrize(("n", "vnodes", "slack"), [(7, 4, 0.0), (5, 16, 0.25), (12, 2, 0.0)])
def test_ring_walk_against_brute_force(n, vnodes, slack):
    rng = random.Random(n)
    for _ in range(5):
        counts = {rng.randrange(256): rng.choice([1, 1, 2, 40]) for _ in range(60)}
        total = sum(counts.values())
        room = [math.ceil((1 + slack) * total / n)] * n if slack else [total // n + (s < total % n) for s in range(n)]
        want = brute_shards([(c, r) for c, k in counts.items() for r in range(k)], n, room, vnodes, 8)
        got, slots = {}, Counter()
        for x in sharding.plan(counts, n, vnodes, slack, 8):
            got |= {(x["cell"], r): x["shard"] for r in range(x["lo"], x["hi"])}
            slots.update((x["shard"], x["slot"] + k) for k in range(x["hi"] - x["lo"]))
        assert got == want
        assert sorted(slots) == sorted((s, k) for s, m in Counter(want.values()).items() for k in range(m)) and max(slots.values()) == 1


def test_bounded_loads_move_little(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    at = lambda df, n, s=0.0: {r["doc_id"]: r["shard"] for r in sharding.shard(df, n, slack=s).collect()}
    a, b = at(d, 20), at(d.where("doc_id < 19800"), 20)
    assert sum(a[i] != b[i] for i in b) < 0.25 * len(b)
    loose, more = at(d, 20, 0.25), at(d, 21, 0.25)
    assert max(Counter(loose.values()).values()) <= math.ceil(1.25 * 1000)
    assert sum(loose[i] != more[i] for i in loose) < 0.3 * len(loose)


def test_shards_odd_rows(odd, empty, spark):
    rows = sharding.shard(odd, 5).collect()
    check_shards(rows, 5)
    assert len(rows) == len(ODD) and sum(r["size"] == 16 for r in rows) == 2
    hot = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    check_shards(sharding.shard(hot, 40).collect(), 40)
    assert sharding.shard(empty, 40).count() == 0


# --- 5 fingerprints


def plain_words(text):
    return [x for x in re.sub(r"[\W_]+", " ", text).lower().split(" ") if x]


def brute_anchors(texts):
    c = Counter(x for t in texts for x in set(plain_words(t)))
    return set(sorted(c, key=lambda x: (-c[x], x.encode()))[: spotsigs.ANCHORS])


def brute_fingerprint(text, common):
    w = plain_words(text)
    md = lambda s: hashlib.md5(s.encode()).hexdigest()[:8]
    content = [x for x in w if x not in common]
    sigs = {md(" ".join(["^", *content[:2]]) if content else "^ " + text)}
    for i, x in enumerate(w):
        chain = [y for y in w[i:] if y not in common][:2]
        if x in common and len(chain) == 2:
            sigs.add(md(" ".join([x, *chain])))
    if not common.intersection(w):
        sigs |= {md(f"* {a} {b}") for a, b in zip(w[1:], w[2:])}
    return "-".join(sorted(sigs))


def test_fingerprints_against_brute_force(spark, texts, duck):
    rows = {r["doc_id"]: r for r in queries.op5_spotsigs(spark, DATA).collect()}
    ids, common = sorted(texts, reverse=True), brute_anchors(texts.values())
    for i, nxt in list(zip(ids, ids[1:] + ids[:1], strict=True))[:60]:
        t, n = texts[i], len(texts[i])
        edited = t[: n - n // 3] + texts[nxt][: n // 3]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (n, hashlib.sha256(edited.encode()).hexdigest(), brute_fingerprint(t, common))
        a, b, c = (set(brute_fingerprint(x, common).split("-")) for x in (t, edited, texts[nxt]))
        assert math.isclose(r["near_edited"], len(a & b) / len(a | b)) and math.isclose(r["near_next"], len(a & c) / len(a | c))
    assert len(rows) == len(ids)


def test_texts_without_anchors_differ_by_their_words(spark):
    """Texts that share their first two words and nothing else, in a language of their own, are not alike."""
    rows = [(i, f"und the a {i}") for i in range(200)] + [(900, "мама мыла раму вчера утром"), (901, "мама мыла окно сегодня вечером рано")]
    anchors = ["the", "und"]
    got = [r["f"] for r in spark.createDataFrame(rows, "doc_id long, text string").where("doc_id >= 900").select(spotsigs.fingerprint("text", anchors).alias("f")).collect()]
    one, two = (set(f.split("-")) for f in got)
    assert got == [brute_fingerprint(t, set(anchors)) for _, t in rows[-2:]] and len(one & two) == 1 and len(one | two) >= 6


def test_next_over_many_buckets(spark):
    ids = random.Random(5).sample(range(-500, 10**12), 700)
    rows = spark.createDataFrame([(i, f"t{i}", 0) for i in ids] + [(None, "null", 0)], "doc_id long, text string, mark long")
    got = {r["doc_id"]: r["next_text"] for r in spotsigs.with_next(rows, ["text"], bucket_rows=40).collect()}
    order = sorted(ids, reverse=True) + [None]
    name = lambda i: "null" if i is None else f"t{i}"
    assert got == {a: name(b) for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_fingerprints_odd_rows(spark, odd, empty):
    rows = spotsigs.fingerprints(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["near_next"] <= 1 and r["fingerprint"] for r in rows)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 5, None)}) == 1
    assert spotsigs.fingerprints(empty).count() == 0
    one = spotsigs.fingerprints(odd.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0


def test_near_pairs(spark, texts):
    some = dict(sorted(texts.items())[:80])
    edited = {10_000 + i: t + " the end" for i, t in some.items()}
    d = spark.createDataFrame(list((some | edited).items()), "doc_id long, text string")
    members, pairs = spotsigs.near_pairs(d, 0.8)
    common = brute_anchors((some | edited).values())
    prints = {brute_fingerprint(t, common) for t in (some | edited).values()}
    sets = {p: set(p.split("-")) for p in prints}
    want = {frozenset((a, b)) for a in prints for b in prints if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {frozenset((r["one"], r["two"])) for r in pairs.collect()} == want and want
    assert members.count() == 160


# --- 6 substring de-duplication


def brute_removed(rows, k):
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - k + 1):
            if i is not None:
                key = tuple(w[j : j + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "anchor"), [(50, 10), (12, 3)])
def test_removed_words_against_brute_force(spark, window, anchor):
    rng = random.Random(window)
    passages = [[f"p{p}w{rng.randrange(30)}" for _ in range(rng.randint(window, 3 * window))] for p in range(5)]
    rows = []
    for i in rng.sample(range(1000), 80):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            w += p[a:] if rng.random() < 0.5 else p
            w += [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))]
            w += ["again"] * rng.choice([0, 0, 2 * window])
        rows.append((i, " ".join(w)))
    rows += [(rows[0][0] + 5000, rows[0][1]), (2000, None), (2001, "")]
    got = rlz.remove_copies(spark.createDataFrame(rows, "doc_id long, text string"), window, anchor).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == brute_removed(rows, window)
    assert any(r["n_removed"] for r in got)
    for r in got:
        if r["n_removed"]:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]


def test_factors_are_copies_of_earlier_documents(spark):
    """Each factor's words are its source's; together they cover the copied windows; what one source gives in a row is one factor."""
    rng = random.Random(6)
    rows, base = [], [f"w{rng.randrange(400)}" for _ in range(400)]
    for d in range(60):
        w = [f"d{d}x{j}" for j in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            source = words(rows[rng.randrange(d)][1]) if d and rng.random() < 0.5 else base
            at = rng.randrange(max(1, len(source) - 20))
            w += source[at : at + rng.randint(5, 90)] + [f"d{d}y{len(w)}"]
        rows.append((d, " ".join(w)))
    rows += [(100, " ".join(f"long{j}" for j in range(300))), (101, "head " + " ".join(f"long{j}" for j in range(20, 280)))]
    text = {d: words(t) for d, t in rows}
    got = [tuple(r) for r in rlz.factors(spark.createDataFrame(rows, "doc_id long, text string"), 12, 4).collect()]
    first = {}
    for d, w in sorted(text.items()):
        for j in range(len(w) - 11):
            first.setdefault(tuple(w[j : j + 12]), d)
    cover = {d: set() for d in text}
    for d, at, n, source, place in got:
        assert source < d and n >= 12 and text[d][at : at + n] == text[source][place : place + n]
        cover[d].update(range(at, at + n))
    for d, w in text.items():
        assert cover[d] == {x for j in range(len(w) - 11) if first[tuple(w[j : j + 12])] < d for x in range(j, j + 12)}
    assert [x for x in got if x[0] == 101] == [(101, 1, 260, 100, 20)] and len(got) > 40


def test_removal_odd_rows(spark, odd, empty):
    rows = [(i, t) for i, t, _ in ODD]
    got = rlz.remove_copies(odd).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == brute_removed(rows, 50)
    out = rlz.rewrite(odd)
    assert out.dtypes == odd.dtypes and out.count() == len(ODD)
    twice = rlz.rewrite(odd.unionByName(odd.where("doc_id = 7").withColumn("doc_id", F.lit(70).cast("long"))))
    assert 70 not in {r["doc_id"] for r in twice.collect()}
    assert rlz.remove_copies(empty).count() == 0 and rlz.rewrite(empty).columns == empty.columns


# --- 7 SentencePiece


@pytest.fixture(scope="module")
def codec():
    return spviterbi.Codec(queries.tokenizer_path("piece_bpe_32k.model"))


def test_round_trip(spark, texts):
    rows = queries.op7_sentencepiece(spark, DATA).collect()
    assert len(rows) == len(texts) and all(r["exact"] for r in rows)
    assert {r["doc_id"]: r["decoded_sha256"] for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_viterbi_is_the_best_path(codec):
    score = codec.pieces.score

    def best(w):
        if not w:
            return 0.0
        ends = [score[w[:i]][0] + best(w[i:]) for i in range(1, len(w) + 1) if w[:i] in score]
        if w[0] not in score:
            ends.append(codec.pieces.worst * len(w[0].encode()) + best(w[1:]))
        return max(ends)

    some = sorted({"▁the", "▁theme", "▁them", "▁therapy", "▁x𝄞y", "abc", "abd", "▁", "日本語"})
    for w, ids in zip(some, codec.pieces.viterbi(some), strict=True):
        known = {i: s for s, i in score.values()}
        got = sum(known.get(i, codec.pieces.worst) for i in ids)
        assert math.isclose(got, best(w)) and b"".join(codec.pieces.raw[i] for i in ids).decode() == w.replace("▁", " ")
    alone = [next(codec.pieces.viterbi([w])) for w in some]
    assert alone == list(codec.pieces.viterbi(some))  # shared prefixes change nothing


def test_ids_the_model_does_not_have(spark):
    p = queries.tokenizer_path("piece_bpe_32k.model")
    rows = spark.createDataFrame([(1, [10**6, -1, None]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [r["text"] for r in spviterbi.decode(rows, p).collect()] == ["", "", ""]


def test_codec_odd_texts(spark, odd, empty, codec):
    for t in ("", " ", "  a  b ", "▁x ▁", "a\n\nb\t\r\n", "日本 𝄞 ñ\x00", "x" * 1000):
        assert codec.decode(codec.encode([t])[0]) == t
    p = queries.tokenizer_path("piece_bpe_32k.model")
    rows = spviterbi.round_trip(odd, p).collect()
    assert len(rows) == len(ODD) and all(r["exact"] for r in rows) and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    back = spviterbi.decode(spviterbi.encode(odd, p), p).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t, _ in ODD)
    assert spviterbi.encode(empty, p).count() == 0


# --- 8 quality


def test_quality_held_out(spark):
    d = queries.op8_quality(spark, DATA.replace("0.001", "0.01")).join(queries.table(spark, DATA.replace("0.001", "0.01"), "labels"), "doc_id").collect()
    held = [(r["score"], r["quality"]) for r in d if r["held_out"]]
    good, bad = ([s for s, q in held if q == v] for v in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in d)


def brute_statistics(text):
    raw = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    out = [0.0] * quality.N_STATS
    if not raw:
        return out
    out[: len(quality._CLASSES)] = [sum(raw.count(bytes([b])) for b in c) / len(raw) for c in quality._CLASSES]
    k, share = len(quality._CLASSES), [raw.count(bytes([b])) / len(raw) for b in set(raw)]
    out[k : k + 2] = math.log1p(len(raw)), -sum(p * math.log2(p) for p in share)
    if w:
        size, n, pairs = [len(x) for x in w], len(w), list(zip(w, w[1:]))
        mean = sum(size) / n
        out[k + 2 :] = [
            math.log1p(n), min(mean, 50), min(math.sqrt(sum((x - mean) ** 2 for x in size) / n), 50), len(set(w)) / n, max(Counter(w).values()) / n,
            sum(a == b for a, b in pairs) / (n - 1) if n > 1 else 0, 1 - len(set(pairs)) / max(1, n - 1), size.count(1) / n, sum(x > 12 for x in size) / n,
            sum(x.endswith(b".") for x in w) / n, sum(x[:1].isupper() for x in w) / n, math.log1p(raw.count(b"\n")),
        ]
    return out


def test_statistics_against_brute_force(texts):
    some = [*list(texts.values())[:60], None, "", "  \n", "x", "A. B. A. B.", "é" * 40 + "\n\n", "| <a> {b} !!! 123 " * 9]
    got = list(quality.statistics(pa.array(some)))
    for text, x in zip(some, got, strict=True):
        assert np.allclose(x, brute_statistics(text), atol=1e-9), text


def test_normal_equations_and_isotonic(spark):
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([1.0, 1, 1, 1, 1]), np.array([0.0, 1, 0, 1, 1]))
    assert np.all(np.diff(y) >= 0) and y.tolist() == [0, 0.5, 0.5, 1, 1] and x.tolist() == [1, 2, 3, 4, 5]
    stats = quality.describe(queries.table(spark, DATA, "documents"))
    labels = queries.table(spark, DATA, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(stats, labels, n_features=16)
    rows = [r for r in stats.join(labels, "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(4))).collect() if r["fold"]]
    phi = model.features(np.array([r["stats"] for r in rows], float))
    y = np.array([r["label"] for r in rows], float)
    want = np.linalg.solve(phi.T @ phi + quality.RIDGE * len(rows) * np.eye(17) / 16, phi.T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)


def test_quality_odd_rows(spark, odd, empty):
    stats = quality.describe(odd)
    labels = spark.createDataFrame([(1, 1), (1, 1), (7, 0), (None, 1), (8, None)], "doc_id long, label int")
    got = quality.score(stats, quality.fit(stats, labels)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(stats, quality.fit(stats, labels.where("false"))).count() == len(ODD)
    assert quality.score(quality.describe(empty), quality.fit(quality.describe(empty), labels)).count() == 0


# --- 9 decontamination


def brute_matches(rows, items):
    """Every window of an item's length, by exact weighted similarity."""
    def shingles(w):
        return Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))

    sets = {i: shingles(words(lower(t))) for i, t in items if words(t)}
    size = {i: len(words(t)) for i, t in items}
    df = Counter(s for c in sets.values() for s in c)
    weight = lambda s: math.log1p(len(sets) / max(df[s], 1))
    out = {}
    for d, t in rows:
        w = words(lower(t))
        for i, c in sets.items():
            n = min(size[i], len(w))
            for j in range(len(w) - n + 1) if n >= 5 else []:
                x = shingles(w[j : j + n])
                if any(s in c for s in x):
                    keys = set(x) | set(c)
                    s = sum(weight(k) * min(x[k], c[k]) for k in keys) / sum(weight(k) * max(x[k], c[k]) for k in keys)
                    if s >= 0.8 - 1e-12 and s > out.get((d, i), (0, 0))[0] + 1e-12:
                        out[d, i] = (s, j)
    return out


def test_matches_against_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"b{i}w{rng.randrange(40)}" for _ in range(rng.randint(8, 60)))) for i in range(25)]
    rows = []
    for d in range(150):
        w = [f"d{rng.randrange(10**5)}" for _ in range(rng.randint(0, 60))]
        if d % 2:
            p = words(items[rng.randrange(25)][1])
            for _ in range(rng.choice([0, 0, 1, 2])):
                p[rng.choice([0, -1, rng.randrange(len(p))])] = "edited"
            at = rng.randrange(len(w) + 1)
            w = w[:at] + p + w[at:]
        rows.append((d, " ".join(w).upper() if d % 3 else " ".join(w)))
    got = decontam.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_matches(rows, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(want) and len(want) > 20
    assert all(math.isclose(r["similarity"], want[r["doc_id"], r["item_id"]][0]) for r in got)


def test_hamming_index_misses_none_and_excludes():
    """All fingerprints within the radius are met in some block; of unrelated ones few are, and none is left after."""
    rng = np.random.default_rng(0)
    marks = rng.integers(0, 1 << 16, (3000, decontam.BLOCKS)).astype(np.uint16)
    found, want = [], set()
    for i in range(300):
        flips = np.zeros(decontam.BITS, np.uint8)
        flips[rng.choice(decontam.BITS, rng.integers(0, decontam.RADIUS + 1), replace=False)] = 1
        found.append(marks[i] ^ np.packbits(flips).view(np.uint16))
        want.add((i, i))
    blocks = decontam.Blocks(marks)
    met = sum(len(w) for w, _ in blocks.met(np.array(found)))
    assert set(blocks.within(np.array(found))) == want and met < 0.05 * 300 * 3000


def test_similar_windows_are_mostly_within_the_radius():
    """Of pairs with a similarity of 0.8 to 0.85 nine in ten are met by a fingerprint, and all by one of the families."""
    rng = np.random.default_rng(1)
    near = np.zeros((400, decontam.FAMILIES), bool)
    for i in range(400):
        a = rng.integers(0, 2**63, 100).astype(np.uint64)
        b = np.concatenate([a[:89], rng.integers(0, 2**63, 11).astype(np.uint64)])
        for f in range(decontam.FAMILIES):
            x, y = (decontam.prints(decontam.signs(s, f).sum(0)[None])[0] for s in (a, b))
            near[i, f] = int(np.bitwise_count(x ^ y).sum()) <= decontam.RADIUS
    assert near.mean() > 0.88 and near.any(1).all()


def test_windows_that_repeat_a_shingle_are_compared_by_occurrence():
    """Junk that is there ten times does not hide an item, nor does it when the item repeats it; without the Hamming search nothing is found."""
    item = " ".join(f"w{j}" for j in range(60))
    junk = " ".join(["junk"] * 14)
    items = [(1, f"{item} x y z"), (2, f"{junk} {item}")]
    rows = [(0, f"{junk} {item}"), (1, f"a b c {item} {junk} e"), (2, "junk " * 3000), (3, f"{item} junk junk junk junk junk junk junk junk")]
    index = decontam.Index.of(items)
    got = {(d, m[0]) for d, m in decontam.found_in(pa.array([t for _, t in rows]), index)}
    assert got == set(brute_matches(rows, items)) and len(got) >= 3
    within, decontam.Blocks.within = decontam.Blocks.within, lambda self, found: iter(())
    try:
        assert list(decontam.found_in(pa.array([t for _, t in rows]), index)) == []
    finally:
        decontam.Blocks.within = within


def test_no_gram_is_lost_at_a_cut(monkeypatch):
    texts = ["abcdefghij" * 7, "ab1cd22ef " * 9 + "x" * 33, "é" * 25 + "-" * 30 + "zz", "a b c" * 20, "12" * 40, "ab" * 20 + "." + "cd" * 20]
    whole = [langid.gram_counts(t) for t in texts]
    for piece in (5, 7, 16):
        monkeypatch.setattr(langid, "_PIECE", piece)
        for t, (codes, counts) in zip(texts, whole, strict=True):
            got = langid.gram_counts(t)
            assert got[0].tolist() == codes.tolist() and got[1].tolist() == counts.tolist(), (t, piece)


def test_temporary_tables_of_two_threads(spark):
    """Each thread deletes its own, also when it fails; an outer block has what an inner one keeps."""
    from concurrent.futures import ThreadPoolExecutor

    from stratal.llm.scratch import materialize, temporary

    def run(fail):
        try:
            with temporary(spark) as kept:
                one, two = materialize(spark.range(3), "one"), materialize(spark.range(4), "two")
                kept.append(two)
                if fail:
                    raise KeyError("fails")
        except KeyError:
            return one, two
        assert two.count() == 4
        return one, None

    with temporary(spark):
        outer = materialize(spark.range(5), "outer")
        with ThreadPoolExecutor(4) as pool:
            gone = [df for pair in pool.map(run, [False, True, False, True]) for df in pair if df is not None]
        assert outer.count() == 5
    for df in [*gone, outer]:
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|NOT_EXIST"):
            df.count()


def test_items_of_shared_text_are_found_beyond_the_radius():
    """Items that share 300 shingles and have five of their own, windows with four of these changed: similar, but often far in bits."""
    template = [f"t{j}" for j in range(304)]
    items = [(i, " ".join([*template, *(f"own{i}x{j}" for j in range(5))])) for i in range(200)]
    index = decontam.Index.of(items)
    rows = [(i, " ".join([*template, f"own{i}x0", *(f"new{i}x{j}" for j in range(4))])) for i in range(200)]
    got = {(d, m[0]) for d, m in decontam.found_in(pa.array([t for _, t in rows]), index)}
    assert {(i, i) for i in range(200)} <= got
    assert {x for x in got if x[0] < 2} == set(brute_matches(rows[:2], items))


def test_blocks_have_the_weights_of_the_whole_benchmark(spark):
    """A benchmark cut into several indexes finds the same, with the same similarities, as in one."""
    rng = random.Random(3)
    shared = [f"t{j}" for j in range(12)]
    items = [(i, " ".join([*(shared if i % 3 else []), *(f"o{i}w{j}" for j in range(14))])) for i in range(24)] + [(90, " "), (91, "t0 t1")]
    rows = []
    for d in range(120):
        w = words(items[d % 24][1])
        for _ in range(d % 3):
            w[rng.randrange(len(w))] = "edited"
        rows.append((d, " ".join(w)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontam.matches(docs, bench).collect()))
    many = sorted(map(tuple, decontam.matches(docs, bench, limit=500).collect()))
    assert len(list(decontam.item_blocks(bench, 500))) > 3 and len(one) > 20
    assert [r[:4] for r in one] == [r[:4] for r in many] and np.allclose([r[4] for r in one], [r[4] for r in many], rtol=1e-12)
    assert {r["doc_id"] for r in decontam.clean(docs, bench, limit=500).collect()} == {r["doc_id"] for r in decontam.clean(docs, bench).collect()}


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "the dog ran to the house with a ball"), (2, None), (3, ""), (4, "one two"), (None, "word")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"]) for r in decontam.matches(odd, items).collect()), key=repr)
    assert got == sorted([(1, 1), (5, 1), (5, 1), (None, 1), (6, 4)], key=repr)
    left = decontam.clean(odd, items)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == {2, 3, 4, 7, 8, -9, 10}
    assert decontam.matches(empty, items).count() == 0 and decontam.matches(odd, items.where("false")).count() == 0


def test_item_blocks(spark, odd):
    items = spark.createDataFrame([(i, f"the dog ran to the house with item {i}") for i in range(10)], "item_id long, text string")
    assert [len(b) for b in decontam.item_blocks(items, limit=100)] == [3, 3, 3, 1]


def test_decontamination_of_repeated_items_and_long_texts(spark):
    """Each row of a repeated item_id is searched; the best window of a very long text is found, the first among equals."""
    one, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(25))
    filler = " ".join(f"f{i}" for i in range(40_000))
    items = spark.createDataFrame([(7, one), (7, other), (8, one)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{filler} {one} {filler} {one}"), (2, other.upper()), (3, filler)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["word"], r["n_words"], round(r["similarity"], 9)) for r in decontam.matches(docs, items).collect())
    assert got == [(1, 7, 40_000, 30, 1.0), (1, 8, 40_000, 30, 1.0), (2, 7, 0, 25, 1.0)]
    assert [r["doc_id"] for r in decontam.clean(docs, items).collect()] == [3]


def test_near_pairs_on_odd_rows(spark, odd, empty):
    members, pairs = spotsigs.near_pairs(odd, 0.8)
    assert members.count() == len(ODD) and pairs.count() == 0  # copies share a fingerprint
    members, pairs = spotsigs.near_pairs(empty, 0.8)
    assert members.count() == 0 and pairs.count() == 0


# --- 10 language model


def test_scores_against_brute_force(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op10_gru_lm(spark, DATA).collect()}
    c = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update([*words(lower(t)), "\n"])
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        w = [*words(lower(t)), "\n"]
        r = rows[i]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert sum(r["score"] for r in rows.values()) > sum(r["base_score"] for r in rows.values())


def test_joined_counts_are_those_of_the_head(spark):
    """Counts beyond the head come by a join; a head of few words gives the same scores."""
    docs = queries.table(spark, DATA, "documents")
    rows = gru_lm.training(docs)
    a, counts_a = gru_lm.learn(rows, max_tokens=2000)
    b, counts_b = gru_lm.learn(rows, max_tokens=2000, head_words=1100)
    one, two = ({r["doc_id"]: r for r in gru_lm.score(docs, m, c).collect()} for m, c in ((a, counts_a), (b, counts_b)))
    assert all(one[i]["n_known"] == two[i]["n_known"] and math.isclose(one[i]["base_score"], two[i]["base_score"], rel_tol=1e-9) for i in one)
    assert all(math.isclose(one[i]["score"], two[i]["score"], rel_tol=1e-4) for i in one)


def test_gru_is_a_distribution_and_gradients_are_right():
    m = gru_lm.Gru(70, hidden=6)
    rng = np.random.default_rng(1)
    for k in m.p:
        m.p[k] = rng.normal(size=m.p[k].shape) * 0.4
    m.start_from(rng.integers(1, 50, 87))
    h = rng.normal(size=(6, 1))
    every = np.arange(87)
    assert math.isclose(np.exp(m.log_probs(np.repeat(h, 87, 1), every)).sum(), 1.0, abs_tol=1e-4)
    inputs, targets = rng.integers(0, 87, (5, 3)), rng.integers(0, 87, (5, 3))
    fresh = np.zeros((5, 3), bool)
    fresh[0], fresh[2, 1] = True, True
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}

    def loss():
        hs, _ = m.states(inputs, fresh, np.zeros((6, 3)))
        return -m.log_probs(hs.transpose(1, 0, 2).reshape(6, -1), targets.ravel()).mean()

    grad, _, value = m.gradients(inputs, targets, fresh, np.zeros((6, 3)))
    assert math.isclose(value, loss(), rel_tol=1e-4)
    for k in m.p:
        flat, g = m.p[k].reshape(-1), grad[k].reshape(-1)
        for i in rng.choice(len(flat), 3, replace=False):
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert math.isclose((up - down) / 2e-2, g[i], rel_tol=0.05, abs_tol=2e-4), k


def test_state_is_carried_across_windows(monkeypatch):
    m = gru_lm.Gru(40)
    m.start_from(np.arange(57) + 1)
    rng = np.random.default_rng(3)
    docs = [np.append(rng.integers(1, 57, n), 0).astype(np.int32) for n in (0, 3, 200, 7, 65, 1)]
    a = m.score(docs)
    monkeypatch.setattr(gru_lm, "WINDOW", 10_000)
    assert np.allclose(a, m.score(docs), rtol=1e-5)
    assert np.allclose(a, [m.score([d])[0] for d in docs], rtol=1e-5)


def test_every_token_of_a_long_document_is_trained_on(monkeypatch):
    """A document longer than all others together is trained on to its end, in each epoch."""
    rng = np.random.default_rng(4)
    docs = [np.append(rng.integers(1, 57, n), 0).astype(np.int32) for n in (9000, *[20] * 300)]
    seen, gradients = Counter(), gru_lm.Gru.gradients

    def spy(self, inputs, targets, fresh, h, live=None):
        seen.update(targets[np.ones_like(fresh) if live is None else live].tolist())
        return gradients(self, inputs, targets, fresh, h, *(() if live is None else (live,)))

    monkeypatch.setattr(gru_lm.Gru, "gradients", spy)
    gru_lm.Gru(40).train(docs, epochs=2)
    want = Counter(np.concatenate(docs).tolist())
    assert seen == {k: 2 * n for k, n in want.items()}


def test_all_training_tokens_are_learned_from(spark):
    """Words that only few documents have, spread over many shards, all move the weights; any layout gives the same."""
    rows = [(i, f"{'a b c d ' * 10}only{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, _ = gru_lm.learn(df.repartition(3), max_tokens=300)
    two, _ = gru_lm.learn(df.coalesce(1), max_tokens=300)
    assert one.tokens == 60 * 42 and np.allclose(one.gru.p["x"], two.gru.p["x"], rtol=1e-4, atol=1e-6)
    start = gru_lm.Gru(one.gru.n_top)
    moved = np.abs(one.gru.p["x"] - start.p["x"]).max(1) > 1e-6
    top = one.head.symbol[np.isin(one.head.counts, [1])]
    assert len(top) == 60 and moved[top].all() and one.trained == one.tokens


def test_language_model_odd_rows(spark, odd, empty):
    rows = odd.select("doc_id", "text")
    model, counts = gru_lm.learn(rows)
    got = gru_lm.score(odd, model, counts).collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, 4)} == {1}
    model, counts = gru_lm.learn(rows.where("false"))
    got = gru_lm.score(odd, model, counts).collect()
    assert len(got) == len(ODD) and all(r["n_known"] == 0 for r in got)
    assert gru_lm.score(empty, model, counts).count() == 0


# --- bytes that are no UTF-8


def test_bytes_that_are_no_text(spark, tmp_path):
    """Every operator takes them; those that need signs see U+FFFD."""
    bad = "CAST(unhex('C3') AS STRING)"
    docs = spark.sql(f"SELECT id AS doc_id, concat('the cat ', {bad}, ' sat on ', IF(id < 3, 'the mat and the dog', CAST(id AS STRING)), ' ', {bad}, repeat(' word', 60)) AS text, 'en' AS lang, 30L AS n_chars FROM range(6)")
    assert langid.predict(docs, langid.learn(docs)).count() == 6
    assert {r["component_id"] for r in ngram_join.ngram_components(docs).collect()} >= {0} and ngram_join.one_of_each(docs).count() < 6
    p = queries.tokenizer_path("word_bpe_49k.json")
    token_store.write_tokens(docs, f"file://{tmp_path}/t", p, 2)
    assert {r["n_tokens"] > 60 for r in token_store.read_tokens(spark, f"file://{tmp_path}/t").collect()} == {True}
    assert sharding.shard(docs, 3).count() == 6 and spotsigs.fingerprints(docs).count() == 6
    removed = {r["doc_id"]: r["n_removed"] for r in rlz.remove_copies(docs).collect()}
    assert removed[0] == 0 and removed[1] > 60 and rlz.rewrite(docs).count() == 4
    m = queries.tokenizer_path("piece_bpe_32k.model")
    assert {r["exact"] for r in spviterbi.round_trip(docs, m).collect()} == {True}
    assert quality.describe(docs).count() == 6
    assert {r["doc_id"] for r in decontam.matches(docs, spark.sql("SELECT 1L AS item_id, 'word word word word word word word' AS text")).collect()} == set(range(6))
    assert gru_lm.learn_and_score(docs, docs["doc_id"] > 0).count() == 6
