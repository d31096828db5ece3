"""Similarity join on distinct word shingles: a count-vector R-tree over prefix-filtered blocks.

Documents with equal shingle sets form a class, and classes are joined. Shingles have one
global order, rare ones first by a sketch of their counts; two sets of Jaccard 0.8 share one
of their first n - ceil(0.8 n) + 1. Classes that share such a shingle stand in one block; a pair
counts in the block of the first shingle both share, where at most what follows that shingle in
either set can be shared too, so members with little left have no partner there.
A class is a point: its shingles counted in GROUPS hash groups. The sum over the groups of
the smaller count bounds the overlap from above, for two points and for the upper corners of
two boxes alike, so a packed R-tree of a block's points leaves few pairs to verify.
Components need no link inside a component twice: first each class is compared with the partner of
greatest bound among a few that its blocks name, then with the one outside its component, and
last all pairs between components are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from stratal.llm import textkernel as tk
from stratal.llm.components import components
from stratal.llm.scratch import discard, materialize

SHINGLE = 5
NUM, DEN = 80, 100
#: Hash groups of a point, a byte each.
GROUPS = 256
SKETCH_BITS = 18
CHUNK = 1 << 12
#: Blocks of up to so many classes give all their pairs at once.
SMALL = 8
#: Points in a leaf of the tree, at most.
LEAF = 16
#: Members in one side of a tile. A larger block has more tiles, each a task's work of its own.
TILE = 256
#: A block of more rows than that is worked on piece by piece, and a key of about HOT rows or more is dealt to several tasks.
PIECE = 1 << 16
HOT = 1 << 18
#: Hot keys are counted among one of so many classes; the most frequent HOT_KEYS of them are dealt, others stay in one task each.
HOT_SHARE = 32
HOT_KEYS = 1 << 16


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than ``k`` words is one shingle."""
    for lo, hi in tk.slices(column):
        words = tk.split_words(column.slice(lo, hi - lo), lower=True)
        w = words.hashes()
        runs = tk.runs_of(w, k)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(runs[a : b - k + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:
                yield tk.runs_of(w[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def names_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = tk.mix64(s), tk.mix64(s ^ np.uint64(0x5851F42D4C957F2D))
    return int(a.sum().view(np.int64)), int(b.sum().view(np.int64))


def _survey(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        shift = np.uint64(64 - SKETCH_BITS)
        none = None
        for batch in batches:
            n, one, two = [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                a, b = names_of(s)
                one.append(a)
                two.append(b)
                np.add.at(counts, (s >> shift).astype(np.int64), 1)
            rows = len(n)
            none = pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), *none], ["doc_id", "n", "cid", "cid2", "chunk", "counts"])
        if counts.any():
            parts = counts.reshape(-1, CHUNK)
            ids = [i for i in range(len(parts)) if parts[i].any()]
            gone = [pa.nulls(len(ids), pa.int64())] * 4
            yield pa.record_batch([*gone, pa.array(ids, pa.int32()), pa.array([parts[i].astype("<u4").tobytes() for i in ids], pa.binary())], ["doc_id", "n", "cid", "cid2", "chunk", "counts"])

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(raw, "<u4").astype(np.uint64)
    if sums:
        level = [np.floor(np.log2(x + np.uint64(1)) * 4).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array(level, pa.binary())], ["chunk", "level"])


def sketch_levels(surveyed: DataFrame) -> np.ndarray:
    """One byte for each of 2 ** SKETCH_BITS bins: how common its shingles are. That is all the driver gets."""
    rows = surveyed.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk")
    levels = np.zeros((1 << SKETCH_BITS) // CHUNK * CHUNK, np.uint8).reshape(-1, CHUNK)
    for r in rows.mapInArrow(_add_up, "chunk int, level binary").collect():
        levels[r["chunk"]] = np.frombuffer(r["level"], np.uint8)
    return levels.ravel()


def prefix(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set's first n - ceil(n * NUM / DEN) + 1 shingles in the global order (level, hash), in that order."""
    order = (levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
    n = len(s)
    p = n - -(-n * NUM // DEN) + 1
    first = np.argpartition(order, p - 1)[:p] if p < n else np.arange(n)
    # equal orders (one in 2 ** 56) fall back on the whole hash
    return s[first[np.lexsort((s[first], order[first]))]]


def point(s: np.ndarray) -> bytes:
    """Counts in GROUPS groups, a byte each, and after them the sum of what goes beyond 255."""
    c = np.bincount((tk.mix64(s) >> np.uint64(32)).astype(np.int64) % GROUPS, minlength=GROUPS)
    return np.minimum(c, 255).astype(np.uint8).tobytes() + int(np.maximum(c - 255, 0).sum()).to_bytes(4, "little")


def points_of(raw: list[bytes]) -> np.ndarray:
    """Rows of counts; the last column is the excess. The smaller excess bounds what the bytes leave out."""
    x = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, GROUPS + 4)
    excess = np.ascontiguousarray(x[:, GROUPS:]).view("<u4")
    return np.concatenate([x[:, :GROUPS].astype(np.int32), excess.astype(np.int32)], 1)


def most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the sum of the smaller coordinates: what two points, or two boxes' upper corners, share at most."""
    return np.concatenate([np.minimum(a[i : i + 4096], b[i : i + 4096]).sum(1, dtype=np.int64) for i in range(0, len(a), 4096)] or [np.zeros(0, np.int64)])


def _describe(k: int, levels: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = batch.column("doc_id").to_pylist(), []
            for d, s in zip(docs, shingle_sets(batch.column("text"), k), strict=True):
                if len(s) and d is not None:
                    rows.append((d, *names_of(s), len(s), tk.signed(prefix(s, levels)), point(s)))
                if len(rows) >= 512:
                    yield pack(rows)
                    rows = []
            if rows:
                yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        d, one, two, n, keys, vec = zip(*rows, strict=True)
        ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
        return pa.record_batch([pa.array(d, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(n, pa.int64()), lists, pa.array(vec, pa.binary())], ["doc_id", "cid", "cid2", "n", "keys", "vec"])

    return run


def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of sets that can have the wanted Jaccard."""
    return DEN * np.minimum(a, b) >= NUM * np.maximum(a, b)


def enough(overlap: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """DEN * overlap >= NUM * union."""
    return (DEN + NUM) * overlap >= NUM * (a + b)


class RTree:
    """A packed R-tree of points: halved along the coordinate that varies most until a part has LEAF points at most.

    Node ``i`` of a level has the children ``2 i`` and ``2 i + 1``; it knows its upper corner, the
    least and greatest size and what is left at most, and its group if that is one and the same.
    """

    def __init__(self, points: np.ndarray, n: np.ndarray, left: np.ndarray, group: np.ndarray):
        order, edges = np.arange(len(n)), [np.array([0, len(n)])]
        while np.diff(edges[-1]).max(initial=0) > LEAF:
            cut = [0]
            for a, b in zip(edges[-1][:-1].tolist(), edges[-1][1:].tolist(), strict=True):
                own = points[order[a:b]]
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, int(own.var(0).argmax())], half)]
                cut += [a + half, b]
            edges.append(np.array(cut))
        self.order, self.edges = order, edges
        self.points, self.n, self.left, self.group = points[order], n[order], left[order], group[order]
        self.levels = [self._level(e[:-1]) for e in edges]

    def _level(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        lo, hi = (f.reduceat(self.group, at) for f in (np.minimum, np.maximum))
        return (np.maximum.reduceat(self.points, at), np.minimum.reduceat(self.n, at), np.maximum.reduceat(self.n, at), np.maximum.reduceat(self.left, at), np.where(lo == hi, 0, 1), lo)

    def meet(self, other: RTree) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of the points here, in ``other``, bound) of the pairs of different groups that size, what is left and the
        bound let pass; of a tree with itself each pair once."""
        same, i, j, deep = other is self, np.zeros(1, np.int64), np.zeros(1, np.int64), [0, 0]
        ends = len(self.edges) - 1, len(other.edges) - 1
        while True:
            a, b = self.levels[deep[0]], other.levels[deep[1]]
            # a pair in two boxes shares what their upper corners do at most, and needs that of the smallest sizes at least
            ok = (DEN * b[2][j] >= NUM * a[1][i]) & (DEN * a[2][i] >= NUM * b[1][j]) & ((a[4][i] + b[4][j] > 0) | (a[5][i] != b[5][j]))
            ok &= enough(np.minimum(a[3][i], b[3][j]), a[1][i], b[1][j])
            i, j = i[ok], j[ok]
            ok = enough(most(a[0][i], b[0][j]), a[1][i], b[1][j])
            i, j = i[ok], j[ok]
            if deep[0] == ends[0] and deep[1] == ends[1]:
                break
            for side in (0, 1):
                if deep[side] < ends[side]:
                    deep[side] += 1
                    i, j = np.repeat(i, 2), np.repeat(j, 2)
                    child = (i, j)[side]
                    child *= 2
                    child[1::2] += 1
            if same:
                i, j = i[i <= j], j[i <= j]
        a, b = self.edges[-1], other.edges[-1]
        for at in range(0, len(i), 256):
            x, y = i[at : at + 256], j[at : at + 256]
            wide = b[y + 1] - b[y]
            rows = tk.ranges(a[x], a[x + 1] - a[x])
            each = np.repeat(np.arange(len(x)), a[x + 1] - a[x])
            p, q = np.repeat(rows, wide[each]), tk.ranges(b[y][each], wide[each])
            ok = (self.group[p] != other.group[q]) & fits(self.n[p], other.n[q]) & enough(np.minimum(self.left[p], other.left[q]), self.n[p], other.n[q])
            if same:
                ok &= p < q
            p, q = p[ok], q[ok]
            bound = most(self.points[p], other.points[q])
            ok = enough(bound, self.n[p], other.n[q])
            if ok.any():
                yield self.order[p[ok]], other.order[q[ok]], bound[ok]


def _blocks(batches: Iterator[pa.RecordBatch], key: str, columns: list[str], limit: int | None = None) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Columns of sorted input, cut where ``key`` changes, and whether it was cut inside a key instead: that is
    done where one has more than ``limit`` rows. What is held is a batch and the rows of one key at most."""
    held: list[pa.RecordBatch] = []
    size, current = 0, None

    def taken() -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(held)
        return {c: t.column(c).to_numpy() if not pa.types.is_binary(t.schema.field(c).type) else t.column(c) for c in columns}

    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        if held and k[0] != current:
            yield taken(), False
            held, size = [], 0
        last = int(np.searchsorted(k, k[-1]))
        if last:
            held.append(batch.slice(0, last))
            yield taken(), False
            held, size = [], 0
        held.append(batch.slice(last))
        size, current = size + batch.num_rows - last, k[-1]
        if limit and size > limit:
            yield taken(), True
            held, size = [], 0
    if held:
        yield taken(), False


def partnered(start: np.ndarray, size: np.ndarray, n: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which rows, sorted by block and n, have a partner of fitting size in their block for which enough is left."""
    block = np.repeat(np.arange(len(start)), size)
    width = np.int64(n.max(initial=0)) * DEN // NUM + 2
    place = block * width + n
    at = np.arange(len(n))
    largest = np.minimum(left * (DEN + NUM) // NUM - n, n * DEN // NUM)
    lo = np.searchsorted(place, block * width + -(-n * NUM // DEN), "left")
    hi = np.searchsorted(place, block * width + np.maximum(largest, 0), "right")
    return hi - lo - ((lo <= at) & (at < hi)) > 0


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks of up to SMALL classes all pairs; of larger ones each class with its next and with the one that
    has most left among those of fitting size, and the members themselves (b null). Rows of hot keys, and of keys
    of which only a piece is seen, are members."""
    names = ["key", "a", "b", "n", "left"]
    cut_before = False
    for block, cut in _blocks(batches, "key", ["key", "cid", "n", "left", "hot"], PIECE):
        key, cid, n, left, hot = (block[c].astype(np.int64) for c in ("key", "cid", "n", "left", "hot"))
        piece = cut or cut_before  # rows of one key, of which there are more
        cut_before = cut
        while len(key):
            edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (hot[1:] != hot[:-1]), [True]]))
            start, size = edges[:-1], np.diff(edges)
            keep = partnered(start, size, n, left) | (hot >= 0) | piece
            if keep.all():
                break
            key, cid, n, left, hot = (x[keep] for x in (key, cid, n, left, hot))
        if not len(key):
            continue
        number = np.repeat(np.arange(len(start)), size)
        large = (size > SMALL) | (hot[start] >= 0) | piece
        pairs = [(np.zeros(0, np.int64),) * 2]
        for gap in range(1, SMALL):
            m = max(0, len(key) - gap)
            i = np.flatnonzero((number[gap:] == number[:m]) & (~large[number[:m]] | (gap == 1)))
            pairs.append((i, i + gap))
        for b in np.flatnonzero(large):
            rows = np.arange(start[b], start[b] + size[b])
            # sizes fall into steps; each class meets the one with most left of its own step and of the one before
            step = np.floor(np.log(n[rows]) / np.log(DEN / NUM)).astype(np.int64)
            order = np.lexsort((cid[rows], -left[rows] / n[rows], step))
            first = np.flatnonzero(np.concatenate([[True], step[order][1:] != step[order][:-1]]))
            steps, hubs = step[order][first], rows[order][first]
            for back in (0, 1):
                at = np.minimum(np.searchsorted(steps, step - back), len(steps) - 1)
                known = steps[at] == step - back
                pairs.append((hubs[at][known], rows[known]))
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        keep = (cid[a] != cid[b]) & fits(n[a], n[b]) & enough(np.minimum(left[a], left[b]), n[a], n[b])
        two = np.unique(np.stack([np.minimum(cid[a[keep]], cid[b[keep]]), np.maximum(cid[a[keep]], cid[b[keep]])], 1), axis=0)
        none = pa.nulls(len(two), pa.int64())
        yield pa.record_batch([none, pa.array(two[:, 0]), pa.array(two[:, 1]), none, none], names)
        big = np.flatnonzero(large[number])
        yield pa.record_batch([pa.array(key[big]), pa.array(cid[big]), pa.nulls(len(big), pa.int64()), pa.array(n[big]), pa.array(left[big])], names)


def _bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose summed minima suffice, with the similarity these allow."""
    for batch in batches:
        if batch.num_rows:
            a, b = (points_of(batch.column(c).to_pylist()) for c in ("va", "vb"))
            both, na, nb = most(a, b), a.sum(1, dtype=np.int64), b.sum(1, dtype=np.int64)
            keep = pa.array(enough(both, na, nb))
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(both / np.maximum(na + nb - both, 1))], ["a", "b", "alike"]).filter(keep)


def _tile_pairs(best_only: bool) -> Callable:
    """R-tree join of a tile: of its own members, or of those with side 0 with those with side 1. Either all pairs
    that the bound lets pass, or for each member the one of greatest bounded similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in _blocks(batches, "tile", ["tile", "cid", "n", "left", "root", "side", "vec"]):
            tile, cid, n, own_left, root, side = (block[c] for c in ("tile", "cid", "n", "left", "root", "side"))
            edges = np.append(np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])), len(tile))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if (root[lo:hi] == root[lo]).all():
                    continue
                vec = points_of(block["vec"].slice(lo, hi - lo).to_pylist())
                trees, places = [], []
                for s in (0, 1):
                    rows = np.flatnonzero(side[lo:hi] == s)
                    if len(rows):
                        places.append(lo + rows)
                        trees.append(RTree(vec[rows], n[lo + rows], own_left[lo + rows], root[lo + rows]))
                top, partner = np.zeros(hi - lo), np.full(hi - lo, -1)
                for i, j, both in trees[0].meet(trees[-1]):
                    x, y = places[0][i], places[-1][j]
                    alike = both / (n[x] + n[y] - both)
                    if not best_only:
                        yield pa.record_batch([pa.array(np.minimum(cid[x], cid[y])), pa.array(np.maximum(cid[x], cid[y])), pa.array(alike)], ["a", "b", "alike"])
                        continue
                    for u, v in ((x, y), (y, x)):
                        order = np.lexsort((cid[v], -alike, u))
                        first = order[np.concatenate([[True], u[order][1:] != u[order][:-1]])]
                        first = first[alike[first] > top[u[first] - lo]]
                        top[u[first] - lo], partner[u[first] - lo] = alike[first], v[first]
                if best_only:
                    x = lo + np.flatnonzero(partner >= 0)
                    y = partner[x - lo]
                    yield pa.record_batch([pa.array(np.minimum(cid[x], cid[y])), pa.array(np.maximum(cid[x], cid[y])), pa.array(top[x - lo])], ["a", "b", "alike"])

    return run


def _sets(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in tk.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                found = list(shingle_sets(part.column("text"), k))
                one = [names_of(s)[0] for s in found]
                # a doc_id with several texts has several sets; only the one asked for is kept
                keep = [x == y for x, y in zip(one, part.column("cid").to_pylist(), strict=True)]
                cols = [pa.array(one, pa.int64()), pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())]
                yield pa.record_batch(cols, ["cid", "set"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
            s, t = (np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))
            both = np.sort(np.concatenate([s, t]))
            ok.append(bool(enough(np.count_nonzero(both[1:] == both[:-1]), len(s), len(t))))
        yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


class Sets:
    """Shingle sets of the classes asked for so far, a table for each call that asked for more."""

    def __init__(self, rows: DataFrame, classes: DataFrame, k: int):
        self.rows, self.classes, self.k, self.tables = rows, classes, k, []

    def of(self, pairs: DataFrame) -> DataFrame:
        need = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        for t in self.tables:
            need = need.join(t.select("cid"), "cid", "left_anti")
        need = materialize(need.join(self.classes.select("cid", F.col("rep").alias("doc_id")), "cid"), "need", compact=True)
        if need.take(1) or not self.tables:
            texts = self.rows.join(need, "doc_id").select("cid", "text")
            self.tables.append(materialize(texts.mapInArrow(_sets(self.k), "cid long, set binary").dropDuplicates(["cid"]), "sets"))
        discard(need)
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.unionByName(t)
        return out

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        sets = self.of(pairs)
        a = sets.select(F.col("cid").alias("a"), F.col("set").alias("sa"))
        b = sets.select(F.col("cid").alias("b"), F.col("set").alias("sb"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(_verify, "a long, b long")

    def discard(self) -> None:
        for t in self.tables:
            discard(t)


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    a = classes.select(F.col("cid").alias("a"), F.col("vec").alias("va"))
    b = classes.select(F.col("cid").alias("b"), F.col("vec").alias("vb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb").mapInArrow(_bound, "a long, b long, alike double")


def best_partners(pairs: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b, alike) those that are the most alike of one of their ends."""
    ends = pairs.select("a", "b", "alike", F.explode(F.array("a", "b")).alias("x"))
    best = ends.groupBy("x").agg(F.max_by(F.struct("a", "b"), F.struct("alike", "a", "b")).alias("p"))
    return best.select("p.a", "p.b").distinct()


def rooted(df: DataFrame, roots: DataFrame | None, node: str, out: str) -> DataFrame:
    if roots is None:
        return df.withColumn(out, F.col(node))
    r = roots.select(F.col("node").alias(node), F.col("root").alias(out))
    return df.join(r, node, "left").withColumn(out, F.coalesce(out, node))


def tiles(members: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, the table of blocks that they are read with): members (key, cid, n, left, root) of large blocks that have several roots, dealt to tiles with their points.

    The members of a block's most frequent root need no comparison with each other. The others are cut by hash into
    parts of about TILE and so are they; each part of the others meets each part of either kind in a tile, so no task
    holds more than two parts, and a block that is one component but for a few is worked on in proportion to its size.
    """
    counts = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    sizes = counts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("mains"), F.sum("c").alias("all"), F.count("*").alias("roots"))
    blocks = sizes.where("roots > 1").select(
        "key", "main", F.ceil((F.col("all") - F.col("mains")) / TILE).cast("long").alias("mo"), F.ceil(F.col("mains") / TILE).cast("long").alias("mj")
    )
    blocks = materialize(blocks, "blocks", compact=True)
    rows = members.join(blocks, "key")
    hashed = F.xxhash64("cid", "key")
    main = F.col("root") == F.col("main")
    rows = rows.withColumn("own", F.pmod(hashed, F.when(main, F.col("mj")).otherwise(F.col("mo"))))
    # to a main part come all parts of the others; to one of the others all of both kinds
    meets = F.when(main, F.sequence(F.lit(0), F.col("mo") - 1)).otherwise(F.sequence(F.lit(0), F.col("mo") + F.col("mj") - 1))
    rows = rows.withColumn("part", F.explode(meets))
    among = ~main & (F.col("part") < F.col("mo"))
    low = F.when(among, F.least("own", "part")).when(main, F.col("part")).otherwise(F.col("own"))
    high = F.when(among, F.greatest("own", "part")).when(main, F.col("mo") + F.col("own")).otherwise(F.col("part"))
    side: Column = F.when(main | (among & (F.col("own") != low)), 1).otherwise(0)
    dealt = rows.select(F.xxhash64("key", low, high).alias("tile"), "cid", "n", "left", "root", side.cast("int").alias("side"))
    return dealt.join(classes.select("cid", "vec"), "cid"), blocks


def hot_keys(classes: DataFrame) -> DataFrame:
    """(key, parts) of the keys that very many classes have; their rows are dealt to so many tasks. Which keys are
    found changes no result, only the balance."""
    some = classes.where(F.pmod(F.xxhash64("cid", F.lit("hot")), F.lit(HOT_SHARE)) == 0).select(F.explode("keys").alias("hot_key"))
    least = max(2, HOT // HOT_SHARE)
    many = some.groupBy("hot_key").agg(F.count("*").alias("c")).where(F.col("c") >= least).orderBy(F.desc("c"), "hot_key").limit(HOT_KEYS)
    return many.select("hot_key", F.ceil(F.col("c") / least).cast("long").alias("parts"))


class Candidates:
    """Pairs of classes that may link: ``pairs`` (a, b, alike) of small blocks and the first ones of large blocks,
    ``members`` (key, cid, n, left) of large blocks."""

    def __init__(self, rows: DataFrame, classes: DataFrame, pairs: DataFrame, first: DataFrame, k: int):
        self.classes, self.pairs, self.first, self.sets = classes, pairs, first, Sets(rows, classes, k)
        self.members = first.where("b IS NULL").select("key", F.col("a").alias("cid"), "n", "left")

    def discard(self) -> None:
        for t in (self.classes, self.pairs, self.first):
            discard(t)

    def across(self, roots: DataFrame | None, best_only: bool) -> DataFrame:
        """Pairs between different components that sizes, what is left and the bound let pass; of tiles the best ones only if wanted."""
        known = rooted(rooted(self.pairs, roots, "a", "ra"), roots, "b", "rb").where("ra <> rb").select("a", "b", "alike")
        tiled, blocks = tiles(rooted(self.members, roots, "cid", "root"), self.classes)
        found = tiled.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tile_pairs(best_only), "a long, b long, alike double")
        out = materialize(known.unionByName(found).groupBy("a", "b").agg(F.max("alike").alias("alike")), "across")
        discard(blocks)
        return out

    def links(self) -> DataFrame:
        """Every linked pair (a, b) of classes."""
        return materialize(self.sets.verified(self.across(None, False)), "all-links")

    def roots(self) -> DataFrame:
        """(node, root) of the components that links make, for the classes that have any."""
        links = tried = roots = None
        tables = []
        for step in range(3):
            pairs = self.pairs if step == 0 else self.across(roots, best_only=step == 1)
            chosen = best_partners(pairs) if step < 2 else pairs.select("a", "b")
            if tried is not None:
                chosen = chosen.join(tried, ["a", "b"], "left_anti")
            chosen = materialize(chosen, "chosen", compact=True)
            if step:
                discard(pairs)
            more = materialize(self.sets.verified(chosen), "links")
            links = more if links is None else links.unionByName(more)
            if roots is None or more.take(1):
                roots, old = components(links, "round"), roots
                discard(old)
            tried = chosen if tried is None else tried.unionByName(chosen)
            tables += [chosen, more]
        for t in tables:
            discard(t)
        self.sets.discard()
        return roots


def join_classes(docs: DataFrame, k: int = SHINGLE) -> tuple[DataFrame, Candidates]:
    """(surveyed documents: doc_id, n, cid, cid2; the candidates among their classes)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    surveyed = materialize(rows.mapInArrow(_survey(k), "doc_id long, n long, cid long, cid2 long, chunk int, counts binary"), "survey")
    levels = sketch_levels(surveyed)
    described = rows.mapInArrow(_describe(k, levels), "doc_id long, cid long, cid2 long, n long, keys array<long>, vec binary")
    keyed = described.groupBy("cid", "cid2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("vec").alias("vec"))
    keyed = materialize(keyed, "classes")
    entries = keyed.select("cid", "n", F.posexplode("keys").alias("pos", "key")).join(F.broadcast(hot_keys(keyed)), F.col("key") == F.col("hot_key"), "left")
    hot = F.coalesce(F.pmod(F.xxhash64("cid"), F.col("parts")), F.lit(-1)).cast("int").alias("hot")
    entries = entries.select("key", "cid", F.col("n").cast("int").alias("n"), (F.col("n") - F.col("pos")).cast("int").alias("left"), hot)
    dealt = entries.repartition("key", "hot").sortWithinPartitions("key", "hot", "n", "cid")
    first = materialize(dealt.mapInArrow(_first_pairs, "key long, a long, b long, n long, left long"), "first")
    classes = materialize(keyed.drop("keys"), "points")
    discard(keyed)
    pairs = materialize(bounded(first.where("b IS NOT NULL").select("a", "b").distinct(), classes), "pairs")
    return surveyed.where("chunk IS NULL"), Candidates(rows, classes, pairs, first, k)


def class_links(docs: DataFrame, k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, class_id; links: one, two) of the join itself: every linked pair of different sets, by the least
    doc_id of each, which is its class_id. Documents with words only; those of one class are linked with each other."""
    surveyed, found = join_classes(docs, k)
    classes = found.classes.select("cid", "cid2", F.col("rep").alias("class_id"))
    members = surveyed.where("n > 0 AND doc_id IS NOT NULL").join(classes, ["cid", "cid2"]).select("doc_id", "class_id")
    one, two = (classes.select(F.col("cid").alias(c), F.col("class_id").alias(d)) for c, d in (("a", "one"), ("b", "two")))
    links = found.links().join(one, "a").join(two, "b")
    return members, links.select(F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two"))


def _named(k: int, kept: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [names_of(s) for s in shingle_sets(batch.column("text"), k)]
            cols = [batch.column(c) for c in kept] + [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)]
            yield pa.record_batch(cols, [*kept, "cid", "cid2"])

    return run


def labelled(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, cid, cid2, component, root) of each row; component is null for rows without words or doc_id."""
    surveyed, found = join_classes(docs, k)
    roots = found.roots()
    reps = rooted(found.classes.select("cid", "cid2", "rep"), roots, "cid", "root")
    least = reps.groupBy("root").agg(F.min("rep").alias("component"))
    named = materialize(reps.join(least, "root").select("cid", "cid2", "component", "root"), "named")
    discard(roots)
    found.discard()
    joined = surveyed.join(named, ["cid", "cid2"], "left")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component"))
    return joined.select("doc_id", "n", "cid", "cid2", own.alias("component"), "root")


def ngram_components(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the least doc_id that links reach).

    Words are runs of bytes other than white space, A-Z lower-cased. Null and wordless texts have
    no shingle and no link, nor have rows without a doc_id (their component_id is null); equal
    rows are each returned. Two sets link when 100 * overlap >= 80 * union.
    """
    return labelled(docs, k).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``docs`` with the document of least doc_id of each component. Rows that share a doc_id are told apart by their
    sets: of those in one component the first by the hash of the text stays. Rows without words or without a doc_id stay."""
    found = materialize(labelled(docs, k), "components")
    many = materialize(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("many_id")), "repeated")
    gone = found.where("component <> doc_id").join(many, F.col("doc_id") == F.col("many_id"), "left_anti").select(F.col("doc_id").alias("gone_id"))
    kept = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    if not many.take(1):
        return kept
    alone = kept.join(many, kept["doc_id"] == many["many_id"], "left_anti")
    shared = docs.join(many, docs["doc_id"] == many["many_id"], "left_semi")
    whole = F.struct(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("whole")
    shared = shared.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), whole)
    schema = f"doc_id long, text string, whole {shared.schema['whole'].dataType.simpleString()}, cid long, cid2 long"
    named = shared.mapInArrow(_named(k, ["doc_id", "text", "whole"]), schema)
    facts = found.join(many, F.col("doc_id") == F.col("many_id")).select("doc_id", "cid", "cid2", "component", "root").distinct()
    rank = F.row_number().over(Window.partitionBy("doc_id", "root").orderBy(F.xxhash64("text"), "text"))
    judged = named.join(facts, ["doc_id", "cid", "cid2"]).withColumn("rank", rank)
    first = judged.where("component IS NULL OR (component = doc_id AND rank = 1)").select(*(F.col(f"whole.c{i}").alias(c) for i, c in enumerate(docs.columns)))
    return alone.unionByName(first)
