"""Exact top-k inner products: KD-trees per shard, searched best box first.

Equal vectors are one point with its smallest ids. Points are dealt to shards by median cuts of a sample; a shard is one
tree or several. A query first searches the shard whose box may hold the highest score; its kth score there goes with it
to the other shards whose boxes reach it, and leaves out boxes inside these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from stratal.llm.scratch import discard, materialize
from stratal.llm.vectors import Form, finite, form, packed

#: Points of a leaf and of a tree, and queries that are searched together.
LEAF, TREE, BLOCK = 256, 8_192, 4_096
#: Shards at most (larger ones hold several trees), and points of the sample that cuts them, as expected.
SHARDS, SAMPLE = 4_096, 65_536
NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def median_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """The rows in the order of a KD-tree's leaves: halved at the median of the widest component until a part has ``leaf`` rows at most."""
    order = np.arange(len(x))
    todo = [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a > leaf:
            rows = order[a:b]
            part = x[rows]
            widest = int(np.argmax(part.max(0).astype(np.int64) - part.min(0)))
            half = (b - a) // 2
            order[a:b] = rows[np.argpartition(part[:, widest], half)]
            todo += [(a, a + half), (a + half, b)]
    return order


@dataclass
class Tree:
    """A KD-tree over points in ``median_order``: the nodes follow from their number. ``low``/``high``: each node's tight box."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF) -> Tree:
        start, end, left = [0], [len(points)], []
        at = 0
        while at < len(start):
            a, b = start[at], end[at]
            if b - a > leaf:
                left.append(len(start))
                start += [a, a + (b - a) // 2]
                end += [a + (b - a) // 2, b]
            else:
                left.append(-1)
            at += 1
        low, high = (np.empty((len(start), points.shape[1]), np.int64) for _ in "ab")
        for i in reversed(range(len(start))):
            if left[i] < 0:
                part = points[start[i] : end[i]]
                low[i], high[i] = part.min(0), part.max(0)
            else:
                c = left[i]
                low[i], high[i] = np.minimum(low[c], low[c + 1]), np.maximum(high[c], high[c + 1])
        return cls(points, np.array(start), np.array(end), np.array(left), low, high)


def reach(queries: np.ndarray, low: np.ndarray, high: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The highest inner product that each query can have with a point of each box."""
    q = queries.astype(kind)
    zero = kind.type(0)
    return np.maximum(q, zero) @ high.astype(kind).T + np.minimum(q, zero) @ low.astype(kind).T


def kind_of(f: Form) -> np.dtype:
    """The fastest type in which no inner product of ``f``'s vectors, and no part of its sum, is rounded."""
    most = f.dim * f.most * f.most
    if most >= 1 << 63:
        raise OverflowError("inner products are beyond 64 bits")
    return np.dtype(np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64)


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, least: np.ndarray, depth: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's ``depth`` best, equal scores by the smaller id; scores below ``least`` are left out.

    ``ids``: those of each point, rising, LAST where there are fewer. All queries go through the tree side by side: in a
    round each takes its open node of the highest bound, opens an inner one or compares itself with a leaf's points, and
    ends when that bound is below its ``depth``-th score.
    """
    points, q = tree.points.astype(kind), queries.astype(kind)
    bound = reach(queries, tree.low, tree.high, np.dtype(np.int64) if kind == np.int64 else np.dtype(np.float64)).astype(np.int64)
    open_ = np.full(bound.shape, NONE)
    open_[:, 0] = bound[:, 0]
    kth = least.astype(np.int64).copy()
    best_score, best_id = np.full((len(q), depth), NONE), np.full((len(q), depth), LAST)
    live = np.arange(len(q))
    while len(live):
        node = np.argmax(open_[live], 1)
        top = open_[live, node]
        keep = (top > NONE) & (top >= kth[live])
        live, node = live[keep], node[keep]
        open_[live, node] = NONE
        inner = tree.left[node] >= 0
        if inner.any():
            rows, child = live[inner], tree.left[node[inner]]
            for c in (child, child + 1):
                open_[rows, c] = bound[rows, c]
        rows, leaf = live[~inner], node[~inner]
        if not len(rows):
            continue
        by_leaf = np.argsort(leaf, kind="stable")
        rows, leaf = rows[by_leaf], leaf[by_leaf]
        cuts = np.flatnonzero(np.diff(leaf)) + 1
        found = []
        for a, b in zip([0, *cuts], [*cuts, len(leaf)], strict=True):
            who, start, end = rows[a:b], tree.start[leaf[a]], tree.end[leaf[a]]
            scores = q[who] @ points[start:end].T
            limit = kth[who]
            if end - start > depth:  # as many points have at least this score
                limit = np.maximum(limit, np.partition(scores, end - start - depth, 1)[:, end - start - depth].astype(np.int64))
            r, p = np.nonzero(scores >= limit[:, None])
            found.append((who[r], p + start, scores[r, p].astype(np.int64)))
        who, point, score = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(who):
            continue
        own = ids[point]
        r, c = np.nonzero(own != LAST)
        who, score, own = who[r], score[r], own[r, c]
        touched, place = np.unique(who, return_inverse=True)
        who = np.concatenate([place, np.repeat(np.arange(len(touched)), depth)])
        score = np.concatenate([score, best_score[touched].ravel()])
        own = np.concatenate([own, best_id[touched].ravel()])
        order = np.lexsort((own, -np.maximum(score, -LAST), who))
        first = np.searchsorted(who[order], np.arange(len(touched)))
        take = order[first[:, None] + np.arange(depth)]
        best_score[touched], best_id[touched] = score[take], own[take]
        kth[touched] = np.maximum(kth[touched], best_score[touched, -1])
    r, c = np.nonzero(best_score > NONE)
    return r, best_id[r, c], best_score[r, c]


@dataclass
class Cuts:
    """The upper part of a KD-tree, whose leaves are shards: component and value of each inner node, which has its children
    at 2i + 1 and 2i + 2."""

    levels: int
    component: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, sample: np.ndarray, shards: int) -> Cuts:
        levels = max(0, int(shards - 1).bit_length())
        component, value = np.zeros((1 << levels) - 1, np.int64), np.zeros((1 << levels) - 1, np.int64)
        parts = {0: sample}
        for i in range(len(component)):
            part = parts.pop(i)
            if len(part):
                component[i] = np.argmax(part.max(0).astype(np.int64) - part.min(0))
                value[i] = np.sort(part[:, component[i]])[len(part) // 2]
            right = part[:, component[i]] >= value[i]
            parts[2 * i + 1], parts[2 * i + 2] = part[~right], part[right]
        return cls(levels, component, value)

    def shard(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.levels):
            at = 2 * at + 1 + (x[np.arange(len(x)), self.component[at]] >= self.value[at])
        return at - len(self.component)


def _deal(f: Form, cuts: Cuts) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                shard = cuts.shard(f.unpack(batch.column("x"))).astype(np.int32)
                yield pa.record_batch([pa.array(shard), batch.column("x"), batch.column("ids")], ["shard", "x", "ids"])

    return run


TREES = "shard int, n int, points binary, ids binary, low binary, high binary"


def _grow(f: Form, depth: int) -> Callable:
    """Trees of TREE points at most from rows in order of their shards."""

    def tree(shard: int, rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        x = np.concatenate([f.unpack(r.column("x")) for r in rows])
        ids = np.full((len(x), depth), LAST)
        lists = pa.concat_arrays([r.column("ids") for r in rows])
        ids[np.arange(depth) < np.diff(np.asarray(lists.offsets))[:, None]] = np.asarray(lists.flatten())
        order = median_order(x, LEAF)
        x = x[order]
        box = [x.min(0).astype("<i8").tobytes(), x.max(0).astype("<i8").tobytes()]
        values = [shard, len(x), x.tobytes(), ids[order].tobytes(), *box]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["shard", "n", "points", "ids", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, now = [], 0, None
        for batch in batches:
            shards = np.asarray(batch.column("shard"))
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shards)], strict=True) if len(shards) else ():
                if held and shards[a] != now:
                    yield tree(now, held)
                    held, n = [], 0
                now = int(shards[a])
                while a < b:
                    m = min(b - a, TREE - n)
                    held.append(batch.slice(a, m))
                    a, n = a + m, n + m
                    if n == TREE:
                        yield tree(now, held)
                        held, n = [], 0
        if held:
            yield tree(now, held)

    return run


def _box(table: pa.Table) -> pa.Table:
    low, high = (np.stack([np.frombuffer(v.as_py(), "<i8") for v in table.column(c)]) for c in ("low", "high"))
    values = [table.column("shard")[0].as_py(), low.min(0).tobytes(), high.max(0).tobytes()]
    return pa.table([pa.array([v], k) for v, k in zip(values, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "low", "high"])


def _route(f: Form, shards: np.ndarray, low: np.ndarray, high: np.ndarray, first: bool) -> Callable:
    """Blocks of queries for the shards they must search: the one of the highest bound first, then all others whose bound
    reaches the query's ``least`` score."""
    kind = np.dtype(np.int64) if kind_of(f) == np.int64 else np.dtype(np.float64)

    def block(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([f.unpack(r.column("x")) for r in rows])
        q, least = (np.concatenate([np.asarray(r.column(c)) for r in rows]) for c in ("q", "least"))
        bound = reach(x, low, high, kind)
        home = np.argmax(bound, 1)
        for i, shard in enumerate(shards):
            who = np.flatnonzero(home == i if first else (home != i) & (bound[:, i] >= least))
            if len(who):
                values = [int(shard), q[who].tobytes(), x[who].tobytes(), least[who].tobytes()]
                yield pa.record_batch([pa.array([v], k) for v, k in zip(values, (pa.int32(), *[pa.binary()] * 3), strict=True)], ["shard", "q", "x", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                m = min(batch.num_rows - at, BLOCK - n)
                held.append(batch.slice(at, m))
                at, n = at + m, n + m
                if n == BLOCK:
                    yield from block(held)
                    held, n = [], 0
        if held:
            yield from block(held)

    return run


def _search(f: Form, depth: int) -> Callable:
    kind = kind_of(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree.of(np.frombuffer(row["points"], f.dtype).reshape(-1, f.dim))
                ids = np.frombuffer(row["ids"], np.int64).reshape(-1, depth)
                q, least = np.frombuffer(row["q"], np.int64), np.frombuffer(row["least"], np.int64)
                who, own, score = search(tree, ids, np.frombuffer(row["x"], f.dtype).reshape(-1, f.dim), least, depth, kind)
                yield pa.record_batch([pa.array(q[who]), pa.array(own), pa.array(score)], ["q", "vec_id", "score"])

    return run


def _best(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The ``k`` first rows of each ``by``, by falling score and rising vec_id; partly taken before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``every`` the ``k`` other rows of the highest inner product
    of floor(256 * embedding), equal scores by the smaller vec_id.

    Rows without a vec_id, and vectors that are null or hold null or non-finite entries, take no part. Shorter vectors are
    filled up with zeros. A row that is there several times counts once; rows of one vec_id with different vectors are
    different candidates, and as queries share one list. Other columns are not read. An empty table gives no row.
    """
    spark = vectors.sparkSession
    rows = finite(vectors).where("vec_id IS NOT NULL")
    f = form(rows)
    once = packed(rows, f).distinct()
    once = materialize(once, "vectors", compact=True)
    asked = once.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "x")
    shared = asked.groupBy("query_id").count().agg(F.max("count")).first()[0]  # vectors of one query's id, which it must not find
    if not shared or not f.dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    depth = k + shared
    rank = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    points = once.withColumn("_r", rank).where(F.col("_r") <= depth).groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = materialize(points, "points", compact=True)
    n = points.count()
    one_in = max(1, n // SAMPLE)
    sample = points.where(F.pmod(F.xxhash64("x"), F.lit(one_in)) == 0).select("x").toArrow().column("x").combine_chunks()
    cuts = Cuts.of(f.unpack(sample), min(SHARDS, -(-n // TREE)))
    dealt = points.mapInArrow(_deal(f, cuts), "shard int, x binary, ids array<long>")
    trees = materialize(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_grow(f, depth), TREES), "trees")
    boxes = trees.select("shard", "low", "high").groupBy("shard").applyInArrow(_box, "shard int, low binary, high binary").collect()  # SHARDS rows at most
    low, high = (np.stack([np.frombuffer(b[c], "<i8") for b in boxes]) for c in ("low", "high"))
    shards = np.array([b["shard"] for b in boxes])
    questions = asked.select("x").distinct().select(F.monotonically_increasing_id().alias("q"), "x")
    questions = materialize(questions, "questions", compact=True)

    def found(least: DataFrame, first: bool) -> DataFrame:
        blocks = least.mapInArrow(_route(f, shards, low, high, first), "shard int, q binary, x binary, least binary")
        blocks = materialize(blocks, "blocks")
        pairs = blocks.join(trees.select("shard", "points", "ids"), "shard")
        answers = materialize(pairs.mapInArrow(_search(f, depth), "q long, vec_id long, score long"), "answers", compact=True)
        discard(blocks)
        return answers

    near = found(questions.withColumn("least", F.lit(int(NONE))), True)
    kth = _best(near, "q", depth).groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    least = F.when(F.col("n") >= depth, F.col("kth")).otherwise(F.lit(int(NONE))).alias("least")
    far = found(questions.join(kth, "q", "left").select("q", "x", least), False)
    best = _best(near.unionByName(far), "q", depth).drop("rank")
    answered = asked.join(questions, "x").select("query_id", "q").join(best, "q").where("query_id <> vec_id")
    out = materialize(_best(answered, "query_id", k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest", compact=True)
    for df in (once, points, trees, questions, near, far):
        discard(df)
    return out
