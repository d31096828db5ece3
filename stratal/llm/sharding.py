"""Consistent-hash sharding with virtual nodes and bounded loads, in DataFrame operations only."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

#: The ring has 2 ** CELL_BITS places. What the driver gathers and broadcasts has that many rows at most.
CELL_BITS = 14


def ring(n_shards: int, vnodes: int, cell_bits: int = CELL_BITS) -> list[tuple[int, int]]:
    """Sorted (cell, shard) of the virtual nodes; a cell that two shards hit goes to the smaller one."""
    points: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            digest = hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest()
            points.setdefault(int.from_bytes(digest, "big") >> (64 - cell_bits), shard)
    return sorted(points.items())


def plan(counts: dict[int, int], n_shards: int, vnodes: int, slack: float, cell_bits: int = CELL_BITS) -> list[dict]:
    """Segments (cell, lo, hi, shard, slot): the rows of rank lo <= r < hi of a cell go to ``shard``,
    from ``slot`` on.

    Cells are taken clockwise. A shard takes the rows of its arcs until it is full; rows that
    find their shard full then go on clockwise to the next shards with room. ``slack`` 0 gives
    each shard floor(n / m) rows, and one more to the first n mod m; otherwise a shard holds
    ceil((1 + slack) * n / m) rows at most.
    """
    total = sum(counts.values())
    if slack:
        room = [-int(-(1 + slack) * total // n_shards)] * n_shards
    else:
        room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    points = ring(n_shards, vnodes, cell_bits)
    cells = [c for c, _ in points]
    used, segments, over = [0] * n_shards, [], []

    def take(cell: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard] - used[shard])
        if n > 0:
            segments.append({"cell": cell, "lo": lo, "hi": lo + n, "shard": shard, "slot": used[shard]})
            used[shard] += n
            lo += n
        return lo

    for cell in sorted(counts):
        home = bisect_left(cells, cell) % len(points)
        lo = take(cell, 0, counts[cell], points[home][1])
        if lo < counts[cell]:
            over.append((cell, lo, home))
    for cell, lo, home in over:
        for step in range(1, len(points) + 1):
            lo = take(cell, lo, counts[cell], points[(home + step) % len(points)][1])
            if lo == counts[cell]:
                break
        for shard in range(n_shards):  # shards without a cell of their own
            if lo < counts[cell]:
                lo = take(cell, lo, counts[cell], shard)
    return segments


def shard(docs: DataFrame, n_shards: int = 40, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """Deal ``docs`` (doc_id, text, any others) to shards: doc_id, size, text_crc32, shard, slot.

    A row's place on the ring is the hash of doc_id (null: that of null). Equal rows
    share a place and are told apart only by their slots. Rows with null texts have size 16;
    an empty table gives an empty result. Only (doc_id, size, checksum) is shuffled; the
    driver sees one count for each of 2 ** CELL_BITS cells.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(docs["doc_id"]), 64 - CELL_BITS).cast("int").alias("cell"),
    )
    # equal rows are counted before anything is ordered: many copies of one row stay one row
    rows = rows.groupBy("cell", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    counts = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.sum("copies").alias("n")).collect()}
    payload = json.dumps(plan(counts, n_shards, vnodes, slack))
    kind = "array<struct<cell:int,lo:bigint,hi:bigint,shard:int,slot:bigint>>"
    segments = spark.range(1).select(F.inline(F.from_json(F.lit(payload), kind)))
    order = Window.partitionBy("cell").orderBy("doc_id", "size", "text_crc32")
    upto = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.withColumn("upto", upto).select(
        "cell", "doc_id", "size", "text_crc32", F.explode(F.sequence(F.col("upto") - F.col("copies"), F.col("upto") - 1)).alias("rank")
    )
    ranked, segments = ranked.alias("r"), F.broadcast(segments).alias("g")
    found = ranked.join(segments, F.expr("r.cell = g.cell AND r.rank >= g.lo AND r.rank < g.hi"))
    return found.select("doc_id", "size", "text_crc32", F.col("g.shard").alias("shard"), F.expr("g.slot + r.rank - g.lo").alias("slot"))
