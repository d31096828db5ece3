"""Connected components of a table of links, without bringing links to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stratal.llm.scratch import discard, materialize


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """``links`` (a, b: long) to (node, root): root is the least node that links reach.

    Each round hangs every node under its least neighbour, follows the pointers to their
    ends and contracts the links, so rounds grow with the logarithm of the nodes. Null ends
    and loops are left out; a node without links has no row.
    """
    live = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    live = materialize(live, name, compact=True)
    labels = None
    while labels is None or live.take(1):
        before = live
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        up = materialize(up, f"{name}-up", compact=True)
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            joined = up.join(above, "up").select("node", "up", "top")
            if not joined.where("up <> top").take(1):
                break
            up, old = materialize(joined.select("node", F.col("top").alias("up")), f"{name}-up", compact=True), up
            discard(old)
        if labels is None:
            labels = materialize(up.select("node", F.col("up").alias("root")), f"{name}-labels", compact=True)
        else:
            step = up.select(F.col("node").alias("root"), F.col("up").alias("top"))
            joined = labels.join(step, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            labels, old = materialize(joined, f"{name}-labels", compact=True), labels
            discard(old)
        a, b = (up.select(F.col("node").alias(c), F.col("up").alias(f"{c}2")) for c in "ab")
        live = live.join(a, "a").join(b, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        live, old = materialize(live.distinct(), name, compact=True), before
        discard(old)
        discard(up)
    discard(live)
    return labels
