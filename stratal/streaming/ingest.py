"""A stream of files or rows, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from stratal.operators.dedup import latest
from stratal.sources.snapshots import SnapshotTable


def stream_upsert(stream: DataFrame, table: SnapshotTable, keys: list[str], newest: str, checkpoint: str, available_now: bool = True, buckets: int = 16) -> StreamingQuery:
    """Each key's row of the greatest ``newest`` is in ``table``, in whatever order and batches rows come: a row replaces another only if it is
    newer, or as new and greater in all its columns. Of the table only the buckets that a batch meets are
    written again. Doing a batch again changes nothing.

    A row that says its key is deleted stays as a tombstone, so that an older row which comes after it does not
    bring the key back; ``living`` leaves tombstones out.
    """

    def one(batch: DataFrame, _: int) -> None:
        order = [F.col(newest).desc_nulls_last(), *(F.col(c).desc_nulls_last() for c in batch.columns if c != newest)]
        table.merge(latest(batch, keys, order), keys, buckets, newest)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def living(table: SnapshotTable, deleted: str) -> DataFrame:
    """The rows whose ``deleted`` is not true."""
    return table.read().where(~F.coalesce(F.col(deleted), F.lit(False)))


def windowed_counts(events: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """Events by window and key; rows later than ``late`` behind the newest are left out of a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")
