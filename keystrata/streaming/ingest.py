"""Streams of result rows: each micro-batch goes through the store's deduplicating write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keystrata.sources.layout import DatasetId
from keystrata.store import Store


def ingest(stream: DataFrame, store: Store, ds: DatasetId, checkpoint: str, access: str | None = None, **trigger) -> StreamingQuery:
    """Starts the stream. A repeated micro-batch adds nothing, as its keys are stored by then."""

    def write(batch: DataFrame, _: int) -> None:
        store.write(ds, batch, access)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def arrivals(stream: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, by, n): rows per window, rows later than the watermark left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count("*").alias("n"))
