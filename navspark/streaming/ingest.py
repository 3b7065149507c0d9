"""Incremental ingestion with Structured Streaming: landed payload files are merged batch by batch.

An addition to the batch operators: a restated day arrives as a later file and wins in the merge, also inside one
micro-batch (by the file's time, then its name), so late data needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources import history
from ..store import Store


def ingest(store: Store, landing: str, checkpoint: str, source: str = "amfi", max_files: int = 100) -> StreamingQuery:
    """Merge all JSON-line payload files (scheme_code, payload) not yet seen, then stop; resumes from the checkpoint."""
    files = history.with_files(store.spark.readStream.schema(history.LINES).option("maxFilesPerTrigger", max_files).json(landing))

    def merge(batch: DataFrame, epoch: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")  # kept with the checkpoint
        with store.run("stream", f"stream-{query}-{epoch}") as end:
            result = store.upsert_nav(history.parse(batch), source, *history.ORDER)
            end |= {"rows_written": result.inserted, "rows_updated": result.updated}

    return (
        files.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
