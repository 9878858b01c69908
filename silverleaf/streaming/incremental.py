"""Incremental work: queues of what lacks a derivation, and a file stream that feeds them.

A queue is an anti-join on key and version (operators.browse); these functions run one
round of it. The stream is an extension: Spark's file source remembers which files it
has seen, and each micro-batch is one staged write.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Library
from ..operators.dml import upsert
from ..schema import KEYS
from ..sources import sidecar
from ..sources.scan import SIDECAR_SUFFIX


def derive(library: Library, table: str, queue: DataFrame, work: Callable[[DataFrame], DataFrame]) -> bool:
    """Run `work` on the queued ids and write its rows over the table's; False if none were queued."""
    if queue.isEmpty():
        return False
    library.write(table, upsert(library.read(table), work(queue), KEYS[table]))
    return True


def sidecar_stream(library: Library, root: str, checkpoint: str, sink: Callable[[DataFrame, int], None], files_per_batch: int = 10_000) -> StreamingQuery:
    """Parse sidecars that have appeared below root since the last call, in bounded batches."""
    stream = (
        library.spark.readStream.format("binaryFile")
        .schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{SIDECAR_SUFFIX}")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )
    parsed = sidecar.parse(stream.select("path", F.decode("content", "UTF-8").alias("json")))
    return parsed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts per key and tumbling window; on a stream, state is dropped when `late` has passed."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
