"""Continuous upserts with Structured Streaming.

The stream appends document versions to a Parquet log; the sink's own commit log makes
each source row arrive once, across restarts, and no state grows with the number of
keys. Readers take the latest version per key. ``keyed_state`` is the stateful form,
for sinks that accept updates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from folioscan.operators.index_store import IndexFolder
from folioscan.operators.upsert import latest


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    glob: str | None = None,
    files_per_batch: int | None = None,
    bytes_per_batch: int | None = None,
) -> DataFrame:
    """Rows of the Parquet files at a path; a number of files or bytes bounds each round.

    The path is a folder or a pattern: a stream does not take the path of a single file.
    """
    options = {"pathGlobFilter": glob, "maxFilesPerTrigger": files_per_batch, "maxBytesPerTrigger": bytes_per_batch}
    reader = spark.readStream.schema(schema).options(**{k: v for k, v in options.items() if v is not None})
    return reader.parquet(path)


def start_upserts(
    stream: DataFrame,
    sink: str,
    checkpoint: str,
    shape: Callable[[DataFrame], DataFrame] | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Append shaped documents to the log at ``sink``.

    Without an interval, all available input is taken in bounded rounds and the query
    ends; the next start on the same checkpoint goes on after the last row.
    """
    documents = stream.transform(shape) if shape else stream
    writer = documents.writeStream.format("parquet").outputMode("append")
    writer = writer.option("path", sink).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def run_upserts(stream: DataFrame, sink: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> list:
    """Take all available input, wait for the end, and return the progress of each round."""
    query = start_upserts(stream, sink, checkpoint, shape)
    query.awaitTermination()
    return list(query.recentProgress)


def current_documents(spark: SparkSession, sink: str, key: str, seq: str | list[str]) -> DataFrame:
    """A batch view of the log: the latest version of each document.

    Every read is one consistent snapshot, so a search that is run again and again is
    this read under the search's own filter and order.
    """
    return latest(spark.read.parquet(sink), key, seq)


def keyed_state(stream: DataFrame, key: str, seq: str | list[str]) -> DataFrame:
    """The latest row per key as streaming state, for update or complete output.

    The state holds one row per key and is never expired.
    """
    return latest(stream, key, seq)


def start_search(
    stream: DataFrame, search: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, interval: str | None = "100 milliseconds"
) -> StreamingQuery:
    """Run a row-wise search continuously over arriving documents; matches are appended to ``sink``."""
    return start_upserts(stream, sink, checkpoint, search, interval)


def index_stream(
    stream: DataFrame, index: IndexFolder, doc_id: str, seq: str | list[str], checkpoint: str, first_version: int = 1, interval: str | None = None
) -> StreamingQuery:
    """Write every round of a stream into an index folder, as a version of its own.

    A round that Spark repeats after a failure carries the same number: it replaces its own unfinished version
    and leaves a finished one alone. Index and checkpoint belong together, as the checkpoint numbers the rounds.
    """

    def write(batch: DataFrame, number: int) -> None:
        index.write(batch, doc_id, first_version + number, seq, batch_id=f"{checkpoint}#{number}")

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def batch_rates(progress: list) -> list[tuple[int, int, float]]:
    """(batch, rows, rows per second) of each finished round."""
    return [(p["batchId"], p["numInputRows"], p["processedRowsPerSecond"]) for p in progress]
