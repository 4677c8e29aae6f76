"""Stream sources and sinks shared by the streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ambergrid.sources.tables import EVENT_SCHEMA, events_as_transactions

#: Bound on one micro-batch. It also bounds what one key can bring to one task.
MAX_BYTES_PER_TRIGGER = str(1 << 30)


def event_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Transactions from event files as they arrive; ``ts`` is an instant, as watermarks need.

    ``path`` is a folder, or a glob that matches the files of one.
    """
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if not {"maxFilesPerTrigger", "maxBytesPerTrigger"} & options.keys():
        options["maxBytesPerTrigger"] = MAX_BYTES_PER_TRIGGER
    events = reader.options(**options).parquet(path)
    return events_as_transactions(events).withColumn("ts", F.col("ts").cast("timestamp"))


def write_stream(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Append to Parquet files. Without ``every`` the query stops after what is there now."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return _start(writer, every)


def for_each_batch(
    stream: DataFrame,
    function: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(function).option("checkpointLocation", checkpoint)
    return _start(writer, every)


def _start(writer, every: str | None) -> StreamingQuery:
    writer = writer.outputMode("append")
    if every is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()
