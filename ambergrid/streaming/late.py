"""Hourly counts that late rows amend: nothing behind the watermark is dropped.

Every micro-batch writes its own partial counts per (hour, category), so its folder is all
that a replay overwrites, and counts of one hour from any number of micro-batches add up. A
row is late if its hour was closed when it came: the hour's end lay at or before the newest
time of earlier micro-batches less the lateness. Late rows are also kept as they are, in a
side table, and an hour that was read as closed is amended by them.

Rows without a time belong to no hour and are kept in the side table only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ambergrid.functions.scalar import micros
from ambergrid.session import materialise
from ambergrid.streaming.common import for_each_batch

LATENESS_SECONDS = 600
HOUR_US = 3_600_000_000
PARTS = "window_start timestamp, category string, n long, n_late long, amount double"
MARKS = "newest_us long"


def count_batches(
    tx: DataFrame, path: str, checkpoint: str, lateness: int = LATENESS_SECONDS, every: str | None = None
) -> StreamingQuery:
    """Count a stream per hour and category under ``path``; see ``hour_counts`` and ``late_rows``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = None
        if batch_id:
            before = spark.read.schema(MARKS).parquet(f"{path}/marks/batch_id={batch_id - 1}").first()["newest_us"]
        at = micros(F.col("ts"))
        end = (F.floor(at / HOUR_US) + 1) * HOUR_US
        late = F.lit(False) if before is None else F.coalesce(end <= before - lateness * 1_000_000, F.lit(False))
        rows = materialise(batch.withColumn("_late", late), "late-batch")
        timed = rows.filter(F.col("ts").isNotNull())
        counts = timed.groupBy(F.window("ts", "1 hour")["start"].alias("window_start"), "category").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("_late").alias("n_late"),
            F.sum("amount").cast("double").alias("amount"),
        )
        counts.write.mode("overwrite").parquet(f"{path}/parts/batch_id={batch_id}")
        kept = rows.filter(F.col("_late") | F.col("ts").isNull()).drop("_late")
        kept.write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        newest = rows.agg(F.greatest(F.max(micros(F.col("ts"))), F.lit(before).cast("long")).alias("newest_us"))
        newest.write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch_id}")

    return for_each_batch(tx, write, checkpoint, every)


def hour_counts(spark: SparkSession, path: str, closed: bool = True, lateness: int = LATENESS_SECONDS) -> DataFrame:
    """(window_start, category, n, n_late, amount) with all amendments so far.

    With ``closed`` only hours that ended at or before the newest time less the lateness.
    """
    parts = spark.read.schema(PARTS).option("basePath", f"{path}/parts").parquet(f"{path}/parts")
    counts = parts.groupBy("window_start", "category").agg(
        F.sum("n").alias("n"), F.sum("n_late").alias("n_late"), F.sum("amount").alias("amount")
    )
    if not closed:
        return counts
    newest = spark.read.schema(MARKS).parquet(f"{path}/marks").agg(F.max("newest_us").alias("newest_us"))
    end = micros(F.col("window_start")) + HOUR_US
    whole = counts.crossJoin(F.broadcast(newest)).filter(end <= F.col("newest_us") - lateness * 1_000_000)
    return whole.drop("newest_us")


def late_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that came after their hour was closed, with the micro-batch that brought them."""
    return spark.read.schema(f"{schema}, batch_id long").parquet(f"{path}/late")
