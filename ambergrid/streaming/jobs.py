"""Hourly counts, scoring against a profile, stateful gaps and alerts on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ambergrid.functions.scalar import flag, micros
from ambergrid.operators.alerts import STREAM_ALERT_ABOVE
from ambergrid.operators.features import MERCHANT_RISK, point_features, user_stats, with_time_since_last
from ambergrid.operators.pieces import salted_left_join
from ambergrid.operators.quantile import exact_quantile
from ambergrid.session import DEFAULT_LIMITS, Limits, materialise
from ambergrid.streaming.common import for_each_batch
from ambergrid.streaming.history import with_user_history

LATENESS = "10 minutes"


def hourly_counts(tx: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Counts and amounts per hour and category; an hour is emitted once it is closed.

    Rows later than the watermark are dropped and counted by the query's progress.
    """
    return (
        tx.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour").alias("w"), "category")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
        .select(F.col("w.start").alias("window_start"), "category", "n", "amount")
    )


def user_profile(history: DataFrame) -> DataFrame:
    """Static side of stream scoring: what is known of every user so far."""
    return user_stats(history)


def score_features(
    stream: DataFrame,
    profile: DataFrame | None,
    high_amount: float,
    risk: Mapping[str, int] = MERCHANT_RISK,
    limits: Limits = DEFAULT_LIMITS,
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Features of arriving transactions, the same as those of a batch over the same rows.

    The gap comes from the user's keyed state, so ``velocity_flag`` and ``risk_score`` are
    known. The user's statistics come from a stored profile, whose busiest users are salted
    going by the counts in it; unknown users keep NULLs. Without a profile they are those that
    the state has kept, up to and including the row. ``earlier`` rows start the state.
    """
    known = with_user_history(stream, earlier)
    if profile is not None:
        known = known.drop("user_avg_amount", "user_std_amount", "user_amount_count", "user_transaction_count")
        rows = F.col("user_transaction_count")
        busy = profile.filter(rows > limits.hot_rows).select("user_id", rows.alias("_n"))
        known = salted_left_join(known, profile, "user_id", "tx_id", limits, hot=busy)
    return point_features(known.withColumn("high_amount_flag", flag(F.col("amount") > high_amount)), risk)


def high_amount_limit(history: DataFrame, p: float) -> float:
    return exact_quantile(history, "amount", p).first()["q"]


_GAP_SCHEMA = "user_id long, tx_id long, ts timestamp, gap_seconds double"


def _gaps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Gaps of one user's new rows, in time order, after the last time seen before.

    A row older than that time cannot know its predecessor any more: its gap is
    NULL and it does not move the state back.
    """
    rows = pd.concat(list(batches)).sort_values(["us", "tx_id"], kind="stable")
    times = rows["us"].to_numpy()
    last = state.get[0] if state.exists else None
    fresh = np.ones(len(times), dtype=bool) if last is None else times >= last
    gap = np.full(len(times), np.nan)
    new = times[fresh]
    if len(new):
        first = np.nan if last is None else (new[0] - last) / 1e6
        gap[fresh] = np.concatenate([[first], np.diff(new) / 1e6])
        state.update((int(new[-1]),))
    yield pd.DataFrame(
        {
            "user_id": rows["user_id"].to_numpy(),
            "tx_id": rows["tx_id"].to_numpy(),
            "ts": rows["ts"].to_numpy(),
            "gap_seconds": gap,
        }
    )


def time_since_last(tx: DataFrame) -> DataFrame:
    """Seconds since the user's previous transaction, kept across micro-batches.

    State is one timestamp per user; a micro-batch is bounded by the source's
    trigger limit, which bounds the rows a busy user brings at once.
    """
    narrow = tx.select("user_id", "tx_id", "ts", micros(F.col("ts")).alias("us"))
    gaps = narrow.filter("user_id IS NOT NULL").groupBy("user_id").applyInPandasWithState(
        _gaps, _GAP_SCHEMA, "last_us long", "append", GroupStateTimeout.NoTimeout
    )
    # Arrow hands NaN back where there is no predecessor.
    known = gaps.withColumn("gap_seconds", F.when(~F.isnan("gap_seconds"), F.col("gap_seconds")))
    # Rows without a user have no predecessor; they pass through without state.
    nobody = narrow.filter("user_id IS NULL").select("user_id", "tx_id", "ts", F.lit(None).cast("double").alias("gap_seconds"))
    return known.unionByName(nobody)


def gap_batches(
    tx: DataFrame,
    path: str,
    checkpoint: str,
    limits: Limits = DEFAULT_LIMITS,
    every: str | None = None,
) -> StreamingQuery:
    """The same gaps by one batch join and window per micro-batch, for backfills and busy users.

    Instead of keyed state, a table of last times is carried from batch to batch
    in two slots that alternate; inside a batch a hot user is split by time. A
    replayed batch reads the slot of the batch before and overwrites its own.
    """
    last_schema = "user_id long, last_us long"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0:
            last = spark.createDataFrame([], last_schema)
        else:
            last = spark.read.schema(last_schema).parquet(f"{path}/last/slot={(batch_id - 1) % 2}")
        rows = materialise(batch.select("user_id", "tx_id", "ts", micros(F.col("ts")).alias("us")), "gap-batch")
        known = salted_left_join(rows, last, "user_id", "tx_id", limits)
        # Late rows leave the user's sequence: no gap, and no effect on later rows.
        fresh = F.col("last_us").isNull() | (F.col("us") >= F.col("last_us"))
        masked = known.withColumns({"_who": F.col("user_id"), "user_id": F.when(fresh, F.col("user_id"))})
        since = (F.col("us") - F.col("last_us")) / F.lit(1e6)
        gap = F.when(
            F.col("user_id").isNotNull(), F.coalesce(F.col("time_since_last_transaction"), since)
        )
        gaps = with_time_since_last(masked, limits).select(
            F.col("_who").alias("user_id"), "tx_id", "ts", gap.alias("gap_seconds")
        )
        gaps.write.mode("overwrite").parquet(f"{path}/gaps/batch_id={batch_id}")
        newest = last.unionByName(rows.filter("user_id IS NOT NULL").select("user_id", F.col("us").alias("last_us")))
        newest.groupBy("user_id").agg(F.max("last_us").alias("last_us")).write.mode("overwrite").parquet(
            f"{path}/last/slot={batch_id % 2}"
        )

    return for_each_batch(tx, write, checkpoint, every)


def alert_stream(
    scored: DataFrame,
    path: str,
    checkpoint: str,
    probability: str = "rf_probability",
    on_alert: Callable[[int, int], None] | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Append alerts above the probability limit, one folder per micro-batch.

    A replayed batch overwrites its own folder, so restarts leave no duplicates.
    """
    found = scored.filter(F.col(probability) > STREAM_ALERT_ABOVE)

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(target)
        if on_alert:
            rows = batch.sparkSession.read.schema(batch.schema).parquet(target).count()
            if rows:
                on_alert(batch_id, rows)

    return for_each_batch(found, write, checkpoint, every)
