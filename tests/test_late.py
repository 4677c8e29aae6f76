"""Late rows amend closed hours."""

from datetime import datetime

from pyspark.sql import functions as F

from ambergrid.sources import tables as src
from ambergrid.streaming import common
from ambergrid.streaming.late import count_batches, hour_counts, late_rows
from conftest import SF_SMALL

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def feed(spark, folder, rows):
    spark.createDataFrame([(i, at and datetime.fromisoformat(at), 1, kind, v, "{}") for i, at, kind, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return common.event_stream(spark, str(folder), maxFilesPerTrigger="1")


def drain(query):
    query.awaitTermination()


def test_late_files_give_the_batch_counts(spark, tmp_path):
    events = src.table(spark, SF_SMALL, "events")
    order = [F.col("event_id") % 7 != 3, (F.col("event_id") % 7 == 3) & (F.col("event_id") % 2 == 0), (F.col("event_id") % 7 == 3) & (F.col("event_id") % 2 == 1)]
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    for part in order:  # a restart after every file
        events.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        drain(count_batches(common.event_stream(spark, str(tmp_path / "in"), maxFilesPerTrigger="1"), path, state))
    tx = src.transactions(spark, SF_SMALL)
    want = tx.groupBy(F.window("ts", "1 hour")["start"].cast("timestamp").alias("w"), "category").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 6).alias("a"))
    got = hour_counts(spark, path, closed=False).select(F.col("window_start").alias("w"), "category", "n", F.round("amount", 6).alias("a"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    late = late_rows(spark, path, "tx_id long, ts timestamp")
    assert late.count() == hour_counts(spark, path, closed=False).agg(F.sum("n_late")).first()[0] > 50
    assert late.where("tx_id % 7 <> 3").isEmpty() and late.select("batch_id").distinct().count() == 2


def test_an_amended_hour_and_a_replay(spark, tmp_path):
    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    steps = [
        [(1, "2024-01-01 10:05:00", "a", 1.0), (2, "2024-01-01 10:30:00", "b", 2.0)],
        [(3, "2024-01-01 11:10:00", "a", 4.0)],  # closes the hour of 10
        [(4, "2024-01-01 10:59:59", "a", 8.0), (5, "2024-01-01 11:05:00", "a", 16.0), (6, None, "a", 32.0)],
    ]
    seen = []
    for rows in steps:
        drain(count_batches(feed(spark, tmp_path / "in", rows), path, state))
        seen.append(sorted((r["window_start"].hour, r["category"], r["n"], r["n_late"], r["amount"]) for r in hour_counts(spark, path).collect()))
    assert seen == [[], [(10, "a", 1, 0, 1.0), (10, "b", 1, 0, 2.0)], [(10, "a", 2, 1, 9.0), (10, "b", 1, 0, 2.0)]]
    kept = late_rows(spark, path, "tx_id long, amount double").collect()
    assert sorted((r["tx_id"], r["batch_id"]) for r in kept) == [(4, 2), (6, 2)]
    for name in ("2", ".2.crc"):  # the last batch was not committed: it runs again and changes nothing
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    drain(count_batches(common.event_stream(spark, str(tmp_path / "in"), maxFilesPerTrigger="1"), path, state))
    assert sorted((r["window_start"].hour, r["category"], r["n"], r["n_late"], r["amount"]) for r in hour_counts(spark, path).collect()) == seen[-1]
