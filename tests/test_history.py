"""Keyed user history in streams: gaps, statistics and scores equal the batch form."""

import math
import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from ambergrid.models.isolation import IsolationForest
from ambergrid.operators import features as ft
from ambergrid.plans.fraud import FraudModel, train_fraud_model
from ambergrid.session import Limits
from ambergrid.sources import tables as src
from ambergrid.streaming import common, history, jobs
from ambergrid.streaming.history import running_moments, with_user_history
from ambergrid.streaming.profile import moments_of

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def rows_of(seed=3, n=600):
    """Events in time order, with ties, NULL users, NULL amounts and a user of a third of the rows."""
    rnd = random.Random(seed)
    at, out = datetime(2024, 1, 1), []
    for k in range(n):
        at += timedelta(milliseconds=rnd.choice([0, 137, 20_000, 90_000]))
        user = 1 if rnd.random() < 0.33 else rnd.choice([None, *range(2, 40)])
        amount = None if rnd.random() < 0.05 else round(rnd.lognormvariate(3, 1), 2)
        out.append((10**15 + k, at, user, rnd.choice(["click", "error", "purchase"]), amount, '{"k": %d}' % (k % 90)))
    return out


def write_parts(spark, folder, rows, parts=6):
    """Files that arrive one after the other; equal times stay in one file."""
    size = -(-len(rows) // parts)
    low = 0
    for k in range(parts):
        high = min(len(rows), max(low, (k + 1) * size))
        while low < high < len(rows) and rows[high][1] == rows[high - 1][1]:
            high += 1
        spark.createDataFrame(rows[low:high], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        low = high
    return common.event_stream(spark, str(folder), maxFilesPerTrigger="1")


def drained(spark, stream, folder, name):
    out = str(folder / name)
    query = common.write_stream(stream, out, str(folder / f"{name}-state"))
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), query


def same(got, want, key="tx_id"):
    got = {r[key]: r for r in got.collect()}
    want = {r[key]: r for r in want.select(*next(iter(got.values())).__fields__).collect()}
    assert got.keys() == want.keys()
    for k, row in got.items():
        for name, value in row.asDict().items():
            other = want[k][name]
            if isinstance(value, float) and other is not None:
                assert math.isclose(value, other, rel_tol=1e-9, abs_tol=1e-9), (k, name, value, other)
            else:
                assert value == other, (k, name, value, other)


@pytest.mark.parametrize("limits", [Limits(), Limits(small_bytes=0, hot_rows=5)])
def test_stream_features_equal_the_batch_over_six_micro_batches(spark, tmp_path, limits):
    rows = rows_of()
    stream = write_parts(spark, tmp_path / "in", rows)
    batch = src.events_as_transactions(spark.createDataFrame(rows, SCHEMA))
    limit = jobs.high_amount_limit(batch, ft.HIGH_AMOUNT_QUANTILE)
    featured = jobs.score_features(stream, jobs.user_profile(batch), limit, ft.EVENT_RISK, limits)
    names = ["time_since_last_transaction", "velocity_flag", "risk_score", "amount_zscore", "user_avg_amount", "high_amount_flag"]
    got, query = drained(spark, featured.select("tx_id", "user_id", "category", "is_fraud", "ts", *names), tmp_path, "out")
    want = ft.transaction_features(batch, ft.EVENT_RISK).withColumn("ts", F.col("ts").cast("timestamp"))
    same(got, want)
    assert sum(p["numInputRows"] > 0 for p in query.recentProgress) == 6
    assert got.where("velocity_flag = 1").count() > 50


def test_kept_statistics_equal_running_windows(spark, tmp_path):
    rows = rows_of(4)
    known = with_user_history(write_parts(spark, tmp_path / "in", rows))
    got, _ = drained(spark, known, tmp_path, "out")
    seen = {}
    want = {}
    for key, at, user, _, amount, _ in rows:
        if user is None:
            want[key] = (None, None, None, None, None)
            continue
        last, values, n = seen.get(user, (None, [], 0))
        values = values + ([] if amount is None else [amount])
        want[key] = (
            None if last is None else (at - last).total_seconds(),
            statistics.fmean(values) if values else None,
            statistics.stdev(values) if len(values) > 1 else None,
            len(values),
            n + 1,
        )
        seen[user] = (at, values, n + 1)
    for row in got.collect():
        found = [row[c] for c in ("time_since_last_transaction", "user_avg_amount", "user_std_amount", "user_amount_count", "user_transaction_count")]
        assert all((a is None) == (b is None) for a, b in zip(found, want[row["tx_id"]])), (row, want[row["tx_id"]])
        assert all(a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-7) for a, b in zip(found, want[row["tx_id"]]))
    assert got.count() == len(rows)


def test_history_starts_the_state(spark, tmp_path):
    """A stream that goes on after a stored history sees what a batch over both would see."""
    rows = rows_of(5)
    past, rest = rows[:300], rows[300:]
    earlier = moments_of(src.events_as_transactions(spark.createDataFrame(past, SCHEMA)))
    known = with_user_history(write_parts(spark, tmp_path / "in", rest, 3), earlier)
    got, _ = drained(spark, known.select("tx_id", "time_since_last_transaction"), tmp_path, "out")
    whole = ft.with_time_since_last(src.events_as_transactions(spark.createDataFrame(rows, SCHEMA)))
    same(got, whole.where(F.col("tx_id") >= rest[0][0]))


def test_restart_late_rows_and_nobody(spark, tmp_path):
    """Late rows have no gap, leave the time alone and count; the state outlives a restart."""
    times = ["10:00:00", "10:10:00", "10:05:00", "10:10:30"]
    found = {}
    for k, at in enumerate(times):
        rows = [(k, datetime.fromisoformat(f"2024-01-01 {at}"), 1, "view", float(k), "{}"), (100 + k, None, None, None, None, None)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        known = with_user_history(common.event_stream(spark, str(tmp_path / "in")))
        got, _ = drained(spark, known, tmp_path, "out")
        found = {r["tx_id"]: r for r in got.collect()}
    assert [found[k]["time_since_last_transaction"] for k in range(4)] == [None, 600.0, None, 30.0]
    assert [found[k]["user_transaction_count"] for k in range(4)] == [1, 2, 3, 4]
    assert [found[k]["user_avg_amount"] for k in range(4)] == [0.0, 0.5, 1.0, 1.5]
    assert all(found[100 + k]["user_transaction_count"] is None and found[100 + k]["ts"] is None for k in range(4))
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(str(tmp_path / "none"))
    got, _ = drained(spark, with_user_history(common.event_stream(spark, str(tmp_path / "none"))), tmp_path, "nothing")
    assert got.count() == 0


def test_nested_columns_are_refused(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    stream = common.event_stream(spark, str(tmp_path / "none")).withColumn("extra", F.array("tx_id"))
    with pytest.raises(ValueError, match="extra"):
        with_user_history(stream)


def test_stream_scores_equal_batch_scores(spark, tmp_path):
    """The stored model gives a row the same score on the stream as in a batch."""
    rows = rows_of(6)
    batch = src.events_as_transactions(spark.createDataFrame(rows, SCHEMA)).withColumn("ts", F.col("ts").cast("timestamp"))
    featured = ft.transaction_features(batch, ft.EVENT_RISK)
    model, _ = train_fraud_model(featured, trees=5, depth=4)
    assert isinstance(model, FraudModel) and isinstance(model.isolation, IsolationForest)
    limit = jobs.high_amount_limit(batch, ft.HIGH_AMOUNT_QUANTILE)
    arriving = jobs.score_features(write_parts(spark, tmp_path / "in", rows), jobs.user_profile(batch), limit, ft.EVENT_RISK)
    names = ["tx_id", "isolation_score", "rf_probability", "fraud_score", "is_fraudulent"]
    got, _ = drained(spark, model.score(arriving).select(*names), tmp_path, "out")
    same(got, model.score(featured).select(*names))
    assert got.select("fraud_score").distinct().count() > 20


def test_running_moments_in_parts():
    """Moments merged batch by batch are those of all values, also far from zero."""
    rng = np.random.default_rng(9)
    values = rng.normal(1e9, 1.0, 500)
    values[rng.random(500) < 0.2] = np.nan
    n, mean, m2 = 0, 0.0, 0.0
    for part in np.array_split(values, 7):
        counts, means, squares = running_moments(part, n, mean, m2)
        n, mean, m2 = int(counts[-1]), float(means[-1]), float(squares[-1])
    known = values[~np.isnan(values)]
    assert n == len(known)
    assert math.isclose(mean, known.mean(), rel_tol=1e-15)
    assert math.isclose(m2, ((known - known.mean()) ** 2).sum(), rel_tol=1e-6)
    assert running_moments(np.array([np.nan]), 0, 0.0, 0.0)[0].tolist() == [0]


def test_users_share_the_calls_of_the_processor(spark, tmp_path, monkeypatch):
    """A call costs milliseconds whatever it is given, so calls must not grow with the users."""
    seen = spark.sparkContext.accumulator(0)
    plain = history.UserHistory.handleInputRows

    class Counted(history.UserHistory):
        def handleInputRows(self, key, rows, timerValues):
            seen.add(1)
            yield from plain(self, key, rows, timerValues)

    monkeypatch.setattr(history, "UserHistory", Counted)
    users = 3 * history.BUCKETS
    at = datetime(2024, 1, 1)
    rows = [(k, at + timedelta(seconds=k // users * 60), k % users, "view", float(k % 7), "{}") for k in range(2 * users)]
    got, _ = drained(spark, with_user_history(write_parts(spark, tmp_path / "in", rows, 2)), tmp_path, "out")
    assert got.groupBy("time_since_last_transaction", "user_transaction_count").count().collect() == unordered(
        [(None, 1, users), (60.0, 2, users)]
    )
    assert history.BUCKETS < seen.value <= 2 * history.BUCKETS


def unordered(rows):
    class Same(list):
        def __eq__(self, other):
            return sorted(map(tuple, other), key=str) == sorted(self, key=str)

    return Same(rows)


def test_rows_without_time_or_key_and_large_keys(spark, tmp_path, monkeypatch):
    """Users of one bucket do not meet: unknown times and keys, and whole numbers beyond doubles."""
    monkeypatch.setattr(history, "BUCKETS", 1)
    at = datetime(2024, 1, 1)
    odd = 2**62 + 1
    rows = [
        (odd, at, 1, "view", 1.0, "{}"), (odd + 2, None, 1, "view", 3.0, "{}"), (None, at + timedelta(seconds=5), 1, "view", None, "{}"),
        (7, None, 2**61 + 1, "view", 5.0, "{}"), (8, at + timedelta(seconds=9), 2**61 + 1, "view", 7.0, "{}"), (9, at, 2**61 + 2, "view", 9.0, "{}"),
    ]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    known = with_user_history(common.event_stream(spark, str(tmp_path / "in")))
    got, _ = drained(spark, known, tmp_path, "out")
    names = ("user_id", "time_since_last_transaction", "user_transaction_count", "user_amount_count", "user_avg_amount")
    found = {r["tx_id"]: tuple(r[c] for c in names) for r in got.collect()}
    assert found == {
        odd: (1, None, 1, 1, 1.0), None: (1, 5.0, 2, 1, 1.0), odd + 2: (1, None, 3, 2, 2.0),
        8: (2**61 + 1, None, 1, 1, 7.0), 7: (2**61 + 1, None, 2, 2, 6.0), 9: (2**61 + 2, None, 1, 1, 9.0),
    }
    assert got.where("ts IS NULL").count() == 2
