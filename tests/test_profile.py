"""The incremental profile equals one batch, touches only its buckets, and survives replays."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ambergrid.operators import features as ft
from ambergrid.streaming.profile import ProfileStore, merged, moments_of

TX = "tx_id long, user_id long, ts timestamp, amount double, category string"


def hours(spark, n=10, seed=8):
    """Hours of transactions: a busy user, rare ones, NULL users and amounts, large amounts."""
    rnd = random.Random(seed)
    out, key = [], 0
    for hour in range(n):
        rows = []
        for _ in range(rnd.randrange(150)):
            key += 1
            user = 1 if rnd.random() < 0.3 else rnd.choice([None, *range(2, 60)])
            amount = None if rnd.random() < 0.1 else 1e6 + rnd.gauss(0, 3)
            rows.append((key, user, f"2024-01-01 {hour:02d}:{rnd.randrange(60):02d}:00", amount, "x"))
        df = spark.createDataFrame(rows, TX.replace("ts timestamp", "ts string"))
        out.append(df.withColumn("ts", F.col("ts").cast("timestamp")))
    return out


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9))


def check(store, tx):
    got = {r["user_id"]: r for r in store.profile().collect()}
    want = {r["user_id"]: r for r in ft.user_stats(tx).collect()}
    assert got.keys() == want.keys() and got
    for user, row in got.items():
        for name in ("user_avg_amount", "user_amount_count", "user_transaction_count"):
            assert close(row[name], want[user][name]), (user, name)
        a, b = row["user_std_amount"], want[user]["user_std_amount"]
        assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_ten_merged_hours_equal_one_batch(spark, tmp_path):
    store, parts = ProfileStore(spark, str(tmp_path / "p"), buckets=8), hours(spark)
    whole = parts[0]
    for k, part in enumerate(parts):
        whole = whole if k == 0 else whole.unionByName(part)
        assert store.merge(part, f"{k:03d}") == k + 1
    check(store, whole)
    last = {r["user_id"]: r["last_us"] for r in store.moments().collect()}
    want = whole.where("user_id is not null").groupBy("user_id").agg(F.max(F.unix_micros("ts")).alias("t")).collect()
    assert last == {r["user_id"]: r["t"] for r in want}


def test_an_hour_reads_and_writes_only_its_buckets(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path / "p"), buckets=16)
    store.merge(hours(spark, 2)[1].unionByName(hours(spark, 1)[0]), "a")
    before = store.version()
    one = spark.createDataFrame([(9999, 5, None, 10.0, "x")], TX)
    store.merge(one, "b")
    after = store.version()
    moved = [b for b in after if after[b][0] != before[b][0]]
    assert len(before) > 8 and len(moved) == 1
    read = store.moments(1, moved).inputFiles()
    assert read and all(f"bucket={moved[0]}/" in f for f in read)
    # the earlier version stays readable
    assert store.moments(1).where("user_id = 5").first()["rows"] + 1 == store.moments().where("user_id = 5").first()["rows"]


def test_replays_crashes_and_conflicts(spark, tmp_path):
    store, (one, two) = ProfileStore(spark, str(tmp_path / "p"), buckets=4), hours(spark, 2)
    store.merge(one, "2024-01-01T00")
    assert store.merge(one, "2024-01-01T00") == 1  # merged before
    # a writer that crashed left data and half a version: the version before stays in use
    (tmp_path / "p" / "versions" / "v000000000002").mkdir()
    check(store, one)
    with pytest.raises(Exception, match="(?i)already exists"):
        store.merge(two, "2024-01-01T01")  # the number is taken, nothing is lost silently
    (tmp_path / "p" / "versions" / "v000000000002").rmdir()
    assert store.merge(two, "2024-01-01T01") == 2
    check(store, one.unionByName(two))


def test_empty_hours_and_an_empty_store(spark, tmp_path):
    store = ProfileStore(spark, str(tmp_path / "p"), buckets=4)
    none = spark.createDataFrame([], TX)
    assert store.profile().count() == 0 and store.newest() == 0
    assert store.merge(none, "a") == 1 and store.profile().count() == 0
    assert store.merge(none, "a") == 1
    (one,) = hours(spark, 1)
    store.merge(one, "b")
    assert store.merge(none, "c") == 3
    check(store, one)


def test_merging_is_symmetric_and_exact_far_from_zero(spark):
    one, two = hours(spark, 2, seed=3)
    a, b = moments_of(one), moments_of(two)
    whole = {r["user_id"]: r for r in moments_of(one.unionByName(two)).collect()}
    for out in (merged(a, b), merged(b, a)):
        for r in out.collect():
            assert r["n"] == whole[r["user_id"]]["n"] and close(r["mean"], whole[r["user_id"]]["mean"])
            assert math.isclose(r["m2"], whole[r["user_id"]]["m2"], rel_tol=1e-6, abs_tol=1e-3)
