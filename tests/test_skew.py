"""The split forms for huge or skewed tables must equal the plain ones, row by row."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ambergrid.operators import features as ft
from ambergrid.operators import prepare as prep
from ambergrid.operators.evaluate import roc_auc
from ambergrid.operators import pieces
from ambergrid.operators.pieces import hot_keys, ranged, salted_left_join, split_hot, with_row_number, with_running_total
from ambergrid.operators.quantile import exact_quantile, grouped_quantile, order_statistic
from ambergrid.session import Limits
from ambergrid.sources.tables import transactions
from conftest import SF, SF_SMALL


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows belong to one user, some to none; timestamps repeat."""
    tx = transactions(spark, SF)
    user = (
        F.when(F.col("tx_id") % 3 == 0, F.lit(7).cast("long"))
        .when(F.col("tx_id") % 50 == 1, F.lit(None).cast("long"))
        .otherwise(F.col("user_id"))
    )
    ts = F.when(F.col("tx_id") % 10 == 0, F.date_trunc("DAY", "ts").cast("timestamp_ntz")).otherwise(F.col("ts"))
    amount = F.when(F.col("tx_id") % 13 != 0, F.col("amount"))
    return tx.withColumns({"user_id": user, "ts": ts, "amount": amount}).cache()


def rows(df, *columns):
    return sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect())


def test_features_do_not_depend_on_the_split(skewed, split_limits):
    columns = ["tx_id", *[F.round(c, 6) if c != "hour" else c for c in ft.MODEL_FEATURES]]
    plain = ft.transaction_features(skewed, ft.EVENT_RISK, Limits(small_bytes=1 << 62))
    split = ft.transaction_features(skewed, ft.EVENT_RISK, split_limits)
    assert rows(plain, *columns) == rows(split, *columns)


def test_hot_user_is_spread_over_many_ranges(skewed, split_limits):
    keyed = skewed.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    rest, hot, n = split_hot(keyed, ["user_id"], split_limits)
    assert n == hot.count() and rest.count() + n == skewed.count()
    parts = ranged(hot, n, ["user_id", "us", "tx_id"], split_limits).groupBy("_part").count().collect()
    assert len(parts) > n / split_limits.hot_rows / 2
    assert max(r["count"] for r in parts) < 5 * split_limits.hot_rows


def test_many_equal_keys_and_a_giant_one_give_bounded_tasks(spark):
    """5,000 equally large keys and one with a third of the rows: no ceiling on either."""
    limits = Limits(small_bytes=0, hot_rows=8)
    table = spark.range(75_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000).cast("long").alias("user_id"),
        F.col("id").alias("tx_id"),
        (F.hash("id") % 1000).cast("long").alias("us"),
    )
    assert hot_keys(table, ["user_id"], limits).count() == 5001
    _, hot, n = split_hot(table, ["user_id"], limits)
    limits = Limits(small_bytes=0, hot_rows=500)
    parts = ranged(hot, n, ["user_id", "us", "tx_id"], limits).groupBy("_part").count().collect()
    assert n == 75_000 and len(parts) > 100
    assert max(r["count"] for r in parts) < 5 * 500


def test_no_key_is_split_when_none_is_hot(skewed):
    rest, hot, n = split_hot(skewed, ["user_id"], Limits(small_bytes=0))
    assert hot is None and n == 0 and rest is skewed


def test_large_tables_of_hot_keys_are_not_broadcast(skewed, split_limits, monkeypatch):
    plain = ft.transaction_features(skewed, ft.EVENT_RISK, Limits(small_bytes=1 << 62))
    monkeypatch.setattr(pieces, "SENT_ROWS", 0)
    split = ft.transaction_features(skewed, ft.EVENT_RISK, split_limits)
    columns = ["tx_id", F.round("risk_score", 6), "time_since_last_transaction"]
    assert rows(plain, *columns) == rows(split, *columns)
    numbered = with_row_number(skewed, [], "tx_id", [], split_limits)
    assert numbered.withColumn("n", F.row_number().over(Window.orderBy("tx_id"))).filter("n <> row_number").isEmpty()


@pytest.mark.parametrize("keys", [[], ["user_id"], ["category", "channel"]])
def test_row_number(skewed, split_limits, keys):
    keyed = skewed.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    numbered = with_row_number(keyed, keys, "us", ["tx_id"], split_limits)
    plain = Window.partitionBy(*keys).orderBy("us", "tx_id")
    wrong = numbered.withColumn("plain", F.row_number().over(plain)).filter("row_number <> plain")
    assert numbered.count() == skewed.count()
    assert wrong.isEmpty()


def test_running_total_with_null_order_values(skewed, split_limits):
    weighted = with_running_total(skewed, ["user_id"], "amount", F.lit(2), ["tx_id"], split_limits)
    w = Window.partitionBy("user_id").orderBy("amount", "tx_id")
    plain = weighted.withColumn("plain", (F.row_number().over(w) - 1) * 2)
    assert plain.filter("before <> plain").isEmpty()


@pytest.mark.parametrize("p", [0.0, 0.02, 0.5, 0.95, 0.999, 1.0])
def test_quantile(skewed, split_limits, p):
    expected = skewed.agg(F.percentile("amount", p)).first()[0]
    assert exact_quantile(skewed, "amount", p, limits=split_limits).first()["q"] == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_narrowed_search_from_a_sample(skewed, p):
    found = order_statistic(skewed, "amount", lambda n: (n - 1) * F.lit(p), narrow_enough=300, sample=3000).first()
    values = sorted(r[0] for r in skewed.select("amount").collect() if r[0] is not None)
    rank = p * (len(values) - 1)
    assert found["low"] == values[int(rank)]
    assert found["high"] == values[-int(-rank // 1)]


def test_narrowed_search_with_one_value_in_a_third_of_the_rows(skewed):
    tied = skewed.withColumn("amount", F.when(F.col("tx_id") % 3 == 0, 5.0).otherwise(F.col("amount")))
    values = sorted(r[0] for r in tied.select("amount").collect() if r[0] is not None)
    for share in (0.1, 0.3, 0.6):
        k = int(share * len(values))
        found = order_statistic(tied, "amount", lambda n: F.lit(k), narrow_enough=300, sample=3000).first()
        assert found["low"] == values[k]


@pytest.mark.parametrize("keys", [[], ["is_fraud"]])
def test_a_bracket_that_misses_is_replaced(skewed, monkeypatch, keys):
    """A wrong bracket is noticed by its counts; infinities and NaN are values like others."""
    odd = F.when(F.col("tx_id") % 40 == 0, float("inf")).when(F.col("tx_id") % 41 == 0, float("nan")).otherwise(F.col("amount"))
    table = skewed.withColumn("amount", odd)
    right = order_statistic(table, "amount", lambda n: F.floor(n / 3), keys=keys, narrow_enough=300, sample=3000).collect()
    monkeypatch.setattr("ambergrid.operators.quantile._margin", lambda sample: -400)
    again = order_statistic(table, "amount", lambda n: F.floor(n / 3), keys=keys, narrow_enough=300, sample=3000).collect()
    assert sorted(map(str, right)) == sorted(map(str, again)) and right[0]["low"] is not None
    top = order_statistic(table, "amount", lambda n: n - 1, keys=keys, narrow_enough=300, sample=3000).collect()
    assert all(str(r["high"]) == "nan" for r in top)


def test_order_statistic_per_class(skewed):
    found = order_statistic(
        skewed, "tx_id", lambda n: F.floor(n / 2), keys=["is_fraud"], narrow_enough=100, sample=2000
    ).collect()
    for row in found:
        values = sorted(r[0] for r in skewed.filter(F.col("is_fraud") == row["is_fraud"]).select("tx_id").collect())
        assert row["low"] == values[len(values) // 2]


def test_grouped_quantile(skewed, split_limits):
    none = skewed.withColumn("amount", F.when(F.col("user_id") % 5 != 0, F.col("amount")))
    for table in (skewed, none):
        plain = grouped_quantile(table, ["user_id"], "amount", 0.99, "q", Limits(small_bytes=1 << 62))
        split = grouped_quantile(table, ["user_id"], "amount", 0.99, "q", split_limits)
        assert rows(plain, "user_id", F.round("q", 6)) == rows(split, "user_id", F.round("q", 6))


def test_quantile_of_nothing_is_null(skewed):
    empty = skewed.filter("false")
    assert exact_quantile(empty, "amount", 0.5, limits=Limits(small_bytes=-1)).collect()[0]["q"] is None
    assert exact_quantile(empty, "amount", 0.5).collect()[0]["q"] is None


def test_auc(skewed, split_limits):
    scored = skewed.withColumn("score", F.round("amount", 0))
    plain = roc_auc(scored, "is_fraud", "score", Limits(small_bytes=1 << 62)).first()["auc"]
    pairs = [(r["score"], r["is_fraud"]) for r in scored.collect() if r["score"] is not None]
    positives = [s for s, y in pairs if y == 1]
    negatives = [s for s, y in pairs if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives)
    assert plain == pytest.approx(wins / (len(positives) * len(negatives)), abs=1e-12)
    assert roc_auc(scored, "is_fraud", "score", split_limits).first()["auc"] == pytest.approx(plain, abs=1e-12)


def test_salted_join(skewed, split_limits):
    stats = ft.user_stats(skewed)
    plain = skewed.join(stats, "user_id", "left")
    salted = salted_left_join(skewed, stats, "user_id", "tx_id", split_limits)
    columns = ["tx_id", "user_id", F.round("user_avg_amount", 6), "user_transaction_count"]
    assert rows(plain, *columns) == rows(salted, *columns)


def test_results_do_not_depend_on_partitioning(spark, split_limits):
    tx = transactions(spark, SF_SMALL)
    other = tx.repartition(7, "category")
    columns = ["tx_id", F.round("risk_score", 6), "time_since_last_transaction"]
    one = ft.transaction_features(tx, ft.EVENT_RISK, split_limits)
    two = ft.transaction_features(other, ft.EVENT_RISK, split_limits)
    assert rows(one, *columns) == rows(two, *columns)


@pytest.mark.parametrize("keys", ["repeated", "half NULL"])
def test_splits_follow_one_rule(spark, split_limits, keys):
    key = F.col("id") % 10 if keys == "repeated" else F.when(F.col("id") % 2 == 0, F.col("id"))
    table = spark.range(1003).select(key.alias("k"), F.col("id").alias("v"), (F.col("id") % 3).alias("y"))
    plain = prep.random_split(table, "k", 0.25)
    split = prep.random_split(table.repartition(5), "k", 0.25, limits=split_limits)
    assert rows(plain, "k", "v", "split") == rows(split, "k", "v", "split")
    assert split.filter("split = 'test'").count() == 251
    plain = prep.stratified_split(table, "k", "y", 0.2)
    split = prep.stratified_split(table.repartition(5), "k", "y", 0.2, limits=split_limits)
    assert rows(plain, "k", "v", "split") == rows(split, "k", "v", "split")


def test_splits_take_many_classes(spark, split_limits):
    table = spark.range(6000).select("id", (F.col("id") % 1500).alias("y"))
    for limits in (Limits(), split_limits):
        assert prep.stratified_split(table, "id", "y", 0.25, limits=limits).filter("split = 'test'").count() == 1500


def test_packed_files_are_not_small(spark, tmp_path):
    from ambergrid.session import is_small, plan_bytes

    spark.range(4_000_000).select(F.lit(1).cast("long").alias("a"), F.lit(2).cast("long").alias("b")).write.parquet(str(tmp_path / "t"))
    packed = spark.read.parquet(str(tmp_path / "t"))
    assert plan_bytes(packed) < 8 << 20 and not is_small(packed, Limits(small_bytes=8 << 20))
