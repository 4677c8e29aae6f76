"""Behavioural transaction features."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambergrid.functions.scalar import (
    clip,
    flag,
    is_night,
    is_risky_hour,
    is_weekend,
    lookup,
    micros,
    seconds_between,
    weekday,
)
from ambergrid.operators.pieces import salted_left_join, split_hot, with_previous
from ambergrid.operators.quantile import exact_quantile
from ambergrid.session import DEFAULT_LIMITS, Limits, is_small

# Risk per merchant category.
MERCHANT_RISK = {
    "jewelry": 3,
    "electronics": 3,
    "casino": 4,
    "crypto": 4,
    "grocery": 1,
    "gas": 1,
    "restaurant": 2,
    "online": 2,
    "retail": 1,
}

#: The same scale for the categories of the ``events`` table.
EVENT_RISK = {"error": 4, "purchase": 3, "signup": 2, "click": 1, "view": 1}

# The columns a model is trained on, in order.
MODEL_FEATURES = [
    "amount",
    "amount_log",
    "amount_zscore",
    "hour",
    "day_of_week",
    "is_weekend",
    "is_night",
    "user_avg_amount",
    "user_std_amount",
    "user_transaction_count",
    "time_since_last_transaction",
    "velocity_flag",
    "merchant_risk_score",
    "high_amount_flag",
    "micro_transaction_flag",
    "risky_hour_flag",
    "risk_score",
]

# Fixed values of the feature formulas.
HIGH_AMOUNT_QUANTILE = 0.95
VELOCITY_SECONDS = 60
MICRO_AMOUNT = 1
ZSCORE_EPSILON = 1e-5


def user_stats(tx: DataFrame) -> DataFrame:
    """Per-user mean, sample deviation and counts. Aggregates partially before its shuffle."""
    aggregates = [value.alias(name) for name, value in _user_aggregates().items()]
    return tx.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(*aggregates)


def join_user_stats(tx: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Every transaction with the statistics of its user; hot users are salted."""
    return salted_left_join(tx, user_stats(tx), "user_id", "tx_id", limits)


def zscore(amount: Column, mean: Column, std: Column) -> Column:
    return (amount - mean) / (std + F.lit(ZSCORE_EPSILON))


def with_time_features(tx: DataFrame) -> DataFrame:
    ts = F.col("ts")
    return tx.withColumns(
        {
            "hour": F.hour(ts),
            "day_of_week": weekday(ts),
            "is_weekend": is_weekend(ts),
            "is_night": is_night(ts),
            "risky_hour_flag": is_risky_hour(ts),
        }
    )


def _user_aggregates() -> dict[str, Column]:
    return {
        "user_avg_amount": F.avg("amount"),
        "user_std_amount": F.stddev_samp("amount"),
        "user_amount_count": F.count("amount"),
        "user_transaction_count": F.count("tx_id"),
    }


def _gap(previous: Column) -> Column:
    return F.when(F.col("user_id").isNotNull(), seconds_between(previous, F.col("_us")))


def with_user_history(tx: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Add user statistics and the seconds since the user's previous transaction.

    One shuffle of the table, on the user: both windows share it. The rows of hot users
    get the statistics from one aggregate, and their predecessors by a scan over ranges.
    """
    timed = tx.withColumn("_us", micros(F.col("ts")))
    rest, hot, rows = (timed, None, 0) if is_small(tx, limits) else split_hot(timed, ["user_id"], limits, _user_aggregates())
    # The ordered window comes first: its sort also serves the unordered one.
    ordered = Window.partitionBy("user_id").orderBy("_us", "tx_id")
    whole = Window.partitionBy("user_id")
    out = rest.withColumn("_prev_us", F.lag("_us").over(ordered)).withColumns(
        {name: value.over(whole) for name, value in _user_aggregates().items()}
    )
    if hot is not None:
        out = out.unionByName(with_previous(hot, ["user_id"], "_us", ["tx_id"], "_prev_us", rows, limits))
    known = F.col("user_id").isNotNull()
    return (
        out.withColumn("time_since_last_transaction", _gap(F.col("_prev_us")))
        .withColumns({name: F.when(known, F.col(name)) for name in _user_aggregates()})
        .drop("_us", "_prev_us")
    )


def with_time_since_last(tx: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Only the seconds since the user's previous transaction."""
    timed = tx.withColumn("_us", micros(F.col("ts")))
    rest, hot, rows = (timed, None, 0) if is_small(tx, limits) else split_hot(timed, ["user_id"], limits)
    ordered = Window.partitionBy("user_id").orderBy("_us", "tx_id")
    out = rest.withColumn("_prev_us", F.lag("_us").over(ordered))
    if hot is not None:
        out = out.unionByName(with_previous(hot, ["user_id"], "_us", ["tx_id"], "_prev_us", rows, limits))
    return out.withColumn("time_since_last_transaction", _gap(F.col("_prev_us"))).drop("_us", "_prev_us")


def velocity_flag(gap: Column) -> Column:
    return flag(gap < VELOCITY_SECONDS)


def with_high_amount_flag(tx: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Compare each amount with one global quantile, a single broadcast row."""
    cut = exact_quantile(tx, "amount", HIGH_AMOUNT_QUANTILE, "_q", limits)
    return (
        tx.crossJoin(F.broadcast(cut))
        .withColumn("high_amount_flag", flag(F.col("amount") > F.col("_q")))
        .drop("_q")
    )


def join_category_risk(tx: DataFrame, risk: Mapping[str, int]) -> DataFrame:
    """Risk by a join with the lookup table; its size is that of the given mapping."""
    rows = [(k, v) for k, v in risk.items()]
    table = tx.sparkSession.createDataFrame(rows, "category string, merchant_risk_score int")
    return tx.join(F.broadcast(table), "category", "left")


def risk_score() -> Column:
    """Composite risk; NULL as soon as a term is unknown."""
    return (
        F.col("velocity_flag") * 2
        + F.col("high_amount_flag") * 3
        + F.col("micro_transaction_flag")
        + F.col("risky_hour_flag")
        + F.col("merchant_risk_score")
        + clip(F.col("amount_zscore"), 0.0, 5.0)
    )


def point_features(df: DataFrame, risk: Mapping[str, int]) -> DataFrame:
    """Features of a row that already has its user statistics, gap and high-amount flag."""
    return (
        with_time_features(df)
        .withColumns(
            {
                "amount_log": F.log1p("amount"),
                "amount_zscore": zscore(F.col("amount"), F.col("user_avg_amount"), F.col("user_std_amount")),
                "velocity_flag": velocity_flag(F.col("time_since_last_transaction")),
                "micro_transaction_flag": flag(F.col("amount") < MICRO_AMOUNT),
                "merchant_risk_score": lookup(F.col("category"), risk),
            }
        )
        .withColumn("risk_score", risk_score())
    )


def transaction_features(
    tx: DataFrame,
    risk: Mapping[str, int] = MERCHANT_RISK,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """All features of a transaction table: one full shuffle plus one broadcast number."""
    cut = exact_quantile(tx, "amount", HIGH_AMOUNT_QUANTILE, "_q", limits)
    history = with_user_history(tx, limits).crossJoin(F.broadcast(cut))
    flagged = history.withColumn("high_amount_flag", flag(F.col("amount") > F.col("_q"))).drop("_q")
    return point_features(flagged, risk)
