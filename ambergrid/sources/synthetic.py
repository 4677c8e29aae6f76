"""Labelled transactions generated on the executors, the same for any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ambergrid.functions.scalar import uniform

# Fixed values of the generated population.
FRAUD_RATE = 0.02
NORMAL_CATEGORIES = ["grocery", "gas", "restaurant", "online", "retail"]
FRAUD_CATEGORIES = ["jewelry", "electronics", "casino", "crypto"]
PAYMENT_SHARES = {"credit_card": 0.5, "debit_card": 0.3, "mobile_payment": 0.2}
LOG_MEAN, LOG_SIGMA = 3.5, 1.5
HIGH_AMOUNT = (1000.0, 5000.0)
MICRO_AMOUNT = (0.01, 1.0)
USER_RANGE = (1000, 5000)
MERCHANT_RANGE = (100, 500)
NORMAL_STEP_SECONDS, FRAUD_STEP_SECONDS = 60, 30


def _integer(key: str, seed: int, tag: str, low: int, high: int) -> Column:
    return (F.floor(uniform(key, seed, tag) * (high - low)) + low).cast("long")


def _choice(u: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.floor(u * len(values)).cast("int") + 1)


def _weighted(u: Column, shares: dict[str, float]) -> Column:
    chain, reached = None, 0.0
    for value, share in shares.items():
        reached += share
        chain = F.when(u < reached, value) if chain is None else chain.when(u < reached, value)
    return chain.otherwise(value)


def _normal(key: str, seed: int, tag: str) -> Column:
    radius = F.sqrt(-2 * F.ln(1 - uniform(key, seed, tag + "r")))
    return radius * F.cos(2 * math.pi * uniform(key, seed, tag + "a"))


def generate_transactions(ids: DataFrame, start: str, key: str = "id", seed: int = 42) -> DataFrame:
    """One transaction record per row of ``ids`` (key values 0 .. n-1).

    The last 2 % of the ids are fraud: the first half of them with high amounts,
    the rest with micro amounts, twice as fast as the normal ones.
    """
    # n is one number; broadcasting it keeps the generation map-only.
    size = ids.agg((F.max(key) + 1).alias("_n"))
    n_fraud = F.floor(F.col("_n") * FRAUD_RATE)
    base = ids.select(F.col(key).alias("transaction_id")).crossJoin(F.broadcast(size))
    base = base.withColumn("_rank", F.col("transaction_id") - (F.col("_n") - n_fraud))
    fraud = F.col("_rank") >= 0

    def u(tag: str) -> Column:
        return uniform("transaction_id", seed, tag)

    amount = (
        F.when(~fraud, F.exp(LOG_MEAN + LOG_SIGMA * _normal("transaction_id", seed, "amount")))
        .when(F.col("_rank") < F.floor(n_fraud / 2), HIGH_AMOUNT[0] + u("high") * (HIGH_AMOUNT[1] - HIGH_AMOUNT[0]))
        .otherwise(MICRO_AMOUNT[0] + u("micro") * (MICRO_AMOUNT[1] - MICRO_AMOUNT[0]))
    )
    seconds = F.when(fraud, F.col("_rank") * FRAUD_STEP_SECONDS).otherwise(
        F.col("transaction_id") * NORMAL_STEP_SECONDS
    )
    origin = F.lit(start).cast("timestamp_ntz")
    return base.select(
        "transaction_id",
        _integer("transaction_id", seed, "user", *USER_RANGE).alias("user_id"),
        _integer("transaction_id", seed, "merchant", *MERCHANT_RANGE).alias("merchant_id"),
        amount.alias("amount"),
        (origin + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).alias("timestamp"),
        F.when(fraud, _choice(u("category"), FRAUD_CATEGORIES))
        .otherwise(_choice(u("category"), NORMAL_CATEGORIES))
        .alias("merchant_category"),
        F.when(fraud, "credit_card").otherwise(_weighted(u("payment"), PAYMENT_SHARES)).alias("payment_method"),
        fraud.cast("int").alias("is_fraud"),
    )


def synthetic_transactions(spark: SparkSession, n: int, start: str, seed: int = 42) -> DataFrame:
    return generate_transactions(spark.range(n), start, "id", seed)
