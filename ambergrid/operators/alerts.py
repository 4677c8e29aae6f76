"""From scores to tiered alerts, statistics and an audit report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambergrid.functions.scalar import clip, flag, money

# Fixed values of the score and its tiers (all comparisons are strict).
ISOLATION_SHARE = 0.3
FOREST_SHARE = 0.7
WARNING_ABOVE = 0.7
CRITICAL_ABOVE = 0.9
PROBABILITY_ABOVE = 0.5
STREAM_ALERT_ABOVE = 0.9

# Texts of the alert reasons.
REASON_VELOCITY = "Transaction trop rapide"
REASON_AMOUNT = "Montant anormalement élevé ($%s)"
REASON_HOUR = "Heure suspecte (%dh)"
REASON_MERCHANT = "Merchant à risque (%s)"
REASON_ZSCORE = "Montant très différent du comportement habituel"
REASON_UNKNOWN = "Pattern anormal détecté"
RISKY_MERCHANT = 3
FAR_ZSCORE = 3


def fraud_score(isolation: Column, probability: Column) -> Column:
    return ISOLATION_SHARE * clip(isolation, 0.0, 1.0) + FOREST_SHARE * probability


def with_fraud_score(df: DataFrame, isolation: str = "isolation_score", probability: str = "rf_probability") -> DataFrame:
    return df.withColumn("fraud_score", fraud_score(F.col(isolation), F.col(probability))).withColumn(
        "is_fraudulent", flag(F.col("fraud_score") > WARNING_ABOVE)
    )


def attach_scores(records: DataFrame, scores: DataFrame, key: str = "tx_id") -> DataFrame:
    """Scores from another table, matched by key (never by position)."""
    return records.join(scores, key)


def alert_level(score: Column) -> Column:
    return F.when(score > CRITICAL_ABOVE, "CRITICAL").when(score > WARNING_ABOVE, "WARNING")


def alert_reason() -> Column:
    reasons = F.concat_ws(
        " | ",
        F.when(F.col("velocity_flag") == 1, REASON_VELOCITY),
        F.when(F.col("high_amount_flag") == 1, F.format_string(REASON_AMOUNT, money(F.col("amount")))),
        F.when(F.col("risky_hour_flag") == 1, F.format_string(REASON_HOUR, F.col("hour"))),
        F.when(F.col("merchant_risk_score") >= RISKY_MERCHANT, F.format_string(REASON_MERCHANT, F.col("category"))),
        F.when(F.col("amount_zscore") > FAR_ZSCORE, REASON_ZSCORE),
    )
    return F.coalesce(F.nullif(reasons, F.lit("")), F.lit(REASON_UNKNOWN))


def alerts(scored: DataFrame) -> DataFrame:
    """Rows above the warning limit with level and reason, in one pass."""
    return (
        scored.withColumn("level", alert_level(F.col("fraud_score")))
        .filter(F.col("level").isNotNull())
        .select("level", "tx_id", "user_id", "amount", "fraud_score", "ts", alert_reason().alias("reason"))
    )


def alert_stats(scored: DataFrame) -> DataFrame:
    level = alert_level(F.col("fraud_score"))
    return scored.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if(level == "CRITICAL").alias("critical_alerts"),
        F.count_if(level == "WARNING").alias("warning_alerts"),
        F.count_if(level.isNotNull()).alias("total_flagged"),
        F.coalesce(F.sum(F.when(level.isNotNull(), F.col("amount"))), F.lit(0.0)).alias("flagged_amount"),
    )


def audit_report(scored: DataFrame, run: str | None = None) -> DataFrame:
    """One nested row; the rate of an empty table is NULL."""
    level = alert_level(F.col("fraud_score"))
    total = F.count(F.lit(1))
    flagged = F.count_if(level.isNotNull())
    optional = {
        "isolation_prediction": "isolation_detections",
        "rf_prediction": "rf_detections",
    }
    return scored.agg(
        F.lit(run).alias("timestamp"),
        total.alias("total_transactions"),
        flagged.alias("fraudulent_transactions"),
        F.try_divide(flagged.cast("double"), total).alias("fraud_rate"),
        F.sum("amount").alias("total_amount"),
        F.coalesce(F.sum(F.when(level.isNotNull(), F.col("amount"))), F.lit(0.0)).alias("fraudulent_amount"),
        F.count_if(level == "CRITICAL").alias("critical_alerts"),
        F.count_if(level == "WARNING").alias("warning_alerts"),
        F.struct(
            F.avg("fraud_score").alias("avg_fraud_score"),
            F.max("fraud_score").alias("max_fraud_score"),
            *[F.sum(c).alias(name) for c, name in optional.items() if c in scored.columns],
        ).alias("model_performance"),
    )


def alert_counts(found: DataFrame) -> DataFrame:
    """Alerts per level, with ``notify`` set when any of them is critical."""
    counts = found.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    critical = counts.agg(F.coalesce(F.bool_or(F.col("level") == "CRITICAL"), F.lit(False)).alias("notify"))
    return counts.crossJoin(F.broadcast(critical))
