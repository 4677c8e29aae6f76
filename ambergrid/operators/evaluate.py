"""Classifier evaluation as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambergrid.operators.pieces import with_running_total
from ambergrid.session import DEFAULT_LIMITS, Limits, materialise


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    hit = (F.col(label) == F.col(prediction)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom), F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows ``class, precision, recall, f1, support``: classes, then the averages.

    The data is reduced once to a confusion table (classes squared); everything
    after that works on those few rows.
    """
    confusion = df.groupBy(F.col(label).alias("t"), F.col(prediction).cast(df.schema[label].dataType).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    # Each confusion cell counts once for its label and once for its prediction.
    sides = confusion.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.alias("hits")),
                F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")),
            )
        ).alias("s")
    )
    per_class = (
        sides.groupBy(F.col("s.c").alias("c"))
        .agg(F.sum("s.hits").alias("hits"), F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"))
        .withColumn("precision", _ratio(F.col("hits"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("hits"), F.col("support")))
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    )
    measures = ["precision", "recall", "f1"]
    total = F.sum("support")
    averages = per_class.agg(
        total.alias("support"),
        _ratio(F.sum("hits"), total).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[_ratio(F.sum(F.col(m) * F.col("support")), total).alias(f"weighted_{m}") for m in measures],
    )
    rows = F.array(
        F.struct(F.lit("accuracy").alias("class"), *[F.col("accuracy").alias(m) for m in measures], "support"),
        F.struct(F.lit("macro avg").alias("class"), *[F.col(f"macro_{m}").alias(m) for m in measures], "support"),
        F.struct(F.lit("weighted avg").alias("class"), *[F.col(f"weighted_{m}").alias(m) for m in measures], "support"),
    )
    classes = per_class.select(F.col("c").cast("string").alias("class"), *measures, "support")
    return classes.unionByName(averages.select(F.explode(rows).alias("r")).select("r.*"))


def roc_auc(df: DataFrame, label: str, score: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Area under the ROC curve, ties counted half; exact and without a global window.

    Rows are first reduced to one per distinct score, written, so that scores are found
    once. A positive outranks the negatives with lower scores and half of those with the
    same score.
    """
    positive = F.col(label) == 1
    by_score = (
        df.filter(F.col(label).isNotNull())
        .groupBy(F.col(score).cast("double").alias("s"))
        .agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    )
    # a filter of unknown scores before would find every score twice
    known = materialise(by_score, "by-score").filter("s IS NOT NULL")
    ranked = with_running_total(known, [], "s", F.col("neg"), (), limits)
    wins = F.sum(F.col("pos") * (F.col("before") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.agg(F.try_divide(wins, pairs).alias("auc"))
