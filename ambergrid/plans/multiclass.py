"""The small classification job: ratios, split, multiclass forest, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambergrid.models.deep import GrownForest, grow_deep_forest
from ambergrid.models.forests import fit_multiclass, with_vector
from ambergrid.operators.evaluate import accuracy, classification_report
from ambergrid.operators.prepare import random_split, split_tables


def with_ratios(df: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Ratio columns (numerator, denominator, name); a zero denominator gives NULL."""
    return df.withColumns({name: F.try_divide(a, b) for a, b, name in pairs})


def train_multiclass(
    df: DataFrame, key: str, values: str, label: str, test_share: float = 0.3, trees: int = 100, depth: int | None = None
) -> tuple[PipelineModel | GrownForest, DataFrame]:
    """Fit on the training part, without a limit of depth unless one is given; returns the model and the scored test rows.

    Without a limit the model is a ``GrownForest``, which scores from its files; its ``model()`` can be stored.
    """
    parts = split_tables(random_split(with_vector(df, values), key, test_share))
    if depth is None:
        model = grow_deep_forest(parts["train"], label, values, key, trees)
        parts["test"] = parts["test"].select(key, label, values)
    else:
        model = fit_multiclass(parts["train"], label, trees, depth)
    tested = model.transform(parts["test"]).select(key, label, F.col("prediction").cast("int").alias("prediction"))
    return model, tested


def summarise(tested: DataFrame, label: str) -> dict[str, DataFrame]:
    return {
        "accuracy": accuracy(tested, label, "prediction"),
        "report": classification_report(tested, label, "prediction"),
    }
