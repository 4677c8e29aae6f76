"""Tree classifiers as Spark ML pipelines: scaling, assembling, classifier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambergrid.functions.scalar import flag
from ambergrid.models.binned import grow_forest
from ambergrid.operators.alerts import PROBABILITY_ABOVE
from ambergrid.operators.prepare import Scaler, with_class_weights
from ambergrid.session import scratch_path

#: Memory for split statistics per pass; more of it means fewer passes over the data.
STATISTICS_MB = 1024
#: Remember each row's node between levels instead of walking every tree again.
PASSES = {"maxMemoryInMB": STATISTICS_MB, "cacheNodeIds": True, "checkpointInterval": 10}

#: Tasks per core of a pass over the rows of boosted trees.
TASKS = 2


def _reloaded(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The model as scoring jobs get it: written and read back.

    A freshly fitted forest drags its training summary, and with it the
    session, into every task; the stored one does not.
    """
    path = scratch_path(spark, "forest")
    model.write().save(path)
    return PipelineModel.load(path)


def _stages(train: DataFrame, inputs: Sequence[str], scale: bool) -> list:
    if not scale:
        return [VectorAssembler(inputCols=list(inputs), outputCol="features")]
    scaler = Scaler.fit(train, inputs)
    return [
        SQLTransformer(statement=scaler.statement()),
        VectorAssembler(inputCols=[f"scaled_{c}" for c in inputs], outputCol="features"),
    ]


def fit_forest(
    train: DataFrame,
    inputs: Sequence[str],
    label: str,
    trees: int = 100,
    depth: int = 10,
    balanced: bool = True,
    scale: bool = True,
    seed: int = 42,
) -> PipelineModel:
    """Random forest; ``balanced`` weighs every class n / (k * n_class)."""
    data = with_class_weights(train, label) if balanced else train.withColumn("weight", F.lit(1.0))
    stages = _stages(data, inputs, scale)
    rows = stages[0].transform(data) if scale else data
    forest = grow_forest(rows, stages[-1].getInputCols(), label, "weight", trees, depth, seed)
    return PipelineModel([*stages, forest])


def fit_boosted(
    train: DataFrame,
    inputs: Sequence[str],
    label: str,
    rounds: int = 100,
    depth: int = 6,
    step: float = 0.3,
    seed: int = 42,
) -> PipelineModel:
    """Gradient-boosted trees for a binary label."""
    boosted = GBTClassifier(
        labelCol=label,
        featuresCol="features",
        maxIter=rounds,
        maxDepth=depth,
        stepSize=step,
        seed=seed,
        # a tree of few levels is walked faster than the nodes of all rows are kept
        **{**PASSES, "cacheNodeIds": False},
    )
    # all passes read the rows where the first one put them, so every core gets as many of them
    cores = train.sparkSession.sparkContext.defaultParallelism
    even = train.select(label, *inputs).repartition(TASKS * cores)
    return Pipeline(stages=[*_stages(train, inputs, False), boosted]).fit(even)


def with_probability(model: PipelineModel, df: DataFrame, prefix: str = "rf") -> DataFrame:
    """Add the probability of class 1 and the 0/1 prediction; scaled inputs stay available."""
    scored = model.transform(df)
    return scored.withColumn(
        f"{prefix}_probability", vector_to_array("probability")[1]
    ).withColumn(
        f"{prefix}_prediction", flag(F.col(f"{prefix}_probability") > PROBABILITY_ABOVE)
    ).drop("features", "rawPrediction", "probability", "prediction")


def feature_importance(model: PipelineModel, features: Sequence[str], top: int | None = 10) -> DataFrame:
    """Rows ``feature, importance`` of a fitted tree model, largest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(features, values)]
    session = SparkSession.active()
    ranked = session.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return ranked.limit(top) if top else ranked


def with_vector(df: DataFrame, array_column: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(array_column).cast("array<double>")))


def fit_multiclass(
    train: DataFrame,
    label: str,
    trees: int = 100,
    depth: int = 30,
    seed: int = 42,
) -> PipelineModel:
    """Random forest over a ready ``features`` vector with any number of classes."""
    forest = RandomForestClassifier(
        labelCol=label, featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, **PASSES
    )
    return _reloaded(Pipeline(stages=[forest]).fit(train), train.sparkSession)
