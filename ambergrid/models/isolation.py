"""Isolation forest (Liu, Ting and Zhou, 2008) on Spark.

Every tree sees a few hundred sampled rows, so trees are grown one per group on
the executors and are small enough to broadcast for scoring, which Spark ML's own
tree walk does inside the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambergrid.functions.scalar import flag, uniform
from ambergrid.models.stored import NODES, stored_forest
from ambergrid.operators.quantile import exact_quantile
from ambergrid.session import materialise

TREE_SCHEMA = (
    "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, "
    "value array<double>"
)
_SPARE = 1.5  # rows drawn per wanted row, so that a tree hardly ever gets too few


def expected_depth(n: int) -> float:
    """Average depth of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(rows: np.ndarray, rng: np.random.Generator, depth_limit: int) -> dict[str, list]:
    """Random splits until a row stands alone; leaves hold their path length."""
    feature, threshold, left, right, value = [], [], [], [], []
    waiting = [(np.arange(len(rows)), 0, -1, False)]
    while waiting:
        members, depth, parent, is_left = waiting.pop()
        node = len(feature)
        if parent >= 0:
            (left if is_left else right)[parent] = node
        part = rows[members]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        stop = depth >= depth_limit or varying.size == 0
        chosen = -1 if stop else int(rng.choice(varying))
        cut = 0.0 if stop else float(rng.uniform(low[chosen], high[chosen]))
        feature.append(chosen)
        threshold.append(cut)
        left.append(-1)
        right.append(-1)
        value.append(depth + expected_depth(len(members)) if stop else 0.0)
        if not stop:
            goes_left = part[:, chosen] <= cut
            waiting.append((members[goes_left], depth + 1, node, True))
            waiting.append((members[~goes_left], depth + 1, node, False))
    return {"feature": feature, "threshold": threshold, "left": left, "right": right, "value": value}


def regression_forest(spark: SparkSession, trees: Sequence[dict], width: int) -> RandomForestRegressionModel:
    """The trees as a forest of Spark ML whose prediction is the mean path length."""
    names = ("value", "left", "right", "feature", "threshold")
    columns = {name: np.concatenate([np.asarray(t[name]) for t in trees]) for name in names}
    sizes = [len(t["feature"]) for t in trees]
    columns |= {"tree": np.repeat(np.arange(len(trees)), sizes), "node": np.concatenate([np.arange(n) for n in sizes])}
    table = spark.createDataFrame(pd.DataFrame(columns)).coalesce(1)  # columns, as rows of Python objects are slow
    kinds = dict(part.split() for part in NODES.split(", "))
    counts = F.array(*[F.lit(0.0)] * 3).alias("counts")
    table = table.select(*[counts if c == "counts" else F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    return stored_forest(table, RandomForestRegressionModel, len(trees), width)


@dataclass
class IsolationForest:
    inputs: list[str]
    trees: list[dict]
    sample: int
    offset: float
    params: dict
    _forest: RandomForestRegressionModel | None = field(default=None, repr=False, compare=False)

    @classmethod
    def fit(
        cls,
        df: DataFrame,
        inputs: Sequence[str],
        key: str,
        trees: int = 100,
        sample: int = 256,
        contamination: float = 0.02,
        seed: int = 42,
    ) -> "IsolationForest":
        """Fit on a table whose rows are identified by ``key``.

        Every tree takes every row with the same chance, whatever the size of the
        table. A row's hash gives the first tree that takes it, if any does, and
        further hashes those after it, so only taken rows are repeated. The sample
        depends on key hashes only.
        """
        inputs = list(inputs)
        n = df.count()
        if n == 0:
            raise ValueError("cannot fit an isolation forest on an empty table")
        size = min(sample, n)
        chance = min(1.0, size * _SPARE / n)
        rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in inputs])
        if chance < 1.0:
            # P(first tree <= k) = 1 - (1 - chance)^(k + 1), turned round
            first = F.floor(F.log1p(-uniform(key, seed, "draw")) / F.lit(math.log1p(-chance))).cast("long")
            mixed = rows.withColumn("_first", first).filter(F.col("_first") < trees)
            later = F.filter(
                F.sequence(F.lit(0), F.lit(trees - 1)),
                lambda t: (t == F.col("_first"))
                | (
                    (t > F.col("_first"))
                    & (F.shiftrightunsigned(F.xxhash64(F.col(key), t, F.lit(seed)), 11) / F.lit(float(1 << 53)) < chance)
                ),
            )
            drawn = mixed.withColumn("tree", F.explode(later)).drop("_first")
        else:
            drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        # Copies of one key collapse before the shuffle, so no tree's group can grow large.
        drawn = drawn.dropDuplicates([key, "tree"]).withColumn("_order", F.xxhash64(key, "tree", F.lit(seed + 2)))
        limit = max(1, math.ceil(math.log2(max(size, 2))))

        def grow(group: pd.DataFrame) -> pd.DataFrame:
            number = int(group["tree"].iloc[0])
            chosen = group.sort_values("_order").head(size)[inputs].to_numpy(dtype=float)
            tree = grow_tree(chosen, np.random.default_rng([seed, number]), limit)
            return pd.DataFrame([{"tree": number, **tree}])

        grown = drawn.groupBy("tree").applyInPandas(grow, TREE_SCHEMA).orderBy("tree").collect()
        params = {"trees": trees, "sample": sample, "contamination": contamination, "seed": seed}
        model = cls(inputs, [r.asDict() for r in grown], size, 0.0, params)
        # One scoring pass over the training rows; the quantile then reads the written scores.
        scores = materialise(model.with_anomaly(df, "s").select((-F.col("s")).alias("s")), "isolation-scores")
        model.offset = exact_quantile(scores, "s", contamination).first()["q"]
        return model

    def with_anomaly(self, df: DataFrame, name: str = "anomaly") -> DataFrame:
        """Add the anomaly score in (0, 1), found inside the JVM."""
        if self._forest is None:
            self._forest = regression_forest(df.sparkSession, self.trees, len(self.inputs))
        forest = self._forest.setFeaturesCol("_isolation_inputs").setPredictionCol("_isolation_depth")
        vectors = VectorAssembler(inputCols=self.inputs, outputCol="_isolation_inputs", handleInvalid="keep")
        scale = expected_depth(self.sample) or 1.0
        walked = forest.transform(vectors.transform(df))
        score = F.pow(F.lit(2.0), -F.col("_isolation_depth") / scale)
        return walked.withColumn(name, score).drop("_isolation_inputs", "_isolation_depth")

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``isolation_score`` (higher is stranger) and the 0/1 ``isolation_prediction``."""
        scored = self.with_anomaly(df, "isolation_score")
        scored = scored.withColumn("isolation_score", F.col("isolation_score") + F.lit(self.offset))
        return scored.withColumn("isolation_prediction", flag(F.col("isolation_score") > 0))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [tuple(t[c.split()[0]] for c in TREE_SCHEMA.split(", ")) for t in self.trees]
        spark.createDataFrame(rows, TREE_SCHEMA).coalesce(1).write.parquet(f"{path}/trees")
        head = [(self.inputs, self.sample, self.offset, {k: str(v) for k, v in self.params.items()})]
        spark.createDataFrame(
            head, "inputs array<string>, sample int, offset double, params map<string,string>"
        ).coalesce(1).write.parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "IsolationForest":
        head = spark.read.parquet(f"{path}/head").first()
        trees = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
        return cls(
            list(head["inputs"]), [t.asDict() for t in trees], head["sample"], head["offset"], dict(head["params"])
        )
