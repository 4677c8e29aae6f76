"""Grown trees as forests of Spark ML.

Trees grown elsewhere are written in the format in which Spark ML stores forests, by Spark
tasks, and read as a forest: rows are then scored inside the JVM by Spark's own tree walk,
and the model is stored, loaded and chained like any other.
"""

from __future__ import annotations

import json

from pyspark.ml.util import JavaMLReadable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambergrid.session import scratch_path

#: A node: its number in the tree (children after parents, from 0), the value of a leaf or the counts of
#: its classes, and the split (feature -1 for a leaf; rows with value <= threshold go left). Importances
#: need two more columns, the ``gain`` of the split and the ``impurity`` of the node.
NODES = "tree int, node int, value double, counts array<double>, left int, right int, feature int, threshold double"


def stored_forest(nodes: DataFrame, kind: type[JavaMLReadable], trees: int, width: int, classes: int = 0, params: dict | None = None):
    """The nodes as a forest: a regression by mean leaf values, or a classification if there are classes.

    ``params`` are those with which the forest was grown, under the names of Spark ML.
    """
    spark = nodes.sparkSession
    path = scratch_path(spark, "trees")
    name = "Classification" if classes else "Regression"
    defaults = {"featuresCol": "features", "labelCol": "label", "predictionCol": "prediction", "leafCol": ""}
    if classes:
        defaults |= {"rawPredictionCol": "rawPrediction", "probabilityCol": "probability"}
    about = {
        "timestamp": 0,
        "sparkVersion": spark.version,
        "defaultParamMap": {**defaults, "impurity": "gini" if classes else "variance"},
        "numFeatures": width,
        **({"numClasses": classes} if classes else {}),
    }
    package = f"org.apache.spark.ml.{name.lower()}"
    whole = {"class": f"{package}.RandomForest{name}Model", "uid": "grown_forest", "paramMap": {**(params or {}), "numTrees": trees}, "numTrees": trees, **about}
    part = {"class": f"{package}.DecisionTree{name}Model", "paramMap": {}, **about}
    leaf = F.col("feature") < 0
    split = F.struct(
        F.col("feature").alias("featureIndex"),
        F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"),
        F.lit(-1).alias("numCategories"),
    )
    node = F.struct(
        F.col("node").alias("id"),
        F.col("value").alias("prediction"),
        (F.col("impurity") if "impurity" in nodes.columns else F.lit(0.0)).alias("impurity"),
        F.col("counts").alias("impurityStats"),
        F.aggregate("counts", F.lit(0.0), lambda x, y: x + y).cast("long").alias("rawCount"),
        (F.col("gain") if "gain" in nodes.columns else F.lit(0.0)).alias("gain"),
        F.col("left").alias("leftChild"),
        F.col("right").alias("rightChild"),
        split.alias("split"),
    )
    nodes.select(F.col("tree").alias("treeID"), node.alias("nodeData")).write.parquet(f"{path}/data")
    heads = [(t, json.dumps({**part, "uid": f"grown_tree_{t}"}), 1.0) for t in range(trees)]
    spark.createDataFrame(heads, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return kind.load(path)
