"""Class weights at scale: rows keep their partitions, and many classes get the same weights."""

import pytest
from pyspark.sql import functions as F

from ambergrid.operators import prepare as prep
from ambergrid.session import Limits, materialise


@pytest.fixture(scope="module")
def rows(spark):
    label = F.when(F.col("id") % 50 == 0, 1).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(0)
    return materialise(spark.range(5000).select("id", label.cast("int").alias("y")), "weights", spread=True)


def test_rows_of_few_classes_stay_in_all_partitions(spark, rows):
    """A shuffle by class would leave the fit as many tasks as there are classes."""
    automatic = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the table were estimated as large
    try:
        weighted = prep.with_class_weights(rows, "y")
        assert weighted.rdd.getNumPartitions() == rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [r["count"] for r in weighted.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", automatic)
    assert len(sizes) == rows.rdd.getNumPartitions() and max(sizes) < 2 * 5000 / len(sizes)


@pytest.mark.parametrize("limits", [Limits(), Limits(small_bytes=0, hot_rows=100)])
def test_weights_are_those_of_the_classes(rows, limits):
    weighted = prep.with_class_weights(rows, "y", limits)
    assert weighted.columns == ["y", "id", "weight"]
    found = {r["y"]: (r["n"], r["low"], r["high"]) for r in weighted.groupBy("y").agg(
        F.count("*").alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high")).collect()}
    want = {r["y"]: r["weight"] for r in prep.class_weights(rows, "y").collect()}
    assert {y: n for y, (n, _, _) in found.items()} == {0: 4800, 1: 100, None: 100}
    assert all(found[y][1:] == (want[y], want[y]) for y in (0, 1)) and found[None][1:] == (None, None)
