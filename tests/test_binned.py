"""Forests grown on binned rows: splits against plain sums, rules of Spark ML, and what passes read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ambergrid.models import binned
from ambergrid.models.forests import feature_importance, fit_boosted, fit_forest, with_probability
from ambergrid.operators.evaluate import roc_auc
from ambergrid.session import Limits, materialise


@pytest.fixture(scope="module")
def rows(spark):
    """Two classes that a and b tell apart together; c is noise of many values, d is constant."""
    random = F.rand(1), F.rand(2), F.rand(3)
    table = spark.range(6000).repartition(5).select("id", *[r.alias(n) for n, r in zip("abc", random)], F.lit(2.0).alias("d"))
    return materialise(table.withColumn("y", ((F.col("a") > 0.7) & (F.col("b") <= 0.4)).cast("int")), "binned-rows")


def plain_split(sums):
    """The best split of one node by its definition."""
    total, best = sums[0].sum(axis=0), (0.0, 0, 0)
    gini = lambda x: 1 - ((x / x.sum()) ** 2).sum()
    for k, table in enumerate(sums):
        for cut in range(len(table) - 1):
            left, right = table[: cut + 1].sum(axis=0), table[cut + 1 :].sum(axis=0)
            if left.sum() > 0 and right.sum() > 0:
                gain = gini(total) - (left.sum() * gini(left) + right.sum() * gini(right)) / total.sum()
                best = max(best, (gain, -k, -cut))
    return best[0], -best[1], -best[2]


def test_splits_are_the_best_ones():
    random = np.random.default_rng(7)
    first = random.poisson(0.4, (6, 1, binned.BINS, 3)).astype(float)
    sums = np.concatenate([first, random.permuted(first, axis=2), np.roll(first, 5, axis=2)], axis=1)
    sums[0, :, :, 1:] = 0  # one class only: no gain
    total, k, cut, gain, children = binned.best_splits(sums)
    for node in range(len(sums)):
        want = plain_split(sums[node])
        assert gain[node] == pytest.approx(want[0], abs=1e-9)
        assert np.allclose(total[node], sums[node, 0].sum(axis=0)) and np.allclose(children[node].sum(axis=0), total[node])
        if gain[node] > 0:
            assert np.allclose(children[node, 0], sums[node, k[node], : cut[node] + 1].sum(axis=0))
    assert gain[0] == 0 and (gain[1:] > 0).all()


def test_sums_of_weights_leave_no_rows_below_nothing():
    """Sums of weights that differ by rounding: no class has less than nothing in a child."""
    sums = np.zeros((1, 1, binned.BINS, 2))
    sums[0, 0, :3] = [[0.1 + 0.2, 5], [0.3, 0], [0, 7]]
    *_, gain, children = binned.best_splits(sums)
    assert gain[0] > 0 and (children >= 0).all()


def test_times_are_poisson():
    times = np.concatenate([binned._times(42, 3, block, 1 << 15) for block in range(40)])
    assert times.mean() == pytest.approx(1, abs=0.005) and (times == 0).mean() == pytest.approx(np.exp(-1), abs=0.003)
    assert (binned._times(42, 3, 5, 100) == binned._times(42, 3, 5, 100)).all()
    assert (binned._times(42, 3, 5, 100) != binned._times(42, 4, 5, 100)).any()


def test_cuts_of_few_and_many_values(rows):
    few = rows.withColumn("e", F.floor(F.col("a") * 4).cast("double"))
    data = few.withColumns({"_label": F.col("y"), "_weight": F.lit(1.0)})
    cuts = binned.cut_points(data, ["e", "c", "d"])
    assert cuts[0].tolist() == [0.5, 1.5, 2.5] and len(cuts[2]) == 0
    c = np.array([r["c"] for r in rows.select("c").collect()])
    shares = (c[:, None] <= cuts[1]).mean(axis=0)
    assert len(cuts[1]) == 31 and np.abs(shares - np.arange(1, 32) / 32).max() < 0.01


def test_cuts_go_by_weight(spark):
    """Of 1000 rows 50 are of a class that weighs as much as the rest: half of the bins are theirs."""
    data = spark.range(1000).select(
        F.col("id").cast("double").alias("x"), (F.col("id") >= 950).cast("int").alias("_label"), F.when(F.col("id") >= 950, 19.0).otherwise(1.0).alias("_weight")
    )
    (cuts,) = binned.cut_points(data, ["x"])
    assert 949.5 in cuts.tolist() and (cuts > 950).sum() == 15 and (cuts < 949).sum() == 15


@pytest.mark.parametrize("cells", [binned.CELLS, 5000])
def test_forest_of_binned_rows(monkeypatch, rows, cells):
    """The same with few sums at once, so that a level takes several passes."""
    monkeypatch.setattr(binned, "CELLS", cells)
    model = fit_forest(rows, ["a", "b", "c", "d"], "y", trees=12, depth=6)
    forest = model.stages[-1]
    assert forest.getNumTrees == 12 and forest.numClasses == 2 and forest.getOrDefault("maxDepth") == 6
    assert max(t.depth for t in forest.trees) <= 6 and len({t.numNodes for t in forest.trees}) > 1
    scored = with_probability(model, rows)
    assert scored.filter("rf_prediction <> y").count() < 150  # a bin is 1/32 wide
    ranked = {r["feature"]: r["importance"] for r in feature_importance(model, ["a", "b", "c", "d"]).collect()}
    assert sum(ranked.values()) == pytest.approx(1) and ranked["d"] == 0 and min(ranked["a"], ranked["b"]) > 0.3


def test_forest_is_repeatable(rows):
    one, two = (fit_forest(rows, ["a", "b", "c"], "y", trees=5, depth=5) for _ in range(2))
    assert one.stages[-1].toDebugString == two.stages[-1].toDebugString


def test_leaves_hold_weighted_shares(rows):
    """One tree of no split gives the balanced share of the classes."""
    model = fit_forest(rows, ["d"], "y", trees=30, depth=3)
    chance = with_probability(model, rows).agg(F.min("rf_probability").alias("low"), F.max("rf_probability").alias("high")).first()
    assert chance["low"] == chance["high"] == pytest.approx(0.5, abs=0.02)
    plain = fit_forest(rows, ["d"], "y", trees=30, depth=3, balanced=False)
    share = rows.agg(F.avg("y")).first()[0]
    assert with_probability(plain, rows).first()["rf_probability"] == pytest.approx(share, abs=0.01)


def test_rows_that_cannot_be_trained_on(spark, rows):
    for bad in (rows.withColumn("a", F.when(F.col("id") != 7, F.col("a"))), rows.withColumn("y", F.when(F.col("id") != 7, F.col("y")))):
        with pytest.raises(Exception, match="must not be NULL|NULL"):
            fit_forest(bad, ["a", "b"], "y", trees=2, depth=2, balanced=False)
    with pytest.raises(ValueError):
        fit_forest(rows.filter("false"), ["a", "b"], "y", trees=2)


def test_training_rows_are_a_byte_a_feature(rows):
    """Spark ML keeps about a kilobyte a row for 100 trees."""
    data = rows.select("a", "b", "c", F.col("y").alias("_label"), F.lit(1.0).alias("_weight"))
    cuts = binned.cut_points(data, ["a", "b", "c"])
    blocks = data.mapInArrow(binned._blocked(cuts), "block long, bins binary, labels binary, weights binary")
    size, n = blocks.agg(F.sum(F.length("bins") + F.length("labels") + F.length("weights")), F.count("*")).first()
    assert size == 6000 * (3 + 4 + 8) and n <= 8


def test_scores_are_found_once(spark, rows):
    """The area under the curve needs the scores of a large table several times."""
    seen = spark.sparkContext.accumulator(0)

    def counted(x: float) -> float:
        seen.add(1)
        return x

    scored = rows.withColumn("s", F.udf(counted, "double")("a"))
    auc = roc_auc(scored, "y", "s", Limits(small_bytes=0, hot_rows=500)).first()["auc"]
    assert seen.value == 6000 and auc > 0.7


def test_boosted_trees_read_even_partitions(spark, rows):
    """Rows that lie in one file: every core gets as many of them."""
    one = materialise(rows.coalesce(1), "one-file")
    model = fit_boosted(one, ["a", "b", "c"], "y", rounds=4, depth=3)
    assert model.stages[-1].getOrDefault("cacheNodeIds") is False
    assert with_probability(model, rows, "gbt").filter("gbt_prediction <> y").count() < 300
