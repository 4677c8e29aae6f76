"""Forests of unbounded depth."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ambergrid.models import deep
from ambergrid.models.deep import fit_deep_forest
from ambergrid.models.forests import with_vector
from ambergrid.registry import Registry
from ambergrid.session import materialise

SCHEMA = "id long, label int, v array<double>"


def table(spark, values, labels):
    rows = [(k, int(y), [float(x) for x in row]) for k, (row, y) in enumerate(zip(values, labels))]
    return with_vector(materialise(spark.createDataFrame(rows, SCHEMA), "deep"), "v")


def staircase(steps=60, copies=8):
    """Two classes in turn along one column, with shares that make every split peel off an end."""
    x = np.repeat(np.arange(steps), copies)
    y = x % 2
    return np.stack([x, np.zeros_like(x)], axis=1), y


def depths(model):
    return [tree.depth for tree in model.trees]


@pytest.mark.parametrize("local", [50_000, 40])
def test_learns_a_staircase(spark, local):
    values, labels = staircase()
    model = fit_deep_forest(table(spark, values, labels), "label", "v", "id", trees=8, local=local)
    found = model.transform(table(spark, values, labels))
    assert found.filter("prediction <> label").isEmpty()
    assert model.getNumTrees == 8 and model.numFeatures == 2 and model.numClasses == 2


def test_a_table_that_needs_more_than_forty_levels(spark):
    """The n-th column only matters where all before it are 0, so a path must pass a split for each."""
    n = 45
    values, labels = [], []
    for k in range(n):
        for copy in range(8):
            row = [0.0] * n
            row[k] = 1.0
            values.append(row)
            labels.append(k % 3)
    data = table(spark, values, labels)
    model = fit_deep_forest(data, "label", "v", "id", trees=20, seed=3)
    assert max(depths(model)) > 40
    assert model.transform(data).filter("prediction <> label").count() <= 8


@pytest.mark.parametrize("local", [50_000, 25])
def test_both_phases_learn_classes_and_held_out_rows(spark, local):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 6)) * 4
    labels = rng.integers(0, 5, 600)
    values = centres[labels] + rng.normal(size=(600, 6))
    values[3, 2] = np.nan
    data = table(spark, values, labels)
    model = fit_deep_forest(data.filter("id < 400"), "label", "v", "id", trees=20, local=local)
    right = model.transform(data.filter("id >= 400")).filter("prediction = label").count()
    assert right > 190
    chances = model.transform(data).select("probability").collect()
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in chances)


def test_trees_do_not_depend_on_partitioning(spark):
    values, labels = staircase(30, 6)
    one = fit_deep_forest(table(spark, values, labels), "label", "v", "id", trees=5)
    two = fit_deep_forest(table(spark, values, labels).repartition(7), "label", "v", "id", trees=5)
    assert [t.toDebugString.split("\n", 1)[1] for t in one.trees] == [t.toDebugString.split("\n", 1)[1] for t in two.trees]


def test_inseparable_constant_and_odd_rows(spark, tmp_path):
    same = table(spark, [[1.0, 2.0]] * 60, [k % 3 == 0 for k in range(60)])
    for local in (50_000, 10):
        model = fit_deep_forest(same, "label", "v", "id", trees=5, local=local)
        assert model.transform(same).select("prediction").distinct().count() == 1 and max(depths(model)) == 0
    pure = table(spark, [[float(k)] for k in range(40)], [1] * 40)
    model = fit_deep_forest(pure.unionByName(pure.limit(1).withColumn("label", F.lit(None).cast("int"))), "label", "v", "id", trees=3, local=5)
    assert [r[0] for r in model.transform(pure).select("prediction").distinct().collect()] == [1.0]
    with pytest.raises(ValueError):
        fit_deep_forest(pure.filter("false"), "label", "v", "id")
    registry = Registry(spark, str(tmp_path / "store"))
    registry.save_model(PipelineModel([model]), "deep")
    again = registry.load_model("deep").transform(pure)
    assert [r[0] for r in again.select("prediction").distinct().collect()] == [1.0]


def test_draws_follow_the_poisson_law():
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 200_000)
    seen = deep.draws(hashes, 3, 42)
    assert abs(seen.mean() - 1) < 0.02 and abs(seen.var() - 1) < 0.03
    assert abs((seen == 0).mean() - np.exp(-1)) < 0.01
    assert (deep.draws(hashes, 4, 42) != seen).any()


def test_bins_of_few_and_many_values(spark):
    rng = np.random.default_rng(2)
    rare = np.r_[np.zeros(995), np.arange(1, 6)]
    values = np.stack([rare, rng.normal(size=1000)], axis=1)
    cuts = deep.cut_points(table(spark, values, np.zeros(1000)), "v")
    assert cuts[0].tolist() == [0, 1, 2, 3, 4] and 200 < len(cuts[1]) <= 254


@pytest.mark.parametrize("local", [50_000, 25])
def test_a_forest_in_files_scores_like_the_stored_one(spark, local, monkeypatch):
    """Scoring must not load the forest: it has about as many nodes as its trees have rows."""
    rng = np.random.default_rng(7)
    values = np.round(rng.normal(size=(400, 4)), 1)
    labels = rng.integers(0, 3, 400)
    values[5, 1] = np.nan
    values[300:], labels[300:330] = values[0], 2  # rows that no split parts, some of another class
    data = table(spark, values, labels)
    grown = deep.grow_deep_forest(data.filter("id < 350"), "label", "v", "id", trees=15, local=local)
    assert bool(grown.upper.leaves) or local > 25
    stored = {r["id"]: r for r in grown.model().transform(data).collect()}
    monkeypatch.setattr(deep, "stored_forest", None)
    asked = data.drop("features").unionByName(spark.createDataFrame([(-1, 0, None)], SCHEMA))
    found = {r["id"]: r for r in grown.transform(asked).collect()}
    assert found.pop(-1)["prediction"] is None and found.keys() == stored.keys()
    for key, row in found.items():
        assert np.allclose(row["probability"].toArray(), stored[key]["probability"].toArray(), atol=1e-12)
        top = sorted(row["probability"].toArray())[-2:]
        assert row["prediction"] == stored[key]["prediction"] or top[1] - top[0] < 1e-9
