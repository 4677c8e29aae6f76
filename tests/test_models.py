import numpy as np
import pytest
from pyspark.sql import functions as F

from ambergrid.models.forests import feature_importance, fit_boosted, fit_forest, with_probability
from ambergrid.models.isolation import IsolationForest, expected_depth, grow_tree, regression_forest
from ambergrid.operators import features as ft
from ambergrid.operators import prepare as prep
from ambergrid.plans import fraud
from ambergrid.plans.multiclass import summarise, train_multiclass, with_ratios
from ambergrid.registry import Registry
from ambergrid.session import materialise
from ambergrid.sources import tables as src
from conftest import SF, SF_SMALL


@pytest.fixture(scope="module")
def labelled(spark):
    """Two classes that the amount separates, 1 in 10 positive."""
    rows = spark.range(2000).select(
        F.col("id").alias("tx_id"),
        (F.col("id") % 10 == 0).cast("int").alias("y"),
        (F.col("id") % 7).cast("double").alias("noise"),
        F.when(F.col("id") % 10 == 0, F.col("id") % 50 + 100).otherwise(F.col("id") % 90).cast("double").alias("amount"),
    )
    return materialise(rows, "labelled")


@pytest.fixture(scope="module")
def planted(spark):
    """1990 rows in a cloud and 10 far away."""
    x = ((F.col("id") * 7919) % 1000) / 1000
    y = ((F.col("id") * 104729) % 1000) / 1000
    far = F.col("id") < 10
    rows = spark.range(2000).select(
        "id", F.when(far, x + 5).otherwise(x).alias("a"), F.when(far, y - 5).otherwise(y).alias("b"), far.alias("far")
    )
    return materialise(rows, "planted")


def test_forest_learns_and_weighs_classes(labelled):
    model = fit_forest(labelled, ["amount", "noise"], "y", trees=10, depth=4)
    wrong = with_probability(model, labelled).filter("rf_prediction <> y")
    assert wrong.isEmpty()
    ranked = feature_importance(model, ["amount", "noise"]).collect()
    assert [r["feature"] for r in ranked] == ["amount", "noise"] and ranked[0]["importance"] > 0.9


def test_class_weights_balance(labelled):
    weights = {r["y"]: r["weight"] for r in prep.class_weights(labelled, "y").collect()}
    assert weights == {0: pytest.approx(2000 / (2 * 1800)), 1: pytest.approx(2000 / (2 * 200))}
    totals = prep.with_class_weights(labelled, "y").groupBy("y").agg(F.sum("weight").alias("w")).collect()
    assert [r["w"] for r in totals] == [pytest.approx(1000), pytest.approx(1000)]


def test_boosted_trees_learn(labelled):
    model = fit_boosted(labelled, ["amount", "noise"], "y", rounds=3, depth=3)
    assert with_probability(model, labelled, "gbt").filter("gbt_prediction <> y").isEmpty()


def walk(tree, row):
    """Path length of a row in a tree; NaN goes right."""
    node = 0
    while tree["feature"][node] >= 0:
        left = row[tree["feature"][node]] <= tree["threshold"][node]
        node = tree["left"][node] if left else tree["right"][node]
    return tree["value"][node]


def test_scores_in_the_jvm_match_a_walk_by_hand(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(300, 3))
    rows[5, 1] = np.nan
    trees = [{"tree": k, **grow_tree(rows[rng.choice(300, 64)], rng, 6)} for k in range(20)]
    trees.append({"tree": 20, **grow_tree(rows[:1], rng, 6)})  # a single leaf
    table = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "id int, a double, b double, c double")
    assert regression_forest(spark, trees, 3).getNumTrees == 21
    model = IsolationForest(["a", "b", "c"], trees, 64, 0.0, {})
    got = {r["id"]: r["anomaly"] for r in model.with_anomaly(table).collect()}
    for k, row in enumerate(rows):
        mean = sum(walk(t, row) for t in trees) / len(trees)
        assert got[k] == pytest.approx(2 ** (-mean / expected_depth(64)), abs=1e-12)
    text = model.transform(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Exchange" not in text
    assert expected_depth(1) == 0 and expected_depth(2) == 1 and expected_depth(256) == pytest.approx(10.244, abs=1e-3)


def test_isolation_forest_ranks_planted_rows_on_top(spark, planted):
    model = IsolationForest.fit(planted, ["a", "b"], "id", contamination=0.005)
    raw = model.with_anomaly(planted, "s")
    assert raw.filter("s <= 0 OR s >= 1").isEmpty()
    top = raw.orderBy(F.desc("s")).limit(10).collect()
    assert all(r["far"] for r in top)
    flagged = model.transform(planted).filter("isolation_prediction = 1").count()
    assert flagged == 10


def test_isolation_forest_is_repeatable(planted):
    one = IsolationForest.fit(planted, ["a", "b"], "id", trees=10)
    two = IsolationForest.fit(planted.repartition(5), ["a", "b"], "id", trees=10)
    assert one.trees == two.trees and one.offset == pytest.approx(two.offset)


def test_isolation_forest_with_disjoint_samples(spark, planted):
    """Enough rows for every tree to get its own."""
    many = spark.range(20000).select(
        "id",
        (((F.col("id") * 7919) % 1000) / 1000 + F.when(F.col("id") < 200, 5).otherwise(0)).alias("a"),
        ((F.col("id") * 104729) % 1000 / 1000).alias("b"),
        (F.col("id") < 200).alias("far"),
    )
    model = IsolationForest.fit(many, ["a", "b"], "id", trees=50, sample=64)
    assert len(model.trees) == 50
    top = model.with_anomaly(many, "s").orderBy(F.desc("s")).limit(200).collect()
    assert sum(r["far"] for r in top) >= 180


def test_isolation_forest_with_many_copies_of_one_row(spark, planted):
    copies = planted.unionByName(
        spark.range(1000).select(F.lit(77).cast("long").alias("id"), F.lit(0.5).alias("a"), F.lit(0.5).alias("b"), F.lit(False).alias("far"))
    )
    model = IsolationForest.fit(copies, ["a", "b"], "id", trees=30)
    assert len(model.trees) == 30 and model.transform(copies).count() == 3000
    top = model.with_anomaly(copies, "s").orderBy(F.desc("s")).limit(10).collect()
    assert all(r["far"] for r in top)


def test_isolation_forest_on_few_and_constant_rows(spark):
    few = spark.range(3).select("id", F.lit(1.0).alias("a"))
    scores = IsolationForest.fit(few, ["a"], "id", trees=5).transform(few).collect()
    assert len({r["isolation_score"] for r in scores}) == 1
    with pytest.raises(ValueError):
        IsolationForest.fit(few.filter("false"), ["a"], "id")


def test_models_survive_the_registry(spark, labelled, planted, tmp_path):
    registry = Registry(spark, str(tmp_path))
    forest = fit_forest(labelled, ["amount", "noise"], "y", trees=5, depth=3)
    isolation = IsolationForest.fit(planted, ["a", "b"], "id", trees=5)
    registry.save_model(forest, "forest", {"accuracy": 0.95})
    registry.save_model(isolation, "isolation")
    assert registry.list_models() == ["forest", "isolation"]

    before = with_probability(forest, labelled).select("tx_id", "rf_probability").collect()
    after = with_probability(registry.load_model("forest"), labelled).select("tx_id", "rf_probability").collect()
    assert sorted(before) == sorted(after)
    loaded = registry.load_model("isolation")
    assert loaded.trees == isolation.trees and loaded.offset == isolation.offset

    about = registry.find("models/forest")["metadata"]
    assert about["model_type"] == "PipelineModel" and about["accuracy"] == "0.95"
    assert about["2.RandomForestClassificationModel.numTrees"] == "5"
    assert registry.find("models/isolation")["metadata"]["param.trees"] == "5"
    assert registry.delete_model("forest") and registry.list_models() == ["isolation"]
    with pytest.raises(KeyError):
        registry.load_model("forest")


def test_multiclass_on_vectors(spark):
    """The labels of these vectors carry no signal, so only shapes are checked."""
    vectors = src.table(spark, SF, "embeddings")
    _, tested = train_multiclass(vectors, "vec_id", "embedding", "label", trees=10, depth=8)
    tested = materialise(tested, "tested")
    assert tested.count() == 150 and tested.select("prediction").distinct().count() > 5
    assert summarise(tested, "label")["report"].count() == 13


def test_multiclass_separates_clear_classes(spark):
    rows = spark.range(300).select(
        "id",
        (F.col("id") % 3).cast("int").alias("label"),
        F.array(
            *[(F.col("id") % 3 == c).cast("double") + ((F.col("id") * 31 + c) % 10) / 100 for c in range(3)]
        ).alias("v"),
    )
    _, tested = train_multiclass(materialise(rows, "clear"), "id", "v", "label", trees=10, depth=5)
    assert summarise(tested, "label")["accuracy"].first()["accuracy"] == 1.0


def test_ratios(spark):
    rows = with_ratios(spark.createDataFrame([(6.0, 2.0), (1.0, 0.0)], "a double, b double"), [("a", "b", "r")])
    assert [r["r"] for r in rows.collect()] == [3.0, None]


def test_batch_and_hour_jobs(spark, tmp_path):
    tx = src.transactions(spark, SF)
    registry = Registry(spark, str(tmp_path / "store"))
    day, as_of = "2024-01-15", "2024-01-15 12:30:00"
    summary = fraud.run_batch(tx, registry, day, "20240116_000000", ft.EVENT_RISK, trees=5)
    n = src.load_day(tx, day).count()
    assert summary["detection_stats"]["total_transactions"] == n and summary["status"] == "success"
    assert set(summary["model_metrics"]) == {"iso_accuracy", "rf_accuracy", "rf_auc", "precision", "recall", "f1_score"}
    scored = registry.load("scored_transactions/20240116_000000")
    assert scored.count() == n and scored.filter("fraud_score IS NULL").isEmpty()
    # The score belongs to the row it stands in.
    again = scored.withColumn("s", 0.3 * F.greatest(F.lit(0.0), F.least("isolation_score", F.lit(1.0))) + 0.7 * F.col("rf_probability"))
    assert again.filter("abs(s - fraud_score) > 1e-9").isEmpty()
    report = spark.read.json(f"{registry.root}/reports/20240116_000000").first()
    assert report["total_transactions"] == n and report["model_performance"]["max_fraud_score"] <= 1
    assert registry.list_models() == ["fraud_isolation_forest", "fraud_random_forest"]
    assert registry.load(fraud.IMPORTANCE_KEY).count() == 10

    hour = fraud.run_hour(tx, registry, as_of, "20240115_120000", ft.EVENT_RISK)
    assert hour["transactions_processed"] == src.load_last_hour(tx, as_of).count() > 0


def test_scoring_is_one_pass(spark):
    featured = materialise(ft.transaction_features(src.transactions(spark, SF_SMALL), ft.EVENT_RISK), "features")
    model, _ = fraud.train_fraud_model(featured, trees=3, depth=3)
    text = model.score(featured)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text
