"""The batch job: load, features, model input, training, scoring, alerts, results."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambergrid.models.forests import feature_importance, fit_forest, with_probability
from ambergrid.models.isolation import IsolationForest
from ambergrid.operators.alerts import alert_stats, alerts, audit_report, with_fraud_score
from ambergrid.operators.evaluate import accuracy, classification_report, roc_auc
from ambergrid.operators.features import MERCHANT_RISK, transaction_features
from ambergrid.operators.prepare import Preparation, split_tables, stratified_split
from ambergrid.plans.packaging import ship_package
from ambergrid.registry import Registry
from ambergrid.session import materialise
from ambergrid.sinks import append_alerts, write_report
from ambergrid.sources.tables import load_day, load_last_hour

# Names under which the models and their columns are kept.
FEATURES_KEY = "model_features"
ISOLATION_NAME = "fraud_isolation_forest"
FOREST_NAME = "fraud_random_forest"
IMPORTANCE_KEY = "feature_importance"

TEST_SHARE = 0.2
CONTAMINATION = 0.02


@dataclass
class FraudModel:
    """Everything scoring needs. Scaling is a stage of the forest pipeline."""

    preparation: Preparation
    forest: PipelineModel
    isolation: IsolationForest

    def score(self, featured: DataFrame) -> DataFrame:
        """Scores beside the raw columns of the same row: no join, no shuffle."""
        inputs = self.preparation.inputs
        scored = with_probability(self.forest, self.preparation.apply(featured))
        scored = self.isolation.transform(scored)
        return with_fraud_score(scored.drop(*inputs, *[f"scaled_{c}" for c in inputs]))

    def save(self, registry: Registry, metrics: Mapping[str, float] | None = None) -> None:
        registry.save_columns(FEATURES_KEY, self.preparation.features)
        registry.save_model(self.isolation, ISOLATION_NAME)
        registry.save_model(self.forest, FOREST_NAME, metrics)
        registry.save(IMPORTANCE_KEY, feature_importance(self.forest, self.preparation.features))

    @classmethod
    def load(cls, registry: Registry) -> "FraudModel":
        return cls(
            Preparation(registry.load_columns(FEATURES_KEY)),
            registry.load_model(FOREST_NAME),
            registry.load_model(ISOLATION_NAME),
        )


def train_fraud_model(
    featured: DataFrame, trees: int = 100, depth: int = 10, seed: int = 42
) -> tuple[FraudModel, dict[str, float]]:
    """Fit on a stratified 80 % and evaluate on the rest; returns the model and its metrics."""
    ship_package(featured.sparkSession)
    preparation = Preparation.fit(featured)
    inputs = preparation.inputs
    labelled = preparation.apply(featured).select("tx_id", "is_fraud", *inputs)
    # Several passes follow (scaler, trees, isolation forest, evaluation).
    data = materialise(stratified_split(labelled, "tx_id", "is_fraud", TEST_SHARE, seed), "model-input", spread=True)
    parts = split_tables(data)
    forest = fit_forest(parts["train"], inputs, "is_fraud", trees, depth, seed=seed)

    scaled = forest.stages[0].transform(parts["train"].filter("is_fraud = 0"))
    isolation = IsolationForest.fit(
        scaled, [f"scaled_{c}" for c in inputs], "tx_id", trees, contamination=CONTAMINATION, seed=seed
    )
    model = FraudModel(preparation, forest, isolation)
    tested = materialise(
        isolation.transform(with_probability(forest, parts["test"])).select(
            "is_fraud", "rf_probability", "rf_prediction", "isolation_prediction"
        ),
        "model-test",
    )
    return model, evaluate_fraud(tested)


def evaluate_fraud(tested: DataFrame) -> dict[str, float]:
    report = {r["class"]: r for r in classification_report(tested, "is_fraud", "rf_prediction").collect()}
    fraud = report.get("1")
    return {
        "iso_accuracy": accuracy(tested, "is_fraud", "isolation_prediction").first()["accuracy"],
        "rf_accuracy": accuracy(tested, "is_fraud", "rf_prediction").first()["accuracy"],
        "rf_auc": roc_auc(tested, "is_fraud", "rf_probability").first()["auc"],
        "precision": fraud["precision"] if fraud else 0.0,
        "recall": fraud["recall"] if fraud else 0.0,
        "f1_score": fraud["f1"] if fraud else 0.0,
    }


def _score_and_report(
    tx: DataFrame, model: FraudModel, registry: Registry, run: str, risk: Mapping[str, int]
) -> DataFrame:
    scored = model.score(transaction_features(tx, risk))
    registry.save(f"scored_transactions/{run}", scored, {"run": run})
    return registry.load(f"scored_transactions/{run}")


def run_batch(
    tx: DataFrame, registry: Registry, day: str, run: str, risk: Mapping[str, int] = MERCHANT_RISK, trees: int = 100
) -> dict:
    """One day from transactions to saved models, scores, alerts and report."""
    featured = registry.save_step_result("extract_features", transaction_features(load_day(tx, day), risk))
    model, metrics = train_fraud_model(featured, trees)
    model.save(registry, metrics)
    registry.save(f"scored_transactions/{run}", model.score(featured), {"run": run})
    scored = registry.load(f"scored_transactions/{run}")
    append_alerts(alerts(scored), f"{registry.root}/alerts", run)
    write_report(audit_report(scored, run), f"{registry.root}/reports/{run}")
    stats = alert_stats(scored).first().asDict()
    return {"date": day, "model_metrics": metrics, "detection_stats": stats, "run": run, "status": "success"}


def run_hour(
    tx: DataFrame, registry: Registry, as_of: str, run: str, risk: Mapping[str, int] = MERCHANT_RISK
) -> dict:
    """Score the last full hour with the saved models, without training."""
    ship_package(tx.sparkSession)
    scored = _score_and_report(load_last_hour(tx, as_of), FraudModel.load(registry), registry, run, risk)
    append_alerts(alerts(scored), f"{registry.root}/alerts", run)
    stats = alert_stats(scored).first().asDict()
    return {
        "timestamp": as_of,
        "transactions_processed": stats["total_transactions"],
        "frauds_detected": stats["total_flagged"],
        "status": "success",
    }
