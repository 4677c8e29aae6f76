"""The registered queries: every operator applied to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ambergrid.functions import scalar
from ambergrid.functions.scalar import flag, hash_order, route
from ambergrid.models.forests import feature_importance as top_features
from ambergrid.models.forests import fit_boosted, fit_forest, with_probability
from ambergrid.models.isolation import IsolationForest
from ambergrid.operators import alerts as al
from ambergrid.operators import evaluate as ev
from ambergrid.operators import features as ft
from ambergrid.operators import monitoring as mon
from ambergrid.operators import prepare as prep
from ambergrid.operators import mapping
from ambergrid.operators.pieces import with_row_number
from ambergrid.operators.quantile import exact_quantile
from ambergrid.plans.fraud import IMPORTANCE_KEY, FraudModel, train_fraud_model
from ambergrid.plans.multiclass import train_multiclass
from ambergrid.plans.packaging import ship_package
from ambergrid.plans.steplog import StepLog
from ambergrid.registry import Registry, latest_entries, list_keys
from ambergrid.session import materialise, scratch_path, shared_dir
from ambergrid.sinks import append_alerts, append_metrics, write_report
from ambergrid.sources import tables as src
from ambergrid.sources.synthetic import generate_transactions
from ambergrid.streaming import common as stream_common
from ambergrid.streaming import jobs
from ambergrid.streaming.history import with_user_history
from ambergrid.streaming.late import count_batches, hour_counts
from ambergrid.streaming.profile import ProfileStore, profile_batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Boosting rounds; the library's own default is 100.
GBT_ROUNDS = 100
DAY = "2024-01-15"
AS_OF = "2024-01-15 12:30:00"
ALERT_RULES = [
    mon.AlertRule("click", "10s"),
    mon.AlertRule("view", "1m"),
    mon.AlertRule("purchase", "150000ms", on_error=False),
    mon.AlertRule("error", "0.05h"),
    mon.AlertRule("signup", None),
]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def neat(df: DataFrame, *columns: str) -> DataFrame:
    """Chosen columns with whole numbers as BIGINT and doubles rounded to 6 digits."""
    kinds = dict(df.dtypes)

    def column(name: str) -> Column:
        if kinds[name] in ("int", "smallint", "tinyint"):
            return F.col(name).cast("long").alias(name)
        if kinds[name] in ("double", "float"):
            return F.round(name, 6).alias(name)
        if kinds[name] == "timestamp":
            return F.col(name).cast("timestamp_ntz").alias(name)
        return F.col(name)

    return df.select(*[column(c) for c in columns or df.columns])


def scored_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with stand-in model outputs derived from the key, so both tiers occur."""
    featured = ft.transaction_features(src.transactions(spark, sf_dir), ft.EVENT_RISK)
    return al.with_fraud_score(featured.withColumns(stand_in_scores()))


def stand_in_scores() -> dict[str, Column]:
    key = F.col("tx_id")
    return {
        "isolation_score": (key % 100) / F.lit(100.0),
        "rf_probability": (key * 7 % 101) / F.lit(100.0),
    }


# -- sources ---------------------------------------------------------------


@query
def src_parquet(spark, sf_dir):
    return src.read_parquet(spark, f"{sf_dir}/orders.parquet")


@query
def src_csv(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders")
    path = scratch_path(spark, "orders-csv")
    orders.write.option("header", True).csv(path)
    return src.read_csv(spark, path, orders.schema)


@query
def src_csv_inferred(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders")
    path = scratch_path(spark, "orders-csv")
    orders.write.option("header", True).csv(path)
    return src.read_csv(spark, path)


@query
def load_day(spark, sf_dir):
    return src.load_day(src.transactions(spark, sf_dir), DAY)


@query
def load_last_hour(spark, sf_dir):
    return src.load_last_hour(src.transactions(spark, sf_dir), AS_OF)


@query
def gen_profile(spark, sf_dir):
    ids = src.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    rows = generate_transactions(ids, DAY)
    fraud = F.col("is_fraud") == 1
    amount = F.col("amount")
    in_range = F.when(fraud, amount.between(1000, 5000) | amount.between(0.01, 1)).otherwise(amount > 0)
    return rows.groupBy(F.col("is_fraud").cast("long").alias("is_fraud")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(fraud & (amount >= 1000)).alias("n_high_fraud"),
        F.every(in_range).alias("amounts_ok"),
        F.every(F.col("user_id").between(1000, 4999) & F.col("merchant_id").between(100, 499)).alias("ids_ok"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


# -- datasets --------------------------------------------------------------


@query
def ds_roundtrip(spark, sf_dir):
    registry = Registry(spark, scratch_path(spark, "registry"))
    registry.save_dataframe(src.transactions(spark, sf_dir).select("tx_id", "amount"), "amounts")
    return registry.load_dataframe("amounts")


@query
def ds_step_result(spark, sf_dir):
    registry = Registry(spark, scratch_path(spark, "registry"))
    return registry.save_step_result("load", src.transactions(spark, sf_dir).select("tx_id", "amount"))


@query
def ds_metadata(spark, sf_dir):
    registry = Registry(spark, scratch_path(spark, "registry"))
    tx = src.transactions(spark, sf_dir)
    registry.save("tx/amounts", tx.select("tx_id", "amount"), {"owner": "risk"})
    registry.save("tx/users", tx.select("user_id").distinct(), {"owner": "risk"})
    return registry.entries().select(
        "key", "rows", F.element_at("metadata", "owner").alias("owner"), (F.col("size_bytes") > 0).alias("has_bytes")
    )


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions seen as registry entries of their category and user."""
    return src.transactions(spark, sf_dir).select(
        F.concat_ws("/", "category", "user_id").alias("key"),
        F.col("tx_id").alias("run_id"),
        F.col("ts").alias("saved_at"),
        (F.col("amount") < 20).alias("deleted"),
    )


@query
def ds_list(spark, sf_dir):
    return list_keys(_entries(spark, sf_dir), "p")


@query
def ds_latest(spark, sf_dir):
    return latest_entries(_entries(spark, sf_dir)).select("key", "run_id", "saved_at")


# -- projections and filters -------------------------------------------------


def _with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with NULL amounts at every 7th and NULL gaps at every 5th key."""
    tx = src.transactions(spark, sf_dir)
    return tx.select(
        "tx_id",
        F.when(F.col("tx_id") % 7 != 0, F.col("amount")).alias("amount"),
        F.when(F.col("tx_id") % 5 != 0, F.col("amount") * 10).alias("time_since_last"),
        F.when(F.col("tx_id") % 11 != 0, F.col("category")).alias("category"),
    )


@query
def na_drop(spark, sf_dir):
    return neat(prep.drop_nulls(_with_gaps(spark, sf_dir)))


@query
def na_fill(spark, sf_dir):
    return neat(prep.fill_zero(_with_gaps(spark, sf_dir)))


@query
def na_fill_default(spark, sf_dir):
    filled = prep.fill_defaults(_with_gaps(spark, sf_dir), {"time_since_last": prep.FIRST_GAP_SECONDS})
    return neat(filled)


@query
def risk_projection(spark, sf_dir):
    featured = ft.transaction_features(src.transactions(spark, sf_dir), ft.EVENT_RISK)
    return neat(featured, "tx_id", "risk_score", "amount_zscore")


@query
def drop_col(spark, sf_dir):
    return src.table(spark, sf_dir, "lineitem").drop("l_shipdate", "l_returnflag", "l_linestatus")


@query
def ratio_features(spark, sf_dir):
    items = src.table(spark, sf_dir, "lineitem")
    # Not rounded: the quotients often end in exactly ...5 at the seventh digit.
    return items.select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        "l_partkey",
        "l_suppkey",
        F.try_divide("l_extendedprice", "l_quantity").alias("price_per_unit"),
        F.try_divide("l_tax", "l_discount").alias("tax_to_discount"),
    )


@query
def align_features(spark, sf_dir):
    tx = ft.with_time_features(src.transactions(spark, sf_dir))
    listed = ["amount", "hour", "payment_cash", "day_of_week", "payment_cheque"]
    return neat(prep.align(tx, listed, keep=["tx_id"]))


@query
def time_features(spark, sf_dir):
    tx = ft.with_time_features(src.transactions(spark, sf_dir))
    return neat(tx, "tx_id", "hour", "day_of_week", "is_weekend", "is_night", "risky_hour_flag")


@query
def flag_features(spark, sf_dir):
    tx = ft.with_high_amount_flag(src.transactions(spark, sf_dir))
    flags = ft.with_time_features(tx).withColumn("micro_transaction_flag", flag(F.col("amount") < ft.MICRO_AMOUNT))
    return neat(flags, "tx_id", "high_amount_flag", "micro_transaction_flag", "risky_hour_flag")


@query
def route_by_threshold(spark, sf_dir):
    limits = [(200.0, "review"), (100.0, "check"), (50.0, "log")]
    routed = src.transactions(spark, sf_dir).withColumn("route", route(F.col("amount"), limits, "pass"))
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query
def amount_log(spark, sf_dir):
    return neat(src.transactions(spark, sf_dir).select("tx_id", F.log1p("amount").alias("amount_log")))


@query
def clip(spark, sf_dir):
    tx = src.transactions(spark, sf_dir)
    value = F.when(F.col("tx_id") % 7 != 0, F.col("amount") - 50)
    return neat(tx.select("tx_id", scalar.clip(value, 0.0, 5.0).alias("clipped")))


@query
def ts_format(spark, sf_dir):
    text = F.date_format("ts", "yyyyMMdd_HHmmss")
    return src.transactions(spark, sf_dir).select(
        "tx_id",
        text.alias("stamp"),
        F.to_timestamp_ntz(text, F.lit("yyyyMMdd_HHmmss")).alias("parsed"),
        F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("hour_start"),
        (F.date_trunc("HOUR", "ts").cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR")).alias("hour_before"),
    )


@query
def one_hot(spark, sf_dir):
    tx = src.transactions(spark, sf_dir)
    columns = prep.one_hot("channel", prep.distinct_levels(tx, "channel"), "payment")
    return neat(tx.select("tx_id", *columns))


# -- joins -------------------------------------------------------------------


@query
def join_user_stats(spark, sf_dir):
    joined = ft.join_user_stats(src.transactions(spark, sf_dir))
    return neat(
        joined, "tx_id", "user_id", "user_avg_amount", "user_std_amount", "user_amount_count", "user_transaction_count"
    )


@query
def category_risk(spark, sf_dir):
    known = {k: v for k, v in ft.EVENT_RISK.items() if k != "view"}
    joined = ft.join_category_risk(src.transactions(spark, sf_dir), known)
    return neat(joined, "tx_id", "category", "merchant_risk_score")


@query
def high_amount(spark, sf_dir):
    return neat(ft.with_high_amount_flag(src.transactions(spark, sf_dir)), "tx_id", "high_amount_flag")


@query
def score_attach(spark, sf_dir):
    tx = src.transactions(spark, sf_dir)
    scores = tx.select("tx_id", *[v.alias(k) for k, v in stand_in_scores().items()])
    return neat(
        al.attach_scores(tx.select("tx_id", "user_id", "amount"), scores),
        "tx_id", "user_id", "amount", "isolation_score", "rf_probability",
    )


@query
def fraud_score(spark, sf_dir):
    scored = al.with_fraud_score(src.transactions(spark, sf_dir).withColumns(stand_in_scores()))
    return neat(scored, "tx_id", "fraud_score", "is_fraudulent")


# -- aggregates --------------------------------------------------------------


@query
def user_stats(spark, sf_dir):
    return neat(ft.user_stats(src.transactions(spark, sf_dir)))


@query
def amount_q95(spark, sf_dir):
    return neat(exact_quantile(src.transactions(spark, sf_dir), "amount", ft.HIGH_AMOUNT_QUANTILE, "q95"))


@query
def class_counts(spark, sf_dir):
    return src.transactions(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("is_fraud") == 0).alias("normal"),
        F.count_if(F.col("is_fraud") == 1).alias("fraud"),
    )


@query
def alert_stats(spark, sf_dir):
    tx = src.transactions(spark, sf_dir).withColumns(stand_in_scores())
    return neat(al.alert_stats(al.with_fraud_score(tx)))


@query
def audit_report(spark, sf_dir):
    tx = src.transactions(spark, sf_dir).withColumns(stand_in_scores())
    path = scratch_path(spark, "report")
    report = al.audit_report(al.with_fraud_score(tx), AS_OF)
    write_report(report, path)
    saved = spark.read.schema(report.schema).json(path)
    return neat(saved.select(*[c for c in saved.columns if c != "model_performance"], "model_performance.*"))


@query
def eval_accuracy(spark, sf_dir):
    return neat(ev.accuracy(src.table(spark, sf_dir, "labels"), "quality", "toxic"))


@query
def eval_report(spark, sf_dir):
    return neat(ev.classification_report(src.table(spark, sf_dir, "labels"), "quality", "toxic"))


@query
def eval_auc(spark, sf_dir):
    return neat(ev.roc_auc(src.transactions(spark, sf_dir), "is_fraud", "amount"))


# -- windows -----------------------------------------------------------------


@query
def time_since_last(spark, sf_dir):
    tx = src.transactions(spark, sf_dir).select("tx_id", "user_id", "ts")
    return neat(ft.with_time_since_last(tx), "tx_id", "time_since_last_transaction")


@query
def velocity_flag(spark, sf_dir):
    tx = src.transactions(spark, sf_dir).select("tx_id", "user_id", "ts")
    gaps = ft.with_time_since_last(tx)
    return neat(
        gaps.select("tx_id", ft.velocity_flag(F.col("time_since_last_transaction")).alias("velocity_flag"))
    )


@query
def amount_zscore(spark, sf_dir):
    joined = ft.join_user_stats(src.transactions(spark, sf_dir))
    z = ft.zscore(F.col("amount"), F.col("user_avg_amount"), F.col("user_std_amount"))
    return neat(joined.select("tx_id", z.alias("amount_zscore")))


@query
def risk_score(spark, sf_dir):
    featured = ft.transaction_features(src.transactions(spark, sf_dir), ft.EVENT_RISK)
    return neat(featured, "tx_id", "risk_score")


@query
def fraud_features(spark, sf_dir):
    featured = ft.transaction_features(src.transactions(spark, sf_dir), ft.EVENT_RISK)
    return neat(featured, "tx_id", "user_id", *ft.MODEL_FEATURES)


# -- order and sampling --------------------------------------------------------


@query
def sort_user_ts(spark, sf_dir):
    return src.transactions(spark, sf_dir).select("user_id", "ts", "tx_id").orderBy("user_id", "ts", "tx_id")


@query
def topk(spark, sf_dir):
    top = src.transactions(spark, sf_dir).select("tx_id", "category", "amount")
    return neat(top.orderBy(F.desc("amount"), "tx_id").limit(10))


@query
def shuffle_order(spark, sf_dir):
    keys = src.transactions(spark, sf_dir).select("tx_id", hash_order(F.col("tx_id"), 42).alias("h"))
    return with_row_number(keys, [], "h", ["tx_id"]).select("tx_id", F.col("row_number").alias("position"))


@query
def log_tail(spark, sf_dir):
    runs = src.step_runs(spark, sf_dir).select("seq", "run_id", "pipeline", "step", "start_ts", "success")
    since = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return mon.search_log(runs, since, 100, pipeline="p1", step="error")


# -- set operations ------------------------------------------------------------


@query
def union_by_name(spark, sf_dir):
    tx = src.transactions(spark, sf_dir)
    high = tx.filter("amount > 100").select("tx_id", "amount", F.lit("high").alias("extra"))
    low = tx.filter("amount < 120").select("amount", "tx_id")
    return neat(high.unionByName(low, allowMissingColumns=True))


@query
def alerts(spark, sf_dir):
    return neat(al.alerts(scored_view(spark, sf_dir)), "level", "tx_id", "user_id", "amount", "fraud_score", "ts")


@query
def alert_tiers(spark, sf_dir):
    tx = al.with_fraud_score(src.transactions(spark, sf_dir).withColumns(stand_in_scores()))
    score = F.col("fraud_score")
    medium = tx.filter((score > al.WARNING_ABOVE) & (score <= al.CRITICAL_ABOVE))
    return neat(medium, "tx_id", "user_id", "amount", "fraud_score")


@query
def alert_reasons(spark, sf_dir):
    return al.alerts(scored_view(spark, sf_dir)).select("tx_id", "level", "reason")


@query
def alert_sink(spark, sf_dir):
    path = scratch_path(spark, "alerts")
    append_alerts(al.alerts(scored_view(spark, sf_dir)), path, "20240115_120000")
    return al.alert_counts(spark.read.parquet(path))


# -- metrics and logs ------------------------------------------------------------


@query
def metrics_long(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    long = mon.metrics_long(mon.step_success(src.step_runs(spark, sf_dir)), ["step"], ["runs", "successes", "success_rate"])
    append_metrics(long, path, stage="prod")
    return neat(spark.read.parquet(path), "step", "metric", "value", "unit", "stage")


@query
def log_json(spark, sf_dir):
    events = src.table(spark, sf_dir, "events")
    lines = mon.to_log_lines(
        events,
        F.col("ts"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"),
        F.concat(F.lit("event "), "event_type"),
        event_id=F.col("event_id"),
        k=F.get_json_object("props", "$.k").cast("long"),
    )
    return mon.parse_log_lines(lines, {"event_id": "long", "k": "long"})


# -- model input -----------------------------------------------------------------


@query
def split_random(spark, sf_dir):
    tx = src.transactions(spark, sf_dir).select("tx_id")
    return prep.random_split(tx, "tx_id", 0.3)


@query
def split_stratified(spark, sf_dir):
    tx = src.transactions(spark, sf_dir).select("tx_id", "is_fraud")
    return neat(prep.stratified_split(tx, "tx_id", "is_fraud", 0.2))


@query
def class_weights(spark, sf_dir):
    return neat(prep.class_weights(src.transactions(spark, sf_dir), "is_fraud"))


@query
def standardize(spark, sf_dir):
    tx = src.transactions(spark, sf_dir).select("tx_id", "amount", F.log1p("amount").alias("amount_log"))
    scaler = prep.Scaler.fit(tx, ["amount", "amount_log"])
    return neat(scaler.apply(tx))


# -- monitoring --------------------------------------------------------------------


@query
def run_summary(spark, sf_dir):
    return mon.run_summary(src.step_runs(spark, sf_dir))


@query
def pipeline_status(spark, sf_dir):
    return neat(mon.pipeline_status(src.step_runs(spark, sf_dir)))


@query
def run_status(spark, sf_dir):
    return neat(mon.pipeline_status(src.step_runs(spark, sf_dir)))


@query
def step_status(spark, sf_dir):
    return neat(mon.step_status(src.step_runs(spark, sf_dir)))


@query
def step_success(spark, sf_dir):
    return neat(mon.step_success(src.step_runs(spark, sf_dir)))


@query
def latency_alerts(spark, sf_dir):
    found = mon.latency_alerts(src.step_runs(spark, sf_dir), ALERT_RULES)
    return neat(found, "seq", "step", "duration_ms", "limit_ms", "slow", "failed")


@query
def metric_stats(spark, sf_dir):
    return neat(mon.metric_stats(src.step_runs(spark, sf_dir)))


@query
def resource_totals(spark, sf_dir):
    return mon.resource_totals(src.step_runs(spark, sf_dir))


@query
def run_cost(spark, sf_dir):
    return mon.run_cost(src.step_runs(spark, sf_dir))


@query
def step_errors(spark, sf_dir):
    return mon.step_errors(src.step_runs(spark, sf_dir))


@query
def hourly_counts(spark, sf_dir):
    tx = src.transactions(spark, sf_dir)
    return tx.groupBy(F.window("ts", "1 hour")["start"].alias("window_start"), "category").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def step_runs_log(spark, sf_dir):
    log = StepLog(Registry(spark, scratch_path(spark, "registry")), "daily", "run1")
    every = src.transactions(spark, sf_dir).select("tx_id", "user_id", "ts", "amount")
    tx = log.run("load", lambda rows: rows, every)
    log.run("stats", ft.user_stats, tx)
    return log.runs().select(
        "run_id", "pipeline", "step", "success", "error", "rows", (F.col("duration_ms") >= 0).alias("timed")
    )


# -- parallel map ------------------------------------------------------------------


def _double_amount(batch: pd.DataFrame) -> pd.DataFrame:
    return batch.assign(doubled=batch["amount"] * 2)[["tx_id", "item_index", "doubled"]]


@query
def map_items(spark, sf_dir):
    ship_package(spark)
    indexed = mapping.with_item_index(src.transactions(spark, sf_dir).select("tx_id", "amount"), "tx_id")
    return neat(mapping.map_items(indexed, _double_amount, "tx_id long, item_index long, doubled double"))


# -- models --------------------------------------------------------------------------

# SQL knows the keys of scored rows and how scores, predictions and flags hang together, so the
# queries return these checks; what the models learn is tested on constructed tables.


def _model_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """All transactions with all model inputs, split by class, and the names of the inputs."""
    featured = ft.transaction_features(src.transactions(spark, sf_dir), ft.EVENT_RISK)
    preparation = prep.Preparation.fit(featured)
    chosen = preparation.apply(featured).select("tx_id", "is_fraud", *preparation.inputs)
    rows = materialise(prep.stratified_split(chosen, "tx_id", "is_fraud"), "model-table", spread=True)
    return rows, preparation.inputs


def _version(spark: SparkSession, sf_dir: str) -> str:
    """Name of the state of the events' files: paths, sizes and times of change."""
    files = src.table(spark, sf_dir, "events").select(
        F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")
    )
    return f"{files.distinct().agg(F.sum(F.col('h') % 1_000_000_007)).first()[0] or 0:x}"


_fitted: dict[tuple[str, str], tuple[PipelineModel, DataFrame, list[str]]] = {}


def _forest(spark: SparkSession, sf_dir: str) -> tuple[PipelineModel, DataFrame, list[str]]:
    """The default forest over the training rows, fitted once per state of the data, the rows and inputs."""
    key = spark.sparkContext.applicationId, _version(spark, sf_dir)
    if key not in _fitted:
        ship_package(spark)
        rows, inputs = _model_table(spark, sf_dir)
        _fitted[key] = fit_forest(prep.split_tables(rows)["train"], inputs, "is_fraud"), rows, inputs
    return _fitted[key]


def _decisions(model: PipelineModel, rows: DataFrame, prefix: str) -> DataFrame:
    """Checks of the scored test rows; ``learned``: training rows are ranked better than by a constant."""
    parts = prep.split_tables(rows)
    chance = F.col(f"{prefix}_probability")
    fitted = with_probability(model, parts["train"], prefix).select("is_fraud", chance)
    learned = ev.roc_auc(fitted, "is_fraud", f"{prefix}_probability").select((F.col("auc") > 0.6).alias("learned"))
    return with_probability(model, parts["test"], prefix).crossJoin(F.broadcast(learned)).select(
        "tx_id",
        chance.between(0, 1).alias("in_range"),
        (F.col(f"{prefix}_prediction") == F.when(chance > 0.5, 1).otherwise(0)).alias("decided"),
        "learned",
    )


@query
def rf_binary(spark, sf_dir):
    model, rows, _ = _forest(spark, sf_dir)
    return _decisions(model, rows, "rf")


@query
def gbt_binary(spark, sf_dir):
    rows, inputs = _model_table(spark, sf_dir)
    model = fit_boosted(prep.split_tables(rows)["train"], inputs, "is_fraud", rounds=GBT_ROUNDS)
    return _decisions(model, rows, "gbt")


@query
def rf_multiclass(spark, sf_dir):
    vectors = materialise(src.table(spark, sf_dir, "embeddings"), "vectors", spread=True)
    model, tested = train_multiclass(vectors, "vec_id", "embedding", "label")
    tested = materialise(tested, "tested")
    labels = vectors.select(F.col("label").alias("prediction")).distinct().withColumn("known", F.lit(True))
    # trees of any depth tell the rows apart that they were grown on
    fitted = model.transform(vectors.join(tested.select("vec_id"), "vec_id", "left_anti"))
    learned = ev.accuracy(fitted.select("label", F.col("prediction").cast("int").alias("prediction")), "label", "prediction")
    return tested.join(F.broadcast(labels), "prediction", "left").crossJoin(F.broadcast(learned)).select(
        "vec_id",
        F.col("label").cast("long").alias("label"),
        F.coalesce("known", F.lit(False)).alias("known"),
        (F.col("accuracy") > 0.9).alias("learned"),
    )


@query
def iforest(spark, sf_dir):
    ship_package(spark)
    rows, inputs = _model_table(spark, sf_dir)
    normal = (F.col("split") == "train") & (F.col("is_fraud") == 0)
    scored = IsolationForest.fit(rows.filter(normal), inputs, "tx_id").transform(rows)
    score = F.col("isolation_score")
    scored = materialise(scored.select("tx_id", "split", "is_fraud", "isolation_score", "isolation_prediction"), "isolation")
    # the share of strange rows among those that the forest was fitted on is the given one
    share = scored.filter(normal).agg((F.abs(F.avg("isolation_prediction") - 0.02) < 0.002).alias("share_flagged"))
    return scored.crossJoin(F.broadcast(share)).select(
        "tx_id",
        score.between(-1, 1).alias("in_range"),
        (F.col("isolation_prediction") == F.when(score > 0, 1).otherwise(0)).alias("decided"),
        "share_flagged",
    )


@query
def feature_importance(spark, sf_dir):
    model, _, inputs = _forest(spark, sf_dir)
    ranked = materialise(top_features(model, inputs, top=None), "importance")
    total = ranked.agg((F.abs(F.sum("importance") - 1) < 1e-6).alias("sums_to_one"))
    return ranked.crossJoin(F.broadcast(total)).select(
        F.regexp_replace("feature", "^x_", "").alias("feature"), (F.col("importance") >= 0).alias("in_range"), "sums_to_one"
    )


def _score_checks(scored: DataFrame) -> DataFrame:
    isolation, chance, score = F.col("isolation_score"), F.col("rf_probability"), F.col("fraud_score")
    bounded = F.when(isolation < 0, 0.0).when(isolation > 1, 1.0).otherwise(isolation)
    return scored.select(
        "tx_id",
        (chance.between(0, 1) & isolation.between(-1, 1)).alias("in_range"),
        (F.abs(score - (0.3 * bounded + 0.7 * chance)) < 1e-9).alias("weighted"),
        (F.col("is_fraudulent") == F.when(score > 0.7, 1).otherwise(0)).alias("flagged"),
    )


def _stored_model(spark: SparkSession, sf_dir: str) -> tuple[FraudModel, DataFrame]:
    """The stored model of this state of the data, as a later job loads it, and the features.

    It is trained and saved where there is none yet; scoring again only loads it.
    """
    featured = materialise(ft.transaction_features(src.transactions(spark, sf_dir), ft.EVENT_RISK), "features", spread=True)
    registry = Registry(spark, f"{shared_dir(spark)}/models-{_version(spark, sf_dir)}")
    if not registry.exists(IMPORTANCE_KEY):  # saved last
        model, metrics = train_fraud_model(featured)
        model.save(registry, metrics)
    return FraudModel.load(registry), featured


@query
def score_batch(spark, sf_dir):
    model, featured = _stored_model(spark, sf_dir)
    return _score_checks(model.score(featured))


@query
def model_roundtrip(spark, sf_dir):
    """Whether the stored model gives every row the probability of the fitted one."""
    registry = Registry(spark, scratch_path(spark, "registry"))
    model, rows, inputs = _forest(spark, sf_dir)
    registry.save_model(model, "forest")
    fitted = with_probability(model, rows, "fitted").drop(*[f"scaled_{c}" for c in inputs])
    both = with_probability(registry.load_model("forest"), fitted, "stored")
    return both.select("tx_id", (F.col("fitted_probability") == F.col("stored_probability")).alias("same"))


@query
def model_registry(spark, sf_dir):
    registry = Registry(spark, scratch_path(spark, "registry"))
    model, _, _ = _forest(spark, sf_dir)
    registry.save_model(model, "forest", {"owner": "risk"})
    registry.save_model(model, "old")
    registry.delete_model("old")
    live = latest_entries(registry.entries()).filter(~F.col("deleted"))
    trees = F.element_at("metadata", "2.RandomForestClassificationModel.numTrees").cast("long")
    return live.select(
        "key",
        F.element_at("metadata", "model_type").alias("model_type"),
        F.element_at("metadata", "owner").alias("owner"),
        trees.alias("trees"),
    )


# -- streams ---------------------------------------------------------------------------


def _drain(stream_query) -> None:
    stream_query.awaitTermination()


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_common.event_stream(spark, f"{sf_dir}/event[s].parquet")


#: Micro-batches in which the registered streams with state see the events.
PARTS = 6


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files in time order, one file to a micro-batch."""
    events = src.table(spark, sf_dir, "events")
    at = scalar.micros(F.col("ts"))
    cuts = events.agg(F.percentile_approx(at, [k / PARTS for k in range(1, PARTS)])).first()[0] or []
    path = scratch_path(spark, "event-parts")
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = events if low is None else events.filter((at > low) | at.isNull())
        part = part if high is None else part.filter(at <= high)
        part.coalesce(1).write.mode("append").parquet(path)
    return stream_common.event_stream(spark, path, maxFilesPerTrigger="1")


@query
def stream_hourly(spark, sf_dir):
    out, state = scratch_path(spark, "hourly"), scratch_path(spark, "hourly-state")
    counts = jobs.hourly_counts(_stream(spark, sf_dir))
    _drain(stream_common.write_stream(counts, out, state))
    return neat(spark.read.schema(counts.schema).parquet(out))


def _late_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of two files: every 50th event comes after all others."""
    events, path = src.table(spark, sf_dir, "events"), scratch_path(spark, "late-parts")
    delayed = F.col("event_id") % 50 == 0
    for part in (~delayed, delayed):
        events.filter(part).coalesce(1).write.mode("append").parquet(path)
    return stream_common.event_stream(spark, path, maxFilesPerTrigger="1")


@query
def stream_late(spark, sf_dir):
    """Closed hours after late rows have amended them, and how many of their rows came late."""
    path = scratch_path(spark, "late")
    _drain(count_batches(_late_feed(spark, sf_dir), path, scratch_path(spark, "late-state")))
    return neat(hour_counts(spark, path), "window_start", "category", "n", "n_late", "amount")


@query
def stream_velocity(spark, sf_dir):
    ship_package(spark)
    out, state = scratch_path(spark, "velocity"), scratch_path(spark, "velocity-state")
    gaps = jobs.time_since_last(_stream(spark, sf_dir))
    _drain(stream_common.write_stream(gaps, out, state))
    return neat(spark.read.schema(gaps.schema).parquet(out), "tx_id", "user_id", "gap_seconds")


@query
def stream_velocity_bulk(spark, sf_dir):
    out, state = scratch_path(spark, "velocity-bulk"), scratch_path(spark, "velocity-bulk-state")
    _drain(jobs.gap_batches(_parts(spark, sf_dir), out, state))
    return neat(spark.read.parquet(f"{out}/gaps"), "tx_id", "user_id", "gap_seconds")


def _stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = src.transactions(spark, sf_dir)
    profile = materialise(jobs.user_profile(history), "profile")
    limit = jobs.high_amount_limit(history, ft.HIGH_AMOUNT_QUANTILE)
    return jobs.score_features(_parts(spark, sf_dir), profile, limit, ft.EVENT_RISK)


@query
def stream_features(spark, sf_dir):
    out, state = scratch_path(spark, "stream-features"), scratch_path(spark, "stream-features-state")
    ship_package(spark)
    featured = _stream_features(spark, sf_dir).select(
        "tx_id", "amount_zscore", "high_amount_flag", "hour", "time_since_last_transaction", "velocity_flag", "risk_score"
    )
    _drain(stream_common.write_stream(featured, out, state))
    return neat(spark.read.schema(featured.schema).parquet(out))


@query
def stream_history(spark, sf_dir):
    """What keyed state knows of each row's user, over several micro-batches."""
    ship_package(spark)
    out, state = scratch_path(spark, "stream-history"), scratch_path(spark, "stream-history-state")
    # the mean is shown as a sum: quotients by 32 or 64 end in exactly ...5 at the seventh digit
    known = with_user_history(_parts(spark, sf_dir)).select(
        "tx_id", "user_id", "time_since_last_transaction", "user_std_amount", "user_transaction_count",
        F.round(F.col("user_avg_amount") * F.col("user_amount_count"), 2).alias("user_amount_sum"),
    )
    _drain(stream_common.write_stream(known, out, state))
    return neat(spark.read.schema(known.schema).parquet(out))


@query
def profile_incremental(spark, sf_dir):
    """The user profile after the stream's micro-batches were merged one by one."""
    store = ProfileStore(spark, scratch_path(spark, "profile-store"))
    _drain(profile_batches(_parts(spark, sf_dir), store, scratch_path(spark, "profile-state")))
    profile = store.profile()
    return neat(
        profile.select(
            "user_id", "user_std_amount", "user_transaction_count",
            F.round(F.col("user_avg_amount") * F.col("user_amount_count"), 2).alias("user_amount_sum"),
        )
    )


@query
def stream_alerts(spark, sf_dir):
    out, state = scratch_path(spark, "stream-alerts"), scratch_path(spark, "stream-alerts-state")
    scored = _stream(spark, sf_dir).withColumns(stand_in_scores())
    _drain(jobs.alert_stream(scored, out, state))
    return neat(spark.read.parquet(out), "tx_id", "user_id", "amount", "rf_probability")


@query
def stream_score(spark, sf_dir):
    ship_package(spark)
    model, _ = _stored_model(spark, sf_dir)
    out, state = scratch_path(spark, "stream-score"), scratch_path(spark, "stream-score-state")
    scored = model.score(_stream_features(spark, sf_dir)).select(
        "tx_id", "isolation_score", "rf_probability", "fraud_score", "is_fraudulent"
    )
    _drain(stream_common.write_stream(scored, out, state))
    return _score_checks(spark.read.schema(scored.schema).parquet(out))
