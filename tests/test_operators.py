"""Edge rows and invariants of the batch operators."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ambergrid.functions import scalar
from ambergrid.operators import alerts as al
from ambergrid.operators import evaluate as ev
from ambergrid.operators import features as ft
from ambergrid.operators import mapping
from ambergrid.operators import monitoring as mon
from ambergrid.operators import prepare as prep
from ambergrid.session import Limits
from ambergrid.sources import tables as src
from ambergrid.sources.synthetic import synthetic_transactions
from conftest import SF, SF_SMALL

TX = "tx_id long, user_id long, ts timestamp_ntz, amount double, category string, channel string, is_fraud int"


def at(text):
    return datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def edge(spark):
    rows = [
        (1, 10, at("2024-01-01 00:00:00"), 5.0, "grocery", "credit_card", 0),  # only row of its user
        (2, 20, at("2024-01-06 10:00:00"), 7.0, "casino", "debit_card", 0),  # constant amounts
        (3, 20, at("2024-01-06 10:00:59.5"), 7.0, "casino", None, 0),
        (4, 20, at("2024-01-06 10:00:59.5"), 7.0, "unknown", "credit_card", 1),  # tie, no such category
        (5, 30, at("2024-01-07 22:00:00"), None, "gas", "credit_card", 0),  # no amount
        (6, 30, at("2024-01-07 23:00:00"), -2.0, "gas", "credit_card", 0),
        (7, 30, at("2024-01-08 06:59:59"), 0.0, "gas", "cash", 0),
        (8, None, at("2024-01-08 12:00:00"), 900.0, "crypto", "credit_card", 1),  # no user
        (9, None, at("2024-01-08 12:00:01"), 1.0, None, "credit_card", 0),
    ]
    return spark.createDataFrame(rows, TX)


@pytest.fixture(scope="module", params=["plain", "split"])
def featured(request, edge, split_limits):
    limits = Limits() if request.param == "plain" else Limits(small_bytes=-1, hot_rows=1)
    return {r["tx_id"]: r for r in ft.transaction_features(edge, limits=limits).collect()}


def test_single_transaction_user(featured):
    row = featured[1]
    assert row["user_std_amount"] is None and row["amount_zscore"] is None and row["risk_score"] is None
    assert row["time_since_last_transaction"] is None and row["velocity_flag"] == 0
    assert row["user_transaction_count"] == 1


def test_constant_amounts_and_ties(featured):
    assert featured[2]["amount_zscore"] == 0.0
    assert featured[3]["time_since_last_transaction"] == 59.5 and featured[3]["velocity_flag"] == 1
    assert featured[4]["time_since_last_transaction"] == 0.0
    assert featured[4]["merchant_risk_score"] is None and featured[4]["risk_score"] is None


def test_null_zero_and_negative_amounts(featured):
    assert featured[5]["high_amount_flag"] == 0 and featured[5]["micro_transaction_flag"] == 0
    assert featured[5]["amount_log"] is None and featured[5]["user_amount_count"] == 2
    assert featured[5]["user_transaction_count"] == 3
    assert featured[6]["micro_transaction_flag"] == 1 and featured[6]["amount_log"] is None
    assert featured[7]["amount_log"] == 0.0


def test_missing_user_gets_no_history(featured):
    for key in (8, 9):
        assert featured[key]["user_avg_amount"] is None and featured[key]["time_since_last_transaction"] is None
    assert featured[8]["high_amount_flag"] == 1 and featured[9]["merchant_risk_score"] is None


def test_time_features(featured):
    assert [featured[i]["day_of_week"] for i in (1, 2, 5)] == [0, 5, 6]
    assert [featured[i]["is_weekend"] for i in (1, 2, 5)] == [0, 1, 1]
    assert [featured[i]["is_night"] for i in (1, 2, 5, 7)] == [1, 0, 1, 1]
    assert [featured[i]["risky_hour_flag"] for i in (1, 7)] == [1, 0]


def test_features_of_nothing(edge):
    assert ft.transaction_features(edge.filter("false")).count() == 0


def test_preparation_is_the_same_for_training_and_scoring(edge):
    rows = ft.transaction_features(edge)
    preparation = prep.Preparation.fit(rows)
    assert preparation.features[-3:] == ["payment_cash", "payment_credit_card", "payment_debit_card"]
    ready = {r["tx_id"]: r for r in preparation.apply(rows).collect()}
    assert ready[1]["x_time_since_last_transaction"] == 3600.0 and ready[1]["x_amount_zscore"] == 0.0
    assert ready[1]["amount_zscore"] is None  # raw columns stay
    assert [ready[3][f"x_payment_{c}"] for c in ("cash", "credit_card", "debit_card")] == [0.0, 0.0, 0.0]
    scoring = preparation.apply(rows.filter("tx_id = 7").drop("hour"))
    row = scoring.first()
    assert row["x_payment_cash"] == 1.0 and row["x_payment_debit_card"] == 0.0 and row["x_hour"] == 0.0


def test_too_many_levels_are_refused(spark):
    with pytest.raises(ValueError, match="more than 5"):
        prep.distinct_levels(spark.range(10), "id", 5)


def test_drop_nulls_drops_nan_too(spark):
    rows = spark.createDataFrame([(1.0, "a"), (math.nan, "b"), (None, "c"), (2.0, None)], "x double, y string")
    assert [r["x"] for r in prep.drop_nulls(rows).collect()] == [1.0]
    assert sorted(r["x"] for r in prep.fill_zero(rows).collect()) == [0.0, 0.0, 1.0, 2.0]


@pytest.mark.parametrize("share", [0.2, 0.25, 0.3])
def test_random_split_is_exact_and_repeatable(spark, share, split_limits):
    tx = src.transactions(spark, SF_SMALL).select("tx_id")
    first = prep.random_split(tx, "tx_id", share)
    second = prep.random_split(tx.repartition(5), "tx_id", share, limits=split_limits)
    parts = prep.split_tables(first)
    assert parts["test"].count() == math.ceil(1000 * share) and first.count() == 1000
    assert sorted(first.collect()) == sorted(second.collect())
    other = prep.random_split(tx, "tx_id", share, seed=7)
    assert sorted(first.collect()) != sorted(other.collect())


def test_stratified_split_keeps_the_shares(spark, split_limits):
    tx = src.transactions(spark, SF).select("tx_id", "is_fraud")
    split = prep.stratified_split(tx, "tx_id", "is_fraud")
    counts = split.groupBy("is_fraud", "split").count().collect()
    found = {(r["is_fraud"], r["split"]): r["count"] for r in counts}
    for label in (0, 1):
        n = found[label, "test"] + found[label, "train"]
        assert found[label, "test"] == math.floor(0.2 * n + 0.5)
    large = prep.stratified_split(tx, "tx_id", "is_fraud", limits=split_limits)
    columns = ["tx_id", "is_fraud", "split"]
    assert sorted(split.select(columns).collect()) == sorted(large.select(columns).collect())


@pytest.mark.parametrize("limits", [Limits(), Limits(small_bytes=0)])
def test_stratified_split_of_tiny_and_missing_classes(spark, limits):
    k = F.col("id")
    rows = spark.range(110).select(k.alias("k"), F.when(k < 100, (k < 2).cast("int")).alias("y"))
    split = prep.stratified_split(rows, "k", "y", limits=limits)
    counts = split.filter("split = 'test'").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in counts} == {0: 20} and split.count() == 110


def test_scaling(spark):
    tx = src.transactions(spark, SF_SMALL).select("tx_id", "amount", F.lit(3.0).alias("constant"))
    scaler = prep.Scaler.fit(tx, ["amount", "constant"])
    row = scaler.apply(tx).agg(F.avg("amount"), F.stddev_pop("amount"), F.min("constant"), F.max("constant")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1) and row[2] == row[3] == 0.0


def test_scalars(spark):
    row = spark.sql("select cast(null as double) as n, -3.0D as a, 0.4D as b, 9.0D as c").select(
        *[scalar.clip(F.col(x), 0.0, 5.0).alias(x) for x in "nabc"]
    ).first()
    assert tuple(row) == (None, 0.0, 0.4, 5.0)
    texts = {"500ms": 500, "1s": 1000, "10s": 10000, "30m": 1.8e6, "2h": 7.2e6, "1.5s": 1500, "x": None, "10": None, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["ms"] for r in rows.select("t", scalar.duration_ms(F.col("t")).alias("ms")).collect()} == texts
    assert spark.range(1).select(scalar.money_grouped(F.lit(12345.678))).first()[0] == "12,345.68"


def scored(spark, values):
    rows = [(i, 1, at("2024-01-01 03:00:00"), 10.0 * i, s) for i, s in enumerate(values)]
    df = spark.createDataFrame(rows, "tx_id long, user_id long, ts timestamp_ntz, amount double, fraud_score double")
    quiet = {c: F.lit(0) for c in ("velocity_flag", "high_amount_flag", "risky_hour_flag", "merchant_risk_score")}
    return df.withColumns({**quiet, "hour": F.lit(3), "amount_zscore": F.lit(None).cast("double"), "category": F.lit("casino")})


def test_tiers_are_strict(spark):
    rows = al.alerts(scored(spark, [0.7, 0.70001, 0.9, 0.90001, 1.0, 0.0, None])).collect()
    assert {r["tx_id"]: r["level"] for r in rows} == {1: "WARNING", 2: "WARNING", 3: "CRITICAL", 4: "CRITICAL"}
    stats = al.alert_stats(scored(spark, [0.7, 0.70001, 0.9, 0.90001, 1.0])).first()
    assert tuple(stats) == (5, 2, 2, 4, 100.0)


def test_reasons(spark):
    base = scored(spark, [1.0])
    assert al.alerts(base).first()["reason"] == al.REASON_UNKNOWN
    one = {"velocity_flag": F.lit(1), "high_amount_flag": F.lit(1), "risky_hour_flag": F.lit(1)}
    full = base.withColumns({**one, "merchant_risk_score": F.lit(4), "amount_zscore": F.lit(3.5), "amount": F.lit(1234.5)})
    assert al.alerts(full).first()["reason"].split(" | ") == [
        "Transaction trop rapide",
        "Montant anormalement élevé ($1234.50)",
        "Heure suspecte (3h)",
        "Merchant à risque (casino)",
        "Montant très différent du comportement habituel",
    ]


def test_report_of_nothing(spark):
    row = al.audit_report(scored(spark, [0.5]).filter("false"), "r").first()
    assert row["total_transactions"] == 0 and row["fraud_rate"] is None and row["fraudulent_amount"] == 0.0


def test_scores_are_joined_by_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "tx_id long, v string")
    right = spark.createDataFrame([(3, 0.3), (1, 0.1), (2, 0.2)], "tx_id long, s double")
    assert {r["v"]: r["s"] for r in al.attach_scores(left, right).collect()} == {"a": 0.1, "b": 0.2, "c": 0.3}


def test_classification_report(spark):
    pairs = [(0, 0), (0, 0), (0, 1), (1, 1), (2, 1), (2, 1)]
    rows = {r["class"]: r for r in ev.classification_report(spark.createDataFrame(pairs, "y int, p int"), "y", "p").collect()}
    assert tuple(rows["0"])[1:] == (1.0, pytest.approx(2 / 3), pytest.approx(0.8), 3)
    assert tuple(rows["1"])[1:] == (0.25, 1.0, pytest.approx(0.4), 1)
    assert tuple(rows["2"])[1:] == (0.0, 0.0, 0.0, 2)
    assert rows["accuracy"]["f1"] == 0.5
    assert rows["macro avg"]["precision"] == pytest.approx(1.25 / 3)
    assert rows["weighted avg"]["recall"] == pytest.approx(0.5)
    assert rows["weighted avg"]["support"] == 6


def test_auc_of_one_class_is_unknown(spark):
    assert ev.roc_auc(spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double"), "y", "s").first()["auc"] is None


def test_run_results(spark):
    rows = [("r", "step1", True, None, 1500.0), ("r", "step2", False, "failed", 500.0), ("r", "step3", True, None, 2000.0)]
    runs = spark.createDataFrame(rows, "run_id string, step string, success boolean, error string, duration_ms double")
    runs = runs.withColumns({"pipeline": F.lit("p"), "start_ts": F.lit("2024-01-01 00:00:00").cast("timestamp"), "memory_mb": F.lit(1024)})
    assert tuple(mon.run_summary(runs).first()) == ("r", 2, 3, False)
    assert mon.step_errors(runs).first()["error"] == "failed"
    rules = [mon.AlertRule("step1", "1s"), mon.AlertRule("step2", "10s"), mon.AlertRule("step3", "2s", False)]
    found = {r["step"]: (r["slow"], r["failed"]) for r in mon.latency_alerts(runs, rules).collect()}
    assert found == {"step1": (True, False), "step2": (False, True)}
    cost = mon.run_cost(runs.withColumn("duration_ms", F.lit(None).cast("double"))).first()
    assert cost["total"] == 8.0 and cost["storage"] == 5.0


def test_generated_population(spark):
    made = synthetic_transactions(spark, 5000, "2024-01-01")
    again = synthetic_transactions(spark, 5000, "2024-01-01").repartition(3)
    assert sorted(made.collect()) == sorted(again.collect())
    counts = {r["is_fraud"]: r["count"] for r in made.groupBy("is_fraud").count().collect()}
    assert counts == {0: 4900, 1: 100}
    row = made.filter("is_fraud = 0").agg(
        F.avg(F.ln("amount")), F.stddev(F.ln("amount")), F.avg((F.col("payment_method") == "credit_card").cast("int")),
        F.count_distinct("merchant_category"), F.min("user_id"), F.max("user_id"),
    ).first()
    assert row[0] == pytest.approx(3.5, abs=0.1) and row[1] == pytest.approx(1.5, abs=0.1)
    assert row[2] == pytest.approx(0.5, abs=0.05) and row[3] == 5 and row[4] >= 1000 and row[5] < 5000
    tx = src.from_records(made)
    assert set(tx.columns) == {"tx_id", "user_id", "merchant_id", "ts", "amount", "category", "channel", "is_fraud"}
    assert ft.transaction_features(tx).filter("risk_score IS NOT NULL").count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitioned_day_load(spark, tmp_path):
    tx = src.transactions(spark, SF_SMALL)
    src.write_by_day(tx, str(tmp_path / "tx"))
    stored = spark.read.parquet(str(tmp_path / "tx"))
    assert src.load_day(stored, "2024-01-15").count() == src.load_day(tx, "2024-01-15").count() > 0
    for as_of, days in (("2024-01-15 12:30:00", "2024-01-15"), ("2024-01-16 00:10:00", "2024-01-15")):
        hour = src.load_last_hour(stored, as_of)
        assert hour.count() == src.load_last_hour(tx, as_of).count()
        assert f"PartitionFilters: [isnotnull(dt" in plan_of(hour) and days in plan_of(hour)
    assert "PartitionFilters: [isnotnull(dt" in plan_of(src.load_day(stored, "2024-01-15"))


def test_sorted_output_is_sorted(spark):
    import __spark_entry__ as contract

    rows = contract.queries()["sort_user_ts"](spark, SF_SMALL).collect()
    assert rows == sorted(rows)


def test_map_items_indexes_by_key(spark):
    indexed = mapping.with_item_index(spark.range(50, 150).repartition(4), "id")
    doubled = mapping.map_items(indexed, lambda b: b.assign(d=b["id"] * 2)[["item_index", "d"]], "item_index long, d long")
    assert sorted(tuple(r) for r in doubled.collect()) == [(i, 2 * (50 + i)) for i in range(100)]


def test_log_lines_keep_free_fields(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00.123456", 'say "hi"', 5)], "t string, m string, n int")
    lines = mon.to_log_lines(df, F.col("t").cast("timestamp_ntz"), F.lit("INFO"), F.col("m"), n=F.col("n"))
    row = mon.parse_log_lines(lines, {"n": "int", "absent": "string"}).first()
    assert row["message"] == 'say "hi"' and row["n"] == 5 and row["absent"] is None
    assert row["timestamp"] == at("2024-01-01 00:00:00.123456")


def test_log_search(spark):
    runs = src.step_runs(spark, SF_SMALL)
    rows = mon.search_log(runs, F.lit("2024-01-20").cast("timestamp_ntz"), 5, step="error").collect()
    assert len(rows) == 5 and [r["start_ts"] for r in rows] == sorted((r["start_ts"] for r in rows), reverse=True)
    assert all(r["step"] == "error" and r["start_ts"] >= at("2024-01-20") for r in rows)


def test_many_channels_share_hashed_indicators(spark):
    """Any number of channels fits and scores, with unseen and NULL ones."""
    from ambergrid.models.forests import fit_forest, with_probability

    rows = spark.range(6000).select(
        F.col("id").alias("tx_id"),
        F.concat(F.lit("channel."), F.col("id") % 5000).alias("channel"),
        (F.col("id") % 5000 == 17).cast("int").alias("is_fraud"),
        *[F.lit(0.0).alias(c) for c in ft.MODEL_FEATURES],
    )
    preparation = prep.Preparation.fit(rows)
    assert preparation.features == [*ft.MODEL_FEATURES, *[f"payment#{k}" for k in range(prep.HASHED_LEVELS)]]
    hashed = [f"x_payment#{k}" for k in range(prep.HASHED_LEVELS)]
    odd = rows.limit(2).withColumn("channel", F.when(F.col("tx_id") == 0, "never seen"))
    ready = preparation.apply(rows.unionByName(odd))
    assert ready.filter(sum(F.col(f"`{c}`") for c in hashed) != F.col("channel").isNotNull().cast("int")).isEmpty()
    slots = rows.select(prep.hashed_level("channel", prep.HASHED_LEVELS).alias("s")).groupBy("s").count().collect()
    assert len(slots) == prep.HASHED_LEVELS and max(r["count"] for r in slots) < 300
    model = fit_forest(ready.filter("tx_id < 5000"), preparation.inputs, "is_fraud", trees=3, depth=3)
    assert with_probability(model, preparation.apply(odd)).filter("rf_probability BETWEEN 0 AND 1").count() == 2
