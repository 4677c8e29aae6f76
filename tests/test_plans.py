"""What the physical plans must look like."""

import re

import pytest

import __spark_entry__ as contract
from ambergrid.operators import features as ft
from ambergrid.operators import prepare as prep
from ambergrid.session import Limits
from ambergrid.sources import tables as src
from conftest import SF


MODELS = {"rf_binary", "gbt_binary", "rf_multiclass", "iforest", "feature_importance", "score_batch"}


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended")).split("== Physical Plan ==")[1]


def shuffles(text):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)


def test_day_filter_reaches_the_scan(spark):
    text = plan(src.load_day(src.transactions(spark, SF), "2024-01-15").select("tx_id", "amount"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in text


def test_hour_filter_reaches_the_scan(spark):
    text = plan(src.load_last_hour(src.transactions(spark, SF), "2024-01-15 12:30:00"))
    assert "LessThan(ts,2024-01-15T12:00" in text


def test_features_shuffle_the_table_once(spark):
    text = plan(contract.queries()["fraud_features"](spark, SF))
    assert len(shuffles(text)) == 1
    assert text.count("+- Sort ") + text.count("- Sort ") <= 2 and text.count("Window [") == 2
    assert "props" not in text


def test_split_features_shuffle_every_row_once(spark):
    """Rows of usual users go by user, those of hot users (written in ranges) by range."""
    text = plan(ft.with_user_history(src.transactions(spark, SF), Limits(small_bytes=0, hot_rows=70)))
    found = shuffles(text)
    assert len(found) == 2 and sum("_part" in keys for keys in found) == 1


def test_lookup_join_is_broadcast(spark):
    assert "BroadcastHashJoin" in plan(contract.queries()["category_risk"](spark, SF))


def test_topk_needs_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan(contract.queries()["topk"](spark, SF))


def test_splits_of_large_tables_go_by_pieces(spark, split_limits):
    tx = src.transactions(spark, SF).select("tx_id", "is_fraud")
    split = prep.stratified_split(tx, "tx_id", "is_fraud", limits=split_limits)
    assert any("_part" in keys for keys in shuffles(plan(split)))


def test_statistics_aggregate_before_the_shuffle(spark):
    text = plan(ft.user_stats(src.transactions(spark, SF)))
    assert "partial_avg" in text and len(shuffles(text)) == 1


@pytest.mark.parametrize("name", sorted(set(contract.oracle_sql()) - {"map_items"}))
def test_no_python_in_sql_checkable_plans(spark, name):
    if name.startswith(("stream_", "ds_", "model_", "op6_")) or name in MODELS:
        pytest.skip("reads what a job has written, or fits a model")
    text = plan(contract.queries()[name](spark, SF))
    assert "Python" not in text and "InPandas" not in text


def test_no_single_task_window_over_the_table(spark, split_limits):
    from ambergrid.operators.pieces import with_row_number

    numbered = with_row_number(src.transactions(spark, SF).select("tx_id"), [], "tx_id", (), split_limits)
    text = plan(numbered)
    assert "Exchange hashpartitioning(_part" in text and "SinglePartition" not in text


def test_limits_choose_the_form(spark):
    tx = src.transactions(spark, SF)
    assert "BroadcastHashJoin" not in plan(ft.with_time_since_last(tx))
    assert "BroadcastHashJoin" in plan(ft.with_time_since_last(tx, Limits(0, 20)))
