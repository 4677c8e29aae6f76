import json
import time

import pytest
from pyspark.sql import functions as F

from ambergrid.operators.monitoring import run_summary
from ambergrid.plans.steplog import StepLog
from ambergrid.registry import Registry
from ambergrid.session import shared_dir
from ambergrid.sinks import append_alerts, append_metrics, write_report


@pytest.fixture
def registry(spark, tmp_path):
    return Registry(spark, str(tmp_path / "store"))


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(1, 4.0), (2, 5.0), (3, 6.0)], "col1 int, col2 double")


def test_save_and_load(registry, small):
    registry.save_dataframe(small, "t")
    assert sorted(registry.load_dataframe("t").collect()) == sorted(small.collect())


@pytest.mark.parametrize("form", ["parquet", "json", "orc", "csv"])
def test_formats(registry, small, form):
    registry.save_dataframe(small, "t", form)
    assert sorted(registry.load_dataframe("t").collect()) == sorted(small.collect())
    assert registry.find("dataframes/t")["metadata"] == {"format": form}


def test_missing_key_is_named(registry):
    with pytest.raises(KeyError, match="nothing/here"):
        registry.load("nothing/here")


def test_overwrite_while_reading(registry, small):
    registry.save("t", small)
    registry.save("t", registry.load("t").withColumn("col2", F.col("col2") * 2))
    assert registry.load("t").agg(F.sum("col2")).first()[0] == 30.0
    assert registry.entries().filter("key = 't'").count() == 2


def test_metadata(registry, small):
    registry.save("t", small, {"accuracy": 0.95, "tag": "a"})
    entry = registry.find("t")
    assert entry["rows"] == 3 and entry["size_bytes"] > 0 and entry["saved_at"] is not None
    assert entry["metadata"] == {"accuracy": "0.95", "tag": "a"}
    assert entry["columns"] == ["col1", "col2"]
    assert [f["name"] for f in json.loads(entry["schema"])["fields"]] == ["col1", "col2"]


def test_exists_delete_list(registry, small):
    for key in ("item1", "item2", "prefix_item3", "prefix_item4"):
        registry.save(key, small)
    assert registry.keys() == ["item1", "item2", "prefix_item3", "prefix_item4"]
    assert registry.keys("prefix_") == ["prefix_item3", "prefix_item4"]
    assert registry.delete("item1") and not registry.delete("item1") and not registry.delete("unknown")
    assert not registry.exists("item1") and registry.exists("item2")
    registry.save("item1", small)
    assert registry.exists("item1")


def test_similar_keys_do_not_collide(registry, small):
    registry.save("a/b", small)
    registry.save("a_b", small.limit(1))
    assert registry.load("a/b").count() == 3 and registry.load("a_b").count() == 1


def test_empty_store(registry):
    assert registry.keys() == [] and not registry.exists("x") and registry.list_models() == []


def test_empty_table(registry, small):
    registry.save("none", small.filter("false"))
    assert registry.load("none").count() == 0 and registry.find("none")["rows"] == 0


def test_compaction_keeps_all_versions(registry, small):
    for _ in range(3):
        registry.save("t", small)
    registry.save("gone", small)
    registry.delete("gone")
    before = sorted(tuple(r)[:4] for r in registry.entries().collect())
    for _ in range(2):
        registry.compact()
        assert sorted(tuple(r)[:4] for r in registry.entries().collect()) == before
    assert registry.keys() == ["t"] and registry.load("t").count() == 3
    registry.save("more", small)
    assert registry.keys() == ["more", "t"]


def test_listing_a_thousand_keys_is_quick(registry):
    run, _ = registry._new_path("k")
    registry._append([registry._entry(f"key{i:04d}", "table", run) for i in range(1000)])
    registry.keys("key")
    start = time.perf_counter()
    assert len(registry.keys("key")) == 1000
    assert time.perf_counter() - start < 1.0


def test_step_results(registry, small):
    result = registry.save_step_result("load", small)
    assert result.count() == 3 and registry.keys() == ["load_result"]
    assert registry.find("load_result")["rows"] == 3


def test_column_lists_keep_their_order(registry):
    registry.save_columns("features", ["b", "a", "c"])
    assert registry.load_columns("features") == ["b", "a", "c"]


def test_alert_sink_is_gated_and_repeatable(spark, tmp_path):
    rows = [("CRITICAL", 1), ("WARNING", 2), ("CRITICAL", 3)]
    found = spark.createDataFrame(rows, "level string, tx_id long")
    seen = []
    for _ in range(2):
        assert append_alerts(found, str(tmp_path / "alerts"), "r1", seen.append) == 2
    assert append_alerts(found.filter("level = 'WARNING'"), str(tmp_path / "alerts"), "r2", seen.append) == 0
    assert seen == [2, 2]
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 4


def test_report_and_metrics(spark, tmp_path):
    write_report(spark.sql("select 1 as a, struct(2 as b) as c"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).select("a", "c.b").first() == (1, 2)
    metrics = spark.sql("select 's' as step, 'm' as metric, 1.5D as value")
    append_metrics(metrics, str(tmp_path / "metrics"))
    append_metrics(metrics, str(tmp_path / "metrics"), "prod", "Milliseconds")
    assert spark.read.parquet(str(tmp_path / "metrics")).filter("unit = 'Milliseconds' and stage = 'prod'").count() == 1


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_step_log_keeps_successes_and_failures(registry, small):
    log = StepLog(registry, "p", "r1")
    doubled = log.run("load", lambda: small)
    log.run("double", lambda df: df.withColumn("col2", F.col("col2") * 2), doubled)
    with pytest.raises(Exception, match="nope"):
        log.run("fail", lambda df: df.select(F.raise_error(F.lit("nope"))), doubled)
    rows = {r["step"]: r for r in log.runs().collect()}
    assert rows["load"]["rows"] == rows["double"]["rows"] == 3 and rows["double"]["success"]
    assert not rows["fail"]["success"] and "nope" in rows["fail"]["error"] and rows["fail"]["rows"] is None
    assert registry.load("double_result").agg(F.sum("col2")).first()[0] == 30.0
    assert tuple(run_summary(log.runs()).first()) == ("r1", 2, 3, False)


def test_finding_a_key_reads_few_files(registry, spark):
    """10,000 entries: a key's bucket is read, not the whole log; compaction keeps the answer."""
    for part in range(5):
        registry._append([{**registry._entry(f"key{k}", "columns", f"{part}"), "columns": [str(part)]} for k in range(part, 10_000, 5)])
    assert registry.entries().count() == 10_000
    files = registry.entries("key777").inputFiles()
    assert 0 < len(files) <= 12
    assert registry.find("key777")["columns"] == ["2"]
    with pytest.raises(KeyError):
        registry.find("key10001")
    registry.compact()
    assert len(registry.entries("key777").inputFiles()) == 1
    assert registry.find("key777")["columns"] == ["2"] and registry.entries().count() == 10_000


def test_two_writers_lose_nothing(registry, spark, small):
    other = Registry(spark, registry.root)
    for k in range(3):
        registry.save_columns("mine", [str(k)])
        other.save_columns("theirs", [str(k)])
        other.save_columns("mine", [f"other{k}"])
    assert registry.entries().count() == 9
    assert registry.load_columns("mine") == ["other2"] and registry.load_columns("theirs") == ["2"]
