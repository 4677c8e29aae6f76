"""Append-only output tables and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def append_alerts(
    found: DataFrame,
    path: str,
    run_id: str,
    on_critical: Callable[[int], None] | None = None,
) -> int:
    """Write a run's alerts to its own partition; returns the number of critical ones.

    The counts come from the write itself. Writing a run again replaces it.
    """
    seen = Observation()
    counted = found.observe(seen, F.count_if(F.col("level") == "CRITICAL").alias("critical"))
    counted.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")
    critical = seen.get["critical"]
    if critical and on_critical:
        on_critical(critical)
    return critical


def write_report(report: DataFrame, path: str) -> None:
    """The one-row nested report as a JSON document."""
    report.coalesce(1).write.json(path)


def append_metrics(metrics: DataFrame, path: str, stage: str = "dev", unit: str = "Count") -> None:
    """Long metric rows (…, metric, value) with their unit and stage."""
    metrics.withColumns({"unit": F.lit(unit), "stage": F.lit(stage)}).write.mode("append").parquet(path)
