"""Run table functions as steps and keep a row of evidence for each."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame

from ambergrid.operators.monitoring import RUN_SCHEMA
from ambergrid.registry import Registry


class StepLog:
    """Materialise the tables of one run step by step and append ``step_runs`` rows."""

    def __init__(self, registry: Registry, pipeline: str, run_id: str):
        self.registry = registry
        self.pipeline = pipeline
        self.run_id = run_id
        self.path = f"{registry.root}/step_runs"

    def run(self, step: str, function: Callable[..., DataFrame], *arguments) -> DataFrame:
        """The result of ``function(*arguments)``, stored as ``<step>_result``.

        A failure is logged with its error and raised again.
        """
        start = datetime.now(timezone.utc)
        error, rows = None, None
        try:
            result = self.registry.save_step_result(step, function(*arguments))
            rows = self.registry.find(f"{step}_result")["rows"]
            return result
        except Exception as failure:
            error = f"{type(failure).__name__}: {failure}"
            raise
        finally:
            end = datetime.now(timezone.utc)
            took = (end - start).total_seconds() * 1000
            row = (self.run_id, self.pipeline, step, 1, error is None, error, start, end, took, rows, None, None)
            spark = self.registry.spark
            spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def runs(self) -> DataFrame:
        return self.registry.spark.read.schema(RUN_SCHEMA).parquet(self.path)
