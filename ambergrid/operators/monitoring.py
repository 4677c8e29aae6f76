"""Roll-ups of step runs: status, latency, errors, metrics and cost."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambergrid.functions.scalar import duration_ms
from ambergrid.operators.pieces import null_safe_join
from ambergrid.operators.quantile import grouped_quantile
from ambergrid.session import DEFAULT_LIMITS, Limits

RUN_SCHEMA = (
    "run_id string, pipeline string, step string, attempt int, success boolean, error string, "
    "start_ts timestamp, end_ts timestamp, duration_ms double, rows long, memory_mb int, gpu boolean"
)

# Fixed values of the cost model, in USD.
COST_PER_GB_SECOND = 0.0000166667
COST_PER_REQUEST = 0.0000002
COST_PER_1000_TRANSITIONS = 0.025
TRANSITIONS_PER_STEP = 2
STORAGE_COST = 5.0
LOG_COST = 3.0
DEFAULT_STEP_SECONDS = 10.0


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run_id").agg(
        F.count_if("success").alias("successful"),
        F.count(F.lit(1)).alias("total"),
        F.every("success").alias("success"),
    )


def pipeline_status(runs: DataFrame) -> DataFrame:
    return runs.groupBy("pipeline").agg(
        F.max("start_ts").alias("last_run"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("duration_ms").alias("avg_duration_ms"),
    )


def step_status(runs: DataFrame) -> DataFrame:
    """Average duration and number of runs per pipeline, step and day."""
    return runs.groupBy("pipeline", "step", F.to_date("start_ts").alias("day")).agg(
        F.avg("duration_ms").alias("avg_duration_ms"), F.count(F.lit(1)).alias("runs")
    )


def step_success(runs: DataFrame) -> DataFrame:
    return runs.groupBy("step").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if("success").alias("successes"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
    )


@dataclass(frozen=True)
class AlertRule:
    """Alert on a step when it is slower than ``latency`` ('500ms', '10s', ...) or fails."""

    step: str
    latency: str | None = None
    on_error: bool = True


def rules_table(runs: DataFrame, rules: Sequence[AlertRule]) -> DataFrame:
    rows = [(r.step, r.latency, r.on_error) for r in rules]
    return (
        runs.sparkSession.createDataFrame(rows, "step string, latency string, on_error boolean")
        .withColumn("limit_ms", duration_ms(F.col("latency")))
        .drop("latency")
    )


def latency_alerts(runs: DataFrame, rules: Sequence[AlertRule]) -> DataFrame:
    """Runs that break the rule of their step. The rules come from the caller, so they are few."""
    joined = runs.join(F.broadcast(rules_table(runs, rules)), "step")
    slow = F.coalesce(F.col("duration_ms") > F.col("limit_ms"), F.lit(False))
    failed = F.col("on_error") & ~F.col("success")
    return joined.withColumns({"slow": slow, "failed": failed}).filter("slow OR failed")


def metric_stats(
    runs: DataFrame, period: str = "1 hour", p: float = 0.99, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Sum, average and p99 of the duration, with runs and errors, per period and step."""
    start = F.window(F.col("start_ts"), period)["start"]
    keyed = runs.select(start.alias("period"), "step", "duration_ms", "success")
    totals = keyed.groupBy("period", "step").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(~F.col("success")).alias("errors"),
        F.sum("duration_ms").alias("sum_ms"),
        F.avg("duration_ms").alias("avg_ms"),
    )
    tails = grouped_quantile(keyed, ["period", "step"], "duration_ms", p, "p99_ms", limits)
    return null_safe_join(totals, tails, ["period", "step"], "left")


def resource_totals(runs: DataFrame) -> DataFrame:
    """Memory, GPU need and number of distinct steps per pipeline."""
    steps = runs.groupBy("pipeline", "step").agg(
        F.max("memory_mb").alias("memory_mb"), F.bool_or("gpu").alias("gpu")
    )
    return steps.groupBy("pipeline").agg(
        F.sum("memory_mb").alias("total_memory_mb"),
        F.bool_or("gpu").alias("uses_gpu"),
        F.count(F.lit(1)).alias("steps"),
    )


def run_cost(runs: DataFrame) -> DataFrame:
    """Cost per pipeline from real durations; unknown durations count 10 seconds."""
    seconds = F.coalesce(F.col("duration_ms") / 1000, F.lit(DEFAULT_STEP_SECONDS))
    sums = runs.groupBy("pipeline").agg(
        F.sum(F.col("memory_mb") / 1024 * seconds).alias("gb_seconds"),
        F.count(F.lit(1)).alias("step_runs"),
    )
    parts: dict[str, Column] = {
        "compute": F.col("gb_seconds") * COST_PER_GB_SECOND,
        "requests": F.col("step_runs") * COST_PER_REQUEST,
        "transitions": F.col("step_runs") * TRANSITIONS_PER_STEP / 1000 * COST_PER_1000_TRANSITIONS,
        "storage": F.lit(STORAGE_COST),
        "logs": F.lit(LOG_COST),
    }
    total = sum(list(parts.values())[1:], parts["compute"])
    return sums.select(
        "pipeline",
        "step_runs",
        *[F.round(v, 2).alias(k) for k, v in parts.items()],
        F.round(total, 2).alias("total"),
    )


def step_errors(runs: DataFrame) -> DataFrame:
    return runs.filter(~F.col("success")).select("run_id", "pipeline", "step", "error", F.col("start_ts").alias("ts"))


def search_log(
    log: DataFrame,
    since: Column | None = None,
    limit: int = 100,
    order: Sequence[str] = ("start_ts", "seq"),
    **equals: str,
) -> DataFrame:
    """The last ``limit`` lines that match, newest first (no full sort)."""
    for column, value in equals.items():
        if value is not None:
            log = log.filter(F.col(column) == value)
    if since is not None:
        log = log.filter(F.col(order[0]) >= since)
    return log.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def metrics_long(df: DataFrame, ids: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per metric: ids..., ``metric``, ``value``."""
    wide = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in measures])
    return wide.unpivot(list(ids), list(measures), "metric", "value")


def to_log_lines(df: DataFrame, ts: Column, level: Column, message: Column, **fields: Column) -> DataFrame:
    """Structured JSON log lines in a column ``value``; free fields sit beside the fixed ones."""
    line = F.struct(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        level.alias("level"),
        message.alias("message"),
        *[v.alias(k) for k, v in fields.items()],
    )
    return df.select(F.to_json(line).alias("value"))


def parse_log_lines(lines: DataFrame, field_types: dict[str, str]) -> DataFrame:
    schema = "timestamp timestamp_ntz, level string, message string" + "".join(
        f", {name} {kind}" for name, kind in field_types.items()
    )
    return lines.select(F.from_json("value", schema).alias("j")).select("j.*")
