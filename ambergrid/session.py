"""Session set-up, shared work folder and size checks."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

_local_dirs: dict[str, str] = {}


@dataclass(frozen=True)
class Limits:
    """Sizes that decide when an operator takes its plain or its split form.

    ``small_bytes``: input whose estimated size is below this can go through a
    plain window, because even one group holding all of it fits one task.
    ``hot_rows``: a key with more rows than this is split into ranges of about
    as many rows, so n rows have at most n / hot_rows hot keys and ranges.
    """

    small_bytes: int = 64 << 20
    hot_rows: int = 1_000_000


DEFAULT_LIMITS = Limits()


def build_session(app: str = "ambergrid", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume (UTC, ANSI, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/") + "/ambergrid"
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="ambergrid-")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path for one written table under the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str, spread: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with files that outlive an executor, and lets several
    consumers share one computation. With ``spread`` a result of few files is
    written again in one file per core, for model fitting and Python stages;
    larger results are left alone.
    """
    spark = df.sparkSession

    def store(rows: DataFrame) -> DataFrame:
        path = scratch_path(spark, tag)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    written = store(df)
    cores = spark.sparkContext.defaultParallelism
    if spread and written.rdd.getNumPartitions() < cores and plan_bytes(written) < cores << 27:
        return store(written.repartition(cores))
    return written


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the result; starts no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def row_bytes(df: DataFrame) -> int:
    """Bytes that Spark assumes for one row in memory."""
    return 8 + sum(_width(f.dataType) for f in df.schema.fields)


def _width(kind: DataType) -> int:
    if isinstance(kind, (StringType, BinaryType)):
        return 20
    if isinstance(kind, (ArrayType, MapType)):
        return 100
    if isinstance(kind, StructType):
        return sum(_width(f.dataType) for f in kind.fields)
    return 8


def is_small(df: DataFrame, limits: Limits) -> bool:
    """Whether all rows fit one task: by their counted number, as files may be packed tightly."""
    if plan_bytes(df) > limits.small_bytes:
        return False
    most = limits.small_bytes // row_bytes(df)
    known = df.__dict__.setdefault("_ambergrid_small", {})  # one count per table and limit
    if most not in known:
        counted = df.limit(most + 1) if most < 1 << 30 else df
        known[most] = counted.count() <= most
    return known[most]
