"""Named, versioned tables and models under one folder, described by a registry table.

A save writes a new version first and appends its registry row afterwards, so a
failed write is never visible and a path being read is never overwritten. The
newest row of a key is its state; a deletion is a row too.
"""

from __future__ import annotations

import hashlib
import json
import time
import zlib
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.ml import PipelineModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ENTRY_SCHEMA = (
    "key string, run_id string, kind string, deleted boolean, path string, format string, "
    "saved_at timestamp, rows long, size_bytes long, schema string, columns array<string>, "
    "metadata map<string,string>"
)
#: Folders of the log, by hash of the key: looking a key up reads one of them. Spark lists up to 32 without a job.
BUCKETS = 32
#: Modules whose models may be loaded beside those of Spark ML.
LOADABLE = ("ambergrid.models.isolation",)
MODEL_PREFIX = "models/"
TABLE_PREFIX = "dataframes/"


def _bucket(key: str) -> int:
    """Folder of the log that holds a key's entries."""
    return zlib.crc32(key.encode()) % BUCKETS


def latest_entries(entries: DataFrame) -> DataFrame:
    """The newest entry per key, tombstones included. One partially aggregated shuffle."""
    newest = F.max_by(F.struct(*entries.columns), F.struct("saved_at", "run_id"))
    return entries.groupBy(F.col("key").alias("_k")).agg(newest.alias("e")).select("e.*")


def list_keys(entries: DataFrame, prefix: str | None = None) -> DataFrame:
    """Sorted keys that exist, optionally only those starting with a prefix."""
    if prefix:
        entries = entries.filter(F.col("key").startswith(prefix))
    return latest_entries(entries).filter(~F.col("deleted")).select("key").orderBy("key")


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._log = f"{self.root}/_registry"

    # -- entries ---------------------------------------------------------

    def entries(self, key: str | None = None) -> DataFrame:
        """Every save and deletion so far; with a key those of its bucket, the only files read then."""
        folder = self._folder()
        if key is not None:
            folder = f"{folder}/bucket={_bucket(key)}"
        if not self._there(folder):
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        return self.spark.read.schema(ENTRY_SCHEMA).option("recursiveFileLookup", True).parquet(folder)

    def _folder(self) -> str:
        """The folder of the log: the one that the newest pointer names, if there is one."""
        if not self._there(f"{self._log}_pointer"):
            return self._log
        newest = self.spark.read.schema("path string, at long").parquet(f"{self._log}_pointer")
        return newest.orderBy(F.desc("at")).first()["path"]

    def _there(self, path: str) -> bool:
        name = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return name.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(name)

    def _append(self, rows: Sequence[Mapping]) -> None:
        names = [part.split()[0] for part in ENTRY_SCHEMA.replace("map<string,string>", "map").split(", ")]
        data = [(*[row.get(n) for n in names], _bucket(row["key"])) for row in rows]
        entries = self.spark.createDataFrame(data, f"{ENTRY_SCHEMA}, bucket int")
        entries.coalesce(1).write.mode("append").partitionBy("bucket").parquet(self._folder())

    def compact(self) -> None:
        """Gather the small files of the log in a new folder, all versions and tombstones included.

        The pointer moves after the folder is complete, so a crash leaves the old log in
        use. Not for use while others write.
        """
        now = time.time_ns()
        fresh = f"{self._log}-{now}"
        dealt = self.entries().withColumn("bucket", (F.crc32(F.encode("key", "UTF-8")) % BUCKETS).cast("int"))
        dealt.repartition("bucket").write.partitionBy("bucket").parquet(fresh)
        pointer = self.spark.createDataFrame([(fresh, now)], "path string, at long")
        pointer.coalesce(1).write.mode("append").parquet(f"{self._log}_pointer")

    def _entry(self, key: str, kind: str, run_id: str, **fields) -> dict:
        metadata = {k: str(v) for k, v in (fields.pop("metadata", None) or {}).items()}
        return {
            "key": key,
            "kind": kind,
            "run_id": run_id,
            "deleted": False,
            "saved_at": datetime.now(timezone.utc),
            "metadata": metadata,
            **fields,
        }

    def _new_path(self, key: str) -> tuple[str, str]:
        run_id = f"{time.time_ns():020d}"
        folder = hashlib.sha256(key.encode()).hexdigest()
        return run_id, f"{self.root}/data/{folder}/v={run_id}"

    def _bytes_under(self, path: str) -> int:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()["b"]

    def find(self, key: str) -> dict:
        """The entry of an existing key."""
        row = latest_entries(self.entries(key).filter(F.col("key") == key)).first()
        if row is None or row["deleted"]:
            raise KeyError(f"Key not found: {key}")
        return row.asDict()

    def exists(self, key: str) -> bool:
        try:
            self.find(key)
            return True
        except KeyError:
            return False

    def delete(self, key: str) -> bool:
        """Mark a key as deleted; False when it does not exist."""
        if not self.exists(key):
            return False
        run_id, _ = self._new_path(key)
        self._append([{**self._entry(key, "tombstone", run_id), "deleted": True}])
        return True

    def keys(self, prefix: str | None = None) -> list[str]:
        return [row["key"] for row in list_keys(self.entries(), prefix).collect()]

    # -- tables ----------------------------------------------------------

    def save(
        self,
        key: str,
        df: DataFrame,
        metadata: Mapping | None = None,
        format: str = "parquet",
        kind: str = "table",
    ) -> str:
        """Write a new version of a table; its row count is observed during the write."""
        run_id, path = self._new_path(key)
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format(format).save(path)
        entry = self._entry(
            key,
            kind,
            run_id,
            path=path,
            format=format,
            rows=seen.get["rows"],
            size_bytes=self._bytes_under(path),
            schema=df.schema.json(),
            columns=df.columns,
            metadata=metadata,
        )
        self._append([entry])
        return path

    def load(self, key: str) -> DataFrame:
        entry = self.find(key)
        reader = self.spark.read.format(entry["format"])
        return reader.schema(_schema_of(entry["schema"])).load(entry["path"])

    def save_dataframe(self, df: DataFrame, name: str, format: str = "parquet") -> str:
        return self.save(TABLE_PREFIX + name, df, {"format": format}, format)

    def load_dataframe(self, name: str) -> DataFrame:
        return self.load(TABLE_PREFIX + name)

    def save_step_result(self, step: str, df: DataFrame) -> DataFrame:
        """Materialise a step's table as ``<step>_result`` and continue from the files."""
        key = f"{step}_result"
        self.save(key, df, {"step": step}, kind="step_result")
        return self.load(key)

    # -- column lists ----------------------------------------------------

    def save_columns(self, key: str, columns: Sequence[str]) -> None:
        run_id, _ = self._new_path(key)
        self._append([self._entry(key, "columns", run_id, columns=list(columns))])

    def load_columns(self, key: str) -> list[str]:
        return list(self.find(key)["columns"])

    # -- models ----------------------------------------------------------

    def save_model(self, model, name: str, metadata: Mapping | None = None) -> str:
        """Save a Spark ML model (or any object with ``save``/``load``) with its description."""
        key = MODEL_PREFIX + name
        run_id, path = self._new_path(key)
        if hasattr(model, "write"):
            model.write().save(path)
        else:
            model.save(self.spark, path)
        entry = self._entry(
            key,
            "model",
            run_id,
            path=path,
            format=f"{type(model).__module__}.{type(model).__name__}",
            size_bytes=self._bytes_under(path),
            metadata={**describe_model(model), **(metadata or {})},
        )
        self._append([entry])
        return path

    def load_model(self, name: str):
        entry = self.find(MODEL_PREFIX + name)
        if entry["format"].startswith("pyspark.ml."):
            if entry["format"].endswith(".PipelineModel"):
                return PipelineModel.load(entry["path"])
            return DefaultParamsReader.loadParamsInstance(entry["path"], self.spark)
        module, _, kind = entry["format"].rpartition(".")
        if module not in LOADABLE:
            raise ValueError(f"no model of a known kind: {entry['format']}")
        return getattr(__import__(module, fromlist=[kind]), kind).load(self.spark, entry["path"])

    def list_models(self) -> list[str]:
        return [k.removeprefix(MODEL_PREFIX) for k in self.keys(MODEL_PREFIX)]

    def delete_model(self, name: str) -> bool:
        return self.delete(MODEL_PREFIX + name)


def _schema_of(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(text))


def describe_model(model) -> dict[str, str]:
    """Type, module and parameters; for a PipelineModel those of every stage."""
    found = {"model_type": type(model).__name__, "model_module": type(model).__module__}
    for i, stage in enumerate(getattr(model, "stages", [model])):
        if hasattr(stage, "extractParamMap"):
            values = {p.name: str(v) for p, v in stage.extractParamMap().items()}
        else:
            values = {k: str(v) for k, v in getattr(stage, "params", {}).items()}
        prefix = f"{i}.{type(stage).__name__}." if hasattr(model, "stages") else "param."
        found.update({prefix + k: v for k, v in values.items()})
    return found
