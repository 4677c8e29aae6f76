"""User profile that grows hour by hour: mergeable moments in versioned, bucketed tables.

A profile holds per user the number of rows, the last time, and the moments of the amounts
(count, mean, sum of squared deviations). Moments of two sets merge exactly pairwise, so an
hour needs the hour's rows and the stored moments of its users, never the history.

Users are dealt to a fixed number of buckets by hash. An hour reads and rewrites only the
buckets of its users; the others stay the files they are. A version is a small table that
names the folder of every bucket. It is written last and under a new number, so readers
see a whole version or the one before, a crash leaves the old one in use, and two writers of
the same number cannot both succeed. An hour carries a label that grows from hour to hour; one
that was merged before changes nothing, so replays are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ambergrid.functions.scalar import micros
from ambergrid.session import materialise
from ambergrid.streaming.common import for_each_batch

MOMENTS = "user_id long, last_us long, rows long, n long, mean double, m2 double"
VERSION = "bucket int, folder string, label string"


def moments_of(tx: DataFrame) -> DataFrame:
    """(user_id, last_us, rows, n, mean, m2) of transactions; rows without a user are left out.

    Partial sums meet in the shuffle, so a busy user costs one row per task. NULL
    amounts count as rows only.
    """
    amount = F.col("amount")
    return tx.filter("user_id IS NOT NULL").groupBy("user_id").agg(
        F.max(micros(F.col("ts"))).alias("last_us"),
        F.count(F.lit(1)).alias("rows"),
        F.count(amount).alias("n"),
        F.coalesce(F.avg(amount), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(amount) * F.count(amount), F.lit(0.0)).alias("m2"),
    )


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Moments of the users of both tables, merged pairwise."""
    both = old.withColumnsRenamed({c: f"old_{c}" for c in old.columns if c != "user_id"}).join(
        new.withColumnsRenamed({c: f"new_{c}" for c in new.columns if c != "user_id"}), "user_id", "full_outer"
    )

    def part(side: str, name: str) -> Column:
        return F.coalesce(F.col(f"{side}_{name}"), F.lit(0))

    n = part("old", "n") + part("new", "n")
    share = F.when(n > 0, part("new", "n") / n).otherwise(0.0)
    delta = part("new", "mean") - part("old", "mean")
    return both.select(
        "user_id",
        F.greatest("old_last_us", "new_last_us").alias("last_us"),
        (part("old", "rows") + part("new", "rows")).alias("rows"),
        n.alias("n"),
        F.when(part("old", "n") == 0, part("new", "mean")).otherwise(part("old", "mean") + delta * share).alias("mean"),
        F.when(part("old", "n") == 0, part("new", "m2"))
        .otherwise(part("old", "m2") + part("new", "m2") + delta * delta * part("old", "n") * share)
        .alias("m2"),
    )


class ProfileStore:
    """Versions of the profile under ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int")

    def newest(self) -> int:
        """Number of the newest whole version, 0 if there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/versions")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return 0
        found = [s.getPath() for s in files.listStatus(path)]
        whole = [p for p in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max((int(p.getName().removeprefix("v")) for p in whole), default=0)

    def version(self, number: int | None = None) -> dict[int, tuple[str, str]]:
        """bucket -> (folder, label of the last merge), at most ``buckets`` of them."""
        number = self.newest() if number is None else number
        if not number:
            return {}
        rows = self.spark.read.schema(VERSION).parquet(f"{self.root}/versions/v{number:012d}").collect()
        return {r["bucket"]: (r["folder"], r["label"]) for r in rows}

    def moments(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Stored moments, of some buckets only if they are given: only their folders are read."""
        known = self.version(number)
        folders = [folder for b, (folder, _) in known.items() if folder and (buckets is None or b in buckets)]
        reader = self.spark.read.schema(MOMENTS)
        return reader.parquet(*folders) if folders else self.spark.createDataFrame([], MOMENTS)

    def profile(self, number: int | None = None) -> DataFrame:
        """The profile with the columns of ``user_stats``."""
        several = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
        return self.moments(number).select(
            "user_id",
            F.when(F.col("n") > 0, F.col("mean")).alias("user_avg_amount"),
            several.alias("user_std_amount"),
            F.col("n").alias("user_amount_count"),
            F.col("rows").alias("user_transaction_count"),
        )

    def merge(self, tx: DataFrame, label: str) -> int:
        """Merge transactions under a label above all earlier ones; returns the newest version.

        A label that is not above the last one was merged before: nothing changes.
        """
        number = self.newest()
        known = self.version(number)
        if known and label <= max(done for _, done in known.values()):
            return number
        delta = materialise(moments_of(tx).withColumn("bucket", self._bucket()), "moments")
        touched = sorted(r["bucket"] for r in delta.select("bucket").distinct().collect())  # at most ``buckets``
        target = f"{self.root}/data/{label}-{number + 1:012d}"
        if touched:
            dealt = merged(self.moments(number, touched), delta.drop("bucket"))
            dealt = dealt.withColumn("bucket", self._bucket()).repartition(len(touched), "bucket")
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(target)
        rows = [(b, folder, label) for b, (folder, _) in known.items() if b not in touched]
        rows += [(b, f"{target}/bucket={b}", label) for b in touched] or ([] if rows else [(-1, None, label)])
        table = self.spark.createDataFrame(rows, VERSION).coalesce(1)
        table.write.mode("errorifexists").parquet(f"{self.root}/versions/v{number + 1:012d}")
        return number + 1


def profile_batches(tx: DataFrame, store: ProfileStore, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Merge a stream of transactions, a micro-batch at a time; a replayed one changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        store.merge(batch, f"{batch_id:012d}")

    return for_each_batch(tx, write, checkpoint, every)
