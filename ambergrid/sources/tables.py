"""Scans and the table views the operators work on."""

from __future__ import annotations

from datetime import date as Date
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of a transaction table.
TX_SCHEMA = (
    "tx_id long, user_id long, merchant_id long, ts timestamp_ntz, amount double, "
    "category string, channel string, is_fraud int"
)

#: External transaction records (fixed names) and their names here.
RECORD_COLUMNS = {
    "transaction_id": "tx_id",
    "user_id": "user_id",
    "merchant_id": "merchant_id",
    "amount": "amount",
    "timestamp": "ts",
    "merchant_category": "category",
    "payment_method": "channel",
    "is_fraud": "is_fraud",
}

EVENT_SCHEMA = (
    "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
)

#: Payment channels, in the order used for the events view.
CHANNELS = ["credit_card", "debit_card", "mobile_payment"]


def read_parquet(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


#: Types a CSV column can have, from narrow to wide, and the texts they are written as. A text may
#: fit several; a column has the first type that all its texts fit, and is a string otherwise.
_WHOLE = r"[+-]?[0-9]{1,19}"
_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_TIME = rf"{_DAY}[ T][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]{{1,6}})?)?"
CSV_TYPES = [
    ("boolean", r"(?i)true|false"),
    ("bigint", _WHOLE),
    ("double", rf"{_WHOLE}|[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|NaN|[+-]?Infinity"),
    ("date", _DAY),
    ("timestamp_ntz", rf"{_DAY}|{_TIME}"),
    ("timestamp", rf"{_DAY}|{_TIME}(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?"),
]


def csv_types(texts: DataFrame) -> dict[str, str]:
    """Type of every column of texts, by one aggregate over them.

    Each text gives a set of types it can be read as, one bit per type. The sets of a column
    are intersected, so partial results merge in any order. Columns without any text are strings.
    """

    def fits(name: str) -> Column:
        value = F.col(f"`{name}`")
        bits = F.lit(0)
        for k, (kind, pattern) in enumerate(CSV_TYPES):
            good = value.rlike(f"^({pattern})$") & value.try_cast(kind).isNotNull()
            bits = bits + F.when(good, F.lit(1 << k)).otherwise(F.lit(0))
        return F.bit_and(F.when(value.isNotNull(), bits))

    if not texts.columns:
        return {}
    found = texts.agg(*[fits(name).alias(f"c{k}") for k, name in enumerate(texts.columns)]).first()
    kinds = [kind for kind, _ in CSV_TYPES]
    return {
        name: kinds[(bits & -bits).bit_length() - 1] if bits else "string" for name, bits in zip(texts.columns, found)
    }


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None, **options: str) -> DataFrame:
    """CSV with a header row. Without a schema the types are found in an extra pass over all rows.

    Short rows have NULLs at their end, surplus fields are left out, empty fields are NULL.
    """
    reader = spark.read.options(header="true", **options)
    if schema is not None:
        return reader.schema(schema).csv(path)
    texts = reader.csv(path)
    return texts.select(*[F.col(f"`{name}`").try_cast(kind).alias(name) for name, kind in csv_types(texts).items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_records(df: DataFrame) -> DataFrame:
    """Rename external transaction records to the columns used here."""
    return df.select(
        *[F.col(old).alias(new) for old, new in RECORD_COLUMNS.items() if old in df.columns]
    )


def channel_of(event_id: Column) -> Column:
    slot = F.pmod(event_id, F.lit(len(CHANNELS)))
    chain = F.when(slot == 0, CHANNELS[0])
    for i, name in enumerate(CHANNELS[1:], 1):
        chain = chain.when(slot == i, name)
    return chain


def events_as_transactions(events: DataFrame) -> DataFrame:
    """Transactions over an ``events`` table; about 2 % are labelled as fraud."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("tx_id"),
        "user_id",
        "ts",
        F.col("value").alias("amount"),
        F.col("event_type").alias("category"),
        channel_of(F.col("event_id")).alias("channel"),
        F.coalesce(k < 2, F.lit(False)).cast("int").alias("is_fraud"),
    )


def events_as_runs(events: DataFrame) -> DataFrame:
    """Step runs over an ``events`` table, for the monitoring queries."""
    success = (F.col("event_type") != "error") | (F.col("value") < 50)
    memory = (
        F.when(F.col("event_type") == "purchase", 2048)
        .when(F.col("event_type") == "signup", 1024)
        .otherwise(512)
    )
    return events.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.concat(F.lit("p"), F.pmod("user_id", F.lit(3))).alias("pipeline"),
        F.col("event_type").alias("step"),
        success.alias("success"),
        F.when(~success, F.format_string("step %s failed", "event_type")).alias("error"),
        F.col("ts").alias("start_ts"),
        (F.col("value") * 1000).alias("duration_ms"),
        memory.alias("memory_mb"),
        (F.col("event_type") == "purchase").alias("gpu"),
        F.col("event_id").alias("seq"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_transactions(table(spark, sf_dir, "events"))


def step_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_runs(table(spark, sf_dir, "events"))


def load_day(tx: DataFrame, day: str | Date | None = None) -> DataFrame:
    """Transactions of one day (today when not given), as a range the scan can prune by."""
    day = str(day or Date.today())
    start = F.lit(day).cast("date").cast("timestamp_ntz")
    found = tx.filter((F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY")))
    return found.filter(F.col("dt") == F.lit(day).cast("date")) if "dt" in tx.columns else found


def load_last_hour(tx: DataFrame, as_of: str | datetime | None = None) -> DataFrame:
    """Transactions of the last full hour before ``as_of`` (now when not given)."""
    as_of = str(as_of or datetime.now())
    end = F.date_trunc("HOUR", F.lit(as_of).cast("timestamp_ntz")).cast("timestamp_ntz")
    start = end - F.expr("INTERVAL 1 HOUR")
    found = tx.filter((F.col("ts") >= start) & (F.col("ts") < end))
    # the hour before midnight lies in the day before, so the folder is that of its start
    return found.filter(F.col("dt") == start.cast("date")) if "dt" in tx.columns else found


def write_by_day(tx: DataFrame, path: str) -> None:
    """Write transactions partitioned by day, so that a day or hour load reads one folder."""
    tx.withColumn("dt", F.to_date("ts")).write.partitionBy("dt").parquet(path)
