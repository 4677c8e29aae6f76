"""What is known of every user of a stream, kept in keyed state and read where rows are scored.

For every user the state holds the time of the last transaction and the moments of the amounts
(count, mean, sum of squared deviations), in one value for all users of a bucket. A micro-batch's rows of a user are put in time
order; each gets the gap to its predecessor and the statistics up to and including itself,
whether the predecessor came in this micro-batch or long ago. The trigger limit of the source
bounds what a busy user brings at once.

A row older than the state's time cannot know its predecessor any more: its gap is NULL and
it does not move the time back; its amount counts; so does that of a row without a time. Rows without a user have no history and
pass through without state. Amounts that are NULL or not a number count as transactions only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import AtomicType

from ambergrid.functions.scalar import micros

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State keys. A call of the processor costs milliseconds whatever it is given, so users share keys by hash;
#: a key's value grows with its users (48 bytes each). Streams must keep the number they began with.
BUCKETS = 4096
#: Arrays of a bucket's state. The last time of a user without any is _NEVER.
_KINDS = {"users": np.int64, "last": np.int64, "rows": np.int64, "n": np.int64, "mean": np.float64, "m2": np.float64}
_NEVER = -(2**63)
_STATE = ", ".join(f"{name} binary" for name in _KINDS)
_KNOWN = "gap double, seen_rows long, seen long, mean double, m2 double"


def merge_moments(n, mean, m2, more_n, more_mean, more_m2):
    """Moments of two sets of values together; counts may be zero."""
    total = n + more_n
    share = more_n / np.maximum(total, 1)
    delta = more_mean - mean
    return total, mean + delta * share, m2 + more_m2 + delta * delta * n * share


def running_moments(values: np.ndarray, n: int, mean: float, m2: float):
    """Moments after each of the values (NaN counts as unknown), begun with earlier ones."""
    known = ~np.isnan(values)
    centre = mean if n else (values[known][0] if known.any() else 0.0)
    off = np.where(known, values - centre, 0.0)
    count = np.cumsum(known)
    one, two = np.cumsum(off), np.cumsum(off * off)
    few = np.maximum(count, 1)
    return merge_moments(n, mean, m2, count, centre + one / few, np.maximum(two - one * one / few, 0.0))


class Known:
    """What is known of a bucket's users, as arrays: they are read and written as one value."""

    def __init__(self, stored: tuple | None) -> None:
        arrays = [np.frombuffer(x, kind).copy() for x, kind in zip(stored or [b""] * len(_KINDS), _KINDS.values())]
        self.columns = dict(zip(_KINDS, arrays))
        self.at = {user: k for k, user in enumerate(self.columns["users"].tolist())}

    def add(self, users: np.ndarray) -> None:
        """Room for users that are not known yet."""
        new = [user for user in np.unique(users).tolist() if user not in self.at]
        self.at |= {user: len(self.at) + k for k, user in enumerate(new)}
        for name, kind in _KINDS.items():
            values = new if name == "users" else np.full(len(new), _NEVER if name == "last" else 0, kind)
            self.columns[name] = np.concatenate([self.columns[name], np.array(values, kind)])

    def stored(self) -> tuple:
        return tuple(x.tobytes() for x in self.columns.values())


def _advance(known: Known, user: int, at: np.ndarray, dated: np.ndarray, spent: np.ndarray) -> tuple:
    """One user's rows in time order: their gaps and running statistics; the state goes on."""
    k, state = known.at[user], known.columns
    last, before = int(state["last"][k]), int(state["rows"][k])
    fresh = dated & (at >= last)
    gap = np.full(len(at), np.nan)
    new = at[fresh]
    if len(new):
        first = np.nan if last == _NEVER else (new[0] - last) / 1e6
        gap[fresh] = np.concatenate([[first], np.diff(new) / 1e6])
        state["last"][k] = new[-1]
    moments = running_moments(spent, int(state["n"][k]), float(state["mean"][k]), float(state["m2"][k]))
    for name, values in zip(("n", "mean", "m2"), moments):
        state[name][k] = values[-1]
    state["rows"][k] = before + len(at)
    return gap, before + np.arange(1, len(at) + 1), *moments


class UserHistory(StatefulProcessor):
    """Last times and moments of the amounts of a bucket's users.

    Names of the frames do not begin with an underscore: pandas would rename them.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("history", _STATE)

    def _known(self) -> Known:
        return Known(self.kept.get() if self.kept.exists() else None)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        known, state = self._known(), initialState
        known.add(state["user_id"].to_numpy(np.int64))
        at = [known.at[user] for user in state["user_id"].tolist()]
        for name, column in {"last": "last_us", "rows": "rows", "n": "n", "mean": "mean", "m2": "m2"}.items():
            values = state[column].fillna(_NEVER if name == "last" else 0)
            known.columns[name][at] = values.to_numpy(_KINDS[name])
        self.kept.update(known.stored())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        ids, tx, at = (batch[c].to_numpy(np.int64) for c in ("user_id", "tx_id", "at_us"))
        dated, keyed = (batch[c].to_numpy(bool) for c in ("dated", "keyed"))
        order = np.lexsort((tx, ~keyed, at, ~dated, ids))  # times and keys that are unknown come last
        batch, ids, at, dated = batch.iloc[order], ids[order], at[order], dated[order]
        spent = batch["spent"].to_numpy(float)
        known = self._known()
        known.add(ids)
        edges = [0, *(np.flatnonzero(np.diff(ids)) + 1), len(ids)]
        found = [_advance(known, int(ids[a]), at[a:b], dated[a:b], spent[a:b]) for a, b in zip(edges, edges[1:])]
        self.kept.update(known.stored())
        gap, rows_seen, seen, mean, m2 = (np.concatenate(parts) for parts in zip(*found))
        yield batch.drop(columns=["spent", "bucket"]).assign(gap=gap, seen_rows=rows_seen, seen=seen, mean=mean, m2=m2)


def bucket_of(user: Column) -> Column:
    return F.pmod(F.xxhash64(user), F.lit(BUCKETS)).cast("int").alias("bucket")


def use_state_store(spark: SparkSession) -> None:
    """The state store that keyed processors need; queries that began with another keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def with_user_history(stream: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Add the gap and the user's statistics up to each row, from keyed state.

    Adds ``time_since_last_transaction``, ``user_avg_amount``, ``user_std_amount``,
    ``user_amount_count`` and ``user_transaction_count``. Columns must be of simple types; they
    travel as text, so that NULLs and large integers come back as they were. ``earlier`` is
    a table of moments (``moments_of``, or the store of a profile).
    """
    use_state_store(stream.sparkSession)
    fields = [f for f in stream.schema.fields if f.name not in ("user_id", "tx_id", "ts")]
    plain = [f.name for f in fields if not isinstance(f.dataType, AtomicType)]
    if plain:
        raise ValueError(f"columns of nested types cannot pass keyed state: {plain}")
    carried = {f"c{k}": f for k, f in enumerate(fields)}
    # whole numbers without NULLs stay whole in pandas
    known = stream.filter("user_id IS NOT NULL").select(
        bucket_of(F.col("user_id").cast("long")),
        F.col("user_id").cast("long").alias("user_id"),
        F.coalesce(F.col("tx_id").cast("long"), F.lit(0)).alias("tx_id"),
        F.col("tx_id").isNotNull().alias("keyed"),
        F.coalesce(micros(F.col("ts")), F.lit(0)).alias("at_us"),
        F.col("ts").isNotNull().alias("dated"),
        F.col("amount").cast("double").alias("spent"),
        *[F.col(f.name).cast("string").alias(c) for c, f in carried.items()],
    )
    texts = "".join(f", {c} string" for c in carried)
    state = None
    if earlier is not None:
        state = earlier.filter("user_id IS NOT NULL").withColumn("bucket", bucket_of(F.col("user_id").cast("long"))).groupBy("bucket")
    result = f"user_id long, tx_id long, keyed boolean, at_us long, dated boolean{texts}, {_KNOWN}"
    seen = known.groupBy("bucket").transformWithStateInPandas(UserHistory(), result, "Append", "None", state)
    deviation = F.when(F.col("seen") > 1, F.sqrt(F.col("m2") / (F.col("seen") - 1)))
    added = {
        "time_since_last_transaction": F.when(~F.isnan("gap"), F.col("gap")),
        "user_avg_amount": F.when(F.col("seen") > 0, F.col("mean")),
        "user_std_amount": deviation,
        "user_amount_count": F.col("seen"),
        "user_transaction_count": F.col("seen_rows"),
    }
    when = F.when(F.col("dated"), F.timestamp_micros("at_us")).cast(stream.schema["ts"].dataType).alias("ts")
    out = seen.select(
        "user_id", F.when(F.col("keyed"), F.col("tx_id")).alias("tx_id"), when, *[F.col(c).cast(f.dataType).alias(f.name) for c, f in carried.items()],
        *[value.alias(name) for name, value in added.items()],
    )
    kinds = {f.name: f.dataType for f in out.schema.fields}
    nobody = stream.filter("user_id IS NULL").select(
        *stream.columns, *[F.lit(None).cast(kinds[name]).alias(name) for name in added]
    )
    return out.select(*stream.columns, *added).unionByName(nobody)
