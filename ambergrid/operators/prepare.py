"""Model input: null defaults, indicator columns, alignment, splits, scaling, weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ambergrid.functions.scalar import flag, hash_order
from ambergrid.operators.features import MODEL_FEATURES
from ambergrid.operators.pieces import salted_left_join, with_running_total
from ambergrid.session import DEFAULT_LIMITS, Limits, materialise

#: Default gap for a user's first transaction: one hour.
FIRST_GAP_SECONDS = 3600.0
PAYMENT_PREFIX = "payment_"
#: Channels that get an indicator of their own; where there are more, all share hashed indicators.
NAMED_LEVELS = 100
HASHED_PREFIX = "payment#"
HASHED_LEVELS = 64


def drop_nulls(df: DataFrame) -> DataFrame:
    """Drop rows with a NULL or NaN in any column."""
    return df.na.drop("any")


def fill_zero(df: DataFrame) -> DataFrame:
    """Numeric NULLs and NaNs become 0; other columns stay as they are."""
    return df.na.fill(0)


def fill_defaults(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Column defaults first, then 0 for whatever numeric NULL is left."""
    return df.na.fill(defaults).na.fill(0)


def distinct_levels(df: DataFrame, column: str, most: int = 1000) -> list:
    """Sorted levels of a categorical column; refuses columns with more than ``most``."""
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"column {column!r} has more than {most} levels")
    return sorted(r[0] for r in rows)


def hashed_level(column: str, slots: int) -> Column:
    """Slot of a level by its hash, for any number of levels, unseen ones included; NULL has none."""
    return F.when(F.col(column).isNotNull(), F.pmod(F.xxhash64(F.col(column).cast("string")), F.lit(slots)))


def one_hot(column: str, levels: Sequence, prefix: str) -> list[Column]:
    """One 0/1 column per level; NULL and unseen levels are 0 everywhere."""
    return [flag(F.col(column) == F.lit(v)).alias(f"{prefix}_{v}") for v in levels]


def align(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The listed features in order: missing ones are 0, columns not listed are dropped."""
    return df.select(
        *keep, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in features]
    )


@dataclass(frozen=True)
class Preparation:
    """The ordered model columns learned from training rows; scoring uses the same object.

    Up to ``NAMED_LEVELS`` channels have an indicator each, and unseen ones none. More of them
    share ``HASHED_LEVELS`` indicators by hash, which unseen ones fall into as well. NULL has none.
    """

    features: list[str]

    @classmethod
    def fit(cls, featured: DataFrame) -> "Preparation":
        known = featured.select("channel").filter("channel IS NOT NULL").distinct().limit(NAMED_LEVELS + 1).count()
        if known > NAMED_LEVELS:
            return cls([*MODEL_FEATURES, *[f"{HASHED_PREFIX}{k}" for k in range(HASHED_LEVELS)]])
        levels = distinct_levels(featured, "channel")
        return cls([*MODEL_FEATURES, *[f"{PAYMENT_PREFIX}{v}" for v in levels]])

    @property
    def inputs(self) -> list[str]:
        return [f"x_{c}" for c in self.features]

    def _value(self, df: DataFrame, feature: str) -> Column:
        if feature in df.columns:
            default = FIRST_GAP_SECONDS if feature == "time_since_last_transaction" else 0.0
            value = F.col(feature).cast("double")
            return F.coalesce(F.when(~F.isnan(value), value), F.lit(default))
        if feature.startswith(HASHED_PREFIX) and "channel" in df.columns:
            return flag(hashed_level("channel", HASHED_LEVELS) == int(feature.removeprefix(HASHED_PREFIX))).cast("double")
        if feature.startswith(PAYMENT_PREFIX) and "channel" in df.columns:
            return flag(F.col("channel") == feature.removeprefix(PAYMENT_PREFIX)).cast("double")
        return F.lit(0.0)

    def apply(self, df: DataFrame) -> DataFrame:
        """Add one double column ``x_<feature>`` per feature beside the raw columns."""
        return df.withColumns({f"x_{c}": self._value(df, c) for c in self.features})


def _mark_test_rows(
    df: DataFrame,
    key: str,
    keys: Sequence[str],
    wanted: Callable[[Column], Column],
    seed: int,
    name: str,
    limits: Limits,
) -> DataFrame:
    """``name`` = 'test' for the first ``wanted(n)`` rows (per class) in hash order, else 'train'."""
    # One rule at every size: rows in the order of the key's hash, equal keys by the hash of
    # the whole row, which also places rows without a key. Equal rows are exchangeable.
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    whole = F.xxhash64(*hashable)
    place = F.when(F.col(key).isNull(), hash_order(whole, seed)).otherwise(hash_order(F.col(key), seed))
    hashed = df.withColumns({"_h": place, "_row": whole})
    ranked = with_running_total(hashed, keys, "_h", F.lit(1), [key, "_row"], limits)
    is_test = F.col("before") < wanted(F.col("total"))
    for k in keys:
        is_test = is_test & F.col(k).isNotNull()
    return ranked.withColumn(name, F.when(is_test, "test").otherwise("train")).drop("_h", "_row", "before", "total")


def random_split(
    df: DataFrame,
    key: str,
    test_share: float = 0.25,
    seed: int = 42,
    name: str = "split",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Add ``split`` = 'test' for exactly ceil(n * share) rows, chosen by key hash."""
    return _mark_test_rows(df, key, [], lambda n: F.ceil(n * F.lit(test_share)), seed, name, limits)


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    test_share: float = 0.2,
    seed: int = 42,
    name: str = "split",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """The same share of each class as test rows: round(share * n_class) of them.

    Any number of classes; rows without a class are training rows.
    """
    return _mark_test_rows(df, key, [label], lambda n: F.round(n * F.lit(test_share)), seed, name, limits)


def split_tables(df: DataFrame, name: str = "split") -> dict[str, DataFrame]:
    return {part: df.filter(F.col(name) == part).drop(name) for part in ("train", "test")}


@dataclass
class Scaler:
    """Centre to mean 0 and population deviation 1; constant columns are only centred."""

    means: dict[str, float]
    stds: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "Scaler":
        row = df.agg(*scaling_statistics(columns)).first()
        means = {c: row[f"{c}__mean"] or 0.0 for c in columns}
        return cls(means, {c: row[f"{c}__std"] or 1.0 for c in columns})

    def expressions(self) -> dict[str, Column]:
        return {c: (F.col(c) - self.means[c]) / self.stds[c] for c in self.means}

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.expressions())

    def statement(self) -> str:
        """The scaling as SQL, for a SQLTransformer stage that is saved with the model."""
        parts = ", ".join(
            f"(`{c}` - {self.means[c]!r}D) / {self.stds[c]!r}D AS `scaled_{c}`" for c in self.means
        )
        return f"SELECT *, {parts} FROM __THIS__"


def scaling_statistics(columns: Sequence[str]) -> list[Column]:
    mean = [F.avg(c).alias(f"{c}__mean") for c in columns]
    return mean + [F.stddev_pop(c).alias(f"{c}__std") for c in columns]


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_class), one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return counts.crossJoin(F.broadcast(totals)).select(
        label, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight")
    )


def with_class_weights(df: DataFrame, label: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Attach the weight of each row's class; rows without a class have none.

    The rows stay where they are unless there are so many classes that their weights cannot be
    broadcast: few classes in a shuffle join would put all rows into as few tasks.
    """
    weights = materialise(class_weights(df, label).select(label, "weight"), "weights")
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    joined = salted_left_join(df.withColumn("_spread", F.xxhash64(*hashable)), weights, label, "_spread", limits)
    return joined.select(label, *[c for c in df.columns if c != label], "weight")
