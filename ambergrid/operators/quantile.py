"""Exact order statistics without sorting the table or holding it in one task."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambergrid.operators.pieces import with_running_total
from ambergrid.session import DEFAULT_LIMITS, Limits, is_small, materialise, plan_bytes

#: Cells of the grid that brackets a rank.
PIECES = 1024
#: Rows sampled to place the grid: about 256 per cell.
SAMPLE = 262_144
SEED = 42
GRID = np.arange(1, PIECES) / PIECES
#: Below this many rows in the search range another narrowing pass is not worth it.
_NARROW_ENOUGH = 1_000_000


def grid_bounds(value: Column) -> Column:
    """Aggregate: the 1023 inner grid values. All of them occur in the column."""
    # A numpy array becomes one array literal instead of 1023 expressions.
    return F.percentile_approx(value, F.lit(GRID), F.lit(10_000))


def _margin(sample: int) -> int:
    """Grid cells to leave on each side: seven deviations of a sampled rank, and the sketch."""
    return math.ceil(7 * 0.5 / math.sqrt(sample) * PIECES) + 2


def _passes(df: DataFrame, narrow_enough: int) -> int:
    """Narrowing passes for a column of this size; one cuts the bracket about 50 times."""
    rows = max(plan_bytes(df) / 8, 1.0)
    return min(4, math.ceil(math.log(max(rows / narrow_enough, 1.0), 50)))


def order_statistic(
    df: DataFrame,
    column: str,
    rank: Callable[[Column], Column],
    keys: Sequence[str] = (),
    narrow_enough: int = _NARROW_ENOUGH,
    sample: int = SAMPLE,
) -> DataFrame:
    """The values at ``floor(rank)`` and ``ceil(rank)`` (from 0) of the sorted column.

    ``rank`` maps the number of non-null values to a possibly fractional rank.
    One row per key: keys..., ``rank``, ``low``, ``high``. A sampled sketch
    brackets the rank, each pass over the column narrows the bracket, and only
    the distinct values left inside are ordered. The ranks themselves are
    counted, so the result is exact. Whether a bracket missed is known from the
    counts; then all distinct values are ordered by a scan over ranges instead.
    Keys must be few (class labels): their table is broadcast. Runs its jobs here.
    """
    values = df.select(*keys, F.col(column).alias("_x")).filter(F.col("_x").isNotNull())
    kind = values.schema["_x"].dataType

    def attach(state: DataFrame) -> DataFrame:
        if keys:
            return values.join(F.broadcast(state), list(keys))
        return values.crossJoin(F.broadcast(state))

    x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
    inside = (lo.isNull() | (x >= lo)) & (hi.isNull() | (x <= hi))

    # _n is the (estimated) number of values inside the bracket.
    state = values.groupBy(*keys).agg(F.count("_x").alias("_n")).select(
        *keys,
        rank(F.col("_n")).cast("double").alias("rank"),
        F.lit(None).cast(kind).alias("_lo"),
        F.lit(None).cast(kind).alias("_hi"),
        F.col("_n").cast("double").alias("_n"),
    )
    margin = _margin(sample)
    for _ in range(_passes(values, narrow_enough)):
        drawn = inside & (F.rand(SEED) < F.lit(float(sample)) / F.col("_n"))
        found = attach(state).withColumn("_drawn", drawn).groupBy(*keys, "rank", "_lo", "_hi").agg(
            F.count_if(F.coalesce(x < lo, F.lit(False))).alias("_below"),
            F.count_if(inside).alias("_m"),
            grid_bounds(F.when(F.col("_drawn"), x)).alias("_bounds"),
        )
        # Cells of margin on each side cover the errors of sample and sketch.
        per_row = F.lit(float(PIECES)) / F.col("_m")
        first = F.floor((F.floor("rank") - F.col("_below")) * per_row).cast("int") - margin
        last = F.floor((F.ceil("rank") - F.col("_below") + 1) * per_row).cast("int") + margin
        wide = F.col("_m") > narrow_enough
        state = found.select(
            *keys,
            "rank",
            F.when(wide, F.coalesce(F.get("_bounds", first), lo)).otherwise(lo).alias("_lo"),
            F.when(wide, F.coalesce(F.get("_bounds", last), hi)).otherwise(hi).alias("_hi"),
            F.when(wide, F.col("_m") * (last - first) / PIECES).otherwise(F.col("_m")).alias("_n"),
        )
    state = state.drop("_n")

    # Values below the bracket share one NULL row, which sorts first.
    counted = (
        attach(state)
        .filter(hi.isNull() | (x <= hi))
        .groupBy(*keys, "rank", F.when(lo.isNull() | (x >= lo), x).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = (
        Window.partitionBy(*keys)
        .orderBy(F.col("_v").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = counted.withColumn("_upto", F.sum("_c").over(upto))
    below = F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_upto"))), F.lit(0))
    picked = running.groupBy(*keys, "rank").agg(
        F.min(F.when(F.col("_upto") > F.floor("rank"), F.col("_v"))).alias("low"),
        F.min(F.when(F.col("_upto") > F.ceil("rank"), F.col("_v"))).alias("high"),
        below.alias("_below"),
    )
    valid = F.col("rank") >= 0
    missed = valid & (F.col("high").isNull() | (F.col("_below") > F.floor("rank")))
    found = materialise(picked.withColumn("_missed", missed), "order-statistic")
    if not found.filter("_missed").isEmpty():
        return scanned_statistic(values, "_x", F.lit(1), rank, keys)
    return found.select(
        *keys, "rank", F.when(valid, F.col("low")).alias("low"), F.when(valid, F.col("high")).alias("high")
    )


def scanned_statistic(
    df: DataFrame,
    column: str,
    weight: Column,
    rank: Callable[[Column], Column],
    keys: Sequence[str] = (),
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """The same from the ordered distinct values: any number of keys, any key size, no bracket.

    Rows count by ``weight``; keys whose rows all weigh nothing have no values.
    """
    counts = df.groupBy(*keys, F.col(column).alias("_v")).agg(F.sum(weight).alias("_c"))
    ranked = with_running_total(counts, keys, "_v", F.col("_c"), (), limits)
    ranked = ranked.withColumn("rank", rank(F.col("total")).cast("double"))
    upto = F.col("before") + F.col("_c")
    return ranked.groupBy(*keys).agg(
        F.max("rank").alias("rank"),
        F.min(F.when((upto > F.floor("rank")) & (F.col("rank") >= 0), F.col("_v"))).alias("low"),
        F.min(F.when((upto > F.ceil("rank")) & (F.col("rank") >= 0), F.col("_v"))).alias("high"),
    )


def _interpolated(low: Column, high: Column, rank: Column) -> Column:
    return low + (high - low) * (rank - F.floor(rank))


def exact_quantile(
    df: DataFrame,
    column: str,
    p: float,
    name: str = "q",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Linear-interpolated quantile of a column, as a one-row table."""
    if is_small(df, limits):
        return df.agg(F.percentile(column, F.lit(p)).cast("double").alias(name))
    ranks = order_statistic(df, column, lambda n: (n - 1) * F.lit(p))
    value = _interpolated(F.col("low"), F.col("high"), F.col("rank"))
    # An aggregate over the one row keeps the result one row (NULL) on empty input.
    return ranks.select(value.cast("double").alias(name)).agg(F.max(name).alias(name))


def grouped_quantile(
    df: DataFrame,
    keys: Sequence[str],
    column: str,
    p: float,
    name: str = "q",
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Linear-interpolated quantile per key; any number of keys, any key size.

    Keys whose values are all NULL have NULL as their quantile.
    """
    if is_small(df, limits):
        return df.groupBy(*keys).agg(F.percentile(column, F.lit(p)).cast("double").alias(name))
    # NULL values stay as one row of weight 0 per key
    known = F.col(column).isNotNull().cast("long")
    found = scanned_statistic(df, column, known, lambda n: (n - 1) * F.lit(p), keys, limits)
    return found.select(*keys, _interpolated(F.col("low"), F.col("high"), F.col("rank")).cast("double").alias(name))
