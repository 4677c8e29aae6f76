"""Ordered groups of any size: a prefix scan over range partitions.

A window over a key sends all rows of the key to one task. That is right for keys of up to
``hot_rows`` rows. The rows of larger keys are partitioned by range of (key, order, ties),
so a partition holds about ``hot_rows`` of them, whatever keys they belong to, and are
written with the number of their partition. Windows then run inside (partition, key), and
what a row needs from earlier partitions of its key is one number: it comes from a scan over
one summary per (partition, key) and is joined back.

There is no ceiling on the number of keys or partitions: n rows give n / hot_rows of them.
Rows that are equal in key, order and ties stay together, as their order is arbitrary.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambergrid.session import DEFAULT_LIMITS, Limits, is_small, materialise

#: Most rows of a table of hot keys or summaries (of about 100 bytes) that is broadcast.
SENT_ROWS = 200_000


def sent(table: DataFrame) -> DataFrame:
    """A written table, marked for broadcast while it is counted as short."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on keys where NULL is a key like any other; keeps the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    condition = None
    for k in keys:
        equal = left[k].eqNullSafe(renamed[f"_k_{k}"])
        condition = equal if condition is None else condition & equal
    return left.join(renamed, condition, how).drop(*[f"_k_{k}" for k in keys])


def hot_keys(
    df: DataFrame, keys: Sequence[str], limits: Limits = DEFAULT_LIMITS, carry: Mapping[str, Column] | None = None
) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, their number ``_n`` and ``carry`` aggregates, written.

    One aggregate that is partial before its shuffle. At most n / hot_rows keys can pass.
    """
    extra = [expr.alias(name) for name, expr in (carry or {}).items()]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *extra)
    return materialise(counts.filter(F.col("_n") > limits.hot_rows), "hot")


def split_hot(
    df: DataFrame, keys: Sequence[str], limits: Limits = DEFAULT_LIMITS, carry: Mapping[str, Column] | None = None
) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of other keys, rows of hot keys with their ``carry`` columns (or None), and the number of these."""
    hot = hot_keys(df, keys, limits, carry)
    rows = hot.agg(F.sum("_n")).first()[0]
    if not rows:
        return df, None, 0
    marked = sent(hot)
    return (
        null_safe_join(df, marked.select(*keys), keys, "left_anti"),
        null_safe_join(df, marked.drop("_n"), keys, "inner"),
        rows,
    )


def ranged(df: DataFrame, rows: int, by: Sequence[str], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """The rows in ranges of ``by`` with the number ``_part`` of their range, written.

    Writing fixes the ranges, so that all later steps and a lost executor see the same ones.
    """
    parts = max(2, -(-rows // max(limits.hot_rows, 1)))
    return materialise(df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "ranged")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str],
    name: str,
    rows: int,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Add ``name``, the order value of the row before in its key, by a scan over ranges."""
    parted = ranged(df, rows, [*keys, order, *ties], limits)
    inside = Window.partitionBy("_part", *keys).orderBy(order, *ties)
    lasts = parted.groupBy("_part", *keys).agg(F.max(order).alias("_last"))
    earlier = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part"))
    carries = materialise(lasts.select("_part", *keys, earlier.alias("_carry")), "carries")
    joined = null_safe_join(parted, sent(carries), ["_part", *keys], "left")
    before = F.when(F.row_number().over(inside) > 1, F.lag(order).over(inside)).otherwise(F.col("_carry"))
    return joined.withColumn(name, before).drop("_part", "_carry")


def _plain_totals(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str]) -> DataFrame:
    key = Window.partitionBy(*keys)
    upto = key.orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("_w").over(upto) - F.col("_w")
    return df.withColumn("before", before).withColumn("total", F.sum("_w").over(key)).drop("_w")


def _scanned_totals(
    df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str], rows: int, limits: Limits
) -> DataFrame:
    parted = ranged(df, rows, [*keys, order, *ties], limits)
    upto = Window.partitionBy("_part", *keys).orderBy(order, *ties)
    running = F.sum("_w").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_w")
    # the scan over summaries: one row per range and key, n / hot_rows of them
    sums = parted.groupBy("_part", *keys).agg(F.sum("_w").alias("_pw"))
    by_key = Window.partitionBy(*keys)
    so_far = F.sum("_pw").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = sums.select(
        "_part", *keys, (so_far - F.col("_pw")).alias("_offset"), F.sum("_pw").over(by_key).alias("total")
    )
    offsets = sent(materialise(offsets, "offsets"))
    joined = null_safe_join(parted, offsets, ["_part", *keys], "inner")
    return joined.withColumn("before", F.col("_offset") + running).drop("_w", "_part", "_offset")


def with_running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    weight: Column,
    ties: Sequence[str] = (),
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Add ``before`` (weights of earlier rows of the key) and ``total``.

    Exact for any skew: running sums inside a range plus one offset per range and key. NULL
    keys are a key like any other, NULL order values come first.
    """
    weighted = df.withColumn("_w", weight)
    if is_small(df, limits):
        return _plain_totals(weighted, keys, order, ties)
    if not keys:
        return _scanned_totals(weighted, keys, order, ties, df.count(), limits)
    rest, hot, rows = split_hot(weighted, keys, limits)
    plain = _plain_totals(rest, keys, order, ties)
    if hot is None:
        return plain
    return plain.unionByName(_scanned_totals(hot, keys, order, ties, rows, limits))


def with_row_number(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """Add ``row_number`` (from 1) per key without one task per key."""
    ranked = with_running_total(df, keys, order, F.lit(1).cast("long"), ties, limits)
    return ranked.withColumn("row_number", F.col("before") + 1).drop("before", "total")


def salted_left_join(
    facts: DataFrame,
    table: DataFrame,
    key: str,
    spread: str,
    limits: Limits = DEFAULT_LIMITS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Left join of facts to one row per key; a hot key goes to a task per ``hot_rows`` of its rows.

    ``spread`` is a facts column with many values. The row of a hot key in ``table`` is repeated
    once per salt, together n / hot_rows rows. ``hot`` gives the hot keys and their numbers of
    rows ``_n`` when they are known; otherwise they are counted.
    """
    if is_small(table, limits):
        return facts.join(F.broadcast(table), key, "left")
    if hot is None:
        if is_small(facts, limits):
            return facts.join(table, key, "left")
        hot = hot_keys(facts, [key], limits)
    salts = F.ceil(F.col("_n") / max(limits.hot_rows, 1)).cast("int")
    marks = sent(materialise(hot.select(key, salts.alias("_salts")), "salts"))
    # A NULL key matches nothing; such rows get any salt so they do not pile up.
    salt = F.when(F.col(key).isNull(), F.xxhash64(spread)).otherwise(
        F.coalesce(F.pmod(F.xxhash64(spread), F.col("_salts")), F.lit(0))
    )
    every = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts") - 1, F.lit(0)).cast("long"))
    left = facts.join(marks, key, "left").withColumn("_salt", salt.cast("long")).drop("_salts")
    right = table.join(marks, key, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return left.join(right, [key, "_salt"], "left").drop("_salt")
