"""Helpers of the training-data operators: word patterns, checked joins, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ambergrid.session import materialise

#: The white space that separates words, as a pattern class.
SPACE = r"\x20\x09-\x0D"
#: Keys up to this number may be broadcast for a semi join (about 50 MB hashed).
BROADCAST_KEYS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; NULL text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def map_arrow(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Arrow batches through ``function``; the input columns are those of ``df``."""
    return df.mapInArrow(function, schema)


def keep_keys(df: DataFrame, keys: DataFrame, on: str, limit: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys`` (distinct, written).

    The keys are counted: up to ``limit`` they are broadcast, so that wide rows stay
    where they are; beyond it the join shuffles.
    """
    if keys.count() <= limit:
        keys = F.broadcast(keys)
    return df.join(keys, on, "left_semi")


def filter_rows(docs: DataFrame, row_keys: DataFrame, key: str, keep: bool) -> DataFrame:
    """Rows of ``docs`` whose hash of key and text is (or is not) among the written row keys."""
    if row_keys.count() <= BROADCAST_KEYS:
        row_keys = F.broadcast(row_keys)
    named = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(F.col(key), F.col("text")).alias("row_key"))
    return named.join(row_keys, "row_key", "left_semi" if keep else "left_anti").select("doc.*")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected edges (a, b), both long and not NULL.

    Returns (id, component) with the smallest id of each component, for all ids that
    have an edge. Large-star and small-star steps alternate until nothing changes; each
    step is one aggregate and one join on an id, and its result is written, so a lost
    executor costs one step. Stars point to the smallest neighbour, so a component of
    any size needs a number of rounds that grows with the logarithm of its diameter.
    """

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        # every node links its larger (large) or smaller neighbours to its minimum
        lows = pairs.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        # written, so that the join is a broadcast of few rows or a shuffle that can split a hub
        lows = materialise(lows, "lows")
        joined = pairs.join(F.broadcast(lows) if lows.count() <= BROADCAST_KEYS else lows, "u")
        if large:
            joined = joined.where("v > u")
            return joined.select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v"))
        own = joined.select("u", F.col("low").alias("v"))
        return out.union(own).where("u <> v").distinct()

    def both_ways(pairs: DataFrame) -> DataFrame:
        return pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def downward(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    current = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    current = materialise(downward(current), "edges")
    before = None
    for _ in range(rounds):
        large = stars(both_ways(current), True)
        current = materialise(downward(stars(downward(large), False)), "stars")
        state = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle; raise rounds")
    lows = current.select(F.col("v").alias("id")).distinct()
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        lows.select("id", F.col("id").alias("component"))
    )
