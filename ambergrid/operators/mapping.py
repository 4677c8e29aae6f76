"""Per-item work in parallel, with an index from key order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambergrid.operators.pieces import with_row_number
from ambergrid.session import DEFAULT_LIMITS, Limits


def with_item_index(df: DataFrame, key: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """``item_index`` from 0 in order of a unique numeric key."""
    ranked = with_row_number(df, [], key, (), limits)
    return ranked.withColumn("item_index", F.col("row_number") - 1).drop("row_number")


def map_items(
    df: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Apply a pandas function to every Arrow batch; it must treat rows independently."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)
