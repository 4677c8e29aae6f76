"""Mixing sources to target weights, in DataFrame functions only.

Every row gets a hash-random key. Within a source the rows are ordered by key and cut where
the running sum of sizes reaches the source's budget; a budget above the source's size is
met by whole repeats plus such a cut. The range of keys is dealt into about sqrt(rows)
pieces per source: sizes are summed per piece, the sums run over the pieces, and only the
one piece in which the cut falls is sorted. Pieces below the cut are taken whole, pieces
above it not at all, so no source is ever sorted or gathered in one task.

Keys are MD5 digests of the row's identity, so reruns agree. Sources are ordered by code
point with NULL last. Defined results: NULL texts have size 0 and are taken 0 times; an
empty table gives an empty mix; rows that are equal in key, size and text are exchangeable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambergrid.llm.common import BROADCAST_KEYS, words
from ambergrid.session import materialise

WEIGHTS = (5, 2, 1)
#: No row is taken more than this many times.
REPEATS = 3
#: Bits of the digest that place a row in a piece.
RANGE = 1 << 40


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Target per source of ``sizes`` (source_key, rank order columns, source_size).

    Shares by weight stop at ``repeats`` times a source's size and the excess is shared out
    by weight again. The fixed point is one level L with target = min(limit, weight * L):
    sources reach their limit in the order of limit / weight, so two running sums find L.
    """
    names = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    table = sizes.withColumn("place", F.row_number().over(names) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = table.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(repeats))
    full = Window.orderBy(F.col("most") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = table.withColumn("limited", F.coalesce(F.sum("most").over(full), F.lit(0.0)))
    table = table.withColumn(
        "free", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))
    ).withColumn("total", F.sum("source_size").over(every).cast("double"))
    level = (F.col("total") - F.col("limited")) / F.col("free")
    # the first source, in that order, whose limit is not reached sets the level of all behind it
    fits = F.when(
        F.col("weight") * level <= F.col("most"),
        F.struct((F.col("most") / F.col("weight")).alias("ratio"), F.col("place"), level.alias("level")),
    )
    table = table.withColumn("level", F.min(fits).over(every)["level"])
    return table.withColumn("target", F.least("most", F.col("weight") * F.coalesce("level", F.lit(float("inf"))))).select(
        "source_key", "source_size", "target"
    )


def mix(docs: DataFrame, key: str = "doc_id", weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Per row: key, row_key (hash of key and text), size, source_size, target and taken words."""
    identity = F.concat_ws(":", F.col(key).cast("string"), word_count(F.col("text")).cast("string"))
    digest = F.md5(F.when(F.col(key).isNull(), F.concat(F.lit("text:"), F.coalesce("text", F.lit("")))).otherwise(identity))
    rows = docs.select(
        F.col(key).alias("key"),
        F.xxhash64(F.col(key), F.col("text")).alias("row_key"),
        "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"),
        word_count(F.col("text")).alias("size"),
        digest.alias("digest"),
    )
    rows = materialise(rows, "mix")
    sources = rows.groupBy("source_key").agg(
        F.first("source").alias("source"),
        F.sum("size").alias("source_size"),
        F.count("*").alias("n"),
    )
    sources = materialise(sources, "sources")
    plan = targets(sources, weights, repeats).join(sources.select("source_key", "n"), "source_key")
    plan = materialise(
        plan.select(
            "source_key",
            "source_size",
            "target",
            F.ceil(F.sqrt("n")).cast("long").alias("pieces"),
            F.least(F.round("target").cast("long"), F.col("source_size") * repeats).alias("budget"),
        ),
        "plan",
    )
    few = plan.count() * 16 <= BROADCAST_KEYS
    small = (lambda t: F.broadcast(t)) if few else (lambda t: t)
    point = F.conv(F.substring("digest", 1, 10), 16, 10).cast("long")
    placed = rows.join(small(plan), "source_key").withColumn(
        "piece", F.floor(point * F.col("pieces") / F.lit(float(RANGE))).cast("long")
    )
    sums = placed.groupBy("source_key", "piece").agg(F.sum("size").alias("sum"))
    order = Window.partitionBy("source_key").orderBy("piece")
    running = sums.withColumn("before", F.sum("sum").over(order) - F.col("sum")).join(small(plan), "source_key")
    rest = F.when(F.col("source_size") > 0, F.col("budget") % F.col("source_size")).otherwise(0)
    cut = (
        running.where((F.col("before") <= rest) & (rest < F.col("before") + F.col("sum")))
        .select("source_key", F.col("piece").alias("cut_piece"), "before")
    )
    cut = materialise(cut, "cut")
    parted = placed.join(small(cut), "source_key", "left").withColumn("rest", rest).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    )
    at_cut = F.col("piece") == F.col("cut_piece")
    sorted_ = Window.partitionBy("source_key", "piece").orderBy("digest", "key", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    inside = parted.where(at_cut).withColumn(
        "extra",
        F.least(
            F.col("size"),
            F.greatest(F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(sorted_), F.lit(0)), F.lit(0)),
        ),
    )
    outside = parted.where(~F.coalesce(at_cut, F.lit(False))).withColumn(
        "extra", F.when(F.col("piece") < F.col("cut_piece"), F.col("size")).otherwise(0)
    )
    out = [F.col("key").alias(key), "row_key", "size", "source_size", "target",
           (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken")]
    return inside.select(*out).unionByName(outside.select(*out))


def take(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mix itself: each row as often as it is taken, the last time cut to the words left.

    All columns are kept; a cut text is its first words joined by blanks, and ``n_chars``, if
    present, follows it. Rows that are equal in key and text count as one row of their sum.
    """
    taken = mix(docs, key).groupBy("row_key").agg(
        F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count("*").alias("n")
    )
    taken = materialise(taken.where("taken > 0"), "taken")
    row_key = F.xxhash64(F.col(key), F.col("text"))
    if taken.where("n > 1").limit(1).count():
        docs = docs.dropDuplicates([key, "text"])
    small = F.broadcast(taken) if taken.count() <= BROADCAST_KEYS else taken
    # the joined columns live in one struct, so names of the input cannot clash
    joined = docs.select(F.struct(*docs.columns).alias("doc"), row_key.alias("row_key")).join(small, "row_key")
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    left = (F.col("taken") - (F.col("copy") - 1) * F.col("size")).cast("int")
    start = F.array_join(F.slice(words(F.col("doc.text")), F.lit(1), left), " ")
    cut = left < F.col("size")
    out = []
    for name in docs.columns:
        value = F.col(f"doc.`{name}`")
        if name == "text":
            value = F.when(cut, start).otherwise(value)
        elif name == "n_chars":
            value = F.when(cut, F.length(start).cast(docs.schema[name].dataType)).otherwise(value)
        out.append(value.alias(name))
    return joined.select(*out)
