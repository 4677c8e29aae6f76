"""Self-join of texts on the Jaccard similarity of their word n-grams, and its groups.

A text's set holds the 64-bit hashes of its distinct n-grams. Texts of equal sets form a
class and only one member of each class is compared. A fixed sketch of all n-grams (the
number of sets per hash range) orders the hashes from rare to common; the first
``size - ceil(t * size) + 1`` of a set are its prefix, and two sets that are similar enough
share a prefix n-gram. Candidates are joined on prefix n-grams and pass length, positional
and suffix filters. The suffix filter compares parity sketches of the whole sets: the bits
in which two sketches differ are a lower bound of the sets' difference. Short sketches
travel with the candidates, wide ones are read for those that are left. What still may be
similar is verified once per pair on the whole sets.

Groups of near copies are not expanded into all pairs. First every set is compared with
one pseudo-random leader per prefix n-gram, the most shared leader first; then only pairs
across the components found so far are joined. A pair inside one component cannot change
the components, so none that matters is left out.

Defined results: a text with fewer words than n has its word sequence as its one element; a
text without words, or NULL, has an empty set and is a group of its own; repeated rows are
copies; NULL keys are compared like others and are never the name of a group with a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambergrid.llm.common import BROADCAST_KEYS, components, keep_keys, map_arrow
from ambergrid.session import materialise

RANGES = 1 << 16
#: Words of 64 bits in the sketch that travels with candidates, and in the wide one.
SKETCH_WORDS = 8
WIDE_WORDS = 64
#: Words whose hashes a worker keeps; the store starts anew beyond that.
KEPT = 100_000
FIRST = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) > KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_digest(word)
        return value


def shingles(text: bytes | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text, A-Z lower-cased."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    words = np.frombuffer(b"".join([known[w] for w in found]), "<u8")
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out += words[k : k + len(out)]
        out *= FIRST
        out ^= out >> np.uint64(29)
    out *= SECOND
    out ^= out >> np.uint64(32)
    return np.unique(out)


def _range_counts(width: int):
    """Number of sets per hash range, one row per range that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = WordHashes(), np.zeros(RANGES, np.int64)
        for batch in batches:
            for text in batch["text"]:
                found = shingles(text.as_py(), width, known)
                counts += np.bincount((found >> np.uint64(48)).astype(np.int64), minlength=RANGES) if len(found) > 4096 else 0
                if len(found) <= 4096:
                    np.add.at(counts, (found >> np.uint64(48)).astype(np.int64), 1)
        met = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(met), pa.array(counts[met])], ["place", "n"])

    return run


def ranked(found: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The hashes with their ranges renumbered from rare to common, sorted."""
    low = found & np.uint64((1 << 48) - 1)
    return np.sort((ranks[(found >> np.uint64(48)).astype(np.int64)] << np.uint64(48)) | low)


def sketch(found: np.ndarray, size: int) -> np.ndarray:
    """Parity of the number of elements per cell, 64 cells to a word."""
    odd = np.bincount((found & np.uint64(64 * size - 1)).astype(np.int64), minlength=64 * size) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _described(width: int, percent: int, shared):
    """Per row: size, signature, sketch and prefix of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = WordHashes(), np.frombuffer(shared.value, "<u2").astype(np.uint64)
        for whole in batches:
            for start in range(0, len(whole), 256):  # few sets at a time, as they may be large
                batch = whole.slice(start, 256)
                sizes, signs, bits, wide, prefixes = [], [], [], [], []
                for text in batch["text"]:
                    found = ranked(shingles(text.as_py(), width, known), ranks)
                    size = len(found)
                    sizes.append(size)
                    signs.append(xxhash.xxh3_128_digest(found.tobytes()))
                    bits.append(sketch(found, SKETCH_WORDS))
                    wide.append(sketch(found, WIDE_WORDS))
                    prefix = found[: size + percent * -size // 100 + 1 if size else 0]
                    prefixes.append(prefix.view(np.int64).copy())  # a view would keep the whole set
                yield pa.record_batch(
                    [
                        *[batch[c] for c in ("key", "row_key")],
                        pa.array(sizes, pa.int64()),
                        pa.array(signs, pa.binary()),
                        pa.array(bits, pa.list_(pa.int64())),
                        pa.array(wide, pa.list_(pa.int64())),
                        pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    ["key", "row_key", "size", "sign", "bits", "wide", "prefix"],
                )

    return run


def _sets(width: int, shared):
    """Signature and whole set per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = WordHashes(), np.frombuffer(shared.value, "<u2").astype(np.uint64)
        for batch in batches:
            for start in range(0, len(batch), 256):  # few sets at a time, as they may be large
                texts = batch["text"].slice(start, 256)
                found = [ranked(shingles(t.as_py(), width, known), ranks) for t in texts]
                signs = [xxhash.xxh3_128_digest(f.tobytes()) for f in found]
                sets = pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))
                yield pa.record_batch([pa.array(signs, pa.binary()), sets], ["sign", "items"])

    return run


def needed(percent: int, total: Column) -> Column:
    """Least intersection of two similar sets whose sizes add up to ``total``."""
    return F.ceil(total * percent / float(100 + percent) - 1e-9)


def possible(percent: int) -> Column:
    """Length and suffix filters on columns size_a, bits_a, size_b and bits_b."""
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    apart = F.lit(0)
    for k in range(SKETCH_WORDS):
        apart = apart + F.bit_count(F.col("bits_a")[k].bitwiseXOR(F.col("bits_b")[k]))
    total = F.col("size_a") + F.col("size_b")
    return (small * 100 >= large * percent) & (apart <= total - 2 * needed(percent, total))


class Join:
    """State of one self-join: the texts, the sketch's ranks and the classes."""

    def __init__(self, docs: DataFrame, key: str, width: int, percent: int) -> None:
        self.width, self.percent = width, percent
        spark = docs.sparkSession
        self.texts = docs.select(
            F.col(key).alias("key"),
            F.xxhash64(F.col(key), F.col("text")).alias("row_key"),
            F.col("text").cast("binary").alias("text"),
        )
        counted = map_arrow(self.texts.select("text"), _range_counts(width), "place long, n long")
        rows = counted.groupBy("place").agg(F.sum("n").alias("n")).collect()  # at most RANGES rows
        counts = np.zeros(RANGES, np.int64)
        for row in rows:
            counts[row["place"]] = row["n"]
        ranks = np.empty(RANGES, "<u2")
        ranks[np.argsort(counts, kind="stable")] = np.arange(RANGES)
        self.shared = spark.sparkContext.broadcast(ranks.tobytes())
        kind = docs.schema[key].dataType.simpleString()
        described = map_arrow(
            self.texts,
            _described(width, percent, self.shared),
            f"key {kind}, row_key long, size long, sign binary, bits array<long>, wide array<long>, prefix array<long>",
        )
        self.rows = materialise(described.withColumn("row", F.monotonically_increasing_id()), "sets")
        heads = self.rows.where("size > 0").groupBy("sign").agg(
            F.min("row").alias("row"),
            F.min(F.struct(F.col("key").isNull().alias("no"), "key", "row_key")).alias("head"),
        )
        self.heads = materialise(heads, "classes")
        self.classes = keep_keys(self.rows, self.heads.select("row"), "row")

    def plausible(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose wide sketches allow them to be similar, numbered."""
        nodes = materialise(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "nodes")
        info = materialise(keep_keys(self.rows.select("row", "size", "wide"), nodes, "row"), "wide")
        for side in ("a", "b"):
            pairs = pairs.join(info.toDF(side, f"size_{side}", f"wide_{side}"), side)
        differing = F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        apart = F.aggregate(differing, F.lit(0), lambda x, y: x + y)
        total = F.col("size_a") + F.col("size_b")
        left = pairs.where(apart <= total - 2 * needed(self.percent, total)).select("a", "b")
        return materialise(left.withColumn("pair", F.monotonically_increasing_id()), "plausible")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) of classes that are similar.

        The sets are made anew from the texts that are needed, and only sent to their pairs.
        """
        pairs = self.plausible(pairs)
        ends = pairs.select(F.col("a").alias("row"), "pair", F.lit(True).alias("left")).union(
            pairs.select(F.col("b").alias("row"), "pair", F.lit(False).alias("left"))
        )
        wanted = materialise(ends.join(self.heads.select("row", "sign", "head.key"), "row"), "wanted")
        keys = materialise(wanted.where("key is not null").select("key").distinct(), "keys")
        texts = keep_keys(self.texts, keys, "key")
        if wanted.where("key is null").limit(1).count():
            texts = texts.union(self.texts.where("key is null"))
        sets = map_arrow(texts.select("text"), _sets(self.width, self.shared), "sign binary, items array<long>")
        places = wanted.select("sign", "pair", "left")
        if places.count() <= BROADCAST_KEYS:
            places = F.broadcast(places)
        sent = sets.join(places, "sign").groupBy("pair").agg(
            F.first(F.when(F.col("left"), F.col("items")), ignorenulls=True).alias("x"),
            F.first(F.when(~F.col("left"), F.col("items")), ignorenulls=True).alias("y"),
        )
        common = F.size(F.array_intersect("x", "y"))
        similar = common * (100 + self.percent) >= (F.size("x") + F.size("y")) * self.percent
        return materialise(pairs.join(sent.where(similar).select("pair"), "pair", "left_semi").select("a", "b"), "links")

    def with_sketches(self, pairs: DataFrame) -> DataFrame:
        info = self.classes.select("row", "size", "bits")
        for side in ("a", "b"):
            pairs = pairs.join(info.toDF(side, f"size_{side}", f"bits_{side}"), side)
        return pairs

    def groups(self) -> DataFrame:
        """(id, component) of the classes that are linked with another one."""
        percent = self.percent
        entries = self.classes.select(
            F.col("row").alias("node"), "size", F.posexplode("prefix").alias("place", "token")
        )
        mask = F.xxhash64("token")
        leaders = (
            entries.groupBy("token")
            .agg(F.count("*").alias("n"), F.min(F.col("node").bitwiseXOR(mask)).alias("least"))
            .where("n > 1")
            .select("token", F.col("least").bitwiseXOR(mask).alias("leader"))
        )
        live = materialise(entries.join(leaders, "token"), "prefixes")
        stars = (
            live.where("node <> leader")
            .groupBy(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"), "node")
            .agg(F.count("*").alias("n"))
        )
        stars = materialise(
            self.with_sketches(stars).where(possible(percent)).select("a", "b", "node", "n"), "stars"
        )
        best = Window.partitionBy("node").orderBy(F.desc("n"), "a", "b")
        first = stars.withColumn("k", F.row_number().over(best)).where("k = 1").select("a", "b").distinct()
        first = materialise(first, "pairs")
        links = self.verified(first)
        found = materialise(components(links), "components")
        more = across(stars.select("a", "b").distinct().join(first, ["a", "b"], "left_anti"), found)
        more = materialise(more, "pairs")
        links = materialise(links.union(self.verified(more)), "links")
        found = materialise(components(links), "components")
        rest = self.across_tokens(live, found).join(first.union(more), ["a", "b"], "left_anti")
        rest = materialise(rest, "pairs")
        return components(links.union(self.verified(rest)))

    def across_tokens(self, live: DataFrame, found: DataFrame) -> DataFrame:
        """Candidate pairs that share a prefix n-gram but no component."""
        percent = self.percent
        named = live.join(found.withColumnRenamed("id", "node"), "node", "left").select(
            "token", "node", "size", "place", F.coalesce("component", "node").alias("group")
        )
        named = materialise(named, "named")
        mixed = named.groupBy("token").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y")
        kept = named.join(mixed.select("token"), "token", "left_semi")
        kept = materialise(kept.join(self.classes.select(F.col("row").alias("node"), "bits"), "node"), "mixed")
        # both sides are one exchange under two names; lengths are compared inside the join
        shorter = kept.select("token", *[F.col(c).alias(f"{c}_a") for c in kept.columns if c != "token"])
        longer = kept.select("token", *[F.col(c).alias(f"{c}_b") for c in kept.columns if c != "token"])
        ordered = F.struct("size_a", "node_a") < F.struct("size_b", "node_b")
        reach = (
            F.least("place_a", "place_b")
            + 1
            + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
            - 1
        )
        enough = reach >= needed(percent, F.col("size_a") + F.col("size_b"))
        apart = F.col("group_a") != F.col("group_b")
        pairs = shorter.join(longer, "token").where(apart & ordered & enough & possible(percent))
        return pairs.select(
            F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")
        ).distinct()


def across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    for side in ("a", "b"):
        pairs = pairs.join(found.toDF(side, f"group_{side}"), side, "left")
    apart = F.coalesce("group_a", "a") != F.coalesce("group_b", "b")
    return pairs.where(apart).select("a", "b")


def jaccard_groups(docs: DataFrame, key: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: key, row_key, n_shingles, component_id and stays (one row of each group).

    ``component_id`` is the smallest key that links of at least ``percent`` lead to. Only key
    and text of ``docs`` are read.
    """
    join = Join(docs, key, width, percent)
    found = join.groups()
    heads = join.heads.join(found.withColumnRenamed("id", "row"), "row", "left").select(
        "sign", "head", F.coalesce("component", "row").alias("component")
    )
    heads = materialise(heads, "heads")
    firsts = heads.groupBy("component").agg(F.min("head").alias("first"))
    names = heads.join(firsts, "component").select("sign", "first")
    rows = join.rows.select("key", "row_key", "size", "sign").join(names, "sign", "left")
    alone = F.col("size") == 0
    return rows.select(
        F.col("key").alias(key),
        "row_key",
        F.col("size").alias("n_shingles"),
        F.when(alone, F.col("key")).otherwise(F.col("first.key")).alias("component_id"),
        (alone | ((F.col("row_key") == F.col("first.row_key")) & F.col("key").eqNullSafe(F.col("first.key")))).alias("stays"),
    )
