"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes when a string of ``SPAN`` bytes over it also starts anywhere else in the
corpus. Suffixes are refined in the order of a suffix array: initial buckets of q-grams,
then buckets split by identifiers of what lies at later (and earlier) offsets, with the
results of one level reused by the next.

* Buckets. Every window of SPAN bytes is represented by the q-gram in it with the least
  hash, the leftmost of equals. That choice depends on the window's bytes only, so equal
  windows have equal q-grams at equal offsets, and each q-gram position stands for one
  run of windows. Positions whose q-gram is in one place only leave at once.
* Refinement. The windows of a position form a range of offsets. A range whose bytes, as a
  whole, also lie around another position is repeated throughout. A range whose common
  core of bytes lies nowhere else is not repeated at all. Any other range is split into
  ``WAYS`` parts, which are put into buckets again, down to single windows. Of ranges
  with equal bytes one goes on as a witness for the others.

All buckets are counted by aggregates on digests (with partial sums before the shuffle), so
a bucket of any size, such as a passage in a third of all texts, is never gathered. Exact
copies of texts are one text throughout. Digests are 128-bit, first q-gram hashes 64-bit:
unequal q-grams of equal hash meet in one bucket and are parted by their bytes.

Defined results: NULL and empty texts have nothing to remove; texts shorter than SPAN stay
whole; repeated rows are exact copies, so from SPAN bytes on all of their bytes go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambergrid.llm.common import BROADCAST_KEYS, keep_keys, map_arrow
from ambergrid.session import materialise

SPAN = 400
GRAM = 64
WAYS = 7
#: Bytes whose windows are examined at once.
CHUNK = 1 << 17
MULTIPLIER = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the q-gram at every position, by doubling: h(2n) joins two h(n)."""
    out = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(MULTIPLIER)
    out ^= out >> np.uint64(32)
    width, power = 1, MULTIPLIER
    while width < gram:
        out = out[:-width] * np.uint64(power | 1) + out[width:]
        width *= 2
        power = power * power % (1 << 64)
    out ^= out >> np.uint64(31)
    out *= np.uint64(MULTIPLIER)
    return out


def anchors(data: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(hash, position, first window, last window) of the q-grams that stand for windows."""
    windows = len(data) - span + 1
    if windows < 1:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    reach = span - gram + 1
    parts = []
    for start in range(0, windows, CHUNK):
        stop = min(start + CHUNK, windows)
        hashed = gram_hashes(data[start : stop + span - 1], gram)
        # the position in the low bits makes the leftmost of equal hashes the least
        bits = np.uint64(18)
        low = (hashed >> bits << bits) | np.arange(len(hashed), dtype=np.uint64)
        width = 1
        while width * 2 <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = reach - width
        if rest:
            low = np.minimum(low[: len(low) - rest], low[rest:])
        place = (low & np.uint64((1 << 18) - 1)).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        tails = np.r_[heads[1:], len(place)] - 1
        chosen = place[heads]
        parts.append((hashed[chosen].view(np.int64), chosen + start, heads + start, tails + start))
    hashed, place, first, last = (np.concatenate(p) for p in zip(*parts))
    own = np.r_[True, place[1:] != place[:-1]]  # a run may go on over the border of chunks
    return hashed[own], place[own], first[own], last[np.r_[own[1:], True]]


def _described(span: int, gram: int):
    """Per row: digests and size of its text, and its anchors with their window offsets."""
    names = ["n_bytes", "sha", "digest", "gram", "place", "low", "high"]
    kinds = [pa.int64(), pa.string(), pa.binary(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.int32())] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for text in batch["text"]:
                raw = text.as_py() or b""
                hashed, place, first, last = anchors(np.frombuffer(raw, np.uint8), span, gram)
                row = (
                    len(raw), hashlib.sha256(raw).hexdigest(), hashlib.md5(raw).digest(),
                    hashed, place, place - last, place - first,
                )
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.record_batch(
                [batch["key"], *[pa.array(c, t) for c, t in zip(out, kinds)]], ["key", *names]
            )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: what is left after the removal of its runs of bytes."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for digest, text, starts, ends in zip(*[batch[c] for c in ("digest", "text", "starts", "ends")]):
            raw, done, removed, spans = text.as_py() or b"", 0, 0, 0
            left, stop = hashlib.sha256(), -1
            for start, end in sorted(zip(starts.as_py(), ends.as_py())):
                if start > stop:  # the runs up to here have ended
                    spans += 1
                    left.update(raw[done:start])
                    done = start
                if end > stop:
                    removed += end - max(done, start)
                    done = stop = end
            left.update(raw[done:])
            for column, value in zip(out, (digest.as_py(), removed, spans, left.hexdigest())):
                column.append(value)
        yield pa.record_batch(
            [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3])],
            ["digest", "n_removed", "n_spans", "kept_sha256"],
        )


class Refinement:
    """Ranges of window offsets around anchors, refined level by level.

    A window that starts at w has the offset place - w from its anchor. ``items`` are the
    anchors (item, gram, low, high) with their bytes ``around``, from place - high up to
    place - low + span.
    """

    def __init__(self, items: DataFrame, span: int, gram: int) -> None:
        self.items, self.span, self.reach = items, span, span - gram + 1

    def parts(self, ranges: DataFrame | None, width: int) -> DataFrame:
        """Ranges (item, from, to) split into aligned parts of ``width``, with two digests.

        ``whole`` is the digest of the bytes of all windows of the part that the anchor
        stands for, ``core`` of the bytes that all windows of the part would share.
        """
        if ranges is None:
            rows = self.items.withColumn("from", F.lit(0)).withColumn("to", F.lit(width))
        elif ranges.count() <= BROADCAST_KEYS:
            rows = self.items.join(F.broadcast(ranges), "item")
        else:
            rows = self.items.join(ranges, "item")
        nodes = F.sequence(
            F.floor(F.greatest("low", "from") / width).cast("int"),
            F.floor(F.least("high", F.col("to") - 1) / width).cast("int"),
        )
        rows = rows.where("`from` <= high and to > low").select("item", "gram", "low", "high", "around", F.explode(nodes).alias("node"))
        start = F.col("node") * width
        rows = rows.withColumn("first", F.greatest("low", start)).withColumn("last", F.least("high", start + width - 1))

        def digest(begin: Column, size: Column, *place: str) -> Column:
            label = F.encode(F.concat_ws(":", F.lit(""), *[F.col(c).cast("string") for c in place]), "UTF-8")
            return F.unhex(F.md5(F.concat(F.substring("around", begin + 1, size), label)))

        return rows.select(
            "item",
            "node",
            "first",
            "last",
            digest(F.col("high") - F.col("last"), F.col("last") - F.col("first") + self.span, "gram", "first", "last").alias("whole"),
            digest(F.col("high") - start, F.lit(self.span - width + 1), "gram", "node").alias("core"),
        )

    def level(self, ranges: DataFrame | None, width: int) -> tuple[DataFrame, DataFrame | None]:
        """Repeated parts (item, first, last), and the ranges (item, from, to) still open."""
        parts = materialise(self.parts(ranges, width), "parts")
        buckets = parts.groupBy("whole", "core").agg(F.min("item").alias("witness"), F.count("*").alias("n"))
        buckets = materialise(buckets, "buckets")
        twice = buckets.where("n > 1").select("whole")
        repeated = parts.join(twice, "whole", "left_semi").select("item", "first", "last")
        if width == 1:
            return repeated, None
        shared = buckets.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1")
        open_ = buckets.join(shared.select("core"), "core", "left_semi")
        open_ = open_.select("whole", F.col("witness").alias("item"))
        ranges = parts.join(open_, ["whole", "item"], "left_semi").select(
            "item", (F.col("node") * width).alias("from"), (F.col("node") * width + width).alias("to")
        )
        return repeated, materialise(ranges, "ranges")

    def repeated(self) -> DataFrame:
        """All repeated runs of windows as (item, first, last) offsets."""
        width = 1
        while width < self.reach:
            width *= WAYS
        found, ranges = self.level(None, width)
        while width > 1:
            width //= WAYS
            more, ranges = self.level(ranges, width)
            found = found.union(more)
        return found


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans and kept_sha256. Only key and text are read."""
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    rows = map_arrow(
        texts,
        _described(span, gram),
        f"key {kind}, n_bytes long, sha string, digest binary, gram array<long>, place array<long>, "
        "low array<int>, high array<int>",
    )
    rows = materialise(rows, "rows")
    places = rows.select("digest", F.explode(F.arrays_zip("gram", "place", "low", "high")).alias("a")).select("digest", "a.*")
    # copies of a text give equal occurrences, so only different ones count
    seen = F.xxhash64("digest", "place")
    grams = places.groupBy("gram").agg(F.min(seen).alias("x"), F.max(seen).alias("y")).where("x <> y").select("gram")
    shared = keep_keys(places, materialise(grams, "grams"), "gram").groupBy("digest", "place", "gram", "low", "high").count()
    by_text = shared.groupBy("digest").agg(F.collect_list(F.struct("gram", "place", "low", "high")).alias("anchors"))
    by_text = materialise(by_text, "anchors")
    wanted = texts.withColumn("digest", F.unhex(F.md5("text")))
    wanted = keep_keys(wanted, by_text.select("digest"), "digest").groupBy("digest").agg(F.first("text").alias("text"))
    sources = materialise(wanted.join(by_text, "digest"), "sources")

    def item(a: Column) -> Column:
        around = F.substring(F.col("text"), (a["place"] - a["high"] + 1).cast("int"), a["high"] - a["low"] + span)
        return F.struct(a["gram"].alias("gram"), a["place"].alias("place"), a["low"].alias("low"), a["high"].alias("high"), around.alias("around"))

    items = sources.select("digest", F.inline(F.transform("anchors", item)))
    items = materialise(items.withColumn("item", F.monotonically_increasing_id()), "items")
    found = Refinement(items.drop("digest", "place"), span, gram).repeated()
    runs = found.join(items.select("item", "digest", "place"), "item").select(
        "digest", (F.col("place") - F.col("last")).alias("start"), (F.col("place") - F.col("first") + span).alias("end")
    )
    runs = runs.distinct().groupBy("digest").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    cut = sources.select("digest", "text").join(runs, "digest").select("digest", "text", "runs.start", "runs.end").toDF(
        "digest", "text", "starts", "ends"
    )
    cut = map_arrow(cut, _cut, "digest binary, n_removed long, n_spans long, kept_sha256 string")
    copies = rows.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    out = rows.select("key", "n_bytes", "sha", "digest").join(copies, "digest", "left").join(cut, "digest", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= span)
    return out.select(
        F.col("key").alias(key),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
