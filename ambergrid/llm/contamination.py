"""Benchmark passages in documents, by a prefix-filtered set join.

Every ``window`` consecutive words of a benchmark item are a record, a shorter item is one
record as a whole. A record's shingles of ``width`` words are its set, and a document holds
the record only if it holds all of them (containment 1), so any single one of them is a
sufficient prefix.

* Rarity. One pass over the documents counts the places of the records' shingles.
* Prefix join. The rarest shingle of each record (ties: smallest hash, then place) is its
  prefix token; records with a shingle that is nowhere leave. A second pass finds the places
  of prefix tokens only and joins them to their records. A common line in a third of all
  texts is thus never joined through its common shingles.
* Bounds. The token's place in the record fixes where the record would begin in the document:
  places before the first or after the last word go (position), and so do records longer than
  what the text has there (length).
* Verification. Every match carries the words around it, so the record's own words are
  compared with an item-sized window of the text. Hashes only propose.

The hashes of the records' shingles go to the tasks while they are counted as at most
``SENT`` (16 MB); beyond it the documents' shingles are joined with them by a shuffle, as bare
hashes. All later tables hold matches only.

Defined results: NULL and empty texts have no words, are never hit and hit nothing; a text
without words likewise. Repeated documents are judged row by row. Items with the same
item_id are one item with several texts; a NULL item_id is one item with the empty name.
Empty tables give no hits. Only key and text are read on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambergrid.llm.common import BROADCAST_KEYS, keep_keys, map_arrow
from ambergrid.llm.jaccard import FIRST, SECOND, WordHashes
from ambergrid.session import materialise

WINDOW = 10
WIDTH = 5
#: Most shingle hashes (of 8 bytes) that are sent to every task.
SENT = 1 << 21
#: Most records (of about 120 bytes) that are broadcast to the matches.
SENT_RECORDS = 200_000

#: Bytes of separators become spaces and A-Z is lower-cased: words are digits, a-z and all beyond ASCII.
TABLE = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256)).lower()


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def hash_words(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.frombuffer(b"".join([known[w] for w in words]), "<u8")


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from every place on."""
    out = np.full(max(len(hashes) - width + 1, 0), width, np.uint64)
    for k in range(width):
        out += hashes[k : k + len(out)]
        out *= FIRST
        out ^= out >> np.uint64(29)
    out *= SECOND
    out ^= out >> np.uint64(32)
    return out


def _recorded(window: int, width: int):
    """Records of each item: their words, number of words and shingles."""
    names = ["item", "words", "size", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for item, text in zip(batch["item"], batch["text"]):
                words = split_words(text.as_py())
                if not words:
                    continue
                size = min(window, len(words))
                hashes = shingle_hashes(hash_words(words, known), min(width, size)).view(np.int64)
                starts = range(len(words) - size + 1)
                own = size - min(width, size) + 1
                for low in range(0, len(starts), 1000):
                    part = starts[low : low + 1000]
                    yield pa.record_batch(
                        [
                            pa.array([item.as_py() or ""] * len(part)),
                            pa.array([b" ".join(words[k : k + size]).decode("utf-8", "replace") for k in part]),
                            pa.array([size] * len(part), pa.int32()),
                            pa.array([hashes[k : k + own] for k in part], pa.list_(pa.int64())),
                        ],
                        names,
                    )

    return run


def member(found: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``found`` whose hash is among the sorted ``wanted``."""
    if not len(found) or not len(wanted):
        return np.empty(0, np.int64)
    spots = np.searchsorted(wanted, found)
    return np.flatnonzero(wanted[np.minimum(spots, len(wanted) - 1)] == found)


class Texts:
    """Places of shingles in the documents, looked up in the tasks or by a shuffle."""

    def __init__(self, docs: DataFrame, key: str, text: str, window: int, width: int) -> None:
        self.kind = docs.schema[key].dataType.simpleString()
        self.rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
        self.window, self.width = window, width

    def _wanted(self, shingles: DataFrame, sent: int):
        """The written (width, shingle) as a broadcast, or None if they are too many."""
        if shingles.count() > sent:
            return None
        wanted: dict[int, list[int]] = {}
        for row in shingles.collect():  # at most ``sent`` hashes of benchmark shingles
            wanted.setdefault(row["width"], []).append(row["shingle"])
        arrays = {k: np.sort(np.array(v, np.int64).view(np.uint64)) for k, v in wanted.items()}
        return self.rows.sparkSession.sparkContext.broadcast(arrays)

    def counts(self, shingles: DataFrame, sent: int = SENT) -> DataFrame:
        """(shingle, n) of the written distinct (width, shingle) that are in the documents."""
        shared = self._wanted(shingles, sent)
        if shared is None:
            widths = [row["width"] for row in shingles.select("width").distinct().collect()]  # at most WIDTH
            rows = self.rows.select(F.lit(0).cast("long").alias("row"), "text")
            places = map_arrow(rows, _all_shingles(widths), "row long, shingle long, n long")
            places = places.join(shingles.select("shingle"), "shingle", "left_semi")
        else:
            places = map_arrow(self.rows.select("text"), _counted(shared), "shingle long, n long")
        return places.groupBy("shingle").agg(F.sum("n").alias("n"))

    def hits(self, tokens: DataFrame, sent: int = SENT) -> tuple[DataFrame, DataFrame]:
        """The rows (row, key, n_words) and the places (row, n_words, place, shingle, before, around) of the tokens.

        Beyond ``sent`` tokens the shingles of all texts are joined with them first, as bare hashes,
        and only texts that hold a token are read for places; a row is named by its hash then.
        """
        shared = self._wanted(tokens, sent)
        place = "struct<place: bigint, shingle: bigint, before: int, around: string>"
        schema = f"row long, key {self.kind}, n_words long, hits array<{place}>"
        if shared is not None:
            numbered = self.rows.withColumn("row", F.monotonically_increasing_id())
            found = materialise(map_arrow(numbered, _placed(shared, [], self.window), schema), "places")
            hits = found.where(F.size("hits") > 0).select("row", "n_words", F.inline("hits"))
            return found.select("row", "key", "n_words"), hits
        widths = [row["width"] for row in tokens.select("width").distinct().collect()]  # at most WIDTH
        named = self.rows.withColumn("row", F.xxhash64("key", "text"))
        pairs = map_arrow(named.select("row", "text"), _all_shingles(widths), "row long, shingle long, n long")
        wanted = pairs.join(tokens.select("shingle"), "shingle", "left_semi").select("row").distinct()
        held = keep_keys(named, materialise(wanted, "wanted"), "row")
        hits = map_arrow(held, _placed(None, widths, self.window), schema).select("row", "n_words", F.inline("hits"))
        hits = materialise(hits.join(tokens.select("shingle"), "shingle", "left_semi"), "places")
        rows = materialise(map_arrow(named, _placed(None, [], self.window), schema), "rows")
        return rows.select("row", "key", "n_words"), hits


def _counted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        wanted: dict[int, np.ndarray] = shared.value
        totals = {width: np.zeros(len(hashes), np.int64) for width, hashes in wanted.items()}
        for batch in batches:
            for text in batch["text"]:
                hashes = hash_words(split_words(text.as_py()), known)
                for width, sought in wanted.items():
                    found = shingle_hashes(hashes, width)
                    places = member(found, sought)
                    if len(places):
                        np.add.at(totals[width], np.searchsorted(sought, found[places]), 1)
        for width, total in totals.items():
            met = np.flatnonzero(total)
            yield pa.record_batch([pa.array(wanted[width][met].view(np.int64)), pa.array(total[met])], ["shingle", "n"])

    return run


def _all_shingles(widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for row, text in zip(batch["row"].to_pylist(), batch["text"]):
                hashes = hash_words(split_words(text.as_py()), known)
                for width in widths:
                    found, n = np.unique(shingle_hashes(hashes, width), return_counts=True)
                    yield pa.record_batch(
                        [pa.array(np.full(len(found), row, np.int64)), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))],
                        ["row", "shingle", "n"],
                    )

    return run


PLACES = pa.list_(pa.struct([("place", pa.int64()), ("shingle", pa.int64()), ("before", pa.int32()), ("around", pa.string())]))


def _placed(shared, widths: list[int], window: int):
    """Per row: its number of words, and the places of wanted shingles with the words around.

    Without a broadcast all shingles of the ``widths`` are wanted.
    """

    def places(words: list[bytes], known: WordHashes) -> list[dict]:
        hashes = hash_words(words, known)
        out = []
        for width in shared.value if shared is not None else widths:
            found = shingle_hashes(hashes, width)
            spots = member(found, shared.value[width]) if shared is not None else np.arange(len(found))
            for spot, code in zip(spots.tolist(), found[spots].view(np.int64).tolist()):
                low = max(0, spot - (window - width))
                around = b" ".join(words[low : spot + window]).decode("utf-8", "replace")
                out.append({"place": spot, "shingle": code, "before": spot - low, "around": around})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for start in range(0, len(whole), 256):
                batch = whole.slice(start, 256)
                texts = [split_words(text.as_py()) for text in batch["text"]]
                yield pa.record_batch(
                    [
                        batch["row"],
                        batch["key"],
                        pa.array([len(words) for words in texts], pa.int64()),
                        pa.array([places(words, known) for words in texts], PLACES),
                    ],
                    ["row", "key", "n_words", "hits"],
                )

    return run


class Contamination:
    """Documents against items: ``rows`` (row, key, n_words), ``spans`` and ``records``.

    ``spans`` are the verified places (row, start, size, record) of records in documents;
    ``records`` says which items (record, item) a record belongs to. Both are written.
    """

    def __init__(
        self,
        docs: DataFrame,
        items: DataFrame,
        key: str = "doc_id",
        item: str = "item_id",
        text: str = "text",
        window: int = WINDOW,
        width: int = WIDTH,
        sent: int = SENT,
        sent_records: int = SENT_RECORDS,
    ) -> None:
        if not 0 < width <= window:
            raise ValueError("a shingle must fit a window")
        sources = items.select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("text"))
        found = map_arrow(sources, _recorded(window, width), "item string, words string, size int, shingles array<long>")
        found = materialise(found, "windows")
        distinct = found.groupBy("words").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"))
        records = materialise(distinct.withColumn("record", F.monotonically_increasing_id()), "records")
        self.records = materialise(found.join(records.select("words", "record"), "words").select("record", "item").distinct(), "items")

        texts = Texts(docs, key, text, window, width)
        parts = records.select(
            "record", F.least("size", F.lit(width)).alias("width"), F.posexplode("shingles").alias("offset", "shingle")
        )
        shingles = materialise(parts.select("width", "shingle").distinct(), "shingles")
        counts = materialise(texts.counts(shingles, sent), "rarity")
        rare = Window.partitionBy("record").orderBy("n", "shingle", "offset")
        ranked = parts.join(counts, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        tokens = ranked.withColumn("turn", F.row_number().over(rare)).where("turn = 1 and n > 0")
        tokens = tokens.select("record", "width", "shingle", "offset").join(records.select("record", "words", "size"), "record")
        self.tokens = tokens = materialise(tokens, "tokens")

        prefixes = materialise(tokens.select("width", "shingle").distinct(), "prefixes")
        self.rows, hits = texts.hits(prefixes, sent)
        few = tokens.count() <= sent_records
        joined = hits.join(F.broadcast(tokens) if few else tokens, "shingle")
        start = F.col("place") - F.col("offset")
        joined = joined.withColumn("start", start).where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        around = F.split("around", " ")
        own = F.array_join(F.slice(around, F.col("before") - F.col("offset") + 1, F.col("size")), " ")
        self.spans = materialise(joined.where(own == F.col("words")).select("row", "start", "size", "record").distinct(), "spans")

    def covered(self) -> DataFrame:
        """(row, n_hit): words of a document inside any span."""
        longest = self.spans.groupBy("row", "start").agg(F.max("size").alias("size"))
        before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        end = F.col("start") + F.col("size")
        new = longest.select("row", (end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0)))).alias("new"))
        return new.groupBy("row").agg(F.sum(F.greatest("new", F.lit(0))).alias("n_hit"))

    def items(self) -> DataFrame:
        """(row, items): the sorted names of the items with a span in the document."""
        records = self.records
        if records.count() <= BROADCAST_KEYS:
            records = F.broadcast(records)
        pairs = self.spans.select("row", "record").distinct().join(records, "record").select("row", "item").distinct()
        return pairs.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))

    def report(self, key: str = "doc_id") -> DataFrame:
        """Per document: key, n_words, n_hit and items."""
        found = self.rows.join(self.covered(), "row", "left").join(self.items(), "row", "left")
        hit: Column = F.coalesce("n_hit", F.lit(0)).cast("long")
        none = F.array().cast("array<string>")
        return found.select(F.col("key").alias(key), "n_words", hit.alias("n_hit"), F.coalesce("items", none).alias("items"))
