"""Spelling variants of the words of a corpus, by a bit-sliced position index.

* Counting. Runs of letters are counted in the map tasks and summed; words that occur
  often enough are the vocabulary.
* Blocks. If one letter of a word of m letters is replaced, or one is put in, the first
  m // 2 or the last m // 2 letters stay as they are. So words of m and m + 1 letters meet
  in blocks by their first and by their last m // 2 letters; pairs with equal first letters
  are left to the former. Blocks above ``CHUNK`` words are cut into pieces, and every
  piece of queries meets every piece of the index in a tile of its own.
* Index. In a tile a bitset per (position, letter) holds the words with that letter there.
  Reading a query letter by letter, one recurrence of whole-bitset operations each keeps
  the words that match so far (zero errors) and those that match with one letter replaced,
  one letter more (bitsets of the next position) or one letter less (of the one before).
  Words stand in the order of falling counts, so a query's best form is the lowest bit and
  the number of near words is the number of bits: no list of pairs is made.
* Roots. Counts grow along forms, so chains are short; they are followed by doubling.

Defined results: NULL and empty texts have no words; a NULL key counts as the empty string
where the key's hash is asked for; repeated rows count again. Extra columns are not read.
Words with equal counts are taken in code-point order. An empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambergrid.llm.common import BROADCAST_KEYS, map_arrow
from ambergrid.session import materialise

#: Least length (code points) and number of occurrences of a word of the vocabulary.
LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A form occurs at least this many times as often as the word.
RATIO = 5
#: Words of a piece of a block.
CHUNK = 1 << 14
#: Different words that a counting task keeps before it sends their counts.
KEPT = 100_000
#: Rows of a task that reads tiles.
TILE_ROWS = 100_000

LETTERS = re.compile("[a-zÀ-ÿ]+")


def _counted(least: int, every: int | None):
    """Counts of the words of a task's texts, sent in parts."""

    def words(key: str, text: bytes) -> Iterator[tuple[str, int]]:
        seed = zlib.crc32(key.encode() + b":")
        for word, n in Counter(LETTERS.findall(text.lower().decode("utf-8", "replace"))).items():
            if len(word) >= least:
                code = zlib.crc32(word.encode(), seed) if every else 1
                if every and code % every == 0:
                    gone = code % len(word)
                    word = word[:gone] + word[gone + 1 :]
                    if len(word) < least:
                        continue
                yield word, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def sent() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                for word, n in words(key.as_py() or "", text.as_py() or b""):
                    counts[word] = counts.get(word, 0) + n
                if len(counts) >= KEPT:
                    yield sent()
        if counts:
            yield sent()

    return run


def vocabulary(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = LEAST_LENGTH,
    times: int = LEAST_COUNT,
    every: int | None = None,
) -> DataFrame:
    """Words (word, n) of at least ``least`` code points that occur at least ``times`` times.

    A word is a maximal run of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. With
    ``every``, a word whose crc32 h of ``<key>:<word>`` it divides loses the code point
    h % length: known misspellings, as a check of the operator.
    """
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("text"))
    counted = map_arrow(rows, _counted(least, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


class PositionIndex:
    """Bitsets over words: per position and letter, per length, and per first letters."""

    def __init__(self, words: list[str], half: int) -> None:
        self.places: list[dict[str, int]] = [{} for _ in range(max(map(len, words), default=0) + 2)]
        self.lengths: dict[int, int] = {}
        self.starts: dict[str, int] = {}
        self.all = (1 << len(words)) - 1
        for k, word in enumerate(words):
            bit = 1 << k
            for place, letter in zip(self.places, word):
                place[letter] = place.get(letter, 0) | bit
            self.lengths[len(word)] = self.lengths.get(len(word), 0) | bit
            self.starts[word[:half]] = self.starts.get(word[:half], 0) | bit

    def near(self, word: str) -> tuple[int, int, int]:
        """Words with one letter replaced, one letter more and one letter less, as bitsets."""
        exact, swapped, longer, shorter = self.all, 0, 0, 0
        before: dict[str, int] = {}
        places = self.places
        last = len(places) - 2
        for k, letter in enumerate(word):
            if k > last:  # longer by two than any word
                return 0, 0, 0
            here, after = places[k].get(letter, 0), places[k + 1].get(letter, 0)
            match = exact & here
            swapped = swapped & here | exact ^ match
            shorter = shorter & before.get(letter, 0) | exact
            longer = (longer | exact) & after
            exact = match
            before = places[k]
            if not (exact or swapped or longer or shorter):
                return 0, 0, 0
        size = len(word)
        lengths = self.lengths
        return swapped & lengths.get(size, 0), (longer | exact) & lengths.get(size + 1, 0), shorter & lengths.get(size - 1, 0)


FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per query of each tile: the number of near words and the most frequent one.

    Rows (ends, m, part, q, i, word, n, indexed, asked) come sorted by tile, falling n and word.
    """

    def solve(tile: tuple, rows: list[tuple]) -> Iterator[tuple]:
        ends, size, *_ = tile
        half = size // 2
        indexed = [(word, n) for word, n, known, _ in rows if known]
        index = PositionIndex([word for word, _ in indexed], half)
        for word, _, _, asked in rows:
            if asked:
                swapped, longer, shorter = index.near(word)
                near = swapped | longer if len(word) == size else shorter
                if ends and near:  # equal first letters are met in another block
                    near ^= near & index.starts.get(word[:half], 0)
                if near:
                    best, n = indexed[(near & -near).bit_length() - 1]
                    yield word, near.bit_count(), n, best

    def results() -> Iterator[tuple]:
        tile, rows = None, []
        for batch in batches:
            for *at, word, n, known, asked in zip(*[column.to_pylist() for column in batch.columns]):
                if at != tile:
                    yield from solve(tile, rows) if rows else ()
                    tile, rows = at, []
                rows.append((word, n, known, asked))
        if rows:
            yield from solve(tile, rows)

    out: list[tuple] = []
    for row in results():
        out.append(row)
        if len(out) == 10_000:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), FOUND.types)], schema=FOUND)
            out = []
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), FOUND.types)], schema=FOUND)


def near_words(words: DataFrame, least: int = LEAST_LENGTH, chunk: int = CHUNK) -> DataFrame:
    """(word, n_near, best_n, best) of the written words (word, n) that have a near word.

    Two words are near if they differ by one inserted, deleted or replaced code point;
    ``best`` is the near word of largest n, the smallest of equals.
    """
    spark = words.sparkSession
    size = F.length("word")
    sizes = F.filter(F.array(size, size - 1), lambda m: m >= least)
    rows = words.select("word", "n", F.explode(sizes).alias("m"))
    half = F.floor(F.col("m") / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(False).alias("ends"), F.col("word").substr(F.lit(1), half).alias("part")),
        F.struct(F.lit(True).alias("ends"), F.col("word").substr(F.length("word") - half + 1, half).alias("part")),
    )
    block = ["ends", "m", "part"]
    rows = rows.select("word", "n", "m", F.inline(parts))
    full = rows.groupBy(*block).agg(F.count("*").alias("full")).where("full > 1")
    full = materialise(full, "blocks")
    rows = rows.join(F.broadcast(full) if full.count() <= BROADCAST_KEYS else full, block)
    pieces = F.ceil(F.col("full") / chunk).cast("int")
    own = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")
    others = F.sequence(F.lit(0), F.col("pieces") - 1)

    def tile(q, i, indexed: bool, asked: bool):
        return F.struct(q.alias("q"), i.alias("i"), F.lit(indexed).alias("indexed"), F.lit(asked).alias("asked"))

    tiles = F.when(F.col("pieces") == 1, F.array(tile(F.lit(0), F.lit(0), True, True))).otherwise(
        F.concat(
            F.transform(others, lambda q: tile(q, F.col("own"), True, False)),
            F.transform(others, lambda i: tile(F.col("own"), i, False, True)),
        )
    )
    rows = rows.withColumn("pieces", pieces).withColumn("own", own)
    rows = rows.select(*block, "word", "n", F.inline(tiles)).select(*block, "q", "i", "word", "n", "indexed", "asked")
    rows = materialise(rows, "tiles")
    deal = max(spark.sparkContext.defaultParallelism, -(-rows.count() // TILE_ROWS))
    dealt = rows.repartition(deal, *block, "q", "i").sortWithinPartitions(*block, "q", "i", F.desc("n"), "word")
    found = map_arrow(dealt, _tiles, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top"))
    return merged.select("word", "n_near", (-F.col("top.less")).alias("best_n"), "top.best")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for links (word, form) without cycles, one per word, by doubling."""
    current = materialise(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        onward = F.broadcast(onward) if onward.count() <= BROADCAST_KEYS else onward
        moved = current.join(onward, "root", "left")
        moved = materialise(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")), "roots")
        current = moved.select("word", "root")
        if not moved.where("more").limit(1).count():
            return current


def spelling_forms(words: DataFrame, least: int = LEAST_LENGTH, ratio: int = RATIO, chunk: int = CHUNK) -> DataFrame:
    """Words (word, n) with form, root, n_near and form_n.

    The form of a word is its most frequent near word (the smallest of equals), if that one
    occurs at least ``ratio`` (2 or more) times as often; the root is the last of the forms
    that follow each other, the word itself if it has none.
    """
    if ratio < 2:
        raise ValueError("forms must grow")
    words = materialise(words.select("word", "n"), "words")
    near = near_words(words, least, chunk)
    good = F.col("best_n") >= ratio * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best")).alias("form"),
        F.when(good, F.col("best_n")).alias("form_n"),
    )
    formed = materialise(formed, "forms")
    rooted = roots(formed.where("form is not null"))
    out = formed.join(rooted, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
