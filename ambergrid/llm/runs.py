"""Periodic runs of words in a text, by a dictionary of basic factors.

A run is a stretch of words with smallest period q (words q apart are the same) that no
neighbouring word extends. The dictionary names the factors of each power-of-two length L:
equal factors of one text have equal names, and the name of a factor of 2L is the rank of
the pair of names of its halves.

* Proposals. For every position the next occurrence of its factor is looked up. If it is q
  words further, L/2 < q <= L, both lie within 2L words and overlap or touch, so the words
  from the position on have period q, and no smaller one: a smaller period would put an
  occurrence in between. Further occurrences stand in arithmetic progression.
* Extension. Neighbouring positions with the same q belong to one run. They are joined; the
  first one is the run's start, the last one plus q + L its end, since a word that went on
  with the period would have been a position with the same q.
* No run is found twice, because a period belongs to one length L. A run of three periods
  holds a position of every phase that has its next occurrence inside, so none is missed.

Factors that occur once in their text leave the dictionary, as longer ones around them
occur once as well. Texts of a batch are put end to end and named together; a factor that
reaches into the next text is never equal to another one. Names are exact (no hashes).

Defined results: NULL and empty texts have no words and no runs, and an empty collapsed
text. Rows are judged one by one, so repeated rows give equal results; an empty table gives
an empty one. Only key and text are read. The largest unit in memory is one text or
``WORDS`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambergrid.llm.common import map_arrow

#: Least length of a run in words, and least number of its periods.
LEAST = 24
TIMES = 3
#: Words that are named together (one text may have more).
WORDS = 1 << 18
#: Words whose numbers a worker keeps; the store starts anew beyond that.
KEPT = 300_000

Run = tuple[int, int, int]


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def find_runs(words: np.ndarray, owner: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Runs (start, length, period) of the numbered words, by start and period.

    ``owner`` numbers the texts that the words belong to, in ascending order; no run
    crosses texts.
    """
    size = len(words)
    found = [np.empty((0, 3), np.int64)]
    longest = int(np.bincount(owner).max()) if size else 0
    place, name = np.arange(size, dtype=np.int64), words.astype(np.int64)
    at = np.full(size + 1, -1, np.int64)
    length = 1
    while len(place) and length < 2 * max(longest // times, 1):
        order = np.sort(name << 32 | place)
        place, name = order & 0xFFFFFFFF, order >> 32
        same = name[1:] == name[:-1]
        if length == 1:
            same &= owner[place[1:]] == owner[place[:-1]]
        gap = place[1:] - place[:-1]
        near = np.flatnonzero(same & (gap <= length) & (2 * gap > length))
        if len(near):
            first, period = place[near], gap[near]
            line = np.argsort(first)
            first, period = first[line], period[line]
            heads = np.flatnonzero(np.r_[True, (first[1:] != first[:-1] + 1) | (period[1:] != period[:-1])])
            tails = np.r_[heads[1:], len(first)] - 1
            start, period = first[heads], period[heads]
            reach = first[tails] + period + length - start
            good = (reach >= least) & (reach >= times * period)
            found.append(np.stack([start[good], reach[good], period[good]], axis=1))
        again = np.r_[same, False] | np.r_[False, same]
        name = np.cumsum(np.r_[True, ~same]) if len(place) else name
        place, name = place[again], name[again]
        # the name of twice the length: the pair of names of both halves
        at[place] = name
        second = at[np.minimum(place + length, size)]
        at[place] = -1
        whole = second >= 0
        place = place[whole]
        name = np.unique(name[whole] << 32 | second[whole], return_inverse=True)[1].astype(np.int64)
        length *= 2
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, of every run only the first period."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return b" ".join([words[k] for k in np.flatnonzero(~gone).tolist()])


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _described(least: int, times: int):
    """Per row: its runs and its collapsed text."""

    def solve(texts: list[list[bytes]], known: Numbers) -> list[list[Run]]:
        ends = np.cumsum([len(words) for words in texts])
        ids = np.fromiter((known[w] for words in texts for w in words), np.int64, int(ends[-1]))
        owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        runs = find_runs(ids, owner, least, times)
        out: list[list[Run]] = [[] for _ in texts]
        starts = ends - np.diff(ends, prepend=0)
        for run, text in zip(runs.tolist(), owner[runs[:, 0]].tolist()):
            out[text].append((run[0] - int(starts[text]), run[1], run[2]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Numbers()
        for batch in batches:
            begin, pending, texts = 0, 0, []
            for k, text in enumerate(batch["text"]):
                texts.append((text.as_py() or b"").split())
                pending += len(texts[-1])
                if pending >= WORDS or k == len(batch) - 1:
                    if len(known) > KEPT:
                        known.clear()
                    runs = solve(texts, known)
                    rows = [[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs]
                    left = [collapsed(words, found).decode("utf-8", "replace") for words, found in zip(texts, runs)]
                    yield pa.record_batch(
                        [batch["key"].slice(begin, len(texts)), pa.array(rows, RUNS), pa.array(left, pa.string())],
                        ["key", "runs", "collapsed"],
                    )
                    begin, pending, texts = k + 1, 0, []

    return run


def periodic_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES
) -> DataFrame:
    """Per row: key, runs (start, length, period by start, then period) and collapsed text.

    Words are maximal stretches without the white space of ASCII, numbered from 0. Runs have
    at least ``least`` words and ``times`` periods (3 or more). In ``collapsed`` the words
    of a run after its first period are left out.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods need not hold a proposing position")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    found = map_arrow(
        rows, _described(least, times), f"key {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    )
    return found.withColumnRenamed("key", key)
