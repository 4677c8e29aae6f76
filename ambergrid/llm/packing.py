"""Order-preserving packing into sequences by dynamic programming.

Documents are tokenised and laid end to end, in the order of the rows of a task. Windows of
at most ``LENGTH`` tokens are cut from that line. A cut may fall at the end of a document
(free), at the end of a sentence or at any other token (truncation penalties). With f(j)
the least cost of the line up to cut j, padding to LENGTH makes

    f(j) = penalty(j) + LENGTH - place(j) + min over i of (f(i) + place(i)),

where i runs over the cuts at most LENGTH tokens before j: a sliding minimum, kept by a
monotone queue in constant time per cut. Windows whose length is a power of two need no
padding and are tried by looking up the cut that far back.

The line is solved in blocks of about ``BLOCK`` tokens: all windows but the last are
written and the rest begins the next block, so a task holds one block, whatever it reads.
Tasks are independent; each leaves at most one short window. Sequence numbers join the
task's number and a counter. A task that runs again reads the same rows of the same files
and gives the same pieces.

Tokens: a text's ids come from the given tokenizer without special tokens, then one end
id. White space never joins two ids of that tokenizer, so ids are kept per stretch between
white space; new stretches are split into words and merged by rank, which gives the same
ids as the tokenizer's own code (tests compare them). Texts with unusual characters go
through the tokenizer itself.

Defined results: a NULL or empty text is one end id; repeated rows are packed each on its
own; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.taskcontext import TaskContext

from ambergrid.llm.common import map_arrow

LENGTH = 4096
BLOCK = 1 << 18
END_ID = 2
#: Penalties, in tokens of padding: a cut inside a document at a sentence end, or elsewhere.
SENTENCE_CUT = 24.0
HARD_CUT = 160.0
#: Stretches kept per worker; the store starts anew beyond that.
KEPT = 400_000

#: Characters for which words, letters and white space are the same to Python and the tokenizer:
#: printable ASCII, Latin letters, common punctuation, and the plain white space.
PLAIN = re.compile(
    "[\\t\\n\\r\\x20-\\x7e¡-©«-±´¶-¸»¿-įı-ɏ"
    "‐-―‘-‟†-•…‰€]*"
)
#: The tokenizer's word pattern for such texts, in lower case.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class Tokens:
    """Ids of texts for a byte-pair tokenizer with word ends, which ignores white space."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in kept]
        back = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {}
        for name, rank in vocabulary.items():
            ends = name.endswith("</w>") and name != "</w>"
            body = name[:-4] if ends else name
            chars = bytes(back[c] for c in body if c in back)
            # byte 0 stands for the end of a word: no plain text has it
            if len(chars) == len(body) and (b"\0" not in chars or chars == b"\0"):
                ranks[chars + (b"\0" if ends else b"")] = rank
        self.merge = tiktoken.Encoding(
            "words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self.known: dict[str, bytes] = {}
        names = {rank: name.removesuffix("</w>") for name, rank in vocabulary.items()}
        self.closes = np.array([names.get(k, "")[-1:] in (".", "!", "?") for k in range(max(names) + 1)])

    @cached_property
    def exact(self):
        """The tokenizer itself, read when a text first needs it: few workers do."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def stretch(self, chars: str) -> bytes:
        found = WORDS.findall(chars.lower())
        return np.array(self.merge("\0".join([*found, ""])), "<u4").tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of one document, the end id included."""
        if not text:
            return np.array([END_ID], "<u4")
        if "<|" in text or PLAIN.fullmatch(text) is None:
            return np.array([*self.exact.encode(text, add_special_tokens=False).ids, END_ID], "<u4")
        known = self.known
        parts = text.split()
        try:
            found = b"".join([known[part] for part in parts])
        except KeyError:
            if len(known) > KEPT:
                known.clear()
            for part in parts:
                if part not in known:
                    known[part] = self.stretch(part)
            found = b"".join([known[part] for part in parts])
        return np.frombuffer(found + END_ID.to_bytes(4, "little"), "<u4")


def cuts(places: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> list[int]:
    """Places of the best cuts, the last one included.

    ``places`` are increasing and at most ``length`` apart, the first within ``length`` of 0.
    """
    spots = [0, *places.tolist()]
    prices = [0.0, *penalties.tolist()]
    at = {place: k for k, place in enumerate(spots)}
    powers = [1 << k for k in range(length.bit_length() - 2, 5, -1)]
    cost = [0.0] * len(spots)
    back = [0] * len(spots)
    queue: deque[int] = deque([0])
    key = [0.0] * len(spots)
    for j in range(1, len(spots)):
        place = spots[j]
        while place - spots[queue[0]] > length:
            queue.popleft()
        best = queue[0]
        least = key[best] + length - place
        for power in powers:
            i = at.get(place - power)
            if i is not None and cost[i] < least:
                least, best = cost[i], i
        cost[j] = least + prices[j]
        back[j] = best
        key[j] = cost[j] + place
        while queue and key[queue[-1]] >= key[j]:
            queue.pop()
        queue.append(j)
    found, j = [], len(spots) - 1
    while j > 0:
        found.append(spots[j])
        j = back[j]
    return found[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, closes: np.ndarray, length: int = LENGTH):
    """Places where the line may be cut, and their penalties."""
    size = len(ids)
    price = np.full(size + 1, np.inf)
    price[np.flatnonzero(closes[np.minimum(ids, len(closes) - 1)]) + 1] = SENTENCE_CUT
    price[ends] = 0.0
    price[size] = 0.0
    places = np.flatnonzero(np.isfinite(price[1:])) + 1
    # long stretches without a cut get hard ones, so that every window can be filled
    gaps = np.diff(places, prepend=0)
    for place, gap in zip(places[gaps > length // 8], gaps[gaps > length // 8]):
        hard = np.arange(place - gap + length // 64, place, length // 64)
        price[hard] = np.minimum(price[hard], HARD_CUT)
    places = np.flatnonzero(np.isfinite(price[1:])) + 1
    return places, price[places]


def packer(path: str, columns: list[str], types: list[pa.DataType]):
    """Task function: batches of (columns..., text) to pieces."""
    names = [*columns, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kinds = [*types, *[pa.int64()] * 6, pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path)
        first = TaskContext.get().partitionId() << 33
        number = 0
        line: list[tuple[tuple, np.ndarray, int]] = []  # key, ids and first open id of each document
        pending = 0

        def solve(last: bool) -> pa.RecordBatch:
            nonlocal line, pending, number
            ids = np.concatenate([d[1][d[2] :] for d in line])
            ends = np.cumsum([len(d[1]) - d[2] for d in line])
            places, penalties = candidates(ids, ends, tokens.closes)
            found = cuts(places, penalties)
            if not last and len(found) > 1:
                found = found[:-1]
            bounds = np.unique(np.concatenate([[0], found, ends[ends < found[-1]]]))
            begins = np.array([0, *found])
            out: list[list] = [[] for _ in names]
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                k = int(np.searchsorted(ends, low, "right"))
                keys, all_ids, open_ = line[k]
                begin = int(ends[k]) - (len(all_ids) - open_)
                window = int(np.searchsorted(begins, low, "right")) - 1
                piece = ids[low:high]
                row = (*keys, open_ + low - begin, high - low, zlib.crc32(piece.tobytes()), len(all_ids),
                       first + number + window, low - int(begins[window]), piece.astype(np.int32))
                for column, value in zip(out, row):
                    column.append(value)
            number += len(found)
            done = found[-1]
            k = int(np.searchsorted(ends, done, "right"))
            rest = []
            for at in range(k, len(line)):
                keys, all_ids, open_ = line[at]
                begin = int(ends[at]) - (len(all_ids) - open_)
                rest.append((keys, all_ids, open_ + max(0, done - begin)))
            line = rest
            pending = int(ends[-1]) - done
            return pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds)], names)

        for whole in batches:
            for begin in range(0, len(whole), 256):  # few texts at a time, as they may be long
                batch = whole.slice(begin, 256)
                keys = zip(*[batch[c].to_pylist() for c in columns])
                for key, text in zip(keys, batch["text"].to_pylist()):
                    ids = tokens.ids(text)
                    line.append((key, ids, 0))
                    pending += len(ids)
                    while pending >= BLOCK:
                        yield solve(False)
        if line:
            yield solve(True)

    return run


def pack(docs: DataFrame, path: str, columns: list[str], text: str = "text") -> DataFrame:
    """Pieces: the given columns, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids."""
    rows = docs.select(*columns, F.col(text).alias("text"))
    types = [to_arrow_type(rows.schema[c].dataType) for c in columns]
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    schema = (
        f"{kept}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, ids array<int>"
    )
    return map_arrow(rows, packer(path, columns, types), schema)
