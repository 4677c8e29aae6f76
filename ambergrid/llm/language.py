"""Language identification with character language models.

One interpolated Kneser-Ney model of order four per language. All models share sorted hash
arrays: per order one array of n-gram hashes and a matrix with one column of log
probabilities per language, and the same for the back-off weights of contexts. A text gets
the language of the lowest cross-entropy per symbol; a calibration part of the training
texts sets the temperature of the score and the cross-entropy above which a prediction is
marked as rejected.

The models are fitted on a bounded sample: about ``sample_chars`` characters of whole
texts per language, chosen by a hash of the key. So the arrays have at most ``sample_chars``
entries per language and order, whatever the size of the input, and may be broadcast. Every
text is scored whole.

Defined results: NULL texts and texts without a letter give ``und`` with score 0; rows with
NULL language or key are never learned from; without any training text all rows are ``und``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambergrid.llm.common import map_arrow
from ambergrid.session import materialise

ORDER = 4
SAMPLE_CHARS = 1_000_000
#: Texts of a language besides those that calibrate, from which on some are held back for it.
LEAST_FITTED = 8
#: Symbols that are scored at once; longer texts go through in slices.
SLICE = 1 << 18
#: Symbol before a text; no letter has this code.
EDGE = 1
UNIFORM = -np.log2(0x110000)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
RESULT = "struct<lang_pred:string,score:double,cross_entropy:double,n_symbols:long,rejected:boolean>"


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """For each code point its lower-case letter, or a blank if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


def normalise(text: str) -> np.ndarray:
    """Symbols of a text: letters, single blanks between words, and ORDER-1 edges before."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    mapped = symbols()[points]
    blank = mapped == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    out = np.full(ORDER - 1 + int(keep.sum()), EDGE, np.uint32)
    out[ORDER - 1 :] = mapped[keep]
    return out


def hashes(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of the n-grams whose k-th symbols are in the k-th array."""
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out += part
        out += np.uint64(1)
        out *= MULTIPLIER
    out ^= out >> np.uint64(31)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts per language of the texts of a task, added up while they are few."""
    found: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, gram, n) for lang, counts in found.items() for gram, n in counts.items()]
        found.clear()
        langs, grams, counts = zip(*rows)
        return pa.record_batch([pa.array(langs), pa.array(grams), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
            line = normalise(text).tobytes().decode("utf-32-le")
            counts = found.setdefault(lang, Counter())
            counts.update(line[i : i + ORDER] for i in range(len(line) - ORDER + 1))
            if sum(map(len, found.values())) > 500_000:
                yield flush()
    if any(found.values()):
        yield flush()


class Models:
    """The models of all languages in shared sorted hash arrays."""

    def __init__(self, grams: pd.DataFrame) -> None:
        self.langs = sorted(grams["lang"].unique())
        tables = [self._fit(grams[grams["lang"] == lang]) for lang in self.langs]
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        self.floor = np.array([t[2] for t in tables])
        strings: list[np.ndarray] = []
        for order in range(ORDER):
            strings.append(np.unique(np.concatenate([t[0][order][0] for t in tables])) if tables else np.array([]))
        for order in range(1, ORDER + 1):
            names = strings[order - 1]
            values = np.stack([self._full(t, names, order) for t in tables], 1)
            self.grams.append(self._sorted(names, order, values))
            contexts = np.unique(np.concatenate([t[1][order - 1][0] for t in tables]))
            weights = np.stack([self._weight(t, contexts, order) for t in tables], 1)
            self.contexts.append(self._sorted(contexts, order - 1, weights))
        self.temperature = 0.05
        self.limits = np.full(len(self.langs), np.inf)

    @staticmethod
    def _fit(grams: pd.DataFrame):
        """Discounted probabilities and back-off weights of one language by order."""
        names, counts = grams["gram"].to_numpy(str), grams["n"].to_numpy(float)
        probabilities, weights = [None] * ORDER, [None] * ORDER
        floor = UNIFORM
        for order in range(ORDER, 0, -1):
            if order < ORDER:  # continuation counts: distinct symbols before
                tails = np.array([n[1:] for n in names], dtype=str)
                names, counts = np.unique(tails, return_counts=True)
                counts = counts.astype(float)
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
            heads = np.array([n[:-1] for n in names], dtype=str) if order > 1 else np.full(len(names), "")
            contexts, which = np.unique(heads, return_inverse=True)
            totals = np.bincount(which, counts)
            kinds = np.bincount(which)
            at = np.argsort(names)
            probabilities[order - 1] = (names[at], ((counts - discount) / totals[which])[at])
            weights[order - 1] = (contexts, discount * kinds / totals)
            if order == 1:
                floor = np.log2(weights[0][1][0]) + UNIFORM
        return probabilities, weights, floor

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return at, keys[at] == wanted

    def _full(self, table, names: np.ndarray, order: int) -> np.ndarray:
        """Interpolated log2 probability of any n-gram, seen in the language or not."""
        probabilities, weights, _ = table
        keys, values = probabilities[order - 1]
        at, seen = self._find(keys, names)
        own = np.where(seen, values[at], 0.0)
        if order == 1:
            return np.log2(own + weights[0][1][0] * 2.0**UNIFORM)
        lower = 2.0 ** self._full(table, np.array([n[1:] for n in names], dtype=str), order - 1)
        return np.log2(own + 2.0 ** self._weight(table, np.array([n[:-1] for n in names], dtype=str), order) * lower)

    def _weight(self, table, contexts: np.ndarray, order: int) -> np.ndarray:
        keys, values = table[1][order - 1]
        at, seen = self._find(keys, contexts)
        return np.log2(np.where(seen, values[at], 1.0))

    @staticmethod
    def _sorted(names: np.ndarray, order: int, values: np.ndarray):
        if order == 0:
            return np.zeros(1, np.uint64), values.astype(np.float32)
        points = np.array([[ord(c) for c in n] for n in names.tolist()], np.uint32).reshape(-1, order)
        keys = hashes(list(points.T))
        at = np.argsort(keys)
        return keys[at], values[at].astype(np.float32)

    def log_probabilities(self, parts: list[np.ndarray]) -> np.ndarray:
        """log2 P(last symbol | the ones before) per position and language."""
        order = len(parts)
        keys, values = self.grams[order - 1]
        at, seen = self._find(keys, hashes(parts))
        out = values[at]
        if seen.all():
            return out
        missed = np.flatnonzero(~seen)
        if order == 1:
            out[missed] = self.floor
            return out
        rest = [p[missed] for p in parts]
        lower = self.log_probabilities(rest[1:])
        keys, weights = self.contexts[order - 1]
        at, seen = self._find(keys, hashes(rest[:-1]))
        out[missed] = lower + np.where(seen[:, None], weights[at], 0.0)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol (texts x languages), and the numbers of symbols."""
        totals, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = []
        owners: list[int] = []
        pending = 0

        def flush() -> None:
            nonlocal pending
            if held:
                line = held[0] if len(held) == 1 else np.concatenate(held)
                owner = np.repeat(np.array(owners), [len(h) for h in held])
                for start in range(0, len(line) - ORDER + 1, SLICE):
                    end = min(start + SLICE, len(line) - ORDER + 1)
                    real = np.flatnonzero(line[start + ORDER - 1 : end + ORDER - 1] != EDGE) + start
                    if not len(real):
                        continue
                    found = self.log_probabilities([line[real + k] for k in range(ORDER)])
                    rows = owner[real + ORDER - 1]
                    heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                    totals[rows[heads]] -= np.add.reduceat(found, heads, axis=0, dtype=np.float64)
            held.clear()
            owners.clear()
            pending = 0

        for k, text in enumerate(texts):
            if not text:
                continue
            line = normalise(text)
            letters = line[line > 32]
            if not len(letters):
                continue
            sizes[k] = len(line) - ORDER + 1
            held.append(line)
            owners.append(k)
            pending += len(line)
            if pending >= SLICE:
                flush()
        flush()
        return totals / np.maximum(sizes, 1)[:, None], sizes

    def posterior(self, entropy: np.ndarray, sizes: np.ndarray, temperature: float) -> np.ndarray:
        """Probability of each language: the total log likelihoods, tempered."""
        exponent = -entropy * np.minimum(sizes, 1000)[:, None] * temperature * np.log(2.0)
        exponent -= exponent.max(1, keepdims=True)
        grown = np.exp(exponent)
        return grown / grown.sum(1, keepdims=True)

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Temperature of the best log likelihood, and per language the usual entropy plus six deviations."""
        entropy, sizes = self.entropies(texts)
        which = np.array([self.langs.index(lang) if lang in self.langs else -1 for lang in langs])
        usable = (sizes > 0) & (which >= 0)
        entropy, sizes, which = entropy[usable], sizes[usable], which[usable]
        if not len(which):
            return
        at = np.arange(len(which))
        grid = [0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0]
        self.temperature = max(
            grid, key=lambda t: np.log(np.maximum(self.posterior(entropy, sizes, t)[at, which], 1e-9)).sum()
        )
        for k in range(len(self.langs)):
            own = entropy[(which == k) & (sizes >= 100), k]
            if len(own) >= 10:
                self.limits[k] = own.mean() + 6 * max(own.std(), 0.05)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        entropy, sizes = self.entropies(texts)
        rows = np.arange(len(texts))
        best = entropy.argmin(1) if self.langs else np.zeros(len(texts), int)
        empty = sizes == 0
        low = entropy[rows, best]
        chance = self.posterior(entropy, sizes, self.temperature)[rows, best]
        names = np.array(self.langs, dtype=object)[best]
        names[empty] = "und"
        return pd.DataFrame(
            {
                "lang_pred": names,
                "score": np.where(empty, 0.0, chance),
                "cross_entropy": np.where(empty, None, low),
                "n_symbols": sizes,
                "rejected": empty | (low > self.limits[best]),
            }
        )


def windows(text: Column, chars: int, pieces: int = 16) -> Column:
    """A text of more than ``chars`` characters as windows of that length together, spread over the whole of it."""
    width = max(chars // pieces, 1)
    step = (F.length(text) - width) / max(pieces - 1, 1)
    starts = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: F.floor(k * step).cast("int") + 1)
    return F.when(
        F.length(text) > chars, F.array_join(F.transform(starts, lambda at: F.substring(text, at, F.lit(width))), " ")
    ).otherwise(text)


def fit(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Models | None:
    """Models learned from docs (key, text, lang), all of which may be learned from.

    Two passes: characters per language and range of hashes, which tell how far the first texts
    in hash order reach ``sample_chars``, and the n-gram counts of the chosen texts, which Spark
    adds up. So every language has a text at least; one longer than the bound is read in windows
    spread over it. One in eight chosen texts calibrates, where a language has enough others.
    """
    usable = docs.select("key", "text", "lang").where("key is not null and text is not null and lang is not null")
    # texts without a letter cannot be learned from and shall not stand for their language
    usable = usable.where(F.col("text").rlike(r"\p{L}"))
    # 64 ranges to a doubling of the draw: the last range taken holds about a hundredth of the bound
    draw = F.xxhash64("key", F.lit("sample")).bitwiseAND((1 << 52) - 1) + 1
    usable = usable.withColumn("reach", F.floor(F.log2(draw.cast("double")) * 64).cast("int"))
    ranges = usable.groupBy("lang", "reach").agg(
        F.sum(F.least(F.length("text"), F.lit(sample_chars)).cast("double")).alias("chars")
    )
    before = F.sum("chars").over(Window.partitionBy("lang").orderBy("reach")) - F.col("chars")
    reached = ranges.withColumn("before", before).where(F.col("before") < sample_chars)
    ends = [(r["lang"], r["end"]) for r in reached.groupBy("lang").agg(F.max("reach").alias("end")).collect()]
    if not ends:
        return None
    end = F.create_map(*[F.lit(x) for pair in ends for x in pair])[F.col("lang")]
    part = F.pmod(F.xxhash64("key", F.lit("part")), F.lit(8))
    chosen = materialise(
        usable.where(F.col("reach") <= end).select("lang", windows(F.col("text"), sample_chars).alias("text"), part.alias("part")),
        "lid",
    )
    others = chosen.groupBy("lang").agg(F.count(F.when(F.col("part") > 0, 1)).alias("n"))
    few = [r["lang"] for r in others.where(F.col("n") < LEAST_FITTED).collect()]
    # only where the others are enough for the fit
    chosen = chosen.withColumn("part", F.when(F.col("lang").isin(few), F.lit(1)).otherwise(F.col("part")))
    counted = map_arrow(chosen.where("part > 0").select("lang", "text"), _counts, "lang string, gram string, n long")
    grams = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if grams.empty:
        return None
    models = Models(grams)
    held = chosen.where("part = 0").select("text", "lang").toPandas()
    models.calibrate(held["text"].tolist(), held["lang"].tolist())
    return models


def identify(text: Column, models: Models | None, spark) -> Column:
    """Struct (lang_pred, score, cross_entropy, n_symbols, rejected) of a text column."""
    if models is None:
        return F.expr(f"from_json('{{\"lang_pred\":\"und\",\"score\":0.0,\"n_symbols\":0,\"rejected\":true}}', '{RESULT[7:-1].replace(':', ' ')}')")
    shared = spark.sparkContext.broadcast(models)

    def predict(texts: pd.Series) -> pd.DataFrame:
        return shared.value.predict(texts.tolist())

    return F.pandas_udf(predict, RESULT)(text)
