"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Each text gets a vector of transformed statistics: log mean word length and the square
roots of its shares of symbols, repeated lines and words in repeated windows. Per language
and source the minimum-covariance-determinant estimate of centre and scatter is found by
concentration steps over all rows, and a text is rejected when its robust squared
Mahalanobis distance exceeds a quantile of the chi-square law.

One step is one aggregate: rows are counted and their moments summed per group and bucket
of distance, and the buckets nearest to the centre are taken until they hold the wanted
share. So no group is sorted or gathered, however many rows it has. Vectors are whole
thousandths and sums are exact decimals, hence results do not depend on partitioning.

Groups of fewer than ``least`` rows are pooled per language, and pools that are still
small across languages; a last pool that is still small is judged by the estimate over all
rows. NULL languages and sources are groups of their own. The estimated scatter is used as
it is; only where it is less than the noise of counting, which no scatter of ordinary texts
can be, that noise takes its place (``floors``).

Defined results: a NULL or empty text has no words and fails the base rules; repeated rows
get equal results; the base rules come first, and a text that fails them is not kept and
takes no part in the estimate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ambergrid.llm.common import BROADCAST_KEYS, SPACE, let, words
from ambergrid.session import materialise

#: Statistics of the vector: what each is a share of (length: counted in), and how many of it come at once.
#: A repeat is two windows of three words.
STATISTICS = {"length": ("word_chars", 4), "symbols": ("word_chars", 1), "lines": ("n_lines", 1), "repeats": ("n_words", 6)}
COUNTED = ["word_chars", "n_lines", "n_words"]
#: Share of the rows that the estimate concentrates on.
CORE = 0.75
#: Probability beyond which a distance is an outlier.
TAIL = 1e-3
STEPS = 4
UNIT = 1000.0
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def repeat_words(found: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the array."""

    def covered(places: Column) -> Column:
        gaps = F.transform(
            places, lambda p, k: F.when(k > 0, F.least(F.lit(3), p - places[F.greatest(k - 1, F.lit(0))])).otherwise(3)
        )
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def twins(order: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            before = (k > 0) & (order[F.greatest(k - 1, F.lit(0))].h == x.h)
            after = (k + 1 < F.size(order)) & (order[F.least(k + 1, F.size(order) - 1)].h == x.h)
            return before | after

        return F.sort_array(F.transform(F.filter(order, twin), lambda x: x.k))

    def windows(w: Column) -> Column:
        hashed = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda k: F.xxhash64(w[k], w[k + 1], w[k + 2])
        )
        return let(
            hashed,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
                let(
                    twins_of(h),
                    covered,
                )
            ),
        )

    def twins_of(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("k"))))
        return let(pairs, twins)

    return let(found, lambda w: F.when(F.size(w) < 3, 0).otherwise(windows(w)))


def statistics(text: Column) -> list[Column]:
    """The base statistics of a text column, as columns named like BASE and n_lines."""
    filled = F.coalesce(text, F.lit(""))
    found = words(text)
    lines = F.filter(F.split(filled, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    return [
        F.size(found).cast("long").alias("n_words"),
        F.length(F.array_join(found, "")).cast("long").alias("word_chars"),
        F.regexp_count(filled, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        repeat_words(found).cast("long").alias("n_repeat_words"),
    ]


def vector() -> list[Column]:
    """The transformed statistics in whole thousandths."""

    def share(part: str, whole: str) -> Column:
        return F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))

    parts = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_symbols", "word_chars"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    ]
    return [F.round(p * UNIT).cast("long").alias(f"x{k}") for k, p in enumerate(parts)]


def chi_square_tail(x: float, half: int) -> float:
    """P(chi-square with 2 * half degrees > x), in closed form."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def chi_square_cut(tail: float, half: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_tail(middle, half) > tail else (low, middle)
    return high


SIZE = len(STATISTICS)
PAIRS = [(i, j) for i in range(SIZE) for j in range(i + 1)]
#: Makes the scatter of the core of a normal sample an estimate of its covariance.
CONSISTENCY = CORE / (1 - chi_square_tail(chi_square_cut(1 - CORE, SIZE // 2), SIZE // 2 + 1))
CUT = chi_square_cut(TAIL, SIZE // 2)


#: Variance of rounding to whole thousandths.
ROUNDING = 1 / 12


def floors(row: bool) -> list[Column]:
    """Least variances: the noise of counting in a text of the pool's mean size, or in a shorter row.

    The square root of a share of n has variance c / 4n when its counts come c at once, and
    the log of a mean word length 1 / n in n characters. A share of one half can always be rejected.
    """
    out = []
    for k, (whole, at_once) in enumerate(STATISTICS.values()):
        n = F.least(F.col(whole), F.col(f"mean_{whole}")) if row else F.col(f"mean_{whole}")
        noise = F.lit(at_once / 4) / F.greatest(n.cast("double"), F.lit(1.0))
        out.append(F.greatest((F.least(noise, F.lit(0.5 / CUT)) if k else noise) * UNIT**2, F.lit(ROUNDING)))
    return out


def precision(estimate: DataFrame, factor: float) -> DataFrame:
    """From counts and moment sums per pool: centre m, variances g and inverse scatter p, by Cholesky factors."""
    least = floors(False)
    n = F.col("n").cast("double")
    out = estimate.select("pool", *[f"mean_{c}" for c in COUNTED], *[(F.col(f"s{i}").cast("double") / n).alias(f"m{i}") for i in range(SIZE)],
                          *[(F.col(f"s{i}{j}").cast("double") / n).alias(f"q{i}{j}") for i, j in PAIRS])
    for i, j in PAIRS:
        scatter = F.greatest(F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"), F.lit(0.0)) if i == j else (
            F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"))
        out = out.withColumn(f"c{i}{j}", F.greatest(scatter * factor, least[i]) if i == j else scatter * factor)
    for j in range(SIZE):
        left = F.col(f"c{j}{j}")
        for k in range(j):
            left = left - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(left, F.lit(ROUNDING))))
        for i in range(j + 1, SIZE):
            left = F.col(f"c{i}{j}")
            for k in range(j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", left / F.col(f"l{j}{j}"))
    for i in range(SIZE):
        for j in range(i + 1):
            value = F.lit(1.0 if i == j else 0.0)
            for k in range(j, i):
                value = value - F.col(f"l{i}{k}") * F.col(f"v{k}{j}")
            out = out.withColumn(f"v{i}{j}", value / F.col(f"l{i}{i}"))
    inverse = []
    for i, j in PAIRS:
        total = F.lit(0.0)
        for k in range(i, SIZE):
            total = total + F.col(f"v{k}{i}") * F.col(f"v{k}{j}")
        inverse.append((total * (1.0 if i == j else 2.0)).alias(f"p{i}{j}"))
    return out.select("pool", *[f"m{i}" for i in range(SIZE)], *[F.col(f"c{i}{i}").alias(f"g{i}") for i in range(SIZE)], *inverse)


def distance() -> Column:
    """Squared distance, with the noise of a short row instead of a lesser variance of its pool."""
    least = floors(True)
    away = [
        (F.col(f"x{i}") - F.col(f"m{i}")) * F.sqrt(F.least(F.lit(1.0), F.col(f"g{i}") / least[i])) for i in range(SIZE)
    ]

    def form(d: Column) -> Column:
        total = F.lit(0.0)
        for i, j in PAIRS:
            total = total + F.col(f"p{i}{j}") * d[i] * d[j]
        return total

    return let(F.array(*away), form)


def bucket() -> Column:
    """Bucket of the distance, eight to a doubling; distances below 2^-8 share one."""
    return F.greatest(F.floor(F.log2(F.greatest(distance(), F.lit(2.0**-8))) * 8), F.lit(-64)).cast("int")


def attach(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Join with a small written table; broadcast only while it is counted as small."""
    if table.count() * 16 <= BROADCAST_KEYS:
        return rows.join(F.broadcast(table), on)
    return rows.join(table, on)


def start(rows: DataFrame) -> DataFrame:
    """First centre and scatter per pool: medians and quartile ranges of each statistic."""
    long = rows.select("pool", F.posexplode(F.array(*[f"x{i}" for i in range(SIZE)])).alias("i", "x"))
    counts = long.groupBy("pool", "i", "x").agg(F.count("*").alias("c"))
    order = Window.partitionBy("pool", "i").orderBy("x")
    ranked = counts.withColumn("upto", F.sum("c").over(order)).withColumn(
        "all", F.sum("c").over(Window.partitionBy("pool", "i"))
    )
    cuts = ranked.groupBy("pool", "i").agg(
        *[F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("x"))).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    )
    means = F.array(*[f"mean_{c}" for c in COUNTED])
    sizes = rows.groupBy("pool").agg(F.max(means).alias("means")).select(
        "pool", *[F.col("means")[k].alias(f"mean_{c}") for k, c in enumerate(COUNTED)]
    ).select("pool", F.array(*floors(False)).alias("least"))
    spread = F.pow((F.col("q75") - F.col("q25")) / 1.349, F.lit(2.0))
    wide = cuts.join(sizes, "pool").withColumn("g", F.greatest(spread, F.col("least")[F.col("i")])).groupBy("pool").agg(
        *[F.max(F.when(F.col("i") == i, F.col("q50"))).cast("double").alias(f"m{i}") for i in range(SIZE)],
        *[F.max(F.when(F.col("i") == i, F.col("g"))).alias(f"g{i}") for i in range(SIZE)],
    ).select("*", *[(1.0 / F.col(f"g{i}")).alias(f"p{i}{i}") for i in range(SIZE)])
    return wide.select(
        "pool",
        *[f"m{i}" for i in range(SIZE)],
        *[f"g{i}" for i in range(SIZE)],
        *[F.col(f"p{i}{j}") if i == j else F.lit(0.0).alias(f"p{i}{j}") for i, j in PAIRS],
    )


def concentrate(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """One step: moments of the nearest ``CORE`` share of every pool, as the next centres."""
    exact = "decimal(20,0)"
    moments = attach(rows, centres, ["pool"]).withColumn("bucket", bucket()).groupBy("pool", "bucket").agg(
        F.count("*").alias("n"),
        *[F.max(f"mean_{c}").alias(f"mean_{c}") for c in COUNTED],
        *[F.sum(F.col(f"x{i}").cast(exact)).alias(f"s{i}") for i in range(SIZE)],
        *[F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast(exact)).alias(f"s{i}{j}") for i, j in PAIRS],
    )
    inner = Window.partitionBy("pool").orderBy("bucket")
    taken = moments.withColumn("before", F.sum("n").over(inner) - F.col("n")).withColumn(
        "all", F.sum("n").over(Window.partitionBy("pool"))
    ).where(F.col("before") < F.col("all") * CORE)
    sums = ["n", *[f"s{i}" for i in range(SIZE)], *[f"s{i}{j}" for i, j in PAIRS]]
    total = taken.groupBy("pool").agg(
        *[F.sum(s).alias(s) for s in sums], *[F.max(f"mean_{c}").alias(f"mean_{c}") for c in COUNTED]
    )
    return materialise(precision(total, CONSISTENCY), "mcd")


def quality(docs: DataFrame, key: str = "doc_id", least: int = 100) -> DataFrame:
    """Per row: key, row_key (hash of key and text), the columns of BASE, the squared distance and kept.

    ``docs`` needs key, text, lang and source; other columns are ignored.
    """
    rows = docs.select(
        F.col(key).alias("key"),
        F.xxhash64(F.col(key), F.col("text")).alias("row_key"),
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang_key"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"),
        *statistics(F.col("text")),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = materialise(rows.withColumn("base_failed", failed).select("*", *vector()), "quality")
    groups = rows.where(~F.col("base_failed")).groupBy("lang_key", "source_key").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(f"all_{c}") for c in COUNTED]
    )
    own = F.col("n") >= least
    by_lang = F.sum(F.when(~own, F.col("n")).otherwise(0)).over(Window.partitionBy("lang_key"))
    # a pool's name starts with its kind; keys start with "=" or are empty, so names differ
    pools = groups.withColumn(
        "pool",
        F.when(own, F.concat(F.lit("s"), F.length("lang_key").cast("string"), F.lit(":"), "lang_key", "source_key"))
        .when(by_lang >= least, F.concat(F.lit("l"), "lang_key"))
        .otherwise("rest"),
    )
    pools = materialise(pools, "pools")
    total = [F.sum("n").alias("n"), *[F.sum(f"all_{c}").alias(f"all_{c}") for c in COUNTED]]
    rest, = pools.where("pool = 'rest'").agg(F.sum("n")).first()
    # too few rows for an estimate of their own: the last pool's is over all rows
    widen = rest is not None and rest < least
    sums = pools.groupBy("pool").agg(*total)
    if widen:
        sums = sums.where("pool <> 'rest'").unionByName(pools.agg(*total).withColumn("pool", F.lit("rest")))
    means = materialise(sums.select("pool", *[(F.col(f"all_{c}") / F.col("n")).alias(f"mean_{c}") for c in COUNTED]), "pools")
    named = materialise(pools.select("lang_key", "source_key", "pool").join(means, "pool"), "pools")
    usable = attach(rows.where(~F.col("base_failed")), named, ["lang_key", "source_key"])
    if widen:
        everything = rows.where(~F.col("base_failed")).crossJoin(F.broadcast(means.where("pool = 'rest'")))
        usable = usable.where("pool <> 'rest'").unionByName(everything.select(usable.columns))
    centres = materialise(start(usable), "mcd")
    for _ in range(STEPS):
        centres = concentrate(usable, centres)
    known = materialise(named.join(centres, "pool"), "mcd")
    judged = rows.join(F.broadcast(known) if known.count() * 16 <= BROADCAST_KEYS else known,
                       ["lang_key", "source_key"], "left")
    far = F.coalesce(F.when(~F.col("base_failed"), distance()) > CUT, F.lit(False))
    return judged.select(
        F.col("key").alias(key),
        "row_key",
        *BASE,
        F.when(~F.col("base_failed"), distance()).alias("distance"),
        (~F.col("base_failed") & ~far).alias("kept"),
    )
