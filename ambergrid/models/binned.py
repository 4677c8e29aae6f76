"""Random forests of bounded depth, grown on binned rows.

Spark ML keeps every row as objects with one number per tree, about a kilobyte for 100 trees, so a
large table leaves the executors' memory. Here a row is one byte per feature, packed by thousands
into blocks that are written once, and a tree's draws come from the number of the block. Trees grow
level by level: every task walks its rows to the open nodes of all trees and sums the weights per
(tree, node, feature, bin, class); the sums meet by node, and only the best split of a node comes back.

The rules are those of Spark ML's forest: at most 32 bins a feature, every tree sees a row as often as
a Poisson draw says, a node looks at sqrt(features) of them, takes the split of the largest gain in
Gini impurity and ends without a gain. The result is stored as a forest of Spark ML.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambergrid.models.stored import stored_forest
from ambergrid.session import materialise

#: Bins of a feature, as in Spark ML by default.
BINS = 32
#: Error of a quantile that lies between bins, as one part of so many of all rows.
ACCURACY = 1000
#: Quantiles of each class from which those by weight are found.
GRID = 256
#: Rows of a block.
BLOCK = 1 << 15
#: Sums that a task keeps at once (128 MB); more of them mean several passes over the blocks for a level.
CELLS = 1 << 24
#: Nodes whose sums travel together.
TOGETHER = 64
#: Times that a tree sees a row, by 16 random bits: Poisson with mean 1.
_TIMES = np.searchsorted(
    np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 12)])), (np.arange(1 << 16) + 0.5) / (1 << 16), "right"
).astype(np.uint8)


def _few(inputs: Sequence[str]):
    """Distinct values per feature as far as a task meets at most ``BINS`` of them, else NULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray | None] = {k: np.empty(0) for k in range(len(inputs))}
        for batch in batches:
            for k, have in known.items():
                if have is not None:
                    have = np.union1d(have, batch.column(k).to_numpy(zero_copy_only=False))
                    known[k] = have if len(have) <= BINS else None
        rows = [(k, x) for k, have in known.items() for x in (have.tolist() if have is not None else [None])]
        yield pa.record_batch([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.float64())], ["k", "x"])

    return run


def cut_points(data: DataFrame, inputs: Sequence[str]) -> list[np.ndarray]:
    """Per feature the values between bins, at most 31: between all distinct values, or quantiles by weight."""
    few = data.select(*inputs).mapInArrow(_few(inputs), "k int, x double").groupBy("k").agg(
        F.max(F.col("x").isNull()).alias("more"), F.collect_set("x").alias("xs")  # at most BINS values a task
    )
    exact = {r["k"]: np.unique(r["xs"]) for r in few.select("k", "more", F.slice("xs", 1, BINS + 1).alias("xs")).collect() if not r["more"]}
    cuts = {k: (xs[:-1] + xs[1:]) / 2 for k, xs in exact.items() if len(xs) <= BINS}
    rest = [k for k in range(len(inputs)) if k not in cuts]
    if rest:
        grid = F.lit(np.arange(1, GRID) / GRID)
        columns = [
            column.alias(f"{name}{k}")
            for k in rest
            for name, column in {
                "low": F.min(inputs[k]), "points": F.percentile_approx(inputs[k], grid, F.lit(ACCURACY)), "high": F.max(inputs[k])
            }.items()
        ]
        classes = data.groupBy("_label").agg(F.sum("_weight").alias("w"), *columns).collect()
        for k in rest:
            points = [np.array([r[f"low{k}"], *r[f"points{k}"], r[f"high{k}"]]) for r in classes]
            cuts[k] = _quantiles(np.concatenate(points), np.repeat([r["w"] for r in classes], [len(p) for p in points]))
    return [cuts[k] for k in range(len(inputs))]


def _quantiles(points: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Where the bins' shares of the mass end: half-way to the next point."""
    values, at = np.unique(points, return_inverse=True)
    upto = np.cumsum(np.bincount(at, mass))
    ends = np.unique(np.searchsorted(upto, np.arange(1, BINS) / BINS * upto[-1] * (1 - 1e-12)))
    ends = ends[ends < len(values) - 1]
    between = (values[ends] + values[ends + 1]) / 2
    return np.unique(np.where(np.isfinite(between), between, values[ends]))


def _blocked(cuts: list[np.ndarray]):
    """Rows as blocks: a byte per feature and row, the labels and the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, waiting, rows = TaskContext.get().partitionId() << 32, 0, [], 0

        def block() -> pa.RecordBatch:
            bins, labels, weights = (np.concatenate(part).tobytes() for part in zip(*waiting))
            return pa.record_batch(
                [pa.array([first + number]), *[pa.array([x], pa.binary()) for x in (bins, labels, weights)]],
                ["block", "bins", "labels", "weights"],
            )

        for batch in batches:
            if any(column.null_count for column in batch.columns):
                raise ValueError("inputs, labels and weights of training rows must not be NULL")
            columns = [column.to_numpy() for column in batch.columns]
            bins = np.empty((len(batch), len(cuts)), np.uint8)
            for k, cut in enumerate(cuts):
                if np.isnan(columns[k]).any():
                    raise ValueError("inputs of training rows must be numbers")
                bins[:, k] = np.searchsorted(cut, columns[k], "left")
            waiting.append((bins, columns[-2].astype(np.int32), columns[-1].astype(float)))
            rows += len(batch)
            if rows >= BLOCK:
                yield block()
                number, waiting, rows = number + 1, [], 0
        if rows:
            yield block()

    return run


def _times(seed: int, tree: int, block: int, rows: int) -> np.ndarray:
    """How often a tree sees each row of a block."""
    random = np.random.Generator(np.random.SFC64([seed, tree, block]))
    return _TIMES[random.integers(0, 1 << 16, rows, np.uint16)]


class _Tree:
    """A tree under way: per node its split (feature, last bin of the left child), left child and class sums."""

    def __init__(self) -> None:
        self.feature, self.cut, self.child = np.zeros(1, np.intp), np.full(1, 255, np.uint8), np.zeros(1, np.intp)
        self.gain, self.counts = np.zeros(1), None
        self.open = np.zeros(1, np.intp)  # the nodes that may be split next

    def walked(self) -> tuple:
        """What a task needs to find the open node of a row: nodes without a split lead to themselves."""
        slot = np.full(len(self.feature), -1, np.intp)
        slot[self.open] = np.arange(len(self.open))
        return self.feature, self.cut, self.child, slot

    def split(self, counts: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, children: np.ndarray) -> None:
        """Split the open nodes that have a gain; their children with rows of two classes are open next."""
        if self.counts is None:
            self.counts = counts
        here = gain > 0
        nodes, size = self.open[here], len(self.feature)
        new = 2 * len(nodes)
        children = children[here].reshape(new, counts.shape[1])
        self.feature[nodes], self.cut[nodes], self.gain[nodes] = feature[here], cut[here], gain[here]
        self.child[nodes] = size + 2 * np.arange(len(nodes))
        added = size + np.arange(new)
        self.feature, self.child = np.r_[self.feature, np.zeros(new, np.intp)], np.r_[self.child, added]
        self.cut, self.gain = np.r_[self.cut, np.full(new, 255, np.uint8)], np.r_[self.gain, np.zeros(new)]
        self.counts = np.concatenate([self.counts, children])
        self.open = added[np.count_nonzero(children > 0, axis=1) > 1]


def _counted(shared, width: int, classes: int, seed: int, depth: int):
    """Sums of the weights of the rows at the open nodes, per feature looked at, bin and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value  # (number, feature, cut, child, slot, features that each open node looks at)
        tables = [np.zeros((looked.shape[1], len(looked) * BINS * classes)) for *_, looked in trees]
        for batch in batches:
            for block, packed, own, weigh in zip(*(batch[c].to_pylist() for c in ("block", "bins", "labels", "weights"))):
                bins, weights = np.frombuffer(packed, np.uint8), np.frombuffer(weigh)
                labels = np.frombuffer(own, np.int32).astype(np.intp)
                for (number, feature, cut, child, slot, looked), table in zip(trees, tables):
                    times = _times(seed, number, block, len(labels))
                    rows = np.flatnonzero(times)
                    node = np.zeros(len(rows), np.intp)
                    first = rows * width
                    for _ in range(depth):
                        node = child[node] + (bins[first + feature[node]] > cut[node])
                    place = slot[node]
                    if (place < 0).any():
                        here = np.flatnonzero(place >= 0)
                        rows, first, place = rows[here], first[here], place[here]
                    seen = times[rows] * weights[rows]
                    base = place * (BINS * classes) + labels[rows]
                    for k, sums in enumerate(table):
                        at = bins[first + looked[place, k]] * np.intp(classes)
                        sums += np.bincount(base + at, seen, len(sums))
        for (number, *_, looked), table in zip(trees, tables):
            by_node = table.reshape(looked.shape[1], len(looked), -1).swapaxes(0, 1)
            for low in range(0, len(looked), TOGETHER):
                sums = np.ascontiguousarray(by_node[low : low + TOGETHER])
                if sums.any():
                    yield pa.record_batch(
                        [pa.array([number], pa.int32()), pa.array([low], pa.int32()), pa.array([sums.tobytes()], pa.binary())],
                        ["tree", "low", "sums"],
                    )

    return run


def best_splits(sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per node the class sums, which of its features splits best, after which bin, the gain, and the children's sums.

    ``sums`` has the axes node, feature looked at, bin, class. Nothing splits where the gain is 0.
    """
    left = sums.cumsum(axis=2)[:, :, :-1]
    total = sums[:, 0].sum(axis=1)
    right = total[:, None, None] - left
    # what is no more than rounding in a sum of weights is no row
    small = 1e-9 * total.sum(axis=1)[:, None, None, None]
    right = np.where(right > small, right, 0.0)
    n_left, n_right, n = left.sum(axis=3), right.sum(axis=3), np.maximum(total.sum(axis=1), 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        pure = np.where(n_left > 0, (left**2).sum(axis=3) / n_left, 0) + np.where(n_right > 0, (right**2).sum(axis=3) / n_right, 0)
    gain = (pure - ((total**2).sum(axis=1) / n)[:, None, None]) / n[:, None, None]
    gain = np.where((n_left > 0) & (n_right > 0) & (gain > 1e-12), gain, 0.0).reshape(len(sums), -1)
    at, node = gain.argmax(axis=1), np.arange(len(sums))
    k, cut = np.divmod(at, BINS - 1)
    return total, k, cut, gain[node, at], np.stack([left[node, k, cut], right[node, k, cut]], axis=1)


def _found(tried: int, classes: int):
    """The sums of a node from all tasks, and its best split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for tree, low, sums in zip(*(batch[c].to_pylist() for c in ("tree", "low", "sums"))):
                own = np.frombuffer(sums)
                known[tree, low] = known[tree, low] + own if (tree, low) in known else own
        for (tree, low), sums in known.items():
            total, k, cut, gain, children = best_splits(sums.reshape(-1, tried, BINS, classes))
            lists = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
            yield pa.record_batch(
                [
                    pa.array([tree] * len(total), pa.int32()), pa.array(range(low, low + len(total)), pa.int32()),
                    lists(total), pa.array(k, pa.int32()), pa.array(cut, pa.int32()), pa.array(gain),
                    lists(children.reshape(len(total), -1)),
                ],
                ["tree", "place", "counts", "k", "cut", "gain", "children"],
            )

    return run


SPLITS = "tree int, place int, counts array<double>, k int, cut int, gain double, children array<double>"


def grow_forest(
    rows: DataFrame,
    inputs: Sequence[str],
    label: str,
    weight: str,
    trees: int = 100,
    depth: int = 10,
    seed: int = 42,
) -> RandomForestClassificationModel:
    """Forest over number columns without NULLs; labels are whole numbers from 0, weights above 0."""
    spark = rows.sparkSession
    data = rows.select(
        *[F.col(c).cast("double").alias(c) for c in inputs], F.col(label).cast("int").alias("_label"), F.col(weight).cast("double").alias("_weight")
    )
    most = data.agg(F.max("_label")).first()[0]
    if most is None:
        raise ValueError("cannot fit a forest on an empty table")
    classes, width = max(int(most) + 1, 2), len(inputs)
    tried = width if trees == 1 else int(np.ceil(np.sqrt(width)))
    cuts = cut_points(data, inputs)
    cores = spark.sparkContext.defaultParallelism
    blocks = data.mapInArrow(_blocked(cuts), "block long, bins binary, labels binary, weights binary")
    blocks = materialise(blocks.repartition(cores), "blocks")  # as many files of equal size as there are cores

    grown = [_Tree() for _ in range(trees)]
    random = np.random.default_rng(seed)
    for level in range(depth):
        looked = [np.argsort(random.random((len(t.open), width)), axis=1)[:, :tried].astype(np.intp) for t in grown]
        waiting = [k for k, t in enumerate(grown) if len(t.open)]
        while waiting:
            # as many trees as a task can keep the sums of
            upto = np.cumsum([looked[k].size * BINS * classes for k in waiting])
            now = waiting[: max(1, int(np.searchsorted(upto, CELLS, "right")))]
            waiting = waiting[len(now) :]
            shared = spark.sparkContext.broadcast([(k, *grown[k].walked(), looked[k]) for k in now])
            counts = blocks.mapInArrow(_counted(shared, width, classes, seed, level), "tree int, low int, sums binary")
            found = counts.repartition(cores, "tree", "low").mapInArrow(_found(tried, classes), SPLITS).toArrow()
            _take(found, grown, looked)
            shared.destroy()
    return _stored(spark, grown, cuts, classes, {"maxDepth": depth, "seed": seed, "labelCol": label, "weightCol": weight, "maxBins": BINS})


def _take(found: pa.Table, grown: list[_Tree], looked: list[np.ndarray]) -> None:
    """Split the trees' open nodes as found: one row per open node."""
    numbers, places, k, cut, gain = (found[c].to_numpy() for c in ("tree", "place", "k", "cut", "gain"))
    counts, children = (np.array(found[c].to_pylist(), float) for c in ("counts", "children"))
    for number in np.unique(numbers).tolist():
        own = np.flatnonzero(numbers == number)
        own = own[np.argsort(places[own])]
        tree = grown[number]
        feature = looked[number][places[own], k[own]]
        tree.open = tree.open[places[own]]
        tree.split(counts[own], feature, cut[own].astype(np.uint8), gain[own], children[own])


def _stored(spark, grown: list[_Tree], cuts: list[np.ndarray], classes: int, params: dict) -> RandomForestClassificationModel:
    sizes = [len(t.feature) for t in grown]
    tree, node = np.repeat(np.arange(len(grown)), sizes), np.concatenate([np.arange(n) for n in sizes])
    feature, cut, child, gain = (np.concatenate([getattr(t, c) for t in grown]) for c in ("feature", "cut", "child", "gain"))
    counts = np.concatenate([t.counts for t in grown])
    inner = gain > 0
    limits = np.zeros((len(cuts), 256))
    for k, own in enumerate(cuts):
        limits[k, : len(own)] = own
    shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300)
    columns = {
        "tree": pa.array(tree, pa.int32()),
        "node": pa.array(node, pa.int32()),
        "value": pa.array(counts.argmax(axis=1).astype(float)),
        "counts": pa.array(counts.tolist(), pa.list_(pa.float64())),
        "left": pa.array(np.where(inner, child, -1), pa.int32()),
        "right": pa.array(np.where(inner, child + 1, -1), pa.int32()),
        "feature": pa.array(np.where(inner, feature, -1), pa.int32()),
        "threshold": pa.array(np.where(inner, limits[feature, cut], 0.0)),
        "gain": pa.array(gain),
        "impurity": pa.array(1.0 - (shares**2).sum(axis=1)),
    }
    nodes = spark.createDataFrame(pa.table(columns)).coalesce(1)
    return stored_forest(nodes, RandomForestClassificationModel, len(grown), len(cuts), classes, params)
