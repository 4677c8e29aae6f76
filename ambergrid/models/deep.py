"""Random forests of unbounded depth for any number of classes.

Spark ML's trees end at depth 30. Here columns are binned once, and trees grow in two phases.

* Large nodes grow level by level. Each pass sends every row down the trees so far to the
  number of its open node, counts classes per (tree, node, feature, bin) in the tasks, sums
  the counts in one shuffle, and finds each node's best split where its counts meet. Only
  the splits come back, so depth is as many passes as the large nodes need.
* A node of at most ``LOCAL`` rows is finished in one task: its rows meet there once and the
  subtree grows to pure leaves, however deep.

A tree sees every row as often as a Poisson draw from the row's hash says, and a node looks at
a random part of the features, more if none of them parts its rows.

A forest of unbounded depth has about as many nodes as its trees have rows, so ``GrownForest``
leaves them in files and scores as it grew: rows are sent down the upper nodes, and meet each
subtree in one task. Only the upper nodes, one per ``LOCAL`` rows, are known to the driver.
``GrownForest.model`` numbers the nodes and reads them as a forest of Spark ML, which holds
all of them on the driver and in every executor: for forests that are small enough to store.

Values of a column that fall into one of at most 255 bins are not told apart; columns of
fewer values are binned exactly. Rows whose label or array is NULL are left out, NaN goes right.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ambergrid.models.stored import NODES, stored_forest
from ambergrid.session import materialise

BINS = 255
#: Rows of a node that one task finishes.
LOCAL = 50_000
#: Cells of counts that a task keeps before it sends them.
CELLS = 1 << 20


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct values per feature as far as a task meets few of them, else NULL."""
    known: dict[int, set | None] = {}
    for batch in batches:
        for row in batch["features"].to_pylist():
            for k, x in enumerate(row):
                have = known.setdefault(k, set())
                if have is not None and x is not None and x == x:
                    have.add(x)
                    if len(have) > BINS:
                        known[k] = None
    rows = [(k, x) for k, have in known.items() for x in (have if have is not None else [None])]
    yield pa.record_batch([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.float64())], ["k", "x"])


def cut_points(train: DataFrame, features: str) -> list[np.ndarray]:
    """Per feature the values between bins, at most 254: all distinct ones, or quantiles."""
    rows = train.select(F.col(features).alias("features"))
    few = rows.mapInArrow(_few, "k int, x double").groupBy("k").agg(
        F.max(F.col("x").isNull()).alias("more"), F.collect_set("x").alias("xs")  # at most BINS values a task
    )
    exact = {r["k"]: np.unique(r["xs"]) for r in few.select("k", "more", F.slice("xs", 1, BINS + 1).alias("xs")).collect() if not r["more"]}
    exact = {k: xs for k, xs in exact.items() if len(xs) <= BINS}
    values = rows.select(F.posexplode("features").alias("k", "x")).filter("x IS NOT NULL AND NOT isnan(x)")
    if exact:
        values = values.filter(~F.col("k").isin(list(exact)))
    grid = F.lit(np.arange(1, BINS) / BINS)
    found = values.groupBy("k").agg(F.percentile_approx("x", grid, F.lit(10_000)).alias("cuts"), F.max("x").alias("most"))
    cuts = {k: xs[:-1] for k, xs in exact.items()}
    for row in found.collect():  # one row per feature
        own = np.unique(row["cuts"])
        cuts[row["k"]] = own[own < row["most"]]
    return [cuts.get(k, np.empty(0)) for k in range(max(cuts, default=-1) + 1)]


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def draws(hashes: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree sees each row: Poisson with mean 1, from the row's hash."""
    mixed = _mixed(hashes.view(np.uint64) + np.uint64((tree * 1_000_003 + seed + 1) * 0x9E3779B97F4A7C15 % 2**64))
    uniform = (mixed >> np.uint64(11)).astype(float) / 2.0**53
    limits = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 12)]))
    return np.searchsorted(limits, uniform, "right").clip(0, 12)


def subset(tree: int, node: int, width: int, seed: int) -> np.ndarray:
    """Order in which a node looks at the features."""
    return np.random.default_rng([seed, tree, node]).permutation(width)


def best_split(counts: np.ndarray) -> tuple[float, int]:
    """Largest drop of the Gini impurity (times rows) and the last bin that goes left, from (bins, classes) counts."""
    left = counts.cumsum(axis=0)
    total = left[-1]
    right = total - left
    n_left, n_right = left.sum(axis=1), right.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        pure = np.where(n_left > 0, (left**2).sum(axis=1) / n_left, 0) + np.where(n_right > 0, (right**2).sum(axis=1) / n_right, 0)
    gain = np.where((n_left > 0) & (n_right > 0), pure - (total**2).sum() / max(total.sum(), 1), -1.0)
    at = int(gain.argmax())
    return float(gain[at]), at


def grow(bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, classes: int, key: tuple[int, int], seed: int, tried: int):
    """Nodes (counts, left, right, feature, bin) of a subtree down to pure or inseparable leaves, parents first."""
    out: list[list] = []
    waiting = [(np.arange(len(labels)), -1, False)]
    while waiting:
        rows, parent, is_left = waiting.pop()
        node = len(out)
        if parent >= 0:
            out[parent][1 if is_left else 2] = node
        counts = np.bincount(labels[rows], weights[rows], classes)
        out.append([counts, -1, -1, -1, 0])
        if np.count_nonzero(counts) < 2:
            continue
        best = (0.0, -1, 0)
        for k, feature in enumerate(subset(key[0], key[1] * 1_000_003 + node, bins.shape[1], seed).tolist()):
            if k >= tried and best[1] >= 0:
                break
            column = bins[rows, feature]
            low, high = int(column.min()), int(column.max())
            if low < high:
                size = high - low + 1
                table = np.bincount((column.astype(np.int64) - low) * classes + labels[rows], weights[rows], size * classes)
                gain, at = best_split(table.reshape(size, classes))
                if gain > best[0] or best[1] < 0:  # a split without a gain may lead on
                    best = (max(gain, 0.0), feature, low + at)
        if best[1] >= 0:
            out[node][3:] = best[1:]
            left = bins[rows, best[1]] <= best[2]
            waiting.append((rows[~left], node, False))
            waiting.append((rows[left], node, True))
    return out


class Trees:
    """The upper part of the trees: nodes that were split by passes, and open ones."""

    def __init__(self, trees: int) -> None:
        # per tree lists of (feature, bin, left, right); feature -1: open (bin counts the features
        # looked at so far), -2: for one task, -3: a leaf
        self.nodes = [[[-1, 0, -1, -1]] for _ in range(trees)]
        self.leaves: dict[tuple[int, int], list[float]] = {}

    def arrays(self) -> list[np.ndarray]:
        return [np.array(nodes, np.int64) for nodes in self.nodes]

    def open(self) -> list[tuple[int, int]]:
        return [(t, k) for t, nodes in enumerate(self.nodes) for k, node in enumerate(nodes) if node[0] == -1]


def places(tree: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Number of the open node that each row comes to."""
    node = np.zeros(len(bins), np.int64)
    while True:
        inner = np.flatnonzero(tree[node, 0] >= 0)
        if not len(inner):
            return node
        at = tree[node[inner]]
        node[inner] = np.where(bins[inner, at[:, 0]] <= at[:, 1], at[:, 2], at[:, 3])


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(-1, width)


def _binned(cuts: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[np.nan if x is None else x for x in row] for row in batch["features"].to_pylist()]
            values = np.array(rows, float).reshape(len(rows), len(cuts))
            bins = np.empty(values.shape, np.uint8)
            for k, cut in enumerate(cuts):
                bins[:, k] = np.where(np.isnan(values[:, k]), 255, np.searchsorted(cut, values[:, k], "left"))
            yield pa.record_batch(
                [batch["label"], batch["hash"], pa.array([row.tobytes() for row in bins], pa.binary())], ["label", "hash", "bins"]
            )

    return run


def _counted(shared, width: int, classes: int, seed: int, tried: int):
    """Class counts of the open nodes per feature and bin, and the nodes' row counts (feature -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        kept: dict[tuple[int, int], np.ndarray] = {}
        looked: dict[tuple[int, int], np.ndarray] = {}
        cells_kept = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for (tree, node), table in kept.items():
                at = np.flatnonzero(table)
                feature, rest = np.divmod(at, 256 * classes)
                size = len(at)
                yield pa.record_batch(
                    [
                        pa.array(np.full(size, tree, np.int32)), pa.array(np.full(size, node, np.int32)),
                        pa.array(looked[tree, node][feature].astype(np.int32)), pa.array((rest // classes).astype(np.int32)),
                        pa.array((rest % classes).astype(np.int32)), pa.array(table[at]),
                    ],
                    ["tree", "node", "feature", "bin", "class", "n"],
                )
            kept.clear()

        for batch in batches:
            bins, hashes = _matrix(batch, width), batch["hash"].to_numpy()
            labels = batch["label"].to_numpy(zero_copy_only=False).astype(np.int64)
            for number, tree in enumerate(trees):
                if not (tree[:, 0] == -1).any():
                    continue
                weights, node = draws(hashes, number, seed), places(tree, bins)
                for at in np.unique(node[(weights > 0) & (tree[node, 0] == -1)]).tolist():
                    rows = np.flatnonzero((node == at) & (weights > 0))
                    key = number, at
                    if key not in looked:
                        looked[key] = subset(number, at, width, seed)[tree[at, 1] :][:tried]
                    chosen = looked[key]
                    cells = np.arange(len(chosen)) * 256 * classes + bins[rows][:, chosen].astype(np.int64) * classes + labels[rows, None]
                    table = np.bincount(cells.ravel(), np.repeat(weights[rows], len(chosen)), len(chosen) * 256 * classes)
                    if key in kept:
                        kept[key] += table
                    else:
                        kept[key] = table
                        cells_kept += len(table)
                    if cells_kept > CELLS:
                        yield from sent()
                        cells_kept = 0
        yield from sent()

    return run


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple[int, int], list]]:
    """Rows of sorted batches by (tree, node)."""
    key, parts = None, []
    for batch in batches:
        tree, node = batch["tree"].to_numpy(), batch["node"].to_numpy()
        edges = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (node[1:] != node[:-1])]) if len(tree) else []
        for low, high in zip(edges, [*edges[1:], len(tree)]):
            own = int(tree[low]), int(node[low])
            if own != key:
                if parts:
                    yield key, parts
                key, parts = own, []
            parts.append([batch[c].slice(low, high - low) for c in names])
    if parts:
        yield key, parts


def _split(classes: int):
    """Per node: its class counts and the best split of the features that were looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, node), parts in _groups(batches, ["feature", "bin", "class", "n"]):
            feature, at, label, n = (np.concatenate([p[k].to_numpy() for p in parts]) for k in range(4))
            best, total = (-0.5, -1, 0), None  # any split that parts the rows will do
            for k in np.unique(feature).tolist():
                own = feature == k
                table = np.bincount(at[own].astype(np.int64) * classes + label[own], n[own], 256 * classes).reshape(256, classes)
                total = table.sum(axis=0) if total is None else total
                gain, place = best_split(table)
                if gain > best[0]:
                    best = (gain, k, place)
            row = (tree, node, total.tolist(), best[1], best[2])
            yield pa.record_batch([pa.array([v]) for v in row], ["tree", "node", "counts", "feature", "bin"])

    return run


def _sent(shared, width: int, seed: int):
    """The rows of every node that one task finishes, as often as its tree sees them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), 500):
                batch = whole.slice(begin, 500)
                bins, hashes = _matrix(batch, width), batch["hash"].to_numpy()
                for number, tree in enumerate(shared.value):
                    weights, node = draws(hashes, number, seed), places(tree, bins)
                    rows = np.flatnonzero((weights > 0) & (tree[node, 0] == -2))
                    if len(rows):
                        yield pa.record_batch(
                            [
                                pa.array(np.full(len(rows), number, np.int32)), pa.array(node[rows].astype(np.int32)),
                                pa.array(weights[rows].astype(float)), batch["label"].take(pa.array(rows)), batch["bins"].take(pa.array(rows)),
                            ],
                            ["tree", "node", "weight", "label", "bins"],
                        )

    return run


SUBTREE = "tree int, top int, place int, counts array<double>, left int, right int, feature int, bin int"


def _finished(width: int, classes: int, seed: int, tried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, node), parts in _groups(batches, ["weight", "label", "bins"]):
            bins = np.frombuffer(b"".join(b for p in parts for b in p[2].to_pylist()), np.uint8).reshape(-1, width)
            weights, labels = (np.concatenate([p[k].to_numpy(zero_copy_only=False) for p in parts]) for k in range(2))
            nodes = grow(bins, labels.astype(np.int64), weights, classes, (tree, node), seed, tried)
            size = len(nodes)
            ints = lambda k: pa.array([x[k] for x in nodes], pa.int32())
            yield pa.record_batch(
                [
                    pa.array([tree] * size, pa.int32()), pa.array([node] * size, pa.int32()), pa.array(range(size), pa.int32()),
                    pa.array([x[0] for x in nodes], pa.list_(pa.float64())), ints(1), ints(2), ints(3), ints(4),
                ],
                [part.split()[0] for part in SUBTREE.split(", ")],
            )

    return run


def _asked(shared, width: int):
    """Every row to the node of every tree at which the upper part ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), 500):
                batch = whole.slice(begin, 500)
                bins, size = _matrix(batch, width), len(batch)
                for number, tree in enumerate(shared.value):
                    yield pa.record_batch(
                        [pa.array(np.full(size, number, np.int32)), pa.array(places(tree, bins).astype(np.int32)), batch["hash"], batch["bins"]],
                        ["tree", "top", "row", "bins"],
                    )

    return run


def _walked(width: int, classes: int):
    """The share of each class in the leaf that a row comes to; the nodes of a subtree come before its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, tree, shares = None, [], None, None
        for batch in batches:
            owner = np.stack([batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tree", "top", "asked")], axis=1)
            edges = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]).any(axis=1)]) if len(owner) else []
            for low, high in zip(edges, [*edges[1:], len(owner)]):
                part, own = batch.slice(low, high - low), tuple(owner[low, :2])
                if own != key:
                    key, parts, tree = own, [], None
                if not owner[low, 2]:
                    parts.append(part)
                    continue
                if tree is None:
                    if parts:
                        nodes = pa.Table.from_batches(parts)
                        tree = np.stack([nodes[c].to_numpy().astype(np.int64) for c in ("feature", "bin", "left", "right")], axis=1)
                        shares = np.array(nodes["counts"].to_pylist(), float).reshape(-1, classes)
                    else:  # no row was drawn for it
                        tree, shares = np.array([[-1, 0, -1, -1]]), np.eye(1, classes)
                    shares, parts = shares / shares.sum(axis=1, keepdims=True), []
                found = shares[places(tree, _matrix(part, width))]
                row, label = np.nonzero(found)
                yield pa.record_batch(
                    [part["row"].take(pa.array(row)), pa.array(label.astype(np.int32)), pa.array(found[row, label])], ["_row", "class", "share"]
                )

    return run


@dataclass
class GrownForest:
    """A grown forest whose nodes stay in files."""

    features: str
    upper: Trees
    subtrees: DataFrame
    cuts: list[np.ndarray]
    classes: int

    def model(self) -> RandomForestClassificationModel:
        """The forest of Spark ML, all of it in memory."""
        nodes = _numbered(self.subtrees, self.upper, self.cuts, self.classes)
        return stored_forest(nodes, RandomForestClassificationModel, len(self.upper.nodes), len(self.cuts), self.classes)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` and ``prediction`` as Spark ML's forest does; NULL where the features are."""
        spark, width, classes, trees = df.sparkSession, len(self.cuts), self.classes, len(self.upper.nodes)
        kept = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "unscored", spread=True)
        rows = kept.filter(F.col(self.features).isNotNull()).select(
            F.lit(0).alias("label"), F.col("_row").alias("hash"), F.col(self.features).cast("array<double>").alias("features")
        )
        shared = spark.sparkContext.broadcast(self.upper.arrays())
        asked = rows.mapInArrow(_binned(self.cuts), "label int, hash long, bins binary").mapInArrow(
            _asked(shared, width), "tree int, top int, row long, bins binary"
        )
        nodes = self.subtrees
        if self.upper.leaves:
            ends = [(tree, top, 0, counts, -1, -1, -1, 0) for (tree, top), counts in self.upper.leaves.items()]
            nodes = nodes.unionByName(spark.createDataFrame(ends, SUBTREE))
        both = nodes.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)), allowMissingColumns=True)
        deal = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = both.repartition(deal, "tree", "top").sortWithinPartitions("tree", "top", "asked", "place")
        votes = dealt.mapInArrow(_walked(width, classes), "_row long, class int, share double")
        voted = votes.groupBy("_row", "class").agg((F.sum("share") / trees).alias("share"))
        shares = F.map_from_entries(F.collect_list(F.struct("class", "share")))
        per_row = voted.groupBy("_row").agg(shares.alias("_shares"), (-F.max(F.struct("share", -F.col("class")))["col2"]).cast("double").alias("prediction"))
        chances = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: F.coalesce(F.try_element_at("_shares", c), F.lit(0.0)))
        scored = per_row.select("_row", array_to_vector(chances).alias("probability"), "prediction")
        return kept.join(scored, "_row", "left").drop("_row")


def grow_deep_forest(
    train: DataFrame,
    label: str,
    features: str,
    key: str,
    trees: int = 100,
    seed: int = 42,
    local: int = LOCAL,
) -> GrownForest:
    """Forest over an array of numbers; labels are whole numbers from 0. Rows are drawn by ``key``."""
    rows = train.filter(F.col(label).isNotNull() & F.col(features).isNotNull()).select(
        F.col(label).cast("int").alias("label"),
        F.xxhash64(F.col(key), F.lit(seed)).alias("hash"),
        F.col(features).cast("array<double>").alias("features"),
    )
    cuts = cut_points(rows, "features")
    width = len(cuts)
    most = rows.agg(F.max("label")).first()[0]
    if most is None or not width:
        raise ValueError("cannot fit a forest on an empty table")
    classes = max(int(most) + 1, 2)
    tried = int(np.ceil(np.sqrt(width)))
    spark = train.sparkSession
    binned = rows.mapInArrow(_binned(cuts), "label int, hash long, bins binary")
    binned = materialise(binned, "binned", spread=True)

    upper = Trees(trees)
    while upper.open():
        shared = spark.sparkContext.broadcast(upper.arrays())
        counts = binned.mapInArrow(
            _counted(shared, width, classes, seed, tried), "tree int, node int, feature int, bin int, class int, n double"
        )
        summed = counts.groupBy("tree", "node", "feature", "bin", "class").agg(F.sum("n").alias("n"))
        dealt = summed.repartition("tree", "node").sortWithinPartitions("tree", "node")
        found = dealt.mapInArrow(_split(classes), "tree long, node long, counts array<double>, feature long, bin long")
        splits = {(r["tree"], r["node"]): r for r in found.collect()}  # one row per open node of this pass
        for tree, node in upper.open():
            row, nodes = splits.get((tree, node)), upper.nodes[tree]
            if row is None or sum(row["counts"]) <= local:
                nodes[node][0] = -2  # small: a task finishes it
            elif sum(n > 0 for n in row["counts"]) < 2 or (row["feature"] < 0 and nodes[node][1] + tried >= width):
                nodes[node][0] = -3  # pure or inseparable
                upper.leaves[tree, node] = row["counts"]
            elif row["feature"] < 0:
                nodes[node][1] += tried  # equal in all of them: look at others
            else:
                nodes[node][:] = [row["feature"], row["bin"], len(nodes), len(nodes) + 1]
                nodes += [[-1, 0, -1, -1], [-1, 0, -1, -1]]
    shared = spark.sparkContext.broadcast(upper.arrays())
    sent = binned.mapInArrow(_sent(shared, width, seed), "tree int, node int, weight double, label int, bins binary")
    deal = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = sent.repartition(deal, "tree", "node").sortWithinPartitions("tree", "node", "bins", "label", "weight")
    subtrees = materialise(dealt.mapInArrow(_finished(width, classes, seed, tried), SUBTREE), "subtrees")
    return GrownForest(features, upper, subtrees, cuts, classes)


def fit_deep_forest(
    train: DataFrame,
    label: str,
    features: str,
    key: str,
    trees: int = 100,
    seed: int = 42,
    local: int = LOCAL,
) -> RandomForestClassificationModel:
    """The forest of ``grow_deep_forest`` as one of Spark ML."""
    return grow_deep_forest(train, label, features, key, trees, seed, local).model()


def _numbered(subtrees: DataFrame, upper: Trees, cuts: list[np.ndarray], classes: int) -> DataFrame:
    """All nodes with numbers per tree: first the upper ones, then the others subtree by subtree."""
    spark = subtrees.sparkSession
    sizes = {(r["tree"], r["top"]): r["n"] for r in subtrees.groupBy("tree", "top").agg((F.count("*") - 1).alias("n")).collect()}
    offsets, above = [], []
    for tree, nodes in enumerate(upper.nodes):
        free = len(nodes)
        for k, (feature, at, left, right) in enumerate(nodes):
            if feature >= 0:
                above.append((tree, k, 0.0, [0.0] * classes, left, right, feature, float(cuts[feature][at]) if at < len(cuts[feature]) else np.inf))
            elif feature == -3:
                counts = upper.leaves[tree, k]
                above.append((tree, k, float(np.argmax(counts)), counts, -1, -1, -1, 0.0))
            elif (tree, k) in sizes:
                offsets.append((tree, k, free - 1))  # the subtree's first node keeps the number of its top
                free += sizes[tree, k]
            else:  # no row was drawn for it
                above.append((tree, k, 0.0, [1.0] + [0.0] * (classes - 1), -1, -1, -1, 0.0))
    placed = subtrees.join(F.broadcast(spark.createDataFrame(offsets, "tree int, top int, free int")), ["tree", "top"])
    number = lambda c: F.when(F.col(c) <= 0, F.when(F.col(c) == 0, F.col("top")).otherwise(-1)).otherwise(F.col(c) + F.col("free"))
    limits = F.lit([[float(x) for x in cut] or [0.0] for cut in cuts])
    threshold = F.coalesce(F.get(F.get(limits, F.col("feature")), F.col("bin")), F.lit(float("inf")))
    most = F.array_position("counts", F.array_max("counts")) - 1
    lower = placed.select(
        "tree", number("place").alias("node"), most.cast("double").alias("value"), "counts", number("left").alias("left"),
        number("right").alias("right"), "feature", F.when(F.col("feature") >= 0, threshold).otherwise(0.0).alias("threshold"),
    )
    return lower.unionByName(spark.createDataFrame(above, NODES)) if above else lower
