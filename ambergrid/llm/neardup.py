"""Near duplicates among embeddings: spherical k-means cells and blocked cosine products.

Spherical k-means is fitted on a hash sample; every vector then has a home cell and probes
the cells that a close vector may have as its home. In each cell the probing vectors are
compared with the vectors at home, in blocks of bounded size: a cell of any size is split
into pairs of blocks, so a hot cell is many tasks. A pair is linked by its cosine in double
precision, so no link is false; which links are found depends on the probes.

Probes: with y within chord r of x, and x at home in c, y cannot be farther than r beyond
the plane between c and its own home. All cells within ``margin * r`` of that plane are
probed. Margin 1 finds every link; the default is 3.2 / sqrt(dimension), since the offset of a
close vector is spread over all dimensions, and finds about 999 of 1000 links or more
(a test measures it against brute force).

Equal vectors are one vector with a weight. Blocks return counts and a spanning forest of
their links, never pairs of a group. The sample is bounded by SAMPLE_PER_CELL * MOST_CELLS.

Defined results: vectors that are NULL, empty or zero, or have NULL or non-finite parts, link
with nothing; vectors of different lengths are never linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambergrid.llm.common import components, map_arrow
from ambergrid.session import materialise

#: Vectors per cell that the number of cells aims at.
CELL = 200
MOST_CELLS = 1 << 14
SAMPLE_PER_CELL = 64
ROUNDS = 6
#: Vectors on each side of one block product.
BLOCK = 2048


def units(vectors: pa.Array) -> np.ndarray:
    """Rows of unit length in double precision; all have the same number of parts."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _partial_sums(shared):
    """Per task: the sum of the vectors of every cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        sums = np.zeros_like(centres)
        for batch in batches:
            if len(batch):
                rows = units(batch["vector"])
                np.add.at(sums, (rows @ centres.T).argmax(1), rows)
        cells = np.flatnonzero(np.abs(sums).sum(1))
        yield pa.record_batch([pa.array(cells), pa.array(list(sums[cells]), pa.list_(pa.float64()))], ["cell", "total"])

    return run


def fit_cells(vectors: DataFrame, n: int) -> np.ndarray:
    """Unit centres of spherical k-means over a hash sample of (node, vector)."""
    spark = vectors.sparkSession
    cells = int(min(MOST_CELLS, max(1, -(-n // CELL))))
    share = min(1.0, cells * SAMPLE_PER_CELL / n)
    hashed = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    sample = materialise(vectors.where(hashed < int(share * (1 << 30)) + 1).select("node", "vector"), "sample")
    first = sample.orderBy(hashed, "node").limit(cells).select("vector").toArrow()
    centres = units(first["vector"].combine_chunks())
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(centres)
        parts = map_arrow(sample.select("vector"), _partial_sums(shared), "cell long, total array<double>")
        totals = (
            parts.select("cell", F.posexplode("total").alias("k", "x"))
            .groupBy("cell", "k")
            .agg(F.sum("x").alias("x"))
            .toPandas()  # cells times dimensions
        )
        sums = np.zeros_like(centres)
        sums[totals["cell"].to_numpy(), totals["k"].to_numpy()] = totals["x"].to_numpy()
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
        shared.unpersist()
    return centres


def _placed(shared, reach: float):
    """Per vector: its home and the cells it probes, the home first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            probes: list[np.ndarray] = []
            for start in range(0, len(batch), 1024):
                part = batch.slice(start, 1024)
                near = units(part["vector"]) @ centres.T
                home = near.argmax(1)
                gap = near[np.arange(len(home)), home][:, None] - near
                rows, cells = np.nonzero(gap <= 2 * reach + 1e-12)
                apart = np.linalg.norm(centres[cells] - centres[home[rows]], axis=1)
                inside = gap[rows, cells] <= reach * apart + 1e-12
                rows, cells = rows[inside], cells[inside]
                for k in range(len(home)):
                    own = cells[np.searchsorted(rows, k) : np.searchsorted(rows, k, "right")]
                    probes.append(np.r_[home[k], own[own != home[k]]].astype(np.int64))
            yield pa.record_batch(
                [batch["node"], batch["weight"], batch["vector"], pa.array(probes, pa.list_(pa.int64()))],
                ["node", "weight", "vector", "probes"],
            )

    return run


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each connected component of the edges a-b over range(n)."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _block(least: float):
    """One block product: links per vector, and a spanning forest of the links."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at_home = rows[rows["target"]]
        probing = rows[~rows["target"]]
        if at_home.empty or probing.empty:
            return pd.DataFrame({"node": [], "n": [], "root": []}).astype("int64")
        cell = int(rows["cell"].iloc[0])
        left = units(pa.array(probing["vector"].tolist(), pa.list_(pa.float64())))
        right = units(pa.array(at_home["vector"].tolist(), pa.list_(pa.float64())))
        p, t = np.nonzero(left @ right.T >= least)
        nodes_p, nodes_t = probing["node"].to_numpy(), at_home["node"].to_numpy()
        other = nodes_p[p] != nodes_t[t]
        p, t = p[other], t[other]
        homes = np.array([x[0] for x in probing["probes"]])
        # a link is credited to the one that probes; the other one is credited here only
        # if it does not probe the first one's home and so never meets it there
        visits = {int(h): np.array([h in set(x) for x in at_home["probes"]]) for h in set(homes[p]) if h != cell}
        once = np.array([h != cell and not visits[int(h)][k] for h, k in zip(homes[p], t)], bool)
        weight_p, weight_t = probing["weight"].to_numpy(), at_home["weight"].to_numpy()
        nodes, which = np.unique(np.r_[nodes_p, nodes_t], return_inverse=True)
        ends_p, ends_t = which[: len(nodes_p)][p], which[len(nodes_p) :][t]
        counts = np.zeros(len(nodes), np.int64)
        np.add.at(counts, ends_p, weight_t[t])
        np.add.at(counts, ends_t[once], weight_p[p[once]])
        root = roots(ends_p, ends_t, len(nodes))
        met = np.zeros(len(nodes), bool)
        met[ends_p] = met[ends_t] = True
        return pd.DataFrame({"node": nodes[met], "n": counts[met], "root": nodes[root[met]]})

    return run


def links(vectors: DataFrame, least: float, margin: float | None) -> DataFrame:
    """(node, n, root) per block in which a node has links, for vectors of one length."""
    spark = vectors.sparkSession
    n, size = vectors.count(), F.size("vector")
    dimension = vectors.select(size.alias("d")).first()["d"]
    share = min(1.0, 3.2 / dimension**0.5) if margin is None else margin
    centres = fit_cells(vectors, n)
    reach = share * (2 - 2 * least) ** 0.5
    kind = vectors.schema["vector"].dataType.simpleString()
    placed = map_arrow(
        vectors.select("node", "weight", "vector"),
        _placed(spark.sparkContext.broadcast(centres), reach),
        f"node long, weight long, vector {kind}, probes array<long>",
    )
    placed = materialise(placed, "placed")
    visits = placed.select("node", F.posexplode("probes").alias("turn", "cell"))
    sizes = visits.groupBy("cell").agg(
        F.ceil(F.count(F.when(F.col("turn") == 0, 1)) / BLOCK).cast("int").alias("home_blocks"),
        F.ceil(F.count("*") / BLOCK).cast("int").alias("probe_blocks"),
    )
    sizes = F.broadcast(materialise(sizes.where("home_blocks > 0"), "cells"))  # at most MOST_CELLS rows
    deal = F.xxhash64("node", "cell")
    dealt = placed.select("*", F.posexplode("probes").alias("turn", "cell")).join(sizes, "cell")
    probing = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("home_blocks") - 1))).select(
        "cell", "i", F.pmod(deal, F.col("probe_blocks")).cast("int").alias("j"), F.lit(False).alias("target"),
        "node", "weight", "vector", "probes",
    )
    at_home = dealt.where("turn = 0").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("probe_blocks") - 1))).select(
        "cell", F.pmod(deal, F.col("home_blocks")).cast("int").alias("i"), "j", F.lit(True).alias("target"),
        "node", "weight", "vector", "probes",
    )
    blocks = probing.unionByName(at_home).groupBy("cell", "i", "j")
    return blocks.applyInPandas(_block(least), "node long, n long, root long")


def near_duplicates(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, margin: float | None = None
) -> DataFrame:
    """Per row: key, n_links, component_id (smallest key reachable by links) and kept."""
    rows = table.select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    good = rows.where(usable(F.col("vector")))
    distinct = good.groupBy("vector").agg(
        F.min("row").alias("node"), F.min("key").alias("name"), F.count("*").alias("weight")
    )
    distinct = materialise(distinct, "distinct")
    lengths = [r["d"] for r in distinct.select(F.size("vector").alias("d")).distinct().collect()]
    found = None
    for length in lengths:
        some = links(distinct.where(F.size("vector") == length), least, margin)
        found = some if found is None else found.union(some)
    if found is None:
        return rows.select(
            F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept")
        )
    found = materialise(found, "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    groups = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = distinct.join(groups.withColumnRenamed("id", "node"), "node", "left").select(
        "vector", "node", "name", "weight", F.coalesce("component", "node").alias("component")
    )
    named = materialise(named.join(counts, "node", "left"), "named")
    firsts = named.groupBy("component").agg(F.min("name").alias("first"))
    info = named.join(firsts, "component").select(
        "vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "first"
    )
    linked = rows.join(info, "vector", "left")
    own = F.when(usable(F.col("vector")), F.col("first")).otherwise(F.col("key"))
    return linked.select(
        F.col("key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        own.alias("component_id"),
        F.col("key").eqNullSafe(own).alias("kept"),
    )
