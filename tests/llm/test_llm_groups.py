"""Operators that compare rows: Jaccard join, repeated bytes, embeddings, components, pipeline."""

import random

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from ambergrid.llm import common, jaccard, neardup, repeats

DOCS = "doc_id long, text string, sign string, row int, items int"


def prose(rnd, n):
    return [f"{rnd.choice('abcdefghij')}{rnd.randrange(60)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, chains of near copies, a common passage, short and odd texts."""
    rnd = random.Random(11)
    out = [None, "", "  ", "one", "one", "One two", "one two", "a b c", "A B C"]
    common_line = " ".join(prose(rnd, 30))
    base = prose(rnd, 120)
    for _ in range(40):  # a group of near copies, most of which are close to the first only
        edited = list(base)
        for k in rnd.sample(range(120), rnd.randint(0, 6)):
            edited[k] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(edited))
    chain = prose(rnd, 100)
    for k in range(10):
        chain = list(chain)
        chain[10 * k] = f"y{k}"
        out.append(" ".join(chain))
    for _ in range(40):
        out.append(" ".join(prose(rnd, rnd.randint(20, 90))) + " " + common_line)
    out += [out[-1]] * 5 + [out[-1].upper()]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_jaccard_equals_all_pairs(spark, texts, width, percent):
    rows = [(3 * i, t, "x", 1, 2) for i, t in enumerate(texts)]
    found = jaccard.jaccard_groups(spark.createDataFrame(rows, DOCS), width=width, percent=percent).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert got == brute.jaccard([(i, t) for i, t, *_ in rows], width, percent)
    assert sorted(r["doc_id"] for r in found if r["stays"]) == sorted({c for _, c in got.values()})


def test_jaccard_of_odd_rows(spark):
    rows = [(None, "a b c d", None, 1, 1), (4, "a b c d", None, 1, 1), (4, "a b c d", None, 1, 1), (4, "other words", None, 1, 1), (None, None, None, 1, 1)]
    found = jaccard.jaccard_groups(spark.createDataFrame(rows, DOCS), width=3, percent=90).collect()
    assert len(found) == 5
    assert {r["component_id"] for r in found if r["n_shingles"] == 2} == {4}
    assert jaccard.jaccard_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_pairs_are_verified_by_shuffle_too(spark, texts, monkeypatch):
    monkeypatch.setattr(common.keep_keys, "__defaults__", (0,))
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)]
    found = jaccard.jaccard_groups(spark.createDataFrame(rows, DOCS), width=5, percent=80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.jaccard([(i, t) for i, t, *_ in rows], 5, 80)


def test_components(spark):
    rnd = random.Random(12)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 300)]
    found = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    ids = {x for e in edges if e[0] != e[1] for x in e}
    assert {r["id"]: r["component"] for r in found} == brute.groups(ids, edges)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeated_texts(rnd, span):
    def noise(n):
        return "".join(rnd.choice("abcé") for _ in range(n))

    shared, other = noise(3 * span), noise(span)
    out = [None, "", "short", noise(span - 1), shared, shared[:span], shared[1 : span + 1], "x" * (span * 2), other + "q" + other]
    for _ in range(25):
        start = rnd.randrange(2 * span)
        out.append(noise(rnd.randrange(2 * span)) + shared[start : start + rnd.randrange(2 * span)] + noise(rnd.randrange(span)))
    near = noise(6 * span)
    for k in range(4):
        out.append(near[: k * span + 50] + "#" + near[k * span + 51 :])
    return out + [out[20], out[20], "é" * span]


@pytest.mark.parametrize("span, gram", [(24, 8), (400, 64)])
def test_repeats_equal_all_windows(spark, span, gram):
    texts = repeated_texts(random.Random(span), span)
    rows = [(i, t, None, i, i) for i, t in enumerate(texts)]
    found = repeats.remove_repeats(spark.createDataFrame(rows, DOCS), span=span, gram=gram).orderBy("doc_id").collect()
    got = [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found]
    assert got == brute.repeats(texts, span)


def test_repeats_over_chunk_borders(monkeypatch):
    rnd = np.random.default_rng(13)
    data = rnd.integers(97, 100, 5000).astype(np.uint8)
    whole = repeats.anchors(data, 24, 8)
    monkeypatch.setattr(repeats, "CHUNK", 100)
    for a, b in zip(repeats.anchors(data, 24, 8), whole):
        assert (a == b).all()


def test_repeats_of_odd_rows(spark):
    rows = [(None, "z" * 900, None, 1, 1), (None, None, None, 1, 1), (5, "z" * 399, None, 1, 1), (5, "z" * 399, None, 1, 1)]
    found = repeats.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["n_removed"] for r in found) == [0, 0, 0, 900]
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, node int, n_links string"


def vectors(rnd, n, d, centres=6):
    base = rnd.normal(size=(centres, d))
    rows = []
    for k in range(n):
        x = base[rnd.integers(centres)] + rnd.normal(size=d) * rnd.choice([0.05, 0.15, 0.3, 2.0])
        rows.append((int(k), [float(np.float32(v)) for v in x], 0, 1, "x"))
    return rows


def linked(rows, least=0.95):
    x = np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    links = [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(near))]
    best = brute.groups([r[0] for r in rows], links)
    return {r[0]: (int(n), best[r[0]]) for r, n in zip(rows, near.sum(1))}


@pytest.mark.parametrize("dimension, margin, block", [(8, 1.0, 2048), (64, 1.0, 50), (64, None, 2048)])
def test_embedding_links(spark, monkeypatch, dimension, margin, block):
    monkeypatch.setattr(neardup, "CELL", 40)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = vectors(np.random.default_rng(dimension), 700, dimension)
    rows += [(10_000 + k, rows[5][1], 0, 1, "x") for k in range(30)]
    expected = linked(rows)
    found = neardup.near_duplicates(spark.createDataFrame(rows, VECTORS), margin=margin).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found}
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    if margin == 1.0:
        assert got == expected
    else:
        total = sum(n for n, _ in expected.values())
        assert all(got[k][0] <= n for k, (n, _) in expected.items())
        assert sum(n for n, _ in got.values()) >= 0.99 * total


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0, 0.0], [2.0, 0.0], [1.0], [1.0, 0.0]]
    rows = [(k, v, None, 1, "x") for k, v in enumerate(odd)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert found == {
        **{k: (0, k, True) for k in (0, 1, 2, 3, 4, 5, 8)}, 6: (2, 6, True), 7: (2, 6, False), 9: (2, 6, False)
    }
    assert neardup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.limit(1).withColumn("text", F.lit(None).cast("string"))
    docs = docs.unionByName(odd).unionByName(docs.limit(20))
    columns = docs.columns
    sizes, given = [], docs
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001")
        docs = common.materialise(docs, name)
        assert name == "pack_sequences" or docs.columns == columns
        sizes.append(docs.count())
        if name == "quality_rules":
            for row in before.select("doc_id", "text").collect():
                n, _, _, _, repeat = brute.statistics(row["text"])
                if n < 50 or 2 * repeat > n:
                    assert row["doc_id"] not in {r["doc_id"] for r in docs.select("doc_id").collect()} or row["text"] is None
        if name == "near_duplicates":
            kept = {r["doc_id"] for r in docs.collect()}
            expected = brute.jaccard([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert kept == {c for _, c in expected.values()} and len(kept) == sizes[-1]
        if name == "personal_data":
            assert all(not brute.personal(r["text"]) and r["n_chars"] == len(r["text"]) for r in docs.collect())
    assert sizes[0] > 100 and sizes[-1] > 0
    nothing = given.where("false")
    for _, stage in corpus_pipeline.STAGES:
        nothing = common.materialise(stage(spark, nothing, ""), "nothing")
    assert nothing.count() == 0
