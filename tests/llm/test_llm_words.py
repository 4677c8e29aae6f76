"""Operators on words: spelling variants, benchmark passages, periodic runs."""

import hashlib
import random
import time

import brute
import numpy as np
import pytest

from ambergrid.llm import common, contamination, runs, variants
from ambergrid.llm.queries import QUERIES

DOCS = "doc_id long, text string, word string, n int, runs string, row int, key int"


def rows(texts):
    return [(i, t, "x", 1, None, i, 3) for i, t in enumerate(texts)]


def saved(spark, folder, docs, items=()):
    """Tables as the queries read them."""
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string, size int").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


# periodic runs


def periodic_texts(rnd):
    out = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "a " * 25 + "b", "é " * 40, "a b " * 200 + "a", "x" * 30_000]
    for _ in range(60):
        words = [rnd.choice("abc") for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(4)):
            part = [rnd.choice("abcd") for _ in range(rnd.randint(1, 12))]
            words += (part * 12)[: rnd.randint(1, 12 * len(part))]
            words += [rnd.choice("abc") for _ in range(rnd.randrange(10))]
        out.append(rnd.choice([" ", "\n", "\x0b  "]).join(words))
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    out.append(" ".join(fibonacci[-1]))
    out.append(" ".join((list("aab" * 9 + "c") * 9)))  # runs within runs
    return out + [out[12], out[12]]


@pytest.mark.parametrize("least, times", [(24, 3), (3, 3), (8, 4)])
def test_runs_equal_all_periods(least, times):
    rnd = random.Random(21)
    texts = [(t or "").split() for t in periodic_texts(rnd)]
    known = runs.Numbers()
    ids = np.array([known[w] for words in texts for w in words])
    owner = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
    begin = np.cumsum([0, *map(len, texts)])
    found = [[] for _ in texts]
    for start, length, period in runs.find_runs(ids, owner, least, times).tolist():
        found[owner[start]].append((start - int(begin[owner[start]]), length, period))
    assert found == [brute.periodic_runs(words, least, times) for words in texts]


def test_runs_query_equals_brute_force(spark, tmp_path):
    docs = rows(periodic_texts(random.Random(22)) + [f"w{k} " * 5 + " ".join(map(str, range(k))) for k in range(120)])
    found = QUERIES["op13_periodic_runs"](spark, saved(spark, tmp_path, docs)).collect()
    assert len(found) == len(docs)
    got = {r["doc_id"]: tuple(r[1:]) for r in found}
    assert got == {r[0]: brute.runs_row(r[0], r[1]) for r in docs}
    assert sum(brute.planted(r[0], ["a", "b", "c"]) != ["a", "b", "c"] for r in docs) > 3


def test_runs_in_small_parts(spark, monkeypatch):
    """Batches that end inside a table give the same rows as whole ones."""
    texts = periodic_texts(random.Random(23))
    batch = [[t.encode() if t else None for t in texts]]
    import pyarrow as pa

    source = [pa.record_batch([pa.array(range(len(texts))), pa.array(batch[0], pa.binary())], ["key", "text"])]
    whole = [r for b in runs._described(24, 3)(iter(source)) for r in b.to_pylist()]
    monkeypatch.setattr(runs, "WORDS", 50)
    monkeypatch.setattr(runs, "KEPT", 10)
    assert [r for b in runs._described(24, 3)(iter(source)) for r in b.to_pylist()] == whole


def test_runs_of_odd_rows(spark):
    same = "p q " * 30
    docs = [(None, same, None, 1, None, 1, 1), (None, None, None, 1, None, 1, 1), (4, same, None, 1, None, 1, 1), (4, same, None, 1, None, 1, 1)]
    found = runs.periodic_runs(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found) == [
        (0, [], ""), (0, [(0, 60, 2)], "p q"), (4, [(0, 60, 2)], "p q"), (4, [(0, 60, 2)], "p q"),
    ]
    assert runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        runs.periodic_runs(spark.createDataFrame([], DOCS), times=2)


def test_runs_of_a_long_text_are_quick():
    words = np.random.default_rng(5).integers(0, 50, 1_000_000)
    words[200_000:900_000] = words[200_000 + np.arange(700_000) % 1003]
    words[199_999] = 99
    began = time.perf_counter()
    found = runs.find_runs(words, np.zeros(len(words), np.int64))
    assert [tuple(r) for r in found.tolist()] == [(200_000, 700_000, 1003)]
    assert time.perf_counter() - began < 20


# spelling variants


def misspelt(rnd, n):
    """Texts of words from a small family and their variants, with accents and capitals."""
    stems = ["garden", "gardens", "gardener", "garten", "cañones", "canones", "élevée", "elevee", "aaaaaa", "aaaaaaa", "abababab"]
    out = [None, "", "...", "short words", "x" * 5000, "GARDEN garden1garden_garden"]
    out += ["quartzzz " * 6, "quartzzy " * 31, "Quartzxy;" * 160]  # a chain of forms
    for _ in range(n):
        words = []
        for _ in range(rnd.randrange(60)):
            word = rnd.choice(stems[: rnd.randint(1, len(stems))])
            if rnd.random() < 0.3:
                k = rnd.randrange(len(word) + 1)
                word = word[:k] + rnd.choice("aeñ") * rnd.randrange(2) + word[k + rnd.randrange(2) :]
            words.append(word.capitalize() if rnd.random() < 0.1 else word)
        out.append(rnd.choice([" ", ", ", "-", "×"]).join(words))
    return out + out[-2:]


def by_word(found):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found}


@pytest.mark.parametrize("chunk", [variants.CHUNK, 3])
def test_spelling_forms_equal_all_pairs(spark, chunk):
    docs = rows(misspelt(random.Random(31), 150))
    words = variants.vocabulary(spark.createDataFrame(docs, DOCS), every=7)
    found = variants.spelling_forms(words, chunk=chunk).collect()
    want = brute.spelling([(r[0], r[1]) for r in docs], every=7)
    assert len(found) == len(want) > 30
    assert by_word(found) == want
    assert any(root != form for form, root, *_ in want.values() if form)


def test_spelling_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(variants, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(variants, "KEPT", 5)
    docs = rows(misspelt(random.Random(32), 60))
    found = variants.spelling_forms(variants.vocabulary(spark.createDataFrame(docs, DOCS))).collect()
    assert by_word(found) == brute.spelling([(r[0], r[1]) for r in docs], every=None)


def test_spelling_query_equals_brute_force(spark, tmp_path):
    docs = rows(misspelt(random.Random(33), 300))
    found = QUERIES["op11_spelling_variants"](spark, saved(spark, tmp_path, docs)).collect()
    assert by_word(found) == brute.spelling([(r[0], r[1]) for r in docs])


@pytest.mark.parametrize("seed", range(3))
def test_position_index_equals_all_pairs(seed):
    rnd = random.Random(seed)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 8))) for _ in range(150)})
    index = variants.PositionIndex(words, 0)
    for query in [*words, "a" * 9, "b" * 11]:
        swapped, longer, shorter = index.near(query)
        assert not swapped & longer and not swapped & shorter
        got = [w for k, w in enumerate(words) if (swapped | longer | shorter) >> k & 1]
        assert got == [w for w in words if brute.one_error(query, w)]
    assert variants.PositionIndex([], 0).near("abc") == (0, 0, 0)


def test_spelling_of_odd_rows(spark):
    docs = [(None, "letters " * 5, None, 1, None, 1, 1), (2, None, None, 1, None, 1, 1), (2, "", None, 1, None, 1, 1)]
    found = variants.spelling_forms(variants.vocabulary(spark.createDataFrame(docs, DOCS), every=3)).collect()
    assert by_word(found) == brute.spelling([(r[0], r[1]) for r in docs], every=3)
    empty = variants.vocabulary(spark.createDataFrame([], DOCS))
    assert variants.spelling_forms(empty).count() == 0
    with pytest.raises(ValueError):
        variants.spelling_forms(empty, ratio=1)


def test_one_hot_block_is_cut_into_tiles(spark):
    """Words that share their first half are compared tile by tile."""
    rnd = random.Random(34)
    words = sorted({"commonstart" + "".join(rnd.choice("ab") for _ in range(11)) for _ in range(400)})
    table = [(w, 5 + 37 * k % 101) for k, w in enumerate(words)]
    found = variants.spelling_forms(spark.createDataFrame(table, "word string, n long"), chunk=32).collect()
    near = {w: [(-n, v) for v, n in table if brute.one_error(w, v)] for w, _ in table}
    assert {r["word"]: r["n_near"] for r in found} == {w: len(v) for w, v in near.items()}
    assert {r["word"]: r["form"] for r in found} == {
        w: min(near[w])[1] if near[w] and -min(near[w])[0] >= 5 * n else None for w, n in table
    }


# benchmark passages


def benchmark(rnd):
    """Items and documents that hold parts of them, edited parts, and a very common line."""
    def noise(n):
        return " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 2) for _ in range(n))

    line = noise(12)
    items = [(k, noise(rnd.randint(1, 40))) for k in range(25)] + [(30, line + " " + noise(9)), (31, line + " " + noise(7))]
    items += [(40, None), (41, ""), (42, "..."), (7, noise(15)), (None, noise(14)), (50, "Ünïque wörds, Only"), (51, "aa " * 15), (52, "solo99")]
    docs = [None, "", "!!", "ünïque WÖRDS", "ÜnÏque wörds only", "ünïque Wörds -- ONLY!", "solo99", "aa " * 12, "aa " * 9, line]
    for _ in range(90):
        source = (rnd.choice(items)[1] or "").split()
        low = rnd.randrange(len(source) + 1)
        part = source[low : low + rnd.randint(0, 25)]
        if part and rnd.random() < 0.3:
            part[rnd.randrange(len(part))] = "zz"
        docs.append(f"{noise(rnd.randrange(30))}, {' '.join(part).upper()}; {noise(rnd.randrange(20))} {line if rnd.random() < 0.5 else ''}")
    return items, docs + docs[-2:]


@pytest.mark.parametrize("limits", [{}, {"sent": 0, "sent_records": 0}])
@pytest.mark.parametrize("window, width", [(10, 5), (4, 4), (6, 1)])
def test_contamination_equals_all_windows(spark, window, width, limits, monkeypatch):
    items, texts = benchmark(random.Random(41))
    if limits:
        monkeypatch.setattr(contamination, "BROADCAST_KEYS", 0)
    source = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, size int")
    found = contamination.Contamination(spark.createDataFrame(rows(texts), DOCS), source, window=window, width=width, **limits)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in found.report().collect()}
    want = brute.contaminated(texts, items, window)
    assert got == dict(enumerate(want))
    assert any(names for *_, names in want) and not all(names for *_, names in want)


def test_contamination_query_equals_brute_force(spark, tmp_path):
    items, texts = benchmark(random.Random(42))
    folder = saved(spark, tmp_path, rows(texts), [(i, t, 5) for i, t in items])
    found = QUERIES["op12_benchmark_decontamination"](spark, folder).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found}
    want = brute.contaminated(texts, items)
    assert got == {
        i: (n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0)
        for i, (n, hit, names) in enumerate(want)
    }


def test_contamination_of_odd_rows(spark):
    source = spark.createDataFrame([(1, "one two", 5), (1, "three", 5)], "item_id long, text string, size int")
    none = spark.createDataFrame([], "item_id long, text string, size int")
    docs = spark.createDataFrame([(None, "one two three", None, 1, None, 1, 1), (3, "One. Two", None, 1, None, 1, 1), (3, "One. Two", None, 1, None, 1, 1)], DOCS)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"]) for r in contamination.Contamination(docs, source).report().collect())
    assert got == [(0, 3, 3, ["1"]), (3, 2, 2, ["1"]), (3, 2, 2, ["1"])]
    assert {(r["n_hit"], tuple(r["items"])) for r in contamination.Contamination(docs, none).report().collect()} == {(0, ())}
    assert contamination.Contamination(spark.createDataFrame([], DOCS), source).report().count() == 0


def test_a_common_line_is_joined_through_rare_shingles(spark):
    """Windows that hold a common line join on their rare shingle, so its copies make no matches to check."""
    line = "to be or not to be that is the question whether tis nobler"
    whole = f"{line} rare ending of one single item here now"
    source = spark.createDataFrame([(1, whole, 1)], "item_id long, text string, size int")
    found = contamination.Contamination(spark.createDataFrame(rows([line] * 300 + [whole]), DOCS), source)
    spans = found.spans.groupBy("row").count().collect()
    assert sorted(r["count"] for r in spans) == [4] * 300 + [12]
    hashes = contamination.hash_words(contamination.split_words(line.encode()), contamination.WordHashes())
    common = set(contamination.shingle_hashes(hashes, 5).view(np.int64).tolist())
    for token in found.tokens.collect():
        assert (token["shingle"] in common) == (token["words"] in line)
