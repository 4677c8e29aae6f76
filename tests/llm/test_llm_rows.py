"""Operators that judge each row: pages, licences, personal data, languages, quality, mixing, packing."""

import collections
import random
import time
import zlib

import brute
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ambergrid.llm import extract, language, licenses, mixing, packing, pii, quality

LONG = "Some words are said again, and others never. " * 8000
TEXTS = [
    None, "", " \n\t ", "one", "Under the MIT License.", "x under the mit license cc by nc apache license version 2 y",
    "mail a.b@c-d.org or +1 (555) 123-4567, 10.0.0.256 10.0.0.25 4111 1111 1111 1111", "été über größe 日本語 ñandú",
    "a b c a b c a b c\na b c\n\na b c", "#*$%&|<> " * 30, "same words here " * 40, LONG,
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, spans int, row_key int"


def frame(spark, texts, repeat=1):
    rows = [
        (i if i % 7 else None if i == 7 else i, t, ["en", "fr", None][i % 3], ["b", "a", None, "ä"][i % 4],
         None if t is None else len(t), None, "x", i, 1)
        for i, t in enumerate(texts)
    ] * repeat
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_page_text():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var x='<p>no</p>';</script></head><body>"
        "<nav><ul><li><a href=/>Home, sweet</a></ul></nav><div class='cookie-notice'><p>We use cookies, many.</p></div>"
        "<div id=main><h1>A  title</h1><p>First &amp; foremost, a&nbsp;text, with commas, of length.<p>Second <b>bold</b>"
        "<br>line, too.<table><tr><td>cell, one<td>cell two</table></div><aside><p>See also, this, that.</p></aside>"
        "<div class=comments><p>Nice, nice, nice, nice, nice, nice, nice.</p></div><footer>&copy; me</footer></body></html>"
    )
    assert extract.main_text(page) == (
        "A title First & foremost, a text, with commas, of length. Second bold line, too. cell, one cell two"
    )


def test_page_text_of_unequal_parts():
    para = "This is a sentence of the article, with words, that goes on. " * 5

    def paras(name, n):
        return "".join(f"<p>{name}{k} {para}</p>" for k in range(n))

    def parts(page):
        return [w for w in extract.main_text(page).split() if w[0] == "@"]

    nested = (
        f"<body><article>@intro, loose<h3>@head</h3><section>{paras('@a', 1)}</section><ul><li>@item</li></ul>"
        f"<section>{paras('@b', 6)}</section><table><tr><td>@cell</td></tr></table><dl><dt>@term</dt></dl>"
        "<ul><li><a href=/x>@link elsewhere</a></li></ul><div class=share>@share</div></article></body>"
    )
    assert parts(nested) == ["@intro,", "@head", "@a0", "@item", *[f"@b{k}" for k in range(6)], "@cell", "@term"]
    two = f"<article>{paras('@a', 1)}</article><article>{paras('@b', 6)}</article>"
    both = ["@a0", *[f"@b{k}" for k in range(6)]]
    assert parts(f"<body><main>{two}</main><div>@outside</div></body>") == both
    assert parts(f"<body>{two}<nav>@menu</nav></body>") == both
    assert parts(f"<body><div><div>{paras('@a', 1)}</div><div>{paras('@b', 6)}</div><h4>@end</h4></div></body>") == [*both, "@end"]


@pytest.mark.parametrize(
    "page, text",
    [(None, ""), ("", ""), ("<p></p>", ""), ("plain", "plain"), ("<b>a<i>b", "ab"), ("<!-- <p>x</p> -->y", "y"),
     ("<p>a<p>b", "a b"), ("<script>x", ""), ("</p></div>z", "z"), ("<div>" * 3000 + "deep", "deep"),
     ("<article><p>a &lt;b&gt; &#233;</p></article>", "a <b> é"), ("a < b", "a < b")],
)
def test_odd_pages(page, text):
    assert extract.main_text(page) == text


PARA = "This is a sentence of the article, with words, that goes on. " * 5


@pytest.mark.parametrize(
    "page",
    [
        f'<div id="page" class="site has-sidebar"><article><p>{PARA}</p></article></div>',
        f'<div class="content no-sidebar"><p>{PARA}</p></div>',
        f'<div class="entry-content related-reading"><p>{PARA}</p></div>',
        f'<form id="aspnetForm" method="post"><div><p>{PARA}</p></div><input name="q"></form>',
        f'<form class="search-form"><main><p>{PARA}</p></main></form>',
        f'<div class="sidebar"><p>{PARA}</p></div>',
        f'<div class="comments-open"><p>{PARA}</p></div>',
        f'<div class="promo"><article><p>{PARA}</p></article><div class="ad">Buy, buy, buy.</div></div>',
        f'<article><p title="a hidden gem">{PARA}</p><p hidden>Unseen.</p><p style="display: none">Unseen.</p></article>',
        f'<article><p class="social-science">{PARA}</p><p aria-hidden="true">Unseen.</p></article>',
        f'<article><p>{PARA}</p></article><div id="comments"><li class="comment"><article class="comment-body"><p>{PARA * 9}</p></article></li></div>',
        f'<div><p>{PARA}</p></div><div class="comments"><p>{PARA * 9}</p></div>',
        f'<article><p>{PARA}</p></article><div class="site-footer"><p>{PARA * 3}</p></div><form><p>{PARA * 3}</p></form>',
    ],
)
def test_page_frames(page):
    assert extract.main_text(f"<html><body><nav>Home</nav>{page}</body></html>") == PARA.strip()


def test_headlines_with_cue_names():
    page = f'<article><h1 class="post-header">The headline</h1><p>{PARA}</p><h2 class="ad">Bargain</h2></article>'
    assert extract.main_text(page) == f"The headline {PARA.strip()}"


@pytest.mark.parametrize(
    "page",
    ["<div>text " * 100_000, "<b>x" * 100_000 + "<div></div>" * 50_000, "<i>" + "<b>" * 50_000 + "</i></u>" * 50_000 + "t",
     "<div>" * 50_000 + "<li>x" * 50_000 + "</section>" * 50_000, "<p>" * 100_000 + "t", "<table><tr><td>" * 30_000 + "t"],
)
def test_deep_pages_take_linear_time(page):
    began = time.perf_counter()
    assert extract.main_text(page)
    assert time.perf_counter() - began < 6  # quadratic steps would take minutes


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for row in pages.withColumn("found", extract.extract_text(F.col("html"))).collect():
        assert row["found"] == brute.article(row["html"])


def test_personal_data_equals_patterns():
    rnd = random.Random(3)
    for _ in range(4000):
        text = "".join(rnd.choice("0129 .-+@a(5)Z_%é") for _ in range(rnd.randrange(60)))
        assert [s[:3] for s in pii.scan(text) if s[3]] == brute.personal(text)


def test_added_spans_and_cover():
    text = "IBAN: DE89 3704 0044 0532 0130 00, ssn 123-45-6789 and token = 'abcdef0123456789abcd' at ftp://me:pw@host.org/x"
    kinds = [s[0] for s in pii.scan(text) if not s[3]]
    assert kinds == ["account", "identity", "secret", "login"]
    covered = pii.cover(text)
    assert "3704" not in covered and "6789" not in covered and "host" not in covered
    assert pii.cover(None) is None and pii.cover("") == "" and pii.cover("plain") == "plain"


def test_personal_data_column(docs, empty):
    rows = docs.withColumn("found", pii.pii_spans(F.col("text"))).collect()
    for row in rows:
        base = [(s["kind"], s["start"], s["end"]) for s in row["found"] if s["base"]]
        assert base == brute.personal(row["text"])
    assert empty.select(pii.pii_spans(F.col("text"))).count() == 0


@pytest.mark.parametrize("label", sorted(licenses.TEMPLATES))
def test_every_family_gets_its_own_label(label):
    """Whole notices, with punctuation, and long ones with an edit, are told from their relatives."""
    rnd = random.Random(label)
    for notice in licenses.TEMPLATES[label]:
        words = notice.split()
        text = f"Some prose before. {notice.capitalize()}, (c) and prose after"
        assert licenses.scan(text.encode())["labels"] == label
        if len(words) > 25:
            edited = list(words)
            edited[rnd.randrange(5)] = "zzz"
            edited.insert(len(words) - 2, "qqq")
            assert licenses.scan(" ".join(edited).encode())["labels"] == label
        half = " ".join(words[: len(words) // 3])
        assert licenses.scan(half.encode())["labels"] in ("", label)
    assert licenses.scan(b"the general public may use this work under any license it likes")["labels"] == ""


def test_licences(docs, empty):
    for row in docs.withColumn("found", licenses.license_scan(F.col("text"))).collect():
        n, places = brute.phrases(row["text"], licenses.PHRASES)
        found = row["found"]
        starts = [p for p, _ in places]
        assert (found["n_words"], found["n_base"]) == (n, len(places))
        assert (found["first_word"], found["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert found["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(found["base_labels"].split(",")) - {""} <= set(found["labels"].split(","))
        assert 0 <= found["score"] <= 1
    assert empty.select(licenses.license_scan(F.col("text"))).count() == 0


def test_edited_licence_text_is_chained():
    notice = licenses.TEMPLATES["mit"][0].split()
    edited = notice[:20] + ["gladly"] + notice[20:50] + notice[54:]
    found = licenses.scan(("intro text " + " ".join(edited) + " outro").encode())
    assert found["labels"] == "mit" and found["n_base"] == 0 and found["score"] > 0.8
    assert found["spans"][0]["start"] == 2
    assert licenses.scan(" ".join(notice[:30]).encode())["labels"] == ""


def test_languages(spark, docs, empty):
    tables = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    models = language.fit(tables.where(~held).select(F.col("doc_id").alias("key"), "text", "lang"))
    rows = tables.where(held).withColumn("found", language.identify(F.col("text"), models, spark)).collect()
    right = sum(r["found"]["lang_pred"] == r["lang"] for r in rows)
    assert right >= 0.97 * len(rows)
    assert all(0 <= r["found"]["score"] <= 1 for r in rows)
    odd = {r["text"]: r["found"] for r in docs.withColumn("found", language.identify(F.col("text"), models, spark)).collect()}
    for text in (None, "", " \n\t ", "#*$%&|<> " * 30):
        assert odd[text]["lang_pred"] == "und" and odd[text]["score"] == 0 and odd[text]["rejected"]
    assert odd[LONG]["lang_pred"] in models.langs
    assert language.fit(empty.select(F.col("doc_id").alias("key"), "text", "lang")) is None
    nothing = docs.select(language.identify(F.col("text"), None, spark).alias("f")).select("f.*").distinct().collect()
    assert [r["lang_pred"] for r in nothing] == ["und"]


def test_long_text_scores_like_its_slices(monkeypatch):
    import pandas as pd

    models = language.Models(
        pd.DataFrame([("x", line[i : i + 4], 1) for line in [language.normalise("abcab cab").tobytes().decode("utf-32-le")]
                      for i in range(len(line) - 3)], columns=["lang", "gram", "n"]).groupby(["lang", "gram"], as_index=False).sum()
    )
    whole = models.entropies(["abc cab bca " * 50, "b"])[0]
    monkeypatch.setattr(language, "SLICE", 16)
    assert np.allclose(models.entropies(["abc cab bca " * 50, "b"])[0], whole)


def test_kneser_ney_sums_to_one():
    import pandas as pd

    lines = [language.normalise(t).tobytes().decode("utf-32-le") for t in ("banana bandana", "cabana and a can")]
    grams = [("x", line[i : i + 4], 1) for line in lines for i in range(len(line) - 3)]
    models = language.Models(pd.DataFrame(grams, columns=["lang", "gram", "n"]).groupby(["lang", "gram"], as_index=False).sum())
    letters = np.array([ord(c) for c in "abcdnu "], np.uint32)
    context = [np.full(len(letters), ord(c), np.uint32) for c in "ana"]
    some = 2.0 ** models.log_probabilities([*context, letters])[:, 0]
    # "u" is unseen; the same chance belongs to each of the code points that are
    assert abs(some.sum() + some[5] * (0x110000 - len(letters)) - 1) < 1e-4


def test_languages_of_few_texts_stay(spark):
    rnd = random.Random(9)
    many = {f"few{k}": "".join(chr(0x4E00 + 40 * k + i) for i in range(40)) for k in range(30)}

    def text(letters, n):
        return " ".join("".join(rnd.choice(letters) for _ in range(4)) for _ in range(n))

    # a text of its own for every language, some of them in the part that calibrates
    rows = [(k, text(letters, 40), lang) for k, (lang, letters) in enumerate(many.items())]
    # and five texts, each far beyond the bound
    rows += [(100 + k, text("абвгдежз", 2500), "long") for k in range(5)]
    rows.append((200, "1 2 3 " * 5000, "few0"))
    docs = spark.createDataFrame(rows, "key long, text string, lang string")
    models = language.fit(docs, sample_chars=1000)
    assert set(models.langs) == {*many, "long"}
    found = docs.where("key < 200").withColumn("f", language.identify(F.col("text"), models, spark)).collect()
    assert all(r["f"]["lang_pred"] == r["lang"] for r in found)
    spread = spark.createDataFrame([("".join(chr(97 + i // 1000) for i in range(20000)),)], "t string")
    assert set(spread.select(language.windows(F.col("t"), 160)).first()[0]) >= {"a", "j", "t"}
    assert spark.createDataFrame([("abc",)], "t string").select(language.windows(F.col("t"), 3)).first()[0] == "abc"


def test_quality_statistics(docs, empty):
    found = quality.quality(docs).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found}
    for row in docs.collect():
        got = by_id[row["doc_id"]]
        n, chars, symbols, lines, repeat = brute.statistics(row["text"])
        assert (got["n_words"], got["word_chars"], got["n_symbols"]) == (n, chars, symbols)
        assert (got["n_dup_lines"], got["n_repeat_words"]) == (lines, repeat)
        assert got["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (got["base_failed"] and got["kept"]) and got["kept"] is not None
    assert quality.quality(empty).count() == 0


def test_quality_rejects_what_differs(spark):
    rnd = random.Random(5)
    syllables = ["an", "be", "co", "di", "el", "fa", "go", "hi"]

    def text(n):
        return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n))

    rows = [(i, text(rnd.randint(60, 300)), "en", "s") for i in range(400)]
    rows += [(400 + i, text(100).replace(" ", "### "), "en", "s") for i in range(60)]
    rows += [(500 + i, text(100), None, None) for i in range(5)]
    found = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(found[i]["kept"] for i in range(400) if not found[i]["base_failed"])
    assert not any(found[400 + i]["kept"] for i in range(60))
    assert all(found[500 + i]["kept"] for i in range(5) if not found[500 + i]["base_failed"])


@pytest.mark.parametrize("lines", [1, 2, 12])
def test_quality_rejects_by_one_statistic(spark, lines):
    rnd = random.Random(8)
    names = ["".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(rnd.randint(2, 9))) for _ in range(4000)]

    def text(n, lines):
        words = [rnd.choice(names) for _ in range(n)]
        return "\n".join(" ".join(words[k * n // lines : (k + 1) * n // lines]) for k in range(lines))

    rows = [text(rnd.randint(60, 300), lines) for _ in range(400)]
    rows += [text(150, lines) + " $ 5 & more" for _ in range(5)]  # a few symbols are ordinary
    shares = [0.05, 0.07, 0.10]
    for share in shares:
        plain = text(200, lines)
        letters = len("".join(plain.split()))
        rows.append(plain + " " + "#" * round(letters * share / (1 - share)))
    # many repeated lines of one word each, among too few repeated windows for the base rule
    spread = text(300, 1).split()
    rows.append("\n".join(f"{a} {b} {c}\nso" for a, b, c in zip(spread[::3], spread[1::3], spread[2::3])))
    found = {
        r["doc_id"]: r
        for r in quality.quality(
            spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string")
        ).collect()
    }
    assert not any(r["base_failed"] for r in found.values())
    assert [found[405 + i]["kept"] for i in range(len(shares) + 1)] == [False] * 4
    assert found[408]["n_dup_lines"] == 99 and found[408]["n_symbols"] == 0
    assert sum(found[i]["kept"] for i in range(405)) >= 402


def test_quality_distances_follow_the_estimate(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(f"w{rnd.randrange(900)}" for _ in range(80)), "en", "s") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one = quality.quality(docs).orderBy("doc_id").select("distance").collect()
    two = quality.quality(docs.repartition(7)).orderBy("doc_id").select("distance").collect()
    assert [r[0] for r in one] == [r[0] for r in two]


def test_mix_meets_its_targets(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(["a", "a", "a", "a", "b", "c", "Z", "é", None])) for i in range(500)]
    rows.append((500, None, "null text"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    again = {r["doc_id"]: r for r in mixing.mix(docs.repartition(5)).collect()}
    assert got == again and len(got) == 501
    sources = sorted({s for *_, s in rows if s is not None}) + [None]
    sizes = [sum(len((t or "").split()) for _, t, s in rows if s == source) for source in sources]
    wanted = brute.targets(sizes)
    for source, size, target in zip(sources, sizes, wanted):
        own = [got[i] for i, _, s in rows if s == source]
        assert all(r["source_size"] == size and abs(r["target"] - target) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - target) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    taken = mixing.take(docs).collect()
    assert sum(len((r["text"] or "").split()) for r in taken) == sum(r["taken"] for r in got.values())


def test_mix_of_odd_rows(spark, empty):
    docs = frame(spark, TEXTS, repeat=2)
    assert mixing.mix(docs).count() == 2 * len(TEXTS)
    assert mixing.take(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0


PATH = public_tokenizers.path("word_bpe_49k.json")


def test_tokens_equal_the_tokenizer():
    tokens, exact = packing.Tokens(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(8)
    alphabet = "aAbéÉñß'st 09.,!?-_\n\t<|>&%“”…·"
    texts = [t for t in TEXTS if t] + ["".join(rnd.choice(alphabet) for _ in range(200)) for _ in range(300)]
    texts += ["<|endoftext|> x", "I'm we'll 'S", "ﬁ ½ ² Ⅷ", "İstanbul Σας", "a\x1cb\x00c", "é", "日本 語"]
    for text in texts:
        assert tokens.ids(text).tolist() == [*exact.encode(text, add_special_tokens=False).ids, 2], text[:50]


def test_best_cuts_equal_all_cuts():
    rnd = random.Random(9)
    for _ in range(60):
        places = np.array(sorted(rnd.sample(range(1, 60), 12)) + [64])
        if np.diff(places, prepend=0).max() > 16:
            continue
        price = np.array([rnd.choice([0.0, 1.0, 3.0]) for _ in places])

        def cost(chosen):
            total, before = 0.0, 0
            for c in chosen:
                total += 16 - (c - before) + price[places.tolist().index(c)]
                before = c
            return total

        best = {0: 0.0}
        for k, place in enumerate(places.tolist()):
            ways = [v + 16 - (place - p) for p, v in best.items() if 0 < place - p <= 16]
            best[place] = min(ways) + price[k]
        found = packing.cuts(places, price, 16)
        assert found[-1] == 64 and abs(cost(found) - best[64]) < 1e-9


def test_packing_round_trip(spark, empty, monkeypatch):
    docs = frame(spark, [*TEXTS, *["word. " * k for k in range(0, 900, 30)]], repeat=2).withColumn("doc_id", F.monotonically_increasing_id())
    pieces = packing.pack(docs, PATH, ["doc_id"]).collect()
    exact = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for piece in pieces:
        by_doc.setdefault(piece["doc_id"], []).append(piece)
        by_sequence.setdefault(piece["sequence_id"], []).append(piece)
    for row in docs.collect():
        ids = [*exact.encode(row["text"] or "", add_special_tokens=False).ids, 2]
        joined = []
        for piece in sorted(by_doc[row["doc_id"]], key=lambda p: p["start"]):
            assert piece["start"] == len(joined) and piece["doc_tokens"] == len(ids)
            part = ids[piece["start"] : piece["start"] + piece["length"]]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == piece["ids_crc32"] and part == piece["ids"]
            joined += part
        assert joined == ids
    for own in by_sequence.values():
        place = 0
        for piece in sorted(own, key=lambda p: p["offset"]):
            assert piece["offset"] == place
            place += piece["length"]
        assert place <= 4096
    assert packing.pack(empty, PATH, ["doc_id"]).count() == 0


def test_language_models_equal_plain_kneser_ney():
    rnd = random.Random(17)
    corpora = {
        "aa": ["".join(rnd.choice("abc d") for _ in range(rnd.randint(1, 40))) for _ in range(25)],
        "bb": ["".join(rnd.choice("bcdée ") for _ in range(rnd.randint(1, 40))) for _ in range(25)],
        "cc": ["x"],
    }
    lines = {lang: [language.normalise(t).tobytes().decode("utf-32-le") for t in texts] for lang, texts in corpora.items()}
    rows = [
        (lang, gram, n)
        for lang, found in lines.items()
        for gram, n in collections.Counter(x[i : i + 4] for x in found for i in range(len(x) - 3)).items()
    ]
    models = language.Models(pd.DataFrame(rows, columns=["lang", "gram", "n"]))
    assert models.langs == ["aa", "bb", "cc"]
    plain = [brute.KneserNey(lines[lang], 4, 1 / 0x110000) for lang in models.langs]
    texts = ["abc d", "é", "dddd cab", "zebra", "b" * 30, corpora["aa"][0] + corpora["bb"][0] + "q"]
    found, sizes = models.entropies(texts)
    for k, text in enumerate(texts):
        line = language.normalise(text).tobytes().decode("utf-32-le")
        assert sizes[k] == len(line) - 3
        assert found[k] == pytest.approx([p.entropy(line) for p in plain], rel=1e-4)
    chances = sum(plain[0].probability("abc"[:3], s) for s in {g[-1] for g in plain[0].counts[1]})
    assert chances < 1 < chances + plain[0].uniform * 0x110000 * 0.5


def test_robust_distances_equal_plain_matrices(spark):
    """Own estimates, pools by language and the last pool; odd texts among ordinary ones."""
    rnd = random.Random(23)

    def ordinary():
        words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(55, 130))]
        words += rnd.sample(words, rnd.randint(0, 9)) + ["#" * rnd.randint(0, 3), "end"]
        lines = [" ".join(words[k : k + 9]) for k in range(0, len(words), 9)]
        return "\n".join(lines + lines[: rnd.randrange(2)])

    groups = [("en", "a")] * 150 + [("en", "b")] * 60 + [("en", "c")] * 70 + [("fr", "a")] * 40 + [(None, None)] * 9
    texts = [ordinary() for _ in groups]
    for k in range(0, len(texts), 13):
        texts[k] = rnd.choice([None, "short", "#$%& " * 90, "one line\n" * 40 + ordinary(), "x" * 30 + " " + ordinary() * 2, "ab " * 80])
    rows = [(k, t, g[0], g[1], 0, 0, "x", 0, 0) for k, (t, g) in enumerate(zip(texts, groups))]
    found = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute.robust_distances(texts, groups, quality.CORE, quality.CUT, quality.STEPS, 100, quality.CONSISTENCY)
    rejected = 0
    for k, d in enumerate(want):
        assert (found[k]["distance"] is None) == (d is None) == found[k]["base_failed"]
        if d is not None:
            assert found[k]["distance"] == pytest.approx(d, rel=1e-6, abs=1e-6)
            assert found[k]["kept"] == (d <= quality.CUT)
            rejected += d > quality.CUT
    assert 0 < rejected < 40
