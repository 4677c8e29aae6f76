"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ambergrid.llm import contamination, extract, jaccard, language, licenses, mixing, neardup, packing, pii, quality
from ambergrid.llm import repeats, runs, variants
from ambergrid.llm.common import let, table, words
from ambergrid.plans.packaging import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
EXPECTED: dict[str, str] = {}


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return function


@query
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", extract.extract_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", licenses.license_scan(F.col("text")).alias("found"))
    return found.select("doc_id", "found.*").drop("spans")


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    )
    learned = docs.where(~F.col("held_out")).select(F.col("doc_id").alias("key"), "text", "lang")
    models = language.fit(learned)
    found = docs.select("doc_id", "held_out", language.identify(F.col("text"), models, spark).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.cross_entropy", "found.rejected")


@query
def op10_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", pii.pii_spans(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s.base)

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s.base & (s.kind == kind))).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.BASE_KINDS],
        F.sha2(pii.span_digest(base), 256).alias("base_sha256"),
        pii.span_digest(F.col("found")).alias("spans"),
    )


@query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("row_key")


EXPECTED["op6_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM sized GROUP BY source),
limits AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
         3.0::DOUBLE * source_size AS most FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER below, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level,
         row_number() OVER (ORDER BY most / weight, place) AS turn
  FROM limits WINDOW below AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (
  SELECT source, source_size,
         least(most, weight * coalesce((SELECT arg_min(level, turn) FROM levels WHERE weight * level <= most), 'inf'::DOUBLE))::DOUBLE AS target
  FROM levels),
keyed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target,
         least(round(p.target)::BIGINT, 3 * p.source_size) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(s.doc_id::VARCHAR || ':' || s.size::VARCHAR), s.doc_id
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
          + least(size, greatest(0, budget % source_size - before)) END)::BIGINT AS taken
FROM keyed
"""


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("row_key")


@query
def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path, ["doc_id"]).drop("ids")


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard.jaccard_groups(docs, width=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query
def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_forms(variants.vocabulary(table(spark, sf_dir, "documents"), every=199))


@query
def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.Contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.report().select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


EXPECTED["op12_benchmark_decontamination"] = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(words, i, i + size - 1), ' ') AS body
  FROM (SELECT item_id, words, least(10, len(words)) AS size, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i
        FROM items WHERE len(words) > 0)),
places AS (
  SELECT doc_id, size, i, array_to_string(list_slice(words, i, i + size - 1), ' ') AS body
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM texts, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)),
matches AS (SELECT DISTINCT doc_id, i, size, item_id FROM places JOIN windows USING (size, body)),
hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM matches) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
          FROM (SELECT DISTINCT doc_id, item_id FROM matches) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def with_planted_run(key: Column, text: Column) -> Column:
    """The text of one in ten documents with a part that repeats itself, chosen by the key's hash."""
    code = F.crc32(F.encode(key.cast("string"), "UTF-8"))
    g = F.floor(code / 10)

    def repeated(found: Column) -> Column:
        n = F.size(found)
        begin = (g % n).cast("int")
        period = (1 + F.floor((n - begin) / (3 + g % 8))).cast("int")
        place = lambda i: F.when(i < begin, i).otherwise(begin + (i - begin) % period)
        same = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(found, place(i)))
        return F.when(n > 0, F.array_join(same, " ")).otherwise(F.lit(""))

    return F.when(code % 10 == 0, let(words(text), repeated)).otherwise(text)


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text", with_planted_run(F.col("doc_id"), F.col("text")))
    found = runs.periodic_runs(docs)
    ahead = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(ahead(y, x), y).otherwise(x))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
