"""Training-data pipeline: from raw documents to packed sequences in five stages.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the next
table. All but the last return the columns of their input. A table that no document
survives goes through all stages and gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambergrid.llm import jaccard, mixing, packing, pii, quality
from ambergrid.llm.common import filter_rows, table
from ambergrid.plans.packaging import ship_package
from ambergrid.session import materialise

TOKENIZER = "word_bpe_49k.json"
#: Rows of an Arrow batch. Spark's own 10,000 whole texts are tens of megabytes, held several times
#: over by the JVM and by each worker while the heap is still full of the stage before.
BATCH_ROWS = 500


def use_workers(spark: SparkSession) -> None:
    """Prepare a stage that runs in Python workers: the package, and small batches to the workers and from files.

    The reader's own 4096 whole texts are arrays of many megabytes, for which the heap grows to its
    limit beside the workers.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    rejected = quality.quality(docs).where(~F.col("kept")).select("row_key").distinct()
    return filter_rows(docs, materialise(rejected, "rejected"), "doc_id", keep=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word similarity 0.8 or more stays, the smallest doc_id."""
    use_workers(spark)
    found = materialise(jaccard.jaccard_groups(docs, width=5, percent=80), "groups")
    kept = filter_rows(docs, materialise(found.where("not stays").select("row_key").distinct(), "gone"), "doc_id", keep=False)
    repeated = found.where("stays").groupBy("row_key").count().where("count > 1")
    return kept.dropDuplicates(["doc_id", "text"]) if repeated.limit(1).count() else kept


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; n_chars follows."""
    use_workers(spark)
    covered = docs.withColumn("text", pii.redacted(F.col("text")))
    return covered.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is brought to its target number of words, by repeats and one cut."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of sequences of 4096."""
    use_workers(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), ["doc_id"])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
#: Tokenizing and language-dependent outliers have no SQL form; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
