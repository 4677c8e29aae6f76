"""Stages of the pipeline with Python workers hold few whole texts at a time."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_files_are_read_in_small_batches(spark, tmp_path):
    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {name: spark.conf.get(name) for name in names}
    rows = [(k, f"mail a{k}@example.com " * 20, 0) for k in range(3000)] + [(3000, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars int").coalesce(1).write.parquet(str(tmp_path / "docs"))
    try:
        spark.conf.set(names[0], "4096")
        found = corpus_pipeline.personal_data(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect()
        assert all(int(spark.conf.get(name)) <= 500 for name in names)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(found) == 3001
    assert {r["doc_id"] for r in found if r["text"] == "mail [EMAIL] " * 20} == set(range(3000))
    assert [r["n_chars"] for r in found if r["doc_id"] == 3000] == [None]
