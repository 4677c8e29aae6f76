"""Types found for CSV columns."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ambergrid.sources import tables as src
from conftest import SF_SMALL


def read(spark, tmp_path, text, **options):
    (tmp_path / "t.csv").write_text(text)
    return src.read_csv(spark, str(tmp_path / "t.csv"), **options)


@pytest.mark.parametrize(
    "values, kind",
    [
        (["true", "FALSE", ""], "boolean"),
        (["1", "-2", "+3", ""], "bigint"),
        (["1", "2.5", "-1e3"], "double"),
        (["NaN", "1", "Infinity"], "double"),
        (["9223372036854775807"], "bigint"),
        (["9223372036854775808", "1"], "double"),
        (["2024-01-31", ""], "date"),
        (["2024-02-30"], "string"),
        (["2024-01-31", "2024-01-31 10:00:00"], "timestamp_ntz"),
        (["2024-01-31T10:00:00.123456"], "timestamp_ntz"),
        (["2024-01-31T10:00:00Z", "2024-01-31 10:00"], "timestamp"),
        (["1", "true"], "string"),
        (["1", "x"], "string"),
        (["2024-01-31", "7"], "string"),
        ([" 1"], "string"),
        (["", ""], "string"),
        ([], "string"),
    ],
)
def test_types(spark, tmp_path, values, kind):
    found = read(spark, tmp_path, "\n".join(["a,b", *[f"{v},x" for v in values]]) + "\n")
    assert dict(found.dtypes)["a"] == kind
    assert found.count() == len(values)
    filled = [v for v in values if v]
    assert found.where("a is not null").count() == len(filled)


def test_ragged_quoted_and_odd_names(spark, tmp_path):
    text = 'a,b.c,d e\n1,"x, y",2.5\n2\n3,"say ""hi""",7,surplus\n4,,\n'
    found = read(spark, tmp_path, text, escape='"')
    assert found.dtypes == [("a", "bigint"), ("b.c", "string"), ("d e", "double")]
    assert [tuple(r) for r in found.orderBy("a").collect()] == [
        (1, "x, y", 2.5), (2, None, None), (3, 'say "hi"', 7.0), (4, None, None),
    ]


def test_one_late_text_widens_the_column(spark, tmp_path):
    text = "a\n" + "1\n" * 5000 + "1.5\n"
    found = read(spark, tmp_path, text)
    assert found.dtypes == [("a", "double")] and found.agg(F.sum("a")).first()[0] == 5001.5


@pytest.mark.parametrize("name", ["orders", "lineitem", "customer", "events"])
def test_types_equal_those_of_another_reader(spark, tmp_path, name):
    folder = str(tmp_path / name)
    src.table(spark, SF_SMALL, name).coalesce(1).write.option("header", True).option("escape", '"').csv(folder)
    found = src.read_csv(spark, folder, escape='"')
    sniffed = duckdb.sql(f"DESCRIBE SELECT * FROM read_csv('{folder}/*.csv', header = true, sample_size = -1)").fetchall()
    names = {"BIGINT": "bigint", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "VARCHAR": "string", "BOOLEAN": "boolean"}
    assert found.dtypes == [(column, names[kind]) for column, kind, *_ in sniffed]
    assert found.count() == src.table(spark, SF_SMALL, name).count()
