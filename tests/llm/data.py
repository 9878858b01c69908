"""Small documents with every awkward row, and the test tables where they exist."""

from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")
DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
#: Names that operators use inside, as columns that are already there.
CLASH = ["id", "score", "fp", "key", "block", "body", "n", "w", "tid", "row", "part", "slot", "shard", "ids", "root", "component_id", "bucket", "count"]

LONG = "Ünïcode wörds and the like go on, " * 40_000
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b ", "en", "a", 5),
    (4, "one", "en", None, 3),
    (5, "the same text as another document here", "en", "a", 38),
    (5, "the same text as another document here", "en", "a", 38),
    (6, "the same text as another document here", "en", "b", 38),
    (None, "a text without an id but with some words", "en", "b", 40),
    (None, None, None, None, None),
    (7, "<|endoftext|> 日本語 テキスト é ﬁ İ ß  x 123 ½", "xx", "c", 40),
    (8, LONG, "de", "c", len(LONG)),
    (9, "a b a b a b a b", "en", "c", 15),
]


def awkward(spark, clash: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, DOCS).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH}) if clash else df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(spark, name, size=SF.name):
    if not SF.exists():
        pytest.skip("no test tables here")
    return spark.read.parquet(f"{SF.parent / size}/{name}.parquet")


def ids(rows, column="id"):
    return sorted((r[column] for r in rows), key=lambda i: (i is None, i))


ALL_IDS = sorted((r[0] for r in AWKWARD), key=lambda i: (i is None, i))
