"""Folds and bounded samples."""

import zlib

from pyspark.sql import functions as F
from silverleaf.llm.common import bounded_sample, fold_is, id_bucket, labelled_rows


def test_folds_are_crc32_of_the_id_as_text(spark):
    df = spark.range(-50, 50).unionByName(spark.createDataFrame([(None,)], "id long"))
    for r in df.select("id", id_bucket("id", 5).alias("b"), fold_is("id", 5, 0).alias("f")).collect():
        if r["id"] is None:
            assert r["b"] is None and r["f"] is False
        else:
            want = zlib.crc32(str(r["id"]).encode()) % 5
            assert (r["b"], r["f"]) == (want, want == 0)


def test_samples_are_bounded_whole_when_small_and_steady(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") < 100, "small").when(F.col("id") < 120, None).otherwise("large").alias("g"))
    got = bounded_sample(rows, 500, "g", ["id"], 1)
    counts = {r["g"]: r["count"] for r in got.groupBy("g").count().collect()}
    assert counts["small"] == 100 and 350 < counts["large"] < 650 and None not in counts
    again = bounded_sample(rows.repartition(17), 500, "g", ["id"], 1)
    assert {r["id"] for r in got.collect()} == {r["id"] for r in again.collect()}
    assert bounded_sample(rows.limit(0), 500, "g", ["id"], 1).count() == 0


def test_an_id_with_many_texts_does_not_outgrow_the_sample(spark):
    docs = spark.range(4_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    known = spark.createDataFrame([(7, 1)], "doc_id long, toxic int")
    assert 50 < labelled_rows(docs, known, "toxic", 100, 1).count() < 200
    assert labelled_rows(docs.limit(30), known, "toxic", 100, 1).count() == 30
    assert labelled_rows(docs.limit(0), known, "toxic", 100, 1).count() == 0
