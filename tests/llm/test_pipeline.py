"""The pipeline's stages: what goes, what stays, and with which columns."""

import corpus_pipeline
from silverleaf.llm import queries

from pyspark.sql import functions as F

from .data import AWKWARD, SF, awkward, empty, table


def test_stages_filter_whole_rows_in_order(spark):
    docs = table(spark, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_dedup", "decontamination", "bpe"]
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(SF)).cache()
        assert after.schema == docs.schema
        assert 0 < after.count() <= before.count() and after.join(before, docs.columns, "left_anti").count() == 0
        before = after
    assert before.count() > 0.5 * docs.count()


def test_run_ends_with_digests(spark):
    docs = table(spark, "documents")
    made = corpus_pipeline.run(spark, str(SF))
    assert made.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    whole = queries.encoded(docs)
    assert 0 < made.count() < docs.count() and made.join(whole, made.columns, "left_anti").count() == 0


def test_every_operator_is_registered():
    names = sorted(queries.QUERIES, key=lambda n: int(n.split("_")[0][2:]))
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]


def tables(spark, folder, docs):
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, name).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_awkward_rows_and_clashing_columns_go_through_every_stage(spark, tmp_path):
    known = table(spark, "documents").withColumn("doc_id", F.col("doc_id") + 1000)
    docs = known.unionByName(awkward(spark), allowMissingColumns=True)
    folder = tables(spark, tmp_path, docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        assert after.exceptAll(docs).isEmpty()
    made = corpus_pipeline.run(spark, folder).collect()
    assert not {1, 2, 3} & {r["doc_id"] for r in made}  # no letter, no language
    assert sum(r["doc_id"] == 5 for r in made) <= 1 and not any(r["doc_id"] == 6 for r in made)  # copies of one another
    assert len(AWKWARD) and {r["doc_id"] for r in made} & {r["doc_id"] for r in known.collect()}


def test_an_empty_table_goes_through_every_stage(spark, tmp_path):
    folder = tables(spark, tmp_path, empty(spark))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, empty(spark), folder)
        assert after.columns == empty(spark).columns and after.isEmpty()
    assert corpus_pipeline.run(spark, folder).isEmpty()


def test_run_is_its_stages_one_after_another(spark):
    """Against brute force: each stage's own rows, worked out document by document."""
    from silverleaf.llm import decontamination, language_id, near_dedup, toxicity

    docs = table(spark, "documents").collect()
    frame = lambda rows: spark.createDataFrame(rows, table(spark, "documents").schema)
    model = language_id.train(frame(docs))
    docs = [r for r in docs for lang, score in [model.predict([r["text"]])] if lang[0] != "und" and score[0] >= language_id.MIN_SCORE]
    model = toxicity.train(frame(docs), table(spark, "labels"))
    docs = [r for r in docs if model.scores([r["text"]], {})[0] < toxicity.THRESHOLD]
    prints = {r["doc_id"]: near_dedup.fingerprint(r["text"]) for r in docs}
    component = {d: d for d in prints}
    while True:
        least = {d: min(component[o] for o in prints if (prints[d] ^ prints[o]).bit_count() <= 4) for d in prints}
        if least == component:
            break
        component = least
    docs = [r for r in docs if component[r["doc_id"]] == r["doc_id"]]
    whole = [f" {' '.join(decontamination.words(r['text']))} " for r in table(spark, "benchmark").collect()]
    docs = [r for r in docs if not any(w in f" {' '.join(decontamination.words(r['text']))} " for w in whole)]
    made = corpus_pipeline.run(spark, str(SF))
    assert sorted(r["doc_id"] for r in made.collect()) == sorted(r["doc_id"] for r in docs)
