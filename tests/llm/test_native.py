"""Sharding and quality rules: no Python in their plans, results against brute force."""

import hashlib
import re
from collections import Counter

import pytest
from silverleaf.llm import quality_rules as rules
from silverleaf.llm import sharding

from .data import ALL_IDS, awkward, empty, ids, table

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_base(text):
    text = text or ""
    ws = WORD.findall(text)
    seen = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {k + d for k in range(len(ws) - 2) if seen[tuple(ws[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_full_even_and_steady():
    names = sharding.shard_names(7)
    made = sharding.fill(names, 701)
    assert set(Counter(made).values()) <= {100, 101}
    fewer = sharding.fill(names[:-1], 701)
    moved = sum(a != b for a, b in zip(made, fewer) if a != 6)
    assert moved < 0.1 * 701
    for names, size in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.fill(names, size)


def test_placement_is_the_tables(spark):
    df = sharding.place(awkward(spark))
    assert not re.search("Python|Arrow|Pandas|ExistingRDD.*slot", plan(df).split("Scan ExistingRDD")[0])
    rows = df.collect()
    assert ids(rows) == ALL_IDS
    made = sharding.fill(sharding.shard_names(sharding.SHARDS), sharding.TABLE_SIZE)
    for r in rows:
        assert r["shard"] == made[r["slot"]]
        if r["id"] is not None:
            assert r["slot"] == int(hashlib.md5(str(r["id"]).encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
    assert sharding.place(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.place(empty(spark), [])


def test_base_counts_equal_brute_force(spark):
    odd = [(10_000 + k, t) for k, t in enumerate(["a a a a a", "a b c x a b c", "x\n\n x\nx\n\ny", "#*$%&|<> ~", "w " * 49, "w " * 50, "  　", "a\x1cb c"])]
    others = awkward(spark, False).filter("doc_id IS NOT NULL AND doc_id <> 5").selectExpr("-doc_id AS doc_id", "text")
    docs = table(spark, "documents").select("doc_id", "text").unionByName(others)
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r["id"]: r for r in rules.score(docs, [0.0] * rules.BUCKETS).collect()}
    for r in docs.collect():
        q, want = got[r["doc_id"]], brute_base(r["text"])
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert (q["base_failed"], q["kept"], q["log_ratio"]) == (failed, not failed, 0.0)


def test_log_ratios_equal_brute_force(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    texts = {r["doc_id"]: WORD.findall(r["text"] or "") for r in docs.collect()}
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    from pyspark.sql import functions as F

    words = sorted({w for ws in texts.values() for w in ws})
    pairs = sorted({p for ws in texts.values() for p in zip(ws, ws[1:])})
    unit = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", rules._unit(F.xxhash64("w"))).collect()}
    pair = {(r[0], r[1]): r[2] for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", rules._pair(F.xxhash64("a"), F.xxhash64("b"))).collect()}
    grams = {d: [unit[w] for w in ws] + [pair[p] for p in zip(ws, ws[1:])] for d, ws in texts.items()}
    corpus = Counter(g for gs in grams.values() for g in gs)
    trusted = Counter(g for d in good for g in grams.get(d, []))
    import math

    share = sum(trusted.values()) / sum(corpus.values())
    want = [math.log(trusted[b] + rules.PRIOR) - math.log(corpus[b] * share + rules.PRIOR) for b in range(rules.BUCKETS)]
    got = rules.train(docs, labels)
    assert got == pytest.approx(want)
    scored = rules.score(docs, got)
    assert not re.search("Python|Arrow|Pandas", plan(scored))
    for r in scored.collect():
        gs = grams[r["id"]]
        assert r["log_ratio"] == pytest.approx(sum(want[g] for g in gs) / max(1, len(gs)))


def test_every_trusted_document_counts(spark):
    docs = spark.range(9_000).selectExpr("id AS doc_id", "concat('w', id, ' and') AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality")
    assert set(rules.train(docs, labels)) == {0.0}
    nameless = spark.createDataFrame([(None, "w1 and")], "doc_id long, text string")
    counts = rules.bucket_counts(docs.unionByName(nameless), labels).selectExpr("sum(corpus)", "sum(trusted)").first()
    assert tuple(counts) == (27_003, 27_000)


def test_awkward_rows(spark):
    labels = spark.createDataFrame([(5, 1), (8, 1), (4, 0)], "doc_id long, quality int")
    got = rules.score(awkward(spark), rules.train(awkward(spark), labels)).collect()
    assert ids(got) == ALL_IDS and all(r["base_failed"] and not r["kept"] for r in got if r["id"] != 8)
    assert set(rules.train(empty(spark), labels)) == {0.0}
    assert rules.score(empty(spark), [0.0] * rules.BUCKETS).count() == 0
