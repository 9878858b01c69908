"""Block-max WAND against adding up every posting, and planted passages."""

import random

import pytest
from silverleaf.llm import decontamination as dec

from .data import AWKWARD, awkward, empty, table


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def words(n, rng, k=300):
    return " ".join(f"w{rng.randint(0, k)}" for _ in range(n))


@pytest.mark.parametrize("block", [1, 3, 64])
def test_wand_retrieves_all_above_any_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(dec, "BLOCK", block)
    rng = random.Random(block)
    index = max(next(dec.indexes(items(spark, [words(rng.randint(3, 32), rng, 25) for _ in range(150)]))).indexes, key=lambda x: len(x.ids))
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.keys)), rng.randint(1, 60)))
        score = {}
        for t in terms:
            for d, x in zip(index.docs[t], index.impacts[t]):
                score[d] = score.get(d, 0) + x
        for limit in (0.02, 0.1, 0.3):
            got = dict(index.search(terms, limit))
            assert got == pytest.approx({d: s for d, s in score.items() if s >= limit - 1e-9})


def test_planted_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(9)
    tests = [f"{words(20, rng)}. {words(9, rng)}" for _ in range(30)]
    at = [0, 1, 63, 64, 500, 65_530, 65_600, 131_000]
    docs = [(k, f"{words(n, rng, 9999)} {tests[k]} {words(50, rng, 9999)}") for k, n in enumerate(at)]
    docs += [(100 + k, words(400, rng, 9999)) for k in range(10)] + [(200, tests[9].upper().replace(" ", "\n")), (201, tests[8].split(".")[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted([(k, k) for k in range(len(at))] + [(200, 9)])
    for size in (dec.INDEX_BYTES, 1500):  # one index, and several
        got = dec.matches(df, items(spark, tests), index_bytes=size)
        assert sorted((r["id"], r["item_id"]) for r in got.collect()) == want
    kept = dec.keep_clean(df, items(spark, tests)).collect()
    assert {r["doc_id"] for r in kept} == {d for d, _ in docs} - {d for d, _ in want}


def test_answers_count(spark):
    q, a = dec.halves("What is it? A thing that is so.")
    assert (q, a) == (["what", "is", "it"], ["a", "thing", "that", "is", "so"])
    q, a = dec.halves("one two three four five six")
    assert (len(q), len(a)) == (4, 2)


def test_whole_tables(spark):
    docs, bench = table(spark, "documents"), table(spark, "benchmark")
    joined = {r["item_id"]: " ".join(dec.words(r["text"])) for r in bench.collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in joined.items() if f" {t} " in f" {' '.join(dec.words(r['text']))} "}
    got = {(r["id"], r["item_id"]) for r in dec.matches(docs, bench).collect()}
    assert want and want <= got
    assert {d for d, _ in got} == {d for d, _ in want}


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "the same text as another document"), (2, None), (None, "some text"), (3, ""), (4, "x"), (5, "the same text as another document"), (None, "with some words")], "item_id long, text string")
    got = dec.matches(awkward(spark), bench).collect()
    assert sorted(((r["id"], r["item_id"]) for r in got if r["id"])) == [(5, 1), (5, 1), (5, 5), (5, 5), (6, 1), (6, 5)]
    assert [r["item_id"] for r in got if r["id"] is None] == [None]
    left = dec.keep_clean(awkward(spark), bench).collect()
    assert len(left) == len(AWKWARD) - 4 and not any(r["text"] and "some words" in r["text"] for r in left)
    assert dec.keep_clean(awkward(spark), bench).columns == awkward(spark).columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert dec.matches(awkward(spark), none).count() == 0 == dec.matches(empty(spark), bench).count()
    assert dec.keep_clean(awkward(spark), none).count() == awkward(spark).count()


def test_short_items_stand_whole_and_in_order(spark):
    bench = items(spark, ["river bank holiday", "north", "two words", "one two three four five six seven"])
    docs = [(0, "a river bank holiday trip"), (1, "river bank and a bank holiday"), (2, "the north wind"), (3, "before\nNorth.\nafter"), (4, "two words\n"), (5, "two words more"), (6, "so one two three four five six seven eight"), (7, "one two three and four five six seven")]
    got = {(r["id"], r["item_id"]) for r in dec.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(0, 0), (3, 1), (4, 2), (6, 3)}


def test_scripts_without_spaces(spark):
    japanese, thai = "日本語のテスト問題です。答えは東京です。", "เมืองหลวงของประเทศไทยคือกรุงเทพมหานคร"
    bench = items(spark, [japanese, thai])
    docs = [(0, f"前文があります。{japanese}後文もあります。"), (1, f"นี่คือข้อความ {thai} และอื่นๆ"), (2, "日本語の別の文章です。大阪は大きい町です。"), (3, "ข้อความอื่นที่ไม่เกี่ยวข้องกันเลย")]
    got = {(r["id"], r["item_id"]) for r in dec.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(0, 0), (1, 1)}


def test_items_of_all_lengths_keep_their_own_passages(spark):
    rng = random.Random(3)
    tests = [words(n, rng, 5000) for n in (3, 9, 10, 33, 200, 1500)]
    part = next(dec.indexes(items(spark, tests)))
    assert sorted(i for index in part.indexes for i in index.ids) == list(range(6)) and [index.step for index in part.indexes] == sorted(index.step for index in part.indexes)
    docs = spark.createDataFrame([(k, f"{words(300, rng, 9999)} {t} {words(300, rng, 9999)}") for k, t in enumerate(tests)], "doc_id long, text string")
    assert sorted((r["id"], r["item_id"]) for r in dec.matches(docs, items(spark, tests)).collect()) == [(k, k) for k in range(6)]


def test_operator_agrees_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(2)) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(texts) for _ in range(n))
    bench = [(k, f"{say(rng.randint(5, 40))}? {say(rng.randint(1, 20))}.") for k in range(12)]
    bench += [(20, say(300)), (21, "one short item stands here"), (22, "two words"), (23, "日本語のテスト問題です。答えは東京です。"), (24, "!!"), (25, None), (None, say(30)), (2, bench[2][1])]
    docs = [(k, say(rng.randint(0, 400))) for k in range(10)] + [(None, bench[0][1]), (50, ""), (51, None), (52, "x\nTwo  words!\ny"), (53, "and one short item stands here now"), (54, "see 日本語のテスト問題です。答えは東京です。")]
    for k, (_, t) in enumerate(b for b in bench if b[1]):
        ws = t.split(" ")
        docs += [(100 + k, f"{say(70)} {t} {say(70)}"), (200 + k, say(40) + " " + " ".join(ws[: len(ws) * 3 // 4]) + " " + say(9)), (300 + k, " ".join(w for w in ws if rng.random() < 0.9))]
    docs += docs[-3:]
    con = duckdb.connect()
    for name, columns, rows in (("documents", "doc_id BIGINT, text VARCHAR", docs), ("benchmark", "item_id BIGINT, text VARCHAR", bench)):
        con.execute(f"CREATE TABLE {name} ({columns})")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    got = dec.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    want = con.sql(dec.ORACLE_SQL).fetchall()
    assert len(want) > 30 and any(r[2] < 1 for r in want)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_an_item_is_found_whatever_others_there_are(spark):
    """Halves of a 40-word item at every distance, alone, beside longer items, and over any number of indexes."""
    rng = random.Random(11)
    one = words(40, rng, 5000).split(" ")
    others = [words(n, rng, 9000) for n in (63, 64, 65, 256, 257, 12)]
    docs = [(gap, " ".join([words(90, rng, 20000), *one[:20], words(gap, rng, 20000), *one[20:], words(90, rng, 20000)])) for gap in range(0, 120, 6)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    alone = {r["id"] for r in dec.matches(df, items(spark, [" ".join(one)])).collect()}
    assert 0 in alone and len(alone) < len(docs)
    for size in (400, 4_000, dec.INDEX_BYTES):
        got = dec.matches(df, items(spark, [" ".join(one), *others]), index_bytes=size).collect()
        assert {r["id"] for r in got if r["item_id"] == 0} == alone
    assert [dec.step_of(n) for n in (3, 9, 10, 64, 65, 256, 257, 4096, 4097)] == [32, 32, 64, 64, 256, 256, 1024, 4096, 16384]
