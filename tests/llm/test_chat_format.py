"""Formatting is undone exactly, and every reply is trained on once."""

import hashlib
import random
from collections import defaultdict

import pytest
from silverleaf.llm import chat_format as chat

PARTS = ["<", "[", "\\", "</s>", "[INST] ", " [/INST]", "<a> ", "<<SYS>>", "<</SYS>>", "<r>", "</r>", "<e>", "x", "é", "\n", " ", ""]


def rows():
    rng = random.Random(3)
    out = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in range(200):
        for k in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "assistant", "system", "to<ol[\\", "", None])
            out.append((c, k, role, rng.choice([None, "".join(rng.choices(PARTS, k=rng.randint(0, 12)))])))
    return [*out, (500, 1, "user", "same"), (500, 1, "user", "same"), (500, None, "assistant", "first"), (501, 0, "assistant", "<\\" * 5000)]


@pytest.mark.parametrize("text", ["", "<", "\\", "<\\", "[\\<", "\\\\<[", "</s>", "a\\b<c[d"])
def test_escape_is_undone(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "</s>" not in chat.escape(text)


def test_reading_back_gives_what_was_said(spark):
    made = spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string").repartition(5)
    got = {r["conv_id"]: r for r in chat.read_back(chat.examples(made)).collect()}
    said = defaultdict(list)
    for c, k, role, text in rows():
        said[c].append((k is not None, k, role or "", text or ""))
    assert set(got) == set(said)
    for c, turns in said.items():
        turns = [t[2:] for t in sorted(turns)]
        replies = "".join(t for r, t in turns if r == "assistant")
        q = got[c]
        assert q["n_turns"] == len(turns)
        assert q["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (q["loss_chars"], q["loss_sha256"]) == (len(replies), hashlib.sha256(replies.encode()).hexdigest())


def test_each_reply_is_an_example_with_all_before_it(spark):
    turns = [(1, 0, "system", "S"), (1, 1, "user", "U1"), (1, 2, "assistant", "A1"), (1, 3, "user", "U2"), (1, 4, "assistant", "A2"), (1, 5, "user", "U3")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = sorted(chat.examples(df).collect(), key=lambda r: r["example"])
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in made] == ["A1", "A2", ""]
    assert [list(chat.read_turns(r["text"])) for r in made] == [[t[2:] for t in turns[:3]], [t[2:] for t in turns[:5]], [t[2:] for t in turns]]
    assert [r["last"] for r in made] == [False, False, True]


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, example string")
    assert chat.read_back(chat.examples(df)).count() == 0
    with pytest.raises(ValueError):
        list(chat.read_turns("not a turn"))


def test_rows_without_an_id_are_conversations_of_their_own(spark):
    data = [(None, k % 3, "assistant" if k % 2 else "user", f"said {k % 7}") for k in range(300)] + [(1, 0, "user", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(6)
    got = chat.read_back(chat.examples(df)).collect()
    assert len(got) == 301 and all(r["n_turns"] == 1 for r in got)
    assert sum(r["loss_chars"] for r in got) == sum(len(t) for _, _, role, t in data if role == "assistant")


def test_examples_that_were_moved_are_sorted_or_refused(spark):
    clash = "conv_id long, turn long, role string, text string, example string, last string, alone string"
    data = [(c, k, "assistant" if k % 2 else "user", f"turn {k} of {c}", "x", "y", "z") for c in range(20) for k in range(9)]
    made = chat.examples(spark.createDataFrame(data, clash)).withColumn("other", chat.F.lit(1))
    want = sorted(map(tuple, chat.read_back(made).collect()))
    moved = spark.createDataFrame(made.collect(), made.schema).repartition(3).orderBy(chat.F.xxhash64("text"))
    assert sorted(map(tuple, chat.read_back(moved, dealt=False).collect())) == want
    with pytest.raises(Exception, match="out of order|missing"):
        chat.read_back(moved).collect()
    with pytest.raises(Exception, match="out of order|missing"):
        chat.read_back(made.filter("not last")).collect()


def test_a_long_conversation_keeps_every_reply(spark):
    turns = spark.range(600).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id, repeat(' word', 20)) AS text")
    made = chat.examples(turns)
    assert made.count() == 300 and made.filter("last").count() == 1
    got = chat.read_back(made).first()
    assert got["n_turns"] == 600 and got["loss_chars"] == turns.filter("role = 'assistant'").selectExpr("sum(length(text))").first()[0]
