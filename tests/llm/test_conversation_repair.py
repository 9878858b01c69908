"""Repairs are the cheapest ones, the least among equals, and the same however rows are spread."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from silverleaf.llm import conversation_repair as repair

from .data import table


def cheapest(kinds):
    """(cost, letters) by trying every edit of every row, keeping the best of each state."""

    def inserted(best):
        for _ in range(4):
            for s, (c, x) in list(best.items()):
                for r, t in repair.NEXT[s].items():
                    if r in "ua":
                        best[t] = min(best.get(t, (1 << 40, "")), (c + 2, x + "I"))
        return best

    best = inserted({0: (0, "")})
    for initial, fault in kinds:
        new = {}
        for s, (c, x) in best.items():
            options = [("D", s, 3)]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                options += [("K", t, more) for r, t in repair.NEXT[s].items() if r == initial]
                options += [("R", t, 2 + more) for r, t in repair.NEXT[s].items() if r in "ua"]
            for letter, t, w in options:
                new[t] = min(new.get(t, (1 << 40, "")), (c + w, x + letter))
        best = inserted(new)
    return min(v for s, v in best.items() if s in (0, 3))


def test_letters_are_the_cheapest_and_least():
    rng = random.Random(1)
    for _ in range(5000):
        kinds = [(rng.choice(["s", "u", "a", "x", ""]), rng.choice([None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 9))]
        assert repair.repair_letters(kinds) == cheapest(kinds)[1]


@pytest.mark.parametrize("rows,letters,text", [
    ([("user", "Hi."), ("assistant", "Yo.")], "KK", "user:Hi.\nassistant:Yo."),
    ([("user", "Hi.")], "KI", "user:Hi.\nassistant:"),
    ([("system", "S."), ("assistant", "Yo.")], "KIK", "system:S.\nuser:\nassistant:Yo."),
    ([("user", " "), ("user", "\x0b")], "DD", ""),
    ([("system", "S.")], "D", ""),
])
def test_small_conversations(spark, rows, letters, text):
    df = spark.createDataFrame([(1, k, r, t, "clash", 0) for k, (r, t) in enumerate(rows)], "conv_id long, turn long, role string, text string, fault string, step long")
    (got,) = repair.digests(repair.repair(df)).collect()
    assert (got["audit"], got["repaired_sha256"]) == (letters, hashlib.sha256(text.encode()).hexdigest())


def awkward():
    rng = random.Random(4)
    words = ["Yes.", "No", "ok!", "", " \n", None, "Well?  ", "日本。", "a.b"]
    out = []
    for c in [*range(60), None]:
        for k in range(rng.randint(1, 12)):
            out.append((c, rng.choice([k, k, k + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "sysop", "tool", None]), rng.choice(words)))
    return [*out, *[(1000, k // 3, "user", "again.") for k in range(30)], (1001, None, "user", "x" * 200_000), (1001, None, "user", "x" * 200_000)]


def expected(rows):
    groups = defaultdict(list)
    for c, k, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if k is None else k}".encode()) % 20
        groups[c]
        if h == 0:
            continue
        text = "" if h == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if h == 2 else text
        groups[c] += [(k, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for c, held in groups.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds = set(), []
        for _, role, text in held:
            bare = text.strip(" \t\n\x0b\x0c\r")
            kinds.append((role[:1], "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        cost, letters = cheapest(kinds)
        lines, state, taken = [], 0, iter(held)
        for x in letters:
            row = None if x == "I" else next(taken)
            if x != "D":
                role = row[1] if x == "K" else {"u": "user", "a": "assistant"}[next(r for r in repair.NEXT[state] if r in "ua")]
                state = repair.NEXT[state][role[0]]
                lines.append(f"{role}:{row[2] if row else ''}")
        turns = {k for k, _, _ in held if k is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        counts = [sum(f == x for _, f in kinds) for x in repair.FAULTS]
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture
def apart(spark):
    """Small partitions stay as they are, so that conversations lie in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize("large", [100_000, 3, 0])
def test_awkward_rows_and_spread_conversations(spark, apart, large):
    rows = awkward()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repaired_conversations(df, large).collect()}
    assert got == expected(rows)


def test_one_conversation_over_many_tasks(spark, apart):
    rng = random.Random(9)
    rows = [(5, k, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "b", "c?", f"{k}."])) for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    edits = repair.repair(repair.damaged(df), 100)
    assert edits.rdd.getNumPartitions() > 2
    whole, spread = (repair.digests(repair.repair(repair.damaged(df), n)).collect() for n in (100_000, 100))
    assert whole == spread
    assert [r["step"] for r in edits.orderBy("step").collect()] == list(range(edits.count()))


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired_conversations(df).count() == 0


def test_every_conversation_of_the_table(spark):
    df = table(spark, "conversations")
    got = repair.repaired_conversations(df).collect()
    assert sorted(r["conv_id"] for r in got) == sorted(r[0] for r in df.select("conv_id").distinct().collect())
