"""Conversation structure repair: the cheapest edits that make roles alternate.

A conversation is a path through a DAG whose nodes are (rows taken, state of the grammar
``(system? (user assistant)+)?``) and whose arcs are edits: Keep, Rerole and Delete take a
row, Insert takes none. Minimum costs from the front and from the back tell which arcs are
tight, i.e. lie on some cheapest path. The repair then walks forward with the set of all
states that its letters so far can have led to, and takes the least letter (D < I < K < R)
that any tight arc from the set has. Paths with equal letters have taken equally many rows
at equal cost, so such a set never spreads over several rows.

Only a row's class (its role's initial and its fault) matters to costs, so each step is
looked up, and as each state has one successor for a letter, the set stays a single state.
Conversations of usual size are dealt out by id, sorted, and repaired one at a
time. Those above ``LARGE`` rows or ``LARGE_CHARS`` characters are range-partitioned by
their rows, so one conversation may lie in any number of tasks: a task gives the costs from
each state to each state over its part, the driver chains these few numbers (one row for
each part of a conversation), parts answer in which state they'd be left for each that
they may be entered in, and at last every part is walked from the state it really gets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpoint
from . import crc32_sql

#: Rows and characters of a conversation from which it is spread over tasks.
LARGE, LARGE_CHARS = 100_000, 64_000_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED_COST = 0, 2, 3, 2, 1
USER, ASSISTANT = "user", "assistant"
ROLE = {"u": USER, "a": ASSISTANT}
#: States of the grammar: nothing yet, after system, after user, after assistant; what each may be followed by.
START, SYSTEM, ASKED, ANSWERED = range(4)
NEXT = [{"s": SYSTEM, "u": ASKED}, {"u": ASKED}, {"a": ANSWERED}, {"u": ASKED}]
ENDS = (START, ANSWERED)
FAR = 1 << 60
BATCH = 4096

FAULTS = ("blank", "duplicate", "truncated")
EDITS = "conv_id long, step long, edit string, fault string, turn long, role_before string, role string, text string"
_ARROW = pa.schema([("conv_id", pa.int64()), ("step", pa.int64()), ("edit", pa.string()), ("fault", pa.string()), ("turn", pa.int64()), ("role_before", pa.string()), ("role", pa.string()), ("text", pa.string())])


@lru_cache(maxsize=4096)
def arcs(initial: str, fault: str | None) -> tuple[tuple[int, str, int, int], ...]:
    """(state, letter, next state, cost) of every edit that takes a row of this class."""
    out = [(s, "D", s, DELETE) for s in range(4)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED_COST if fault == "truncated" else 0
        for s in range(4):
            out += [(s, "K", t, KEEP + more) for r, t in NEXT[s].items() if r == initial]
            out += [(s, "R", t, REROLE + more) for r, t in NEXT[s].items() if r in ROLE]
    return tuple(out)


INSERTS = [(s, "I", t, INSERT) for s in range(4) for r, t in NEXT[s].items() if r in ROLE]


def _relaxed(costs: list[int], back: bool) -> list[int]:
    """Costs with any number of insertions at this place."""
    while True:
        before = list(costs)
        for s, _, t, w in INSERTS:
            if back:
                costs[s] = min(costs[s], costs[t] + w)
            else:
                costs[t] = min(costs[t], costs[s] + w)
        if costs == before:
            return costs


@lru_cache(maxsize=1 << 16)
def _step(costs: tuple[int, ...], kind: tuple[str, str | None], back: bool) -> tuple[tuple[int, ...], int]:
    """Costs after (before) a row, less their least, and that least. costs hold insertions at their place."""
    out = [FAR] * 4
    for s, _, t, w in arcs(*kind):
        if back:
            out[s] = min(out[s], costs[t] + w)
        else:
            out[t] = min(out[t], costs[s] + w)
    out = _relaxed(out, back)
    least = min(out)
    return tuple(min(FAR, c - least) for c in out), least


def costs_along(kinds: list, entry: tuple[int, ...], back: bool = False) -> list[tuple[tuple[int, ...], int]]:
    """(costs of the states less their least, that least) at every place, from the front or the back; entry holds insertions."""
    least = min(entry)
    out = [(tuple(min(FAR, c - least) for c in entry), least)]
    for kind in reversed(kinds) if back else kinds:
        costs, more = _step(out[-1][0], kind, back)
        out.append((costs, out[-1][1] + more))
    return out[::-1] if back else out


def walk(kinds: list, ahead: list, behind: list, states: frozenset[int], last: bool) -> tuple[str, frozenset[int]]:
    """The least letters over tight arcs from a set of states, and the set that is left after all rows.

    ahead and behind are the costs from the front and the back at every place. Insertions
    behind the last row belong to the next part, or to this one if it is the last.
    """
    total = min(a + b for a, b in zip(ahead[0][0], behind[0][0])) + ahead[0][1] + behind[0][1]
    letters = []
    for k in range(len(kinds) + 1):
        front, base = ahead[k]
        row = arcs(*kinds[k]) if k < len(kinds) else ()
        if k == len(kinds) and not last:
            break
        while True:
            at: dict[str, set[int]] = {}
            for options, (there, least) in ((INSERTS, behind[k]), (row, behind[k + 1] if row else behind[k])):
                for s, letter, t, w in options:
                    if s in states and front[s] + base + w + there[t] + least == total:
                        at.setdefault(letter, set()).add(t)
            if not at:
                break  # nothing follows: the end
            letter = min(at)
            letters.append(letter)
            states = frozenset(at[letter])
            if letter != "I":
                break
    return "".join(letters), states


START_COSTS = tuple(_relaxed([0, FAR, FAR, FAR], False))
END_COSTS = tuple(_relaxed([0 if s in ENDS else FAR for s in range(4)], True))


def repair_letters(kinds: list[tuple[str, str | None]]) -> str:
    """The cheapest edits of rows given by (role initial, fault), least in ASCII among equally cheap ones."""
    return walk(kinds, costs_along(kinds, START_COSTS), costs_along(kinds, END_COSTS, True), frozenset([START]), True)[0]


def applied(letters: str, rows: Iterator[tuple], after: int = START) -> Iterator[tuple]:
    """(edit, row or None, new role) for each letter; after: the state before the first."""
    state = after
    rows = iter(rows)
    for letter in letters:
        row = None if letter == "I" else next(rows)
        if letter == "D":
            yield letter, row, None
            continue
        role = row[0] if letter == "K" else next(ROLE[r] for r in NEXT[state] if r in ROLE)
        state = NEXT[state][role[:1]]
        yield letter, row, role


# Rows and their faults.


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32 of `conv_id:turn` modulo 20.

    0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes
    its role user. Nulls of role and text, and in the hashed name, are one space; null ids
    and turns stay null. Other columns are not read.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"), F.pmod(F.crc32(F.concat_ws(":", one("conv_id"), one("turn")).cast("binary")), F.lit(20)).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    changed = rows.filter("h != 0").select("conv_id", "turn", F.when(F.col("h") == 4, USER).otherwise(F.col("role")).alias("role"), text.alias("text"), "h")
    return changed.withColumn("again", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("h", "again")


def own_fault(text: Column) -> Column:
    """The fault that a text shows by itself."""
    shown = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(shown == "", "blank").when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated")


ORDER = ["conv_id", "turn", "role", "text"]


def _whole(rows: DataFrame) -> DataFrame:
    """Edits of conversations that a task holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        seen: set[tuple[str, str]] = set()
        conv, begun = None, False

        def repaired() -> Iterator[tuple]:
            letters = repair_letters([(r[0][:1], r[3]) for r in held])
            for k, (edit, row, role) in enumerate(applied(letters, held)):
                yield (conv, k, edit, None, None, None, role, "") if row is None else (conv, k, edit, row[3], row[2], row[0], role, row[1])

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
            out.clear()
            return made

        for b in batches:
            for i, turn, role, text, fault in zip(*(c.to_pylist() for c in b.columns)):
                if begun and i != conv:
                    for x in repaired():
                        out.append(x)
                        if len(out) >= BATCH:
                            yield flush()
                    held.clear()
                    seen.clear()
                conv, begun = i, True
                if fault != "blank":
                    if (role, text) in seen:
                        fault = "duplicate"
                    seen.add((role, text))
                held.append((role, text, turn, fault))
        if begun:
            for x in repaired():
                out.append(x)
                if len(out) >= BATCH:
                    yield flush()
        if out:
            yield flush()

    dealt = rows.select(*ORDER, "fault").repartition("conv_id").sortWithinPartitions(*ORDER)
    return dealt.mapInArrow(run, EDITS)


def _with_duplicates(rows: DataFrame) -> DataFrame:
    """Rows with `duplicate` as the fault of those whose role and text were seen earlier; no content's rows gather."""
    content = ["conv_id", "role", "text"]
    same = checkpoint(rows.groupBy(*content, "turn", "fault").agg(F.count("*").alias("n")))  # equal rows are one until the end
    first = same.groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("p"), "turn")).alias("first"), F.count("*").alias("places"))
    keyed = same.withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    again = first.filter("places > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("g"), "first")
    on = keyed["conv_id"].eqNullSafe(again["c"]) & (keyed["role"] == again["r"]) & (keyed["h"] == again["g"])
    found = keyed.join(again, on, "left")
    leads = F.col("first").isNull() | F.col("first.turn").eqNullSafe(F.col("turn"))
    each = found.select(*ORDER, "fault", leads.alias("leads"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    fault = F.when((F.col("fault") == "blank") | (F.col("leads") & (F.col("k") == 1)), F.col("fault")).otherwise("duplicate")
    return each.select(*ORDER, "k", fault.alias("fault"))


def _spread(rows: DataFrame) -> DataFrame:
    """Edits of conversations that lie in many tasks; see the module's docstring."""
    order = [*ORDER, "k"]
    placed = checkpoint(_with_duplicates(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    kinds = placed.select("conv_id", "part", F.substring("role", 1, 1).alias("i"), "fault")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, int, list]]:
        """(conv_id, part, kinds) of each conversation's rows in a task."""
        conv, part, held = None, None, []
        for b in batches:
            for c, p, i, fault in zip(*(x.to_pylist() for x in b.columns)):
                if held and (c, p) != (conv, part):
                    yield conv, part, held
                    held = []
                conv, part = c, p
                held.append((i, fault))
        if held:
            yield conv, part, held

    names = ["conv_id", "part", "costs", "n"]

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, p, held in parts(batches):
            flat = []
            for s in range(4):
                front, least = costs_along(held, tuple(_relaxed([0 if s == t else FAR for t in range(4)], False)))[-1]
                flat += [min(FAR, f + least) for f in front]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([p], pa.int32()), pa.array([flat], pa.list_(pa.int64())), pa.array([len(held)], pa.int64())], names)

    segments: dict[int | None, list] = {}  # one row for each part of a conversation: bounded by partitions and large conversations
    for r in sorted(kinds.mapInArrow(costs, "conv_id long, part int, costs array<long>, n long").collect(), key=lambda r: r["part"]):
        segments.setdefault(r["conv_id"], []).append(r)
    given: dict[tuple, tuple] = {}
    for c, found in segments.items():
        ahead = [START_COSTS]
        for r in found:
            ahead.append(tuple(min(FAR, min(ahead[-1][s] + r["costs"][4 * s + t] for s in range(4))) for t in range(4)))
        behind = [END_COSTS]
        for r in reversed(found):
            behind.append(tuple(min(FAR, min(r["costs"][4 * s + t] + behind[-1][t] for t in range(4))) for s in range(4)))
        behind.reverse()
        for k, r in enumerate(found):
            given[c, r["part"]] = (ahead[k], behind[k + 1], k == len(found) - 1)

    def walked(c: int | None, p: int, held: list, states: frozenset[int]) -> tuple[str, frozenset[int]]:
        ahead, behind, last = given[c, p]
        return walk(held, costs_along(held, ahead), costs_along(held, behind, True), states, last)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, p, held in parts(batches):
            out = []
            for s in range(4):
                letters, left = walked(c, p, held, frozenset([s]))
                out.append((min(left), letters.count("I")))
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([p], pa.int32()), *(pa.array([list(x)], pa.list_(pa.int64())) for x in zip(*out))], ["conv_id", "part", "left", "inserted"])

    entered: dict[tuple, tuple[int, int]] = {}
    states: dict[int | None, tuple[int, int]] = {}
    sizes = {(c, r["part"]): r["n"] for c, found in segments.items() for r in found}
    maps = kinds.mapInArrow(leaves, "conv_id long, part int, left array<long>, inserted array<long>").collect()
    for r in sorted(maps, key=lambda r: r["part"]):
        came, step = entered[r["conv_id"], r["part"]] = states.get(r["conv_id"], (START, 0))
        states[r["conv_id"]] = (r["left"][came], step + sizes[r["conv_id"], r["part"]] + r["inserted"][came])

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, held = None, None, []

        def repaired() -> Iterator[pa.RecordBatch]:
            came, step = entered[conv, part]
            letters, _ = walked(conv, part, [(r[0][:1], r[3]) for r in held], frozenset([came]))
            out = []
            for k, (edit, row, role) in enumerate(applied(letters, held, came)):
                out.append((conv, step + k, edit, None, None, None, role, "") if row is None else (conv, step + k, edit, row[3], row[2], row[0], role, row[1]))
                if len(out) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

        for b in batches:
            for c, p, turn, role, text, fault in zip(*(x.to_pylist() for x in b.columns)):
                if held and (c, p) != (conv, part):
                    yield from repaired()
                    held = []
                conv, part = c, p
                held.append((role, text, turn, fault))
        if held:
            yield from repaired()

    return placed.select("conv_id", "part", "turn", "role", "text", "fault").mapInArrow(edits, EDITS)


def repair(turns: DataFrame, large: int = LARGE, large_chars: int = LARGE_CHARS) -> DataFrame:
    """The edits of every conversation: (conv_id, step, edit, fault, turn, role_before, role, text).

    edit is K, R, D or I; steps count from 0. role and text are the repaired row's (a
    deleted one has no role); turn and role_before are null for inserted rows. Rows are
    taken by turn, nulls first, then role and text; a null role or text is one space. A
    role is known by its first letter; one that starts with none of s, u, a, or is empty,
    can't be kept. Rows without an id are one conversation. Repeated rows are duplicates;
    an empty table has no edits; columns besides the four are not read. Edits of a usual
    conversation are in order within one partition.
    """
    filled = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = filled.withColumn("fault", own_fault(F.col("text")))
    big = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("c")).filter((F.col("n") > large) | (F.col("c") > large_chars))
    named = checkpoint(big.select(F.col("conv_id").alias("big")))  # at most one for so many rows or characters of the whole table
    if named.isEmpty():
        return _whole(rows)
    on = rows["conv_id"].eqNullSafe(named["big"])
    return _whole(rows.join(named, on, "left_anti")).unionByName(_spread(rows.join(named, on, "left_semi")))


def digests(edits: DataFrame, dealt: bool = False) -> DataFrame:
    """One row for each conversation that has edits, from repair()'s rows.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).
    The text is hashed as it passes. With dealt, edits are in order as they stand.
    """
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    legal = ("su", "ua", "au")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, done = None, False, []
        state: dict = {}

        def fresh() -> dict:
            return {"turns": 0, "low": None, "high": None, "last": None, "fault": dict.fromkeys(FAULTS, 0), "illegal": 0, "before": None, "cost": 0, "audit": [], "sha": hashlib.sha256(), "rows": 0}

        def closed() -> tuple:
            gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
            return (conv, gaps, *(state["fault"][f] for f in FAULTS), state["illegal"], state["cost"], "".join(state["audit"]), state["sha"].hexdigest())

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)

        for b in batches:
            for i, edit, fault, turn, before, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if not begun or i != conv:
                    if begun:
                        done.append(closed())
                        if len(done) >= BATCH:
                            yield flush()
                            done = []
                    conv, begun, state = i, True, fresh()
                state["audit"].append(edit)
                state["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED_COST if fault == "truncated" and edit != "D" else 0)
                if before is not None:
                    if fault:
                        state["fault"][fault] += 1
                    if state["before"] is not None and state["before"] + before[:1] not in legal:
                        state["illegal"] += 1
                    state["before"] = before[:1]
                    if turn is not None and turn != state["last"]:
                        state["turns"] += 1
                        state["low"] = turn if state["low"] is None else state["low"]
                        state["high"] = state["last"] = turn
                if edit != "D":
                    state["sha"].update((("\n" if state["rows"] else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    state["rows"] += 1
        if begun:
            done.append(closed())
        if done:
            yield flush()

    rows = edits if dealt else edits.repartition("conv_id").sortWithinPartitions("conv_id", "step")
    columns = rows.select("conv_id", "edit", "fault", "turn", "role_before", "role", "text")
    return columns.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def repaired_conversations(turns: DataFrame, large: int = LARGE, large_chars: int = LARGE_CHARS) -> DataFrame:
    """digests() of every conversation of turns after damage; all zero and empty for those that lost all rows."""
    hurt = damaged(turns)
    made = digests(repair(hurt, large, large_chars)).withColumnRenamed("conv_id", "made_id")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = every.join(made, every["conv_id"].eqNullSafe(made["made_id"]), "left").drop("made_id")
    nothing = hashlib.sha256(b"").hexdigest()
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


_CHAIN = {START: ASKED, SYSTEM: ASKED, ASKED: ANSWERED, ANSWERED: ASKED}


def _inserted() -> str:
    """(state, state after k insertions, letters, cost) as SQL values."""
    out = []
    for s in range(4):
        t = s
        for k in range(4):
            out.append(f"({s}, {t}, '{'I' * k}', {INSERT * k})")
            t = _CHAIN[t]
    return ", ".join(out)


_GRAMMAR = ", ".join(f"({s}, '{r}', {t})" for s in range(4) for r, t in NEXT[s].items())
#: repaired_conversations() as DuckDB SQL: the best (cost, letters) of each state, row by row.
ORACLE_SQL = rf"""
WITH RECURSIVE turns AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {crc32_sql.crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations
), damaged AS (
    SELECT conv_id, turn, CASE h WHEN 4 THEN '{USER}' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS again FROM turns WHERE h <> 0
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS nth FROM damaged
), placed AS (
    SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS i_before,
           CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' END AS fault FROM ordered
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i_before IS NOT NULL AND i_before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM placed GROUP BY conv_id
), grammar AS (SELECT * FROM (VALUES {_GRAMMAR}) AS g(s, r, t)
), ins AS (SELECT * FROM (VALUES {_inserted()}) AS g(s, t, letters, w)
), rows AS (
    SELECT conv_id, k, n, s, t, letter, w FROM placed JOIN (
        SELECT s, t, r AS needs, 'K' AS letter, {KEEP} AS w FROM grammar UNION ALL SELECT s, t, NULL, 'R', {REROLE} FROM grammar WHERE r <> 's'
    ) ON needs IS NULL OR needs = i WHERE coalesce(fault, '') NOT IN ('blank', 'duplicate', 'truncated')
    UNION ALL SELECT conv_id, k, n, s, t, letter, w + {TRUNCATED_COST} FROM placed JOIN (
        SELECT s, t, r AS needs, 'K' AS letter, {KEEP} AS w FROM grammar UNION ALL SELECT s, t, NULL, 'R', {REROLE} FROM grammar WHERE r <> 's'
    ) ON needs IS NULL OR needs = i WHERE fault = 'truncated'
    UNION ALL SELECT conv_id, k, n, s, s, 'D', {DELETE} FROM placed CROSS JOIN (SELECT unnest(range(4)) AS s)
), paths AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS k, 0::BIGINT AS s, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM placed
    UNION ALL
    SELECT p.conv_id, p.k + 1, r.t::BIGINT, min({{'cost': p.best.cost + i.w + r.w, 'audit': p.best.audit || i.letters || r.letter}})
    FROM paths p JOIN ins i ON i.s = p.s JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.k = p.k + 1 AND r.s = i.t GROUP BY p.conv_id, p.k + 1, r.t
), audits AS (
    SELECT p.conv_id, min({{'cost': p.best.cost + i.w, 'audit': p.best.audit || i.letters}}) AS best
    FROM paths p JOIN (SELECT DISTINCT conv_id, n FROM placed) z ON z.conv_id IS NOT DISTINCT FROM p.conv_id AND z.n = p.k JOIN ins i ON i.s = p.s AND i.t IN ({ENDS[0]}, {ENDS[1]}) GROUP BY p.conv_id
), letters AS (
    SELECT conv_id, unnest(string_split(best.audit, '')) AS letter, generate_subscripts(string_split(best.audit, ''), 1) AS pos FROM audits
), taken AS (
    SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS k, count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id ORDER BY pos) AS o FROM letters
), written AS (
    SELECT l.conv_id, l.pos, l.letter, l.o, p.role, CASE l.letter WHEN 'I' THEN '' ELSE p.text END AS text,
           max(CASE WHEN l.letter = 'K' AND l.o = 1 AND p.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS shift
    FROM taken l LEFT JOIN placed p ON p.conv_id IS NOT DISTINCT FROM l.conv_id AND p.k = l.k WHERE l.letter <> 'D'
), repaired AS (
    SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - shift) % 2 = 1 THEN '{USER}' ELSE '{ASSISTANT}' END || ':' || text, chr(10) ORDER BY pos)) AS sha FROM written GROUP BY conv_id
)
SELECT d.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
       coalesce(a.best.cost, 0)::BIGINT AS cost, coalesce(a.best.audit, '') AS audit, coalesce(r.sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM d.conv_id
"""
