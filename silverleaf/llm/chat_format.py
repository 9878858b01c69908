r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it, formatted, are
its context, and only its reply is under the loss mask. Turns after the last reply (or
all turns, where there is no reply) close the conversation in one more example without
loss, so nothing of a conversation is lost.

The template marks turns with control strings that begin with ``<`` or ``[``. Inside
roles and texts a backslash is doubled and one is put after each ``<`` and ``[``, so no
control string can stand there, and reading undoes exactly that.

Conversations are dealt out by id and sorted, and a task streams through them with one
conversation's prefix in memory at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What opens and closes a turn of each role; other roles are named in the marker.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<a> ", "</s>")}
TRAINED = "assistant"
_ESCAPED = re.compile(r"([<\[])\\|\\(\\)")
#: A turn: one of the fixed openings, or a named role, then text without bare < or [.
_INSIDE = r"(?:[^<\[]|[<\[]\\)*"
_TURN = re.compile(
    "|".join(f"{re.escape(a)}(?P<{role}>{_INSIDE}){re.escape(z)}" for role, (a, z) in MARKS.items()) + f"|<r>(?P<role>{_INSIDE})</r>(?P<other>{_INSIDE})<e>"
)
#: Rows and characters in an output batch.
BATCH_ROWS, BATCH_CHARS = 1_000, 4 << 20
SCHEMA = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("last", pa.bool_())])


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def mark(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where in it the text stands."""
    a, z = MARKS.get(role, (f"<r>{escape(role)}</r>", "<e>"))
    body = escape(text)
    return a + body + z, len(a), len(a) + len(body)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a formatted text; raises on anything else."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        yield (unescape(m["role"]), unescape(m["other"])) if kind == "other" else (kind, unescape(m[kind]))
        at = m.end()


def examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, last): one row for each reply.

    turns has conv_id, turn, role and text; other columns are not read, so their names
    can't clash. Turns are ordered by turn, then role and text where that ties; repeated
    rows are turns of their own; null roles and texts count as empty, null turns come
    first. Nothing says which rows without a conv_id belong together, so each is a
    conversation of its own, and any number of them is spread over all tasks. Offsets are
    in characters. An empty table gives none. Examples of a conversation stand side by
    side and in order, as read_back wants them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        chars = 0
        conv, prefix, k, open_rows, begun = None, "", 0, False, False

        def flush() -> pa.RecordBatch:
            nonlocal out, chars
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SCHEMA)], schema=SCHEMA)
            out, chars = [], 0
            return b

        held: tuple | None = None  # the conversation's last example so far
        for b in batches:
            for i, role, text in zip(b.column(0), b.column(2), b.column(3)):
                i, role, text = i.as_py(), role.as_py(), text.as_py()
                if not begun or i is None or i != conv:
                    if begun:
                        if open_rows:
                            if held:
                                out.append((*held, False))
                            held = (conv, k, prefix, len(prefix), len(prefix))
                        out.append((*held, True))
                    conv, prefix, k, open_rows, begun, held = i, "", 0, False, True, None
                turn, a, z = mark(role, text)
                at, open_rows = len(prefix), True
                prefix += turn
                if role == TRAINED:
                    if held:
                        out.append((*held, False))
                    held = (conv, k, prefix, at + a, at + z)
                    k, open_rows, chars = k + 1, False, chars + len(prefix)
                if len(out) >= BATCH_ROWS or chars >= BATCH_CHARS and out:
                    yield flush()
        if begun:
            if open_rows:
                if held:
                    out.append((*held, False))
                held = (conv, k, prefix, len(prefix), len(prefix))
            out.append((*held, True))
        if out:
            yield flush()

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text", F.spark_partition_id())).otherwise(F.lit(0))
    dealt = rows.withColumn("alone", alone).repartition("conv_id", "alone").sortWithinPartitions("conv_id", "alone", "turn", "role", "text").drop("alone")
    return dealt.mapInArrow(run, "conv_id long, example long, text string, loss_start long, loss_end long, last boolean")


def read_back(made: DataFrame, dealt: bool = True) -> DataFrame:
    """One row for each conversation, from its examples.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars): turns are
    parsed from the last example, the loss text from every example's masked span. made
    is what examples() gave, as it stands; with dealt off it may have been written, moved
    or reordered since, and is dealt out and sorted first. Examples that are missing or
    out of order raise an error, never a wrong row. Conversations without an id are one
    row each; an empty table gives none; columns besides those of examples() are not read.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, chars, total = hashlib.sha256(), 0, 0
        due: tuple | None = None  # the conversation and example that must come next
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["conv_id"], r["example"]) != (due or (r["conv_id"], 0)):
                    raise ValueError(f"example {r['example']} of conversation {r['conv_id']} is out of order")
                reply = unescape(r["text"][r["loss_start"] : r["loss_end"]])
                loss.update(reply.encode("utf-8", "surrogatepass"))
                chars, total = chars + len(reply), total + len(r["text"])
                due = None if r["last"] else (r["conv_id"], r["example"] + 1)
                if r["last"]:
                    turns, n = hashlib.sha256(), 0
                    for role, text in read_turns(r["text"]):
                        turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                        n += 1
                    out.append((r["conv_id"], n, turns.hexdigest(), chars, loss.hexdigest(), total))
                    loss, chars, total = hashlib.sha256(), 0, 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in n else pa.int64()) for c, n in zip(zip(*out), names)], names)
        if due:
            raise ValueError(f"example {due[1]} of conversation {due[0]} is missing")

    made = made.select(*SCHEMA.names)
    made = made if dealt else made.repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return made.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _escaped_length(x: str) -> str:
    return rf"length({x}) + length(regexp_replace({x}, '[^\\<\[]', '', 'g'))"


#: What read_back(examples(conversations and conversation -7)) gives, without the template.
ORACLE_SQL = rf"""
WITH said AS (SELECT '</s>[INST] ok [/INST]' AS s), turns AS (
    SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, NULL, 0, 'user', s FROM said UNION ALL SELECT -7, NULL, 1, 'assistant', s FROM said
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id, alone) AS n,
           CASE role {" ".join(f"WHEN '{r}' THEN {len(a) + len(z)}" for r, (a, z) in MARKS.items())} ELSE {len("<r></r><e>")} + {_escaped_length("role")} END + {_escaped_length("text")} AS size
    FROM turns
), prefixed AS (
    SELECT *, sum(size) OVER (PARTITION BY conv_id, alone ORDER BY k) AS prefix FROM placed
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{TRAINED}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = '{TRAINED}'), '')) AS loss_sha256,
       sum(CASE WHEN role = '{TRAINED}' OR k = n THEN prefix ELSE 0 END)::BIGINT AS formatted_chars
FROM prefixed GROUP BY conv_id, alone
"""
