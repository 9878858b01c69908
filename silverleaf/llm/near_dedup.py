"""SimHash near-duplicates with a Gray-order hierarchical index.

Every document gets a 64-bit majority fingerprint of its word shingles. Fingerprints
that differ in few bits are linked, and links are closed into components.

The index finds all links. Within a group, fingerprints are sorted by Gray rank (which
puts similar ones side by side) and cut into nodes of a few, and these into nodes above,
up to one node for the group. Every node keeps the bits that all rows below it share;
bits that a parent shares are taken out of its children. A query walks down adding up its
differences with each node's own pattern, and drops a whole subtree as soon as the sum is
over the limit, if all its rows come before the query (each pair is met once), or if all
are known to be in the query's own component. All groups of a task are levels of one
forest, walked together.

Groups spread the index over machines: a Gray index alone can't be, as a query's ball of
four bits meets most nodes of the upper levels, so every fingerprint would go to almost
every partition. With at most ``max_bits`` differing bits, of ``max_bits + r`` blocks of
bits r at least are equal, so each fingerprint goes to one group for every choice of r
blocks, and a linked pair meets in one of them. r is the least number that keeps groups
of evenly spread fingerprints small: 1 up to eight million distinct ones. Groups that are
large all the same are dealt out again by parts of their other bits.

Only a spanning forest of each group leaves a task, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import checkpoint, ranked
from ..operators.graph import components
from . import xxh64_sql

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
#: Children of a node of the index; rows that the queries walked at once may meet.
FANOUT, MEETINGS = 4, 1 << 20
#: Rows that a group of evenly spread fingerprints has at most, by the choice of r.
EVEN = 2_048
#: Rows of a group that get one index; rows of a group that go to one task, and groups
#: above that at most (their keys are broadcast).
INDEXED, GROUP, LARGE_GROUPS = 8_192, 8_192, 100_000
#: Rows of whole groups that are indexed together, if a task has as many.
TOGETHER = 1 << 18
#: Shingles hashed before their bits are counted; bounds memory on very long texts.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The majority fingerprint of one text as an unsigned integer; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at ASCII space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        raw = b"".join([digest(joined[a:z], SEED) for a, z in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])])
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp bigint) of every row; null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of n blocks that tile 64 bits."""
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def shared_blocks(distinct: int, max_bits: int) -> int:
    """How many whole blocks a group shares, for groups of EVEN rows at most where bits are even; 4 at most."""
    r = 1
    while r < 4 and distinct > EVEN << (64 // (max_bits + r) * r):
        r += 1
    return r


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each pattern in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """A tree over each group's rows; a node's pattern is over bits that no node above it covers."""

    def __init__(self, group: np.ndarray, fps: np.ndarray):
        """Rows of groups (equal numbers, side by side) and their fingerprints."""
        n = len(fps)
        self.order = np.lexsort((gray_rank(fps), group))
        self.rows = fps[self.order]
        new = np.r_[True, group[1:] != group[:-1]][:n]
        number = np.cumsum(new) - 1  # of each row's group
        size = np.bincount(number, minlength=0)
        self.size = size[number]
        top, root = np.zeros(len(size), np.int64), np.flatnonzero(new)  # level and place of the node that is a whole group
        #: From the rows up: value, own mask, end of its rows, first child, number of children.
        self.levels = [[self.rows, np.full(n, ~np.uint64(0)), np.arange(n) + 1, None, None]]
        low = high = self.rows
        count = size
        while (count > 1).any():
            below = self.levels[-1]
            at = np.flatnonzero(count[number] > 1)
            number = number[at]
            start = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            place = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
            cut = np.flatnonzero(place % FANOUT == 0)
            fan = np.diff(np.r_[cut, len(at)])
            low, high = np.bitwise_and.reduceat(low[at], cut), np.bitwise_or.reduceat(high[at], cut)
            shared = ~(low ^ high)
            below[1][at] &= ~np.repeat(shared, fan)
            self.levels.append([low, shared, below[2][at[cut + fan - 1]], at[cut], fan])
            number = number[cut]
            count = np.bincount(number, minlength=len(size))
            top[count > 0] = len(self.levels) - 1
            alone = np.flatnonzero(count[number] == 1)
            root[number[alone]] = alone
        group = np.repeat(np.arange(len(size)), size)
        self.top, self.root = top[group], root[group]  # of each row's group

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """For every level: the label that all rows below a node share, -1 where they differ."""
        low = high = labels[self.order]
        out = [low]
        for _, _, _, first, fan in self.levels[1:]:
            at = np.repeat(first - np.r_[0, np.cumsum(fan)[:-1]], fan) + np.arange(int(fan.sum()))
            cut = np.r_[0, np.cumsum(fan)[:-1]]
            low, high = np.minimum.reduceat(low[at], cut), np.maximum.reduceat(high[at], cut)
            out.append(np.where(low == high, low, -1))
        return out

    def matches(self, asked: np.ndarray, limit: int, own: np.ndarray | None = None, known: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, later row of its group), in Gray order, of pairs within the limit with an asked row first.

        With own (all rows' labels, in Gray order) and known (of uniform()), pairs of one label are left out.
        """
        q, node, acc = (np.zeros(0, np.int64) for _ in range(3))
        for k in range(len(self.levels) - 1, 0, -1):
            fresh = asked[self.top[asked] == k]
            q, node, acc = np.r_[q, fresh], np.r_[node, self.root[fresh]], np.r_[acc, np.zeros(len(fresh), np.int64)]
            _, _, _, first, fan = self.levels[k]
            fan = fan[node]
            child = np.repeat(first[node] - (np.cumsum(fan) - fan), fan) + np.arange(int(fan.sum()))
            q, acc = np.repeat(q, fan), np.repeat(acc, fan)
            value, mask, end, _, _ = self.levels[k - 1]
            live = end[child] > q + 1
            if known is not None:
                live &= known[k - 1][child] != own[q]
            q, child, acc = q[live], child[live], acc[live]
            acc = acc + np.bitwise_count((self.rows[q] ^ value[child]) & mask[child])
            live = acc <= limit
            q, node, acc = q[live], child[live], acc[live]
        return q, node


def _merge(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining rows a[i] and b[i]; a label is the smallest row of its set."""
    a, b = lab[a], lab[b]
    apart = a != b
    if not apart.any():
        return lab
    pairs = np.unique(np.stack([np.minimum(a, b)[apart], np.maximum(a, b)[apart]], 1), axis=0)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for x, y in pairs.tolist():
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    to = np.arange(len(lab))
    for x in list(root):
        to[x] = find(x)
    return to[lab]


def _within(lab: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The labels of some rows, as places among them."""
    _, first, inverse = np.unique(lab[rows], return_index=True, return_inverse=True)
    return first[inverse]


def _indexed(group: np.ndarray, fps: np.ndarray, limit: int, lab: np.ndarray) -> np.ndarray:
    """Labels of the rows of groups, all through one index; a label is the smallest row of its set."""
    index = GrayIndex(group, fps)
    asked = np.flatnonzero(index.top > 0)
    edges = np.searchsorted(np.cumsum(index.size[asked]), np.arange(0, int(index.size[asked].sum()) + MEETINGS, MEETINGS))
    for k, (a, z) in enumerate(zip(edges, edges[1:])):
        if k & (k - 1) == 0:  # 0, 1, 2, 4, 8, ...: labels change most at first
            known, own = index.uniform(lab), lab[index.order]
        one, two = index.matches(asked[a:z], limit, own, known)
        lab = _merge(lab, index.order[one], index.order[two])
    return lab


def _split_labels(fps: np.ndarray, limit: int, lab: np.ndarray) -> np.ndarray:
    """Labels of one group that is too large for one index: neighbours by look-up, then parts of it.

    It is dealt out as the whole was: of limit + 1 parts of the bits that differ in it, a
    linked pair shares at least one.
    """
    n, order = len(fps), np.argsort(fps)
    ordered = fps[order]
    for bit in range(64):
        near = ordered ^ (np.uint64(1) << np.uint64(bit))
        place = np.minimum(np.searchsorted(ordered, near), n - 1)
        hit = np.flatnonzero(ordered[place] == near)
        lab = _merge(lab, order[hit], order[place[hit]])
    differ = int(np.bitwise_or.reduce(fps) ^ np.bitwise_and.reduce(fps))
    bits = np.array([b for b in range(64) if differ >> b & 1], np.uint64)
    if len(bits) <= limit + 1:
        return _indexed(np.zeros(n, np.int64), fps, limit, lab)
    for part in np.array_split(bits, limit + 1):
        if not lab.any():
            break
        key = np.zeros(n, np.int64)
        for k, b in enumerate(part):
            key |= ((fps >> b) & np.uint64(1)).astype(np.int64) << k
        by_key = np.argsort(key, kind="stable")
        own = _labels(key[by_key], fps[by_key], limit, _within(lab, by_key))
        lab = _merge(lab, by_key, by_key[own])
    return lab


def _labels(key: np.ndarray, fps: np.ndarray, limit: int, lab: np.ndarray | None = None) -> np.ndarray:
    """Labels of the rows of whole groups, joined with what lab says; key is sorted, fps are distinct in a group."""
    n = len(key)
    lab = np.arange(n) if lab is None else lab
    if not n:
        return lab
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[cuts, n])
    each = np.repeat(sizes, sizes)
    open_ = np.repeat(np.minimum.reduceat(lab, cuts) != np.maximum.reduceat(lab, cuts), sizes)
    usual = np.flatnonzero(open_ & (each <= INDEXED))
    lab = _merge(lab, usual, usual[_indexed(key[usual], fps[usual], limit, _within(lab, usual))])
    for at, count in zip(cuts[sizes > INDEXED].tolist(), sizes[sizes > INDEXED].tolist()):
        rows = np.arange(at, at + count)
        lab = _merge(lab, rows, rows[_split_labels(fps[rows], limit, _within(lab, rows))])
    return lab


def links(distinct: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """(a, b): a spanning set of the links among distinct (fp, node), by node.

    A group of over `group` rows is dealt out again: max_bits + 1 parts of the bits that
    its blocks don't cover, one of which a linked pair shares. A task that still gets
    a large part splits it further for itself.
    """
    total = distinct.count()
    r = shared_blocks(total, max_bits)
    tiles = blocks(max_bits + r)
    keys, again = [], []
    for i, chosen in enumerate(combinations(tiles, r)):
        key = F.lit(i << 56).cast("long")
        at = 0
        for shift, width in chosen:
            bits = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
            key, at = key.bitwiseOR(F.shiftleft(bits, at)), at + width
        keys.append(key)
        rest = [s + k for s, w in tiles if (s, w) not in chosen for k in range(w)]
        masks = [sum(1 << int(b) for b in p) for p in np.array_split(rest, max_bits + 1)]
        again.append(F.array(*(F.xxhash64("key", F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long"))) for k, m in enumerate(masks))))
    rows = distinct.select("fp", "node", F.explode(F.array(*keys)).alias("key"))
    group = max(group, total * len(keys) // LARGE_GROUPS)
    large = checkpoint(rows.groupBy("key").count().filter(F.col("count") > group).select("key"))
    if not large.isEmpty():
        kind = F.shiftrightunsigned("key", 56)
        split = F.coalesce(*(F.when(kind == i, a) for i, a in enumerate(again)))
        hot = rows.join(F.broadcast(large), "key", "left_semi").select("fp", "node", F.explode(split).alias("key"))
        rows = rows.join(F.broadcast(large), "key", "left_anti").select("fp", "node", "key").unionByName(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def done() -> pa.RecordBatch:
            k, x, node = (np.concatenate(c) for c in zip(*held))
            lab = _labels(k, x, max_bits)
            linked = np.flatnonzero(lab != np.arange(len(k)))
            return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[lab[linked]])], ["a", "b"])

        for batch in batches:
            k, fp, node = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(k):
                continue
            x, cut = fp.view(np.uint64), int(np.searchsorted(k, k[-1]))  # the last group may go on
            if cut and size + cut >= TOGETHER:
                held.append([k[:cut], x[:cut], node[:cut]])
                yield done()
                held, size = [], 0
                k, x, node = k[cut:], x[cut:], node[cut:]
            held.append([k.copy(), x.copy(), node.copy()])
            size += len(k)
        if held:
            yield done()

    return rows.select("key", "fp", "node").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def named(fps: DataFrame) -> tuple[DataFrame, bool]:
    """(fp, least, copies, node) of distinct fingerprints, and whether nodes are ids.

    least is the smallest id with that fingerprint, and a node where these are there and
    all differ. Where ids are null or stand on several texts, nodes are places in the
    order of least, nulls last, so that the smallest node still is at the smallest id.
    """
    distinct = checkpoint(fps.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    rows, names = distinct.agg(F.count("*"), F.count_distinct("least")).first()
    if rows == names:
        return distinct.withColumn("node", F.col("least")), True
    order = distinct.withColumns({"none": F.col("least").isNull(), "id": F.coalesce("least", F.lit(0))})
    return checkpoint(ranked(order, ["none", "id", "fp"], "node").drop("none", "id")), False


def classes(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id, copies) of the distinct fingerprints of (id, fp); root names a component even without ids."""
    distinct, are_ids = named(fps)
    roots = components(links(distinct.select("fp", "node"), max_bits), contract=False).withColumnRenamed("node", "linked")
    found = distinct.join(roots, distinct.node == roots.linked, "left").select("fp", F.coalesce("root", "node").alias("root"), "copies")
    if are_ids:
        return found.withColumn("component_id", F.col("root"))
    return found.join(distinct.select(F.col("node").alias("root"), F.col("least").alias("component_id")), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each document: (id, fp, component_id, copies).

    component_id is the smallest id reachable over links, copies the number of rows
    with the same fingerprint. Null and empty texts have fingerprint 0 and are linked
    like any other; a null id never names a component unless all its members have none;
    repeated rows stay repeated; an empty table gives an empty result. Other columns
    of docs are not read, so their names can't clash.
    """
    fps = checkpoint(fingerprints(docs, id_col, text_col, width))
    return fps.join(classes(fps, max_bits), "fp").select("id", "fp", "component_id", "copies")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stay: one of each component.

    It is the row with the smallest doc_id; where several rows have that doc_id, or none of
    the component has one, the smallest by its columns as JSON. Rows with one doc_id and
    texts that are not alike are components of their own. Null and empty texts are alike;
    an empty table stays empty. docs must have doc_id and text; any other names may be there.
    """
    fps = checkpoint(fingerprints(docs))
    found = checkpoint(classes(fps))
    winners = checkpoint(fps.join(found, "fp").filter("id = component_id").groupBy("id").count())
    once, several = winners.filter("count = 1"), winners.filter("count > 1")
    key = docs["doc_id"].cast("long")
    kept = docs.join(once, key == once["id"], "left_semi")
    if several.isEmpty() and found.filter("component_id IS NULL").isEmpty():
        return kept
    unclear = docs.filter("doc_id IS NULL").unionByName(docs.join(several, key == several["id"], "left_semi"))
    rows = unclear.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["row", "fp"])

    schema = T.StructType([rows.schema["row"], T.StructField("fp", T.LongType())])
    least = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id").cast("long"), F.to_json("row"))
    of_fp = rows.mapInArrow(run, schema).groupBy("fp").agg(F.min_by("row", least).alias("row"))
    mine = of_fp.join(found, "fp").filter(F.col("component_id").eqNullSafe(F.col("row.doc_id").cast("long")))
    return kept.unionByName(mine.groupBy("root").agg(F.min_by("row", least).alias("row")).select("row.*"))


_SHINGLES = f"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT r, unnest(list_transform(range(1, greatest(len(w) - {SHINGLE_WORDS - 1}, 1) + 1), lambda i: array_to_string(w[i : i + {SHINGLE_WORDS - 1}], ' '))) AS s FROM docs WHERE len(w) > 0),
occurring AS (SELECT DISTINCT s FROM shingles),
"""
_LINKED = f"""
counted AS (SELECT r, count(*) AS n, {", ".join(f"count(*) FILTER (b & {1 << k}::UBIGINT <> 0) AS b{k}" for k in range(64))} FROM (SELECT r, h::UBIGINT AS b FROM shingles JOIN hashed USING (s)) GROUP BY r),
made AS (SELECT r, {" + ".join(f"CASE WHEN 2 * b{k} > n THEN {1 << k}::UBIGINT ELSE 0::UBIGINT END" for k in range(64))} AS fp FROM counted),
fps AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM docs LEFT JOIN made USING (r)),
classes AS (SELECT fp, min(doc_id) AS least, count(*) AS copies FROM fps GROUP BY fp),
linked AS (SELECT a.fp, b.fp AS other FROM classes a JOIN classes b ON bit_count(xor(a.fp, b.fp)) <= {MAX_BITS}),
reached AS (SELECT fp, fp AS other FROM classes UNION SELECT r.fp, l.other FROM reached r JOIN linked l ON l.fp = r.other),
named AS (SELECT r.fp, min(c.least) AS component_id FROM reached r JOIN classes c ON c.fp = r.other GROUP BY r.fp)
SELECT f.doc_id, lpad(lower(to_hex(f.fp)), 16, '0') AS fingerprint, n.component_id, c.copies FROM fps f JOIN named n USING (fp) JOIN classes c USING (fp)
"""
#: The whole operator as DuckDB SQL, which compares all pairs of distinct fingerprints.
ORACLE_SQL = _SHINGLES + xxh64_sql.strings("hashed", "occurring") + "," + _LINKED
