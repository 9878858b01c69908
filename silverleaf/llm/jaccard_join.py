"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Documents are sets of hashed word shingles; two link if their Jaccard similarity is at
least 0.9. Equal sets are one class from the start. What sizes say is used at every step:

* Linked sets of n and m shingles differ in (n + m) / 19 at most. Sizes are cut into
  classes so that linked ones are in the same class or the next; for each pair of
  neighbouring classes the shingles are dealt by hash into one part more than its sets may
  differ in (two more for short sets, of which two must be equal). Linked sets have equal
  parts, so only sets with a part in common go on. Each is tied to the smallest class
  with that part, not to every other, and these ties are closed into groups; links never
  cross groups.
* Each group's incidence matrix is multiplied with its transpose, in blocks of rows and
  blocks of n-grams. After each block of n-grams the overlaps so far and the n-grams left
  bound every pair's overlap, and pairs, rows and blocks below what their sizes need are
  discarded.

A group of more than a block of documents is spread. Its blocks are first multiplied with
themselves and with a few hubs (the documents that share most parts); copies of one text
so mostly become one component at once. Then only the documents outside the group's
largest component are multiplied with all blocks, and pairs known to be connected are
skipped. Every pair of a group is either connected or multiplied, so no link is lost.
Only spanning forests leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpoint
from ..operators.graph import _stars, components

WIDTH, PERCENT = 3, 90
#: Documents and n-grams of a block; documents outside the largest component in a block; hubs of a large group.
BLOCK, BLOCK_GRAMS, LEFT, HUBS = 1_024, 1 << 22, 512, 8
#: Rows that are multiplied at once, n-grams of a block of columns.
ROWS, COLUMNS = 256, 2_048
#: Ids that may be broadcast to pick out texts; beyond that they are joined by shuffle.
BROADCAST = 1_000_000
#: Parts that the copies of one text are dealt into where they meet their class.
SALTS = 32
SEED = 7
#: Odd multipliers that mix bits.
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of one text's shingles; with fewer words, of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z, splits at ASCII space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return np.frombuffer(digest(joined, SEED), ">u8").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    raw = b"".join([digest(joined[a:z], SEED) for a, z in zip(starts, ends[width - 1 :].tolist())])
    return np.unique(np.frombuffer(raw, ">u8").astype(np.uint64))


def least_overlap(total: np.ndarray | int) -> np.ndarray | int:
    """The least overlap of linked sets whose sizes add up to total."""
    return -(-PERCENT * total // (100 + PERCENT))


def _classes(limit: int = 1 << 40) -> np.ndarray:
    """The least size of each class; linked sizes are in one class or in neighbours."""
    out = [1]
    while out[-1] < limit:
        out.append(out[-1] * 100 // PERCENT + 1)
    return np.array(out)


CLASSES = _classes()


def signatures(g: np.ndarray) -> np.ndarray:
    """One number for each part (or pair of parts) of a set; linked different sets share at least one."""
    own = int(np.searchsorted(CLASSES, len(g), side="right")) - 1
    mixed = g * _M1
    mixed ^= mixed >> np.uint64(29)
    mixed *= _M2
    out = []
    for band in (own, own + 1):
        most = 2 * (int(CLASSES[band + 1]) - 1)
        differ = most * (100 - PERCENT) // (100 + PERCENT)
        if not differ:
            continue  # linked sets of these sizes are equal
        pairs = differ <= 2
        n = differ + 1 + pairs
        part = (g % np.uint64(n)).astype(np.int64)
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, part, mixed)
        names = (np.arange(n, dtype=np.uint64) + np.uint64(band << 32)) * _M2
        keys = (sums ^ names) * _M1
        keys ^= keys >> np.uint64(32)
        if pairs:
            i, j = np.triu_indices(n, 1)
            keys = (keys[i] * _M2 + keys[j]) * _M1
            keys ^= keys >> np.uint64(32)
        out.append(keys)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def incidence(docs: DataFrame, id_col: str, text_col: str, width: int, what: str) -> DataFrame:
    """Of every row: (id, key, n, sigs), or (key, n, grams) of those with words. key names the set; null where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [grams(t.as_py(), width) for t in b.column(1)]
            key = pa.array([xxhash.xxh64_intdigest(g.tobytes(), SEED) if len(g) else 0 for g in made], pa.uint64()).to_numpy().view(np.int64)
            n = np.fromiter(map(len, made), np.int64, len(made))
            keys = pa.array(key, mask=n == 0)
            lists = [signatures(g) if len(g) else g for g in made] if what == "sigs" else made
            ends = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
            flat = np.concatenate(lists).view(np.int64) if lists else np.zeros(0, np.int64)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            first = [b.column(0)] if what == "sigs" else []
            yield pa.RecordBatch.from_arrays([*first, keys, pa.array(n), values], [*(["id"] if first else []), "key", "n", what])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    head = "id long, " if what == "sigs" else ""
    return rows.mapInArrow(run, f"{head}key long, n long, {what} array<long>")


class Matrix:
    """The incidence of some sets, by rows."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.fromiter(map(len, sets), np.int64, len(sets))
        self.row = np.repeat(np.arange(len(sets)), self.n)
        self.gram = np.concatenate(sets) if sets else np.zeros(0, np.int64)

    def columns(self, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, number of columns of each row) of what is among some sorted n-grams."""
        at = np.searchsorted(common, self.gram)
        at[at == len(common)] = 0
        hit = common[at] == self.gram if len(common) else np.zeros(len(self.gram), bool)
        return self.row[hit], at[hit], np.bincount(self.row[hit], minlength=len(self.n))


def product(left: Matrix, right: Matrix, left_label: np.ndarray, right_label: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of left, row of right) of linked pairs; with `same`, left is right and each pair is met once.

    Pairs of equal labels are left out, as are those whose sizes rule a link out.
    """
    there = np.unique(left.gram)
    common = there if same else np.intersect1d(there, np.unique(right.gram), assume_unique=True)
    lr, lc, left_rest = left.columns(common)
    rr, rc, right_rest = right.columns(common)
    frequent = np.bincount(rc, minlength=len(common))
    if same:  # what only one document has overlaps with none
        lr, lc = lr[frequent[lc] > 1], lc[frequent[lc] > 1]
        rr, rc = lr, lc
        left_rest = right_rest = np.bincount(lr, minlength=len(left.n))
    order = np.argsort(-frequent, kind="stable")  # what most have first: it settles most
    place = np.empty(len(common), np.int64)
    place[order] = np.arange(len(common))
    lc, rc = place[lc], place[rc]
    by_column = np.argsort(rc, kind="stable")
    rr, rc = rr[by_column], rc[by_column]
    for top in range(0, len(left.n), ROWS):
        rows = np.arange(top, min(top + ROWS, len(left.n)))
        mine = np.flatnonzero((lr >= top) & (lr < top + ROWS))
        mine = mine[np.argsort(lc[mine], kind="stable")]
        row, column = lr[mine] - top, lc[mine]
        total = left.n[rows][:, None] + right.n[None]
        need = least_overlap(total)
        live = (np.minimum(left_rest[rows][:, None], right_rest[None]) >= need) & (left_label[rows][:, None] != right_label[None])
        if same:
            live &= rows[:, None] < np.arange(len(right.n))[None]
        overlap = np.zeros(live.shape, np.float32)
        a_rest, b_rest = left_rest[rows].copy(), right_rest.copy()
        last = int(column[-1]) if len(column) else -1
        for begin in range(0, last + 1, COLUMNS):
            a_live, b_live = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
            if not len(a_live):
                break
            x, z = np.searchsorted(column, [begin, begin + COLUMNS])
            p, q = np.searchsorted(rc, [begin, begin + COLUMNS])
            a = np.zeros((len(rows), COLUMNS), np.float32)
            a[row[x:z], column[x:z] - begin] = 1
            b = np.zeros((len(right.n), COLUMNS), np.float32)
            b[rr[p:q], rc[p:q] - begin] = 1
            overlap[np.ix_(a_live, b_live)] += a[a_live] @ b[b_live].T
            a_rest -= np.bincount(row[x:z], minlength=len(rows))
            b_rest -= np.bincount(rr[p:q], minlength=len(right.n))
            live &= overlap + np.minimum(a_rest[:, None], b_rest[None]) >= need
        i, j = np.nonzero(live & (overlap >= need))
        yield rows[i], j


def multiplied(rows: DataFrame) -> DataFrame:
    """(a, b): a spanning set of the links within groups, by key.

    rows: g (group), side, key, label, grams. In a group with rows of side 0 these are
    multiplied with those of side 1, else all with all. A group fits a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None

        def done() -> Iterator[pa.RecordBatch]:
            sides = [[h for h in held if h[0] == s] for s in (0, 1)]
            same = not sides[0]
            parts = []
            for own in [sides[1]] if same else sides:
                parts.append((np.array([h[1] for h in own]), np.array([h[2] for h in own]), Matrix([h[3] for h in own])))
            (a, al, am), (b, bl, bm) = parts[0], parts[-1]
            if same:  # different classes, whatever their labels
                al = np.full(len(a), -1)
            for i, j in product(am, bm, al, bl if not same else np.zeros(len(b)), same):
                if len(i):
                    made = _stars(a[i], b[j])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["a", "b"])

        for batch in batches:
            for g, side, key, label, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                if g != group:
                    if len(held) > 1:
                        yield from done()
                    held, group = [], g
                held.append((side, key, label, values.values.to_numpy().copy()))
        if len(held) > 1:
            yield from done()

    dealt = rows.select("g", "side", "key", "label", "grams").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, "a long, b long")


def _ceil(x: Column, by: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(x / by)).cast("long")


def _candidates(sets: DataFrame) -> DataFrame:
    """(key, n, comp, blocks, degree) of the sets that share a part with another; see the module's docstring."""
    rows = sets.filter("key IS NOT NULL").select("key", "n", F.explode("sigs").alias("sig"))
    shared = rows.groupBy("sig").agg(F.min("key").alias("hub"), F.max("key").alias("last")).filter("hub != last").select("sig", "hub")
    ties = checkpoint(rows.join(shared, "sig").groupBy("key", "hub").agg(F.count("*").alias("w"), F.min("n").alias("n")))
    found = components(ties.filter("key != hub").select(F.col("key").alias("a"), F.col("hub").alias("b"))).withColumnsRenamed({"node": "key", "root": "comp"})
    known = checkpoint(ties.groupBy("key").agg(F.sum("w").alias("degree"), F.min("n").alias("n")).join(found, "key"))
    sizes = known.groupBy("comp").agg(F.greatest(_ceil(F.count("*"), BLOCK), _ceil(F.sum("n"), BLOCK_GRAMS)).alias("blocks"))
    return known.join(sizes, "comp")


def _links(docs: DataFrame, sets: DataFrame, classes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(a, b): a spanning set of the links between different sets, by key; classes: key and its least id."""
    wanted = checkpoint(_candidates(sets))
    ids = checkpoint(classes.join(wanted.select("key"), "key").select(F.col("least").alias("wanted_id")).distinct())
    small = ids.count() <= BROADCAST
    picked = docs.join(F.broadcast(ids) if small else ids, docs[id_col].cast("long").eqNullSafe(ids["wanted_id"]), "left_semi")
    held = incidence(picked, id_col, text_col, width, "grams").drop("n").dropDuplicates(["key"])
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    held = checkpoint(held.join(wanted, "key").withColumn("block", block))
    alike = F.lit(0).cast("long").alias("label")
    own = held.select(F.xxhash64("comp", "block").alias("g"), F.lit(1).alias("side"), "key", alike, "grams")
    large = held.filter("blocks > 1")
    if large.isEmpty():
        return multiplied(own)
    slot = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(HUBS))
    hubs = large.groupBy("comp", slot.alias("slot")).agg(F.max_by(F.struct("key", "block", "blocks", "grams"), F.struct("degree", "key")).alias("h"))
    sent = hubs.select("comp", "h.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h.blocks") - 1)).alias("to")).filter("to != block")
    first = checkpoint(multiplied(own.unionByName(sent.select(F.xxhash64("comp", F.col("to")).alias("g"), F.lit(1).alias("side"), "key", alike, "grams"))))
    roots = components(first, contract=False).withColumnsRenamed({"node": "key", "root": "label"})
    labelled = checkpoint(large.drop("grams", "degree").join(roots, "key", "left").withColumn("label", F.coalesce("label", "key")))
    counts = labelled.groupBy("comp", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("comp").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    rest = labelled.join(main, "comp").filter("label != main").drop("main")
    parts = checkpoint(rest.groupBy("comp").agg(F.greatest(_ceil(F.count("*"), LEFT), _ceil(F.sum("n"), BLOCK_GRAMS)).alias("parts")))
    if parts.isEmpty():
        return first
    of = lambda which: large.select("key", "grams").join(which, "key")
    g = F.xxhash64("comp", "part", "to", F.lit(2)).alias("g")
    apart = of(rest.join(parts, "comp").withColumn("part", F.pmod(F.xxhash64("key", F.lit(2)), F.col("parts"))))
    asked = apart.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(g, F.lit(0).alias("side"), "key", "label", "grams")
    every = of(labelled.join(parts, "comp")).withColumns({"to": F.col("block"), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))})
    return first.unionByName(multiplied(asked.unionByName(every.select(g, F.lit(1).alias("side"), "key", "label", "grams"))))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row for each document: (id, n_shingles, component_id).

    component_id is the smallest id reachable over links. Texts without words, and null
    ones, have no shingles and are linked with nothing, so theirs is their own id. A null
    id never names a component unless all its members have none; rows that repeat stay
    repeated; an empty table gives an empty result; other columns are not read. Shingles
    and sets are told apart by hashes of 64 bits.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    sets = checkpoint(incidence(docs, id_col, text_col, width, "sigs").withColumn("salt", salt))
    known = sets.filter("key IS NOT NULL").select("id", "key", "salt")
    classes = checkpoint(known.groupBy("key").agg(F.min("id").alias("least"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt"))).alias("mask")))
    roots = checkpoint(components(_links(docs, sets, classes, id_col, text_col, width), contract=False)).withColumnRenamed("node", "key")
    mine = classes.join(roots, "key")
    names = mine.groupBy("root").agg(F.min("least").alias("component_id"))
    grouped = mine.join(names, "root").select("key", F.col("component_id"))
    alone = classes.join(roots, "key", "left_anti").select("key", F.col("least").alias("component_id"))
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0)
    named = grouped.unionByName(alone).join(classes.select("key", "mask"), "key").select("key", "component_id", F.explode(salts).alias("salt"))
    rows = sets.select("id", "n", "key", "salt")
    found = rows.join(named, ["key", "salt"], "left")
    return found.select("id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


#: linked(documents) as DuckDB SQL, by counting shared shingles of all pairs of different sets.
ORACLE_SQL = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (SELECT DISTINCT r, unnest(list_transform(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1), lambda i: array_to_string(w[i : i + {WIDTH - 1}], ' '))) AS s FROM docs WHERE len(w) > 0
), sets AS (SELECT r, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM shingles GROUP BY r
), reps AS (SELECT k, min(r) AS r, min(n) AS n FROM sets GROUP BY k
), held AS (SELECT p.k, p.n, s.s FROM reps p JOIN shingles s USING (r)
), pairs AS (SELECT a.k, b.k AS other, a.n AS n, b.n AS m, count(*) AS c FROM held a JOIN held b ON a.s = b.s AND a.k < b.k AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) GROUP BY a.k, b.k, a.n, b.n
), links AS (SELECT k, other FROM pairs WHERE 100 * c >= {PERCENT} * (n + m - c)
), ways AS (SELECT k, other FROM links UNION SELECT other, k FROM links
), reached AS (SELECT k, k AS other FROM reps UNION SELECT r.k, b.other FROM reached r JOIN ways b ON b.k = r.other
), least AS (SELECT r.k, min(d.doc_id) AS component_id FROM reached r JOIN sets s ON s.k = r.other JOIN docs d ON d.r = s.r GROUP BY r.k)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, CASE WHEN s.k IS NULL THEN d.doc_id ELSE l.component_id END AS component_id FROM docs d LEFT JOIN sets s USING (r) LEFT JOIN least l USING (k)
"""
