"""Spelling variant grouping: a trie self-join with active-node sets at distance one.

The vocabulary is dealt into tries by prefix or suffix, so that words at distance one meet
in exactly one of them. Words of c and c + 1 letters are one class; a pair of the class
has its edit where its common prefix ends: at place m or later, and then both start with
the same m letters, or before, and then both end with the same c - m letters. So a class
is cut in two at m = c // 2: a trie for each prefix, one (of reversed words) for each
suffix. A trie that is still too large is cut again at the middle of the places that are
left, into one for each longer prefix and one for each longer suffix, until it is small or
all but one letter are shared. Nothing is sampled or capped.

In a task all tries are levels of one forest. A node's active nodes are those at distance
one: its parent (its letter deleted), its siblings (replaced), its children (inserted),
and the children by its letter of its parent's active nodes. So the sets go down level by
level, by array look-ups over all nodes of a level at once. Where a word ends and one of
its node's active nodes ends a word, the two are a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpoint
from . import crc32_sql

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
MIN_LENGTH, MIN_COUNT, TIMES, DAMAGE = 7, 2, 10, 31
#: Letters of the words of one trie, from which it is cut in two; letters of the tries walked together.
CELLS, TOGETHER = 1 << 19, 1 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = DAMAGE) -> DataFrame:
    """(word, n) of words of at least MIN_LENGTH letters with at least MIN_COUNT occurrences in all texts.

    Runs of letters are lower-cased (A-Z only); where `damage` divides the crc32 of
    `<id>:<run>` (a null id is empty), the run loses the letter at that number modulo its
    length. Null texts have no words, repeated rows count again, and other columns are not
    read. Counts are combined in each task before they are shuffled.
    """
    text = F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.explode(F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{MIN_LENGTH},}}"), F.lit(0))).alias("w"))
    word: Column = F.col("w")
    if damage:
        h = F.crc32(F.concat("i", F.lit(":"), "w").cast("binary"))
        at = F.pmod(h, F.length("w")).cast("int")
        cut = F.concat(F.substr("w", F.lit(1), at), F.substr("w", at + 2))
        word = F.when(F.pmod(h, F.lit(damage)) == 0, cut).otherwise(word)
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter((F.col("n") >= MIN_COUNT) & (F.length("word") >= MIN_LENGTH))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows of (word, n, c, p, s) with the key of their trie: first p and last s letters."""
    return rows.withColumn("key", F.xxhash64("c", "p", "s", F.expr("left(word, p)"), F.expr("right(word, s)")))


def _cut(rows: DataFrame) -> DataFrame:
    """Each row twice: where the pair's edit is at the middle place or after it, and where it is before."""
    m = F.col("p") + F.floor((F.col("c") - F.col("s") - F.col("p")) / 2).cast("int")
    both = F.array(F.struct(m.alias("p"), F.col("s").alias("s")), F.struct(F.col("p").alias("p"), (F.col("c") - m).alias("s")))
    return _keyed(rows.select("word", "n", "c", F.explode(both).alias("x")).select("word", "n", "c", "x.p", "x.s"))


def tries(words: DataFrame, cells: int = CELLS) -> DataFrame:
    """(word, n, c, p, s, key): every word in all tries where it may have a near word."""
    length = F.length("word")
    classes = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("c")).filter(F.col("c") >= MIN_LENGTH)
    rows = _cut(classes.withColumns({"p": F.lit(0), "s": F.lit(0)}))
    done: list[DataFrame] = []
    trie = ["c", "p", "s", "key"]
    while True:
        large = checkpoint(rows.groupBy(*trie).count().filter((F.col("count") * (F.col("c") + 1) > cells) & (F.col("c") - F.col("s") - F.col("p") > 1)).select(*trie))
        if large.isEmpty():
            break
        done.append(rows.join(large, trie, "left_anti"))
        rows = checkpoint(_cut(rows.join(large, trie, "left_semi")))
    for more in done:
        rows = rows.unionByName(more)
    return rows


class Forest:
    """Tries of words, side by side; words are sorted by (trie, letters) and distinct within a trie."""

    def __init__(self, trie: np.ndarray, letters: np.ndarray, lengths: np.ndarray):
        """trie: a number for each word; letters: a row of code points for each, 0 behind its end."""
        n = len(trie)
        node = np.cumsum(np.r_[True, trie[1:] != trie[:-1]][:n]) - 1
        #: Of every depth: parent, letter, first child, number of children, word that ends there (or -1).
        self.parent, self.letter, self.first, self.fan, self.word = [], [], [], [], []
        live, count = np.arange(n), int(node[-1]) + 1 if n else 0
        self._level(np.zeros(count, np.int64), np.zeros(count, np.int64))
        depth = 0
        while True:
            longer = lengths[live] > depth
            ended = ~longer
            self.word[-1][node[ended]] = live[ended]
            live, above = live[longer], node[longer]
            if not len(live):
                self.first.append(np.zeros(len(self.parent[-1]), np.int64))
                self.fan.append(np.zeros(len(self.parent[-1]), np.int64))
                break
            x = letters[live, depth].astype(np.int64)
            new = np.r_[True, (above[1:] != above[:-1]) | (x[1:] != x[:-1])]
            node = np.cumsum(new) - 1
            parent = above[new]
            self.fan.append(np.bincount(parent, minlength=len(self.parent[-1])))
            self.first.append(np.cumsum(self.fan[-1]) - self.fan[-1])
            self._level(parent, x[new])
            depth += 1

    def _level(self, parent: np.ndarray, letter: np.ndarray) -> None:
        self.parent.append(parent)
        self.letter.append(letter)
        self.word.append(np.full(len(parent), -1))

    def _children(self, depth: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among nodes, child) of all children of some nodes."""
        fan = self.fan[depth][nodes]
        child = np.repeat(self.first[depth][nodes] - (np.cumsum(fan) - fan), fan) + np.arange(int(fan.sum()))
        return np.repeat(np.arange(len(nodes)), fan), child

    def _child_by(self, depth: int, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The child of each node by a letter, or -1."""
        if depth + 1 >= len(self.parent):
            return np.full(len(nodes), -1)
        keys = self.parent[depth + 1] << 21 | self.letter[depth + 1]
        asked = nodes << 21 | letters
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, at, -1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(word, other) at distance one, both ways round."""
        one, two = [], []
        # Active nodes of the roots: their children. Kept by how much deeper than the node they lie.
        none = np.zeros(0, np.int64)
        active = {-1: (none, none), 0: (none, none), 1: self._children(0, np.arange(len(self.parent[0])))}
        for d in range(1, len(self.parent)):
            parent, letter = self.parent[d], self.letter[d]
            own = np.arange(len(parent))
            new: dict[int, list] = {-1: [(own, parent)], 0: [], 1: [self._children(d, own)]}
            place, sibling = self._children(d - 1, parent)
            new[0].append((place[sibling != place], sibling[sibling != place]))
            for e, (u, v) in active.items():
                if d - 1 + e < 0 or not len(u):
                    continue
                at, c = self._children(d - 1, u)
                v = v[at]
                found = self._child_by(d - 1 + e, v, letter[c])
                good = found >= 0
                if e == 1:
                    good &= v != c  # else it is a child of the node itself, which is there already
                elif e == -1:
                    good &= found != parent[c]  # likewise the parent
                new[e].append((c[good], found[good]))
            active = {e: tuple(np.concatenate(x) for x in zip(*found)) for e, found in new.items()}
            for e, (u, v) in active.items():
                if 0 <= d + e < len(self.word):
                    a, b = self.word[d][u], self.word[d + e][v]
                    both = (a >= 0) & (b >= 0)
                    one.append(a[both])
                    two.append(b[both])
        return (np.concatenate(one), np.concatenate(two)) if one else (none, none)


def _common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many letters rows of two matrices share from the start; they differ somewhere."""
    return np.argmax(a != b, axis=1)


def near_words(words: DataFrame, cells: int = CELLS, together: int = TOGETHER) -> DataFrame:
    """(word, n, other, other_n): words at distance one, both ways round, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            word, n, c, p, s, key = (t.column(k).combine_chunks() for k in range(6))
            c, p, s, key = (x.to_numpy(zero_copy_only=False) for x in (c, p, s, key))
            texts = word.to_pylist()
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            # Tries by width, so that a few long words don't make all rows wide.
            width = np.maximum(c + 1, 32).astype(np.int64)
            for w in np.unique(width):
                mine = np.flatnonzero(width == w)
                u = np.array([texts[k] for k in mine], dtype=f"<U{w}")
                points = u.view(np.uint32).reshape(len(mine), -1)
                size = lengths[mine]
                back = s[mine] > p[mine]
                turned = points.copy()
                at = size[back, None] - 1 - np.arange(points.shape[1])[None]
                turned[back] = np.where(at >= 0, np.take_along_axis(points[back], np.maximum(at, 0), axis=1), 0)
                # Sorted by trie, then letters: a row's code points, big-endian, compare as bytes.
                as_bytes = np.ascontiguousarray(turned.astype(">u4")).view(f"S{4 * points.shape[1]}").ravel()
                tries_ = np.cumsum(np.r_[True, (key[mine][1:] != key[mine][:-1]) | (c[mine][1:] != c[mine][:-1]) | (p[mine][1:] != p[mine][:-1]) | (s[mine][1:] != s[mine][:-1])])
                order = np.lexsort((as_bytes, tries_))
                a, b = Forest(tries_[order], turned[order], size[order]).pairs()
                a, b = mine[order[a]], mine[order[b]]
                place = np.full(len(texts), -1)
                place[mine] = np.arange(len(mine))
                common = _common_prefix(points[place[a]], points[place[b]])
                right = (np.minimum(lengths[a], lengths[b]) == c[a]) & ((s[a] == 0) | (common < c[a] - s[a]))
                a, b = pa.array(a[right]), pa.array(b[right])
                yield pa.RecordBatch.from_arrays([word.take(a), n.take(a), word.take(b), n.take(b)], ["word", "n", "other", "other_n"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4, 5)]
            new = np.flatnonzero(np.r_[last != tuple(x[0] for x in names), np.any([x[1:] != x[:-1] for x in names], axis=0)])
            last = tuple(x[-1] for x in names)
            cells_ = np.cumsum(names[0].astype(np.int64) + 1)
            begin = 0
            for k in new:  # a trie is never cut
                before = int(cells_[k - 1]) if k else 0
                if size + before - (int(cells_[begin - 1]) if begin else 0) >= together:
                    if k > begin:
                        held.append(batch.slice(begin, int(k) - begin))
                    if held:
                        yield from done()
                    held, size, begin = [], 0, int(k)
            held.append(batch.slice(begin))
            size += int(cells_[-1]) - (int(cells_[begin - 1]) if begin else 0)
        if held:
            yield from done()

    rows = tries(words, cells).select("word", "n", "c", "p", "s", "key")
    dealt = rows.repartition("key").sortWithinPartitions("c", "p", "s", "key", "word")
    return dealt.mapInArrow(run, "word string, n long, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the forms that follow one another; steps double each round.

    A form is at least TIMES as frequent as its word, so no chain is longer than the
    number of digits of the largest count, and there is no ring.
    """
    jump = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        further = jump.select(F.col("word").alias("via"), F.col("root").alias("next"))
        moved = checkpoint(jump.join(further, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")))
        jump = moved.select("word", "root")
        if moved.filter("on").isEmpty():
            return jump


def variants(words: DataFrame, times: int = TIMES, cells: int = CELLS, together: int = TOGETHER) -> DataFrame:
    """One row for each word of (word, n): (word, form, root, n, n_near, form_n).

    form is the near word of largest n (of equals the smallest in code-point order) if that
    is at least `times` the word's, root the end of the chain of forms, or the word
    itself. Words must be distinct, of MIN_LENGTH letters at least. No words: no rows.
    """
    held = checkpoint(words)
    near = near_words(held, cells, together).groupBy(F.col("word").alias("near_to")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    joined = held.join(near, F.col("word") == F.col("near_to"), "left")
    enough = -F.col("best.less") >= F.lit(times) * F.col("n")
    found = checkpoint(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    ends = roots(found.filter("form IS NOT NULL")).withColumnRenamed("word", "of")
    return found.join(ends, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: variants(vocabulary(documents)) as DuckDB SQL, by letters deleted at every place.
ORACLE_SQL = rf"""
WITH RECURSIVE runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS i, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]{{{MIN_LENGTH},}}')) AS w FROM documents
), counted AS (SELECT i, w, count(*) AS n FROM runs GROUP BY i, w
), hashed AS (SELECT w, n, {crc32_sql.crc32("i || ':' || w")} AS h FROM counted
), cut AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN left(w, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word, n FROM hashed
), words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}
), deleted AS (SELECT word, n, k, left(word, (k - 1)::INTEGER) || substr(word, k + 1) AS d FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)
), near AS (
    SELECT a.word, b.word AS other, b.n AS m FROM deleted a JOIN deleted b ON a.d = b.d AND a.k = b.k AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM deleted a JOIN words b ON a.d = b.word
    UNION SELECT b.word, a.word, a.n FROM deleted a JOIN words b ON a.d = b.word
), best AS (SELECT word, count(*) AS n_near, min({{'less': -m, 'form': other}}) AS best FROM near GROUP BY word
), found AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.best.less >= {TIMES} * w.n THEN b.best.form END AS form,
           CASE WHEN -b.best.less >= {TIMES} * w.n THEN -b.best.less END AS form_n FROM words w LEFT JOIN best b USING (word)
), chain AS (
    SELECT word, word AS at, form AS next FROM found
    UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN found f ON f.word = c.next
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM found f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
