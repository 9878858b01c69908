"""Benchmark decontamination: BM25 retrieval by block-max WAND, then overlap.

Test items go into an inverted index whose terms are pairs of neighbouring words (single
words of the same language are in too many items to tell passages apart). Every
document is cut into overlapping passages, each long enough to hold any item whole, and
every passage is a query: all items whose BM25 score is at least a share of their own
score against themselves are retrieved, with block-max WAND skipping postings that
can't reach it. Impacts are divided by the item's own score, so one threshold serves
all items. A retrieved item counts as found if the passage also holds enough of both
its question and its answer. Items of a few words, which any passage may half hold by chance,
must stand in the passage whole and in order; items of one word or two, which make no
telling pairs, must be a line of their own.

Words are runs of letters and digits; in scripts that put no spaces between words every
character counts as one. Items of like length share an index, whose passages are twice
as long as an item of its length class can be; so what is found never depends on which
other items there are, or on how they are split over indexes.

The index is sent to tasks whole, so its size is bounded: items go into as many indexes
as it takes for each to stay below ``index_bytes``, and documents are held against one
after another. Document frequencies are always those of the whole benchmark.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Share of an item's own score from which it is retrieved; shares of the pairs of its
#: question and of its answer that the passage must hold.
RETRIEVE, QUESTION, ANSWER = 0.4, 0.5, 0.5
#: Items in a posting block, text in one index.
BLOCK, INDEX_BYTES = 64, 8 << 20
#: Words below which an item must stand whole and in order, and the step of their passages;
#: the longest of the first length class of longer ones, and the factor from one class to the next.
SHORT, MIN_STEP, FIRST, CLASSES = 10, 32, 64, 4
#: Words of a document looked at together; passages overlap across the seams.
PIECE = 1 << 16
#: Thai to Lao, Myanmar, Khmer, kana, Han: written without spaces.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W_{_UNSPACED}]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def pairs(ws: list[str]) -> list[tuple[str, str]]:
    return list(zip(ws, ws[1:]))


def step_of(n: int) -> int:
    """The passage step, in words, of the length class of an item of n words: the most that such an item has."""
    if n < SHORT:
        return MIN_STEP
    step = FIRST
    while step < n:
        step *= CLASSES
    return step


def halves(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: the last sentence is the answer, else the last third."""
    cut = max((m.end() for m in re.finditer(r"[.!?\n]+", text.rstrip(" \n.!?"))), default=0)
    q, a = words(text[:cut]), words(text[cut:])
    if len(q) < 2 or len(a) < 2:
        ws = words(text)
        at = len(ws) - max(2, len(ws) // 3)
        q, a = ws[:at], ws[at:]
    return q, a


class Index:
    """Items and their postings; impacts are shares of the item's own score."""

    def __init__(self, items: list[tuple[int | None, str]], frequency: dict[tuple[str, str], int], total: int, mean_length: float):
        """Items of three words or more (shorter ones have no postings) and the document frequencies of their pairs."""
        kept = [(i, t, words(t)) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1]))]
        kept = [(i, t, ws) for i, t, ws in kept if len(ws) >= 3]
        self.ids = [i for i, _, _ in kept]
        self.parts = [tuple(set(pairs(h)) for h in halves(t)) for _, t, _ in kept]
        self.whole = [f" {' '.join(ws)} " if len(ws) < SHORT else None for _, _, ws in kept]
        self.step = max([MIN_STEP, *(step_of(len(ws)) for _, _, ws in kept)])
        self.word: dict[str, int] = {}
        lists: dict[tuple[str, str], list[tuple[int, float]]] = {}
        for d, (_, _, ws) in enumerate(kept):
            counts = Counter(pairs(ws))
            norm = K1 * (1 - B + B * len(ws) / mean_length)
            impact = {p: math.log(1 + (total - frequency[p] + 0.5) / (frequency[p] + 0.5)) * c * (K1 + 1) / (c + norm) for p, c in counts.items()}
            own = sum(impact.values())
            for p, x in impact.items():
                lists.setdefault(p, []).append((d, x / own))
                for w in p:
                    self.word.setdefault(w, len(self.word))
        order = sorted(lists, key=self.key)
        self.keys = np.array([self.key(p) for p in order], np.int64)
        self.docs = [[d for d, _ in lists[p]] for p in order]
        self.impacts = [[x for _, x in lists[p]] for p in order]
        self.block_max = [[max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for x in self.impacts]
        self.top = np.array([max(x) for x in self.impacts])

    def key(self, pair: tuple[str, str]) -> int:
        return self.word[pair[0]] << 32 | self.word[pair[1]]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All (item, score) with score >= threshold, by block-max WAND."""
        found = []
        at = [[self.docs[t][0], t, 0] for t in terms]  # current item, term, place
        slack = threshold - 1e-9

        def forward(c: list[int], item: int) -> bool:
            docs = self.docs[c[1]]
            c[2] = bisect_left(docs, item, c[2])
            if c[2] < len(docs):
                c[0] = docs[c[2]]
                return True
            return False

        while at:
            at.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(at):
                bound += self.top[c[1]]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == item:
                pivot += 1
            bound, end = 0.0, at[pivot + 1][0] if pivot + 1 < len(at) else 1 << 60
            for c in at[: pivot + 1]:  # what the blocks around the pivot can give at most
                docs = self.docs[c[1]]
                k = bisect_left(docs, item, c[2])
                if k < len(docs):
                    bound += self.block_max[c[1]][k // BLOCK]
                    last = min(len(docs), (k // BLOCK + 1) * BLOCK) - 1
                    end = min(end, docs[last] + 1)
            if bound < slack:
                at = [c for c in at if c[0] >= end or forward(c, max(end, item + 1))]
            elif at[0][0] == item:
                score = sum(self.impacts[c[1]][c[2]] for c in at[: pivot + 1])
                if score >= slack:
                    found.append((item, score))
                at = [c for c in at if c[0] > item or forward(c, item + 1)]
            else:
                at = [c for c in at if c[0] >= item or forward(c, item)]
        return found

    def find(self, ws: list[str]) -> dict[int, tuple[float, float, float]]:
        """Items found among a text's words: place -> best (score, question, answer) of a passage."""
        best: dict[int, tuple[float, float, float]] = {}
        if not self.ids:
            return best
        ids = np.fromiter(map(self.word.get, ws, repeat(-1)), np.int64, len(ws))
        for start in range(0, max(1, len(ws)), PIECE):
            own = ids[start : start + PIECE + 2 * self.step]
            if len(own) > 1:
                self._piece(ws, start, own, best)
        return best

    def _piece(self, ws: list[str], start: int, ids: np.ndarray, best: dict[int, tuple[float, float, float]]) -> None:
        there = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        key = ids[there] << 32 | ids[there + 1]
        term = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[term] == key
        there, term = there[hit], term[hit]
        if not len(there):
            return
        sums = np.r_[0.0, np.cumsum(self.top[term])]
        begin = np.arange(0, len(ids), self.step)
        lo, hi = np.searchsorted(there, begin), np.searchsorted(there, begin + 2 * self.step - 1)
        for k in np.flatnonzero(sums[hi] - sums[lo] >= RETRIEVE - 1e-9).tolist():
            terms = np.unique(term[lo[k] : hi[k]])
            if self.top[terms].sum() < RETRIEVE - 1e-9:
                continue
            found = self.search(terms.tolist(), RETRIEVE)
            if not found:
                continue
            a = start + int(begin[k])
            here = ws[a : a + 2 * self.step]
            passage, line = set(pairs(here)), f" {' '.join(here)} "
            for item, raw in found:
                score = round(raw, 9)  # so that passages that hold as much are told apart by their halves
                if self.whole[item] is not None and self.whole[item] not in line:
                    continue
                q, ans = (len(part & passage) / len(part) if part else 1.0 for part in self.parts[item])
                if q >= QUESTION and ans >= ANSWER:
                    best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, q, ans))


class Items:
    """Part of a benchmark: an index of each length class, and the items of one word or two."""

    def __init__(self, items: list[tuple[int | None, str]], frequency: dict[tuple[str, str], int], total: int, mean_length: float):
        by_class: dict[int, list[tuple[int | None, str]]] = {}
        self.lines: dict[tuple[str, ...], list[int | None]] = {}
        for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            ws = words(t)
            if len(ws) >= 3:
                by_class.setdefault(step_of(len(ws)), []).append((i, t))
            elif ws:
                self.lines.setdefault(tuple(ws), []).append(i)
        self.indexes = [Index(part, frequency, total, mean_length) for _, part in sorted(by_class.items())]

    def find(self, text: str) -> list[tuple[int | None, float, float, float]]:
        """(item id, score, question, answer) of every item found in a text."""
        ws = words(text)
        found = [(index.ids[k], *x) for index in self.indexes for k, x in sorted(index.find(ws).items())]
        if self.lines:
            own = {tuple(words(line)) for line in text.split("\n")}
            found += [(i, 1.0, 1.0, 1.0) for line in sorted(own & self.lines.keys()) for i in self.lines[line]]
        return found


def indexes(benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> Iterator[Items]:
    """The benchmark's items in parts of bounded size, with frequencies over all items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([" ".join(p) for p in dict.fromkeys(pairs(words(t)))], pa.string())], ["term"])

    size, total = items.agg(F.sum(F.length("text")), F.count("*")).first()
    if not total:
        return
    length = max(1.0, size / total / 6)  # about: characters of a word with its space
    parts = max(1, math.ceil(size / index_bytes))
    frequency = items.mapInArrow(listed, "term string").groupBy("term").count()
    for k in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        known = frequency if parts == 1 else frequency.join(own.mapInArrow(listed, "term string").distinct(), "term", "left_semi")
        counts = {tuple(r["term"].split(" ")): r["count"] for r in known.collect()}
        yield Items([(r["item_id"], r["text"]) for r in own.collect()], counts, total, length)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(id, item_id, score, question, answer): every item found in every document.

    Null and empty texts match nothing, nor do items without a letter or digit; repeated
    rows are reported as often as they stand there; equal items are each reported, also
    those without an id; empty tables give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, item_id long, score double, question double, answer double"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in indexes(benchmark, index_bytes):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(i.as_py(), *x) for i, t in zip(b.column(0), b.column(1)) if t.is_valid for x in items.find(t.as_py())]
                columns = zip(*found) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3)], ["id", "item_id", "score", "question", "answer"])

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of docs, all columns, in which no item is found.

    Rows with null and empty texts stay; a null id changes nothing; repeated rows all stay
    or all go; items without an id count; an empty table stays empty, and an empty
    benchmark removes nothing. docs must have a column text; any other names may be there.
    """
    at = docs.columns.index("text")
    for items in indexes(benchmark, index_bytes):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not (t.is_valid and items.find(t.as_py())) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


_SPLIT = f"regexp_extract_all(regexp_replace(lower(@), '([{_UNSPACED}])', ' \\1 ', 'g'), '[{_UNSPACED}]|[\\p{{L}}\\p{{N}}]+')"
_ENDS, _LAST = "' .!?' || chr(10)", "'(?s)^.*[.!?\\n]'"
_STEPS = [FIRST * CLASSES**k for k in range(12)]
#: The whole operator as DuckDB SQL, without an index: all scores of all passages.
ORACLE_SQL = f"""
WITH given AS (SELECT row_number() OVER () AS d, item_id, text, length(regexp_extract(rtrim(text, {_ENDS}), {_LAST})) AS cut
  FROM (SELECT DISTINCT item_id::BIGINT AS item_id, text FROM benchmark WHERE text IS NOT NULL)),
split AS (SELECT d, item_id, {_SPLIT.replace("@", "text")} AS ws, {_SPLIT.replace("@", "substr(text, 1, cut)")} AS qs, {_SPLIT.replace("@", "substr(text, cut + 1)")} AS zs FROM given),
items AS (SELECT d, item_id, ws, len(ws) AS n, len(qs) >= 2 AND len(zs) >= 2 AS named, len(ws) - greatest(2, len(ws) // 3) AS upto, qs, zs,
  CASE WHEN len(ws) < {SHORT} THEN {MIN_STEP} ELSE list_min(list_filter({_STEPS}, lambda s: s >= len(ws))) END AS step FROM split),
sides AS (SELECT d, 'all' AS side, ws FROM items UNION ALL SELECT d, 'question', CASE WHEN named THEN qs ELSE ws[1 : upto] END FROM items
  UNION ALL SELECT d, 'answer', CASE WHEN named THEN zs ELSE ws[upto + 1 : len(ws)] END FROM items),
held AS (SELECT d, side, ws[i] AS a, ws[i + 1] AS b, count(*) AS c FROM sides, LATERAL (SELECT unnest(range(1, len(ws))) AS i) GROUP BY ALL),
frequency AS (SELECT a, b, count(*) AS f FROM held WHERE side = 'all' GROUP BY a, b),
size AS (SELECT count(*) AS total, greatest(1, sum(length(text)) / count(*) / 6) AS mean FROM given),
impacts AS (SELECT d, a, b, ln(1 + (total - f + 0.5::DOUBLE) / (f + 0.5)) * c * {K1 + 1}::DOUBLE / (c + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * n / mean)) AS x
  FROM held JOIN items USING (d) JOIN frequency USING (a, b), size WHERE side = 'all' AND n >= 3),
shares AS (SELECT d, a, b, x / sum(x) OVER (PARTITION BY d) AS share FROM impacts),
parts AS (SELECT d, a, b, bool_or(side = 'question') AS q, bool_or(side = 'answer') AS z FROM held GROUP BY d, a, b),
wholes AS (SELECT d, count(*) FILTER (side = 'question') AS q_all, count(*) FILTER (side = 'answer') AS z_all FROM held GROUP BY d),
docs AS (SELECT row_number() OVER () AS r, doc_id, text, {_SPLIT.replace("@", "text")} AS ws FROM documents WHERE text IS NOT NULL),
places AS (SELECT r, len(ws) AS n, i - 1 AS p, ws[i] AS a, ws[i + 1] AS b FROM docs, LATERAL (SELECT unnest(range(1, len(ws))) AS i)),
hits AS (SELECT l.r, l.n, l.p, s.d, s.a, s.b, s.share, coalesce(h.q, FALSE) AS q, coalesce(h.z, FALSE) AS z, step
  FROM places l JOIN shares s USING (a, b) JOIN parts h USING (d, a, b) JOIN items i ON i.d = s.d),
pieces AS (SELECT *, least(n - start, {PIECE} + 2 * step) AS own FROM (SELECT *, unnest(range(0, p + 1, {PIECE})) AS start FROM hits) WHERE p - start <= {PIECE} + 4 * step),
passages AS (SELECT r, d, start + skip AS first, start, step, a, b, any_value(share) AS share, any_value(q) AS q, any_value(z) AS z, bool_or(p + 1 < start + own) AS seen
  FROM (SELECT *, unnest(range(greatest(0, (p - start) // step - 1) * step, p - start + 1, step)) AS skip FROM pieces) WHERE skip < own AND p - start - skip <= 2 * step - 2 GROUP BY ALL),
scored AS (SELECT r, d, first, step, round(sum(share) FILTER (seen), 9) AS score, count(*) FILTER (q) AS q, count(*) FILTER (z) AS z FROM passages GROUP BY r, d, start, first, step HAVING sum(share) FILTER (seen) >= {RETRIEVE} - 1e-9),
judged AS (SELECT r, c.d, o.doc_id, i.item_id, score, CASE WHEN coalesce(q_all, 0) = 0 THEN 1.0::DOUBLE ELSE q / q_all END AS question, CASE WHEN coalesce(z_all, 0) = 0 THEN 1.0::DOUBLE ELSE z / z_all END AS answer
  FROM scored c JOIN items i ON i.d = c.d JOIN docs o USING (r) LEFT JOIN wholes w ON w.d = c.d
  WHERE i.n >= {SHORT} OR contains(' ' || array_to_string(o.ws[first + 1 : first + 2 * c.step], ' ') || ' ', ' ' || array_to_string(i.ws, ' ') || ' ')),
best AS (SELECT r, d, any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, max({{'s': score, 'q': question, 'z': answer}}) AS x FROM judged WHERE question >= {QUESTION} AND answer >= {ANSWER} GROUP BY r, d),
lines AS (SELECT DISTINCT r, doc_id, {_SPLIT.replace("@", "line")} AS ws FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line FROM docs))
SELECT doc_id, item_id, x.s AS score, x.q AS question, x.z AS answer FROM best
UNION ALL SELECT doc_id, item_id, 1, 1, 1 FROM lines JOIN items USING (ws) WHERE len(ws) IN (1, 2)
"""
