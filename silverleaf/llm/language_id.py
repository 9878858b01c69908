"""Language identification by prediction by partial matching.

Every language gets a tree of byte contexts of up to ``order`` bytes, frozen after
training. A byte seen after its context costs -log2 n/(T+D); otherwise an escape,
-log2 D/(T+D), is paid and the context loses its oldest byte (T: times the context was
seen, D: distinct bytes after it). A document's cost under a language is the exact sum
over all its bytes, and the cheapest language wins.

The trees are laid out as one table for each n-gram length, over the n-grams that any
language has, with each language's full cost (escapes included) worked out in advance;
so scoring is a hash lookup for each byte, and escapes are followed only where no
language knows the n-gram. The tables' size is bounded by the training sample's bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold_is

ORDER = 4
#: Training documents of each language, each with its whole text.
SAMPLE_DOCS = 250
#: Bytes scored at once.
CHUNK = 1 << 19
UNKNOWN = "und"
#: Below this posterior the pipeline rejects a document.
MIN_SCORE = 0.5
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class HashTable:
    """uint64 keys to their places, open addressing, looked up in bulk."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.place = np.full(1 << bits, -1, np.int32)
        left, slot, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            free = self.place[slot] < 0
            self.place[slot[free]] = left[free]  # of several for one slot the last stays
            self.keys[slot[free]] = keys[left[free]]
            lost = self.place[slot] != left
            left, slot, self.probes = left[lost], (slot[lost] + 1) & self.mask, self.probes + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        slot = self._slot(keys)
        out = self.place[slot]
        odd = np.flatnonzero((self.keys[slot] != keys) & (out >= 0))
        at = slot[odd]
        for _ in range(self.probes):
            if not len(odd):
                return out
            at = (at + 1) & self.mask
            found = self.place[at]
            settled = (found < 0) | (self.keys[at] == keys[odd])
            out[odd[settled]] = found[settled]
            odd, at = odd[~settled], at[~settled]
        out[odd] = -1
        return out


def _grams(stream: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each place from n - 1 on, as an integer with a leading 1."""
    key = np.ones(len(stream) - n + 1, np.uint64)
    for k in range(n):
        key = (key << np.uint64(8)) | stream[k : len(stream) - n + 1 + k]
    return key


class PpmModel:
    """Frozen context trees of several languages."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.languages, self.order = sorted(texts), order
        streams = [np.frombuffer(b"\n" * order + b"\n".join(t.lower().encode("utf-8", "replace") for t in texts[l]), np.uint8) for l in self.languages]
        count = len(self.languages)
        self.tables: list[HashTable] = []  # of n-grams, n from 1
        self.cost: list[np.ndarray] = []  # bits of the last byte after the others
        self.escape: list[np.ndarray] = [np.zeros((1, count), np.float32)]  # bits to leave the n-gram as a context, n from 0
        union = [np.zeros(0, np.uint64)]
        for n in range(1, order + 2):
            each = [np.unique(_grams(s, n), return_counts=True) for s in streams]
            keys = np.unique(np.concatenate([k for k, _ in each])) if each else np.zeros(0, np.uint64)
            if n == 1:
                context, shorter = np.zeros(len(keys), np.int64), np.full((len(keys), count), 8.0, np.float32)
                contexts = 1
            else:
                context = np.searchsorted(union[-1], keys >> np.uint64(8))
                low = np.uint64((1 << (8 * (n - 1))) - 1)
                suffix = (keys & low) | np.uint64(1 << (8 * (n - 1)))
                shorter, contexts = self.cost[-1][np.searchsorted(union[-1], suffix)], len(union[-1])
            cost, escape = np.empty((len(keys), count), np.float32), np.zeros((contexts, count), np.float32)
            for j, (k, c) in enumerate(each):
                at = np.searchsorted(keys, k)
                times = np.bincount(context[at], c, contexts)
                kinds = np.bincount(context[at], minlength=contexts)
                seen = kinds > 0
                escape[seen, j] = np.log2((times[seen] + kinds[seen]) / kinds[seen])
                cost[:, j] = escape[context, j] + shorter[:, j]
                cost[at, j] = np.log2((times + kinds)[context[at]] / c)
            self.escape[n - 1 :] = [escape]
            self.cost.append(cost)
            self.tables.append(HashTable(keys))
            union.append(keys)

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """(documents, languages): bits of each text under each language."""
        total = np.zeros((len(texts), len(self.languages)))
        parts: list[bytes] = []
        owner: list[int] = []
        size = 0
        pad = b"\n" * self.order
        for i, text in enumerate(texts):
            data = pad + text.lower().encode("utf-8", "replace")
            for at in range(self.order, len(data), CHUNK):
                part = data[at - self.order : at + CHUNK]
                parts.append(part)
                owner.append(i)
                size += len(part)
                if size >= CHUNK:
                    self._add(total, parts, owner)
                    parts, owner, size = [], [], 0
        if parts:
            self._add(total, parts, owner)
        return total

    def _add(self, total: np.ndarray, parts: list[bytes], owner: list[int]) -> None:
        stream = np.frombuffer(b"".join(parts), np.uint8)
        top = self.order + 1
        key = _grams(stream, top)
        place = self.tables[top - 1].find(key)
        bits = self.cost[top - 1][place]
        miss = np.flatnonzero(place < 0)
        bits[miss] = 0
        for n in range(top - 1, 0, -1):  # context of n bytes fails: pay its escape, then try n-grams
            if not len(miss):
                break
            context = (key[miss] >> np.uint64(8)) & np.uint64((1 << (8 * n)) - 1) | np.uint64(1 << (8 * n))
            at = self.tables[n - 1].find(context)
            known = at >= 0
            bits[miss[known]] += self.escape[n][at[known]]
            gram = key[miss] & np.uint64((1 << (8 * n)) - 1) | np.uint64(1 << (8 * n))
            at = self.tables[n - 1].find(gram)
            known = at >= 0
            bits[miss[known]] += self.cost[n - 1][at[known]]
            miss = miss[~known]
        bits[miss] += self.escape[0][0] + 8.0
        ends = np.cumsum([len(p) for p in parts])
        starts = ends - [len(p) for p in parts]  # key[i] ends at stream[i + order]
        edges = np.empty(2 * len(parts), np.int64)
        edges[0::2], edges[1::2] = starts, ends - self.order
        edges = np.minimum(edges, len(bits) - 1)
        sums = np.add.reduceat(bits, edges, axis=0, dtype=np.float64)[0::2]
        sums[-1] = bits[starts[-1] :].sum(axis=0, dtype=np.float64)
        np.add.at(total, owner, sums)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = self.code_lengths([t or "" for t in texts])
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(np.maximum(-1000, bits.min(axis=1, keepdims=True) - bits)).sum(axis=1)
        known = np.array([bool(t) and bool(_LETTER.search(t)) for t in texts])
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0.0)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, order: int = ORDER) -> PpmModel:
    """Fit on at most about sample_docs documents of each language outside fold 0 of 5, on whole texts.

    Rows without an id, text or language are left out; equal rows count once.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~fold_is("doc_id", 5, 0))
    rows = bounded_sample(labelled, sample_docs, "lang", ["doc_id", "text"], 6).select("lang", "doc_id", "text").distinct().collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    return PpmModel(texts, order)


def predict(docs: DataFrame, model: PpmModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row's whole text.

    lang_pred is `und`, with score 0, if the text is null or has no letter, or if no
    language was learned; score is the language's share when costs are taken as exact.
    Ties go to the first language by name. Repeated rows and null ids stay; an empty
    table stays empty. Other columns of docs are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: PpmModel, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, all columns, whose language the model knows well enough.

    Null and empty texts, and texts without a letter, go; a null id changes nothing;
    repeated rows all stay or all go; an empty table stays empty. docs must have a
    column text; any other names may be there.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = model.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([l != UNKNOWN and s >= min_score for l, s in zip(lang, score)]))

    return docs.mapInArrow(run, docs.schema)
