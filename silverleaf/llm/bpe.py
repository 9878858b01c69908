"""BPE encoding and decoding through a distinct-word table.

For a word-level BPE (lower-cased words with a word-end mark) a text's ids are its
words' ids in order, so each distinct word is encoded once in the whole corpus:

1. split: tasks cut their documents into words and pack them into blocks of bounded
   size: the block's own word list, and for every document the list positions of its
   words. A block's name is a hash of its word list.
2. encode: the blocks' word lists are exploded, dealt out by word and sorted, so that
   one task meets all rows of a word in a row and encodes it once. A row is a word of a
   block, not an occurrence, so a very frequent word weighs no more than a rare one.
3. join back: each block gets its words' ids by position and so every document's ids.
4. decode: a document's ids are joined with the table of pieces, whose place is the id,
   for a batch of documents at once, and its pieces are put together in order.

Splitting is cheap and blocks are large, so both branches split for themselves, and only
the second moves whole blocks. Should the input's order change in between (it does not
for files), blocks get other names, find no words, and the job fails instead of mixing.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text in a block, of text in an output batch, words packed at once.
BLOCK_CHARS, OUT_CHARS, PACK_WORDS = 24 << 20, 2 << 20, 200_000
DEFAULT_MODEL = "word_bpe_49k.json"


def _ranges(prefix: str) -> str:
    """A regex class of the characters below U+0180 whose category starts so."""
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c)).startswith(prefix))


_L, _N, _S = _ranges("L"), _ranges("N"), r"\t-\r \x85\xa0"
#: The tokenizer's own split pattern, spelled out for the characters below U+0180.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_OTHER = re.compile("[^\x00-ſ]")


class WordBpe:
    """The tokenizer file, cut into its steps: added tokens, normalise and split, merge.

    The library's own tokenizer is loaded only where it is needed.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.vocabulary = spec["model"]["vocab"]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    @cached_property
    def steps(self):
        """(normalizer, pre-tokenizer, tokenizer without a normalizer)."""
        from tokenizers import Tokenizer, normalizers

        tok = Tokenizer.from_file(self.path)
        normalizer = tok.normalizer
        tok.normalizer = normalizers.Sequence([])
        return normalizer, tok.pre_tokenizer, tok

    def pieces(self) -> pa.Array:
        """The table of pieces: each stands at its id."""
        named = {i: p for p, i in (self.vocabulary | self.added).items()}
        return pa.array([named.get(i, "") for i in range(max(named, default=-1) + 1)], pa.string())

    def words(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if not _OTHER.search(text):  # no composition below U+0180, and lower() agrees
            return _WORDS.findall(text.lower())
        normalizer, splitter, _ = self.steps
        norm = normalizer.normalize_str(text)
        return [norm[a:z] for _, (a, z) in splitter.pre_tokenize_str(norm)]

    def encode(self, words: list[str]) -> list[list[int]]:
        plain = self.steps[2].encode_batch([w for w in words if w not in self.added], add_special_tokens=False)
        ids = iter(plain)
        return [[self.added[w]] if w in self.added else next(ids).ids for w in words]


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays of one unsigned type, byte plane by byte plane, compressed."""
    raw = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize))], np.int64).tobytes()
    return head + zstandard.ZstdCompressor(level=3).compress(b"".join(raw))


def _load(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 2 * n, 8).tolist()
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob[8 * (2 * n + 1) :]), 0, []
    for count, width in zip(head[::2], head[1::2]):
        a = np.frombuffer(raw, np.uint8, count * width, at).reshape(width, count).T
        out.append(np.ascontiguousarray(a).view(f"u{width}").ravel())
        at += count * width
    return out


def _blocks(batches: Iterator[pa.RecordBatch], path: str, block_chars: int, with_places: bool) -> Iterator[tuple[int, list[str], bytes]]:
    """(name, words, places) of each block of a task's (id, text) rows; places only if asked for."""
    bpe = WordBpe(path)
    at: dict[str, int] = {}
    ids, nulls, counts, places, chars, held = [], [], [], [], 0, False

    def packed() -> tuple[int, list[str], bytes]:
        words, body = list(at), b""
        if with_places:
            body = _dump(np.array(ids, np.int64).view(np.uint64), np.array(nulls, np.uint8), np.array(counts, np.uint32), np.concatenate(places))
        return xxhash.xxh64_intdigest("\n".join(words).encode("utf-8", "surrogatepass")) - (1 << 63), words, body

    for b in batches:
        for i, t in zip(b.column(0), b.column(1)):
            text = t.as_py() or ""
            ws = bpe.words(text)
            for w in dict.fromkeys(ws):  # in order, so that both branches number words alike
                if w not in at:
                    at[w] = len(at)
            if with_places:
                places.append(np.fromiter(map(at.__getitem__, ws), np.uint32, len(ws)))
                ids.append(i.as_py() or 0)
                nulls.append(not i.is_valid)
                counts.append(len(ws))
            chars, held = chars + len(text), True
            if chars >= block_chars:
                yield packed()
                at, ids, nulls, counts, places, chars, held = {}, [], [], [], [], 0, False
    if held:
        yield packed()


def encode_words(rows: DataFrame, path: str, block_chars: int) -> DataFrame:
    """(block, pack): the ids of each block's words, each word encoded once."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, _ in _blocks(batches, path, block_chars, False):
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(np.full(len(part), block, np.int64)), pa.array(np.arange(at, at + len(part), dtype=np.int32))], ["word", "block", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        last: tuple[str | None, list[int]] = (None, [])
        held: list[tuple[np.ndarray, np.ndarray, list[list[int]]]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            nonlocal held, size
            blocks = np.concatenate([h[0] for h in held])
            place = np.concatenate([h[1] for h in held])
            ids = [x for h in held for x in h[2]]
            n = np.fromiter(map(len, ids), np.uint32, len(ids))
            flat = np.fromiter((x for y in ids for x in y), np.uint32, int(n.sum()))
            start = np.cumsum(n, dtype=np.int64) - n
            order = np.lexsort((place, blocks))
            edges = np.flatnonzero(np.r_[True, np.diff(blocks[order]) != 0])
            names, packs = [], []
            for rows in np.split(order, edges[1:]):
                names.append(int(blocks[rows[0]]))
                packs.append(_dump(place[rows].astype(np.uint32), n[rows], _ragged(flat, start[rows], n[rows])))
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(packs, pa.binary())], ["block", "pack"])

        for b in batches:
            words = b.column(0).to_pylist()
            fresh = [w for k, w in enumerate(words) if w != (words[k - 1] if k else last[0])]
            known = dict(zip(fresh, bpe.encode(fresh)))
            if words and last[0] == words[0]:
                known[words[0]] = last[1]
            if words:
                last = (words[-1], known[words[-1]])
            held.append((b.column(1).to_numpy(), b.column(2).to_numpy(), [known[w] for w in words]))
            size += len(words)
            if size >= PACK_WORDS:
                yield packed()
        if size:
            yield packed()

    words = rows.mapInArrow(explode, "word string, block long, place int")
    return words.repartition("word").sortWithinPartitions("word").mapInArrow(run, "block long, pack binary")


def _ragged(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + n[i]] of every i, one after another."""
    n = n.astype(np.int64)
    ends = np.cumsum(n)
    return flat[np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, ids array<int>, decoded string) of every row's whole text.

    ids are what the tokenizers library gives without added special tokens (their
    strings inside a text still count as such), decoded is the library's decode with
    special tokens kept. Null and empty texts give no ids and an empty string;
    repeated rows stay repeated, null ids stay null, an empty table stays empty.
    Other columns of docs are not read.
    """
    path = path or public_tokenizers.path(DEFAULT_MODEL)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, body in _blocks(batches, path, block_chars, True):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(words)], pa.int64()), pa.array([body], pa.binary())], ["block", "n_words", "body"])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = WordBpe(path).pieces()
        for b in batches:
            for n, body, packs in zip(b.column("n_words"), b.column("body"), b.column("packs")):
                yield from _render(n.as_py(), body.as_py(), packs.as_py() or [], pieces)

    packs = encode_words(rows, path, block_chars).groupBy("block").agg(F.collect_list("pack").alias("packs"))
    joined = rows.mapInArrow(split, "block long, n_words long, body binary").join(packs, "block", "left")
    return joined.select("n_words", "body", "packs").mapInArrow(render, "id long, ids array<int>, decoded string")


def _render(words: int, body: bytes, packs: list[bytes], pieces: pa.Array) -> Iterator[pa.RecordBatch]:
    ids, nulls, counts, place = _load(body)
    ids = ids.view(np.int64)
    parts = [_load(p) for p in packs]
    order = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint32)
    if len(np.unique(order)) != words:
        raise RuntimeError("the words of a block are missing: the input's order changed between its two readings")
    n, start = np.zeros(words, np.int64), np.zeros(words, np.int64)
    flat = np.concatenate([p[2] for p in parts]).astype(np.int32) if parts else np.zeros(0, np.int32)
    each = np.concatenate([p[1] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
    n[order], start[order] = each, np.cumsum(each) - each
    ends = np.cumsum(counts.astype(np.int64))
    first = 0
    while first < len(ids):
        base = int(ends[first - 1]) if first else 0
        last = min(len(ids), max(first + 1, int(np.searchsorted(ends, base + OUT_CHARS // 8, "right"))))
        p = place[base : int(ends[last - 1])].astype(np.int64)
        tokens = _ragged(flat, start[p], n[p])
        upto = np.r_[0, np.cumsum(n[p])]
        edges = np.r_[0, ends[first:last] - base]
        lists = pa.ListArray.from_arrays(pa.array(upto[edges].astype(np.int32)), pa.array(tokens, pa.int32()))
        decoded = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, pieces.take(lists.values)), " ")
        keys = pa.array(ids[first:last], mask=nulls[first:last].astype(bool))
        yield pa.RecordBatch.from_arrays([keys, lists, decoded], ["id", "ids", "decoded"])
        first = last
