"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A boundary between two characters is proven stable when no piece of the vocabulary
holds that pair side by side: no merge can ever span it, so any encoding that has both
characters away from its ends has a token boundary there, and the tokens on either
side do not depend on the other side. Huge documents are cut into chunks that overlap;
an overlap that holds no stable boundary is widened until it does (or the document
ends, and then it is not cut there). Both chunks of an overlap report the stable
boundary from their own token offsets, and the counts are spliced where they agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MODEL = "piece_bpe_32k.model"
#: Characters from one cut to the next, of an overlap at first, and encoded at once.
CHUNK, OVERLAP, BATCH = 1 << 16, 256, 1 << 18
SPACE = "▁"


class Pieces:
    """A sentencepiece model with the length of each piece and the pairs inside pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.chars = np.zeros(n, np.int64)
        self.pairs: set[str] = set()
        for i in range(n):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.chars[i] = not 0x80 <= int(piece[3:5], 16) < 0xC0  # a character counts at its first byte
            elif not self.model.is_control(i):
                self.chars[i] = len(piece) if not self.model.is_unknown(i) else 1
                self.pairs.update(piece[k : k + 2] for k in range(len(piece) - 1))

    def stable(self, text: str, start: int, stop: int) -> int | None:
        """The first stable boundary in [start, stop), start over 0."""
        pairs, stop = self.pairs, min(stop, len(text))
        for k in range(start, stop):
            if text[k - 1 : k + 1].replace(" ", SPACE) not in pairs:
                return k
        return None

    def offsets(self, text: str) -> np.ndarray:
        """The end of each token, in characters of the text."""
        ends = np.cumsum(self.chars[self.model.encode(text)]) - 1  # one for the space put in front
        if len(ends) and ends[-1] != len(text):
            raise ValueError("the model's normaliser changes lengths; its texts can't be cut")
        return ends


def cut(pieces: Pieces, text: str, chunk: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, stop, lead, tail) of overlapping chunks; counts hold from lead to tail."""
    cuts, at = [], chunk  # (start of the overlap, its end, the boundary)
    while at < len(text):
        width, found = overlap, None
        while found is None and at + width // 2 < len(text):
            found = pieces.stable(text, at + 1 if width == overlap else at + width // 2, at + width)
            width *= 2
        if found is None:
            break
        cuts.append((at, min(len(text), max(at + overlap, found + 1)), found))
        at = max(at + chunk, found + 1)
    starts = [(0, 0), *((a, p) for a, _, p in cuts)]
    stops = [*((z, p) for _, z, p in cuts), (len(text), len(text))]
    return [(a, z, lead, tail) for (a, lead), (z, tail) in zip(starts, stops)]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row's whole text.

    Counts are the sentencepiece library's, without begin, end or other special tokens.
    Null and empty texts count 0; repeated rows stay repeated; null ids stay null; an
    empty table stays empty. Other columns of docs are not read.
    """
    path = path or public_tokenizers.path(DEFAULT_MODEL)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    huge = F.length("text") > chunk + overlap

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(path).model
        for b in batches:
            texts, counts, at = b.column(1).to_pylist(), [], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH):
                    size, end = size + len(texts[end]), end + 1
                counts += map(len, model.encode(texts[at:end], num_threads=1))
                at = end
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, row = Pieces(path), TaskContext.get().partitionId() << 33
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                text = t.as_py()
                parts, row = cut(pieces, text, chunk, overlap), row + 1
                for k, (a, z, lead, tail) in enumerate(parts):
                    own = text[a : parts[k + 1][0] if k + 1 < len(parts) else z]
                    yield pa.RecordBatch.from_pylist(
                        [{"row": row, "part": k, "parts": len(parts), "id": i.as_py(), "start": a, "lead": lead, "tail": tail, "size": len(own.encode("utf-8", "surrogatepass")), "text": text[a:z]}], schema=_CHUNK
                    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        for b in batches:
            out = []
            for r in b.to_pylist():
                ends, text, a = pieces.offsets(r["text"]), r["text"], r["start"]
                first, last = -1, len(ends) - 1
                lead, tail = r["lead"], r["tail"]
                if r["part"]:  # the boundary must be one of this chunk's own
                    first = int(np.searchsorted(ends, lead - a))
                    lead = int(ends[first]) + a
                if r["part"] + 1 < r["parts"]:
                    last = int(np.searchsorted(ends, tail - a))
                    tail = int(ends[last]) + a
                out.append({"row": r["row"], "part": r["part"], "parts": r["parts"], "id": r["id"], "lead": lead, "tail": tail, "size": r["size"], "n": last - first})
            yield pa.RecordBatch.from_pylist(out, schema=_COUNT)

    short = rows.filter(~huge).mapInArrow(whole, "id long, n_bytes long, n_tokens long")
    dealt = rows.filter(huge).mapInArrow(chunks, _ddl(_CHUNK)).repartition("row", "part")
    parts = dealt.mapInArrow(encoded, _ddl(_COUNT)).groupBy("row").agg(
        F.first("id").alias("id"), F.sum("size").alias("n_bytes"), F.sum("n").alias("n_tokens"), F.max("parts").alias("parts"), F.array_sort(F.collect_list(F.struct("part", "lead", "tail"))).alias("at")
    )
    agree = F.forall(F.sequence(F.lit(1), F.size("at")), lambda k: (k == F.size("at")) | (F.get("at", k - 1)["tail"] == F.get("at", k)["lead"]))
    spliced = parts.filter(F.when((F.size("at") == F.col("parts")) & agree, True).otherwise(F.raise_error(F.lit("chunks of a document do not meet")).cast("boolean")))
    every = short.unionByName(spliced.select("id", "n_bytes", "n_tokens"))
    return every.withColumn("over_limit", F.col("n_tokens") > limit)


_CHUNK = pa.schema([(n, pa.int64()) for n in ("row", "part", "parts", "id", "start", "lead", "tail", "size")] + [("text", pa.string())])
_COUNT = pa.schema([(n, pa.int64()) for n in ("row", "part", "parts", "id", "lead", "tail", "size", "n")])


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {'string' if f.type == pa.string() else 'long'}" for f in schema)
