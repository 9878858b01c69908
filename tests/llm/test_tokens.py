"""BPE and token counts against the libraries themselves."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from silverleaf.llm import bpe, token_counts

from .data import ALL_IDS, AWKWARD, awkward, empty, ids, table

ODD = list("abcABC  \n\t'''sdtlm.,!?|<>09²½éÉßñİŸµªſ\x85\xa0 ́̇Σςσǅあが한국ᄒ😀👍🏽Ⅷ٣\x00\x1c​ﬁ▁") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "</s>", "<s>", "'ll", "I'VE"]


def texts():
    rng = random.Random(5)
    out = ["".join(rng.choices(ODD, k=rng.randint(0, 50))) for _ in range(400)]
    return [*out, "a" * 3000, " " * 3000, "ab" * 2000 + " " + "x" * 500, "日本語" * 900, None, ""]


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(texts())]
    known = table(spark, "documents").select((F.col("doc_id") + 10_000).alias("doc_id"), "text")
    return spark.createDataFrame(rows, "doc_id long, text string").unionByName(known).repartition(3).cache()


def test_encoding_and_decoding_are_the_librarys(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r[0]: (r[1], r[2]) for r in bpe.encode_decode(docs, block_chars=100_000).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        ids_ = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]] == (ids_, tok.decode(ids_, skip_special_tokens=False))


def test_blocks_without_their_words_fail():
    body = bpe._dump(np.array([1], np.uint64), np.zeros(1, np.uint8), np.ones(1, np.uint32), np.zeros(1, np.uint32))
    with pytest.raises(RuntimeError):
        list(bpe._render(1, body, [], pa.array([], pa.string())))


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 256), (50, 4), (7, 2)])
def test_counts_are_the_librarys_however_texts_are_cut(spark, docs, chunk, overlap):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    small = docs.filter("length(coalesce(text, '')) < 5000")
    got = {r["id"]: r for r in token_counts.count_tokens(small, chunk=chunk, overlap=overlap, limit=100).collect()}
    for r in small.collect():
        n = len(sp.encode(r["text"] or ""))
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["over_limit"]) == (n, len((r["text"] or "").encode()), n > 100)


def test_counts_of_huge_texts_are_the_librarys(spark):
    """Texts of several chunks of the usual size, one of them without a boundary for long."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(11)
    known = [r["text"] for r in table(spark, "documents").select("text").collect() if r["text"]]
    huge = [" ".join(rng.choices(known, k=150)), "".join(rng.choices(ODD, k=150_000)), " ".join(known)[:100_000] + "a" * 40_000 + " " + " ".join(known)[:60_000], "日本語。" * 30_000]
    assert all(len(t) > 65_536 + 256 for t in huge)
    docs = spark.createDataFrame(list(enumerate(huge)), "doc_id long, text string")
    got = {r["id"]: (r["n_tokens"], r["n_bytes"]) for r in token_counts.count_tokens(docs).collect()}
    assert got == {k: (len(sp.encode(t)), len(t.encode())) for k, t in enumerate(huge)}


def test_cuts_overlap_and_widen():
    pieces = token_counts.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    assert token_counts.cut(pieces, "a" * 1000, 100, 10) == [(0, 1000, 0, 1000)]  # no boundary is proven
    parts = token_counts.cut(pieces, "a" * 150 + " " + "a" * 150, 100, 10)
    assert parts[0][3] == parts[1][2] == 150 and parts[0][1] > 150 > parts[1][0]


def test_awkward_rows(spark):
    encoded = bpe.encode_decode(awkward(spark)).collect()
    assert ids(encoded) == ALL_IDS
    assert all((r["ids"], r["decoded"]) == ([], "") for r in encoded if r["id"] in (1, 2, 3))
    counted = token_counts.count_tokens(awkward(spark)).collect()
    assert ids(counted) == ALL_IDS
    long = next(t for i, t, *_ in AWKWARD if i == 8)
    assert next(r["n_bytes"] for r in counted if r["id"] == 8) == len(long.encode())
    assert bpe.encode_decode(empty(spark)).count() == token_counts.count_tokens(empty(spark)).count() == 0
