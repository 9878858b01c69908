"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio.

All of it is DataFrame functions. Each word is hashed once; single words and word pairs
go by these hashes into a fixed number of buckets (as is usual for such ratios: rare
n-grams share buckets, and a ratio says something only about what is frequent); two multinomials are counted, one over documents that are trusted
(label quality = 1), one over every document. A document's score is the mean over its
n-grams of log p_trusted - log p_corpus, and every document is held against one fixed
threshold, so equal texts always get equal verdicts.

Counting explodes n-grams into a hash aggregate with at most as many keys as buckets in
each task, so what is shuffled does not grow with the text and no bucket is hot; the
two counts of each bucket are all that comes to the driver. Every trusted document
counts, so ids are joined with texts by shuffle and each text is moved once; rows
without an id stay where they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import xxh64_sql
from .common import WORD_SPACE

BUCKETS = 1 << 14
PRIOR = 10.0
#: The mean log ratio from which a document is kept.
THRESHOLD = -0.06
MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 50, 3, 50
SYMBOL, SPACE = "[#*$%&|<>]", " \t\n\x0b\x0c\r"


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WORD_SPACE))


def _unit(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS))


def _pair(h: Column, g: Column) -> Column:
    return F.pmod(F.xxhash64(h, g), F.lit(BUCKETS))


def with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("id", "text", _words(F.col("text")).alias("w")).select("id", "text", "w", F.size("w").alias("n"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))


def bucket_counts(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, corpus, trusted): n-grams in all rows, and in rows with a trusted id."""
    # A hash join, as a sorted one would sort the texts.
    known = trusted.select(F.col("doc_id").alias("tid")).filter("tid IS NOT NULL").distinct().hint("shuffle_hash")
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL").join(known, F.col("id") == F.col("tid"), "left")
    others = docs.filter(F.col(id_col).isNull()).select(F.col(text_col).alias("text"), F.lit(False).alias("t"))
    rows = with_words(named.select("text", F.col("tid").isNotNull().alias("t")).unionByName(others), "t", "text")
    units = F.transform("h", _unit)
    pairs = F.transform(F.slice("h", 1, F.greatest(F.col("n") - 1, F.lit(0))), lambda x, i: _pair(x, F.get("h", i + 1)))
    grams = rows.select(F.col("id").alias("t"), F.explode(F.concat(units, pairs)).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count("*").alias("corpus"), F.count_if("t").alias("trusted"))


def log_ratios(counts: DataFrame) -> list[float]:
    """log p_trusted - log p_corpus of each bucket, both smoothed by the same prior.

    A bucket's trusted count is held against what the corpus leads one to expect of so
    much trusted text; PRIOR is added to both, so rare n-grams say little. Without
    trusted text nothing is known and every ratio is 0.
    """
    corpus, trusted = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():  # at most BUCKETS rows
        corpus[r["bucket"]], trusted[r["bucket"]] = r["corpus"], r["trusted"]
    share = sum(trusted) / max(1, sum(corpus))
    return [math.log(t + PRIOR) - math.log(c * share + PRIOR) for t, c in zip(trusted, corpus)]


def train(docs: DataFrame, labels: DataFrame) -> list[float]:
    return log_ratios(bucket_counts(docs, labels.filter("quality = 1")))


def score(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, base counts, log_ratio, base_failed, kept.

    Null texts have no words and fail; a text of one word has one n-gram; repeated rows
    and null ids stay; an empty table stays empty; other columns of docs are not read.
    Windows of words are compared by a 64-bit hash.
    """
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    rows = with_words(docs, id_col, text_col)
    n, w, h = F.col("n"), F.col("w"), F.col("h")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.transform(F.slice(h, 1, F.greatest(n - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    each = F.transform(h, lambda x, i: F.get(weights, _unit(x)) + F.when(i + 1 < n, F.get(weights, _pair(x, F.get(h, i + 1)))).otherwise(0.0))
    made = rows.select(
        "id",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", SYMBOL)) - 1).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("windows"),
        F.aggregate(each, F.lit(0.0), lambda a, x: a + x).alias("total"),
    )
    # Only texts with a repeated window need its places: sort (window, place), keep neighbours that agree.
    placed = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    made = made.select(
        "id", "n_words", "word_chars", "n_symbols", "total",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        placed.alias("placed"),
    )
    again = F.filter("placed", lambda e, k: F.coalesce(F.get("placed", k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get("placed", k + 1)["h"] == e["h"], F.lit(False)))
    starts = F.sort_array(F.transform(again, lambda e: e["i"]))
    made = made.select("id", "n_words", "word_chars", "n_symbols", "total", "n_dup_lines", starts.alias("starts"))
    first = F.struct(F.lit(0).alias("covered"), F.lit(-WINDOW).alias("last"))
    step = lambda a, x: F.struct((a["covered"] + F.least(F.lit(WINDOW), x - a["last"])).alias("covered"), x.alias("last"))
    repeated = F.coalesce(F.aggregate("starts", first, step, lambda a: a["covered"]), F.lit(0)).cast("long")
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    made = made.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), (F.col("total") / grams).alias("log_ratio"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return made.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("log_ratio") >= threshold))


_GRAMS = f"""
word_hashes AS (SELECT s, h, (h % {BUCKETS})::INT AS bucket FROM hashed_words),
docs_words AS (SELECT r, i, w, h, bucket, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(h) OVER o AS g
  FROM (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs) JOIN word_hashes ON s = w WINDOW o AS (PARTITION BY r ORDER BY i)),
neighbours AS (SELECT DISTINCT h, g FROM docs_words WHERE g IS NOT NULL),
"""
_SCORES = f"""
grams AS (SELECT r, bucket FROM docs_words UNION ALL SELECT r, (q.h % {BUCKETS})::INT FROM docs_words d JOIN pairs q ON q.first = d.h AND q.g = d.g),
trusted AS (SELECT r FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
counts AS (SELECT bucket, count(*) AS c, count(t.r) AS t FROM grams LEFT JOIN trusted t USING (r) GROUP BY bucket),
ratios AS (SELECT bucket, ln(t + {PRIOR}::DOUBLE) - ln(c * (SELECT sum(t)::DOUBLE / sum(c) FROM counts) + {PRIOR}::DOUBLE) AS ratio FROM counts),
totals AS (SELECT r, sum(ratio) AS total FROM grams JOIN ratios USING (bucket) GROUP BY r),
again AS (SELECT r, i FROM docs_words WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, w, w2, w3) > 1),
repeated AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, range({WINDOW}) AS a(k) GROUP BY r),
base AS (SELECT r, doc_id, len(ws) AS n_words, list_sum(list_transform(ws, lambda w: length(w))) AS chars, length(t) - length(regexp_replace(t, '{SYMBOL}', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM docs),
made AS (SELECT doc_id, n_words, coalesce(chars, 0)::BIGINT AS word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(total, 0) / greatest(2 * n_words - 1, 1) AS ratio FROM base LEFT JOIN repeated USING (r) LEFT JOIN totals USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND ratio >= {THRESHOLD} AS kept, round(ratio, 6) + 0 AS log_ratio
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS failed FROM made)
"""
#: The whole operator as DuckDB SQL; log_ratio is rounded, as sums of doubles depend on their order.
ORACLE_SQL = (
    "WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents), "
    "distinct_words AS (SELECT DISTINCT unnest(ws) AS s FROM docs), "
    + xxh64_sql.strings("hashed_words", "distinct_words") + "," + _GRAMS
    + f"seeded AS (SELECT h AS first, g, h AS long, {xxh64_sql.SEED}::UHUGEINT AS seed FROM neighbours), "
    + xxh64_sql.longs("one", "seeded", "first, g", "long", "seed") + ", "
    + xxh64_sql.longs("pairs", "one", "first, g", "g", "h") + "," + _SCORES
)
