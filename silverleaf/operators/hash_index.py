"""Hamming range search by multi-index hashing.

A hash of 256 bits is cut into 16 blocks of 16. Within a radius below 16 * (t + 1) of a
query, some block of the hash has no more than t bits other than the query's. The stored
table has a row for each block of each hash, partitioned by block and in order of the
block's value, so the few values near a query's block are read from few row groups. A
hash that is near in several blocks is taken in the first of them, so nothing needs to be
made distinct. Radii of 48 and more, for which near values are too many, go through all
rows of one block.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits

BLOCKS = 16
WIDTH = 256 // BLOCKS
#: Bits of a block up to which near values are listed: 1, 17 or 137 of them.
MOST_FLIPS = 2


def _block(words: Column, k: int) -> Column:
    """Block k of four 64-bit words as a number."""
    per_word = 64 // WIDTH
    return F.shiftrightunsigned(F.get(words, k // per_word), 64 - WIDTH * (k % per_word + 1)).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long")).cast("int")


def rows(phash: DataFrame) -> DataFrame:
    """(block, value, asset_id, algo, words) of every hash; those that are none are left out."""
    algo = F.col("algo") if "algo" in phash.columns else F.lit(None).cast("string")
    held = phash.select("asset_id", algo.alias("algo"), bits.hash_words(F.col("phash_hex")).alias("words")).filter("words IS NOT NULL")
    blocks = F.array(*(F.struct(F.lit(k).alias("block"), _block(F.col("words"), k).alias("value")) for k in range(BLOCKS)))
    return held.select("asset_id", "algo", "words", F.explode(blocks).alias("b")).select("b.block", "b.value", "asset_id", "algo", "words")


def write(phash: DataFrame, path: str) -> None:
    """Store the table; rows are range-partitioned by block and value, so equal values lie together and none fills a task alone."""
    order = ["block", "value", "asset_id"]
    rows(phash).repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("block").parquet(path)


def near_values(value: int, flips: int) -> list[int]:
    """All numbers of WIDTH bits with at most so many bits other than value."""
    return sorted({value ^ sum(1 << b for b in chosen) for k in range(flips + 1) for chosen in combinations(range(WIDTH), k)})


def search(spark: SparkSession, path: str, phash_hex: str, radius: int, algo: str | None = None) -> DataFrame:
    """(asset_id, score) of stored hashes at no more differing bits, fewest first; none for an invalid query."""
    stored = spark.read.parquet(path)
    if algo is not None:
        stored = stored.filter(F.col("algo") == algo)
    try:
        number = int(phash_hex, 16) if phash_hex and len(phash_hex) <= bits.DIGITS and set(phash_hex.lower()) <= set("0123456789abcdef") else -1
    except ValueError:
        number = -1
    if number < 0 or radius < 0:
        return stored.select("asset_id", F.lit(0).cast("long").alias("score")).limit(0)
    asked = [number >> (256 - WIDTH * (k + 1)) & ((1 << WIDTH) - 1) for k in range(BLOCKS)]
    words = [number >> (192 - 64 * k) & ((1 << 64) - 1) for k in range(bits.WORDS)]
    query = F.array(*(F.lit(w - (1 << 64) if w >> 63 else w).cast("long") for w in words))
    score = bits.hamming(F.col("words"), query).cast("long").alias("score")
    flips = radius // BLOCKS
    if flips > MOST_FLIPS:
        found = stored.filter("block = 0").select("asset_id", score)
    else:
        parts = []
        for k in range(BLOCKS):
            near = reduce(lambda a, b: a | b, (F.col("value") == v for v in near_values(asked[k], flips)))
            earlier = [F.bit_count(_block(F.col("words"), j).bitwiseXOR(F.lit(asked[j]))) <= flips for j in range(k)]
            fresh = reduce(lambda a, b: a & ~b, earlier, F.lit(True))
            parts.append(stored.filter((F.col("block") == k) & near).filter(fresh).select("asset_id", score))
        found = reduce(DataFrame.unionByName, parts)
    return found.filter(F.col("score") <= radius).orderBy("score", "asset_id")
