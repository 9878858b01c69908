"""Perceptual hashes: hexadecimal text of up to 256 bits as four 64-bit words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS, DIGITS = 4, 64


def is_hash(h: Column) -> Column:
    return h.isNotNull() & h.rlike(rf"^[0-9a-fA-F]{{1,{DIGITS}}}$")


def hash_words(h: Column) -> Column:
    """array<bigint> of the hash, its number padded on the left; null if it is no hash."""
    padded = F.lpad(F.lower(h), DIGITS, "0")
    words = [F.conv(F.substring(padded, 16 * k + 1, 16), 16, -10).cast("bigint") for k in range(WORDS)]
    return F.when(is_hash(h), F.array(*words))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two word arrays."""
    return sum((F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(1, WORDS)), F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))


def hamming_hex(a: Column, b: Column) -> Column:
    return hamming(hash_words(a), hash_words(b))


def gradient_hash(grid: Column, rows: int = 16, columns: int = 16) -> Column:
    """dHash of a luma grid of rows x (columns + 1) values, row by row, as hexadecimal text.

    Bit row * columns + column is set if a value is greater than its right neighbour.
    """
    cell = lambda k: (k / columns).cast("int") * (columns + 1) + k % columns
    nibble = lambda d: sum(
        (F.when(F.get(grid, cell(d * 4 + j)) > F.get(grid, cell(d * 4 + j) + 1), 1 << j).otherwise(0) for j in range(1, 4)),
        F.when(F.get(grid, cell(d * 4)) > F.get(grid, cell(d * 4) + 1), 1).otherwise(0),
    )
    digits = F.transform(F.sequence(F.lit(rows * columns // 4 - 1), F.lit(0)), lambda d: F.lower(F.hex(nibble(d).cast("bigint"))))
    return F.array_join(digits, "")
