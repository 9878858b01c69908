"""CRC-32 written out as DuckDB SQL, for the oracles of what is chosen by it."""

from __future__ import annotations

# Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
_ALL = 0xFFFFFFFF


def _of_byte(n: int) -> int:
    for _ in range(8):
        n = n >> 1 ^ (POLYNOMIAL if n & 1 else 0)
    return n


def crc32(x: str) -> str:
    """The CRC-32 of a string's UTF-8 bytes, as a BIGINT."""
    table = ", ".join(str(_of_byte(n)) for n in range(256))
    data = f"list_transform(range(octet_length(encode({x}))), lambda k: ('0x' || substr(hex(encode({x})), 2 * k + 1, 2))::BIGINT)"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, list_extract([{table}], (xor(c, b) & 255) + 1)), {_ALL}::BIGINT), {_ALL}::BIGINT)"
