"""XXH64 written out as DuckDB SQL, for the oracles of what is hashed by it.

Products of two 64-bit numbers fit UHUGEINT. A rotation by r is a product with 2^r modulo
2^64 - 1, which keeps every number but 2^64 - 1 itself.
"""

from __future__ import annotations

# The five primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SEED = 42
_ALL = 1 << 64


def _u(n: int) -> str:
    return f"{n}::UHUGEINT"


def _add(a: str, b: str) -> str:
    return f"(({a} + {b}) % {_u(_ALL)})"


def _mul(a: str, n: int) -> str:
    return f"({a} * {_u(n)} % {_u(_ALL)})"


def _rot(a: str, bits: int) -> str:
    return f"({a} * {_u(1 << bits)} % {_u(_ALL - 1)})"


def _xor(a: str, b: str) -> str:
    return f"xor({a}, {b})"


def _round(v: str, lane: str) -> str:
    return _mul(_rot(_add(v, _mul(lane, P2)), 31), P1)


def _number(at: str, size: int) -> str:
    """The little-endian number of the bytes from place `at` of the hex string x."""
    return "('0x' || " + " || ".join(f"substr(x, 2 * ({at} + {k}) + 1, 2)" for k in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


def mixed(name: str, source: str, keep: str) -> str:
    """CTEs up to `name`: the columns `keep` of the CTE source and h, its h mixed to the end."""
    steps, last = [], source
    for k, (shift, prime) in enumerate(((33, P2), (29, P3), (32, None))):
        own = name if prime is None else f"{name}_mix{k}"
        h = _xor("h", f"(h // {_u(1 << shift)})")
        steps.append(f"{own} AS (SELECT {keep}, {h if prime is None else _mul(h, prime)} AS h FROM {last})")
        last = own
    return ", ".join(steps)


def longs(name: str, source: str, keep: str, long: str, seed: str) -> str:
    """CTEs up to `name`: the columns `keep` and h, the hash of a 64-bit number with a seed, both columns of source."""
    start = _xor(_add(seed, _u(P5 + 8)), _round(_u(0), long))
    return f"{name}_raw AS (SELECT {keep}, {_add(_mul(_rot(start, 27), P1), _u(P4))} AS h FROM {source}), " + mixed(name, f"{name}_raw", keep)


def strings(name: str, source: str) -> str:
    """CTEs up to `name`: (s, h) of the strings s of the CTE source, which has no other columns."""
    first = [(SEED + P1 + P2) % _ALL, SEED + P2, SEED, (SEED - P1) % _ALL]
    lanes = [f"list_reduce(list_filter(lanes, lambda e, i: i <= n // 32 * 4 AND i % 4 = {(k + 1) % 4}), lambda a, e: {_round('a', 'e')}, {_u(v)})" for k, v in enumerate(first)]
    head = _add(_add(_rot("v1", 1), _rot("v2", 7)), _add(_rot("v3", 12), _rot("v4", 18)))
    for k in range(1, 5):
        head = _add(_mul(_xor(head, _round(_u(0), f"v{k}")), P1), _u(P4))
    eight = _add(_mul(_rot(_xor("a", _round(_u(0), "e")), 27), P1), _u(P4))
    four = _add(_mul(_rot(_xor("h", _mul(_number("n // 8 * 8", 4), P1)), 23), P2), _u(P3))
    one = _mul(_rot(_xor("a", _mul("e", P5)), 11), P1)
    return ", ".join([
        f"{name}_hex AS (SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM {source})",
        f"{name}_cut AS (SELECT s, x, n, list_transform(range(n // 8), lambda k: {_number('8 * k', 8)}) AS lanes, "
        f"list_transform(range(n // 4 * 4, n), lambda k: {_number('k', 1)}) AS tail FROM {name}_hex)",
        f"{name}_four AS (SELECT *, {', '.join(f'{e} AS v{k}' for k, e in enumerate(lanes, 1))} FROM {name}_cut)",
        f"{name}_head AS (SELECT s, x, n, lanes, tail, {_add(f'CASE WHEN n >= 32 THEN {head} ELSE {_u(SEED + P5)} END', 'n::UHUGEINT')} AS h FROM {name}_four)",
        f"{name}_body AS (SELECT s, x, n, tail, list_reduce(list_filter(lanes, lambda e, i: i > n // 32 * 4), lambda a, e: {eight}, h) AS h FROM {name}_head)",
        f"{name}_rest AS (SELECT s, tail, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM {name}_body)",
        f"{name}_last AS (SELECT s, list_reduce(tail, lambda a, e: {one}, h) AS h FROM {name}_rest)",
        mixed(name, f"{name}_last", "s"),
    ])
