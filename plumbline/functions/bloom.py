"""A Bloom filter of a file's identifiers: 65,536 bits, six probes, no false negatives.

Built where a file is parsed. A probe is a literal's six bit positions, so the test is a JVM expression. A filter of
another length answers "maybe": a store that was cut short must not hide a file. Filters hold names of ASCII letters
only; for any other name the answer is always "maybe".
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES, PROBES = 8192, 6
#: FNV-1a for 64 and 32 bits.
FNV64, PRIME64 = 0xCBF29CE484222325, 0x100000001B3
FNV32, PRIME32 = 0x811C9DC5, 0x01000193


def fnv64(data: bytes) -> int:
    h = FNV64
    for b in data:
        h = (h ^ b) * PRIME64 & 0xFFFFFFFFFFFFFFFF
    return h


def fnv32(data: bytes) -> int:
    h = FNV32
    for b in data:
        h = (h ^ b) * PRIME32 & 0xFFFFFFFF
    return h


def bits(name: str) -> list[int]:
    """Double hashing with a square term: the halves of one digest give start and step."""
    h = fnv64(name.encode())
    start, step = h & 0xFFFFFFFF, h >> 32 | 1
    return [(start + i * step + i * i) % (BYTES * 8) for i in range(PROBES)]


def built(names: Iterable[str]) -> bytes:
    out = bytearray(BYTES)
    for name in set(names):
        for bit in bits(name):
            out[bit >> 3] |= 1 << (bit & 7)
    return bytes(out)


def may_contain(held: bytes, name: str) -> bool:
    return len(held) != BYTES or not name.isascii() or all(held[b >> 3] >> (b & 7) & 1 for b in bits(name))


def may_contain_expr(held: Column, name: str) -> Column:
    """The same test inside the JVM."""
    if not name.isascii():
        return F.lit(True)
    hit = F.lit(True)
    for b in bits(name):
        byte = F.conv(F.hex(F.substring(held, (b >> 3) + 1, 1)), 16, 10).cast("int")
        hit = hit & (F.shiftright(byte, b & 7).bitwiseAND(F.lit(1)) == 1)
    return held.isNull() | (F.length(held) != BYTES) | hit
