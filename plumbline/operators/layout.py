"""Layouts that lookups can skip: rows clustered by several columns at once, and keys whose prefixes are ranges.

Sorted by one column, files can be skipped by that column alone. Here each column's values are cut into ranges of about
equally many rows (split points come from a bounded sample; they shape the files, not the answers), and rows are sorted
by the bits of their range numbers, taken from the columns in turn. Rows of a file are then near each other by every
column, and the least and greatest values that Parquet keeps rule out most files for a lookup by any of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a sample that split points come from, at most.
SAMPLE = 20_000


def split_points(rows: DataFrame, columns: Sequence[str], bits: int) -> dict[str, list]:
    """For each column at most 2^bits - 1 values that cut its rows evenly, from a sample."""
    total = rows.count()
    drawn = rows.select(*columns).sample(min(1.0, SAMPLE / max(1, total)), 7).limit(2 * SAMPLE).collect() if total else []
    out = {}
    for i, c in enumerate(columns):
        held = sorted(r[i] for r in drawn if r[i] is not None)
        n = 1 << bits
        out[c] = sorted({held[len(held) * k // n] for k in range(1, n)}) if held else []
    return out


def range_number(column: str, points: Sequence) -> Column:
    """How many split points a value reaches; 0 for null."""
    if not points:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, points)), lambda p: p <= F.col(column))), F.lit(0))


def interleaved(numbers: Sequence[Column], bits: int) -> Column:
    """The bits of several numbers in turn, the most significant first."""
    parts = []
    for b in range(bits):
        for i, n in enumerate(numbers):
            place = b * len(numbers) + (len(numbers) - 1 - i)
            parts.append(F.shiftleft(F.shiftright(n.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), place))
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def clustered(rows: DataFrame, columns: Sequence[str], first: Sequence[str] = (), bits: int = 6, partitions: int | None = None) -> DataFrame:
    """``rows`` dealt to ranges of ``first`` and the clustering of ``columns``, and sorted so within them."""
    held = [c for c in columns if c in rows.columns]
    if not held:
        return rows.repartitionByRange(*first).sortWithinPartitions(*first) if first else rows
    points = split_points(rows, held, bits)
    z = rows.withColumn("_z", interleaved([range_number(c, points[c]) for c in held], bits))
    keys = [*first, "_z", *held]
    dealt = z.repartitionByRange(partitions, *keys) if partitions else z.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys).drop("_z")


def successor(prefix: str) -> str | None:
    """The least text that is greater than all texts with ``prefix``, by code points; None if there is none.

    Code points sort as their UTF-8 bytes do. Surrogates are no characters and are stepped over.
    """
    while prefix:
        n = ord(prefix[-1]) + 1
        n = 0xE000 if 0xD800 <= n <= 0xDFFF else n
        if n <= 0x10FFFF:
            return prefix[:-1] + chr(n)
        prefix = prefix[:-1]
    return None


def prefix_range(column: str, prefix: str) -> Column:
    """Whether a text begins with ``prefix``, as a half-open range that a scan can push down."""
    end = successor(prefix)
    low = F.col(column) >= prefix
    return low if end is None else low & (F.col(column) < end)
