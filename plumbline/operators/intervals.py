"""Which intervals hold a point, without nested loops, windows or a cell width to choose.

The line of whole numbers is a tree: a node of level l holds 8^l neighbouring numbers. An interval is the union of a few
nodes on each level (at most 14), and a point lies in one node of each, so "holds" is an equi-join on key and node. Where
only the best interval is wanted, the intervals of a node are aggregated to one row before they meet any point, so no key
can gather more than its nodes. A key of few intervals needs no tree: they are one array, which its points look through,
so that neither side is repeated for nodes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import shared_folder

#: Bits of a number that a level of the tree takes.
BITS = 3
#: Intervals of a key that its points look through one by one; a key of more has a tree.
FEW = 32


def _right(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits.cast("int"))


def _range(a: Column, b: Column) -> Column:
    """From ``a`` up to and without ``b``."""
    return F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))


def nodes_at(at: Column, levels: int) -> Column:
    """The nodes (level, node) that hold the point."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda n: F.struct(n.alias("_level"), _right(at.cast("long"), n * BITS).alias("_node")))


def nodes_of(start: Column, end: Column, levels: int) -> Column:
    """The fewest nodes up to level ``levels`` whose union is the interval from ``start`` to ``end``, both included."""

    def low(n: Column) -> Column:
        return _right(start.cast("long") + F.call_function("shiftleft", F.lit(1).cast("long"), (n * BITS).cast("int")) - 1, n * BITS)

    def high(n: Column) -> Column:
        return _right(end.cast("long") + 1, n * BITS)

    def own(n: Column) -> Column:
        up, wide = n + 1, 1 << BITS
        sides = F.concat(_range(low(n), low(up) * wide), _range(high(up) * wide, high(n)))
        nodes = F.when((n < levels) & (low(up) < high(up)), sides).otherwise(_range(low(n), high(n)))
        return F.transform(nodes, lambda x: F.struct(n.alias("_level"), x.alias("_node")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), own))


def levels_of(intervals: DataFrame, start: str, end: str) -> int:
    """The highest level that the longest interval needs."""
    longest = intervals.agg(F.max(F.col(end).cast("long") - F.col(start).cast("long") + 1)).first()[0] or 1
    return max(0, (int(longest).bit_length() - 1) // BITS)


def all_holding(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str = "start", end: str = "end") -> DataFrame:
    """A row for each point and each interval of its keys that holds it."""
    levels = levels_of(intervals, start, end)
    dealt = intervals.filter(F.col(start) <= F.col(end)).select("*", F.inline(nodes_of(F.col(start), F.col(end), levels)))
    placed = points.select("*", F.inline(nodes_at(F.col(at), levels)))
    return placed.join(dealt, [*keys, "_level", "_node"]).drop("_level", "_node")


def best_holding(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, best: Mapping[str, Column], start: str = "start", end: str = "end", few: int = FEW
) -> DataFrame:
    """``points`` with, for each name in ``best``, the least value of that column among the intervals that hold them.

    A value is null if no interval of the point's keys holds it (or all values are null). ``intervals`` is read several
    times, so it should be no long way from a table.
    """
    shared_folder(points.sparkSession)
    some = intervals.filter(F.col(start) <= F.col(end)).select(*keys, F.col(start).alias("_start"), F.col(end).alias("_end"), *(c.alias(n) for n, c in best.items()))
    many = some.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > few).select(*keys).checkpoint()
    trees = not many.isEmpty()
    listed = (some.join(many, list(keys), "left_anti") if trees else some).groupBy(*keys).agg(F.collect_list(F.struct("_start", "_end", *best)).alias("_held"))
    place = F.col(at)
    holding = F.filter("_held", lambda x: (x["_start"] <= place) & (place <= x["_end"]))
    shown = points.join(listed, list(keys), "left").withColumn("_held", holding)
    told = {n: F.array_min(F.col("_held")[n]) for n in best}
    if not trees:
        return shown.select(*points.columns, *(c.alias(n) for n, c in told.items()))
    large = some.join(many, list(keys), "left_semi")
    levels = levels_of(large, "_start", "_end")
    dealt = large.select(*keys, *best, F.inline(nodes_of(F.col("_start"), F.col("_end"), levels)))
    nodes = dealt.groupBy(*keys, "_level", "_node").agg(*(F.min(n).alias(n) for n in best))
    asked = points.select(*keys, at).join(many, list(keys), "left_semi").distinct().select("*", F.inline(nodes_at(F.col(at), levels)))
    found = asked.join(nodes, [*keys, "_level", "_node"]).groupBy(*keys, at).agg(*(F.min(n).alias(f"_tree_{n}") for n in best))
    return shown.join(found, [*keys, at], "left").select(*points.columns, *(F.coalesce(c, F.col(f"_tree_{n}")).alias(n) for n, c in told.items()))
