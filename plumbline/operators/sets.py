"""Unions, differences and intersections of row sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.rows import best_per_key


def union_distinct(first: DataFrame, second: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of both, one per key."""
    return best_per_key(first.unionByName(second), keys, order)


def gone(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """Keys of ``before`` that ``after`` lacks."""
    return before.select(key).subtract(after.select(key))


def both(first: DataFrame, second: DataFrame, key: str = "path") -> DataFrame:
    return first.select(key).intersect(second.select(key))


def first_wins(sources: Sequence[DataFrame], label: str, prefix: str = "") -> DataFrame:
    """Union by source priority: of equal labels the first source's row. Labels with a leading _ need such a prefix."""
    tagged = [s.withColumn("_source", F.lit(n)) for n, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, tagged).filter(F.lower(label).startswith(prefix.lower()))
    if not prefix.startswith("_"):
        rows = rows.filter(~F.col(label).startswith("_"))
    return best_per_key(rows, [label], ["_source"]).drop("_source")
