"""Ordered work over keys of any size: rows are cut into cells, ranges of key and order, and cells tell each other little.

A window by key alone gathers a hot key in one task. Here rows are dealt by ranges of (key, order), so a hot key spans
many cells, each a task's worth; what a cell must know of the ones before it (a count, a last value, the end of a span) is
one row for each key and cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import shared_folder

#: Rows that a cell may hold, about.
CELL_ROWS = 200_000


def celled(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], size: int = CELL_ROWS) -> DataFrame:
    """``rows`` with _cell, a number that grows along (keys, order); kept in the checkpoint folder, as cells come from sampled ranges.

    ``order`` should tell rows apart: equal ones share a cell. Where all rows are no more than a cell may hold, they are one.
    """
    spark = rows.sparkSession
    n = rows.count()
    if n <= size:
        return rows.withColumn("_cell", F.lit(0))
    shared_folder(spark)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-n // size))
    return rows.repartitionByRange(parts, *keys, *order).withColumn("_cell", F.spark_partition_id()).checkpoint()


def within(keys: Sequence[str], order: Sequence[Column | str]) -> Window:
    """The window over the rows of a key in one cell."""
    return Window.partitionBy(*keys, "_cell").orderBy(*order)


def across(keys: Sequence[str]) -> Window:
    """The window over the cells of a key before the current one; a row for each cell."""
    return Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)


def joined(rows: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with what is known of their key and cell; null keys match each other."""
    named = cells.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_cell").alias("_in"), *(c for c in cells.columns if c not in (*keys, "_cell")))
    same = F.col("_cell") == F.col("_in")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, same, "left").drop("_in", *(f"_k{i}" for i in range(len(keys))))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, size: int = CELL_ROWS) -> DataFrame:
    """``rows`` with their number (from 1) along ``order`` in their key."""
    held = celled(rows, keys, order, size)
    counts = held.groupBy(*keys, "_cell").agg(F.count("*").alias("_held"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_held").over(across(keys)), F.lit(0))).drop("_held")
    placed = joined(held.withColumn("_here", F.row_number().over(within(keys, order))), before, keys)
    return placed.withColumn(name, F.col("_before") + F.col("_here")).drop("_cell", "_here", "_before")


def exits(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For spans in order: the end that a greedy choice has reached behind the last span if it takes the span at each place.

    The next choice is the first later span that starts at or after the end of the one taken.
    """
    n = len(starts)
    after = np.maximum(np.searchsorted(starts, ends, side="left"), np.arange(1, n + 1)).tolist()
    out = ends.tolist()
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            out[i] = out[after[i]]
    return np.array(out, dtype=np.int64)


def greedy(spans: DataFrame, key: str, size: int = CELL_ROWS) -> DataFrame:
    """Per key, spans (start, end, span_id) in order of start, end and id, each kept if it starts at or after the end of the last kept one.

    A skipped span doesn't move the end, so a cell can't be folded before the end is known that the cells before it
    reach. Every cell first tells, for each span that it may begin with, what end it would reach (places with equal
    results are merged, and choices soon meet, so that is short); one pass over the cells of a key then carries the end
    from cell to cell; and each cell keeps its spans, from the end that it is given.
    """
    place = spans.select(F.col(key).alias("_key"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "span_id")
    held = celled(place.filter("start is not null and end is not null"), ["_key"], ["start", "end", "span_id"], size)
    id_type = spans.schema["span_id"].dataType.simpleString()
    key_type = spans.schema[key].dataType.simpleString()

    def sorted_rows(rows: pa.Table) -> pa.Table:
        return rows.sort_by([("start", "ascending"), ("end", "ascending"), ("span_id", "ascending")])

    def reach(rows: pa.Table) -> pa.Table:
        rows = sorted_rows(rows)
        starts = rows["start"].to_numpy()
        out = exits(starts, rows["end"].to_numpy())
        last = np.append(out[1:] != out[:-1], True)  # the last of the places with an equal result
        told = [rows["_key"].slice(0, 1), rows["_cell"].slice(0, 1), pa.array([starts[last].tolist()], pa.list_(pa.int64())), pa.array([out[last].tolist()], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(told, names=["_key", "_cell", "upto", "ends"])

    steps = held.groupBy("_key", "_cell").applyInArrow(reach, f"_key {key_type}, _cell int, upto array<long>, ends array<long>")
    own = "_key", "_cell"

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end = object(), 0
        for batch in batches:
            given = []
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                if name != now:
                    now, end = name, -(2**63)
                given.append(end)
                upto, ends = batch.column(2)[i].values.to_numpy(), batch.column(3)[i].values.to_numpy()
                at = int(np.searchsorted(upto, end, side="left"))
                end = int(ends[at]) if at < len(upto) else end
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(given, pa.int64())], names=["_key", "_cell", "_given"])

    # A row for each cell, those of a key in one task.
    chained = steps.repartition("_key").sortWithinPartitions(*own).mapInArrow(carry, f"_key {key_type}, _cell int, _given long")
    entered = joined(held, chained, ["_key"])

    def keep(rows: pa.Table) -> pa.Table:
        rows = sorted_rows(rows)
        starts, ends, end = rows["start"].to_numpy(), rows["end"].to_numpy(), rows["_given"][0].as_py()
        taken, at = [], int(np.searchsorted(starts, end, side="left"))
        while at < len(starts):
            taken.append(at)
            at = max(at + 1, int(np.searchsorted(starts, ends[at], side="left")))
        return rows.take(pa.array(taken, pa.int64())).select(["_key", "start", "end", "span_id"])

    kept = entered.groupBy(*own).applyInArrow(keep, f"_key {key_type}, start long, end long, span_id {id_type}")
    types = {f.name: f.dataType for f in spans.schema}
    return kept.select(F.col("_key").alias(key), F.col("start").cast(types["start"]).alias("start"), F.col("end").cast(types["end"]).alias("end"), "span_id")
