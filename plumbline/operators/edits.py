"""Positions in texts that are edited: maps between old and new places, lines and columns, and the edited text itself.

A batch of edits replaces spans of a text that don't overlap. It moves places by a piecewise-linear map: a place behind an
edit moves by the sum of the length changes up to there, a place inside of one to the same distance from its start, at
most to its end. The sums are running totals over cells, and a place finds its edit by an as-of join, so neither a text of
many edits nor one of many places needs a row or a task of its own. Batches follow each other; each maps what the last one
gave. Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.cells import CELL_ROWS, across, celled, joined, within
from plumbline.operators.windows import last_before
from plumbline.session import shared_folder


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, name: str, size: int = CELL_ROWS) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their key that come before them."""
    held = celled(rows, keys, order, size)
    sums = held.groupBy(*keys, "_cell").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(across(keys)), F.lit(0))).drop("_sum")
    here = F.coalesce(F.sum(value).over(within(keys, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return joined(held.withColumn("_here", here), before, keys).withColumn(name, F.col("_before") + F.col("_here")).drop("_cell", "_here", "_before")


def segments(edits: DataFrame, key: str, size: int = CELL_ROWS) -> DataFrame:
    """``edits`` (key, start, end, length of the new text) as segments: start, end, and where both lie in the new text."""
    change = edits.select(key, "start", "end", "length", (F.col("length") - (F.col("end") - F.col("start"))).alias("_change"))
    placed = running_sum(change, [key], ["start", "end"], "_change", "_moved", size)
    new = F.col("start") + F.col("_moved")
    return placed.select(key, "start", "end", new.alias("new_start"), (new + F.col("length")).alias("new_end"))


def mapped(points: DataFrame, edits: DataFrame, key: str, at: str, back: bool = False, size: int = CELL_ROWS) -> DataFrame:
    """``points`` with their places moved by one batch of edits, or, ``back``, from the new text to the old one."""
    held = segments(edits, key, size)
    a, b, x, y = ("new_start", "new_end", "start", "end") if back else ("start", "end", "new_start", "new_end")
    named = held.select(F.col(key), (F.col(a) - 1).alias(at), F.col(a).alias("_turn"), F.col(b).alias("_b"), F.col(a).alias("_a"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    # The last edit that starts at or before a place; of edits that start together the later one.
    asked = points.withColumn("_turn", F.lit(None).cast("long"))
    seen = last_before(asked, named.withColumn("_turn", F.col("_b")), key, at, ["_a", "_b", "_x", "_y"], "_turn", size).drop("_turn")
    place = F.col(at)
    inside = F.col("last__x") + F.least(place - F.col("last__a"), F.col("last__y") - F.col("last__x"))
    moved = F.when(F.col("last__a").isNull(), place).when(place >= F.col("last__b"), F.col("last__y") + place - F.col("last__b")).otherwise(inside)
    return seen.withColumn(at, moved.cast(points.schema[at].dataType)).select(*points.columns)


def through(points: DataFrame, edits: DataFrame, key: str, at: str, back: bool = False, size: int = CELL_ROWS) -> DataFrame:
    """``points`` moved by all batches of ``edits`` (a column ``batch`` tells their order), each in the text that the last one left."""
    shared_folder(points.sparkSession)
    numbers = sorted(r[0] for r in edits.select("batch").distinct().collect())
    for n in reversed(numbers) if back else numbers:
        points = mapped(points, edits.filter(F.col("batch") == n).drop("batch"), key, at, back, size).checkpoint()
    return points


def edited(texts: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """``texts`` (key, text) with their edits (batch, start, end, new) made; a text's own edits meet in its row."""
    step = F.struct("batch", (-F.col("start")).alias("from"), (-F.col("end")).alias("to"), "new")
    own = edits.groupBy(key).agg(F.array_sort(F.collect_list(step)).alias("_steps"))

    def make(text: Column, s: Column) -> Column:
        start, end = -s["from"], -s["to"]
        return F.concat(F.substr(text, F.lit(1), start.cast("int")), s["new"], F.substr(text, (end + 1).cast("int"), F.length(text)))

    # The last edit of a batch first, so that offsets of the others still hold.
    whole = texts.join(own, key, "left")
    return whole.withColumn("text", F.when(F.col("_steps").isNull(), F.col("text")).otherwise(F.aggregate("_steps", F.col("text"), make))).select(*texts.columns)


def lines(texts: DataFrame, key: str) -> DataFrame:
    """key, line (from 0), start (its offset) and row (its text without the line break)."""
    split = F.split("text", "\n", -1)
    rows = texts.select(key, F.posexplode(split).alias("line", "row"))
    starts = texts.select(
        key,
        F.posexplode(
            F.aggregate(split, F.array(F.lit(0).cast("long")), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(s) + 1)))
        ).alias("line", "start"),
    )
    return rows.join(starts, [key, "line"]).select(key, "line", "start", F.regexp_replace("row", "\r$", "").alias("row"))


def byte_column(row: Column, column: Column) -> Column:
    """Bytes of UTF-8 before a column of code points."""
    return F.octet_length(F.substr(row, F.lit(1), column.cast("int")))


def utf16_column(row: Column, column: Column) -> Column:
    """Units of UTF-16 before a column of code points."""
    head = F.substr(row, F.lit(1), column.cast("int"))
    return F.length(head) + F.length(F.regexp_replace(head, "[^\\x{10000}-\\x{10FFFF}]", ""))


def positions(points: DataFrame, texts: DataFrame, key: str, at: str, size: int = CELL_ROWS) -> DataFrame:
    """``points`` (key, offset) with line, column, byte_column and utf16_column; a place behind the end is that of the end."""
    told = lines(texts, key).select(key, F.col("line").cast("long").alias("line"), (F.col("start") - 1).alias(at), F.col("start").alias("_start"), "row")
    asked = points.withColumn("line", F.lit(None).cast("long"))
    seen = last_before(asked, told, key, at, ["line", "_start", "row"], "line", size)
    column = F.least(F.col(at) - F.col("last__start"), F.length("last_row").cast("long"))
    return seen.withColumn("_column", column).select(
        *points.columns, F.col("last_line").alias("line"), F.col("_column").alias("column"),
        byte_column(F.col("last_row"), F.col("_column")).alias("byte_column"), utf16_column(F.col("last_row"), F.col("_column")).alias("utf16_column"),
    )


def offsets(places: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """``places`` (key, line, utf16_column) with their offsets; columns behind a line's end are its end."""
    told = lines(texts, key)
    # The longest head of the line that has no more units than the column.
    wide = lambda c: F.when(F.octet_length(c) == 4, 2).otherwise(1)
    units = F.aggregate(
        F.split("row", ""), F.struct(F.lit(0).alias("n"), F.lit(0).alias("u")),
        lambda acc, c: F.when(acc["u"] + wide(c) <= F.col("utf16_column"), F.struct((acc["n"] + 1).alias("n"), (acc["u"] + wide(c)).alias("u"))).otherwise(
            F.struct(acc["n"].alias("n"), F.lit(2**30).alias("u"))
        ),
    )["n"]
    return places.join(told, [key, "line"]).withColumn("offset", F.col("start") + F.when(F.col("row") == "", 0).otherwise(units)).select(*places.columns, "offset")
