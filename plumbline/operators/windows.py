"""Ordered operators: picks, runs, running budgets and ordered folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.cells import CELL_ROWS, across, celled, greedy, joined, numbered, within
from plumbline.operators.rows import best_per_key


def rank_and_pick(rows: DataFrame, keys: Sequence[str], module: str, best: Sequence[Column | str]) -> DataFrame:
    """Per key: an import from the hinted module, else a definition in it, else the best row."""
    hinted = F.col("module") == module
    imported = F.coalesce(F.col("import_from"), F.lit("")).startswith(module + "::")
    tier = F.when(imported, 0).when(hinted & F.col("import_from").isNull(), 1).otherwise(2)
    return best_per_key(rows, keys, [tier, *best])


def last_before(points: DataFrame, bindings: DataFrame, key: str, at: str, payload: Sequence[str], tie: str, size: int = CELL_ROWS) -> DataFrame:
    """As-of join: for each point the last binding of its key before it (by ``at``, then ``tie``), null if none.

    Both sides are merged and cut into cells along (key, at); a window in each cell carries the last binding forward, and
    cells begin with the last one of the cells before. No join of ranges, and no window over a whole key.
    """
    marked = F.struct(*payload)
    types = {f.name: f.dataType for f in points.schema}
    nothing = F.lit(None).cast(bindings.select(marked.alias("_seen")).schema["_seen"].dataType)
    left = points.select("*", F.lit(1).alias("_point"), nothing.alias("_seen"))
    shared = [F.col(c) if c in (key, at, tie) else F.lit(None).cast(types[c]).alias(c) for c in points.columns]
    right = bindings.select(*shared, F.lit(0).alias("_point"), marked.alias("_seen"))
    # Of rows at the same place the point comes first, so it sees only what lies before it.
    order = [F.col(at), F.desc("_point"), F.col(tie)]
    held = celled(left.unionByName(right), [key], order, size)
    ends = held.filter("_point = 0").groupBy(key, "_cell").agg(F.max(F.struct(at, tie, "_seen")).alias("_end"))
    # Every cell of a key, so that one without bindings passes on what came before.
    known = joined(held.select(key, "_cell").distinct(), ends, [key])
    before = known.withColumn("_before", F.last("_end", ignorenulls=True).over(across([key]))["_seen"]).drop("_end")
    here = F.last("_seen", ignorenulls=True).over(within([key], order).rowsBetween(Window.unboundedPreceding, 0))
    merged = joined(held.withColumn("_last", here).filter("_point = 1"), before, [key]).withColumn("_last", F.coalesce("_last", "_before"))
    return merged.select(*points.columns, *(F.col(f"_last.{p}").alias(f"last_{p}") for p in payload))


def visible_binding(bindings: DataFrame, keys: Sequence[str], line: Column, scope: Column) -> DataFrame:
    """Per key the binding that a place sees: deepest scope first, parameters before others, then the nearest line.

    A binding is seen if it stands at or before the line and its scope path is a prefix of the place's; a class scope
    is seen only from itself.
    """
    own = F.col("scope")
    seen = (F.col("line") <= line) & ((own == scope) | (scope.startswith(F.concat(own, F.lit("/"))) & (F.col("scope_kind") != "class")) | (own == ""))
    depth = F.size(F.split(own, "/"))
    return best_per_key(bindings.filter(seen), keys, [-depth, (F.col("is_parameter") == F.lit(False)).cast("int"), line - F.col("line"), "path"])


def greedy_spans(spans: DataFrame, key: str, size: int = CELL_ROWS) -> DataFrame:
    """Per key, spans in order of start, end and id, each kept if it starts at or after the end of the last kept one."""
    return greedy(spans, key, size).select(key, "start", "end", "span_id")


def runs(rows: DataFrame, keys: Sequence[str], line: str, size: int = CELL_ROWS) -> DataFrame:
    """Runs of consecutive lines per key: first, last and their number."""
    island = numbered(rows, keys, [line], "_n", size).withColumn("_run", F.col(line) - F.col("_n"))
    return island.groupBy(*keys, "_run").agg(F.min(line).alias("first_line"), F.max(line).alias("last_line"), F.count("*").alias("n_lines")).drop("_run")


def value_runs(rows: DataFrame, key: str, order: Sequence[str], value: str, size: int = CELL_ROWS) -> DataFrame:
    """Runs of equal values along an order: run number (from 1), value and length, per key."""
    held = celled(rows, [key], order, size)
    own = within([key], order)
    fresh = F.when(F.row_number().over(own) == 1, 0).when(F.col(value).eqNullSafe(F.lag(value).over(own)), 0).otherwise(1)
    marked = held.withColumn("_new", fresh)
    place = F.struct(*order, F.col(value).alias("_v"))
    ends = marked.groupBy(key, "_cell").agg(F.min(place).alias("_first"), F.max(place).alias("_last"), F.sum("_new").alias("_inside"))
    by_cell = Window.partitionBy(key).orderBy("_cell")
    opens = F.when(F.lag("_cell").over(by_cell).isNull() | ~F.col("_first._v").eqNullSafe(F.lag("_last._v").over(by_cell)), 1).otherwise(0)
    opened = ends.withColumn("_opens", opens)
    before = opened.withColumn("_before", F.coalesce(F.sum(F.col("_inside") + F.col("_opens")).over(across([key])), F.lit(0)) + F.col("_opens")).select(key, "_cell", "_before")
    told = joined(marked.withColumn("_here", F.sum("_new").over(own)), before, [key]).withColumn("run_no", F.col("_before") + F.col("_here"))
    return told.groupBy(key, "run_no", value).agg(F.count("*").alias("n_rows"))


def running_total(rows: DataFrame, bucket: Column, order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """``rows`` with the exact total of ``value`` over all rows before, in the order of bucket, then ``order``.

    Totals of whole buckets give offsets, so no task sorts more than one bucket; only one row per bucket meets in one
    task. ``bucket`` must grow with the order (a day, a range of keys).
    """
    placed = rows.withColumn("_bucket", bucket)
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_bucket").agg(F.sum(value).alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(sums.select("_bucket", "_start"), "_bucket")
    return joined.withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_bucket", "_start")


def newest(rows: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The newest ``n`` rows (they are protected from pruning)."""
    return rows.orderBy(*order).limit(n)


def last_load(loads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the row of the last load line."""
    return best_per_key(loads, keys, [-F.col("load_line"), "path"])
