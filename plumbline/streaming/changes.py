"""Keeping an index current: change events, snapshot differences, versions and generations.

The same functions serve a batch of events and, through ``foreachBatch``, a stream of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.rows import best_per_key

#: Client event types and what they mean for a path.
OPS = {"created": "changed", "changed": "changed", "deleted": "deleted"}
EVENTS = "path string, event string, version long"


def change_events(raw: DataFrame, keep: Sequence[str] = (), more: Mapping[str, str] | None = None) -> DataFrame:
    """path, op and version (and the columns ``keep``) of client events; event types unknown here and to ``more`` are dropped."""
    op = F.element_at(F.create_map(*(F.lit(x) for kv in (OPS | dict(more or {})).items() for x in kv)), F.lower("event"))
    return raw.select("path", op.alias("op"), "version", *keep).filter("op is not null and path is not null")


def latest(events: DataFrame) -> DataFrame:
    """The event of the highest version per path; of equal versions a deletion wins."""
    return best_per_key(events, ["path"], [-F.col("version"), (F.col("op") != "deleted").cast("int")])


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and op (insert, update, delete, unchanged) between two (path, fingerprint) tables."""
    b, a = before.withColumnRenamed("fingerprint", "_b"), after.withColumnRenamed("fingerprint", "_a")
    joined = b.withColumn("_in_b", F.lit(True)).join(a.withColumn("_in_a", F.lit(True)), "path", "full")
    op = (
        F.when(F.col("_in_b").isNull(), "insert")
        .when(F.col("_in_a").isNull(), "delete")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged")
        .otherwise("update")
    )
    return joined.select("path", op.alias("op"))


def clear_pending(pending: DataFrame, done: DataFrame) -> DataFrame:
    """Pending rows that a finished refresh doesn't cover: other paths, and newer versions than it has captured."""
    captured = done.select("path", F.col("version").alias("_done"))
    return pending.join(captured, "path", "left").filter(F.col("_done").isNull() | (F.col("version") > F.col("_done"))).drop("_done")


def current_only(results: DataFrame, generation: int) -> DataFrame:
    """Results of superseded generations are rejected."""
    return results.filter(F.col("generation") == generation)


def debounced(events: DataFrame, limit: int = 16) -> tuple[DataFrame, DataFrame]:
    """The newest event per path, and the first ``limit`` of the paths to parse now."""
    newest = latest(events)
    return newest, newest.filter("op = 'changed'").orderBy("version", "path").limit(limit)


def fail_open(pending_live: DataFrame, cached: DataFrame, may_contain) -> DataFrame:
    """Live rows of pending paths whatever their filters say, and cached rows whose filter may hold the name."""
    rest = cached.join(pending_live.select("path").distinct(), "path", "left_anti").filter(may_contain)
    return rest.select(*pending_live.columns).unionByName(pending_live)


def refresh_needed(events: DataFrame, namespace: str) -> DataFrame:
    """Events of modules in a namespace; derived tables need a refresh if there is any."""
    return events.filter((F.col("module") == namespace) | F.col("module").startswith(f"{namespace}."))


def drop_dirty(cached: DataFrame, dirty: DataFrame, key: str) -> DataFrame:
    """Cached answers whose key isn't among the dirty names."""
    return cached.join(dirty.select(F.lower("name").alias(key)).distinct(), key, "left_anti")


def watch(stream: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True, seconds: float = 0.04):
    """A streaming query that refreshes with the newest event per path of every micro-batch.

    Restarts go on from ``checkpoint``; a batch that is repeated must give the same store (upserts by path and version
    do), which makes the whole exactly-once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        refresh(latest(change_events(batch)), number)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{seconds} seconds")).start()


def apply_all(batches: Iterable[DataFrame], refresh: Callable[[DataFrame, int], None]) -> None:
    """Several batches of changes at once: only the newest event of each path is applied, and the store is written once."""
    held = None
    for b in batches:
        held = b if held is None else held.unionByName(b)
    if held is not None:
        refresh(latest(change_events(held)), 0)
