"""The set of paths that wait for a refresh, as state of a stream: versions, debounce, results that come too late.

A stream of (path, event, version, at) holds what clients tell of their files and, as event ``done``, what refreshes report
with the version that they had read. For every path the state holds the highest version, whether its refresh is due, and
when. Events of a lower version are ``superseded``. A change waits for ``delay``; if none newer comes, its path is
``ready``, by a timer if no further event of the path comes at all. A result is ``installed`` if its version is still the
highest, else ``rejected``; what is installed waits no longer. Paths that are silent for ``keep`` are forgotten, so the
state is as large as the paths of that time.

Time is that of the events. Within a batch the events of a path are taken by time, then version, and a wait that ends
before the next event ends first: the outcome is the same however a stream that comes in order is cut into batches, and a
restart goes on from its checkpoint. Events of unknown kinds or without path, version or time are dropped, as are those
that come more than ``late`` behind the latest one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.streaming.changes import change_events, debounced

OUTCOMES = "path string, version long, op string, outcome string, at_ms long"
STATE = "newest long, installed boolean, op string, due long, last long"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Waiting:
    """What is known of a path; ``due`` is None if nothing waits."""

    newest: int = -1
    installed: bool = False
    op: str | None = None
    due: int | None = None
    last: int | None = None

    def end_wait(self, now: int) -> list[tuple]:
        if self.due is None or self.due > now:
            return []
        out = [(self.newest, self.op, "ready", self.due)]
        self.due = None
        return out

    def take(self, version: int, op: str, at: int, delay: int) -> list[tuple]:
        """The outcomes of one event, and of a wait that ends before it."""
        out = self.end_wait(at)
        self.last = at
        if op == "done":
            current = version == self.newest and not self.installed
            if current:
                self.installed, self.due = True, None
            return [*out, (version, op, "installed" if current else "rejected", at)]
        if version <= self.newest:
            return [*out, (version, op, "superseded", at)]
        self.newest, self.installed, self.op, self.due = version, False, op, at + delay
        return out


class Pending(StatefulProcessor):
    def __init__(self, delay: int, keep: int) -> None:
        self.delay, self.keep = delay, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("waiting", STATE)

    def held(self) -> Waiting:
        return Waiting(*self.state.get()) if self.state.exists() else Waiting()

    def save(self, held: Waiting) -> None:
        """The state, and one timer for what comes next: the end of the wait, or that the path is forgotten."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update(astuple(held))
        self.handle.registerTimer(min(held.due if held.due is not None else 2**62, held.last + self.keep))

    def rows(self, path: str, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            frame = pd.DataFrame([(path, *o) for o in out], columns=["path", "version", "op", "outcome", "at_ms"])
            yield frame.astype({"version": "int64", "at_ms": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = sorted(e for frame in rows for e in zip(frame["at_ms"].tolist(), frame["version"].tolist(), frame["op"].tolist()))
        held, out = self.held(), []
        for at, version, op in events:
            if held.last is not None and at >= held.last + self.keep:
                out += held.end_wait(at)
                held = Waiting()
            out += held.take(version, op, at, self.delay)
        self.save(held)
        yield from self.rows(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = expiredTimerInfo.getExpiryTimeInMs(), self.held()
        out = held.end_wait(now)
        if held.last is None or held.last + self.keep <= now:
            self.state.clear()
        else:
            self.save(held)
        yield from self.rows(key[0], out)

    def close(self) -> None:
        pass


def pending_changes(events: DataFrame, delay_ms: int = 40, keep_ms: int = 86_400_000, late: str = "0 seconds") -> DataFrame:
    """path, version, op, outcome and at_ms of a stream of (path, event, version, at); see the module.

    Keeps its state in RocksDB, which timers need; the setting is made for the session.
    """
    spark = events.sparkSession
    spark.conf.set(STORE, ROCKS)
    at = events.withColumn("at", F.col("at").cast("timestamp")).filter("at is not null and version is not null")
    told = change_events(at, keep=["at"], more={"done": "done"})
    timed = told.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    processor = Pending(delay_ms, max(keep_ms, delay_ms + 1))
    return timed.groupBy("path").transformWithStateInPandas(processor, OUTCOMES, "Append", "EventTime")


def watch_pending(
    events: DataFrame, refresh: Callable[[DataFrame, int], None], checkpoint: str, delay_ms: int = 40, keep_ms: int = 86_400_000, late: str = "0 seconds", limit: int = 16
):
    """A streaming query that hands ``refresh`` what has become ready in each batch: all paths, at most ``limit`` of them to parse first.

    ``refresh`` gets (path, op, version, first), and must give the same store for a batch that is repeated.
    """

    def apply(batch: DataFrame, number: int) -> None:
        ready = batch.filter("outcome = 'ready'").select("path", "op", "version")
        newest, first = debounced(ready, limit)
        if not newest.isEmpty():
            marked = first.select("path", F.lit(True).alias("first"))
            refresh(newest.join(marked, "path", "left").withColumn("first", F.coalesce("first", F.lit(False))), number)

    changes = pending_changes(events, delay_ms, keep_ms, late)
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
