"""The pending set as state of a stream: versions out of order, timers, results that come too late, restarts, expiry."""

import uuid

from plumbline.session import shared_folder
from plumbline.streaming import pending

EVENTS = "path string, event string, version long, at timestamp_ntz"


class Feed:
    """A stream of files that is run, stopped and started again from one checkpoint."""

    def __init__(self, spark, **how):
        self.spark, self.how = spark, how
        self.base = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"

    def stream(self):
        return self.spark.readStream.schema(EVENTS).parquet(f"{self.base}/events")

    def append(self, events):
        import datetime

        start = datetime.datetime(2024, 1, 1)
        rows = [(p, e, v, start + datetime.timedelta(milliseconds=ms)) for p, e, v, ms in events]
        self.spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{self.base}/events")

    def tell(self, *events):
        """New outcomes after these events."""
        before = self.found()
        self.append(events)
        changes = pending.pending_changes(self.stream(), **self.how)
        writer = changes.writeStream.format("parquet").option("path", f"{self.base}/found").option("checkpointLocation", f"{self.base}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
        after = self.found()
        for row in before:
            after.remove(row)
        return sorted(after)

    def found(self):
        import os

        if not os.path.exists(f"{self.base}/found/_spark_metadata".removeprefix("file:")):
            return []
        rows = self.spark.read.schema(pending.OUTCOMES).parquet(f"{self.base}/found").collect()
        return [(r["path"], r["version"], r["op"], r["outcome"], r["at_ms"] - 1704067200000) for r in rows]


def test_versions_timers_and_results_over_restarts(spark):
    feed = Feed(spark, delay_ms=40)
    assert feed.tell(("a", "changed", 3, 0), ("a", "changed", 2, 10), ("b", "deleted", 1, 5), ("x", "unknown", 9, 10), (None, "changed", 1, 10)) == [("a", 2, "changed", "superseded", 10)]
    # Later events of another path let the waits of a and b end, by timers; they had no more events of their own.
    assert feed.tell(("c", "created", 1, 60)) == [("a", 3, "changed", "ready", 40), ("b", 1, "deleted", "ready", 45)]
    # A newer event starts the wait anew; the result for the old version is rejected, an old event stays superseded.
    assert feed.tell(("a", "changed", 5, 70), ("a", "done", 3, 80), ("a", "changed", 4, 90)) == [("a", 3, "done", "rejected", 80), ("a", 4, "changed", "superseded", 90)]
    assert feed.tell(("b", "done", 1, 100)) == [("b", 1, "done", "installed", 100), ("c", 1, "changed", "ready", 100)]
    # A result for the version that waits ends the wait; it is installed once.
    assert feed.tell(("a", "done", 5, 105), ("a", "done", 5, 106), ("z", "changed", 1, 300)) == [("a", 5, "done", "installed", 105), ("a", 5, "done", "rejected", 106)]


def test_the_cut_into_batches_makes_no_difference(spark):
    import random

    rng = random.Random(3)
    events = [(rng.choice("abcd"), rng.choice(["changed", "deleted", "done", "created"]), rng.randint(1, 30), 7 * i) for i in range(200)]
    whole, parts = Feed(spark, delay_ms=60), Feed(spark, delay_ms=60)
    want = whole.tell(*events)
    for at in (0, 50, 120):
        parts.tell(*events[at : {0: 50, 50: 120, 120: 200}[at]])
    assert sorted(parts.found()) == want and {o for *_, o, _ in want} == {"ready", "superseded", "installed", "rejected"}


def test_silent_paths_are_forgotten(spark):
    feed = Feed(spark, delay_ms=40, keep_ms=1000)
    feed.tell(("a", "changed", 9, 0), ("b", "changed", 9, 0))
    assert feed.tell(("b", "changed", 8, 500)) == [("a", 9, "changed", "ready", 40), ("b", 8, "changed", "superseded", 500), ("b", 9, "changed", "ready", 40)]
    feed.tell(("c", "changed", 1, 1200))
    # a was silent for a second, b was not.
    assert feed.tell(("a", "changed", 1, 1250), ("b", "changed", 1, 1250), ("c", "changed", 2, 2000)) == [
        ("a", 1, "changed", "ready", 1290), ("b", 1, "changed", "superseded", 1250), ("c", 1, "changed", "ready", 1240)
    ]


def test_refresh_gets_what_is_ready_and_what_comes_first(spark):
    feed = Feed(spark)
    feed.append([(f"p{i}", "changed", i, i) for i in range(20)] + [("gone", "deleted", 99, 3), ("end", "changed", 100, 5000)])
    seen = []
    pending.watch_pending(feed.stream(), lambda batch, number: seen.extend(map(tuple, batch.collect())), f"{feed.base}/checkpoint").awaitTermination()
    assert sorted(p for p, *_ in seen) == sorted([f"p{i}" for i in range(20)] + ["gone"])
    assert sorted(p for p, *_, first in seen if first) == sorted(f"p{i}" for i in range(16))
