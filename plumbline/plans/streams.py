"""Streams over the events table, run until all of it is read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.plans.registry import query
from plumbline.session import shared_folder
from plumbline.sources.tables import table
from plumbline.streaming.pending import pending_changes

#: Six hours without a newer event end a wait.
DELAY_MS = 6 * 3_600_000


def told_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, event, version and at: users as paths. Some versions are old, and purchases report a version of the path before them."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    event: Column = F.when(kind == "signup", "created").when(kind == "error", "deleted").when(kind == "purchase", "done").when(kind == "view", "looked").otherwise("changed")
    old = F.when(F.col("event_id") % 5 == 0, F.col("event_id") - 60).otherwise(F.col("event_id"))
    before = F.coalesce(F.last(F.when(kind.isin("signup", "error", "click"), old), ignorenulls=True).over(own), F.lit(-7).cast("long"))
    version = F.when(kind == "purchase", before - F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).otherwise(old)
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), event.alias("event"), version.alias("version"), F.col("ts").alias("at"))


@query(
    "pending_paths",
    f"""
    WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 5 = 0 THEN event_id - 60 ELSE event_id END AS old FROM events),
    v AS (SELECT *, last_value(CASE WHEN event_type IN ('signup', 'error', 'click') THEN old END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seen FROM e),
    t AS (SELECT user_id AS path, event_id AS id, ms, event_type = 'purchase' AS done, CASE event_type WHEN 'error' THEN 'deleted' WHEN 'purchase' THEN 'done' ELSE 'changed' END AS op,
      CASE WHEN event_type = 'purchase' THEN coalesce(seen, -7) - CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END ELSE old END AS version FROM v WHERE event_type <> 'view'),
    h AS (SELECT *, greatest(-1, coalesce(max(CASE WHEN NOT done THEN version END) OVER (PARTITION BY path ORDER BY ms, version, op ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)) AS newest FROM t),
    d AS (SELECT *, row_number() OVER (PARTITION BY path, version ORDER BY ms) = 1 AS first FROM h WHERE done AND version = newest),
    a AS (SELECT *, lead(ms) OVER (PARTITION BY path ORDER BY ms, version) AS next_ms FROM h WHERE NOT done AND version > newest),
    r AS (SELECT a.path, a.version, a.op, a.ms + {DELAY_MS} AS due FROM a LEFT JOIN d ON d.first AND d.path = a.path AND d.version = a.version
      WHERE coalesce(a.next_ms, 1e18) >= a.ms + {DELAY_MS} AND coalesce(d.ms, 1e18) >= a.ms + {DELAY_MS} AND a.ms + {DELAY_MS} <= (SELECT max(ms) FROM t))
    SELECT path::VARCHAR AS path, version, op, 'ready' AS outcome, due AS at_ms FROM r
    UNION ALL SELECT path::VARCHAR, version, op, 'superseded', ms FROM h WHERE NOT done AND version <= newest
    UNION ALL SELECT path::VARCHAR, version, op, 'installed', ms FROM d WHERE first
    UNION ALL SELECT path::VARCHAR, version, op, 'rejected', ms FROM h WHERE done AND id NOT IN (SELECT id FROM d WHERE first)
    """,
)
def pending_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of the table as a stream that is stopped halfway and started again, and what becomes of every path."""
    base = f"{shared_folder(spark)}/pending-{uuid.uuid4().hex}"
    told = told_events(spark, sf_dir).withColumn("at", F.col("at").cast("timestamp"))
    middle = told.agg(F.percentile_approx("at", 0.5)).first()[0]
    for half in (F.col("at") <= middle, F.col("at") > middle):
        told.filter(half).write.mode("append").parquet(f"{base}/events")
        found = pending_changes(spark.readStream.schema(told.schema).parquet(f"{base}/events"), DELAY_MS, keep_ms=366 * 86_400_000)
        run = found.writeStream.format("parquet").option("path", f"{base}/found").option("checkpointLocation", f"{base}/checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{base}/found")
