"""Ordered operators over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import windows
from plumbline.plans.registry import query
from plumbline.sources.tables import table


@query(
    "latest_version_wins",
    """
    SELECT user_id AS path, event_id AS version, event_type AS op FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'view'
    """,
)
def latest_version_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.streaming.changes import latest

    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("op"), F.col("event_id").alias("version"))
    return latest(events).filter("op <> 'view'").select("path", "version", "op")


@query(
    "comment_runs",
    """
    WITH m AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run_no FROM m)
    SELECT user_id, run_no::BIGINT AS run_no, event_type, count(*) AS n_rows FROM r GROUP BY ALL
    """,
)
def comment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.value_runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "run_no", "event_type", "n_rows")


@query(
    "line_runs",
    """
    SELECT l_suppkey AS path, min(k) AS first_line, max(k) AS last_line, count(*) AS n_lines FROM (
      SELECT l_suppkey, k, k - row_number() OVER (PARTITION BY l_suppkey ORDER BY k) AS g
      FROM (SELECT DISTINCT l_suppkey, l_partkey % 200 AS k FROM lineitem)) GROUP BY l_suppkey, g
    """,
)
def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), (F.col("l_partkey") % 200).alias("line")).distinct()
    return windows.runs(lines, ["path"], "line").select("path", "first_line", "last_line", "n_lines")


@query(
    "nonoverlap_greedy",
    """
    WITH RECURSIVE s AS (SELECT user_id AS k, event_id, epoch(ts)::BIGINT AS a, epoch(ts)::BIGINT + (event_id % 5 + 1) * 20000 AS b,
        row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT, epoch(ts)::BIGINT + (event_id % 5 + 1) * 20000, event_id) AS n FROM events),
    f AS (SELECT k, event_id, n, b AS last, true AS kept FROM s WHERE n = 1
      UNION ALL SELECT s.k, s.event_id, s.n, CASE WHEN s.a >= f.last THEN s.b ELSE f.last END, s.a >= f.last FROM f JOIN s ON s.k = f.k AND s.n = f.n + 1)
    SELECT k AS user_id, event_id FROM f WHERE kept
    """,
)
def nonoverlap_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rounded as the SQL's cast from seconds does, halves to even.
    start = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    spans = table(spark, sf_dir, "events").select(
        "user_id", start.alias("start"), (start + (F.col("event_id") % 5 + 1) * 20000).alias("end"), F.col("event_id").alias("span_id")
    )
    return windows.greedy_spans(spans, "user_id").select("user_id", F.col("span_id").alias("event_id"))


RETENTION = """
    WITH e AS (SELECT o_orderkey AS entry, o_orderdate AS t, o_totalprice::DECIMAL(18, 2) AS size, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS newest FROM orders),
    o AS (SELECT *, CASE WHEN newest <= 10 THEN 'protected' WHEN t < TIMESTAMP '1996-01-01' THEN 'old' END AS first_reason FROM e),
    k AS (SELECT *, sum(size) OVER () AS total FROM o WHERE first_reason IS DISTINCT FROM 'old'),
    r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY t, entry DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM k WHERE first_reason IS NULL)
    SELECT entry, 'old' AS decision FROM o WHERE first_reason = 'old'
    UNION ALL SELECT entry, 'protected' FROM o WHERE first_reason = 'protected'
    UNION ALL SELECT entry, CASE WHEN total - freed > 2000000000 THEN 'budget' ELSE 'kept' END FROM r
"""


@query("retention_budget", RETENTION)
def retention_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.sources.store import retention

    entries = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("entry"), F.col("o_orderdate").alias("modified"), F.col("o_totalprice").cast("decimal(18,2)").alias("size")
    )
    return retention(entries, protect=10, oldest="1996-01-01", budget=2_000_000_000)


@query(
    "last_binding_before",
    """
    SELECT event_id, user_id, lag(event_id) OVER w AS last_event_id, lag(event_type) OVER w AS last_event_type
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS n FROM events) WHERE n = 1
    WINDOW w AS (PARTITION BY user_id ORDER BY ts)
    """,
)
def last_binding_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    from plumbline.operators.rows import best_per_key

    once = best_per_key(events, ["user_id", "ts"], ["event_id"])
    points = once.select("user_id", "ts", "event_id")
    return windows.last_before(points, once, "user_id", "ts", ["event_id", "event_type"], "event_id").drop("ts")


@query(
    "rank_and_pick",
    """
    SELECT part_key, order_key FROM (SELECT l_partkey AS part_key, l_orderkey AS order_key, row_number() OVER (PARTITION BY l_partkey ORDER BY
      CASE WHEN l_shipmode = 1 THEN 0 WHEN l_shipmode = 2 THEN 1 ELSE 2 END, l_orderkey, l_linenumber) AS n
      FROM (SELECT *, l_suppkey % 4 AS l_shipmode FROM lineitem)) WHERE n = 1
    """,
)
def rank_and_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.col("l_suppkey") % 4
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part_key"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
        F.when(mode == 2, "hint").otherwise("other").alias("module"), F.when(mode == 1, "hint::x").alias("import_from"),
    )
    return windows.rank_and_pick(rows, ["part_key"], "hint", ["order_key", "line"]).select("part_key", "order_key")


@query("newest_entries", "SELECT o_orderkey AS entry FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def newest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.newest(table(spark, sf_dir, "orders"), 25, [F.desc("o_orderdate"), F.asc("o_orderkey")]).select(F.col("o_orderkey").alias("entry"))


@query(
    "last_load_wins",
    "SELECT l_partkey AS name, max(l_orderkey) AS load_line FROM lineitem GROUP BY 1",
)
def last_load_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("load_line"), F.col("l_linenumber").alias("path"))
    return windows.last_load(loads, ["name"]).select("name", "load_line")
