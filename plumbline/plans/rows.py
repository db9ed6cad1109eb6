"""Counts, best rows, distinct rows and set operations over the order, event and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import ascii_tokens
from plumbline.operators import rows, sets
from plumbline.plans.registry import query
from plumbline.sources.tables import table


@query(
    "kind_count_coalesced",
    "SELECT coalesce(nullif(o_orderpriority, '3-MEDIUM'), 'unknown') AS origin, count(*) AS n FROM orders GROUP BY 1",
)
def kind_count_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("origin", F.nullif("o_orderpriority", F.lit("3-MEDIUM")))
    return rows.coalesced_counts(orders, "origin")


@query(
    "origin_totals",
    """
    SELECT count(*) AS total, sum(CASE WHEN o_orderstatus IN ('O', 'P') THEN 1 ELSE 0 END)::BIGINT AS source,
      sum(CASE WHEN o_orderstatus IN ('O', 'P') THEN 0 ELSE 1 END)::BIGINT AS static FROM orders
    """,
)
def origin_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.origin_totals(table(spark, sf_dir, "orders"), "o_orderstatus", ("O", "P"))


@query(
    "best_per_key",
    """
    SELECT part_key, order_key, line_number, quantity FROM (
      SELECT l_partkey AS part_key, l_orderkey AS order_key, l_linenumber AS line_number, l_quantity AS quantity,
        row_number() OVER (PARTITION BY l_partkey ORDER BY
          CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_quantity DESC, l_orderkey, l_linenumber) AS n
      FROM lineitem) WHERE n = 1
    """,
)
def best_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part_key"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"),
        F.col("l_quantity").alias("quantity"), "l_returnflag",
    )
    flag = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return rows.best_per_key(lines, ["part_key"], [flag, -F.col("quantity"), "order_key", "line_number"]).drop("l_returnflag")


@query(
    "dedupe_records",
    """
    SELECT l_partkey AS part_key, l_suppkey AS supp_key, l_returnflag AS flag, min(l_orderkey) AS first_order
    FROM lineitem GROUP BY 1, 2, 3
    """,
)
def dedupe_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"), F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("first_order")
    )
    return rows.distinct_records(lines, ["part_key", "supp_key", "flag"], ["first_order"])


@query(
    "inverted_index_df",
    """
    SELECT token, count(*) AS n_docs FROM (
      SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\b[A-Za-z_][A-Za-z0-9_]*')) AS token FROM documents)
    GROUP BY token
    """,
)
def inverted_index_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(ascii_tokens(F.col("text"))).alias("token"))
    return rows.inverted_index(tokens, "token", "doc_id")


@query(
    "token_occurrences",
    """
    SELECT doc_id, len(regexp_extract_all(text, '\\bthe\\b')) AS n_hits FROM documents
    WHERE regexp_matches(text, '\\bthe\\b')
    """,
)
def token_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.regexp_count("text", F.lit(r"(?<![A-Za-z0-9_])the(?![A-Za-z0-9_])")).cast("long")
    return table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("the"))).select("doc_id", hits.alias("n_hits")).filter("n_hits > 0")


@query("count_by_path", "SELECT l_orderkey AS path, count(*) AS n FROM lineitem GROUP BY 1")
def count_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.count_by(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path")), "path")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files below nations below regions."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    joined = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
    return joined.select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"))


PLACES = """
    SELECT r_name || '/' || n_name || '/' || c_name AS path FROM customer
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


@query(
    "root_counts",
    f"""
    WITH files AS ({PLACES}), roots AS (
      SELECT r_name AS root FROM region UNION SELECT r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
      UNION SELECT 'nowhere')
    SELECT root, count(path) AS n FROM roots LEFT JOIN files ON path = root OR starts_with(path, root || '/') GROUP BY root
    """,
)
def root_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    inner = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.concat_ws("/", "r_name", "n_name").alias("root"))
    roots = region.select(F.col("r_name").alias("root")).unionByName(inner).unionByName(spark.createDataFrame([("nowhere",)], "root string"))
    return rows.count_by_root(_places(spark, sf_dir), roots)


@query(
    "overlapping_roots",
    """
    WITH roots AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[/?#]*$', '') AS root FROM pages)
    SELECT root FROM roots r WHERE NOT EXISTS (
      SELECT 1 FROM roots o WHERE o.root <> r.root AND starts_with(r.root, o.root || '/'))
    """,
)
def overlapping_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[/?#]*$", "")
    return rows.outermost_roots(table(spark, sf_dir, "pages").select(root.alias("root")))


@query(
    "counter_delta",
    """
    WITH counters AS (SELECT c_custkey AS key, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1),
    changes AS (SELECT user_id AS key, sum(CASE WHEN event_type = 'click' THEN 1 ELSE -1 END) AS delta FROM events GROUP BY 1)
    SELECT c.key, greatest(n + coalesce(delta, 0), 0)::BIGINT AS n FROM counters c LEFT JOIN changes d ON c.key = d.key
    """,
)
def counter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("m"))
    counters = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).join(orders, "key", "left").select("key", F.coalesce("m", F.lit(0)).cast("long").alias("n"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_type")
    return rows.apply_deltas(counters, rows.deltas(events.filter("event_type = 'click'"), events.filter("event_type <> 'click'"), "key"), "key")


@query(
    "merged_counters",
    """
    WITH stored AS (SELECT o_custkey AS root, count(*) AS s FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
    scanned AS (SELECT o_custkey AS root, count(*) AS c FROM orders GROUP BY 1)
    SELECT coalesce(stored.root, scanned.root) AS root, coalesce(s, c) AS n, s IS NOT DISTINCT FROM c AS agree
    FROM stored FULL JOIN scanned ON stored.root = scanned.root
    """,
)
def merged_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "root")
    return rows.merged_counts(rows.count_by(orders.filter("o_orderstatus = 'O'"), "root"), rows.count_by(orders, "root"))


@query(
    "grouped_call_ranges",
    """
    SELECT callee, (n - 1) // 1000 AS piece, any_value(total) AS n_calls, string_agg(place, ',' ORDER BY n) AS ranges FROM (
      SELECT l_partkey AS callee, l_orderkey || ':' || l_linenumber AS place, count(*) OVER (PARTITION BY l_partkey) AS total,
        row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) GROUP BY 1, 2
    """,
)
def grouped_call_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "callee")
    grouped = rows.call_groups(calls, ["callee"], "l_orderkey", "l_linenumber")
    shown = F.transform("ranges", lambda r: F.concat_ws(":", r["line"].cast("string"), r["column"].cast("string")))
    return grouped.select("callee", "piece", "n_calls", F.array_join(shown, ",").alias("ranges"))


@query(
    "call_pieces_of_flags",
    """
    SELECT callee, (n - 1) // 500 AS piece, any_value(total) AS n_calls, count(*) AS n_ranges, min(l_orderkey) AS first_line, max(l_orderkey) AS last_line FROM (
      SELECT l_returnflag AS callee, l_orderkey, count(*) OVER (PARTITION BY l_returnflag) AS total,
        row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) GROUP BY 1, 2
    """,
)
def call_pieces_of_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three identities that hold all rows: their places come in pieces of 500."""
    calls = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "callee")
    grouped = rows.call_groups(calls, ["callee"], "l_orderkey", "l_linenumber", size=500)
    ends = F.transform("ranges", lambda r: r["line"])
    return grouped.select("callee", "piece", "n_calls", F.size("ranges").cast("long").alias("n_ranges"), F.array_min(ends).alias("first_line"), F.array_max(ends).alias("last_line"))


@query(
    "dual_key_postings",
    """
    SELECT key, count(*) AS n, min(r) AS first_row FROM (
      SELECT lower(n_name) AS key, n_nationkey AS r FROM nation UNION SELECT lower(r_name), n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey)
    GROUP BY key
    """,
)
def dual_key_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    both = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    grouped = rows.postings(both, [F.col("n_name"), F.col("r_name")], ["n_nationkey"])
    return grouped.select("key", F.size("rows").cast("long").alias("n"), F.get("rows", F.lit(0))["n_nationkey"].alias("first_row"))


@query(
    "dual_key_best",
    """
    SELECT key, list(r ORDER BY r) AS best FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY r) AS n FROM (
      SELECT lower(p_name) AS key, p_partkey AS r FROM part UNION SELECT lower(p_brand), p_partkey FROM part UNION SELECT lower(p_type), p_partkey FROM part))
    WHERE n <= 7 GROUP BY key
    """,
)
def dual_key_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven parts under each name, brand and type; brands and types hold thousands."""
    grouped = rows.postings(table(spark, sf_dir, "part"), [F.col("p_name"), F.col("p_brand"), F.col("p_type")], ["p_partkey"], limit=7)
    return grouped.select("key", F.transform("rows", lambda r: r["p_partkey"]).alias("best"))


@query(
    "documented_count",
    "SELECT greatest(count(CASE WHEN length(trim(text)) > 0 THEN 1 END), 5)::BIGINT AS n_docs FROM documents",
)
def documented_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.doc_count(table(spark, sf_dir, "documents").withColumnRenamed("text", "docstring"), 5)


@query(
    "touched_names",
    """
    WITH changed AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0),
    own AS (SELECT p_name, p_type FROM part WHERE p_size IN (SELECT s_suppkey FROM changed))
    SELECT lower(p_name) AS name FROM own UNION SELECT lower(split_part(p_type, ' ', 3)) FROM own
    """,
)
def touched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("path"))
    symbols = table(spark, sf_dir, "part").select(
        F.col("p_size").cast("string").alias("path"), F.col("p_name").alias("name"),
        F.concat(F.lit("m::"), F.split_part("p_type", F.lit(" "), F.lit(3))).alias("import_from"),
    )
    return rows.touched_names(symbols, changed)


@query(
    "bundle_stats",
    "SELECT count(*) AS n_files, sum(octet_length(encode(html)))::BIGINT AS n_bytes FROM pages",
)
def bundle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.bundle_stats(table(spark, sf_dir, "pages").select(F.octet_length("html").alias("size")))


@query(
    "import_noise_suppressed",
    """
    SELECT event_id, user_id, event_type FROM events e WHERE event_type <> 'view' OR NOT EXISTS (
      SELECT 1 FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'purchase' AND date_trunc('day', o.ts) = date_trunc('day', e.ts))
    """,
)
def import_noise_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    strong = events.filter("event_type = 'purchase'").select("user_id", "day").distinct()
    weak = events.filter("event_type = 'view'").join(strong, ["user_id", "day"], "left_anti")
    kept = events.filter("event_type <> 'view'").select("event_id", "user_id", "event_type")
    return kept.unionByName(weak.select("event_id", "user_id", "event_type"))


@query(
    "union_distinct",
    """
    SELECT l_partkey AS part_key, min(l_suppkey) AS supp_key FROM (
      SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 40)
    GROUP BY 1
    """,
)
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"), "l_returnflag", "l_quantity")
    first, second = lines.filter("l_returnflag = 'A'"), lines.filter("l_quantity > 40")
    keep = ["part_key", "supp_key"]
    return sets.union_distinct(first.select(*keep), second.select(*keep), ["part_key"], ["supp_key"])


@query("deleted_paths", "SELECT c_custkey AS path FROM customer EXCEPT SELECT o_custkey FROM orders")
def deleted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"))
    return sets.gone(before, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path")))


@query("shared_paths", "SELECT c_custkey AS path FROM customer INTERSECT SELECT user_id FROM events")
def shared_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"))
    return sets.both(first, table(spark, sf_dir, "events").select(F.col("user_id").alias("path")))
