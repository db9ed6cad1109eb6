"""Expressions over documentation, modules and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.plans.registry import query
from plumbline.sources.tables import table


@query(
    "doc_summary",
    "SELECT doc_id, regexp_extract(text, '(?m)^[ \\t\\r\\f]*([^ \\t\\r\\f\\n](?:[^\\n]*[^ \\t\\r\\f\\n])?)[ \\t\\r\\f]*$', 1) AS summary FROM documents",
)
def doc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.summary(F.col("text")).alias("summary"))


@query(
    "relative_module",
    """
    SELECT p_partkey AS part_key, CASE p_partkey % 4
      WHEN 0 THEN 'other.place' WHEN 1 THEN 'pkg.m' || (p_partkey % 10) || '.sib' WHEN 2 THEN 'pkg.up' ELSE 'top' END AS module FROM part
    """,
)
def relative_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    importer = F.concat(F.lit("pkg.m"), (k % 10).cast("string"), F.lit(".leaf"))
    target = F.when(k % 4 == 0, "other.place").when(k % 4 == 1, ".sib").when(k % 4 == 2, "..up").otherwise("...top")
    return table(spark, sf_dir, "part").select(k.alias("part_key"), text.relative_module(importer, target).alias("module"))


@query("json_props", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query(
    "page_modules",
    """
    SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[/?#].*$', '') AS root,
      coalesce(nullif(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/?#]*/?', ''), '[?#].*$', ''), '/+$', ''), '\\.[^./]*$', ''), '/', '.'), ''), 'document') AS module
    FROM pages
    """,
)
def page_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", ""), "/+$", "")
    root = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[/?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", root.alias("root"), text.module_of_path(path, root).alias("module"))


@query(
    "cache_namespaces",
    "SELECT c_custkey AS key, left(sha256(c_name || chr(0) || c_mktsegment), 16) AS namespace FROM customer",
)
def cache_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), text.short_digest(F.col("c_name"), F.col("c_mktsegment")).alias("namespace"))


@query(
    "entry_ages",
    "SELECT o_orderkey AS entry, greatest((1000000000000 - epoch_ms(o_orderdate)) // 86400000, 0)::BIGINT AS age FROM orders",
)
def entry_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    then = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry"), text.age_days(F.lit(1_000_000_000_000), then).alias("age"))


@query(
    "excluded_paths",
    "SELECT page_id FROM pages WHERE NOT (contains(url, 'blog') OR contains(url, 'fr'))",
)
def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter(~text.is_excluded(F.col("url"), ["**blog*", "fr/"])).select("page_id")


@query("identifier_names", "SELECT p_partkey AS part_key, regexp_matches(replace(p_name, ' ', ''), '^[A-Za-z_][A-Za-z0-9_]*$') AS valid FROM part")
def identifier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit(""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), text.is_identifier(name).alias("valid"))


@query(
    "clipped_messages",
    "SELECT doc_id, left(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), 500) AS message FROM documents",
)
def clipped_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.redacted(F.col("text"), "/home/user").alias("message"))
