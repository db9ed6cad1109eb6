"""Ranked search, prefix completion and multi-term queries over the part and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import search, sets
from plumbline.plans.registry import query
from plumbline.sources.tables import table


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_key"), F.col("p_name").alias("name"), F.col("p_type").alias("module"), F.col("p_brand").alias("brand")
    )


RANKED = """
    WITH hits AS (
      SELECT p_partkey AS part_key, p_name AS name, p_type AS module,
        CASE WHEN lower(p_name) = 're' THEN 0
             WHEN starts_with(lower(p_name), 're') THEN 1
             WHEN regexp_matches(lower(p_name), '[ _]re') THEN 2
             WHEN contains(lower(p_name), 're') THEN 3
             WHEN contains(lower(p_type), 're') THEN 4 ELSE 5 END AS rank
      FROM part)
    SELECT part_key, name, module, rank FROM hits WHERE rank < 5
    ORDER BY rank, length(name), name, module, part_key LIMIT 20
"""


@query("symbol_search_ranked", RANKED)
def symbol_search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.ranked_search(_parts(spark, sf_dir).drop("brand"), "re", 20, " _", ("part_key",))
    return found.select("part_key", "name", "module", "rank")


@query(
    "symbol_search_like",
    """
    WITH hits AS (
      SELECT p_partkey AS part_key, p_name AS name, p_type AS module,
        CASE WHEN lower(p_name) = 'o_d' THEN 0 WHEN starts_with(lower(p_name), 'o_d') THEN 1
             WHEN contains(lower(p_name), 'o_d') THEN 3 WHEN contains(lower(p_type), 'o_d') THEN 4 ELSE 5 END AS rank
      FROM part WHERE lower(p_name) LIKE '%o_d%' OR lower(p_type) LIKE '%o_d%')
    SELECT part_key, name, module, rank FROM hits
    ORDER BY rank, length(name), name, module, part_key LIMIT 50
    """,
)
def symbol_search_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wildcards in the term match, but rank behind all literal hits."""
    rows = _parts(spark, sf_dir).drop("brand")
    return search.like_search(rows, "o_d", 50, tie_breakers=("part_key",)).select("part_key", "name", "module", "rank")


@query(
    "prefix_topk_best",
    """
    WITH best AS (
      SELECT *, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_size, p_partkey) AS n
      FROM part WHERE starts_with(lower(p_name), 's'))
    SELECT lower(p_name) AS label, p_partkey AS part_key, p_name AS name, p_type AS module
    FROM best WHERE n = 1 ORDER BY name, module LIMIT 100
    """,
)
def prefix_topk_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_key"), F.col("p_name").alias("name"), F.col("p_type").alias("module"), F.col("p_size").alias("size")
    )
    return search.prefix_top(rows, "S", 100, ["size", "part_key"]).select("label", "part_key", "name", "module")


@query(
    "multi_term_search",
    """
    SELECT doc_id, source FROM documents
    WHERE contains(lower(text), 'the') AND contains(lower(text), 'ing') AND contains(lower(text), 'er')
    """,
)
def multi_term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.multi_term(table(spark, sf_dir, "documents"), "text", "The ing  ER").select("doc_id", "source")


@query(
    "plain_ranked_search",
    """
    SELECT part_key, name, score FROM (
      SELECT p_partkey AS part_key, p_name AS name,
        CASE WHEN lower(p_name) = 'small' THEN 0 WHEN starts_with(lower(p_name), 'small') THEN 1
             WHEN contains(lower(p_name), 'small') THEN 2 END AS score FROM part)
    WHERE score IS NOT NULL ORDER BY score, name, part_key LIMIT 200
    """,
)
def plain_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).withColumn("name", F.col("name"))
    low = F.lower("name")
    score = F.when(low == "small", 0).when(low.startswith("small"), 1).when(low.contains("small"), 2).cast("int")
    return rows.withColumn("score", score).filter("score is not null").orderBy("score", "name", "part_key").limit(200).select("part_key", "name", "score")


@query(
    "hot_names",
    "SELECT name FROM (SELECT DISTINCT p_name AS name FROM part) ORDER BY name LIMIT 256",
)
def hot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hot_set(_parts(spark, sf_dir), "name", 256)


@query(
    "viewer_list",
    """
    SELECT part_key, name, module,
      CASE WHEN kind IN ('economy', 'standard') THEN 'plain' WHEN kind IN ('promo') THEN 'special' ELSE 'other' END AS bucket
    FROM (SELECT p_partkey AS part_key, p_name AS name, p_type AS module, lower(split_part(p_type, ' ', 1)) AS kind FROM part
          WHERE contains(lower(p_name), 'e') AND contains(lower(p_name), 'o'))
    ORDER BY name, module, part_key LIMIT 500
    """,
)
def viewer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir).withColumn("kind", F.lower(F.split_part("module", F.lit(" "), F.lit(1))))
    held = search.multi_term(rows, "name", "e o").orderBy("name", "module", "part_key").limit(500)
    bucket = F.when(F.col("kind").isin("economy", "standard"), "plain").when(F.col("kind") == "promo", "special").otherwise("other")
    return held.select("part_key", "name", "module", bucket.alias("bucket"))


@query(
    "priority_union",
    """
    WITH rows AS (
      SELECT p_name AS label, p_type AS detail, 0 AS source FROM part WHERE p_size > 25
      UNION ALL SELECT p_name, 'derived', 1 FROM part
      UNION ALL SELECT r_name, 'region', 2 FROM region)
    SELECT label, min(detail) AS detail FROM rows r
    WHERE source = (SELECT min(source) FROM rows o WHERE o.label = r.label) GROUP BY label
    """,
)
def priority_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    sources = [
        part.filter("p_size > 25").select(F.col("p_name").alias("label"), F.col("p_type").alias("detail")),
        part.select(F.col("p_name").alias("label"), F.lit("derived").alias("detail")),
        table(spark, sf_dir, "region").select(F.col("r_name").alias("label"), F.lit("region").alias("detail")),
    ]
    return sets.first_wins(sources, "label")
