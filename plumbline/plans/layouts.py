"""Lookups in tables that are laid out for them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import layout, search
from plumbline.plans.registry import query
from plumbline.session import shared_folder
from plumbline.sources.tables import table


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as symbols of the modules that their suppliers are."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("Item_"), F.col("l_partkey").cast("string")).alias("name"),
        F.concat(F.lit("shop."), F.col("l_returnflag"), F.lit(".s"), F.col("l_suppkey").cast("string")).alias("module"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
    )


def laid_out(rows: DataFrame, columns: list[str], partitions: int | None = None) -> DataFrame:
    """``rows`` written to the shared folder, clustered, and read again."""
    folder = f"{shared_folder(rows.sparkSession)}/layout-{uuid.uuid4().hex}"
    layout.clustered(rows, columns, partitions=partitions).write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


LAID = "WITH l AS (SELECT 'Item_' || l_partkey AS name, 'shop.' || l_returnflag || '.s' || l_suppkey AS module, l_orderkey AS order_key, l_linenumber AS line FROM lineitem)"


@query("clustered_by_module", f"{LAID} SELECT name, module, order_key, line FROM l WHERE module = 'shop.A.s1' OR starts_with(module, 'shop.R.s1')")
def clustered_by_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module and a range of modules, from rows clustered by module and name."""
    held = laid_out(search.keyed(symbols(spark, sf_dir)), ["module", search.NAME_KEY])
    return held.filter((F.col("module") == "shop.A.s1") | layout.prefix_range("module", "shop.R.s1")).drop(search.NAME_KEY)


@query("clustered_by_prefix", f"{LAID} SELECT lower(name) AS label, min(name) AS name, count(*) AS n FROM l WHERE starts_with(lower(name), 'item_1') GROUP BY 1")
def clustered_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a prefix, in any case, from the same layout."""
    held = laid_out(search.keyed(symbols(spark, sf_dir)), ["module", search.NAME_KEY])
    found = search.prefix_filter(held, "ITEM_1")
    return found.groupBy(F.col(search.NAME_KEY).alias("label")).agg(F.min("name").alias("name"), F.count("*").alias("n"))


@query(
    "prefix_words",
    r"""
    SELECT p.prefix, count(*) AS n FROM (SELECT DISTINCT lower(p_name) AS name FROM part) d JOIN (SELECT DISTINCT lower(substr(p_name, 1, 3)) AS prefix FROM part) p
      ON starts_with(d.name, p.prefix) GROUP BY 1
    """,
)
def prefix_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names each prefix of three letters has: ranges of keys, met in the order of the keys."""
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    prefixes = table(spark, sf_dir, "part").select(F.lower(F.substring("p_name", 1, 3)).alias("prefix")).distinct()
    # A name lies in the range of the prefix that its own first letters are.
    return names.join(prefixes, F.substring("name", 1, 3) == F.col("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))
