"""Queries of what keeps an index current and of its sinks and outside sources."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.index import engine
from plumbline.plans.modules import FILES
from plumbline.plans.registry import query
from plumbline.session import shared_folder
from plumbline.sources import files, store
from plumbline.sources.tables import table
from plumbline.streaming import changes

#: An outside program that answers each name with its length; nothing for names with a blank.
ANSWERING = """
import json, sys
for line in sys.stdin:
    name = json.loads(line)["symbol"]
    print(json.dumps({} if " " in name else {"docstring": f"{name} has {len(name)} letters"}), flush=True)
"""


def told_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, event and version: users as paths, and the module that each belongs to."""
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "view", "opened").otherwise("changed")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), kind.alias("event"), F.col("event_id").alias("version"))


@query("change_rows", "SELECT user_id::VARCHAR AS path, CASE event_type WHEN 'error' THEN 'deleted' ELSE 'changed' END AS op, event_id AS version FROM events WHERE event_type <> 'view'")
def change_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client events as changes; unknown kinds are dropped."""
    return changes.change_events(told_events(spark, sf_dir))


@query(
    "refresh_needed",
    "SELECT event_id, 'u.m' || user_id AS module FROM events WHERE user_id = 1 OR starts_with('u.m' || user_id || '.x', 'u.m1.')",
)
def refresh_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one namespace; its siblings whose names only begin so are others."""
    module = F.concat(F.lit("u.m"), F.col("user_id").cast("string"))
    return changes.refresh_needed(table(spark, sf_dir, "events").select("event_id", module.alias("module")), "u.m1")


@query(
    "applied_batches",
    """
    SELECT path, version, op FROM (SELECT user_id::VARCHAR AS path, event_id AS version, CASE event_type WHEN 'error' THEN 'deleted' ELSE 'changed' END AS op,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type <> 'view') WHERE n = 1
    """,
)
def applied_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five batches of changes that are applied at once: the newest of each path, in one write."""
    told = told_events(spark, sf_dir)
    folder = f"{shared_folder(spark)}/applied-{uuid.uuid4().hex}"
    changes.apply_all([told.filter(F.col("version") % 5 == n) for n in range(5)], lambda batch, number: batch.write.parquet(folder))
    return spark.read.schema("path string, op string, version long").parquet(folder).select("path", "version", "op")


@query(
    "fail_open_rows",
    """
    WITH p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
    SELECT user_id, event_id, 'live' AS origin FROM events WHERE event_type = 'error'
    UNION ALL SELECT user_id, event_id, 'cached' FROM events WHERE value > 50 AND event_type <> 'error' AND user_id NOT IN (SELECT user_id FROM p)
    """,
)
def fail_open_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pending paths whatever a filter says of them, and cached rows of other paths that it lets through."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "event_id", "event_type", "value")
    live = events.filter("event_type = 'error'").select("path", "event_id", F.lit("live").alias("origin"))
    cached = events.filter("event_type <> 'error'").select("path", "event_id", F.lit("cached").alias("origin"), "value")
    return changes.fail_open(live, cached, F.col("value") > 50).withColumnRenamed("path", "user_id")


@query(
    "kept_answers",
    """
    WITH n AS (SELECT lower(p_type || '_' || p_partkey % 997) AS name, p_size FROM part)
    SELECT DISTINCT name, p_size AS answer FROM n WHERE name NOT IN (SELECT name FROM n WHERE p_size > 40)
    """,
)
def kept_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached answers whose names no change has touched, whatever their case."""
    name = F.concat("p_type", F.lit("_"), (F.col("p_partkey") % 997).cast("string"))
    part = table(spark, sf_dir, "part").select(name.alias("name"), F.col("p_size").alias("answer"))
    cached = part.select(F.lower("name").alias("name"), "answer").distinct()
    return changes.drop_dirty(cached, part.filter("answer > 40").select(F.upper("name").alias("name")), "name").select("name", "answer")


@query(
    "live_and_index_counts",
    """
    SELECT path, count(*) AS n, max(origin) AS origin FROM (
      SELECT l_suppkey AS path, 'index' AS origin FROM lineitem WHERE l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)
      UNION ALL SELECT l_suppkey, 'live' FROM lineitem WHERE l_quantity > 49) GROUP BY path
    """,
)
def live_and_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open paths are served from their live rows, all others from the index."""
    from plumbline.operators.joins import overlay

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), "l_quantity")
    index, live = lines.select("path", F.lit("index").alias("origin")), lines.filter("l_quantity > 49").select("path", F.lit("live").alias("origin"))
    return overlay(index, live, live).groupBy("path").agg(F.count("*").alias("n"), F.max("origin").alias("origin"))


@query(
    "definition_lines",
    r"""
    SELECT doc_id, n - 1 AS line FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS row, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS n FROM documents)
    WHERE regexp_matches(row, '(?i)^\s*the\s*(?::[^=]+)?|^\s*(?:def|class)\b[^(=]*\bthe\b')
    """,
)
def definition_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that a text search finds, with their numbers."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    found = files.matching_lines(docs, r"^\s*the\s*(?::[^=]+)?|^\s*(?:def|class)\b[^(=]*\bthe\b")
    return found.select(F.col("path").alias("doc_id"), F.col("line").cast("long").alias("line"))


@query(
    "outside_docs",
    "SELECT name AS symbol, CASE WHEN contains(name, ' ') THEN NULL ELSE name || ' has ' || length(name) || ' letters' END AS docstring FROM (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT c_mktsegment || ' x' FROM customer)",
)
def outside_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documentation from a program that runs beside each task."""
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("symbol"))
    names = types.unionByName(table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit(" x")).alias("symbol"))).distinct()
    return files.runtime_docs(names, [sys.executable, "-c", ANSWERING], timeout=20)


@query(
    "evolved_rows",
    f"WITH {FILES} SELECT p AS path, m AS module, 'unknown' AS language, NULL::VARCHAR AS fingerprint FROM s",
)
def evolved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an older version wrote: columns that it lacked are null, a new one has its default."""
    held = store.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    texts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"))
    named = texts.select(F.concat(F.lit("/lib/supply/s_"), "k", F.lit(".py")).alias("path"), F.concat(F.lit("supply.s_"), "k").alias("module"))
    held.replace({"files": named})
    return store.with_column(held.read("files"), "language", "string", F.lit("unknown")).select("path", "module", "language", "fingerprint")


@query("rebuilt_store", f"WITH {FILES} SELECT p AS path FROM s")
def rebuilt_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that can't be written is rebuilt in the next folder."""
    base = f"{shared_folder(spark)}/rebuilt-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("/lib/supply/s_"), F.col("s_suppkey").cast("string"), F.lit(".py")).alias("path"))
    rows.limit(0).write.parquet(f"{base}/taken")
    used = store.or_rebuild(lambda folder: rows.write.parquet(folder), [f"{base}/taken", f"{base}/free"], lambda folder: rows.write.parquet(folder))
    return spark.read.schema("path string").parquet(used)


@query("index_command", f"WITH {FILES} SELECT m AS module FROM s")
def index_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question by its command's name."""
    return engine(spark, sf_dir).query("import_candidates", name="Factory", limit=2_000_000_000).select("module")


@query("index_preset", f"WITH {FILES} SELECT 'only_' || min(k) AS name, 'navigation' AS preset, 2::BIGINT AS n_references FROM s")
def index_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a preset: a definition and its references, nothing else."""
    first = table(spark, sf_dir, "supplier").agg(F.min("s_suppkey")).first()[0]
    parts = engine(spark, sf_dir).answers(f"only_{first}", "navigation")
    assert set(parts) == {"definition", "references"}
    told = parts["definition"].select("name", F.lit("navigation").alias("preset"))
    return told.join(parts["references"].agg(F.count("*").alias("n_references")))


@query(
    "index_completions",
    f"""
    WITH {FILES}, words AS (SELECT 'only_' || k AS name FROM s)
    SELECT DISTINCT name FROM words
    """,
)
def index_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of the index that begin so."""
    return engine(spark, sf_dir).completion("ONLY_", limit=2_000_000_000).select("name")
