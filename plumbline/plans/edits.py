"""Places of texts that are edited in two batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import edits
from plumbline.plans.registry import query
from plumbline.sources.tables import table

#: Edits of supplier s: every 40 code points at most one in each batch, of up to 30, by up to 25 new ones.
EDITS = """
    e AS (SELECT l_suppkey AS path, batch, 40 * k AS a, 40 * k + wide AS b, long AS n FROM (
      SELECT l_suppkey, l_linenumber % 2 AS batch, l_orderkey % 250 AS k, min(l_quantity::BIGINT % 31) AS wide, min(l_partkey % 26) AS long FROM lineitem GROUP BY 1, 2, 3)),
    p AS (SELECT DISTINCT l_suppkey AS path, (l_partkey * 13) % 10000 AS place FROM lineitem)
"""


def moved(batch: int, source: str, out: str, back: bool = False) -> str:
    """One batch by brute force: the changes of all edits that end before a place, and the edit that holds it."""
    new = f"""n{out} AS (SELECT path, a, b, n, a + coalesce((SELECT sum(o.n - (o.b - o.a)) FROM e o WHERE o.batch = {batch} AND o.path = e.path AND o.a < e.a), 0) AS na FROM e WHERE batch = {batch})"""
    a, b, x, y = ("na", "na + n", "a", "b") if back else ("a", "b", "na", "na + n")
    return f"""{new},
    {out} AS (SELECT s.path, s.place, CASE WHEN max({a}) IS NULL THEN any_value(s.at_) WHEN any_value(s.at_) >= max_by({b}, {a}) THEN max_by({y}, {a}) + any_value(s.at_) - max_by({b}, {a})
      ELSE max_by({x}, {a}) + least(any_value(s.at_) - max({a}), max_by({y}, {a}) - max_by({x}, {a})) END AS at_
      FROM {source} s LEFT JOIN n{out} q ON q.path = s.path AND {a} <= s.at_ GROUP BY s.path, s.place)"""


@query(
    "places_through_edits",
    f"""
    WITH {EDITS}, s0 AS (SELECT path, place, place AS at_ FROM p), {moved(0, "s0", "s1")}, {moved(1, "s1", "s2")},
    {moved(1, "s2", "s3", back=True)}, {moved(0, "s3", "s4", back=True)}
    SELECT s2.path, s2.place, s2.at_::BIGINT AS moved, s4.at_::BIGINT AS restored FROM s2 JOIN s4 ON s2.path = s4.path AND s2.place = s4.place
    """,
)
def places_through_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where places of a text lie after two batches of edits, and where these lie in the text before."""
    items = table(spark, sf_dir, "lineitem")
    told = items.groupBy(F.col("l_suppkey").alias("path"), (F.col("l_linenumber") % 2).alias("batch"), (F.col("l_orderkey") % 250).alias("k")).agg(
        F.min(F.col("l_quantity").cast("long") % 31).alias("wide"), F.min(F.col("l_partkey") % 26).alias("length")
    )
    made = told.select("path", "batch", (40 * F.col("k")).alias("start"), (40 * F.col("k") + F.col("wide")).alias("end"), "length")
    points = items.select(F.col("l_suppkey").alias("path"), ((F.col("l_partkey") * 13) % 10000).alias("place")).distinct().withColumn("moved", F.col("place"))
    there = edits.through(points, made, "path", "moved").withColumn("restored", F.col("moved"))
    return edits.through(there, made, "path", "restored", back=True)


@query(
    "edited_texts",
    r"""
    WITH e AS (SELECT doc_id, text, length(text) AS n FROM documents),
    f AS (SELECT doc_id, n, CASE WHEN n < 20 THEN text ELSE substr(text, 1, 3) || '<' || doc_id || '>' || substr(text, 8, n - 17) || substr(text, n - 4) END AS one FROM e)
    SELECT doc_id, md5(CASE WHEN n < 20 THEN one ELSE 'é' || substr(one, 2) END) AS digest, length(one) AS n_chars FROM f
    """,
)
def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits of every longer document, then one of what they left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.length("text")
    one = lambda batch, start, end, new: F.struct(F.lit(batch).alias("batch"), start.cast("int").alias("start"), end.cast("int").alias("end"), new.alias("new"))
    marks = F.concat(F.lit("<"), F.col("doc_id").cast("string"), F.lit(">"))
    steps = docs.filter(n >= 20).select("doc_id", F.inline(F.array(one(1, n - 10, n - 5, F.lit("")), one(1, F.lit(3), F.lit(7), marks), one(2, F.lit(0), F.lit(1), F.lit("é")))))
    return edits.edited(docs, steps, "doc_id").select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


@query(
    "places_in_documents",
    r"""
    WITH d AS (SELECT doc_id, text, n_chars FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, text, unnest([0, length(text) // 3, length(text) // 2, length(text)]) AS at_ FROM d),
    h AS (SELECT DISTINCT doc_id, at_, substr(text, 1, at_) AS head FROM p)
    SELECT doc_id, at_ AS place, (length(head) - length(replace(head, chr(10), '')))::BIGINT AS line, length(string_split(head, chr(10))[-1])::BIGINT AS col,
      strlen(string_split(head, chr(10))[-1])::BIGINT AS byte_col FROM h
    """,
)
def places_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line, column and byte column of four places of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter("text is not null")
    n = F.length("text").cast("long")
    points = docs.select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.floor(n / 3), F.floor(n / 2), n)).alias("place")).distinct()
    found = edits.positions(points, docs, "doc_id", "place")
    return found.select("doc_id", "place", "line", F.col("column").alias("col"), F.col("byte_column").cast("long").alias("byte_col"))
