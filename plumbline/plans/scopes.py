"""Bindings that places see, over scopes and blocks that the tables give, and over texts that vary with their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import bindings
from plumbline.plans.registry import query
from plumbline.sources.tables import table

#: Lines of a supplier's text, and lines that a function or class of it takes.
LINES, SPAN = 4096, 64

#: Scopes and blocks of supplier s: of every 64 lines the last 56 are a function or a class, with an inner function, an if
#: of two branches with a loop in the first, and a loop around another if.
SHAPES = f"""
    spans AS (SELECT s_suppkey AS path, unnest(range({LINES // SPAN})) AS a FROM supplier),
    scopes AS (SELECT path, {SPAN} * a + 8 AS f, {SPAN} * a + 63 AS t, CASE WHEN (path + a) % 3 = 0 THEN 'class' ELSE 'function' END AS kind FROM spans
      UNION ALL SELECT path, {SPAN} * a + 34, {SPAN} * a + 54, 'function' FROM spans WHERE a % 2 = 0),
    blocks AS (SELECT path, {SPAN} * a + o.f AS f, {SPAN} * a + o.t AS t, CASE WHEN o.g >= 0 THEN {SPAN} * a + o.g END AS g FROM spans,
      (VALUES (2, 5, 1), (10, 17, 9), (19, 27, 9), (12, 14, -1), (29, 32, -1), (40, 52, -1), (42, 45, 41), (47, 50, 41)) o(f, t, g))
"""


def shapes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scopes and blocks of every supplier's text."""
    # A supplier is a few bytes and makes 608 rows, so they are dealt first.
    dealt = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    spans = dealt.select("path", F.explode(F.sequence(F.lit(0), F.lit(LINES // SPAN - 1))).alias("a"))
    at = lambda n: F.col("a") * SPAN + n
    kind = F.when((F.col("path") + F.col("a")) % 3 == 0, "class").otherwise("function")
    outer = spans.select("path", at(7).alias("line"), at(8).alias("start"), at(63).alias("end"), kind.alias("kind"))
    inner = spans.filter("a % 2 = 0").select("path", at(33).alias("line"), at(34).alias("start"), at(54).alias("end"), F.lit("function").alias("kind"))
    some = [(2, 5, 5, 1), (10, 17, 27, 9), (19, 27, 27, 9), (12, 14, 14, None), (29, 32, 32, None), (40, 52, 52, None), (42, 45, 50, 41), (47, 50, 50, 41)]
    named = lambda f, t, last, g: (at(f).alias("start"), at(t).alias("end"), at(last).alias("group_end"), (F.lit(None) if g is None else at(g)).cast("int").alias("branch_of"))
    each = F.inline(F.array(*(F.struct(*named(*shape)) for shape in some)))
    return outer.unionByName(inner), spans.select("path", each)


@query(
    "seen_bindings",
    f"""
    WITH {SHAPES},
    b AS (SELECT l_suppkey AS path, l_partkey % 11 AS name, l_orderkey % {LINES} AS ln, l_linenumber AS id FROM lineitem),
    p AS (SELECT DISTINCT l_suppkey AS path, l_partkey % 11 AS name, (7 * l_orderkey + l_linenumber) % {LINES} AS ln FROM lineitem),
    rows_ AS (SELECT DISTINCT path, ln FROM (SELECT path, ln FROM b UNION ALL SELECT path, ln FROM p)),
    sc AS (SELECT r.path, r.ln, list(s.f ORDER BY s.f) AS scope, coalesce(last(s.kind ORDER BY s.f), 'text') AS kind
      FROM rows_ r JOIN scopes s ON r.path = s.path AND r.ln BETWEEN s.f AND s.t GROUP BY r.path, r.ln),
    bl AS (SELECT r.path, r.ln, list(s.f ORDER BY s.f) AS chain, list(coalesce(s.g, -s.f - 1) ORDER BY s.f) AS groups
      FROM rows_ r JOIN blocks s ON r.path = s.path AND r.ln BETWEEN s.f AND s.t GROUP BY r.path, r.ln),
    at_ AS (SELECT r.path, r.ln, coalesce(scope, []) AS scope, coalesce(kind, 'text') AS kind, coalesce(chain, []) AS chain, coalesce(groups, []) AS groups
      FROM rows_ r LEFT JOIN sc USING (path, ln) LEFT JOIN bl USING (path, ln)),
    pairs AS (SELECT p.path, p.name, p.ln, b.ln AS binding_at, b.id, len(x.scope) AS depth, x.chain AS bc, y.chain AS pc, x.groups AS bg, y.groups AS pg
      FROM p JOIN b ON p.path = b.path AND p.name = b.name AND b.ln < p.ln
      JOIN at_ x ON b.path = x.path AND b.ln = x.ln JOIN at_ y ON p.path = y.path AND p.ln = y.ln
      WHERE y.scope[1:len(x.scope)] = x.scope AND (len(x.scope) = len(y.scope) OR x.kind <> 'class')),
    related AS (SELECT *, CASE WHEN pc[1:len(bc)] = bc THEN 'dominates' WHEN bc[1:len(pc)] = pc THEN 'conditional'
        WHEN len(list_filter(list_zip(bc, pc, bg, pg), lambda z: z[1] <> z[2] AND z[3] = z[4])) > 0 THEN 'hidden' ELSE 'conditional' END AS relation FROM pairs),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY path, name, ln ORDER BY depth DESC, binding_at DESC, id) AS n FROM related WHERE relation <> 'hidden'),
    sure AS (SELECT path, name, ln, first(binding_at ORDER BY depth DESC, binding_at DESC) AS sure_at FROM related WHERE relation = 'dominates' GROUP BY ALL)
    SELECT p.path, p.name, p.ln AS line, r.binding_at, coalesce(r.relation, 'hidden') AS relation, s.sure_at, r.id
    FROM p LEFT JOIN ranked r ON n = 1 AND p.path = r.path AND p.name = r.name AND p.ln = r.ln LEFT JOIN sure s ON p.path = s.path AND p.name = s.name AND p.ln = s.ln
    """,
)
def seen_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes, blocks = shapes(spark, sf_dir)
    items = table(spark, sf_dir, "lineitem")
    path, name = F.col("l_suppkey").alias("path"), (F.col("l_partkey") % 11).alias("name")
    bound = items.select(path, name, (F.col("l_orderkey") % LINES).alias("at"), F.lit(False).alias("is_parameter"), F.col("l_linenumber").alias("id"))
    places = items.select(path, name, ((7 * F.col("l_orderkey") + F.col("l_linenumber")) % LINES).alias("at"))
    return bindings.seen_bindings(places, bound, scopes, blocks, payload=["id"], once=True).withColumnRenamed("at", "line")
