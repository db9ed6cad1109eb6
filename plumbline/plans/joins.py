"""Joins between symbols, documentation and imports, on tables of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import joins
from plumbline.plans.registry import query
from plumbline.sources.tables import table


@query(
    "symbols_left_docs",
    "SELECT d.doc_id, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def symbols_left_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_docs(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    "attach_first_doc",
    """
    SELECT c_custkey AS key, c_name AS name, event_id, event_type FROM customer LEFT JOIN (
      SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_type, event_id) AS n FROM events) e
    ON c_custkey = user_id AND n = 1
    """,
)
def attach_first_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "event_type")
    return joins.with_first_doc(names, events, ["key"], ["event_type", "event_id"])


#: Part k stands for an import of part k // 3 while k is a multiple of 3 above 3, and for a definition else.
SYMBOLS = """
    symbols AS (SELECT p_partkey AS k, 'n' || p_partkey AS name, 'pkg.m' || p_partkey AS module,
      CASE WHEN p_partkey % 3 = 0 AND p_partkey > 3 THEN 'm' || (p_partkey // 3) || '::n' || (p_partkey // 3) END AS import_from FROM part)
"""


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    up = F.floor(k / 3).cast("string")
    target = F.when((k % 3 == 0) & (k > 3), F.concat(F.lit("m"), up, F.lit("::n"), up))
    return table(spark, sf_dir, "part").select(
        k.alias("k"), F.concat(F.lit("n"), k.cast("string")).alias("name"), F.concat(F.lit("pkg.m"), k.cast("string")).alias("module"),
        F.lit("function").alias("kind"), target.alias("import_from"),
    )


@query(
    "import_resolution_chain",
    f"""
    WITH RECURSIVE {SYMBOLS}, walk AS (
      SELECT i.k AS import_id, s.k AS spot, 1 AS depth FROM symbols i JOIN LATERAL (
        SELECT k FROM symbols t WHERE t.name = split_part(i.import_from, '::', 2) AND ends_with(t.module, '.' || split_part(i.import_from, '::', 1))) s ON true
      WHERE i.import_from IS NOT NULL
      UNION ALL
      SELECT w.import_id, t.k, depth + 1 FROM walk w JOIN symbols c ON c.k = w.spot AND c.import_from IS NOT NULL
      JOIN symbols t ON t.name = split_part(c.import_from, '::', 2) AND ends_with(t.module, '.' || split_part(c.import_from, '::', 1))
      WHERE depth < 8)
    SELECT i.k AS import_id, max_by(spot, depth) AS target_id FROM symbols i JOIN walk w ON w.import_id = i.k GROUP BY i.k
    """,
)
def import_resolution_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = _symbols(spark, sf_dir)
    imports = symbols.filter("import_from is not null").select(F.col("k").alias("import_id"), "import_from")
    return joins.follow_imports(imports, symbols, ["s_k"]).filter("s_k is not null").select("import_id", F.col("s_k").alias("target_id"))


@query(
    "star_reexport_fixpoint",
    """
    WITH RECURSIVE edges AS (SELECT DISTINCT l_partkey AS importer, l_suppkey AS source FROM lineitem WHERE l_partkey <> l_suppkey),
    exports AS (SELECT s_suppkey AS module, 'x' || s_nationkey AS name FROM supplier),
    walk AS (SELECT module, name, 0 AS depth FROM exports
      UNION SELECT importer, name, depth + 1 FROM walk JOIN edges ON module = source WHERE depth < 8)
    SELECT DISTINCT module, name FROM walk
    """,
)
def star_reexport_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("importer"), F.col("l_suppkey").alias("source")).filter("importer <> source")
    held = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("module"), F.concat(F.lit("x"), F.col("s_nationkey").cast("string")).alias("name"))
    return joins.spread_names(held, edges)


@query("star_edges", "SELECT DISTINCT 'm' || l_partkey AS importer, 'pkg' || l_suppkey AS source FROM lineitem WHERE l_quantity > 45")
def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_quantity") > 45, "*").otherwise("thing")
    return joins.star_edges(
        lines.select(
            F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("module"),
            F.concat(F.lit("pkg"), F.col("l_suppkey").cast("string"), F.lit("::"), name).alias("import_from"),
        )
    )


@query(
    "static_fallback_fill",
    """
    SELECT n_nationkey::BIGINT AS key, n_name AS label FROM nation WHERE n_regionkey <> 2
    UNION ALL SELECT k, 'static' || k FROM (SELECT unnest(range(0, 40)) AS k)
    WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)
    """,
)
def static_fallback_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("label"))
    static = spark.range(40).select(F.col("id").alias("key"), F.concat(F.lit("static"), F.col("id").cast("string")).alias("label"))
    return joins.fill_absent(rows, static, ["key"])


@query(
    "owner_classification",
    """
    SELECT p_partkey AS part_key, p_type || '.' || p_brand || '.x' AS module,
      CASE WHEN p_type = 'PROMO' AND p_brand = 'Brand#1' THEN 'first promo' WHEN p_type = 'PROMO' THEN 'promo'
           WHEN p_type = 'SMALL' THEN 'small' WHEN p_type = 'STANDARD' THEN 'standard' END AS label FROM part
    """,
)
def owner_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = spark.createDataFrame(
        [("PROMO.Brand#1", "first promo", 0), ("PROMO", "promo", 1), ("SMALL", "small", 1), ("STANDARD", "standard", 2)],
        "prefix string, label string, priority int",
    )
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_key"), F.concat_ws(".", "p_type", "p_brand", F.lit("x")).alias("module"))
    return joins.classify(rows, "module", prefixes).select("part_key", "module", "label")


@query(
    "alias_targets",
    """
    SELECT a.n_name AS name, t.n_name AS target, a.n_regionkey AS owner FROM nation a JOIN nation t
    ON a.n_regionkey = t.n_regionkey AND t.n_nationkey = a.n_nationkey + 5
    """,
)
def alias_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    one = nation.select(F.lit("p").alias("path"), F.col("n_regionkey").alias("owner"), (F.col("n_nationkey") + 5).cast("string").alias("target"), F.col("n_name").alias("name"))
    targets = nation.select(
        F.lit("p").alias("path"), F.col("n_regionkey").alias("owner"), F.col("n_nationkey").cast("string").alias("name"),
        F.lit("method").alias("kind"), F.col("n_name").alias("signature"), F.lit("").alias("docstring"),
    )
    return joins.resolve_aliases(one, targets).select("name", F.col("signature").alias("target"), "owner")


@query(
    "snapshot_diff",
    """
    WITH m AS (SELECT *, quantile_disc(event_id, 0.5) OVER () AS middle FROM events),
    o AS (SELECT user_id, max_by(event_type, event_id) AS t, max(event_id) AS f FROM m WHERE event_id <= middle GROUP BY 1 HAVING max_by(event_type, event_id) <> 'error'),
    n AS (SELECT user_id, max_by(event_type, event_id) AS t, max(event_id) AS f FROM m GROUP BY 1 HAVING max_by(event_type, event_id) <> 'error')
    SELECT coalesce(o.user_id, n.user_id) AS path, CASE WHEN o.user_id IS NULL THEN 'insert' WHEN n.user_id IS NULL THEN 'delete'
      WHEN o.t = n.t THEN 'unchanged' ELSE 'update' END AS op FROM o FULL JOIN n ON o.user_id = n.user_id
    """,
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after half of all events against that after all: of each user the type of the last event, gone after an error."""
    from plumbline.streaming.changes import snapshot_diff as diff

    events = table(spark, sf_dir, "events")
    state = lambda rows: rows.groupBy(F.col("user_id").alias("path")).agg(F.max_by("event_type", "event_id").alias("fingerprint")).filter("fingerprint <> 'error'")
    middle = events.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)").cast("long").alias("m"))
    return diff(state(events.join(F.broadcast(middle), F.col("event_id") <= F.col("m")).drop("m")), state(events))


@query(
    "enclosing_interval",
    """
    WITH spans AS (SELECT l_orderkey AS k, epoch(l_shipdate)::BIGINT // 86400 AS a, epoch(l_shipdate)::BIGINT // 86400 + l_quantity::BIGINT AS b, l_linenumber AS label FROM lineitem),
    points AS (SELECT l_orderkey AS k, l_linenumber AS point_no, epoch(l_shipdate)::BIGINT // 86400 + 3 AS spot FROM lineitem)
    SELECT k AS order_key, point_no, spot, label FROM (
      SELECT p.k, point_no, spot, label, row_number() OVER (PARTITION BY p.k, point_no, spot ORDER BY a DESC, b, label) AS n
      FROM points p JOIN spans s ON p.k = s.k AND a <= spot AND spot <= b) WHERE n = 1
    """,
)
def enclosing_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    lines = table(spark, sf_dir, "lineitem").withColumn("day", day)
    spans = lines.select(F.col("l_orderkey").alias("order_key"), F.col("day").alias("start"), (F.col("day") + F.col("l_quantity").cast("long")).alias("end"), F.col("l_linenumber").alias("label"))
    points = lines.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("point_no"), (F.col("day") + 3).alias("spot"))
    return joins.innermost(points.distinct(), spans, "order_key", "spot").select("order_key", "point_no", "spot", "label")


@query(
    "live_overlay",
    """
    SELECT l_orderkey AS path, l_partkey AS part_key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderstatus = 'P'
    """,
)
def live_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("part_key"))
    live = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("path"), F.lit(-1).cast("long").alias("part_key"))
    return joins.overlay(index, live, live)


@query(
    "paired_roles",
    """
    SELECT l_partkey AS part_key, l_suppkey AS supp_key, l_orderkey AS order_key FROM lineitem l WHERE l_returnflag = 'A' AND EXISTS (
      SELECT 1 FROM lineitem o WHERE o.l_partkey = l.l_partkey AND o.l_suppkey = l.l_suppkey AND o.l_returnflag = 'R')
    """,
)
def paired_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.when(F.col("l_returnflag") == "A", "pxd").when(F.col("l_returnflag") == "R", "pyx").otherwise("py")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"), F.col("l_orderkey").alias("order_key"), F.concat(F.lit("f."), ext).alias("path")
    )
    return joins.paired_roles(rows, ["part_key", "supp_key"], "declaration").drop("path")


@query(
    "three_tables",
    """
    SELECT DISTINCT o_orderkey AS path FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN part ON l_partkey = p_partkey
    WHERE lower(o_orderpriority) LIKE '%urgent%' OR lower(o_orderstatus) LIKE '%urgent%' OR lower(p_name) LIKE '%urgent%' OR lower(p_type) LIKE '%urgent%'
    """.replace("%urgent%' OR lower(p_type)", "%urgent%' OR lower(p_type)"),
)
def three_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), "l_partkey").join(part, "l_partkey")
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("module"))
    return joins.three_tables(
        files.withColumn("path", F.col("path").cast("string")),
        lines.select(F.col("path").cast("string").alias("path"), F.col("p_name").alias("name")),
        lines.select(F.col("path").cast("string").alias("path"), F.col("p_type").alias("export")),
        "urgent",
    ).select(F.col("path").cast("long").alias("path"))


@query(
    "unique_classes",
    """
    WITH d AS (SELECT l_suppkey AS s, l_partkey AS k, count(*) AS n, min(l_orderkey) AS p FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2),
    r AS (SELECT l_suppkey AS s, l_partkey AS k, count(*) AS n, min(l_orderkey) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
    i AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS k FROM lineitem)
    SELECT 'm' || i.s AS module, i.k::VARCHAR AS name, CASE WHEN d.n = 1 THEN d.p ELSE r.p END AS path FROM i LEFT JOIN d USING (s, k) LEFT JOIN r USING (s, k)
    WHERE (d.n = 1 AND r.n IS NULL) OR (d.n IS NULL AND r.n = 1)
    """,
)
def unique_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("module"), F.col("l_partkey").cast("string").alias("name"),
        F.col("l_orderkey").alias("path"), F.lit("class").alias("kind"), "l_returnflag",
    )
    imports = lines.select("module", "name").distinct()
    return joins.unique_classes(imports, lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag = 'R'")).select("module", "name", "path")


@query("semi_join_fresh", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = table(spark, sf_dir, "labels").filter("quality = 1")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(fresh, "doc_id", "left_semi")


@query(
    "unresolved_imports",
    """
    SELECT l_orderkey AS order_key, l_linenumber AS line_number, 'module-missing' AS code FROM lineitem
    WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)
    UNION ALL
    SELECT l_orderkey, l_linenumber, 'name-missing' FROM lineitem WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)
    AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)
    """,
)
def unresolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    modules = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    names = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return joins_unresolved(lines, modules, names).select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_number"), "code")


def joins_unresolved(bindings: DataFrame, modules: DataFrame, names: DataFrame) -> DataFrame:
    """Bindings whose module is missing, and those whose module is there but whose name is not."""
    no_module = bindings.join(modules, modules.columns, "left_anti").withColumn("code", F.lit("module-missing"))
    no_name = bindings.join(modules, modules.columns, "left_semi").join(names, names.columns, "left_anti")
    return no_module.unionByName(no_name.withColumn("code", F.lit("name-missing")))


@query(
    "identity_references",
    """
    SELECT l_orderkey AS path, l_linenumber AS start_line, min(l_suppkey) AS supp_key FROM lineitem
    WHERE l_returnflag = 'R' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY 1, 2
    """,
)
def identity_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    references = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("start_line"), F.lit(0).alias("start_character"),
        F.col("l_suppkey").alias("end_line"), F.lit(0).alias("end_character"), F.col("l_partkey").alias("part_key"),
        F.when(F.col("l_returnflag") == "R", "high").otherwise("low").alias("confidence"),
    )
    target = table(spark, sf_dir, "part").filter("p_size = 7").select(F.col("p_partkey").alias("part_key"))
    return joins.same_identity(references, target, ["part_key"]).select("path", "start_line", F.col("end_line").alias("supp_key"))


@query(
    "below_roots",
    """
    SELECT r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR (r_name = 'EUROPE' AND contains(n_name, 'A'))
    """,
)
def below_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    roots = region.filter("r_name = 'ASIA'").select(F.col("r_name").alias("root")).unionByName(
        places.filter("r_name = 'EUROPE' and contains(n_name, 'A')").select(F.concat_ws("/", "r_name", "n_name").alias("root"))
    )
    files = customer.join(places, customer["c_nationkey"] == places["n_nationkey"]).select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"))
    return joins.below_roots(files, roots)
