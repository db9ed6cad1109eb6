"""Queries of the whole index, built once a session over the modules that ``plans.modules`` writes, and of its store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.engine import TextsEngine
from plumbline.plans.modules import FILES, base_texts, module_texts
from plumbline.plans.registry import query
from plumbline.session import shared_folder
from plumbline.sources.store import Store
from plumbline.sources.tables import table

_BUILT: dict[tuple, TextsEngine] = {}
FIRST = "/lib/supply/s_1.py"


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """The files of the tables that the index is made of, with their sizes and times."""
    out = []
    for name in ("supplier", "nation"):
        for file in table(spark, sf_dir, name).inputFiles():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(file))
            told = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
            out.append((file, told.getLen(), told.getModificationTime()))
    return tuple(sorted(out))


def engine(spark: SparkSession, sf_dir: str) -> TextsEngine:
    """The index over all suppliers' and nations' files; editable are the suppliers'. It is built anew when the tables change."""
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir))
    if key not in _BUILT:
        texts = module_texts(spark, sf_dir).unionByName(base_texts(spark, sf_dir))
        made = TextsEngine(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", texts, "/lib", ["/lib/supply"])
        made.reconcile()
        _BUILT[key] = made
    return _BUILT[key]


@query("index_status", f"WITH {FILES} SELECT (SELECT count(*) FROM s) + (SELECT count(*) FROM b) AS file_count, 22 * (SELECT count(*) FROM s) + 3 * (SELECT count(*) FROM b) AS symbol_count, 3 * (SELECT count(*) FROM s) + 2 * (SELECT count(*) FROM b) AS doc_count")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).status().select(*(F.col(c).cast("long").alias(c) for c in ("file_count", "symbol_count", "doc_count")))


@query("index_search", f"WITH {FILES} SELECT 'rate' AS name, 'function' AS kind, m AS module, 0::INTEGER AS rank FROM b")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions alone: imports of a name that has one are noise."""
    return engine(spark, sf_dir).search("rate", "all").select("name", "kind", "module", "rank")


@query("index_definition", f"WITH {FILES} SELECT 'cost' AS name, b.m AS module, b.p AS path, 3::INTEGER AS start_line, 'high' AS confidence FROM s JOIN b USING (n) WHERE s.p = '{FIRST}'")
def index_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``price`` means in one file: the function that its import renames."""
    return engine(spark, sf_dir).definition("price", path=FIRST).select("name", "module", "path", "start_line", "confidence")


@query("definition_candidates", f"WITH {FILES} SELECT name, path, confidence FROM (SELECT 'cost' AS name, p AS path, 'low' AS confidence FROM b ORDER BY p LIMIT 5)")
def definition_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a hint, up to five candidates of low confidence."""
    return engine(spark, sf_dir).definition("cost").select("name", "path", "confidence")


@query("definition_in_module", f"WITH {FILES} SELECT 'rate' AS name, m AS module, 'high' AS confidence FROM b WHERE n = 3")
def definition_in_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).definition("rate", module="base.nation_3").select("name", "module", "confidence")


@query(
    "index_references",
    f"""
    WITH {FILES} SELECT p AS path, 0::INTEGER AS start_line, 4::INTEGER AS start_character FROM b WHERE n = 3
    UNION ALL SELECT p, 1, 26 FROM s WHERE n = 3 UNION ALL SELECT p, 5, 7 FROM s WHERE n = 3
    """,
)
def index_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of one nation's ``rate``, not of the others'."""
    held = engine(spark, sf_dir)
    return held.references("rate", held.definition("rate", module="base.nation_3")).select("path", "start_line", "start_character")


@query("index_rename", f"WITH {FILES} SELECT p AS path, 2::INTEGER AS n_edits FROM s WHERE n = 3")
def index_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of editable files only."""
    held = engine(spark, sf_dir)
    found = held.rename("rate", "speed", held.definition("rate", module="base.nation_3"))
    return found.select("path", F.size("edits").alias("n_edits"))


@query("index_completion", "SELECT unnest(['Rate', 'rate', 'range']) AS name")
def index_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each name of the index and the built-in ones that begins so."""
    return engine(spark, sf_dir).completion("ra").select("name")


@query("index_documentation", f"WITH {FILES} SELECT 'rate' AS name, min('Rate of ' || name || '.') AS docstring, 'reference' AS origin, min('Rate of ' || name || '.') AS summary FROM b")
def index_documentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).documentation("rate").select("name", "docstring", "origin", "summary")


@query("index_signature_help", f"WITH {FILES} SELECT path, 'cost(x, y)' AS signature, 1::INTEGER AS active, 2::INTEGER AS n_parameters FROM (SELECT p AS path FROM b ORDER BY p LIMIT 5)")
def index_signature_help(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine(spark, sf_dir).signature_help("cost(1, ", 0, 8)
    return found.select("path", "signature", "active", F.size("parameters").alias("n_parameters"))


@query("index_type_definition", f"WITH {FILES} SELECT path, 'Maker' AS name FROM (SELECT p AS path FROM s ORDER BY p LIMIT 5)")
def index_type_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).type_definition("made = Maker(1)\n", "made", 0, {"Maker": "Maker"}).select("path", "name")


@query("index_member", f"WITH {FILES} SELECT min(p) AS path, 'make' AS name, 'Method Maker.make' AS detail FROM s")
def index_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).member("Maker", "make").select("path", "name", "detail")


@query("index_outgoing_calls", f"WITH {FILES} SELECT p AS path, 'make' AS caller, 'only_' || k AS callee, p AS callee_path, 1::BIGINT AS n_calls FROM s")
def index_outgoing_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose name one definition alone has."""
    held = engine(spark, sf_dir)
    return held.outgoing_calls(held.listing()).select("path", "caller", "callee", "callee_path", "n_calls")


@query("index_incoming_calls", "SELECT 'only_7' AS callee, 'make' AS caller, '/lib/supply/s_7.py' AS path, 1::BIGINT AS n_calls")
def index_incoming_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = engine(spark, sf_dir)
    return held.incoming_calls("only_7", held.definition("only_7")).select("callee", "caller", "path", "n_calls")


@query(
    "index_exports",
    f"""
    WITH {FILES} SELECT s.m AS import_module, 'rate' AS public_name, 'rate' AS source_name, b.m AS module, 'definition' AS reason FROM s JOIN b USING (n)
    UNION ALL SELECT s.m, 'price', 'cost', b.m, 'definition' FROM s JOIN b USING (n)
    UNION ALL SELECT s.m, 'Factory', 'Maker', s.m, 'definition' FROM s
    """,
)
def index_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where imported names and an alias lead, for every supplier's module."""
    found = engine(spark, sf_dir).store.read("export_table").filter("startswith(import_module, 'supply.') and public_name in ('rate', 'price', 'Factory')")
    return found.select("import_module", "public_name", "source_name", "module", "reason")


@query("index_import_candidates", f"WITH {FILES} SELECT m AS module FROM s UNION ALL SELECT m FROM b")
def index_import_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every module that exports a name, without a cap."""
    return engine(spark, sf_dir).import_candidates("rate", 2_000_000_000).select("module")


@query("index_unresolved_imports", f"WITH {FILES} SELECT p AS path, g.name, 'module-missing' AS code FROM s, (VALUES ('units'), ('solve_it'), ('plan'), ('best'), ('length')) g(name)")
def index_unresolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).unresolved_imports().select("path", "name", "code")


@query("index_batch", f"WITH {FILES} SELECT s.p AS path, 'price' AS name, b.p AS d_path, 3::INTEGER AS d_line FROM s JOIN b USING (n)")
def index_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the word at one place of every supplier's file means."""
    held = engine(spark, sf_dir)
    places = held.listing().filter("startswith(path, '/lib/supply/')").select("path", F.lit(11).alias("line"), F.lit(17).alias("column"))
    return held.batch(places).select("path", "name", "d_path", "d_line")


@query(
    "index_seen",
    f"""
    WITH {FILES}, asked AS (SELECT unnest(['n', 'price', 'make', 'make', 'm', 'z', 'n']) AS name, unnest([11, 11, 12, 19, 16, 23, 19]) AS line)
    SELECT p AS path, name, line::INTEGER AS line, CASE WHEN name IN ('n', 'm') AND line < 19 THEN line - 2 + (name = 'm')::INTEGER WHEN name = 'price' THEN 1 WHEN name = 'make' AND line = 12 THEN 9
      WHEN name = 'z' THEN 22 END::INTEGER AS binding_line, CASE WHEN line = 19 THEN 'hidden' ELSE 'dominates' END AS relation FROM s, asked
    """,
)
def index_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What seven names mean at places of every supplier's file: parameters, imports, a method that only its class sees."""
    held = engine(spark, sf_dir)
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(at).alias("line")) for n, at in (("n", 11), ("price", 11), ("make", 12), ("make", 19), ("m", 16), ("z", 23), ("n", 19)))))
    places = held.listing().filter("startswith(path, '/lib/supply/')").select("path", asked.alias("asked")).select("path", "asked.*")
    return held.seen(places).select("path", "name", "line", "binding_line", "relation")


@query("index_root_counters", f"WITH {FILES} SELECT '/lib' AS root, (SELECT count(*) FROM s) + (SELECT count(*) FROM b) AS file_count, 3 * (SELECT count(*) FROM s) + 2 * (SELECT count(*) FROM b) AS doc_count")
def index_root_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).store.read("index_root_metadata").select("root", "file_count", "doc_count")


@query(
    "index_span_counts",
    f"WITH {FILES} SELECT p AS path, g.name, g.n FROM s, (VALUES ('units', 4::BIGINT), ('rate', 2), ('price', 2), ('Maker', 3), ('n', 3), ('make', 2)) g(name, n)",
)
def index_span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference spans that the store holds: of editable files only."""
    spans = engine(spark, sf_dir).store.read("reference_spans").filter("name in ('units', 'rate', 'price', 'Maker', 'n', 'make')")
    return spans.groupBy("path", "name").agg(F.count("*").alias("n"))


# The store


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def _files(texts: DataFrame) -> DataFrame:
    return texts.select("path", "module", "fingerprint", F.lit(None).cast("binary").alias("identifier_filter"))


def _docs(texts: DataFrame, said: str) -> DataFrame:
    return texts.select(F.lit("top").alias("name"), "module", "path", F.lit("Function top").alias("detail"), F.lit(said).alias("docstring"))


@query("store_upserted_paths", f"WITH {FILES} SELECT p AS path, CASE WHEN n < 10 THEN 'new' ELSE 'old' END AS docstring FROM s")
def store_upserted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files stored, then those of some nations anew: their rows are replaced, the others stay."""
    held, texts = _store(spark), module_texts(spark, sf_dir)
    held.replace({"files": _files(texts), "docs": _docs(texts, "old")})
    nation = F.regexp_extract("text", r"nation_(\d+)", 1).cast("int")
    some = texts.filter(nation < 10)
    held.upsert_paths({"files": _files(some), "docs": _docs(some, "new")}, some)
    return held.read("docs").select("path", "docstring")


@query("store_deleted_roots", f"WITH {FILES} SELECT p AS path, m AS module FROM b")
def store_deleted_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _store(spark)
    held.replace({"files": _files(module_texts(spark, sf_dir).unionByName(base_texts(spark, sf_dir)))})
    held.delete_roots(spark.createDataFrame([("/lib/supply",)], "root string"))
    return held.read("files").select("path", "module")


@query("store_bulk_insert", f"WITH {FILES} SELECT p AS path, m AS module, 'Function top' AS detail, NULL::VARCHAR AS fingerprint FROM s")
def store_bulk_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fresh store has every table, empty; rows that are put in come back."""
    held = _store(spark)
    held.create()
    held.replace({"docs": _docs(module_texts(spark, sf_dir), "said")})
    return held.read("docs").join(held.read("files").select("path", "fingerprint"), "path", "left").select("path", "module", "detail", "fingerprint")


@query("store_runtime_docs", "SELECT 'c.' || c_nationkey AS symbol, max(c_custkey)::BIGINT AS updated_at FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def store_runtime_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documentation written back: the last of each symbol, nothing where nothing is said."""
    said = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).otherwise(" ")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c."), F.col("c_nationkey").cast("string")).alias("symbol"), said.alias("docstring"), F.lit(None).cast("string").alias("summary"), F.col("c_custkey").cast("long").alias("updated_at")
    )
    held = _store(spark)
    held.write_back_docs(rows)
    return held.read("runtime_docs").select("symbol", "updated_at")


@query("store_moved_counters", "SELECT '/r/' || n_regionkey AS root, greatest(count(*) - 4, 0)::BIGINT AS file_count FROM nation GROUP BY n_regionkey")
def store_moved_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = F.concat(F.lit("/r/"), F.col("n_regionkey").cast("string")).alias("root")
    counted = table(spark, sf_dir, "nation").groupBy(root).agg(F.count("*").alias("file_count"))
    held = _store(spark)
    held.upsert("index_root_metadata", counted)
    held.move_counters("file_count", counted.select("root", F.lit(-4).alias("delta")))
    return held.read("index_root_metadata").select("root", "file_count")


@query("store_seeded", f"WITH {FILES} SELECT p AS path, 'said' AS docstring FROM s")
def store_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One root's rows from another store that knows it by the same fingerprint; other roots stay behind."""
    peer, mine = _store(spark), _store(spark)
    both = module_texts(spark, sf_dir).unionByName(base_texts(spark, sf_dir))
    whole = _files(both).withColumn("identifier_filter", F.unhex(F.repeat(F.lit("00"), 8192)))
    mark = spark.createDataFrame([("/lib/supply", "f")], "root string, root_fingerprint string")
    peer.replace({"files": whole, "docs": _docs(both, "said")})
    for held in (peer, mine):
        held.upsert("index_root_metadata", mark)
    mine.seed_from(peer, "/lib/supply")
    return mine.read("docs").select("path", "docstring")
