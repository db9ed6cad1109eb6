"""Predicates, parsers, ranks and choices over symbol rows that are made of the part table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.operators import joins, rows, search
from plumbline.plans.registry import query
from plumbline.sources import files, store
from plumbline.sources.tables import table

#: One symbol per part; the Spark and the SQL side say the same.
COLUMNS = {
    "id": "p_partkey",
    "name": "replace(p_name, ' ', '_')",
    "module": "concat('m.', lower(p_type))",
    "kind": "CASE p_size % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' ELSE 'variable' END",
    "path": "concat('/m/', lower(p_type), '/', CAST(p_size AS STRING), CASE p_size % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.pyx' WHEN 2 THEN '.pxd' ELSE '.pxi' END)",
    "start_line": "CAST(p_partkey AS INT)",
    "start_character": "p_size",
    "docstring": "CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN '  ' WHEN p_size % 5 = 2 THEN concat(p_name, ' Runtime documentation worker can provide') ELSE p_name END",
    "signature": "CASE WHEN p_size % 2 = 0 THEN concat(replace(p_name, ' ', '_'), '(self, x)') ELSE concat(replace(p_name, ' ', '_'), '(x)') END",
}
SYMBOLS = "sym AS (SELECT " + ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {c}" for c, e in COLUMNS.items()) + " FROM part)"
KIND = "CASE kind WHEN 'class' THEN 1 WHEN 'function' THEN 2 ELSE 4 END"
EXTENSION = "CASE string_split(path, '.')[-1] WHEN 'py' THEN 1 WHEN 'pyx' THEN 2 WHEN 'pxd' THEN 3 ELSE 4 END"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(*(F.expr(e).alias(c) for c, e in COLUMNS.items()))


@query("last_components", f"WITH {SYMBOLS} SELECT id, substr(module, 3) AS last FROM sym")
def last_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).select("id", text.last_component(F.col("module")).alias("last"))


@query("split_targets", f"WITH {SYMBOLS} SELECT id, module, CASE WHEN id % 2 = 0 THEN name ELSE substr(module, 3) END AS name FROM sym")
def split_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with a name, and modules alone, whose last component is the name."""
    target = F.when(F.col("id") % 2 == 0, F.concat_ws("::", "module", "name")).otherwise(F.col("module"))
    module, name = joins.split_import(target)
    return symbols(spark, sf_dir).select("id", module.alias("module"), name.alias("name"))


@query("method_owners", f"WITH {SYMBOLS} SELECT id, CASE WHEN kind = 'class' THEN name END AS owner FROM sym")
def method_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = F.when(F.col("kind") == "class", F.concat(F.lit("Method "), "name", F.lit(".run"))).otherwise(F.concat(F.lit("Function "), "name"))
    return symbols(spark, sf_dir).select("id", text.detail_owner(detail).alias("owner"))


@query("known_kinds", f"WITH {SYMBOLS} SELECT id, CASE WHEN kind = 'variable' THEN 'variable' ELSE kind END AS kind FROM sym")
def known_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds in any case are known; a word that is no kind means a variable."""
    told = F.when(F.col("kind") == "variable", F.col("name")).otherwise(F.upper("kind"))
    return symbols(spark, sf_dir).select("id", text.kind_of(told).alias("kind"))


@query(
    "truncated_docs",
    """
    WITH h AS (SELECT doc_id, text, array_to_string(string_split(text, chr(10))[1:24], chr(10)) AS head FROM documents),
      c AS (SELECT doc_id, text, CASE WHEN strlen(head) > 2400 THEN substring(head, 1, 2400) ELSE head END AS cut FROM h)
    SELECT doc_id, md5(CASE WHEN cut = text THEN text ELSE cut || chr(10) || '...' END) AS digest FROM c
    """,
)
def truncated_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.shortened(F.col("text"))).alias("digest"))


@query(
    "hover_texts",
    f"WITH {SYMBOLS} SELECT id, '**' || kind || '**' || chr(10) || '_' || module || '_' || CASE WHEN docstring IS NULL THEN '' ELSE chr(10) || docstring END AS shown FROM sym",
)
def hover_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).select("id", text.hover(F.col("kind"), F.col("module"), F.col("docstring")).alias("shown"))


@query("prefix_rows", f"WITH {SYMBOLS} SELECT id, name FROM sym WHERE lower(name) LIKE 'bl%'")
def prefix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.prefix_filter(symbols(spark, sf_dir), "Bl").select("id", "name")


@query("subtree_rows", f"WITH {SYMBOLS} SELECT id, module FROM sym WHERE module = 'm.small'")
def subtree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).filter(text.in_subtree(F.col("module"), "m.small")).select("id", "module")


@query("method_like_rows", f"WITH {SYMBOLS} SELECT id, name FROM sym WHERE kind <> 'class' AND contains(signature, '(self')")
def method_like_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).filter(text.is_method(F.col("kind"), F.col("name"), F.col("signature"))).select("id", "name")


@query("specific_docs", f"WITH {SYMBOLS} SELECT id, docstring FROM sym WHERE trim(docstring) <> '' AND NOT contains(docstring, 'Runtime documentation worker can provide')")
def specific_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).filter(text.is_specific(F.col("docstring"))).select("id", "docstring")


@query("indexable_files", f"WITH {SYMBOLS} SELECT id, string_split(path, '.')[-1] = 'py' AS plain, true AS with_cython FROM sym")
def indexable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return symbols(spark, sf_dir).select("id", text.has_extension(path).alias("plain"), text.has_extension(path, True).alias("with_cython"))


@query("file_fingerprints", "SELECT p_partkey AS id, p_size || ':' || p_partkey AS fingerprint FROM part")
def file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.fingerprint(F.col("p_size"), F.col("p_partkey")).alias("fingerprint"))


@query(
    "chosen_module_files",
    "SELECT 'a.s_' || s_suppkey AS module, '/r/a/s_' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '/__init__.py' ELSE '.py' END AS path FROM supplier",
)
def chosen_module_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a plain file, a Cython file and a package the one that a module's name finds."""
    held = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit("/r/a/s_"), F.col("s_suppkey").cast("string")).alias("stem"))
    ends = F.when(F.col("k") % 3 == 0, F.array(F.lit(".py"), F.lit(".pyx"))).when(F.col("k") % 3 == 1, F.array(F.lit("/__init__.py"))).otherwise(F.array(F.lit("/__init__.py"), F.lit(".py")))
    listed = held.select("stem", F.explode(ends).alias("end")).select(F.concat("stem", "end").alias("path"))
    asked = held.select(F.concat(F.lit("a.s_"), F.col("k").cast("string")).alias("module"))
    return files.module_paths(asked, listed.withColumn("root", F.lit("/r")), with_cython=True)


@query(
    "best_symbols",
    f"""
    WITH {SYMBOLS} SELECT name, id FROM (SELECT name, id, row_number() OVER (PARTITION BY name
      ORDER BY {KIND}, CASE WHEN length(trim(coalesce(docstring, ''))) = 0 THEN 1 ELSE 0 END, {EXTENSION}, path, start_line, start_character) AS r FROM sym) WHERE r = 1
    """,
)
def best_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.best_symbol(symbols(spark, sf_dir), ["name"]).select("name", "id")


@query("distinct_references", f"WITH {SYMBOLS} SELECT path, start_character, min(start_line)::INTEGER AS start_line FROM sym GROUP BY path, start_character")
def distinct_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each place, the first in its file."""
    held = symbols(spark, sf_dir).select("path", "start_character", "start_line")
    return rows.distinct_records(held, ["path", "start_character"], ["start_line"])


@query(
    "merged_modules",
    f"""
    WITH {SYMBOLS} SELECT module, name, path, id FROM (SELECT *, row_number() OVER (PARTITION BY module, name
      ORDER BY CASE string_split(path, '.')[-1] WHEN 'pxd' THEN 1 WHEN 'py' THEN 2 ELSE 3 END, path, id) AS r FROM sym) WHERE r = 1
    """,
)
def merged_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.merge_modules(symbols(spark, sf_dir).select("module", "name", "path", "id"), ("pxd", "py"))


@query(
    "merged_docstrings",
    """
    WITH m AS (SELECT 'm' || p_size AS module, p_brand AS name, p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'pxd' WHEN p_partkey % 3 = 1 THEN 'py' ELSE 'pyx' END AS ext,
      CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN '  ' END AS docstring FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY module, name ORDER BY CASE ext WHEN 'pyx' THEN 1 WHEN 'py' THEN 2 ELSE 3 END, lpad(id::VARCHAR, 9, '0')) AS n FROM m)
    SELECT module, name, min(id) FILTER (n = 1) AS id, coalesce(first(docstring ORDER BY n) FILTER (length(trim(docstring)) > 0), first(docstring) FILTER (n = 1)) AS docstring FROM r GROUP BY 1, 2
    """,
)
def merged_docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several suffixes the implementation, with the declaration's docstring where its own is blank."""
    n = F.col("p_partkey")
    ext = F.when(n % 3 == 0, "pxd").when(n % 3 == 1, "py").otherwise("pyx")
    said = F.when(n % 4 == 0, F.col("p_name")).when(n % 4 == 1, "  ")
    held = table(spark, sf_dir, "part").select(
        F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("module"), F.col("p_brand").alias("name"), n.alias("id"),
        F.concat(F.lpad(n.cast("string"), 9, "0"), F.lit("."), ext).alias("path"), said.alias("docstring"),
    )
    return rows.merge_modules(held, ("pyx", "py"), ["docstring"]).select("module", "name", "id", "docstring")


@query(
    "reranked_symbols",
    f"WITH {SYMBOLS} SELECT path, start_line, name, 1::INTEGER AS level FROM sym WHERE starts_with(lower(name), 'red_')",
)
def reranked_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results once more; what begins with the term here, as nothing equals it."""
    found = search.rerank(symbols(spark, sf_dir).drop("id"), "red_", 1_000_000)
    return found.filter("level < 2").select("path", "start_line", "name", "level")


@query(
    "member_candidate_rows",
    f"WITH {SYMBOLS} SELECT id, owner_type FROM (SELECT id, kind AS owner_type FROM sym ORDER BY (kind = 'function')::INTEGER DESC, (module = 'm.small')::INTEGER DESC, {KIND}, module, path, start_line LIMIT 5)",
)
def member_candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = symbols(spark, sf_dir).withColumn("owner_type", F.col("kind"))
    return search.member_candidates(members, "function", ["m.small"]).select("id", "owner_type")


@query(
    "role_order",
    f"""
    WITH {SYMBOLS}, e AS (SELECT id, string_split(path, '.')[-1] AS x FROM sym)
    SELECT id, list_position(['pyx', 'py', 'pxd', 'pxi'], x)::INTEGER AS implementation, list_position(['pxd', 'pyx', 'py', 'pxi'], x)::INTEGER AS declaration FROM e
    """,
)
def role_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).select("id", *(search.role_rank(F.col("path"), r).alias(r) for r in ("implementation", "declaration")))


@query("search_limits", f"WITH {SYMBOLS}, t AS (SELECT count(*) AS n FROM sym WHERE contains(lower(name), 'r') OR contains(module, 'r')) SELECT g.mode, least(n, g.most)::BIGINT AS n FROM t, (VALUES ('palette', 50), ('workspace', 200), ('all', 1000)) g(mode, most)")
def search_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each mode of search returns for one term."""
    held = symbols(spark, sf_dir)
    parts = [search.ranked_search(held, "r", most).agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "n") for mode, most in search.LIMITS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("reliable_bindings", f"WITH {SYMBOLS} SELECT id, name AS constructor FROM sym WHERE name IN (SELECT name FROM sym WHERE kind = 'class' AND module = 'm.small')")
def reliable_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = symbols(spark, sf_dir)
    return joins.reliable(held.select("id", F.col("name").alias("constructor")), held.filter("kind = 'class' and module = 'm.small'"))


@query("catalogue_members", f"WITH {SYMBOLS} SELECT id, 'Maker' AS owner_type, name AS member FROM sym WHERE module = 'm.small' AND name NOT IN (SELECT name FROM sym WHERE module = 'm.small' AND start_character = 45)")
def catalogue_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries of one module with the symbols that they name, but for members that source rows give."""
    held = symbols(spark, sf_dir)
    entries = held.filter("module = 'm.small'").select(F.lit("Maker").alias("owner_type"), F.col("name").alias("member"), "module", F.col("name").alias("source_name")).distinct()
    taken = held.filter("module = 'm.small' and start_character = 45").select(F.lit("Maker").alias("owner_type"), F.col("name").alias("member"))
    return joins.catalogue_rows(entries, held, taken).select("id", "owner_type", "member")


@query("symbol_lookup", f"WITH {SYMBOLS} SELECT id, name, module FROM (SELECT *, row_number() OVER (ORDER BY {KIND}, CASE WHEN length(trim(coalesce(docstring, ''))) = 0 THEN 1 ELSE 0 END, {EXTENSION}, path, start_line) AS r FROM sym WHERE name = 'red_widget') WHERE r = 1")
def symbol_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = symbols(spark, sf_dir).withColumn("import_from", F.lit(None).cast("string"))
    return joins.lookup(held, "red_widget", rows.best_symbol).select("id", "name", "module")


@query("dense_symbol_ids", f"WITH {SYMBOLS} SELECT id AS part, row_number() OVER (ORDER BY name, module, path, id) - 1 AS dense FROM sym")
def dense_symbol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from 0 in the order of names, without one task that sorts all."""
    held = symbols(spark, sf_dir).select("name", "module", "path", F.col("id").alias("part"))
    return store.dense_ids(held, ["name", "module", "path", "part"], "dense").select("part", "dense")


@query("first_versions", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return store.first_wins(held, ["user_id"], "ts").select("user_id", "event_id")
