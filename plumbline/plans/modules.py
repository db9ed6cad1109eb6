"""Extraction queries over modules that are written from the supplier and nation tables: one file per row.

A supplier's file imports from its nation's, and holds every kind of alias, import and assignment once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import extract
from plumbline.plans.registry import query
from plumbline.sources.tables import table

SUPPLIER = '''"""Supplier {k}."""
from base.nation_{n} import rate, cost as price
import tools.units as units
lazy_import('base.heavy', ['solve', 'plan'], ['solve_it', None])
R.<x, y> = Ring({k})
Rate = rate
best = units.length.best
class Maker(object):
    """Makes {k}."""
    def make(self, n):
        """Makes one."""
        return price(only_{k}(n), n)
    build = make
    length = staticmethod(units.length)
    @matrix_method("shape")
    def shape_of(self, m):
        return rank(m)
Factory = Maker
old_make = deprecated_function_alias({k}, Maker)
limit = {k}
ring = Ring({k})
load("tools_{n}.py")
def only_{k}(z):
    return z
'''
NATION = '''def rate(x):
    """Rate of {k}."""
    return x
def cost(x, y):
    """Cost in {k}."""
    return x * y
'''
FILES = """
    s AS (SELECT s_suppkey AS k, s_nationkey AS n, 'supply.s_' || s_suppkey AS m, '/lib/supply/s_' || s_suppkey || '.py' AS p FROM supplier),
    b AS (SELECT n_nationkey AS n, n_name AS name, 'base.nation_' || n_nationkey AS m, '/lib/base/nation_' || n_nationkey || '.py' AS p FROM nation)
"""


def module_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, module, fingerprint and text of a file per supplier."""
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    text = F.replace(F.replace(F.lit(SUPPLIER), F.lit("{k}"), key), F.lit("{n}"), nation)
    return _files(table(spark, sf_dir, "supplier"), "supply/s_", key, text)


def base_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, module, fingerprint and text of a file per nation."""
    key = F.col("n_nationkey").cast("string")
    return _files(table(spark, sf_dir, "nation"), "base/nation_", key, F.replace(F.lit(NATION), F.lit("{k}"), F.col("n_name")))


def _files(rows: DataFrame, stem: str, key, text) -> DataFrame:
    named = F.concat(F.lit(stem), key)
    made = rows.select(F.concat(F.lit("/lib/"), named, F.lit(".py")).alias("path"), F.translate(named, "/", ".").alias("module"), text.alias("text"))
    return made.select("path", "module", F.md5("text").alias("fingerprint"), "text")


def symbols(spark: SparkSession, sf_dir: str, which: str, *columns: str) -> DataFrame:
    """Symbol rows of the suppliers' files that ``which`` is true of."""
    return extract.symbols_of(extract.symbol_rows(module_texts(spark, sf_dir))).filter(which).select(*columns)


@query("module_rows", f"WITH {FILES} SELECT m AS module, m AS name, p AS path, 'Supplier ' || k || '.' AS docstring, 0::INTEGER AS start_line FROM s")
def module_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir, "kind = 'module'", "module", "name", "path", "docstring", "start_line")


@query(
    "method_aliases",
    f"WITH {FILES} SELECT m AS module, 'build' AS name, m || '::Maker.make' AS import_from, 'make(self, n)' AS signature, 'Makes one.' AS docstring, 'Maker' AS owner, 12::INTEGER AS start_line FROM s",
)
def method_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir, "startswith(detail, 'MethodAlias Maker.')", "module", "name", "import_from", "signature", "docstring", "owner", "start_line")


@query(
    "decorator_aliases",
    f"WITH {FILES} SELECT m AS module, 'shape' AS name, 'MethodAlias matrix.shape for shape_of' AS detail, m || '::shape_of' AS import_from, 15::INTEGER AS start_line, 8::INTEGER AS start_character FROM s",
)
def decorator_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir, "startswith(detail, 'MethodAlias matrix.')", "module", "name", "detail", "import_from", "start_line", "start_character")


@query(
    "generator_rows",
    f"""
    WITH {FILES} SELECT m AS module, g.name, g.detail, g.c AS start_character FROM s,
      (VALUES ('R', 'Variable R', 0::INTEGER), ('x', 'Generator x of R', 3::INTEGER), ('y', 'Generator y of R', 6::INTEGER)) g(name, detail, c)
    """,
)
def generator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir, "kind = 'variable' and start_line = 4", "module", "name", "detail", "start_character")


@query(
    "assigned_names",
    f"WITH {FILES} SELECT m AS module, g.name, g.line AS start_line FROM s, (VALUES ('limit', 19::INTEGER), ('ring', 20::INTEGER)) g(name, line)",
)
def assigned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir, "kind = 'variable' and start_line <> 4", "module", "name", "start_line")


@query(
    "import_rows",
    f"""
    WITH {FILES} SELECT m AS module, 'rate' AS name, 'Import base.nation_' || n || '.rate' AS detail, 'base.nation_' || n || '::rate' AS import_from, 1::INTEGER AS start_line FROM s
    UNION ALL SELECT m, 'price', 'Import base.nation_' || n || '.cost', 'base.nation_' || n || '::cost', 1 FROM s
    UNION ALL SELECT m, 'units', 'Import tools.units', 'tools.units', 2 FROM s
    """,
)
def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir, "kind = 'import' and start_line in (1, 2)", "module", "name", "detail", "import_from", "start_line")


@query(
    "lazy_import_rows",
    f"""
    WITH {FILES} SELECT m AS module, g.name, 'Import base.heavy.' || g.own AS detail, 'base.heavy::' || g.own AS import_from FROM s,
      (VALUES ('solve_it', 'solve'), ('plan', 'plan')) g(name, own)
    """,
)
def lazy_import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir, "kind = 'import' and start_line = 3", "module", "name", "detail", "import_from")


def _alias(name: str, line: int, target: str) -> None:
    """A query for the one alias of a kind that every file has on a line; ``target`` is SQL."""

    def found(spark: SparkSession, sf_dir: str) -> DataFrame:
        return symbols(spark, sf_dir, f"kind = 'import' and start_line = {line}", "module", "name", "import_from")

    own = SUPPLIER.split("\n")[line].split("=")[0].strip()
    query(name, f"WITH {FILES} SELECT m AS module, '{own}' AS name, {target} AS import_from FROM s")(found)


_alias("import_aliases", 5, "'base.nation_' || n || '::rate'")
_alias("member_aliases", 6, "'tools.units.length::best'")
_alias("static_aliases", 13, "'tools.units::length'")
_alias("definition_aliases", 17, "m || '::Maker'")
_alias("deprecated_aliases", 18, "m || '::Maker'")


@query(
    "constructor_hints",
    f"WITH {FILES} SELECT p AS path, 20::INTEGER AS start_line, 4::INTEGER AS start_character, ': ring' AS label FROM s",
)
def constructor_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.hints(module_texts(spark, sf_dir), {"Ring": ": ring"}).select("path", "start_line", "start_character", "label")


@query(
    "inferred_types",
    f"""
    WITH {FILES} SELECT p AS path, g.name, g.line, g.type FROM s,
      (VALUES ('R', 4::INTEGER, 'ring'), ('x', 4::INTEGER, 'element of ring'), ('y', 4::INTEGER, 'element of ring'), ('ring', 20::INTEGER, 'ring')) g(name, line, type)
    """,
)
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.types(module_texts(spark, sf_dir), {"Ring": "ring"})


@query(
    "document_links",
    f"WITH {FILES} SELECT p AS path, 21::INTEGER AS start_line, 6::INTEGER AS start_character, (15 + length(n::VARCHAR))::INTEGER AS end_character, '/lib/supply/tools_' || n || '.py' AS label FROM s",
)
def document_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.links(module_texts(spark, sf_dir)).select("path", "start_line", "start_character", "end_character", "label")


@query("load_targets", f"WITH {FILES} SELECT p AS path, '/lib/supply/tools_' || n || '.py' AS target, 21::INTEGER AS load_line FROM s")
def load_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.loads(module_texts(spark, sf_dir))


@query(
    "single_name_references",
    f"WITH {FILES} SELECT p AS path, g.line AS start_line, g.c AS start_character FROM s, (VALUES (2::INTEGER, 13::INTEGER), (2, 22), (6, 7), (13, 26)) g(line, c)",
)
def single_name_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.references_to(module_texts(spark, sf_dir), "units").select("path", "start_line", "start_character")


@query(
    "scope_rows",
    f"""
    WITH {FILES} SELECT p AS path, g.scope, g.kind AS scope_kind, g.a AS first_line, g.b AS last_line, g.parent FROM s,
      (VALUES ('Maker', 'class', 7::INTEGER, 16::INTEGER, ''), ('Maker/make', 'function', 9, 11, 'Maker'), ('Maker/shape_of', 'function', 15, 16, 'Maker')) g(scope, kind, a, b, parent)
    UNION ALL SELECT p, 'only_' || k, 'function', 22, 23, '' FROM s
    UNION ALL SELECT p, '', 'module', 0, 24, '' FROM s
    """,
)
def scope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.scopes(module_texts(spark, sf_dir))


def _places(spark: SparkSession, sf_dir: str, line: int, column: int) -> DataFrame:
    """Every supplier's file with one place of it."""
    return module_texts(spark, sf_dir).select("path", "text", F.lit(line).alias("line"), F.lit(column).alias("column"))


@query("call_contexts", f"WITH {FILES} SELECT p AS path, 'price' AS callee, 1::INTEGER AS argument FROM s")
def call_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call that is open before the last ``n`` of line 11: the second argument of the outer one."""
    texts = module_texts(spark, sf_dir)
    line = F.get(F.split("text", "\n"), F.lit(11))
    return extract.call_contexts(texts.select("path", "text", F.lit(11).alias("line"), (F.length(line) - 2).alias("column")))


@query("words_at_places", f"WITH {FILES} SELECT p AS path, 'units' AS word, 'units.length' AS dotted FROM s")
def words_at_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = extract.words(_places(spark, sf_dir, 6, 9)).withColumnRenamed("word", "plain")
    dotted = extract.words(_places(spark, sf_dir, 6, 15), dotted=True).withColumnRenamed("word", "dotted")
    return plain.withColumnRenamed("plain", "word").join(dotted, "path")


@query(
    "highlighted_places",
    f"WITH {FILES} SELECT p AS path, g.line AS start_line, g.c AS start_character FROM s, (VALUES (7::INTEGER, 6::INTEGER), (17, 10)) g(line, c) UNION ALL SELECT p, 18, (39 + length(k::VARCHAR))::INTEGER FROM s",
)
def highlighted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of the word at line 7: the class and its two other names."""
    return extract.highlights(_places(spark, sf_dir, 7, 8)).select("path", "start_line", "start_character")


@query(
    "selection_ranges",
    f"""
    WITH {FILES} SELECT p AS path, g.rank, g.a AS start_line, g.b AS end_line FROM s,
      (VALUES (0::INTEGER, 9::INTEGER, 9::INTEGER), (1, 9, 9), (2, 9, 11), (3, 7, 16), (4, 0, 24)) g(rank, a, b)
    """,
)
def selection_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the method's name over its line, its block and its class to the file."""
    return extract.selections(_places(spark, sf_dir, 9, 9)).select("path", "rank", "start_line", "end_line")


@query(
    "signature_parameters",
    f"WITH {FILES} SELECT m AS module, g.name, g.rank, g.a AS start, g.b AS stop FROM s, (VALUES ('make', 0::INTEGER, 5::INTEGER, 9::INTEGER), ('make', 1, 11, 12), ('shape_of', 0, 9, 13), ('shape_of', 1, 15, 16)) g(name, rank, a, b)",
)
def signature_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.parameter_spans(symbols(spark, sf_dir, "kind = 'method'", "module", "name", "signature"))


@query(
    "quick_fixes",
    f"WITH {FILES} SELECT p AS path, 'Use ** for powers' AS title, 23::INTEGER AS start_line, 13::INTEGER AS start_character, '**' AS replacement FROM s",
)
def quick_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file gets a caret in its last line; the one fix answers it."""
    texts = module_texts(spark, sf_dir).withColumn("text", F.replace("text", F.lit("return z"), F.lit("return z ^ 2")))
    return extract.fixes(texts).select("path", "title", "start_line", "start_character", "replacement")
