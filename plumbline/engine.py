"""The index as a whole: build and reconcile it, then ask it.

Answers are DataFrames, so a caller's selection prunes what is computed (that is what feature flags are elsewhere: an
answer's unused parts cost nothing). ``Engine.query`` is the command surface: a name and parameters.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import bloom, source, text
from plumbline.operators import bindings, extract, joins, rows, search, sets
from plumbline.session import shared_folder, unsent
from plumbline.sources import files
from plumbline.sources.store import PER_PATH, Store
from plumbline.streaming import changes

#: What each preset of features computes.
PRESETS = {
    "full": ("definition", "documentation", "references", "signature", "diagnostics", "completion"),
    "navigation": ("definition", "references"),
    "hover": ("definition", "documentation"),
    "definition_only": ("definition",),
}
#: Names that every text knows.
BUILTINS = ("abs", "all", "any", "bool", "dict", "enumerate", "float", "int", "isinstance", "len", "list", "map", "max", "min", "print", "range", "set", "sorted", "str", "sum", "tuple", "type", "zip")
IDENTITY = ("d_name", "d_module", "d_path", "d_start_line")


def enclosing(points: DataFrame, outline: DataFrame, line: str) -> DataFrame:
    """``points`` with the name of the innermost outlined symbol of the same path around their line."""
    spans = outline.filter("kind in ('function', 'method', 'class', 'cython')").select("path", F.col("first_line").alias("start"), F.col("last_line").alias("end"), F.col("name").alias("label"))
    shared_folder(points.sparkSession)
    spans = spans.checkpoint()  # made by Python once, read several times
    return joins.innermost(points, spans, "path", line).withColumnRenamed("label", "caller").drop("start", "end")


def incoming_calls(calls: DataFrame, outline: DataFrame) -> DataFrame:
    """callee, caller, path, n_calls and ranges: who calls what from where."""
    points = calls.select("path", F.element_at(F.split("label", r"\."), -1).alias("callee"), F.col("start_line").alias("line"), F.col("start_character").alias("column"))
    return rows.call_groups(enclosing(points, outline, "line"), ["callee", "caller", "path"], "line", "column")


def builtin_rows(spark: SparkSession, names: Sequence[str] = BUILTINS) -> DataFrame:
    return spark.createDataFrame([(n, "builtin", "builtins", f"Builtin {n}") for n in names], "name string, kind string, module string, detail string")


class Engine:
    """An index of source roots in a store."""

    def __init__(
        self, spark: SparkSession, folder: str, roots: Sequence[str], editable: Sequence[str] = (), excludes: Sequence[str] = (), with_cython: bool = True
    ) -> None:
        self.spark, self.roots, self.editable = spark, list(roots), list(editable)
        self.excludes, self.with_cython = list(excludes), with_cython
        self.store = Store(spark, f"{folder}/{files.namespace('1', roots, excludes, with_cython)}")
        self.generation = 0
        self.timings: dict[str, float] = {}

    # Build and refresh

    def listing(self) -> DataFrame:
        return files.listing(self.spark, self.roots, self.excludes, self.with_cython)

    def listed(self, paths: DataFrame) -> DataFrame:
        """The listing of some paths alone, as far as they are files of the engine; executors look at them."""
        return files.listed(paths, self.roots, self.excludes, self.with_cython)

    def texts(self, listed: DataFrame | None = None) -> DataFrame:
        """path, module, fingerprint and text of files, read when they are needed."""
        held = files.read_texts(self.listing() if listed is None else listed)
        return held.withColumn("module", text.module_of_path(F.col("path"), F.col("root")))

    def reconcile(self) -> dict[str, int]:
        """Bring the store up to the files: parse what is new or changed, delete what is gone, leave the rest."""
        with unsent(self.spark):
            return self._reconcile()

    def _reconcile(self) -> dict[str, int]:
        began = time.time()
        self.store.create()
        listed = self.listing()
        diff = changes.snapshot_diff(self.store.read("files").select("path", "fingerprint"), listed.select("path", "fingerprint")).cache()
        counts = {r["op"]: r["count"] for r in diff.groupBy("op").count().collect()}
        stale = diff.filter("op <> 'unchanged'").select("path")
        # Stores that were cut short have files without rows; such files are parsed again.
        hollow = self.store.read("files").select("path").join(self.store.read("symbols").select("path"), "path", "left_anti")
        stale = stale.unionByName(hollow).distinct()
        if not stale.isEmpty():
            self._refresh(listed.join(stale, "path", "left_semi"), stale)
        diff.unpersist()
        self.timings["reconcile"] = time.time() - began
        return counts

    def _refresh(self, listed: DataFrame, stale: DataFrame) -> None:
        """Parse ``listed`` and put the rows in the place of those of the ``stale`` paths; what other paths have is not touched."""
        parsed = extract.parsed(self.texts(listed)).checkpoint()
        before = {name: self.store.of_paths(name, stale) for name in ("files", "symbols", "docs")}
        if parsed.isEmpty() and before["files"].isEmpty():
            return  # only files that can't be read, which the store doesn't have
        tables = {
            "files": extract.files_of(parsed),
            "symbols": extract.symbols_of(parsed).drop("docstring", "owner"),
            "docs": extract.docs_of(parsed),
            "reference_spans": extract.spans_of(parsed, self.editable or None).drop("module"),
        }
        marks = self.root_marks()
        # Readers see the new rows, exports and counters together.
        with self.store.transaction():
            known = self.store.read("index_root_metadata").select("root")
            unknown = marks.join(known, "root", "left_anti")
            counted = unknown.isEmpty()
            moved = self._moved_counts(before, tables).checkpoint() if counted else None
            same = all(_same(before[name], tables[name]) for name in ("symbols", "docs"))
            self.store.upsert_paths(tables, stale)
            if not same:
                self.store.replace({"export_table": self.resolved_exports()})
            if counted:
                self.store.move_all_counters(moved)
                self.store.mark_roots(marks)
            else:
                self.store.refresh_counters(marks)
        self.generation += 1

    def root_marks(self) -> DataFrame:
        """root, root_fingerprint and root_marker of the engine's roots."""
        return files.root_marks(self.spark, self.roots)

    def _moved_counts(self, before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
        """By how much the rows of some paths move the counters of every root."""
        roots = self.spark.createDataFrame([(r,) for r in self.roots], "root string")
        out = roots
        for counter, name, said in (("file_count", "files", "true"), ("symbol_count", "symbols", "true"), ("doc_count", "docs", "detail <> 'module' and length(trim(docstring)) > 0")):
            new, old = (rows.count_by_root(held[name].filter(said), roots) for held in (after, before))
            delta = new.join(old.withColumnRenamed("n", "_old"), "root").select("root", (F.col("n") - F.col("_old")).alias(counter))
            out = out.join(delta, "root")
        return out

    def apply_events(self, events: DataFrame) -> None:
        """Changed paths are parsed again and deleted ones go; what is unchanged by fingerprint stays."""
        self.store.create()
        newest = changes.latest(changes.change_events(events))
        stale = newest.select("path").distinct()
        with unsent(self.spark):
            self._refresh(self.listed(newest.filter("op = 'changed'")), stale)

    def watch(self, stream: DataFrame, checkpoint: str):
        """Refresh from a stream of (path, event, version)."""
        return changes.watch(stream, lambda batch, _: self.apply_events(batch.select("path", F.col("op").alias("event"), "version")), checkpoint)

    # Tables

    def symbols(self) -> DataFrame:
        return self.store.read("symbols")

    def documented(self) -> DataFrame:
        return joins.with_first_doc(self.symbols(), self.store.read("docs"), ["path", "module", "name", "detail"], ["docstring"])

    def resolved_exports(self) -> DataFrame:
        """public_name of every module after re-exports, with the definition that it leads to."""
        symbols = self.symbols()
        listed = symbols.filter("detail = 'Export'").select("module", "name")
        marked = listed.select("module").distinct()
        own = symbols.filter("kind <> 'module' and detail <> 'Export' and name <> '*' and not startswith(name, '_') and not startswith(detail, 'Method')")
        free = own.join(marked, "module", "left_anti").select("module", "name")
        exports = listed.unionByName(free).distinct().withColumn("origin", F.col("module"))
        spread = joins.spread_exports(exports, joins.star_edges(symbols.filter("name = '*'")))
        asked = spread.select(F.col("module").alias("import_module"), F.col("name").alias("public_name"), F.concat_ws("::", "origin", "name").alias("import_from"))
        found = joins.follow_imports(asked, symbols.filter("detail <> 'Export' and kind <> 'module'"), ["s_path", "s_start_line"]).filter("s_name is not null")
        named = [F.col(f"s_{c}").alias(c) for c in symbols.columns]
        reason = F.when(F.col("resolved"), "definition").otherwise("import").alias("reason")
        told = found.select("public_name", F.col("s_name").alias("source_name"), "import_module", reason, *named)
        return joins.with_first_doc(told, self.store.read("docs"), ["path", "module", "name", "detail"], ["docstring"])

    def method_table(self, catalogue: DataFrame, owners: DataFrame) -> DataFrame:
        """Members by owner type: classified by module (``owners``: prefix, label, priority), else from a catalogue."""
        methods = self.documented().filter(text.is_method(F.col("kind"), F.col("name"), F.col("signature")))
        typed = joins.classify(methods, "module", owners).filter("label is not null").withColumnsRenamed({"label": "owner_type"}).withColumn("member", F.col("name"))
        best = rows.best_symbol(typed, ["owner_type", "member"]).withColumn("origin", F.lit("source"))
        static = joins.catalogue_rows(catalogue, self.documented(), best).withColumn("origin", F.lit("static")).withColumnRenamed("source_name", "name")
        return best.unionByName(static.select(*best.columns))

    # Answers

    def status(self) -> DataFrame:
        """One row: counters over the outermost roots, and the generation."""
        held = self.store.read("index_root_metadata")
        outer = held.join(rows.outermost_roots(held), "root", "left_semi")
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("file_count", "symbol_count", "doc_count")]
        return outer.agg(*sums, F.max("updated_at").alias("updated_at")).withColumn("generation", F.lit(self.generation))

    def search(self, term: str, mode: str = "workspace") -> DataFrame:
        held = self.symbols().filter("kind <> 'module' and name <> '*'")
        low = F.lower("name")
        strong = held.filter("kind <> 'import'").select(low.alias("label")).distinct()
        noise = held.filter("kind = 'import'").withColumn("label", low).join(strong, "label", "left_anti").drop("label")
        kept = held.filter("kind <> 'import'").unionByName(noise)
        return search.ranked_search(kept, term, search.LIMITS[mode], tie_breakers=("path", "start_line", "start_character"))

    def completion(self, prefix: str, path: str | None = None, limit: int = 100) -> DataFrame:
        """Names of the file itself first, then of the index, then builtins; one row per label."""
        columns = ["name", "kind", "module", "detail"]
        held = search.prefix_filter(self.symbols(), prefix).filter("kind <> 'module' and name <> '*' and detail <> 'Export'")
        best = lambda df: rows.best_per_key(df, ["name"], [search.kind_rank(F.col("kind")), "path", "start_line"]).select(*columns)
        parts = [best(held.filter(F.col("path") == path))] if path else []
        found = sets.first_wins([*parts, best(held), builtin_rows(self.spark)], "name", prefix)
        return found.orderBy(F.length("name"), "name").limit(limit)

    def bound(self, name: str) -> DataFrame:
        """path and the definition that ``name`` means there: its own symbol, or what its import leads to."""
        held = self.symbols().filter((F.col("name") == name) & (F.col("detail") != "Export") & (F.col("kind") != "module"))
        own = held.filter("import_from is null")
        local = rows.best_per_key(own, ["path"], ["start_line", "start_character"])
        told = local.select("path", F.col("name").alias("d_name"), F.col("module").alias("d_module"), F.col("path").alias("d_path"), F.col("start_line").alias("d_start_line"))
        asked = rows.best_per_key(held.filter("import_from is not null"), ["path"], ["start_line"]).join(own.select("path"), "path", "left_anti")
        found = joins.follow_imports(asked.select("path", "import_from"), self.symbols().filter("detail <> 'Export'"), ["s_path", "s_start_line"]).filter("resolved")
        far = found.select("path", F.col("s_name").alias("d_name"), F.col("s_module").alias("d_module"), F.col("s_path").alias("d_path"), F.col("s_start_line").alias("d_start_line"))
        return told.unionByName(far)

    def definition(self, name: str, path: str | None = None, module: str | None = None, role: str = "any") -> DataFrame:
        """The definition of a name with its tier and confidence: one row of high confidence, or up to five candidates.

        Tiers: what the file binds; an export of the hinted module; a symbol of the hinted module; any export; any
        symbol. The first tier that answers is taken, a later one never mixes in.
        """
        symbols = self.symbols().filter("detail <> 'Export' and kind <> 'module'")
        tiers: list[DataFrame] = []
        if path:
            here = self.bound(name).filter(F.col("path") == path)
            tiers.append(here.join(symbols.withColumnsRenamed({"path": "s_path"}), (F.col("d_path") == F.col("s_path")) & (F.col("d_name") == F.col("name")) & (F.col("d_start_line") == F.col("start_line"))).select("name", "kind", "module", F.col("s_path").alias("path"), "start_line", "start_character", "detail", "signature"))
        columns = ["name", "kind", "module", "path", "start_line", "start_character", "detail", "signature"]
        exports = self.store.read("export_table").filter(F.col("public_name") == name)
        own = symbols.filter((F.col("name") == name) & F.col("import_from").isNull())
        if module:
            tiers += [exports.filter(F.col("import_module") == module).select(*columns), own.filter(F.col("module") == module).select(*columns)]
        tiers += [exports.select(*columns), own.select(*columns)]
        tagged = reduce(DataFrame.unionByName, [t.select(*columns).withColumn("tier", F.lit(n)) for n, t in enumerate(tiers)])
        one = rows.best_per_key(tagged, ["path", "start_line", "start_character", "name"], ["tier"])
        least = one.agg(F.min("tier").alias("tier"))
        first = one.join(F.broadcast(least), "tier", "left_semi")
        total = first.agg((F.count("*") == 1).alias("_single"))
        told = first.join(F.broadcast(total)).withColumn("confidence", F.when(F.col("_single"), "high").otherwise("low")).drop("_single")
        return told.orderBy(search.role_rank(F.col("path"), role), search.kind_rank(F.col("kind")), "path", "start_line").limit(5)

    def references(self, name: str, target: DataFrame, mode: str = "references", with_declaration: bool = True) -> DataFrame:
        """Places in code where ``name`` means the target (a definition row): filter, scan, then identity.

        Files whose filter can't hold the name aren't read. A local symbol of the same name hides the target. Rename
        sees editable roots only.
        """
        may = self.store.read("files").filter(bloom.may_contain_expr(F.col("identifier_filter"), name)).select("path", "fingerprint")
        listed = self.listing()
        if mode == "rename":
            listed = joins.below_roots(listed, self.spark.createDataFrame([(r,) for r in self.editable], "root string"))
        # Files that changed behind the store are read whatever their filter said.
        known = self.store.read("files").select("path", "fingerprint")
        stale = listed.join(known.hint("merge"), ["path", "fingerprint"], "left_anti").select("path")
        scanned = listed.join(may.select("path").unionByName(stale).distinct().hint("merge"), "path", "left_semi")
        hits = extract.references_to(self.texts(scanned), name)
        wanted = target.select(F.col("name").alias("d_name"), F.col("module").alias("d_module"), F.col("path").alias("d_path"), F.col("start_line").alias("d_start_line"))
        same = self.bound(name).join(wanted.distinct(), list(IDENTITY), "left_semi").select("path")
        found = hits.join(same.distinct().hint("merge"), "path", "left_semi").drop("label")
        if not with_declaration:
            found = found.join(target.select("path", "start_line", "start_character"), ["path", "start_line", "start_character"], "left_anti")
        return rows.best_per_key(found, ["path", "start_line", "start_character"], ["end_line", "end_character"]).orderBy("path", "start_line", "start_character")

    def rename(self, name: str, new: str, target: DataFrame) -> DataFrame:
        """Edits per editable file (a file's own text bounds the list)."""
        if not source.re.fullmatch(source.ASCII_WORD, new) or new in source.KEYWORDS:
            raise ValueError(f"{new!r} is no name")
        found = self.references(name, target, "rename")
        edit = F.struct("start_line", "start_character", "end_line", "end_character", F.lit(new).alias("text"))
        return found.groupBy("path").agg(F.sort_array(F.collect_list(edit)).alias("edits"))

    def documentation(self, name: str, prefer: str = "auto") -> DataFrame:
        """name, docstring and where it comes from: an export, the workspace, runtime, or a placeholder."""
        said = lambda df, origin, order: df.filter(text.is_specific(F.col("docstring"))).select(F.lit(name).alias("name"), "docstring", F.lit(origin).alias("origin"), F.lit(order).alias("_order"))
        runtime = self.store.read("runtime_docs").filter((F.col("name") == name) | (F.col("symbol") == name))
        borrowed = self.store.read("docs").filter(F.col("name").isin(f"{name}Factory", f"{name}_class"))
        order = {"auto": (0, 1, 2), "runtime": (1, 2, 0), "workspace": (1, 0, 2), "reference": (0, 1, 2)}[prefer]
        parts = [
            said(self.store.read("export_table").filter(F.col("public_name") == name), "reference", order[0]),
            said(self.store.read("docs").filter(F.col("name") == name), "workspace", order[1]),
            said(runtime, "runtime", order[2]),
            said(borrowed, "factory", 3),
            self.spark.createDataFrame([(name, "no documentation available", "placeholder", 9)], "name string, docstring string, origin string, _order int"),
        ]
        return rows.best_per_key(reduce(DataFrame.unionByName, parts), ["name"], ["_order", "docstring"]).drop("_order").withColumn("summary", text.summary(F.col("docstring")))

    def signature_help(self, document: str, line: int, column: int) -> DataFrame:
        """The signature of the call that is open at a place, the spans of its parameters, and the active one."""
        code = source.Code(document)
        call = source.call_at(code, code.offset(line, column))
        found = self.definition(call[0].split(".")[-1] if call else "").filter("signature is not null")
        named = extract.with_parameters(found if call else found.limit(0))
        return named.withColumn("active", F.lit(call[1] if call else 0))

    def type_definition(self, document: str, name: str, line: int, constructors: dict[str, str]) -> DataFrame:
        """The class that a name's inferred type names, at a line."""
        seen = [t for n, at, t in source.inferred_types(source.Code(document), constructors) if n == name and at <= line]
        kind = seen[-1].removeprefix("element of ") if seen else ""
        return self.definition(kind).filter("kind = 'class'")

    def member(self, owner: str, name: str, path: str | None = None, members: DataFrame | None = None) -> DataFrame:
        """``owner.name``: a member of an imported module, a method of a class, a catalogue member of an owner type."""
        symbols = self.symbols()
        spaces = symbols.filter((F.col("name") == owner) & F.col("import_from").isNotNull())
        if path:
            spaces = spaces.filter(F.col("path") == path)
        module = F.replace("import_from", F.lit("::"), F.lit("."))
        inside = spaces.select(module.alias("module")).distinct().join(symbols.filter(F.col("name") == name), "module")
        methods = symbols.filter((F.col("name") == name) & (F.col("detail") == f"Method {owner}.{name}"))
        columns = ["name", "kind", "module", "path", "start_line", "detail", "signature"]
        parts = [inside.select(*columns), methods.select(*columns)]
        if members is not None:
            parts.append(members.filter((F.col("owner_type") == owner) & (F.col("member") == name)).select(*columns))
        tagged = reduce(DataFrame.unionByName, [p.withColumn("tier", F.lit(n)) for n, p in enumerate(parts)])
        return rows.best_per_key(tagged, ["name"], ["tier", "path", "start_line"])

    def outgoing_calls(self, paths: DataFrame) -> DataFrame:
        """Calls from the symbols of some paths to definitions that their name alone decides, with their places."""
        texts = self.texts(self.listing().join(paths.select("path").distinct().hint("merge"), "path", "left_semi"))
        calls = extract.calls(texts).select("path", F.element_at(F.split("label", r"\."), -1).alias("callee"), F.col("start_line").alias("line"), F.col("start_character").alias("column"))
        own = self.symbols().filter("import_from is null and kind in ('function', 'method', 'class', 'cython')")
        sure = own.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("_n"), F.min("path").alias("callee_path")).filter("_n = 1").drop("_n")
        placed = enclosing(calls, extract.outline(texts), "line").join(sure.hint("merge"), "callee")
        return rows.call_groups(placed, ["path", "caller", "callee", "callee_path"], "line", "column")

    def incoming_calls(self, name: str, target: DataFrame) -> DataFrame:
        """Callers of a definition: references that are calls, inside which symbol."""
        found = self.references(name, target, with_declaration=False).select("path", "start_line", "start_character").checkpoint()
        texts = self.texts(self.listing().join(found.select("path").distinct(), "path", "left_semi"))
        calls = extract.calls(texts).join(found, ["path", "start_line", "start_character"], "left_semi")
        return incoming_calls(calls, extract.outline(texts))

    def import_candidates(self, name: str, limit: int = 100) -> DataFrame:
        """Modules that export a name, shorter ones first."""
        held = self.store.read("export_table").filter(F.col("public_name") == name).select(F.col("import_module").alias("module"), "reason").distinct()
        return held.orderBy(F.size(F.split("module", r"\.")), "module").limit(limit)

    def unresolved_imports(self) -> DataFrame:
        """Imports whose module isn't indexed, and imports of names that their module lacks."""
        symbols = self.symbols()
        module, name = joins.split_import(F.col("import_from"))
        asked = symbols.filter("kind = 'import' and name <> '*' and detail <> 'Export' and not startswith(detail, 'MethodAlias')")
        held = asked.select("path", "start_line", "name", module.alias("module"), name.alias("wanted"), F.contains("import_from", F.lit("::")).alias("_named"))
        modules = symbols.select("module").distinct()
        names = symbols.filter("kind <> 'module'").select("module", F.col("name").alias("wanted")).distinct()
        inner = symbols.filter("kind = 'module'").select(F.col("module").alias("_m"))
        no_module = held.join(modules, "module", "left_anti").withColumn("code", F.lit("module-missing"))
        no_name = held.filter("_named").join(modules, "module", "left_semi").join(names, ["module", "wanted"], "left_anti")
        no_name = no_name.join(inner, F.concat_ws(".", "module", "wanted") == F.col("_m"), "left_anti").withColumn("code", F.lit("name-missing"))
        return no_module.unionByName(no_name).select("path", "start_line", "name", "module", "wanted", "code")

    def batch(self, positions: DataFrame) -> DataFrame:
        """Many places (path, line, column) at once: the word at each and what it means there, with one parse per file."""
        asked = positions.groupBy("path").agg(F.collect_list(F.struct("line", "column")).alias("asked"))
        texts = self.texts(self.listing()).join(asked, "path").select("path", "text", "asked")

        def words(path, document, places):
            code = source.Code(document)
            for p in places:
                yield path, p["line"], p["column"], source.word_at(code, code.offset(p["line"], p["column"]))

        told = extract.each_text(texts, "path string, line int, column int, name string", words).filter("name <> ''")
        own = self.symbols().filter("import_from is null and kind <> 'module'").select("path", "name", F.col("start_line").alias("d_line"), F.col("path").alias("d_path"))
        first = rows.best_per_key(own, ["path", "name"], ["d_line"])
        imports = rows.best_per_key(self.symbols().filter("import_from is not null and detail <> 'Export'").select("path", "name", "import_from", "start_line"), ["path", "name"], ["start_line"])
        asked_names = told.select("path", "name").distinct()
        open_ = imports.join(asked_names, ["path", "name"], "left_semi").join(first, ["path", "name"], "left_anti").drop("start_line")
        far = joins.follow_imports(open_, self.symbols().filter("detail <> 'Export'"), ["s_path", "s_start_line"]).filter("resolved")
        meant = first.unionByName(far.select("path", "name", F.col("s_start_line").alias("d_line"), F.col("s_path").alias("d_path")))
        return told.join(meant, ["path", "name"], "left")

    def seen(self, places: DataFrame) -> DataFrame:
        """What names mean at places (path, line, name) of their own files: binding_line, relation, sure_line and is_parameter.

        Scopes, blocks and bindings are taken from the texts of those files alone.
        """
        texts = self.texts(self.listed(places))
        lines = bindings.logical_lines(texts).checkpoint()
        scopes = bindings.scopes_of(lines)
        bound = bindings.bindings_of(lines, scopes).withColumn("parameter", F.col("is_parameter"))
        asked = places.select("path", "name", F.col("line").alias("at")).distinct()
        found = bindings.seen_bindings(asked, bound, scopes, bindings.blocks_of(lines), payload=["parameter"])
        return found.select(
            "path", "name", F.col("at").alias("line"), F.col("binding_at").alias("binding_line"), "relation", F.col("sure_at").alias("sure_line"), F.col("parameter").alias("is_parameter")
        )

    def query(self, command: str, **parameters) -> DataFrame:
        """The command surface; parameters are the method's own."""
        known = ("status", "search", "completion", "definition", "references", "rename", "documentation", "signature_help", "type_definition", "member", "outgoing_calls", "incoming_calls", "import_candidates", "unresolved_imports", "batch", "seen")
        if command not in known:
            raise ValueError(f"unknown command {command!r}; known: {', '.join(known)}")
        return getattr(self, command)(**parameters)

    def answers(self, name: str, preset: str = "full", **parameters) -> dict[str, DataFrame]:
        """The parts of a preset for one name, none of them computed before it is read."""
        wanted = PRESETS[preset]
        found = self.definition(name, **parameters)
        parts = {"definition": lambda: found, "documentation": lambda: self.documentation(name), "references": lambda: self.references(name, found), "signature": lambda: found.select("name", "signature"), "completion": lambda: self.completion(name), "diagnostics": lambda: extract.diagnostics(self.texts())}
        return {p: parts[p]() for p in wanted}


def _same(old: DataFrame, new: DataFrame) -> bool:
    """Whether both hold the same rows, as often, by the columns of ``new``."""
    held = old.select(*new.columns)
    return held.exceptAll(new).isEmpty() and new.exceptAll(held).isEmpty()


class TextsEngine(Engine):
    """An index of the texts of a table (path, fingerprint, text), all below one root, instead of files on disk.

    The root is a name: nothing of it is looked up on any machine, and its fingerprint is that of its texts.
    """

    def __init__(self, spark: SparkSession, folder: str, texts: DataFrame, root: str, editable: Sequence[str] = ()) -> None:
        self.spark, self.roots, self.editable, self.excludes, self.with_cython = spark, [root], list(editable), [], True
        self.store = Store(spark, f"{folder}/texts-{hashlib.sha256(root.encode()).hexdigest()[:24]}")
        self.generation = 0
        self.timings = {}
        self.held = texts.select("path", F.lit(root).alias("root"), F.octet_length("text").cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"), "fingerprint", "text")

    def listing(self) -> DataFrame:
        return self.held.drop("text")

    def listed(self, paths: DataFrame) -> DataFrame:
        return self.listing().join(paths.select("path").distinct().hint("merge"), "path", "left_semi")

    def root_marks(self) -> DataFrame:
        """The number of texts and the sum of their digests, modulo 2^64, whatever their order."""
        digest = F.conv(F.substring(F.md5(F.concat_ws("\n", "path", "fingerprint")), 1, 15), 16, 10).cast("decimal(20,0)")
        print_ = F.substring(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(digest), F.lit(0)).cast("string")), 256), 1, 16)
        return self.held.agg(print_.alias("root_fingerprint")).select(F.lit(self.roots[0]).alias("root"), "root_fingerprint", F.lit("").alias("root_marker"))

    def texts(self, listed: DataFrame | None = None) -> DataFrame:
        held = self.held if listed is None else self.held.join(listed.select("path").hint("merge"), "path", "left_semi")
        return held.withColumn("module", text.module_of_path(F.col("path"), F.col("root")))


def tables_of(engine: Engine) -> dict[str, DataFrame]:
    """All per-path tables, for export or comparison."""
    return {name: engine.store.read(name) for name in PER_PATH}
