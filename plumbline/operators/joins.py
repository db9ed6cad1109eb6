"""Joins between symbols, documentation, imports and places."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.cells import numbered
from plumbline.operators.intervals import best_holding
from plumbline.operators.rows import ancestors, best_per_key
from plumbline.session import shared_folder

#: Fixed value: how many imports or re-exports are followed at most.
DEPTH = 8
#: Rows of a few short columns that may be sent to all executors.
SMALL = 200_000
#: Parts that a popular name is cut into where names are too many to be sent.
SALTS = 16


def with_docs(symbols: DataFrame, docs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join; a key that documentation has twice gives a row for each."""
    return symbols.join(docs, list(on), "left")


def with_first_doc(symbols: DataFrame, docs: DataFrame, on: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Left join with the first documentation row per key, so that rows never multiply."""
    return symbols.join(best_per_key(docs, list(on), order), list(on), "left")


def split_import(target: Column) -> tuple[Column, Column]:
    """(module, name) of an import target ``module::name``; the last component where no name is given."""
    parts = F.split(target, "::")
    module = F.get(parts, F.lit(0))
    return module, F.coalesce(F.get(parts, F.lit(1)), F.element_at(F.split(module, r"\."), -1))


def _next_hops(targets: DataFrame, symbols: DataFrame, best: Sequence[Column | str]) -> DataFrame:
    """For each distinct import target (_f): the best symbol that it names (_row, null if none), its place and its own target."""
    target, wanted = split_import(F.col("_f"))
    tail = lambda module: F.element_at(F.split(module, r"\."), -1)
    held = symbols.select(
        F.col("name").alias("s_name"), F.col("module").alias("s_module"), F.col("kind").alias("s_kind"), F.col("import_from").alias("s_import_from"),
        *(F.col(c).alias(f"s_{c}") for c in symbols.columns if c not in ("name", "module", "kind", "import_from")),
    )
    asked = targets.withColumns({"_target": target, "_wanted": wanted}).withColumn("_ask_tail", tail(F.col("_target")))
    match = (
        (F.col("_wanted") == F.col("s_name"))
        & (F.col("_ask_tail") == F.col("_tail"))
        & ((F.col("s_module") == F.col("_target")) | F.col("s_module").endswith(F.concat(F.lit("."), F.col("_target"))))
    )
    found = asked.join(held.withColumn("_tail", tail(F.col("s_module"))), match).withColumn("_far", (F.col("s_module") != F.col("_target")).cast("int"))
    one = best_per_key(found.drop("_ask_tail", "_tail", "_target", "_wanted"), ["_f"], ["_far", *best])
    row = F.struct(*held.columns).alias("_row")
    return one.select("_f", row, F.concat_ws("::", "s_module", "s_name").alias("_here"), F.col("s_import_from").alias("_to"))


def follow_imports(imports: DataFrame, symbols: DataFrame, best: Sequence[Column | str], depth: int = DEPTH) -> DataFrame:
    """Where each import ends: the columns of ``imports`` (import_id, import_from) and of the symbol that it names.

    An import names a symbol if the names are equal and the symbol's module is the import's, or ends with it behind a
    dot. The best row (by ``best``, which may name the symbol's columns) is taken; if that is an import itself, its own
    target is followed, up to ``depth`` times and never past a module and name that was seen before. An import that leads
    nowhere stays as it is: its last row is returned with ``resolved`` false.

    What a target names does not depend on who asks. So each distinct target meets the symbols once, by an equi-join on
    name and last module component, and paths over targets are doubled, in as many rounds as the logarithm of ``depth``.
    """
    shared_folder(imports.sparkSession)
    targets = imports.select(F.col("import_from").alias("_f")).unionByName(symbols.select(F.col("import_from").alias("_f"))).filter("_f is not null").distinct()
    hops = _next_hops(targets, symbols, best).checkpoint()
    # _path: the targets followed and the symbols found; _to: the target to follow next, null where the path ends.
    paths = hops.select("_f", F.array(F.struct("_f", "_here")).alias("_path"), "_to")
    length = 1
    while length < depth:
        rest = paths.select(F.col("_f").alias("_to"), F.col("_path").alias("_more"), F.col("_to").alias("_next"))
        longer = paths.join(rest, "_to", "left")
        paths = longer.select("_f", F.when(F.col("_more").isNull(), F.col("_path")).otherwise(F.concat("_path", "_more")).alias("_path"), F.col("_next").alias("_to"))
        length *= 2
    # The first symbol that was seen before, else the last one.
    again = F.filter("_path", lambda x, i: F.exists(F.slice(F.col("_path"), F.lit(1), i), lambda y: y["_here"] == x["_here"]))
    within = paths.withColumn("_path", F.slice("_path", 1, depth))
    stop = F.coalesce(F.get(again, F.lit(0))["_f"], F.element_at("_path", -1)["_f"])
    ends = within.select(F.col("_f").alias("_asked"), stop.alias("_stop"))
    rows = ends.join(hops.select(F.col("_f").alias("_stop"), "_row"), "_stop").select("_asked", "_row")
    out = imports.join(rows, F.col("import_from") == F.col("_asked"), "left")
    shown = out.select(*imports.columns, "_row.*")
    return shown.withColumn("resolved", F.col("s_name").isNotNull() & F.col("s_import_from").isNull())


def star_edges(imports: DataFrame) -> DataFrame:
    """importer and source module of every star import."""
    module, name = split_import(F.col("import_from"))
    return imports.filter(name == "*").select(F.col("module").alias("importer"), module.alias("source")).distinct()


def spread_exports(exports: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """exports (module, name, origin) after ``depth`` rounds of re-export along ``edges`` (importer, source).

    A round adds what the sources export and the importer lacks, the least origin first. Rounds go only along edges
    between modules that others import from; they join what the last round added, append it, and end when nothing is
    new, so a row is written once. All other importers take what they get in one join at the end, from the round that
    had it first.
    """
    shared_folder(exports.sparkSession)
    held = exports.select("module", "name", "origin", F.lit(0).alias("_round")).checkpoint()
    sources = edges.select(F.col("source").alias("importer")).distinct()
    inner = edges.join(sources, "importer", "left_semi").select("importer", "source").checkpoint()
    outer = edges.join(sources, "importer", "left_anti").select("importer", "source")
    parts, fresh = [held], held
    for n in range(1, depth + 1):
        moved = fresh.join(inner, fresh["module"] == inner["source"]).select(F.col("importer").alias("module"), "name", "origin")
        lacking = moved.groupBy("module", "name").agg(F.min("origin").alias("origin")).join(reduce(DataFrame.unionByName, parts), ["module", "name"], "left_anti")
        fresh = lacking.withColumn("_round", F.lit(n)).checkpoint()
        if fresh.isEmpty():
            break
        parts.append(fresh)
    spread = reduce(DataFrame.unionByName, parts)
    if spread.limit(SMALL + 1).count() <= SMALL:
        # Sent to edges that already lie with their importer, the rows need not move again to be merged.
        spread, outer = F.broadcast(spread), outer.repartition("importer")
    taken = spread.filter(F.col("_round") < depth).join(outer, F.col("module") == F.col("source")).select(F.col("importer").alias("module"), "name", "_round", "origin")
    best = taken.groupBy("module", "name").agg(F.min(F.struct("_round", "origin")).alias("_best")).select("module", "name", F.col("_best.origin").alias("origin"))
    return spread.drop("_round").unionByName(best.join(held, ["module", "name"], "left_anti"))


def spread_names(exports: DataFrame, edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The modules and names that spread_exports() gives, once each, for callers that ask for no origin.

    Names are numbered, those first exported by the same module next to each other, and 64 of them are the bits of one
    number. So what an edge carries is a row for each 64 names that its source holds, and not one for each name, and sets
    are merged by bitwise sums before they move. Edges and exports may repeat; null names count as one name.
    """
    shared_folder(exports.sparkSession)
    listed = numbered(exports.groupBy("name").agg(F.min("module").alias("_first")), [], ["_first", "name"], "_n")
    names = listed.select("name", F.shiftright("_n", 6).alias("_word"), F.col("_n").bitwiseAND(F.lit(63)).cast("int").alias("_bit")).checkpoint()
    few = names.count() <= SMALL
    sent = F.broadcast if few else lambda df: df
    merged = lambda df: df.groupBy("module", "_word").agg(F.bit_or("_names").alias("_names"))
    numbers = sent(names.withColumnRenamed("name", "_name"))
    held = merged(exports.join(numbers, F.col("name").eqNullSafe(F.col("_name"))).select("module", "_word", F.expr("shiftleft(1L, _bit)").alias("_names"))).checkpoint()
    sources = edges.select(F.col("source").alias("importer")).distinct()
    inner = edges.join(sources, "importer", "left_semi").select("importer", "source").distinct().checkpoint()
    outer = edges.join(sources, "importer", "left_anti").select("importer", "source")
    along = lambda df, by: df.join(by, F.col("module") == F.col("source")).select(F.col("importer").alias("module"), "_word", "_names")
    parts, passed = [held], [held]
    for n in range(1, depth + 1):
        known = merged(reduce(DataFrame.unionByName, parts)).withColumnRenamed("_names", "_known")
        lacking = F.col("_names").bitwiseAND(F.bitwise_not(F.coalesce("_known", F.lit(0).cast("long"))))
        moved = merged(along(parts[-1], inner)).join(known, ["module", "_word"], "left")
        fresh = moved.select("module", "_word", lacking.alias("_names")).filter("_names <> 0").checkpoint()
        if fresh.isEmpty():
            break
        parts.append(fresh)
        if n < depth:
            passed.append(fresh)
    spread = merged(reduce(DataFrame.unionByName, passed)).checkpoint()
    if spread.count() <= SMALL:
        spread = F.broadcast(spread)
    whole = merged(reduce(DataFrame.unionByName, [*parts, along(spread, outer)]))
    if few:
        told = whole.join(numbers, "_word")
    else:
        salted = whole.withColumn("_salt", F.pmod(F.xxhash64("module"), F.lit(SALTS)))
        told = salted.join(numbers.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["_word", "_salt"])
    return told.filter("getbit(_names, _bit) = 1").select("module", F.col("_name").alias("name"))


def fill_absent(rows: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows``, and those of a small ``fallback`` table whose keys they lack."""
    return rows.unionByName(fallback.join(rows.select(*keys).distinct(), list(keys), "left_anti"))


def catalogue_rows(catalogue: DataFrame, symbols: DataFrame, taken: DataFrame) -> DataFrame:
    """Catalogue entries (owner_type, member, module, source_name) with the symbols they name, unless source rows exist."""
    named = symbols.withColumnRenamed("name", "source_name")
    found = catalogue.join(named, ["module", "source_name"])
    return found.join(taken.select("owner_type", "member").distinct(), ["owner_type", "member"], "left_anti")


def classify(rows: DataFrame, column: str, prefixes: DataFrame, separator: str = ".") -> DataFrame:
    """``rows`` with the label of least priority whose prefix is the value or one of its parents; no nested loop.

    ``prefixes`` has prefix, label and priority. Rows without a match have a null label.
    """
    parts = F.split(F.col(column), f"\\Q{separator}\\E")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))
    values = rows.select(column).distinct()
    best = (
        values.select(column, F.explode(chain).alias("prefix"))
        .join(prefixes, "prefix")
        .groupBy(column)
        .agg(F.min(F.struct("priority", "label")).alias("_best"))
        .select(column, F.col("_best.label").alias("label"))
    )
    return rows.join(best, column, "left")


def resolve_aliases(aliases: DataFrame, targets: DataFrame) -> DataFrame:
    """Aliases (path, module, owner, name, target) with the row of the same path and owner that the target names."""
    named = targets.select("path", "owner", F.col("name").alias("target"), "kind", "signature", "docstring")
    return aliases.join(named, ["path", "owner", "target"])


def changed_and_deleted(current: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths whose fingerprint is new, and cached paths that are gone."""
    return current.join(cached, ["path", "fingerprint"], "left_anti"), cached.join(current.select("path"), "path", "left_anti")


def same_identity(references: DataFrame, target: DataFrame, identity: Sequence[str]) -> DataFrame:
    """References that were resolved with high confidence to the target's identity, one row per place."""
    sure = references.filter(F.col("confidence") == "high")
    hit = sure.join(target.select(*identity).distinct(), list(identity), "left_semi")
    return best_per_key(hit, ["path", "start_line", "start_character"], ["end_line", "end_character"])


def innermost(points: DataFrame, intervals: DataFrame, key: str, point: str) -> DataFrame:
    """``points`` with the interval (start, end, label) of the same key that holds them and starts last; others go.

    Of intervals that start together the shorter wins, then the label.
    """
    best = F.struct((-F.col("start")).alias("from"), "end", "label", "start")
    held = best_holding(points, intervals.filter(F.col("end") >= F.col("start")), [key], point, {"_best": best}).filter("_best is not null")
    return held.select(*points.columns, "_best.start", "_best.end", "_best.label")


def overlay(index: DataFrame, live: DataFrame, open_paths: DataFrame) -> DataFrame:
    """Rows of open paths come from the live text, all others from the index."""
    return index.join(open_paths.select("path").distinct(), "path", "left_anti").unionByName(live)


def paired_roles(rows: DataFrame, identity: Sequence[str], role: str) -> DataFrame:
    """Rows of ``role`` (declaration or implementation) whose identity exists in both."""
    from plumbline.operators.search import extension_of

    ext = extension_of(F.col("path"))
    tagged = rows.withColumn("_role", F.when(ext == "pxd", "declaration").when(ext == "pyx", "implementation"))
    both = tagged.groupBy(*identity).agg(F.count_distinct("_role").alias("_n")).filter("_n = 2").select(*identity)
    return tagged.filter(F.col("_role") == role).join(both, list(identity), "left_semi").drop("_role")


def three_tables(files: DataFrame, symbols: DataFrame, exports: DataFrame, term: str) -> DataFrame:
    """Distinct paths whose module, path, symbol or export contains ``term``: three narrow scans instead of one wide join."""
    like = lambda c: F.lower(c).contains(term.lower())
    hits = [
        files.filter(like("module") | like("path")).select("path"),
        symbols.filter(like("name")).select("path").join(files.select("path"), "path", "left_semi"),
        exports.filter(like("export")).select("path").join(files.select("path"), "path", "left_semi"),
    ]
    return hits[0].unionByName(hits[1]).unionByName(hits[2]).distinct()


def unique_classes(imports: DataFrame, definitions: DataFrame, reexports: DataFrame) -> DataFrame:
    """Imports that lead to exactly one class: one definition and no re-export, or no definition and one re-export."""
    count = lambda rows, n: rows.groupBy("module", "name").agg(F.count("*").alias(n), F.min(F.struct("path", "kind")).alias(f"{n}_row"))
    d, r = count(definitions, "n_def"), count(reexports, "n_exp")
    both = imports.join(d, ["module", "name"], "left").join(r, ["module", "name"], "left")
    n_def, n_exp = F.coalesce("n_def", F.lit(0)), F.coalesce("n_exp", F.lit(0))
    row = F.when((n_def == 1) & (n_exp == 0), F.col("n_def_row")).when((n_def == 0) & (n_exp == 1), F.col("n_exp_row"))
    return both.withColumn("_row", row).filter("_row.kind = 'class'").select(*imports.columns, F.col("_row.path").alias("path"))


def reliable(bindings: DataFrame, constructors: DataFrame) -> DataFrame:
    """Bindings whose right side calls a known constructor."""
    return bindings.join(constructors.select(F.col("name").alias("constructor")).distinct(), "constructor", "left_semi")


def lookup(symbols: DataFrame, name: str, best: Callable[[DataFrame, Sequence[str]], DataFrame]) -> DataFrame:
    """The best row of one name, followed to its definition if it is an import."""
    one = best(symbols.filter(F.col("name") == name), ["name"])
    plain = one.filter("import_from is null")
    again = one.filter("import_from is not null").select(F.col("name").alias("import_id"), "import_from")
    far = follow_imports(again, symbols, ["s_path", "s_start_line"])
    named = [F.coalesce(F.col(f"s_{c}"), F.col("import_id") if c == "name" else F.lit(None)).alias(c) for c in symbols.columns]
    return plain.unionByName(far.select(*named))


def below_roots(rows: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is a root or lies below one, by an equi-join on ancestors."""
    hit = rows.select(path).distinct().select(path, F.explode(ancestors(F.col(path))).alias("root")).join(roots.select("root"), "root", "left_semi")
    return rows.join(hit.select(path).distinct(), path, "left_semi")
