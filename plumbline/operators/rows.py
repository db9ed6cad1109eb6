"""Best rows, distinct rows and counts.

All of these aggregate on the map side first, so a hot key reaches the shuffle as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places that a row holds at most.
PIECE = 1000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def best_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The least row by ``order`` for every key; of equal rows the one with the least other columns.

    Nulls come first. The row travels as a struct behind its order, so one hash or sort aggregation does it.
    """
    rest = [c for c in rows.columns if c not in keys]
    placed = F.struct(*(_col(c).alias(f"_o{n}") for n, c in enumerate(order)), *(F.col(c) for c in rest))
    best = rows.groupBy(*keys).agg(F.min(placed).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest)).select(*rows.columns)


def best_symbol(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The best symbol per key: by kind, with documentation first, by extension, then by place."""
    from plumbline.operators.search import kind_rank, role_rank

    undocumented = (F.coalesce(F.length(F.trim("docstring")), F.lit(0)) == 0).cast("int")
    return best_per_key(rows, keys, [kind_rank(F.col("kind")), undocumented, role_rank(F.col("path")), "path", "start_line", "start_character"])


def distinct_records(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """One row per key: the least by ``order`` (references: path and range; symbols: name, kind, module, path and range)."""
    return best_per_key(rows, keys, order)


def inverted_index(tokens: DataFrame, key: str, document: str) -> DataFrame:
    """token and n_docs, the number of documents that have it (a list of all holders would be unbounded)."""
    return tokens.select(F.col(key).alias("token"), F.col(document).alias("_d")).distinct().groupBy("token").agg(F.count("*").alias("n_docs"))


def best_n(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, salts: int = 32) -> DataFrame:
    """The first ``n`` rows by ``order`` of every key, with their rank (from 1).

    Every map task passes on at most n rows of a key, by one of ``salts`` ways, each of which passes on at most n: the
    task that ranks a key gets n * salts rows of it, however many there are.
    """
    by = [_col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    names = [f"_o{i}" for i in range(len(order))]
    placed = rows.select("*", *by).withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    some = placed.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*names))).filter(F.col("_n") <= n)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*names))).filter(F.col("rank") <= n)
    return ranked.select(*rows.columns, "rank")


def in_pieces(rows: DataFrame, keys: Sequence[str], payload: Sequence[str], size: int, name: str) -> DataFrame:
    """keys, piece (from 0), n (rows of the key) and the payloads of its rows in order, at most ``size`` in a piece."""
    from plumbline.operators.cells import numbered

    placed = numbered(rows.select(*keys, *payload), keys, list(payload), "_n").withColumn("piece", F.floor((F.col("_n") - 1) / size))
    listed = placed.groupBy(*keys, "piece").agg(F.count("*").alias("_held"), F.sort_array(F.collect_list(F.struct(*payload))).alias(name))
    total = Window.partitionBy(*keys)
    return listed.withColumn("n", F.sum("_held").over(total)).select(*keys, "piece", "n", name)


def postings(rows: DataFrame, keys: Sequence[Column], payload: Sequence[str], limit: int | None = None, size: int = PIECE) -> DataFrame:
    """Rows under each of several keys (a public and an own name): the first ``limit`` of each, or all in pieces of ``size``."""
    both = rows.select(F.explode(F.array_distinct(F.array(*(F.lower(k) for k in keys)))).alias("key"), *payload)
    if limit is None:
        return in_pieces(both, ["key"], payload, size, "rows")
    few = best_n(both, ["key"], list(payload), limit)
    return few.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(*payload))).alias("rows"))


def coalesced_counts(rows: DataFrame, column: str, unknown: str = "unknown") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit(unknown)).alias("origin")).agg(F.count("*").alias("n"))


def origin_totals(rows: DataFrame, column: str, source: Sequence[str]) -> DataFrame:
    """One row: total, source and static counts."""
    mine = F.col(column).isin(list(source))
    return rows.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(mine.cast("long")), F.lit(0)).alias("source"),
        F.coalesce(F.sum((~F.coalesce(mine, F.lit(False))).cast("long")), F.lit(0)).alias("static"),
    )


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def under(path: Column, root: Column) -> Column:
    """``path`` is ``root`` or below it, by whole components."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def ancestors(path: Column) -> Column:
    """A path and all its parents, so that "below a root" becomes an equi-join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def count_by_root(rows: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """root and n for every root, 0 where nothing lies below it; joined by ancestor, without a nested loop."""
    below = rows.select(F.explode(ancestors(F.col(path))).alias("root")).groupBy("root").agg(F.count("*").alias("n"))
    return roots.select("root").distinct().join(below, "root", "left").select("root", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def outermost_roots(roots: DataFrame) -> DataFrame:
    """Roots that lie below no other root."""
    own = roots.select("root").distinct()
    inner = own.select("root", F.explode(ancestors(F.col("root"))).alias("above")).filter("above <> root")
    nested = inner.join(own.withColumnRenamed("root", "above"), "above", "left_semi").select("root")
    return own.join(nested, "root", "left_anti")


def merged_counts(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """Stored counters, and scanned ones where none are stored; ``agree`` tells whether both exist and are equal."""
    s, c = stored.withColumnRenamed("n", "_stored"), scanned.withColumnRenamed("n", "_scanned")
    both = s.join(c, "root", "full")
    return both.select("root", F.coalesce("_stored", "_scanned").alias("n"), F.col("_stored").eqNullSafe(F.col("_scanned")).alias("agree"))


def deltas(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """key and delta, new rows less old rows."""
    signed = new.select(key, F.lit(1).alias("d")).unionByName(old.select(key, F.lit(-1).alias("d")))
    return signed.groupBy(key).agg(F.sum("d").alias("delta"))


def apply_deltas(counters: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Counters moved by their deltas, never below 0."""
    moved = F.greatest(F.col("n") + F.coalesce("delta", F.lit(0)), F.lit(0))
    return counters.join(changes, key, "left").select(key, moved.cast("long").alias("n"))


def call_groups(calls: DataFrame, keys: Sequence[str], line: str, column: str, size: int = PIECE) -> DataFrame:
    """Call sites per identity: piece, the number of all its calls, and its places in order, at most ``size`` in a piece."""
    placed = calls.select(*keys, F.col(line).alias("line"), F.col(column).alias("column"))
    return in_pieces(placed, keys, ["line", "column"], size, "ranges").withColumnRenamed("n", "n_calls")


def doc_count(docs: DataFrame, cached: int = 0) -> DataFrame:
    """Non-empty docstrings, or the cached number if that is larger."""
    n = F.count(F.when(F.length(F.trim("docstring")) > 0, 1))
    return docs.agg(F.greatest(n, F.lit(cached).cast("long")).alias("n_docs"))


def touched_names(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Distinct lower-case names, own and imported, of the changed paths."""
    own = symbols.join(changed.select("path").distinct(), "path", "left_semi")
    source = F.element_at(F.split("import_from", "::"), -1)
    names = own.select(F.lower("name").alias("name")).unionByName(own.filter("import_from is not null").select(F.lower(source).alias("name")))
    return names.distinct()


def merge_modules(modules: DataFrame, precedence: Sequence[str], fill: Sequence[str] = ()) -> DataFrame:
    """One row per (module, name): of several suffixes the first by ``precedence``.

    Where that row has nothing in a column of ``fill`` (a docstring, say), the first one that has something gives it.
    """
    from plumbline.operators.search import extension_of, order_of

    order = [order_of(extension_of(F.col("path")), precedence), "path"]
    best = best_per_key(modules, ["module", "name"], order)
    if not fill:
        return best
    place = [_col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    said = [F.min(F.when(F.length(F.trim(F.col(c))) > 0, F.struct(*place, F.col(c).alias("said"))))["said"].alias(f"_{c}") for c in fill]
    others = modules.groupBy("module", "name").agg(*said)
    filled = best.join(others, ["module", "name"])
    for c in fill:
        filled = filled.withColumn(c, F.coalesce(F.when(F.length(F.trim(F.col(c))) > 0, F.col(c)), F.col(f"_{c}"), F.col(c)))
    return filled.select(*modules.columns)


def bundle_stats(files: DataFrame, size: str = "size") -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("n_bytes"))
