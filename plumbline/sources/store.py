"""A store of tables as versioned Parquet folders with a pointer, and what is done to it.

Parquet has no updates. A table lies in buckets, by a hash of the path or key that its rows belong to. A change makes new
folders for the buckets that it touches, beside the old ones, and then adds a pointer, a small file of the next number that
names the folder of every bucket. Readers take the newest; a change that began from an older one fails, as its number is
taken. Old folders stay for a while, so that lazy answers still read. All paths go through Hadoop's file systems; the
store needs one whose renames are atomic (HDFS, a shared disk), as plain object stores are not.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce, wraps

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.cells import numbered
from plumbline.operators.layout import clustered
from plumbline.operators.rows import ancestors, apply_deltas, best_per_key, count_by_root
from plumbline.operators.search import NAME_KEY, keyed
from plumbline.operators.windows import running_total

POSITION = "start_line int, start_character int, end_line int, end_character int"
SYMBOL = f"name string, kind string, module string, path string, {POSITION}, detail string, import_from string, signature string, name_key string"
#: The tables of a store and their keys (empty: rows belong to a path).
SCHEMAS = {
    "files": "path string, module string, fingerprint string, identifier_filter binary",
    "symbols": SYMBOL,
    "docs": "name string, module string, path string, detail string, docstring string",
    "reference_spans": f"name string, path string, {POSITION}",
    "runtime_docs": "symbol string, name string, module_name string, kind string, detail string, summary string, docstring string, uri string, updated_at long",
    "index_root_metadata": "root string, file_count long, symbol_count long, doc_count long, updated_at long, root_fingerprint string, root_marker string",
    "export_table": f"public_name string, source_name string, import_module string, reason string, {SYMBOL}, docstring string",
    "method_table": f"owner_type string, member string, origin string, {SYMBOL}, docstring string",
}
KEYS = {
    "runtime_docs": ("symbol",),
    "index_root_metadata": ("root",),
    "export_table": ("import_module", "public_name"),
    "method_table": ("owner_type", "member"),
}
#: Columns that tables are clustered by within their buckets, for lookups by any of them (a path's rows are in one bucket).
CLUSTERED = {"symbols": ("module", "name_key"), "export_table": ("import_module", "name_key")}
PER_PATH = ("files", "symbols", "docs", "reference_spans")
#: The column that names a row's bucket in folder names, and the entry of a pointer that holds the schema of a caller's own table.
BUCKET, SCHEMA = "_bucket", "_schema"


class Conflict(RuntimeError):
    """Another writer has changed the store meanwhile; read again and repeat."""


def whole(change: Callable) -> Callable:
    """What a change reads and writes is one transaction."""

    @wraps(change)
    def together(self: Store, *args, **kwargs):
        with self.transaction():
            return change(self, *args, **kwargs)

    return together


class Store:
    """Tables below one folder, in versions; a numbered pointer names the version of each."""

    def __init__(self, spark: SparkSession, folder: str, keep_seconds: float = 86_400, buckets: int = 16) -> None:
        self.spark, self.folder, self.keep_seconds, self.buckets = spark, folder.rstrip("/"), keep_seconds, buckets
        self._open: dict[str, dict[str, str]] | None = None

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _latest(self) -> int:
        """The number of the newest pointer; 0 if there is none."""
        fs, p = self._fs(self.folder)
        if not fs.exists(p):
            return 0
        names = (f.getPath().getName() for f in fs.listStatus(p))
        return max((int(n.removeprefix("_pointer-")) for n in names if n.startswith("_pointer-") and n[9:].isdigit()), default=0)

    def _pointer(self) -> dict[str, dict[str, str]]:
        if self._open is not None:
            return {name: dict(parts) for name, parts in self._open.items()}
        return self._load(self._latest())

    def _load(self, number: int) -> dict[str, dict[str, str]]:
        if not number:
            return {}
        fs, p = self._fs(f"{self.folder}/_pointer-{number}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["tables"]
        finally:
            stream.close()

    def _commit(self, base: int, names: dict[str, dict[str, str]]) -> None:
        """The next pointer after ``base``, if no other writer has made one meanwhile.

        It is written beside and renamed to its number, which fails where the number is taken.
        """
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        fs, draft = self._fs(f"{self.folder}/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"tables": names}, sort_keys=True).encode()))
        out.close()
        _, new = self._fs(f"{self.folder}/_pointer-{base + 1}")
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        flags = self.spark.sparkContext._gateway.new_array(options, 1)
        flags[0] = options.NONE
        try:
            context.rename(draft, new, flags)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"another writer has changed {self.folder} since version {base}") from e
            raise

    @contextmanager
    def transaction(self) -> Iterator[Store]:
        """Several changes that readers see together, or not at all if one of them fails or another writer was faster."""
        if self._open is not None:
            yield self
            return
        base = self._latest()
        held = self._load(base)
        self._open = {name: dict(parts) for name, parts in held.items()}
        try:
            try:
                yield self
            finally:
                names, self._open = self._open, None
            if names != held:
                self._commit(base, names)
        except BaseException:
            for at in _folders(names) - _folders(held):
                fs, p = self._fs(f"{self.folder}/{at}")
                fs.delete(p, True)
            raise
        if names != held:
            self._retire()

    def _retire(self) -> None:
        """Delete versions that no pointer younger than ``keep_seconds`` names, and the pointers themselves."""
        fs, p = self._fs(self.folder)
        found = sorted((int(f.getPath().getName()[9:]), f.getModificationTime() / 1000) for f in fs.listStatus(p) if f.getPath().getName().startswith("_pointer-"))
        # A pointer was current until its successor came.
        until = {n: later for (n, _), (_, later) in zip(found, found[1:], strict=False)}
        old = [n for n, end in until.items() if end < time.time() - self.keep_seconds]
        named = {at for n, _ in found if n not in old for at in _folders(self._load(n))}
        for n in old:
            for at in _folders(self._load(n)) - named:
                fs.delete(self._fs(f"{self.folder}/{at}")[1], True)
            fs.delete(self._fs(f"{self.folder}/_pointer-{n}")[1], False)
        # Folders with nothing that is named: all of it has gone, or a writer died before its pointer.
        kept = {at.rsplit("/", 1)[0] for at in named}
        for table in (f.getPath() for f in fs.listStatus(p) if f.isDirectory() and not f.getPath().getName().startswith("_")):
            for f in fs.listStatus(table):
                if f"{table.getName()}/{f.getPath().getName()}" not in kept and f.getModificationTime() / 1000 <= time.time() - self.keep_seconds:
                    fs.delete(f.getPath(), True)

    @whole
    def create(self) -> None:
        """Every table that is missing, empty."""
        held = self._pointer()
        self.replace({name: self.spark.createDataFrame([], ddl) for name, ddl in SCHEMAS.items() if name not in held})

    def read(self, name: str, buckets: Iterable[str] | None = None) -> DataFrame:
        """The current version, or some of its buckets; columns that an older version lacks are null."""
        parts = self._pointer().get(name, {})
        schema = parts.get(SCHEMA, SCHEMAS.get(name))
        held = [f"{self.folder}/{at}" for b, at in sorted(parts.items()) if b != SCHEMA and (buckets is None or b in buckets)]
        return self.spark.read.schema(schema).parquet(*held) if held else self.spark.createDataFrame([], schema)

    def _bucket(self, name: str, columns: Sequence[str]) -> Column:
        keys = KEYS.get(name) or (("path",) if "path" in columns else tuple(columns)[:1])
        return F.pmod(F.hash(*keys), F.lit(self.buckets)).cast("string")

    def _write(self, name: str, df: DataFrame, sort: Sequence[str]) -> dict[str, str]:
        """A folder for every bucket that has rows. Large buckets are split, small ones are one file; rows are sorted or clustered within."""
        at = f"{name}/{uuid.uuid4().hex}"
        held = keyed(df) if "name" in df.columns and NAME_KEY in SCHEMAS.get(name, "") else df
        placed = held.withColumn(BUCKET, self._bucket(name, df.columns))
        if name in CLUSTERED:
            placed = clustered(placed, CLUSTERED[name], first=[BUCKET])
        else:
            keys = [c for c in sort if c in df.columns]
            placed = placed.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, *keys)
        out = placed.write.partitionBy(BUCKET)
        for c in CLUSTERED.get(name, ()):
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.parquet(f"{self.folder}/{at}")
        fs, p = self._fs(f"{self.folder}/{at}")
        names = (f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory())
        return {n.removeprefix(f"{BUCKET}="): f"{at}/{n}" for n in names if n.startswith(f"{BUCKET}=")}

    def replace(self, tables: dict[str, DataFrame], sort: Sequence[str] = ("name",)) -> None:
        """New versions of several whole tables, visible together. Rows are sorted within files, so that statistics prune.

        Older versions stay for ``keep_seconds``, so that answers that were asked for before still read.
        """
        with self.transaction():
            for name, df in tables.items():
                shape = {} if name in SCHEMAS else {SCHEMA: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)}
                self._open[name] = self._write(name, df, sort) | shape

    def of_paths(self, name: str, paths: DataFrame) -> DataFrame:
        """The rows of some paths; only the buckets that hold them are read."""
        asked = paths.select("path").distinct()
        return self.read(name, self.touched(name, asked)).join(asked, "path", "left_semi")

    def touched(self, name: str, keys: DataFrame) -> list[str]:
        """The buckets of a table that hold the given paths or keys."""
        return [r[0] for r in keys.select(self._bucket(name, keys.columns)).distinct().collect()]

    def _change(self, name: str, gone: DataFrame, on: Sequence[str], new: DataFrame | None, sort: Sequence[str] = ("name",)) -> None:
        """The rows whose columns ``on`` are among ``gone`` go and ``new`` ones come; only the buckets of both are written."""
        some = self.touched(name, gone)
        kept = self.read(name, some)
        rows = kept.join(gone, list(on), "left_anti").select(*kept.columns)
        if new is not None:
            rows = rows.unionByName(new, allowMissingColumns=True).select(*kept.columns)
        written = self._write(name, rows, sort)
        parts = {b: at for b, at in self._pointer().get(name, {}).items() if b not in some}
        self._open[name] = parts | written

    @whole
    def upsert_paths(self, tables: dict[str, DataFrame], paths: DataFrame) -> None:
        """Rows of ``paths`` go from every per-path table, and the given rows, of the same paths, come in their place."""
        gone = paths.select("path").distinct()
        for name in PER_PATH:
            self._change(name, gone, ["path"], tables.get(name))

    @whole
    def delete_roots(self, roots: DataFrame) -> None:
        """Everything at or below the roots goes from the per-path tables."""
        for name in PER_PATH:
            paths = self.read(name).select("path").distinct()
            hit = paths.select("path", F.explode(ancestors(F.col("path"))).alias("root")).join(roots.select("root"), "root", "left_semi")
            self._change(name, hit.select("path").distinct(), ["path"], None)

    @whole
    def upsert(self, name: str, rows: DataFrame) -> None:
        """Rows replace those of the same key."""
        self._change(name, rows.select(*KEYS[name]).distinct(), KEYS[name], rows)

    def write_back_docs(self, rows: DataFrame) -> None:
        """Runtime documentation, unless the symbol is blank or there is nothing to say."""
        said = F.length(F.trim(F.coalesce("docstring", F.lit("")))) + F.length(F.trim(F.coalesce("summary", F.lit(""))))
        self.upsert("runtime_docs", last_wins(rows.filter((F.length(F.trim("symbol")) > 0) & (said > 0)), ["symbol"], "updated_at"))

    @whole
    def seed_from(self, peer: Store, root: str, filter_bytes: int = 8192) -> bool:
        """One root's rows from another store, if both know it by the same fingerprint and all its filters are whole."""
        mine, theirs = (s.read("index_root_metadata").filter(F.col("root") == root).select("root_fingerprint").first() for s in (self, peer))
        below = lambda df: df.filter((F.col("path") == root) | F.col("path").startswith(f"{root}/"))
        files = below(peer.read("files"))
        if not mine or not theirs or mine[0] != theirs[0] or not files.filter(F.length("identifier_filter") != filter_bytes).isEmpty():
            return False
        paths = files.select("path")
        self.upsert_paths({name: below(peer.read(name)) for name in PER_PATH}, paths)
        return True

    def count_roots(self, roots: DataFrame) -> DataFrame:
        """File, symbol and documentation counts per root, from the tables themselves."""
        told = lambda name, df: count_by_root(df, roots).withColumnRenamed("n", name)
        docs = self.read("docs").filter("detail <> 'module' and length(trim(docstring)) > 0")
        counts = told("file_count", self.read("files")).join(told("symbol_count", self.read("symbols")), "root")
        return counts.join(told("doc_count", docs), "root")

    @whole
    def refresh_counters(self, fingerprints: DataFrame) -> None:
        """Counters and fingerprints (root, root_fingerprint, root_marker) of the given roots anew."""
        counted = self.count_roots(fingerprints).join(fingerprints, "root").withColumn("updated_at", F.lit(int(time.time())))
        self.upsert("index_root_metadata", counted)

    @whole
    def mark_roots(self, marks: DataFrame) -> None:
        """Fingerprints (root, root_fingerprint, root_marker) of roots that are counted; their counters stay."""
        held = self.read("index_root_metadata").drop("root_fingerprint", "root_marker", "updated_at").join(marks, "root")
        self.upsert("index_root_metadata", held.withColumn("updated_at", F.lit(int(time.time()))))

    @whole
    def move_counters(self, column: str, deltas: DataFrame) -> None:
        """One counter of the roots in (root, delta) moved, never below 0; the buckets of other roots are not written."""
        self.move_all_counters(deltas.select("root", F.col("delta").alias(column)))

    @whole
    def move_all_counters(self, deltas: DataFrame) -> None:
        """The counters named by the columns of ``deltas`` (root, counters) moved for its roots, never below 0."""
        old = self.read("index_root_metadata", self.touched("index_root_metadata", deltas.select("root")))
        for column in [c for c in deltas.columns if c != "root"]:
            moved = apply_deltas(old.select("root", F.col(column).alias("n")), deltas.select("root", F.col(column).alias("delta")), "root")
            old = old.drop(column).join(moved.withColumnRenamed("n", column), "root")
        known = [f.split()[0] for f in SCHEMAS["index_root_metadata"].split(", ")]
        self.upsert("index_root_metadata", old.join(deltas.select("root"), "root", "left_semi").select(*known))


def _folders(names: dict[str, dict[str, str]]) -> set[str]:
    return {at for parts in names.values() for b, at in parts.items() if b != SCHEMA}


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with one key the last by ``order``."""
    return best_per_key(rows, keys, [-F.col(order)])


def first_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return best_per_key(rows, keys, [F.col(order)])


def with_column(df: DataFrame, name: str, kind: str, default: Column | None = None) -> DataFrame:
    """``df`` with a column that older versions lack."""
    return df if name in df.columns else df.withColumn(name, (default if default is not None else F.lit(None)).cast(kind))


def or_rebuild(write: Callable[[str], None], folders: Sequence[str], rebuild: Callable[[str], None]) -> str:
    """Write to the first folder; if that fails rebuild the store in the next that takes it. Returns the folder used."""
    try:
        write(folders[0])
        return folders[0]
    except Exception as first:
        for folder in folders[1:]:
            try:
                rebuild(folder)
                return folder
            except Exception:
                continue
        raise first


def peers(spark: SparkSession, base: str, own: str) -> list[str]:
    """Other stores beside one, the newest first."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getModificationTime(), s.getPath().toString()) for s in (fs.listStatus(p) if fs.exists(p) else []) if s.isDirectory()]
    return [at for _, at in sorted(found, reverse=True) if at.rstrip("/").split("/")[-1] != own.rstrip("/").split("/")[-1]]


def retention(entries: DataFrame, protect: int, oldest: str, budget: int) -> DataFrame:
    """entry and decision of every cache entry (entry, modified, size).

    The newest ``protect`` entries stay. Of the others those before ``oldest`` go; then, while what is left is over
    the budget, the oldest go. Sizes before an entry are totalled by day first, so no task sorts all entries.
    """
    newest = entries.orderBy(F.desc("modified"), "entry").limit(protect).select("entry", F.lit(True).alias("_newest"))
    tagged = entries.join(newest, "entry", "left")
    old = F.col("modified") < F.lit(oldest).cast(entries.schema["modified"].dataType)
    first = tagged.withColumn("_why", F.when(F.col("_newest"), "protected").when(old, "old"))
    left = first.filter("_why is null or _why = 'protected'").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_total"))
    open_ = first.filter("_why is null").drop("_why", "_newest")
    freed = running_total(open_, F.col("modified").cast("date"), ["modified", F.desc("entry")], "size", "_freed")
    ruled = freed.join(F.broadcast(left)).select("entry", F.when(F.col("_total") - F.col("_freed") > budget, "budget").otherwise("kept").alias("decision"))
    return first.filter("_why is not null").select("entry", F.col("_why").alias("decision")).unionByName(ruled)


def export_bundle(symbols: DataFrame, references: DataFrame, folder: str, private: Sequence[str] = ("/home/", "/Users/", "/root/")) -> dict[str, int]:
    """A static bundle as JSON folders: sources, symbols with dense ids, references and a search index.

    Symbols are distinct by origin, name, module and source. A private path anywhere stops the export. Ids follow the
    order of name and module; they are dealt by ranges, so only one count per range meets in one task.
    """
    leaked = reduce(lambda a, b: a | b, (F.contains("path", F.lit(p)) for p in private))
    if not symbols.filter(leaked).isEmpty():
        raise ValueError("a private path would be exported")
    one = best_per_key(symbols, ["origin", "name", "module", "path"], ["start_line", "start_character"])
    ided = dense_ids(one, ["name", "module", "path", "origin"], "id")
    sources = dense_ids(one.select("path", "module").distinct(), ["path", "module"], "source_id")
    linked = ided.join(sources, ["path", "module"])
    parts = {
        "sources": sources,
        "symbols": linked,
        "references": references.join(linked.select("name", "module", "id"), ["name", "module"]),
        "search_index": linked.select("id", F.lower(F.concat_ws(" ", "name", "module", "detail")).alias("search_text")),
    }
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
    return {name: symbols.sparkSession.read.json(f"{folder}/{name}").count() for name in ("sources", "symbols")}


def dense_ids(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with ids from 0 in order."""
    return numbered(rows, [], list(order), name).withColumn(name, (F.col(name) - 1).cast("long"))


def write_snapshot(tables: dict[str, DataFrame], folder: str, keys: dict[str, Sequence[str]]) -> None:
    """The older layout: whole tables rewritten, of rows with one key the first stays."""
    for name, df in tables.items():
        held = best_per_key(df, list(keys[name]), []) if name in keys else df
        held.write.mode("overwrite").parquet(f"{folder}/{name}")

