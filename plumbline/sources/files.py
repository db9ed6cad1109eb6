"""Source trees as tables: listing, reading, names, fingerprints.

Spark's own file index can't be used here because it hides names that begin with _ or a dot. Folders are a frontier, a
table that executors list level by level with the ignore rules that apply to each folder, so the driver touches no file.
Contents are read on the executors too, a partition of paths at a time, so the folders must be reachable from them; bytes
that aren't UTF-8 drop the file instead of being replaced.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import re
import subprocess
from collections.abc import Iterator, Sequence
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import fingerprint
from plumbline.operators.rows import best_per_key
from plumbline.operators.search import order_of
from plumbline.session import shared_folder

#: Extensions in the order in which a module is looked up, and files that mark a root.
PLAIN, CYTHON = ("py", "sage"), ("pyx", "pxd", "pxi", "spyx")
MARKERS = ("pyproject.toml", "setup.py", "setup.cfg", "VERSION.txt", "meson.build")
PACKAGE_DIRS = ("site-packages", "dist-packages")
MARKER_BYTES = 64 << 10
LISTING = "path string, root string, size long, mtime_ns long"


def normalized(paths: Sequence[str]) -> list[str]:
    """Real paths, sorted, each once; of a path that doesn't exist the parent is resolved."""
    real = []
    for p in paths:
        path = Path(p)
        real.append(str(path.resolve() if path.exists() else path.parent.resolve() / path.name))
    return sorted(set(real))


def narrowed(root: str, package: str | None) -> str:
    """A package directory of an interpreter is narrowed to its one known package."""
    inner = os.path.join(root, package) if package else root
    return inner if package and os.path.basename(root.rstrip("/")) in PACKAGE_DIRS and os.path.isdir(inner) else root


class Ignored:
    """The patterns of the .gitignore files on the way to a folder; the last that matches decides."""

    def __init__(self, base: str, rules: Sequence = ()) -> None:
        self.rules = tuple(map(tuple, rules))
        listed = os.path.join(base, ".gitignore")
        if os.path.isfile(listed):
            with open(listed, encoding="utf-8", errors="replace") as lines:
                self.rules = (*self.rules, *((base, line.strip()) for line in lines if line.strip() and not line.startswith("#")))

    def hides(self, path: str, is_dir: bool) -> bool:
        hidden = False
        for base, rule in self.rules:
            keep, rule = rule.startswith("!"), rule.lstrip("!")
            only_dirs, rule = rule.endswith("/"), rule.rstrip("/")
            if only_dirs and not is_dir:
                continue
            below = os.path.relpath(path, base)
            hit = fnmatch.fnmatch(below, rule.lstrip("/")) if "/" in rule else fnmatch.fnmatch(os.path.basename(path), rule)
            if hit:
                hidden = not keep
        return hidden


def entries(folder: str, rules: Sequence, excludes: Sequence[str], with_cython: bool) -> Iterator[tuple[str, bool, int, int, tuple]]:
    """(path, is folder, size, mtime_ns, rules) of what a folder holds that may be indexed; nothing if it can't be read."""
    parts = [e.strip("*").strip("/") for e in excludes]
    allowed = PLAIN + (CYTHON if with_cython else ())
    try:
        ignored = Ignored(folder, rules)
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    for entry in found:
        try:
            is_dir = entry.is_dir(follow_symlinks=False)
            if entry.name == ".git" or ignored.hides(entry.path, is_dir) or any(p and p in entry.path for p in parts):
                continue
            if is_dir:
                yield entry.path, True, 0, 0, ignored.rules
            elif entry.is_file() and entry.name.rpartition(".")[2] in allowed and "." in entry.name:
                told = entry.stat()
                yield entry.path, False, told.st_size, told.st_mtime_ns, ()
        except OSError:
            continue  # gone meanwhile


def walk(root: str, excludes: Sequence[str] = (), with_cython: bool = False) -> Iterator[tuple[str, int, int]]:
    """(path, size, mtime_ns) of the indexable files below a root, hidden ones too, ignored ones not, by one process."""
    todo: list[tuple[str, tuple]] = [(root, ())]
    while todo:
        for path, is_dir, size, mtime, rules in entries(*todo.pop(), excludes, with_cython):
            if is_dir:
                todo.append((path, rules))
            else:
                yield path, size, mtime


FOUND = "path string, root string, turn int, is_dir boolean, size long, mtime_ns long, rules string"


def listing(spark: SparkSession, roots: Sequence[str], excludes: Sequence[str] = (), with_cython: bool = False, package: str | None = None) -> DataFrame:
    """One row per file, under the first root that holds it, with its fingerprint.

    Each round lists the folders that the last one found, spread over the executors; what they hold goes to the
    checkpoint folder. There are as many rounds as the tree is deep.
    """
    shared_folder(spark)
    tops = spark.createDataFrame([(r, r, n, True, 0, 0, None) for n, r in enumerate(roots)], FOUND)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            schema = batch.schema
            out = []
            for row in batch.to_pylist():
                folder = narrowed(row["path"], package) if row["rules"] is None else row["path"]
                for path, is_dir, size, mtime, rules in entries(folder, json.loads(row["rules"] or "[]"), excludes, with_cython):
                    out.append({"path": path, "root": row["root"], "turn": row["turn"], "is_dir": is_dir, "size": size, "mtime_ns": mtime, "rules": json.dumps(rules) if is_dir else ""})
                    if len(out) == 10_000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
            yield pa.RecordBatch.from_pylist(out, schema)

    levels, folders = [], tops
    while True:
        found = folders.mapInArrow(scan, FOUND).checkpoint()
        levels.append(found.filter("not is_dir"))
        folders = found.filter("is_dir")
        n = folders.count()
        if not n:
            break
        # A few folders for each task, wherever they were found.
        folders = folders.repartition(max(1, min(-(-n // 16), 10_000)))
    files = best_per_key(reduce(DataFrame.unionByName, levels), ["path"], ["turn"]).select("path", "root", "size", "mtime_ns")
    return files.withColumn("fingerprint", fingerprint(F.col("size"), F.col("mtime_ns")))


def listed(paths: DataFrame, roots: Sequence[str], excludes: Sequence[str] = (), with_cython: bool = False) -> DataFrame:
    """The rows that ``listing`` would have for some paths: only the folders on their way are looked at."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, tuple], dict] = {}

        def inside(folder: str, rules: tuple) -> dict:
            if (folder, rules) not in held:
                held[folder, rules] = {e[0]: e for e in entries(folder, rules, excludes, with_cython)}
            return held[folder, rules]

        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                for root in roots:
                    if path.startswith(root.rstrip("/") + "/"):
                        at, rules, told = root.rstrip("/"), (), None
                        for part in path[len(at) + 1 :].split("/"):
                            told = inside(at, rules).get(f"{at}/{part}")
                            if told is None:
                                break
                            at, rules = told[0], told[4]
                        if told and not told[1]:
                            out.append((path, root, told[2], told[3]))
                        break
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["path", "root", "size", "mtime_ns"])

    found = paths.select("path").distinct().mapInArrow(look, LISTING)
    return found.withColumn("fingerprint", fingerprint(F.col("size"), F.col("mtime_ns")))


def read_texts(files: DataFrame, partitions: int | None = None, batch_bytes: int = 4 << 20) -> DataFrame:
    """``files`` with their text, some megabytes at a time; files that are gone, unreadable or not UTF-8 are dropped."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", text string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("path")

            def done(rows: list[int], texts: list[str]) -> pa.RecordBatch:
                kept = batch.take(pa.array(rows, pa.int64()))
                return pa.RecordBatch.from_arrays([*kept.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

            rows: list[int] = []
            texts: list[str] = []
            load = 0
            for n, path in enumerate(batch.column(at).to_pylist()):
                try:
                    held = Path(path).read_bytes()
                    texts.append(held.decode("utf-8"))
                except (OSError, UnicodeDecodeError):
                    continue
                rows.append(n)
                load += len(held)
                if load >= batch_bytes:
                    yield done(rows, texts)
                    rows, texts, load = [], [], 0
            yield done(rows, texts)

    spread = files.repartition(partitions) if partitions else files
    return spread.mapInArrow(read, ddl)


def module_name(root: str, path: str) -> str:
    below = os.path.relpath(path, root).replace(os.sep, "/")
    parts = re.sub(r"\.[^./]*$", "", below).split("/")
    if parts[-1] == "__init__":
        parts.pop()
    return ".".join(p for p in parts if p not in ("", ".")) or "document"


def module_paths(modules: DataFrame, files: DataFrame, with_cython: bool = False) -> DataFrame:
    """module and path: of all files that could hold a module the first by root, then plain file, then extension."""
    from plumbline.functions.text import module_of_path

    named = files.select(module_of_path(F.col("path"), F.col("root")).alias("module"), "path", "root")
    package = F.col("path").rlike(r"/__init__\.[^./]*$").cast("int")
    ext = order_of(F.element_at(F.split("path", r"\."), -1), PLAIN + (CYTHON if with_cython else ()))
    held = modules.select("module").distinct().join(named, "module")
    return best_per_key(held, ["module"], ["root", package, ext, "path"]).select("module", "path")


def root_fingerprint(root: str) -> tuple[str, str]:
    """(16 hex digits, marker): the root's path and state, the heads of its marker files, and its git head."""
    digest, marker = hashlib.sha256(root.encode()), ""
    if os.path.isdir(root):
        told = os.stat(root)
        digest.update(f"{told.st_mtime_ns}".encode())
        for name in MARKERS:
            at = os.path.join(root, name)
            if os.path.isfile(at):
                marker = marker or name
                with open(at, "rb") as f:
                    digest.update(name.encode() + f.read(MARKER_BYTES))
        head = Path(root, ".git", "HEAD")
        if head.is_file():
            ref = head.read_text(errors="replace").strip()
            digest.update(ref.encode())
            target = Path(root, ".git", ref.removeprefix("ref: "))
            if ref.startswith("ref: ") and target.is_file():
                digest.update(target.read_bytes())
    return digest.hexdigest()[:16], marker


def root_marks(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """root, root_fingerprint and root_marker; executors look at the roots."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [root_fingerprint(r) for r in batch.column(0).to_pylist()]
            columns = [batch.column(0), pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["root", "root_fingerprint", "root_marker"])

    held = spark.createDataFrame([(r,) for r in roots], "root string")
    return held.mapInArrow(look, "root string, root_fingerprint string, root_marker string")


def namespace(version: str, roots: Sequence[str], excludes: Sequence[str], with_cython: bool) -> str:
    """The directory name of a store: it changes with the format, the roots, the excludes and the flag."""
    told = "\x00".join([version, *normalized(roots), "--", *sorted(excludes), str(int(with_cython))])
    return hashlib.sha256(told.encode()).hexdigest()[:16]


def matching_lines(texts: DataFrame, pattern: str) -> DataFrame:
    """path, line (from 0) and text of the lines that match a case-insensitive regular expression."""
    lines = texts.select("path", F.posexplode(F.split("text", r"\r?\n", -1)).alias("line", "line_text"))
    return lines.filter(F.col("line_text").rlike(f"(?i){pattern}"))


def definition_pattern(name: str) -> str:
    """Lines that look like a definition of ``name``: a def, class, assignment or import of it."""
    word = re.escape(name)
    return rf"^\s*(?:(?:cp?def|def|class)\b[^(=]*\b{word}\b|{word}\s*(?::[^=]+)?=(?!=)|(?:from\s+\S+\s+)?c?import\b.*\b{word}\b)"


def runtime_docs(names: DataFrame, command: Sequence[str], timeout: float = 0.75) -> DataFrame:
    """Documentation from an outside program: one JSON line in, one out, per name; one process per partition.

    A process that dies, says nonsense or is late is replaced once, then the partition's other names give null.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json
        import select

        process, failures = None, 0
        try:
            for batch in batches:
                out = []
                for name in batch.column(0).to_pylist():
                    doc = None
                    if failures < 2:
                        try:
                            process = process or subprocess.Popen(list(command), stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)
                            process.stdin.write(json.dumps({"symbol": name}) + "\n")
                            process.stdin.flush()
                            if not select.select([process.stdout], [], [], timeout)[0]:
                                raise TimeoutError
                            doc = json.loads(process.stdout.readline()).get("docstring")
                        except (OSError, ValueError, TimeoutError):
                            failures += 1
                            if process:
                                process.kill()
                            process = None
                    out.append(doc)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["symbol", "docstring"])
        finally:
            if process:
                process.kill()

    return names.select("symbol").mapInArrow(ask, "symbol string, docstring string")


def summaries(rows: DataFrame, schema: str) -> DataFrame:
    """Rows whose summary_json can be read, with its fields."""
    held = rows.withColumn("_s", F.from_json("summary_json", schema, {"mode": "PERMISSIVE"}))
    return held.filter("_s is not null").select("path", "_s.*")
