"""Source texts to rows: one parse of a file gives all its rows, in one pass over the texts without a shuffle."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import bloom, source

POS = "start_line int, start_character int, end_line int, end_character int"
SYMBOL = f"name string, kind string, {POS}, detail string, import_from string, signature string, docstring string, owner string"
PARSED = f"path string, module string, fingerprint string, identifier_filter binary, has_all boolean, symbols array<struct<{SYMBOL.replace(' string', ':string').replace(' int', ':int')}>>, spans array<struct<name:string,start_line:int,start_character:int,end_line:int,end_character:int>>"
#: Rows that are given to Spark at a time, and characters of texts after which they are given whatever their number.
ROWS, CHARACTERS = 4096, 1 << 20


def each_text(texts: DataFrame, columns: str, rows_of: Callable[..., Iterator[tuple]]) -> DataFrame:
    """Rows of ``rows_of(*row)`` for every row of ``texts``; an Arrow batch per some rows or megabyte of text, also within a text."""
    empty = texts.sparkSession.createDataFrame([], columns)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(empty.schema)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        arrays = zip(*rows, strict=True) if rows else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, load = [], 0
            for at in range(batch.num_rows):
                row = [c[at].as_py() for c in batch.columns]
                for r in rows_of(*row):
                    out.append(r)
                    if len(out) == ROWS:
                        yield told(out)
                        out = []
                load += sum(len(v) for v in row if isinstance(v, str))
                if load >= CHARACTERS:
                    yield told(out)
                    out, load = [], 0
            yield told(out)

    return texts.mapInArrow(run, columns)


def _place(code: source.Code, start: int, end: int) -> tuple[int, int, int, int]:
    return (*code.position(start), *code.position(end))


def parsed(texts: DataFrame, with_spans: bool = True) -> DataFrame:
    """path, module, fingerprint, filter, has_all, and arrays of symbols and reference spans of (path, module, fingerprint, text)."""

    def rows(path, module, fingerprint, text):
        code, symbols = source.symbols_of(module, path, text)
        names = ("start_line", "start_character", "end_line", "end_character")
        told = []
        for s in symbols:
            place = dict(zip(names, _place(code, s.start, s.end)))
            told.append({"name": s.name, "kind": s.kind, **place, "detail": s.detail, "import_from": s.import_from, "signature": s.signature, "docstring": s.docstring, "owner": s.owner})
        refs = source.references(code)
        spans = [{"name": n, **dict(zip(names, _place(code, a, a + len(n))))} for n, a in refs] if with_spans else []
        yield path, module, fingerprint, bloom.built(n for n, _ in source.references(code, ascii_only=True)), source.has_all(code), told, spans

    return each_text(texts.select("path", "module", "fingerprint", F.coalesce("text", F.lit("")).alias("text")), PARSED, rows)


def _whole(texts: DataFrame, *columns: str) -> DataFrame:
    return texts.select(*columns, F.coalesce("text", F.lit("")).alias("text"))


def symbol_rows(texts: DataFrame) -> DataFrame:
    """path, module, has_all and the columns of symbols_of(), for who needs no more of parsed()."""

    def rows(path, module, text):
        code, symbols = source.symbols_of(module, path, text)
        listed = source.has_all(code)
        for s in symbols:
            yield (path, module, listed, s.name, s.kind, *_place(code, s.start, s.end), s.detail, s.import_from, s.signature, s.docstring, s.owner)

    return each_text(_whole(texts, "path", "module"), f"path string, module string, has_all boolean, {SYMBOL}", rows)


def span_rows(texts: DataFrame) -> DataFrame:
    """The rows of spans_of(), for who needs no more of parsed()."""

    def rows(path, text):
        code = source.Code(text)
        for name, at in source.references(code):
            yield (path, name, *_place(code, at, at + len(name)))

    return each_text(_whole(texts, "path"), f"path string, name string, {POS}", rows)


def filter_rows(texts: DataFrame) -> DataFrame:
    """The rows of files_of(), for who needs no more of parsed()."""

    def rows(path, module, fingerprint, text):
        yield path, module, fingerprint, bloom.built(n for n, _ in source.references(source.Code(text), ascii_only=True))

    return each_text(_whole(texts, "path", "module", "fingerprint"), "path string, module string, fingerprint string, identifier_filter binary", rows)


def files_of(rows: DataFrame) -> DataFrame:
    return rows.select("path", "module", "fingerprint", "identifier_filter")


def symbols_of(rows: DataFrame) -> DataFrame:
    """The symbols of parsed() rows; symbol_rows() are such already."""
    return rows.select("path", "module", F.inline("symbols")) if "symbols" in rows.columns else rows.drop("has_all")


def docs_of(rows: DataFrame) -> DataFrame:
    """Documentation rows; a module's own has the detail "module"."""
    held = symbols_of(rows).filter("docstring is not null")
    return held.select("name", "module", "path", "detail", "docstring")


def spans_of(rows: DataFrame, editable: list[str] | None = None) -> DataFrame:
    """Reference spans, of editable roots only where those are given."""
    if editable is not None:
        hit = F.lit(False)
        for root in editable:
            hit = hit | (F.col("path") == root) | F.col("path").startswith(f"{root}/")
        rows = rows.filter(hit)
    return rows.select("path", F.inline("spans"))


def public_exports(rows: DataFrame) -> DataFrame:
    """module, name, origin: what each module exports: its list if it has one, else its names without a leading _."""
    held = rows.select("module", "has_all", F.inline("symbols")) if "symbols" in rows.columns else rows
    listed = held.filter("has_all and detail = 'Export'")
    free = held.filter("not has_all and kind <> 'module' and owner is null and name <> '*' and not startswith(name, '_')")
    return listed.select("module", "name", F.col("module").alias("origin")).unionByName(free.select("module", "name", F.col("module").alias("origin"))).distinct()


def offsets(texts: DataFrame, extract: Callable[[source.Code, str], Iterator[tuple[int, int, str]]]) -> DataFrame:
    """Rows (path, place, label) of spans that ``extract(code, path)`` finds."""

    def rows(path, text):
        code = source.Code(text)
        for a, b, label in extract(code, path):
            yield (path, *_place(code, a, b), label)

    return each_text(texts.select("path", "text"), f"path string, {POS}, label string", rows)


def references_to(texts: DataFrame, name: str) -> DataFrame:
    return offsets(texts, lambda code, path: ((a, a + len(name), name) for a in source.references_to(code, name)))


def semantic_spans(texts: DataFrame) -> DataFrame:
    return offsets(texts, lambda code, path: source.semantic_spans(code))


def diagnostics(texts: DataFrame) -> DataFrame:
    return offsets(texts, lambda code, path: ((a, b, f"{c}:{s}") for a, b, c, s in source.diagnostics(code.text, path)))


def calls(texts: DataFrame) -> DataFrame:
    return offsets(texts, lambda code, path: ((a, a + len(n.split(".")[-1]), n) for n, a in source.calls(code)))


def hints(texts: DataFrame, labels: dict[str, str]) -> DataFrame:
    return offsets(texts, lambda code, path: ((a, a, label) for a, label in source.inlay_hints(code, labels)))


def links(texts: DataFrame) -> DataFrame:
    return offsets(texts, lambda code, path: source.links(code, posixpath.dirname(path)))


def _lines(texts: DataFrame, found: Callable[[source.Code, str], list[tuple[int, int, str]]]) -> DataFrame:
    def rows(path, text):
        for a, b, kind in found(source.Code(text), path):
            yield path, a, b, kind

    return each_text(texts.select("path", "text"), "path string, first_line int, last_line int, kind string", rows)


def folds(texts: DataFrame) -> DataFrame:
    return _lines(texts, lambda code, path: source.folds(code))


def cells(texts: DataFrame) -> DataFrame:
    return _lines(texts, lambda code, path: [(a, b, "cell") for a, b in source.cells(code.text)])


def outline(texts: DataFrame) -> DataFrame:
    """path, symbol_id, name, kind, first_line, last_line and parent_id; ids are row numbers within the file."""

    def rows(path, module, text):
        code, symbols = source.symbols_of(module, path, text)
        for n, last, parent in source.outline(code, symbols):
            yield path, n, symbols[n].name, symbols[n].kind, code.line_of(symbols[n].start), last, parent

    return each_text(texts.select("path", "module", "text"), "path string, symbol_id int, name string, kind string, first_line int, last_line int, parent_id int", rows)


def scopes(texts: DataFrame) -> DataFrame:
    def rows(path, module, text):
        code, symbols = source.symbols_of(module, path, text)
        for name, kind, a, b, parent in source.scopes(code, symbols):
            yield path, name, kind, a, b, parent

    return each_text(texts.select("path", "module", "text"), "path string, scope string, scope_kind string, first_line int, last_line int, parent string", rows)


def bindings(texts: DataFrame) -> DataFrame:
    """What each scope binds, with the scope's kind."""

    def rows(path, module, text):
        code, symbols = source.symbols_of(module, path, text)
        kinds = {s[0]: s[1] for s in source.scopes(code, symbols)}
        for name, scope, line, parameter in source.bindings(code, symbols):
            yield path, name, scope, kinds.get(scope, "module"), line, parameter

    return each_text(texts.select("path", "module", "text"), "path string, name string, scope string, scope_kind string, line int, is_parameter boolean", rows)


def types(texts: DataFrame, constructors: dict[str, str], strict: bool = True) -> DataFrame:
    def rows(path, text):
        for name, line, kind in source.inferred_types(source.Code(text), constructors, strict):
            yield path, name, line, kind

    return each_text(texts.select("path", "text"), "path string, name string, line int, type string", rows)


def rewritten(texts: DataFrame) -> DataFrame:
    """path, generated text and the array of edits."""

    def rows(path, text):
        new, edits = source.rewrite(text)
        yield path, new, [{"start": a, "end": b, "text": t} for a, b, t in edits]

    return each_text(texts.select("path", "text"), "path string, generated string, edits array<struct<start:int,end:int,text:string>>", rows)


def mapped(texts: DataFrame) -> DataFrame:
    """path, generated text and the original offset of each of its characters."""

    def rows(path, text):
        yield (path, *source.source_map(text))

    return each_text(texts.select("path", "text"), "path string, generated string, offsets array<int>", rows)


def syntax_tree_rows(texts: DataFrame) -> DataFrame:
    def rows(path, module, text):
        for name, kind, line, target in source.syntax_tree_rows(module, path, text):
            yield path, name, kind, line, target

    return each_text(texts.select("path", "module", "text"), "path string, name string, kind string, line int, target string", rows)


def summaries(texts: DataFrame) -> DataFrame:
    def rows(path, module, text):
        public, own = source.summary_rows(module, path, text)
        yield path, module, public, [{"name": n, "kind": k} for n, k in own]

    return each_text(texts.select("path", "module", "text"), "path string, module string, exports array<string>, symbols array<struct<name:string,kind:string>>", rows)


def code_share(texts: DataFrame, key: str = "path") -> DataFrame:
    """Code points of each text, and how many of them are neither in strings nor in comments."""

    def rows(name, text):
        code = source.Code(text)
        yield name, len(text), len(text) - sum(b - a for a, b, _ in code.spans)

    return each_text(texts.select(F.col(key).cast("string").alias("k"), F.coalesce("text", F.lit("")).alias("text")), "k string, n_chars long, n_code long", rows)


def loads(texts: DataFrame) -> DataFrame:
    """path, target and line of load and attach statements; targets are relative to the file's folder."""

    def rows(path, text):
        code = source.Code(text)
        for target, at in source.load_paths(code):
            yield path, posixpath.normpath(posixpath.join(posixpath.dirname(path), target)), code.line_of(at)

    return each_text(texts.select("path", "text"), "path string, target string, load_line int", rows)


def _at_places(places: DataFrame, columns: str, told: Callable[[source.Code, int], Iterator[tuple]]) -> DataFrame:
    """Rows of ``told(code, offset)`` behind the path, for every (path, text, line, column)."""

    def rows(path, text, line, column):
        code = source.Code(text)
        for row in told(code, code.offset(line, column)):
            yield (path, *row)

    return each_text(places.select("path", "text", "line", "column"), f"path string, {columns}", rows)


def call_contexts(places: DataFrame) -> DataFrame:
    """path, callee and index of the argument of the innermost call that is open at each place."""
    return _at_places(places, "callee string, argument int", lambda code, at: filter(None, [source.call_at(code, at)]))


def words(places: DataFrame, dotted: bool = False) -> DataFrame:
    """path and the word at each place, or the dotted name up to there; none where no word is."""
    return _at_places(places, "word string", lambda code, at: ((w,) for w in [source.word_at(code, at, dotted)] if w))


def highlights(places: DataFrame) -> DataFrame:
    """All places in code of the word at each place."""

    def told(code: source.Code, at: int) -> Iterator[tuple]:
        word = source.word_at(code, at)
        return (_place(code, a, a + len(word)) for a in source.highlights(code, at))

    return _at_places(places, POS, told)


def selections(places: DataFrame) -> DataFrame:
    """path, rank and range: what a selection at each place grows to, the least first."""
    return _at_places(places, f"rank int, {POS}", lambda code, at: ((n, *_place(code, a, b)) for n, (a, b) in enumerate(source.selections(code, at))))


def parameter_spans(signatures: DataFrame) -> DataFrame:
    """module, name, rank, start and stop (UTF-16) of every parameter of (module, name, signature)."""

    def rows(module, name, signature):
        for n, (a, b) in enumerate(source.parameter_spans(signature)):
            yield module, name, n, a, b

    return each_text(signatures.select("module", "name", "signature").filter("signature is not null"), "module string, name string, rank int, start int, stop int", rows)


def fixes(texts: DataFrame) -> DataFrame:
    """path, title, range and replacement of the quick fixes that a text's diagnostics have."""

    def rows(path, text):
        code = source.Code(text)
        for title, a, b, new in source.quick_fixes(source.diagnostics(text, path)):
            yield path, title, *_place(code, a, b), new

    return each_text(texts.select("path", "text"), f"path string, title string, {POS}, replacement string", rows)


def with_parameters(rows: DataFrame) -> DataFrame:
    """``rows`` with the spans (start, end) of the parameters in their signature."""
    at = rows.columns.index("signature")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", parameters array<struct<_1:int,_2:int>>"

    def told(*row):
        yield (*row, [{"_1": a, "_2": b} for a, b in source.parameter_spans(row[at] or "")])

    return each_text(rows, ddl, told)
