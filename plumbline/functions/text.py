"""Column expressions over names, modules, paths and documentation; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that stands for missing documentation, and limits of what is shown.
PLACEHOLDER = "Runtime documentation worker can provide"
MAX_LINES, MAX_BYTES, MAX_MESSAGE = 24, 2400, 500
IDENTIFIER = "^[A-Za-z_][A-Za-z0-9_]*$"


def ascii_tokens(text: Column) -> Column:
    """Identifiers by ASCII word boundaries, in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))


def is_identifier(name: Column) -> Column:
    return name.rlike(IDENTIFIER)


def last_component(module: Column) -> Column:
    return F.element_at(F.split(module, r"\."), -1)


def relative_module(importer: Column, target: Column, is_package: Column | None = None) -> Column:
    """The absolute module of a target with leading dots: each dot pops a component of the importer.

    For a package the first dot is the package itself. Too many dots leave what follows them.
    """
    dots = F.char_length(F.regexp_extract(target, r"^(\.*)", 1))
    rest = F.regexp_replace(target, r"^\.+", "")
    pops = dots - (F.coalesce(is_package, F.lit(False)).cast("int") if is_package is not None else 0)
    parts = F.split(importer, r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - pops, F.lit(0))), ".")
    joined = F.when(base == "", rest).when(rest == "", base).otherwise(F.concat_ws(".", base, rest))
    return F.when(dots == 0, target).otherwise(joined)


def module_of_path(path: Column, root: Column) -> Column:
    """The dotted module of a path below ``root``: no extension, no final __init__; "document" for nothing."""
    below = F.substring(path, F.char_length(root) + 2, 1 << 20)
    bare = F.regexp_replace(F.regexp_replace(below, r"\.[^./]*$", ""), r"(^|/)__init__$", "")
    return F.coalesce(F.nullif(F.translate(bare, "/", "."), F.lit("")), F.lit("document"))


def detail_owner(detail: Column) -> Column:
    """The class in "Method Class.name", null for other details."""
    return F.nullif(F.regexp_extract(detail, r"^Method ([^.\s]+)\.", 1), F.lit(""))


def kind_of(text: Column, kinds: tuple[str, ...] = ("class", "function", "method", "variable", "cython", "module", "import")) -> Column:
    """A known kind in lower case, "variable" for anything else."""
    low = F.lower(text)
    return F.when(low.isin(*kinds), low).otherwise("variable")


def is_specific(doc: Column) -> Column:
    """Documentation that says something: not blank, and without the text that stands for missing documentation."""
    return F.coalesce(doc.rlike(r"\S") & ~doc.contains(PLACEHOLDER), F.lit(False))


def summary(doc: Column) -> Column:
    """The first line that isn't blank, trimmed; empty if there is none."""
    return F.regexp_extract(doc, r"(?m)^[ \t\r\f]*([^ \t\r\f\n](?:[^\n]*[^ \t\r\f\n])?)[ \t\r\f]*$", 1)


def first_paragraph(doc: Column) -> Column:
    """Lines up to the first blank one, joined by spaces."""
    return F.regexp_replace(F.trim(F.regexp_extract(F.regexp_replace(doc, r"^\s+", ""), r"(?s)^(.*?)(?:\n[ \t\r]*\n|\z)", 1)), r"\s*\n\s*", " ")


def shortened(doc: Column) -> Column:
    """At most 24 lines and about 2400 characters, with an ellipsis where something was cut."""
    lines = F.split(doc, "\n", -1)
    head = F.array_join(F.slice(lines, 1, MAX_LINES), "\n")
    cut = F.when(F.octet_length(head) > MAX_BYTES, F.substring(head, 1, MAX_BYTES)).otherwise(head)
    return F.when(cut == doc, doc).otherwise(F.concat(cut, F.lit("\n...")))


def hover(detail: Column, module: Column, doc: Column) -> Column:
    """What is shown for a symbol: its detail, its module, its documentation."""
    return F.concat_ws("\n", F.concat(F.lit("**"), detail, F.lit("**")), F.concat(F.lit("_"), module, F.lit("_")), F.nullif(shortened(doc), F.lit("")))


def redacted(message: Column, home: str) -> Column:
    """Messages without private paths, with single spaces, of at most 500 characters."""
    plain = F.regexp_replace(F.replace(message, F.lit(home), F.lit("~")), r"/(?:home|Users|root)/[^/\s]+", "~")
    return F.substring(F.trim(F.regexp_replace(plain, r"\s+", " ")), 1, MAX_MESSAGE)


def age_days(now_ms: Column, then_ms: Column) -> Column:
    """Whole days between two epochs in milliseconds, never below 0."""
    return F.greatest(F.floor((now_ms - then_ms) / 86_400_000), F.lit(0)).cast("long")


def fingerprint(size: Column, mtime_ns: Column) -> Column:
    return F.concat_ws(":", size.cast("string"), mtime_ns.cast("string"))


def short_digest(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, which NUL separates."""
    return F.substring(F.sha2(F.concat_ws("\x00", *parts).cast("binary"), 256), 1, 16)


def has_extension(path: Column, with_cython: bool = False) -> Column:
    allowed = ["py", "sage"] + (["pyx", "pxd", "pxi", "spyx"] if with_cython else [])
    return F.element_at(F.split(path, r"\."), -1).isin(allowed)


def is_excluded(path: Column, patterns: list[str]) -> Column:
    """Patterns are bare parts of a path once * and / are trimmed from their ends."""
    hit = F.lit(False)
    for pattern in patterns:
        part = pattern.strip("*").strip("/")
        if part:
            hit = hit | F.contains(path, F.lit(part))
    return hit


def is_method(kind: Column, name: Column, signature: Column) -> Column:
    """Callable members whose first parameter is self, special names apart."""
    first = F.regexp_extract(signature, r"\(\s*([A-Za-z_]\w*)", 1)
    return ~kind.isin("import", "module", "class") & ~name.rlike(r"^__.*__$") & (first == "self")


def in_subtree(module: Column, top: str) -> Column:
    return (module == top) | module.startswith(f"{top}.")


def between_siblings(path: Column, root: str) -> Column:
    """Paths below ``root`` as a half-open range, which reaches the file statistics: "0" follows "/"."""
    return (path >= f"{root}/") & (path < f"{root}0")


def label_of_call(rhs: Column, labels: dict[str, str]) -> Column:
    """The label of the constructor that an assignment's right side calls, null for others."""
    called = F.regexp_extract(rhs, r"^\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\(", 1)
    return F.element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), F.element_at(F.split(called, r"\."), -1)) if labels else F.lit(None).cast("string")
