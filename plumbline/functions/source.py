"""What one source text says: declarations, imports, exports, references, spans.

Plain functions of a text, for the generators in ``operators.extract``; each is one or a few passes over the text, so
its cost and memory are linear in the document. Positions are (line, column) from 0, columns in UTF-8 bytes, ends
exclusive. The code mask is shared: strings and comments never hold declarations, references or calls.
"""

from __future__ import annotations

import ast
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

WORD = r"[^\W\d]\w*"
ASCII_WORD = r"[A-Za-z_][A-Za-z0-9_]*"
#: Strings with their prefixes, longest quotes first, and comments. An unclosed triple string runs to the end, another to its line's.
NON_CODE = re.compile(
    r'''(?P<string>(?<![\w])?(?:[rRuUbBfF]{0,2})(?:"""(?:\\.|[^\\])*?(?:"""|\Z)|\'\'\'(?:\\.|[^\\])*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*(?:"|$)|'(?:\\.|[^'\\\n])*(?:'|$)))|(?P<comment>#[^\n]*)''',
    re.DOTALL | re.MULTILINE,
)
DECLARATION = re.compile(r"^([ \t]*)(?:(async[ \t]+)?(def|class)|(c[p]?def)(?:[ \t]+(?:inline|class|struct|api|public|readonly|unsigned|long|double|int|void|object|bint|str|list|dict|tuple))*)[ \t]+(?:[\w.\[\], *]*?[ \t*])??(" + WORD + r")[ \t]*(?=[(:])", re.MULTILINE)
GENERATORS = re.compile(rf"^[ \t]*({ASCII_WORD})\.<([^<>\n=]+)>\s*=", re.MULTILINE)
ASSIGNMENT = re.compile(rf"^({ASCII_WORD})[ \t]*(?::[ \t]*[^=\n]+?)?[ \t]*=(?!=)[ \t]*([^\n]*)", re.MULTILINE)
FROM = re.compile(rf"^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+c?import[ \t]+", re.MULTILINE)
PLAIN = re.compile(r"^[ \t]*c?import[ \t]+([^\n#;]+)", re.MULTILINE)
INCLUDE = re.compile(r"^[ \t]*include[ \t]+['\"]([^'\"\n]+)['\"]", re.MULTILINE)
LAZY = re.compile(r"\blazy_import\s*\(")
LAZY_OBJECT = re.compile(rf"^({ASCII_WORD})[ \t]*=[ \t]*LazyImport\s*\(\s*['\"]([\w.]+)['\"]\s*,\s*['\"](\w+)['\"]", re.MULTILINE)
STATIC = re.compile(rf"^[ \t]*({ASCII_WORD})[ \t]*=[ \t]*staticmethod\(\s*({ASCII_WORD}(?:\.\w+)*)\.(\w+)\s*\)", re.MULTILINE)
DEPRECATED = re.compile(rf"^[ \t]*({ASCII_WORD})[ \t]*=[ \t]*deprecated_function_alias\(\s*\d+\s*,\s*([\w.]+)\s*\)", re.MULTILINE)
DECORATED = re.compile(rf"^[ \t]*@matrix_method(?:\(([^)\n]*)\))?[ \t]*\n(?:[ \t]*@[^\n]*\n)*[ \t]*def[ \t]+({ASCII_WORD})", re.MULTILINE)
ALL = re.compile(r"^__all__[ \t]*(\+?=)[ \t]*[\[(]|^__all__\.(append|extend)\(", re.MULTILINE)
LITERAL = re.compile(r"""['"]([^'"\n]*)['"]""")
LOAD = re.compile(r"^[ \t]*(?:load|attach)[ \t]*\(?[ \t]*((?:['\"][^'\"\n]+['\"][ \t]*,?[ \t]*)+)", re.MULTILINE)
CALL = re.compile(rf"({WORD}(?:\.{WORD})*)[ \t]*\(")
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in "
    "is lambda nonlocal not or pass raise return try while with yield cdef cpdef cimport ctypedef include".split()
)
CYTHON = ("pyx", "pxd", "pxi", "spyx")


class Code:
    """A text with its line starts and its mask of code."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts = array("q", [0])
        self.starts.extend(m.end() for m in re.finditer("\n", text))
        self.spans: list[tuple[int, int, str]] = []
        blank = []
        at = 0
        for m in NON_CODE.finditer(text):
            a, b = m.span()
            self.spans.append((a, b, m.lastgroup))
            blank.append(text[at:a])
            blank.append(re.sub(r"[^\n]", " ", m[0]))
            at = b
        blank.append(text[at:])
        #: The text with blanks where there is no code; offsets are the same.
        self.code = "".join(blank)
        self._from = array("q", (a for a, _, _ in self.spans))

    def is_code(self, offset: int) -> bool:
        n = bisect_right(self._from, offset) - 1
        return n < 0 or offset >= self.spans[n][1]

    def line_of(self, offset: int) -> int:
        return bisect_right(self.starts, offset) - 1

    def position(self, offset: int) -> tuple[int, int]:
        line = self.line_of(offset)
        return line, len(self.text[self.starts[line] : offset].encode())

    def offset(self, line: int, column: int) -> int:
        """The offset of a byte column."""
        if line >= len(self.starts):
            return len(self.text)
        end = self.starts[line + 1] - 1 if line + 1 < len(self.starts) else len(self.text)
        row = self.text[self.starts[line] : end].encode()[:column]
        return self.starts[line] + len(row.decode(errors="ignore"))

    def line(self, n: int) -> str:
        end = self.starts[n + 1] if n + 1 < len(self.starts) else len(self.text)
        return self.text[self.starts[n] : end].rstrip("\r\n")

    def closing(self, offset: int) -> int:
        """Behind the bracket that closes the one at ``offset``; the end if none does."""
        depth = 0
        for m in re.compile(r"[()\[\]{}]").finditer(self.code, offset):
            depth += 1 if m[0] in "([{" else -1
            if depth == 0:
                return m.end()
        return len(self.text)


@dataclass(slots=True)
class Symbol:
    name: str
    kind: str
    start: int
    end: int
    detail: str
    import_from: str | None = None
    signature: str | None = None
    docstring: str | None = None
    owner: str | None = field(default=None, repr=False)


def literal_body(text: str) -> str:
    """The inside of a string literal with its prefix and quotes."""
    body = text.lstrip("rRuUbBfF")
    quote = body[:3] if body[:3] in ('"""', "'''") else body[:1]
    body = body[len(quote) :]
    return body[: -len(quote)] if body.endswith(quote) else body


def docstring_at(code: Code, offset: int) -> str | None:
    """A triple-quoted literal that comes next behind ``offset``, white space apart."""
    at = re.compile(r"\s*").match(code.text, offset).end()
    m = re.compile(r"[rRuUbBfF]{0,2}(?:\"\"\"|''')").match(code.text, at)
    if not m:
        return None
    n = bisect_right(code._from, at) - 1
    return literal_body(code.text[at : code.spans[n][1]]).strip() if n >= 0 and code.spans[n][0] == at else None


def module_docstring(code: Code) -> str | None:
    """A triple-quoted literal before all code, comments apart."""
    at = re.compile(r"(?:[ \t\r\n]+|#[^\n]*)*").match(code.text).end()
    return docstring_at(code, at)


def header_end(code: Code, offset: int) -> int:
    """Behind the colon that ends a declaration's header, at bracket depth 0; the line's end if there is none."""
    depth = 0
    for m in re.compile(r"[()\[\]{}:]|\n").finditer(code.code, offset):
        if m[0] in "([{":
            depth += 1
        elif m[0] in ")]}":
            depth -= 1
        elif depth <= 0:
            return m.end() if m[0] == ":" else m.start()
    return len(code.text)


def signature_of(code: Code, name: str, start: int, end: int) -> str | None:
    """The name with its parameter list, in single spaces; comments are left out."""
    header = " ".join(re.sub(r"#[^\n]*", " ", code.text[start:end]).split())
    a, b = header.find("("), header.rfind(")")
    return f"{name}{header[a : b + 1]}" if 0 <= a < b else None


def declarations(code: Code, path: str) -> list[Symbol]:
    """Classes, functions and methods. A class ends with the first line of code that is no deeper than itself."""
    cython = path.rpartition(".")[2] in CYTHON
    lines = ((m.start(), len(m[1].expandtabs(8))) for m in re.finditer(r"^([ \t]*)\S", code.code, re.MULTILINE))
    line = next(lines, None)
    classes: list[tuple[int, str]] = []
    out = []
    for m in DECLARATION.finditer(code.code):
        while line and line[0] <= m.start():
            while classes and classes[-1][0] >= line[1]:
                classes.pop()
            line = next(lines, None)
        is_class = m[3] == "class" or bool(m[4] and re.search(r"\bclass\b", m[0]))
        name, start = m[5], m.start(5)
        end = header_end(code, start)
        owner = classes[-1][1] if classes else None
        kind = "class" if is_class else "cython" if cython and m[4] else "method" if owner else "function"
        detail = f"Method {owner}.{name}" if owner and not is_class else f"{kind.capitalize()} {name}"
        signature = None if is_class else signature_of(code, name, start, end)
        out.append(Symbol(name, kind, start, m.end(5), detail, None, signature, docstring_at(code, end), owner))
        if is_class:
            classes.append((len(m[1].expandtabs(8)), name))
    return out


def generator_symbols(code: Code) -> list[Symbol]:
    """``R.<x, y> = ...`` declares R and its generators."""
    out = []
    for m in GENERATORS.finditer(code.code):
        out.append(Symbol(m[1], "variable", m.start(1), m.end(1), f"Variable {m[1]}"))
        at = m.start(2)
        for part in m[2].split(","):
            name = part.strip()
            if re.fullmatch(ASCII_WORD, name):
                start = at + part.index(name)
                out.append(Symbol(name, "variable", start, start + len(name), f"Generator {name} of {m[1]}"))
            at += len(part) + 1
    return out


def import_names(code: Code, offset: int) -> list[tuple[str, str | None, int]]:
    """(name, alias, offset) of the names behind ``import``, over several lines inside parentheses or after a backslash."""
    if code.code[offset : offset + 1] == "(":
        end = code.closing(offset)
        body, base = code.code[offset + 1 : end - 1], offset + 1
    else:
        end = re.compile(r"(?:\\\n|[^\n;])*").match(code.code, offset).end()
        body, base = code.code[offset:end], offset
    out = []
    for m in re.finditer(rf"(\*|{ASCII_WORD})(?:\s+as\s+({ASCII_WORD}))?\s*(?:,|$|(?=[\s\\]*\Z))", body.replace("\\", " ")):
        out.append((m[1], m[2], base + (m.start(2) if m[2] else m.start(1))))
    return out


def absolute(module: str, target: str, is_package: bool = False) -> str:
    """A relative target below the importing module."""
    dots = len(target) - len(target.lstrip("."))
    if not dots:
        return target
    parts = module.split(".")
    base = parts[: max(0, len(parts) - dots + is_package)]
    rest = target[dots:]
    return ".".join([*base, *([rest] if rest else [])])


def imported(name: str, target: str, offset: int) -> Symbol:
    return Symbol(name, "import", offset, offset + len(name), f"Import {target.replace('::', '.')}", target)


def imports(code: Code, module: str, is_package: bool = False) -> list[Symbol]:
    """Rows of from, plain, c and include imports; stars only in modules named ``all``, whose exports they make."""
    out = []
    for m in FROM.finditer(code.code):
        source = absolute(module, m[1], is_package)
        for name, alias, at in import_names(code, m.end()):
            if name == "*":
                if module == "all" or module.endswith(".all"):
                    out.append(Symbol("*", "import", at, at + 1, f"Import {source}.*", f"{source}::*"))
            else:
                out.append(imported(alias or name, f"{source}::{name}", at))
    for m in PLAIN.finditer(code.code):
        at = m.start(1)
        for part in m[1].split(","):
            named = re.match(rf"\s*([\w.]+)(?:\s+as\s+({ASCII_WORD}))?", part)
            if named:
                alias = named[2] or named[1].split(".")[0]
                target = named[1] if named[2] else alias
                out.append(imported(alias, target, at + (named.start(2) if named[2] else named.start(1))))
            at += len(part) + 1
    for m in INCLUDE.finditer(code.text):
        if code.is_code(m.start()):
            stem = re.sub(r"\.[^./]*$", "", m[1]).replace("/", ".")
            out.append(Symbol(stem.split(".")[-1], "import", m.start(1), m.end(1), f"Import {stem}", stem))
    return out


def lazy_imports(code: Code) -> list[Symbol]:
    """``lazy_import(module, names, as_=aliases)``: names and aliases side by side, one alias for all; LazyImport objects."""
    out = []
    for m in LAZY.finditer(code.code):
        open_ = m.end() - 1
        try:
            call = ast.parse("f" + code.text[open_ : code.closing(open_)].strip(), mode="eval").body
            values = [ast.literal_eval(a) for a in call.args]
            named = {k.arg: ast.literal_eval(k.value) for k in call.keywords if k.arg in ("names", "as_", "as_name")}
        except (SyntaxError, ValueError):
            continue
        many = lambda x: [x] if isinstance(x, str) else list(x or [])
        names = many(values[1] if len(values) > 1 else named.get("names"))
        aliases = many(values[2] if len(values) > 2 else named.get("as_") or named.get("as_name"))
        aliases = aliases * len(names) if len(aliases) == 1 else aliases
        for n, name in enumerate(names if values and isinstance(values[0], str) else []):
            alias = aliases[n] if n < len(aliases) and aliases[n] else name
            at = code.text.find(name, open_)
            out.append(Symbol(alias, "import", at, at + len(name), f"Import {values[0]}.{name}", f"{values[0]}::{name}"))
    for m in LAZY_OBJECT.finditer(code.text):
        if code.is_code(m.start()):
            out.append(imported(m[1], f"{m[2]}::{m[3]}", m.start(1)))
    return out


def exports(code: Code) -> list[tuple[str, int]]:
    """(name, offset) of the entries of ``__all__``: a literal, += and append and extend; each valid name once."""
    out: dict[str, int] = {}
    for m in ALL.finditer(code.code):
        open_ = m.end() - 1
        end = code.closing(open_)
        for entry in LITERAL.finditer(code.text, open_, end):
            if re.fullmatch(ASCII_WORD, entry[1]):
                out.setdefault(entry[1], entry.start(1))
    return list(out.items())


def has_all(code: Code) -> bool:
    return ALL.search(code.code) is not None


def aliases(code: Code, module: str, known: list[Symbol]) -> list[Symbol]:
    """Rows for names that are other names: of imports, definitions, members of imported modules, methods and so on."""
    by_import = {s.name: s.import_from for s in known if s.import_from}
    local = {s.name: s for s in known if s.kind in ("class", "function", "cython") and not s.owner}
    methods = {(s.owner, s.name): s for s in known if s.owner}
    classes = [(s, len(code.line(code.line_of(s.start))) - len(code.line(code.line_of(s.start)).lstrip())) for s in known if s.kind == "class"]
    out = []
    for m in ASSIGNMENT.finditer(code.code):
        name, rhs = m[1], m[2].strip()
        if re.fullmatch(ASCII_WORD, rhs):
            if rhs in by_import:
                out.append(imported(name, by_import[rhs], m.start(1)))
            elif rhs in local:
                out.append(imported(name, f"{module}::{rhs}", m.start(1)))
        elif re.fullmatch(rf"{ASCII_WORD}(?:\.\w+)+", rhs):
            head, _, tail = rhs.partition(".")
            if head in by_import:
                base = by_import[head].replace("::", ".")
                inner, _, last = tail.rpartition(".")
                out.append(imported(name, f"{base}{'.' + inner if inner else ''}::{last}", m.start(1)))
    for m in STATIC.finditer(code.code):
        head, _, tail = m[2].partition(".")
        if head in by_import:
            base = by_import[head].replace("::", ".")
            out.append(imported(m[1], f"{base}{'.' + tail if tail else ''}::{m[3]}", m.start(1)))
    for m in DEPRECATED.finditer(code.code):
        head, _, tail = m[2].partition(".")
        target = by_import.get(head)
        inner, _, last = tail.rpartition(".")
        if target and tail:
            target = f"{target.replace('::', '.')}{'.' + inner if inner else ''}::{last}"
        out.append(imported(m[1], target or f"{module}::{m[2]}", m.start(1)))
    class_starts = [s.start for s, _ in classes]
    for m in re.finditer(rf"^([ \t]+)({ASCII_WORD})[ \t]*=[ \t]*({ASCII_WORD})[ \t]*$", code.code, re.MULTILINE):
        n = bisect_left(class_starts, m.start())
        if n and len(m[1].expandtabs(8)) == classes[n - 1][1] + 4:
            owner = classes[n - 1][0].name
            if (owner, m[3]) in methods:
                out.append(Symbol(m[2], "import", m.start(2), m.end(2), f"MethodAlias {owner}.{m[2]} for {m[3]}", f"{module}::{owner}.{m[3]}", methods[owner, m[3]].signature, methods[owner, m[3]].docstring, owner))
    for m in DECORATED.finditer(code.text):
        named = re.search(r"name\s*=\s*['\"](\w+)['\"]|^\s*['\"](\w+)['\"]", m[1] or "")
        name = (named[1] or named[2]) if named else m[2].removesuffix("_matrix").removeprefix("matrix_")
        if code.is_code(m.start()) and name != m[2]:
            out.append(Symbol(name, "import", m.start(2), m.end(2), f"MethodAlias matrix.{name} for {m[2]}", f"{module}::{m[2]}"))
    return out


def assignments(code: Code, known: list[Symbol]) -> list[Symbol]:
    """Top-level variables, but for names that a row has on the same line, aliases and dotted right sides."""
    taken = {(s.name, code.line_of(s.start)) for s in known}
    declared = {s.name for s in known}
    out = []
    for m in ASSIGNMENT.finditer(code.code):
        name, rhs = m[1], code.text[m.start(2) : m.end(2)].strip()
        plain = re.fullmatch(rf"{ASCII_WORD}(?:\.\w+)+", rhs) or rhs in declared or rhs.startswith("deprecated_function_alias(")
        if (name, code.line_of(m.start(1))) in taken or name == "__all__" or plain:
            continue
        out.append(Symbol(name, "variable", m.start(1), m.end(1), f"Variable {name}"))
    return out


def symbols_of(module: str, path: str, text: str) -> tuple[Code, list[Symbol]]:
    """All rows of a file in a fixed order, the later ones built on the earlier."""
    code = Code(text)
    doc = module_docstring(code)
    rows = [Symbol(module, "module", 0, 0, "module", None, None, doc)]
    rows += declarations(code, path)
    rows += generator_symbols(code)
    rows += imports(code, module, bool(re.search(r"(^|/)__init__\.\w+$", path)))
    rows += lazy_imports(code)
    rows += aliases(code, module, rows)
    rows += [Symbol(name, "import", at, at + len(name), "Export", f"{module}::{name}") for name, at in exports(code)] if has_all(code) else []
    rows += assignments(code, rows)
    return code, rows


def references(code: Code, ascii_only: bool = False) -> list[tuple[str, int]]:
    """(name, offset) of every identifier in code, keywords apart; word boundaries by Unicode or by ASCII letters alone."""
    word = re.compile(rf"(?<![A-Za-z0-9_]){ASCII_WORD}(?![A-Za-z0-9_])" if ascii_only else rf"\b{WORD}\b")
    return [(m[0], m.start()) for m in word.finditer(code.code) if m[0] not in KEYWORDS]


def references_to(code: Code, name: str) -> list[int]:
    """Offsets of one name in code, by ASCII word boundaries."""
    return [m.start() for m in re.finditer(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])", code.code)]


def highlights(code: Code, offset: int) -> list[int]:
    """All occurrences of the word at a place."""
    word = word_at(code, offset)
    return references_to(code, word) if word else []


def word_at(code: Code, offset: int, dotted: bool = False) -> str:
    """The identifier, or the dotted name up to its end, at a place; empty if there is none."""
    line = code.line_of(offset)
    at = offset - code.starts[line]
    for m in re.finditer(rf"{WORD}(?:\.{WORD})*" if dotted else WORD, code.line(line)):
        if m.start() <= at <= m.end():
            if dotted:
                ends = [m.start() + i for i, c in enumerate(m[0] + ".") if c == "." and m.start() + i >= at]
                return code.line(line)[m.start() : ends[0]]
            return m[0]
    return ""


def semantic_spans(code: Code) -> list[tuple[int, int, str]]:
    """(start, end, type) of tokens, in order; of spans that overlap the one that starts first, then the longer, stays."""
    found = [(a, b, kind) for a, b, kind in code.spans]
    families = (
        ("keyword", rf"\b(?:{'|'.join(sorted(KEYWORDS))})\b", 0),
        ("class", rf"\bclass[ \t]+({ASCII_WORD})", 1),
        ("function", rf"\bc?p?def[ \t]+(?:[\w ]+[ \t])?({ASCII_WORD})[ \t]*\(", 1),
        ("number", r"(?<![\w.])\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?", 0),
        ("generator", rf"\.<([^<>\n]+)>", 1),
        ("decorator", rf"^[ \t]*(@[\w.]+)", 1),
    )
    for kind, pattern, group in families:
        found += [(*m.span(group), kind) for m in re.finditer(pattern, code.code, re.MULTILINE)]
    out, end = [], 0
    for a, b, kind in sorted(found, key=lambda s: (s[0], -(s[1] - s[0]), s[2])):
        if a >= end and b > a:
            out.append((a, b, kind))
            end = b
    return out


def rewrite(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """(generated text, edits (start, end, replacement)): powers, ranges, empty indexes and generator declarations."""
    code = Code(text)
    edits: list[tuple[int, int, str]] = []
    for m in re.finditer(r"(?<!\^)\^(?![\^=])", code.code):
        edits.append((m.start(), m.end(), "**"))
    for m in re.finditer(r"\^\^", code.code):
        edits.append((m.start(), m.end(), "^"))
    for m in re.finditer(r"(?<=[\w\])])\s*\.\.(?!\.)\s*(?=[\w(\[-])", code.code):
        edits.append((m.start(), m.end(), ","))
    for m in re.finditer(r"(?<=[\w\])])\[\s*\]", code.code):
        if not re.search(r"=\s*$", code.code[: m.start()]):
            edits.append((m.start(), m.end(), "[0]"))
    for m in GENERATORS.finditer(code.code):
        names = ", ".join(p.strip() for p in m[2].split(","))
        end = code.starts[code.line_of(m.start()) + 1] - 1 if code.line_of(m.start()) + 1 < len(code.starts) else len(text)
        rhs = text[m.end() : end].strip()
        quoted = "(" + ", ".join(f"'{n.strip()}'" for n in m[2].split(",")) + ("," if "," not in m[2] else "") + ")"
        call = re.sub(r"\)\s*$", f", names={quoted})", rhs) if rhs.endswith(")") else rhs
        indent = re.match(r"[ \t]*", m[0])[0]
        edits = [e for e in edits if not m.start() <= e[0] < end]
        edits.append((m.start(), end, f"{indent}{m[1]} = {call}; ({names}{',' if ',' not in names else ''}) = {m[1]}._first_ngens({len(names.split(','))})"))
    edits.sort()
    out, at = [], 0
    for a, b, new in edits:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), edits


def source_map(text: str) -> tuple[str, list[int]]:
    """The rewritten text, and for each of its characters the offset in the original that it comes from."""
    generated, edits = rewrite(text)
    where: list[int] = []
    at = 0
    for a, b, new in edits:
        where += range(at, a)
        where += [min(a + n, max(a, b - 1)) for n in range(len(new))]
        at = b
    where += range(at, len(text))
    return generated, where


#: Characters of a text that are parsed at a time, about.
PIECE = 1 << 18


def parsed_pieces(text: str) -> Iterator[tuple[int, list[ast.stmt]]]:
    """(number of lines before, statements) of pieces of a text that begin with a definition at the left edge.

    The trees of a text take many times its size, so they come one after another. No bracket can hold def or class, so
    pieces that all parse are the whole; an error in one (which a decorator behind its edge may be, too) says nothing of
    the text.
    """
    edges, last = [0], 0
    if len(text) > PIECE and "\r" not in text:
        for m in re.finditer(r"^(?:async[ \t]+def|def|class)\b", text, re.MULTILINE):
            before = text[text.rfind("\n", 0, max(0, m.start() - 1)) + 1 : m.start()]
            if m.start() - last >= PIECE and not before.startswith("@"):
                edges.append(last := m.start())
    line = 0
    for a, b in zip(edges, [*edges[1:], len(text)], strict=True):
        piece = text[a:b]
        yield line, ast.parse(piece).body
        line += piece.count("\n")


def check_syntax(text: str) -> None:
    """Raises what parsing the text raises."""
    try:
        for _ in parsed_pieces(text):
            pass
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        ast.parse(text)


def diagnostics(text: str, path: str) -> list[tuple[int, int, str, str]]:
    """(start, end, code, severity): a caret that ends a line, a caret in plain Python, text that doesn't parse."""
    code, ext = Code(text), path.rpartition(".")[2]
    out = []
    for m in re.finditer(r"\^[ \t]*$", code.code, re.MULTILINE):
        out.append((m.start(), m.start() + 1, "trailing-caret", "error"))
    if ext == "py":
        for m in re.finditer(r"(?<=[\w)])[ \t]*\^[ \t]*(?=[\w(])", code.code):
            at = code.code.index("^", m.start())
            out.append((at, at + 1, "caret-power", "warning"))
    if ext not in CYTHON and not any(d[2] == "trailing-caret" for d in out):
        try:
            check_syntax(rewrite(text)[0] if ext != "py" else text)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            line = max(0, min((getattr(e, "lineno", 1) or 1) - 1, len(code.starts) - 1))
            out.append((code.starts[line], code.starts[line] + len(code.line(line)), "syntax", "error"))
    return sorted(out)


#: What each diagnostic's quick fix is called and puts in place (None: removes).
FIXES = {"caret-power": ("Use ** for powers", "**"), "trailing-caret": ("Remove the caret", "")}


def quick_fixes(found: list[tuple[int, int, str, str]]) -> list[tuple[str, int, int, str]]:
    return [(FIXES[c][0], a, b, FIXES[c][1]) for a, b, c, _ in found if c in FIXES]


def block_end(code: Code, line: int) -> int:
    """The last line of the block that a line opens, by indentation; blank lines at its end don't count."""
    own = len(code.line(line)) - len(code.line(line).lstrip())
    last = line
    for n in range(line + 1, len(code.starts)):
        row = code.line(n)
        outside = len(row) - len(row.lstrip()) <= own and row.strip()
        if outside and row.lstrip().startswith("#"):
            continue
        if outside and code.is_code(code.starts[n]):
            break
        if row.strip():
            last = n
    return last


def outline(code: Code, rows: list[Symbol]) -> list[tuple[int, int, int | None]]:
    """(row number, last line, number of the row around it or None), in order of place, imports and the module apart."""
    shown = [(n, s) for n, s in enumerate(rows) if s.kind not in ("import", "module")]
    shown.sort(key=lambda ns: (ns[1].start, ns[0]))
    out, stack = [], []
    for n, s in shown:
        first = code.line_of(s.start)
        holds = s.kind in ("class", "function", "method", "cython")
        last = block_end(code, first) if holds else first
        while stack and stack[-1][2] < last or stack and stack[-1][1] == first:
            stack.pop()
        out.append((n, last, stack[-1][0] if stack else None))
        if holds:
            stack.append((n, first, last))
    return out


def folds(code: Code) -> list[tuple[int, int, str]]:
    """(first line, last line, kind) of regions, runs of comment lines and indented blocks; each once, in order."""
    out, regions, run = set(), [], []
    for n in range(len(code.starts)):
        row = code.line(n).strip()
        if re.match(r"#\s*region\b", row):
            regions.append(n)
        elif re.match(r"#\s*endregion\b", row) and regions:
            out.add((regions.pop(), n, "region"))
        if row.startswith("#") and not re.match(r"#\s*(end)?region\b", row):
            run.append(n)
        else:
            if len(run) > 1:
                out.add((run[0], run[-1], "comment"))
            run = []
        if code.code[code.starts[n] : code.starts[n] + len(code.line(n))].rstrip().endswith(":"):
            last = block_end(code, n)
            if last > n:
                out.add((n, last, "block"))
    if len(run) > 1:
        out.add((run[0], run[-1], "comment"))
    return sorted(out)


def selections(code: Code, offset: int) -> list[tuple[int, int]]:
    """The ranges around a place, from the word over its line and blocks to the whole text."""
    line = code.line_of(offset)
    ranges = []
    for m in re.finditer(WORD, code.line(line)):
        if m.start() <= offset - code.starts[line] <= m.end():
            ranges.append((code.starts[line] + m.start(), code.starts[line] + m.end()))
    ranges.append((code.starts[line], code.starts[line] + len(code.line(line))))
    blocks = [(a, b) for a, b, kind in folds(code) if kind == "block" and a <= line <= b]
    for a, b in sorted(blocks, key=lambda x: x[1] - x[0]):
        ranges.append((code.starts[a], code.starts[b] + len(code.line(b))))
    ranges.append((0, len(code.text)))
    return list(dict.fromkeys(ranges))


def inlay_hints(code: Code, labels: dict[str, str], lines: tuple[int, int] = (0, 1 << 30)) -> list[tuple[int, str]]:
    """(offset behind the name, label) of assignments whose right side calls a known constructor."""
    out = []
    for m in re.finditer(rf"^[ \t]*({ASCII_WORD})[ \t]*=(?!=)[ \t]*(?:\w+\.)*({ASCII_WORD})[ \t]*\(", code.code, re.MULTILINE):
        if lines[0] <= code.line_of(m.start(1)) <= lines[1] and m[2] in labels:
            out.append((m.end(1), labels[m[2]]))
    return out


def load_paths(code: Code, max_line: int = 1 << 30) -> list[tuple[str, int]]:
    """(path, offset) of load and attach statements up to a line, each path once."""
    out: dict[str, int] = {}
    for m in LOAD.finditer(code.text):
        if code.is_code(m.start()) and code.line_of(m.start()) <= max_line:
            for entry in LITERAL.finditer(code.text, m.start(1), m.end(1)):
                out.setdefault(entry[1], entry.start(1))
    return list(out.items())


def links(code: Code, folder: str) -> list[tuple[int, int, str]]:
    """(start, end, resolved path) of load, attach and include literals."""
    import posixpath

    found = [(p, a) for p, a in load_paths(code)] + [(m[1], m.start(1)) for m in INCLUDE.finditer(code.text) if code.is_code(m.start())]
    return sorted((a, a + len(p), posixpath.normpath(posixpath.join(folder, p))) for p, a in found)


def calls(code: Code) -> list[tuple[str, int]]:
    """(dotted callee, offset of its last name) of calls, but for keywords, declarations and what isn't code."""
    out = []
    for m in CALL.finditer(code.code):
        before = code.code[max(0, m.start() - 8) : m.start()]
        if m[1].split(".")[0] in KEYWORDS or re.search(r"\b(?:c?p?def|class)\s+$", before):
            continue
        out.append((m[1], m.start() + len(m[1]) - len(m[1].split(".")[-1])))
    return out


def call_at(code: Code, offset: int) -> tuple[str, int] | None:
    """(callee, index of the argument) of the innermost call that is open at a place."""
    stack: list[tuple[str, int]] = []
    for m in re.finditer(r"[()\[\]{},]", code.code[:offset]):
        if m[0] in "([{":
            name = re.search(rf"({WORD}(?:\.{WORD})*)[ \t]*$", code.code[: m.start()]) if m[0] == "(" else None
            stack.append((name[1] if name and name[1] not in KEYWORDS else "", 0))
        elif m[0] in ")]}" and stack:
            stack.pop()
        elif m[0] == "," and stack:
            stack[-1] = (stack[-1][0], stack[-1][1] + 1)
    for name, n in reversed(stack):
        if name:
            return name, n
    return None


def utf16(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


def parameters(signature: str) -> list[str]:
    """The parameters of a signature, split at commas that no bracket or string holds."""
    code = Code(signature)
    a = code.code.find("(")
    if a < 0:
        return []
    end = code.closing(a) - 1
    out, depth, start = [], 0, a + 1
    for m in re.finditer(r"[()\[\]{},]", code.code[a + 1 : end]):
        at = a + 1 + m.start()
        depth += (m[0] in "([{") - (m[0] in ")]}")
        if m[0] == "," and depth == 0:
            out.append(signature[start:at])
            start = at + 1
    out.append(signature[start:end])
    return [p.strip() for p in out if p.strip()]


def parameter_spans(signature: str) -> list[tuple[int, int]]:
    """UTF-16 offsets of the parameters."""
    out, at = [], 0
    for p in parameters(signature):
        at = signature.index(p, at)
        out.append((utf16(signature[:at]), utf16(signature[: at + len(p)])))
        at += len(p)
    return out


def cells(text: str) -> list[tuple[int, int]]:
    """(first line, last line) of the cells between ``# %%`` and ``# region`` marks, without blank edges."""
    lines = text.split("\n")
    marks = [n for n, row in enumerate(lines) if re.match(r"\s*#\s*(?:%%|region\b)", row)]
    bounds = [0, *[m for m in marks if m], len(lines)]
    out = []
    for a, b in zip(bounds, bounds[1:]):
        rows = [n for n in range(a, b) if lines[n].strip()]
        if rows:
            out.append((rows[0], rows[-1]))
    return out


def inferred_types(code: Code, constructors: dict[str, str], strict: bool = True) -> list[tuple[str, int, str]]:
    """(name, line, type) after each assignment: of constructor calls, of copies of known names, and generators' parents.

    The scan goes forward with what it knows so far; an assignment of anything else forgets the name (or, unless
    ``strict``, keeps the last type).
    """
    known: dict[str, str] = {}
    out = []
    pattern = re.compile(rf"^[ \t]*({ASCII_WORD})(?:\.<([^<>\n]+)>)?[ \t]*=(?!=)[ \t]*([^\n]*)", re.MULTILINE)
    for m in pattern.finditer(code.code):
        name, rhs = m[1], m[3].strip()
        called = re.match(rf"(?:\w+\.)*({ASCII_WORD})\s*\(", rhs)
        kind = constructors.get(called[1]) if called else known.get(rhs)
        line = code.line_of(m.start(1))
        if kind:
            known[name] = kind
            out.append((name, line, kind))
            for g in (m[2] or "").split(","):
                if g.strip():
                    known[g.strip()] = f"element of {kind}"
                    out.append((g.strip(), line, known[g.strip()]))
        elif strict:
            known.pop(name, None)
    return out


def scopes(code: Code, rows: list[Symbol]) -> list[tuple[str, str, int, int, str]]:
    """(scope path, kind, first line, last line, parent path) of the module, classes and functions."""
    out = [("", "module", 0, len(code.starts) - 1, "")]
    paths = {None: ""}
    for n, last, parent in outline(code, rows):
        s = rows[n]
        if s.kind in ("class", "function", "method", "cython"):
            above = paths.get(parent, "")
            path = f"{above}/{s.name}" if above else s.name
            paths[n] = path
            out.append((path, "class" if s.kind == "class" else "function", code.line_of(s.start), last, above))
    return out


def bindings(code: Code, rows: list[Symbol]) -> list[tuple[str, str, int, bool]]:
    """(name, scope path, line, is parameter) of what each scope binds."""
    held = scopes(code, rows)
    # The innermost scope of every line, with and without the scope's own first line: inner ones overwrite outer ones.
    own, inside = [held[0]] * len(code.starts), [held[0]] * len(code.starts)
    for s in sorted(held, key=lambda s: (s[2], len(s[0]))):
        own[s[2] : s[3] + 1] = [s] * len(own[s[2] : s[3] + 1])
        if s is not held[0]:
            inside[s[2] + 1 : s[3] + 1] = [s] * len(inside[s[2] + 1 : s[3] + 1])
    out = []
    for s in rows:
        line = code.line_of(s.start)
        if s.kind != "module":
            out.append((s.name, inside[line][0], line, False))
        for p in parameters(s.signature or ""):
            name = re.match(rf"\**({ASCII_WORD})", p)
            if name:
                out.append((name[1], own[line][0], line, True))
    for m in re.finditer(rf"^[ \t]+({ASCII_WORD})[ \t]*=(?!=)", code.code, re.MULTILINE):
        line = code.line_of(m.start(1))
        out.append((m[1], own[line][0], line, False))
    return out


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    """Ranged edits that don't overlap, from the last to the first."""
    for a, b, new in sorted(edits, reverse=True):
        text = text[:a] + new + text[b:]
    return text


def syntax_tree_rows(module: str, path: str, text: str) -> list[tuple[str, str, int, str | None]]:
    """(name, kind, line, owner or target) by the language's own parser; by patterns where the text doesn't parse."""
    source_text = text if path.endswith(".py") else rewrite(text)[0]
    out: list[tuple[str, str, int, str | None]] = []
    before = 0

    def visit(nodes, owner: str | None) -> None:
        for node in nodes:
            if isinstance(node, ast.ClassDef):
                out.append((node.name, "class", before + node.lineno - 1, owner))
                visit(node.body, node.name)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((node.name, "method" if owner else "function", before + node.lineno - 1, owner))
            elif isinstance(node, ast.ImportFrom):
                source = absolute(module, "." * node.level + (node.module or ""), path.endswith("__init__.py"))
                out.extend([(a.asname or a.name, "star" if a.name == "*" else "import", before + node.lineno - 1, f"{source}::{a.name}") for a in node.names])
            elif isinstance(node, ast.Import):
                out.extend([(a.asname or a.name.split(".")[0], "import", before + node.lineno - 1, a.name) for a in node.names])
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                value = node.value.func if isinstance(node.value, ast.Call) else None
                made = value.id if isinstance(value, ast.Name) else getattr(value, "attr", None)
                out.extend([(t.id, "member" if owner else "variable", before + node.lineno - 1, owner or made) for t in targets if isinstance(t, ast.Name)])
            elif isinstance(node, (ast.If, ast.Try)):
                visit(node.body + node.orelse + getattr(node, "finalbody", []), owner)

    try:
        try:
            for before, body in parsed_pieces(source_text):
                visit(body, None)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            before, tree = 0, ast.parse(source_text)
            out.clear()
            visit(tree.body, None)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        code, rows = symbols_of(module, path, text)
        return [(s.name, s.kind, code.line_of(s.start), s.import_from or s.owner) for s in rows if s.kind != "module"]
    return out


def summary_rows(module: str, path: str, text: str) -> tuple[list[str], list[tuple[str, str]]]:
    """(exported names, (name, kind) of own symbols), the cheap summary of a file."""
    code, rows = symbols_of(module, path, text)
    own = [(s.name, s.kind) for s in rows if s.kind not in ("module", "import") and not s.owner]
    listed = [n for n, _ in exports(code)]
    public = listed if has_all(code) else [n for n, _ in own if not n.startswith("_")]
    return sorted(set(public)), own
