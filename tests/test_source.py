"""What one source text says, on small texts."""

import pytest

from plumbline.functions import bloom
from plumbline.functions import source as S


def rows(text, module="pkg.mod", path="pkg/mod.py"):
    return S.symbols_of(module, path, text)[1]


def by_name(text, **how):
    return {s.name: s for s in rows(text, **how) if s.kind != "module"}


def test_positions_are_bytes_and_masks_hide_strings_and_comments():
    code = S.Code('é = "x # y"  # é z\nname = é\n')
    assert code.position(code.text.index('"')) == (0, 5) and code.offset(0, 5) == code.text.index('"')
    assert S.references_to(code, "z") == [] and S.references_to(code, "y") == []
    assert [n for n, _ in S.references(code)] == ["é", "name", "é"]
    assert [n for n, _ in S.references(S.Code("Iechä Iech"), ascii_only=True)] == ["Iech", "Iech"]
    assert S.Code("a = '''open # x\nb").code.count("\n") == 1
    assert S.Code("x = 'a\\'b' + c").is_code(11)


def test_declarations():
    text = 'class A(B):\n    """Doc."""\n    def f(self,  # why\n          a=(1, 2)):\n        r"""Raw."""\n    class C:\n        async def g(self): pass\ndef top(): pass\n'
    found = by_name(text)
    assert (found["A"].kind, found["A"].docstring) == ("class", "Doc.")
    assert (found["f"].detail, found["f"].signature, found["f"].docstring) == ("Method A.f", "f(self, a=(1, 2))", "Raw.")
    assert found["g"].detail == "Method C.g" and found["top"].kind == "function"
    cython = by_name("cdef class K(object):\n    cpdef int m(self, x):\n        pass\ncdef inline double z(double x): return x\n", path="a.pyx")
    assert cython["K"].kind == "class" and cython["m"].kind == "cython" and cython["z"].signature == "z(double x)"


def test_imports():
    text = "from a.b import (x,  # one\n    y as z)\nfrom .c import d\nfrom ..e import f as g\nimport m.n as q, os.path\nfrom s import *\nfrom t cimport u\nx2 = 'from no import no2'\n"
    found = by_name(text, module="p.q.r")
    assert {n: s.import_from for n, s in found.items() if s.import_from} == {"x": "a.b::x", "z": "a.b::y", "d": "p.q.c::d", "g": "p.e::f", "q": "m.n", "os": "os", "u": "t::u"}
    assert by_name("from s import *\n", module="p.all")["*"].import_from == "s::*"
    lazy = by_name("lazy_import('m', ['a', 'b'], as_=['a1', 'b1'])\nlazy_import('n', 'c')\nL = LazyImport('o', 'd')\nlazy_import('k', ['e', 'f'], as_='one')\n")
    assert {n: s.import_from for n, s in lazy.items()} == {"a1": "m::a", "b1": "m::b", "c": "n::c", "L": "o::d", "one": "k::f"}


def test_aliases_and_assignments():
    text = (
        "from a import x\nimport lib.sub as mod\ndef f(): pass\ny = x\ng = f\nh = mod.deep.member\nold = deprecated_function_alias(123, f)\n"
        "class K:\n    def m(self): pass\n    n = m\n    s = staticmethod(mod.fn)\nplain = 3\ntyped: int = 4\ndotted = other.thing\n@matrix_method(name='id')\ndef identity_matrix(): pass\n"
    )
    found = by_name(text)
    assert found["y"].import_from == "a::x" and found["g"].import_from == "pkg.mod::f" and found["h"].import_from == "lib.sub.deep::member"
    assert found["old"].import_from == "pkg.mod::f" and found["n"].detail == "MethodAlias K.n for m" and found["s"].import_from == "lib.sub::fn"
    assert found["plain"].kind == found["typed"].kind == "variable" and "dotted" not in found and found["id"].import_from == "pkg.mod::identity_matrix"


def test_exports_and_generators():
    code = S.Code('__all__ = ["a",\n "b c", \'d\']\n__all__.append("e")\n__all__ += ["a", "f"]\n# __all__.append("g")\n')
    assert [n for n, _ in S.exports(code)] == ["a", "d", "e", "f"]
    assert {n: s.detail for n, s in by_name("R.<x, y> = Poly(QQ)\n").items()} == {"R": "Variable R", "x": "Generator x of R", "y": "Generator y of R"}


def test_rewriting_and_its_map():
    text = "a = 2^10 # 2^3\nb = '2^4'\nc = [1..5]\nd = e^^f\nR.<x> = Poly(QQ)\n"
    new, edits = S.rewrite(text)
    assert new.split("\n")[:4] == ["a = 2**10 # 2^3", "b = '2^4'", "c = [1,5]", "d = e^f"]
    assert new.split("\n")[4] == "R = Poly(QQ, names=('x',)); (x,) = R._first_ngens(1)"
    assert S.apply_edits(text, edits) == new
    again, where = S.source_map(text)
    assert again == new and len(where) == len(new) and text.index("R.<x>") <= where[new.index("QQ")] < len(text) and where[new.index("10 #")] == text.index("10 #")


def test_diagnostics_and_fixes():
    found = S.diagnostics("x = a ^ b\n", "m.py")
    assert [d[2] for d in found] == ["caret-power"] and S.quick_fixes(found)[0][3] == "**"
    assert [d[2] for d in S.diagnostics("x = a ^\n", "m.txt")] == ["trailing-caret"]
    assert [d[2] for d in S.diagnostics("x = (\n", "m.py")] == ["syntax"] and S.diagnostics("cdef int x\n", "m.pyx") == []


def test_outline_folds_selections_cells():
    text = "# region A\nclass K:\n    def m(self):\n        return 1\n\n    z = 2\n# one\n# two\n# endregion\nv = 1\n"
    code, symbols = S.symbols_of("m", "m.py", text)
    outline = {symbols[n].name: (last, parent is not None and symbols[parent].name) for n, last, parent in S.outline(code, symbols)}
    assert outline == {"K": (5, False), "m": (3, "K"), "v": (9, False)}
    assert (0, 8, "region") in S.folds(code) and (6, 7, "comment") in S.folds(code) and (1, 5, "block") in S.folds(code)
    ranges = S.selections(code, text.index("return") + 2)
    assert text[slice(*ranges[0])] == "return" and ranges[-1] == (0, len(text)) and len(ranges) == 5
    assert S.cells("\na\n# %%\nb\n\n# %%\n\n") == [(1, 1), (2, 3), (5, 5)]


def test_calls_and_signatures():
    code = S.Code("def f(x):\n    if (x): return g(h.k(1), [2, (3, ")
    assert [n for n, _ in S.calls(code)] == ["g", "h.k"]
    assert S.call_at(code, len(code.text)) == ("g", 1)
    assert S.call_at(S.Code("a = 1"), 3) is None
    assert S.parameters("f(self, a=(1, 2), b='x,y', *c)") == ["self", "a=(1, 2)", "b='x,y'", "*c"]
    assert S.parameter_spans("f(é𝒳, b)") == [(2, 5), (7, 8)]
    assert S.word_at(S.Code("a.b.c + d"), 2, dotted=True) == "a.b" and S.word_at(S.Code("  "), 1) == ""


def test_hints_loads_links_types_scopes():
    text = 'p = lib.Point(1)\nq = p\nload("a.py", \'b.py\')\nattach("a.py")\np = 3\ndef f(arg):\n    inner = 1\n    return q\n'
    code, symbols = S.symbols_of("m", "d/m.py", text)
    assert S.inlay_hints(code, {"Point": "Point"}) == [(1, "Point")]
    assert [p for p, _ in S.load_paths(code)] == ["a.py", "b.py"] and S.load_paths(code, 1) == []
    assert [x[2] for x in S.links(code, "d/e")] == ["d/e/a.py", "d/e/b.py"]
    assert S.inferred_types(code, {"Point": "Point"}) == [("p", 0, "Point"), ("q", 1, "Point")]
    assert ("f", "function", 5, 7, "") in S.scopes(code, symbols)
    assert {("arg", "f", 5, True), ("inner", "f", 6, False), ("q", "", 1, False)} <= set(S.bindings(code, symbols))
    assert [k for _, _, k in S.semantic_spans(S.Code("def f(): # c\n  return 'def' + 1"))] == ["keyword", "function", "comment", "keyword", "string", "number"]


def test_tree_rows_and_summaries():
    text = "from .a import *\nimport b\nclass K:\n    z = 1\n    def m(self): pass\nv = K()\n_h = 1\n"
    found = S.syntax_tree_rows("p.q", "p/q.py", text)
    assert ("*", "star", 0, "p.a::*") in found and ("z", "member", 3, "K") in found and ("v", "variable", 5, "K") in found
    assert ("f", "function", 0, None) in S.syntax_tree_rows("m", "m.py", "def f(:\n  (\n") or S.syntax_tree_rows("m", "m.py", "x ===")
    assert S.summary_rows("m", "m.py", text)[0] == ["K", "v"]


@pytest.mark.parametrize("text", ["", "\n", "'", '"""', "((((", "\\", "a" * 100_000, "\x00", "#", "def", "class :", "é" * 1000, "__all__ = [", "lazy_import("])
def test_nothing_crashes(text):
    code, found = S.symbols_of("m", "m.py", text)
    S.rewrite(text), S.folds(code), S.outline(code, found), S.semantic_spans(code), S.diagnostics(text, "m.py"), S.cells(text), S.scopes(code, found)
    S.bindings(code, found), S.call_at(code, len(text)), S.selections(code, 0), S.source_map(text)


def test_filters_have_no_false_negatives():
    names = [f"name_{i}" for i in range(3000)]
    held = bloom.built(names)
    assert all(bloom.may_contain(held, n) for n in names) and len(held) == 8192
    assert sum(bloom.may_contain(held, f"other_{i}") for i in range(2000)) < 100
    assert bloom.may_contain(held[:10], "anything") and bloom.fnv32(b"a") == 0xE40C292C and bloom.fnv64(b"a") == 0xAF63DC4C8601EC8C
