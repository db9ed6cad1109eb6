"""Operators that no registered query covers whole, on a few rows."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import bloom, text
from plumbline.operators import joins, rows, search, windows
from plumbline.sources import files, store
from plumbline.streaming import changes

SYMBOL = "name string, kind string, module string, path string, start_line int, start_character int, end_line int, end_character int, detail string, import_from string, signature string, docstring string"


def symbol(name, kind="function", module="m", path="m.py", line=0, import_from=None, signature=None, docstring=None, detail=""):
    return (name, kind, module, path, line, 0, line, len(name), detail, import_from, signature, docstring)


def test_best_symbol_prefers_kind_then_docs_then_extension(spark):
    df = spark.createDataFrame([symbol("a", "function"), symbol("a", "class", path="m.pyx"), symbol("a", "class", path="m.pyx", line=3, docstring="Doc"), symbol("a", "import")], SYMBOL)
    assert rows.best_symbol(df, ["name"]).first()["start_line"] == 3


def test_lookup_follows_imports_and_survives_cycles(spark):
    df = spark.createDataFrame([symbol("x", "import", "a", "a.py", import_from="b::x"), symbol("x", "import", "b", "b.py", import_from="a::x"), symbol("y", "import", "a", "a.py", import_from="c::z"), symbol("z", "function", "c", "c.py", 4), symbol("w", "import", "a", "a.py", import_from="no::w")], SYMBOL)
    assert joins.lookup(df, "y", rows.best_symbol).first()["name"] == "z"
    asked = df.filter("import_from is not null").select("name", "module", "import_from")
    found = {(r["name"], r["module"]): r["resolved"] for r in joins.follow_imports(asked, df, ["s_path"]).collect()}
    assert found == {("x", "a"): False, ("x", "b"): False, ("y", "a"): True, ("w", "a"): False}


def test_search_extras(spark):
    df = spark.createDataFrame([symbol("ring", line=1), symbol("ring", line=1), symbol("ringlet", line=2), symbol("a_%b", line=3), symbol("axxb", line=4)], SYMBOL)
    assert [r["name"] for r in search.rerank(df, "ring", 10).collect()] == ["ring"]
    assert [r["name"] for r in search.rerank(df, "rin", 2).collect()] == ["ring", "ringlet"]
    assert [r["name"] for r in search.like_search(df, "_%", 10, literal=True).collect()] == ["a_%b"]
    assert [r["name"] for r in search.like_search(df, "a__b", 10).collect()] == ["a_%b", "axxb"]
    assert [r["name"] for r in search.plain_rank(df, "ring", 2).collect()] == ["ring", "ring"]
    members = df.withColumn("owner_type", F.when(F.col("name") == "axxb", "K").otherwise("L"))
    assert search.member_candidates(members, "K", ["m"]).first()["name"] == "axxb"
    listed = search.viewer_list(df.withColumn("search_text", F.col("name")), "ring", {"code": ["function"]})
    assert {r["bucket"] for r in listed.collect()} == {"code"}


def test_visible_binding_ignores_classes_from_inside_functions(spark):
    df = spark.createDataFrame(
        [("x", "", "module", 1, False, "p"), ("x", "K", "class", 2, False, "p"), ("x", "K/m", "function", 5, True, "p"), ("x", "K/m", "function", 9, False, "p"), ("y", "K", "class", 3, False, "p")],
        "name string, scope string, scope_kind string, line int, is_parameter boolean, path string",
    )
    see = lambda line, scope: {r["name"]: (r["scope"], r["line"]) for r in windows.visible_binding(df, ["name"], F.lit(line), F.lit(scope)).collect()}
    assert see(7, "K/m") == {"x": ("K/m", 5)} and see(4, "K") == {"x": ("K", 2), "y": ("K", 3)} and see(4, "other") == {"x": ("", 1)}


def test_text_expressions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(text.module_of_path(F.lit("/r/a/__init__.py"), F.lit("/r"))) == "a" and one(text.module_of_path(F.lit("/r/__init__.py"), F.lit("/r"))) == "document"
    assert one(text.relative_module(F.lit("a.b.c"), F.lit("."), F.lit(True))) == "a.b.c" and one(text.relative_module(F.lit("a.b.c"), F.lit("...d"))) == "d"
    assert one(text.first_paragraph(F.lit("\n one\n two\n\nthree"))) == "one two" and one(text.summary(F.lit("\n  \n x y \n z"))) == "x y"
    long = "\n".join(f"line {i}" for i in range(40))
    assert one(text.shortened(F.lit(long))).count("\n") == 24 and one(text.shortened(F.lit("short"))) == "short"
    assert one(text.hover(F.lit("d"), F.lit("m"), F.lit(""))) == "**d**\n_m_"
    assert one(text.redacted(F.lit("at /home/me/x  and /Users/you/y"), "/work")) == "at ~/x and ~/y"
    assert one(text.is_specific(F.lit("TODO"))) and not one(text.is_specific(F.lit(" \n\t "))) and not one(text.is_specific(F.lit(f"{text.PLACEHOLDER} more.")))
    assert one(text.is_specific(F.lit("Makes rings.")))
    assert one(text.is_method(F.lit("method"), F.lit("f"), F.lit("f(self, x)"))) and not one(text.is_method(F.lit("method"), F.lit("__f__"), F.lit("__f__(self)")))
    assert one(text.detail_owner(F.lit("Method K.f"))) == "K" and one(text.detail_owner(F.lit("Class K"))) is None and one(text.kind_of(F.lit("Odd"))) == "variable"
    assert one(text.in_subtree(F.lit("a.b"), "a")) and not one(text.in_subtree(F.lit("ab"), "a")) and one(text.between_siblings(F.lit("/r/x"), "/r")) and not one(text.between_siblings(F.lit("/r0"), "/r"))
    assert one(text.has_extension(F.lit("a.pyx"), True)) and not one(text.has_extension(F.lit("a.pyx"))) and one(text.label_of_call(F.lit("lib.Point(1)"), {"Point": "P"})) == "P"
    held = bytearray(bloom.built(["abc", "é"]))
    df = spark.createDataFrame([(held,), (bytearray(b"short"),), (None,)], "f binary")
    assert [r["v"] for r in df.select(bloom.may_contain_expr(F.col("f"), "é").alias("v")).collect()] == [True, True, True]
    assert [r["v"] for r in df.select(bloom.may_contain_expr(F.col("f"), "zzz").alias("v")).collect()][0] is False


def test_roots_with_wildcards_and_overlaps(spark):
    roots = spark.createDataFrame([("/a_b",), ("/axb",), ("/p%q",), ("/p%q/src",)], "root string")
    df = spark.createDataFrame([("/a_b/f",), ("/axb/f",), ("/p%q/src/f",), ("/axbc/f",)], "path string")
    assert {r["root"]: r["n"] for r in rows.count_by_root(df, roots).collect()} == {"/a_b": 1, "/axb": 1, "/p%q": 1, "/p%q/src": 1}
    assert {r["root"] for r in rows.outermost_roots(roots).collect()} == {"/a_b", "/axb", "/p%q"}


def test_versions_and_generations(spark):
    events = spark.createDataFrame([("a", "CREATED", 1), ("a", "changed", 3), ("a", "deleted", 3), ("b", "renamed", 9), (None, "changed", 1), ("c", "changed", 2)], "path string, event string, version long")
    newest = {r["path"]: r["op"] for r in changes.latest(changes.change_events(events)).collect()}
    assert newest == {"a": "deleted", "c": "changed"}
    pending = spark.createDataFrame([("a", 5), ("b", 2), ("c", 1)], "path string, version long")
    left = changes.clear_pending(pending, spark.createDataFrame([("a", 4), ("b", 2)], "path string, version long"))
    assert {r["path"] for r in left.collect()} == {"a", "c"}
    assert changes.current_only(spark.createDataFrame([(1, "x"), (2, "y")], "generation int, v string"), 2).count() == 1
    _, now = changes.debounced(changes.change_events(events), 16)
    assert [r["path"] for r in now.collect()] == ["c"]
    modules = spark.createDataFrame([("lib.a",), ("library",)], "module string")
    assert changes.refresh_needed(modules, "lib").count() == 1
    cached = spark.createDataFrame([("x", 1), ("y", 2)], "key string, v int")
    assert changes.drop_dirty(cached, spark.createDataFrame([("X",)], "name string"), "key").count() == 1
    live = spark.createDataFrame([("p", "new")], "path string, v string")
    held = spark.createDataFrame([("p", "old"), ("q", "ok"), ("r", "no")], "path string, v string")
    assert {tuple(r) for r in changes.fail_open(live, held, F.col("v") == "ok").collect()} == {("p", "new"), ("q", "ok")}


def test_store_helpers(spark, tmp_path):
    df = spark.createDataFrame([("k", 1), ("k", 2)], "key string, n int")
    assert store.last_wins(df, ["key"], "n").first()["n"] == 2 and store.first_wins(df, ["key"], "n").first()["n"] == 1
    assert store.with_column(df, "extra", "int").columns == ["key", "n", "extra"] and store.with_column(df, "n", "int") is df

    def fail(folder):
        raise OSError(folder)

    assert store.or_rebuild(fail, ["a", "b"], lambda f: None) == "b"
    with pytest.raises(OSError):
        store.or_rebuild(fail, ["a", "b"], fail)
    symbols = spark.createDataFrame([("o", "b", "m", "src/x.py", 1, 0, "d"), ("o", "b", "m", "src/x.py", 2, 0, "d"), ("o", "a", "m", "src/x.py", 5, 0, "d")], "origin string, name string, module string, path string, start_line int, start_character int, detail string")
    references = spark.createDataFrame([("a", "m", "src/y.py")], "name string, module string, used_in string")
    assert store.export_bundle(symbols, references, f"file://{tmp_path}/bundle") == {"sources": 1, "symbols": 2}
    ids = {r["name"]: r["id"] for r in spark.read.json(f"file://{tmp_path}/bundle/symbols").collect()}
    assert ids == {"a": 0, "b": 1}
    with pytest.raises(ValueError):
        store.export_bundle(symbols.withColumn("path", F.lit("/home/me/x.py")), references, f"file://{tmp_path}/bundle2")
    store.write_snapshot({"exports": df}, f"file://{tmp_path}/old", {"exports": ["key"]})
    assert spark.read.parquet(f"file://{tmp_path}/old/exports").count() == 1
    (tmp_path / "stores/one").mkdir(parents=True)
    (tmp_path / "stores/two").mkdir()
    assert [p.rsplit("/", 1)[1] for p in store.peers(spark, f"file://{tmp_path}/stores", "one")] == ["two"]


def test_runtime_docs_and_summaries(spark, tmp_path):
    program = tmp_path / "docs.py"
    program.write_text("import json, sys\nfor line in sys.stdin:\n    s = json.loads(line)['symbol']\n    print(json.dumps({'docstring': 'Doc of ' + s}), flush=True)\n")
    asked = spark.createDataFrame([("a",), ("b",)], "symbol string")
    assert {r["docstring"] for r in files.runtime_docs(asked, ["python3", str(program)], 10).collect()} == {"Doc of a", "Doc of b"}
    assert {r["docstring"] for r in files.runtime_docs(asked, ["false"], 1).collect()} == {None}
    df = spark.createDataFrame([("p", '{"exports": ["a"]}'), ("q", "broken")], "path string, summary_json string")
    assert [r["exports"] for r in files.summaries(df, "exports array<string>").collect()][0] == ["a"]
    texts = spark.createDataFrame([("p", "x = 1\ndef ring(): pass\nring()")], "path string, text string")
    assert [r["line"] for r in files.matching_lines(texts, files.definition_pattern("ring")).collect()] == [1]


def test_catalogue_and_reliable_bindings(spark):
    symbols = spark.createDataFrame([symbol("det", "method", "lin", "lin.py"), symbol("inv", "method", "lin", "lin.py")], SYMBOL)
    catalogue = spark.createDataFrame([("matrix", "determinant", "lin", "det"), ("matrix", "inverse", "lin", "inv")], "owner_type string, member string, module string, source_name string")
    taken = spark.createDataFrame([("matrix", "inverse")], "owner_type string, member string")
    assert [r["member"] for r in joins.catalogue_rows(catalogue, symbols, taken).collect()] == ["determinant"]
    bindings = spark.createDataFrame([("p", "Point"), ("q", "other")], "name string, constructor string")
    assert [r["name"] for r in joins.reliable(bindings, spark.createDataFrame([("Point",)], "name string")).collect()] == ["p"]
    modules = spark.createDataFrame([("m", "a", "m.py"), ("m", "a", "m.pyx")], "module string, name string, path string")
    assert rows.merge_modules(modules, ("pyx", "py")).first()["path"] == "m.pyx"


def test_imports_end_at_definitions_and_at_the_first_repeat(spark):
    """Chains of every length up to beyond the limit, cycles with a way in, and targets that name nothing."""
    from plumbline.operators import joins

    schema = "name string, module string, kind string, import_from string, path string"
    rows = [(f"n{i}", "p.m", "import", f"m::n{i + 1}", f"/{i}") for i in range(12)] + [("n12", "p.m", "class", None, "/12")]
    rows += [("a", "p.m", "import", "m::b", "/a"), ("b", "p.m", "import", "m::c", "/b"), ("c", "p.m", "import", "m::b", "/c"), ("lost", "p.m", "import", "m::nowhere", "/l")]
    rows += [("c", "q.m", "class", None, "/z"), ("a", "q.m", "import", "p.m::n12", "/y")]
    symbols = spark.createDataFrame(rows, schema)
    held = {}
    for r in rows:
        held.setdefault(r[0], []).append(r)

    def slowly(target):
        seen, last = [], None
        for _ in range(8):
            module, name = target.split("::")
            fits = [r for r in held.get(name, []) if r[1] == module or r[1].endswith("." + module)]
            if not fits:
                return last
            last = min(fits, key=lambda r: (r[1] != module, r[4]))
            here = f"{last[1]}::{last[0]}"
            if last[3] is None or here in seen:
                return last
            seen.append(here)
            target = last[3]
        return last

    asked = [(i, f"m::{n}") for i, n in enumerate(["n0", "n3", "n5", "n9", "n12", "a", "b", "c", "lost", "nowhere"])] + [(98, "q.m::a"), (99, None)]
    got = joins.follow_imports(spark.createDataFrame(asked, "import_id int, import_from string"), symbols, ["s_path"]).collect()
    for r in got:
        want = slowly(r["import_from"]) if r["import_from"] else None
        assert r["s_path"] == (want[4] if want else None), r
        assert r["resolved"] == (want is not None and want[3] is None)
    assert len(got) == len(asked)


def test_exports_spread_in_rounds(spark):
    import random

    from plumbline.operators import joins

    rng = random.Random(2)
    edges = sorted({(rng.randrange(60), rng.randrange(40)) for _ in range(90)} | {(100 + i, 101 + i) for i in range(12)})
    exports = sorted({(rng.randrange(40), f"x{rng.randrange(6)}", rng.randrange(1000)) for _ in range(25)} | {(112, "far", 5)})
    held = {(m, n): o for m, n, o in exports}
    first = {}
    for m, n, o in exports:
        first.setdefault((m, n), []).append(o)
    fresh = {k: min(v) for k, v in first.items()}
    for _ in range(8):
        new = {}
        for a, b in edges:
            for (m, n), o in fresh.items():
                if m == b and (a, n) not in held:
                    new[(a, n)] = min(o, new.get((a, n), 10**9))
        held |= new
        fresh = new
    got = joins.spread_exports(spark.createDataFrame(exports, "module int, name string, origin int"), spark.createDataFrame(edges, "importer int, source int")).collect()
    assert {(r["module"], r["name"]) for r in got} == set(held) and (103, "far") not in held and (104, "far") in held
    assert {(r["module"], r["name"], r["origin"]) for r in got} == {(m, n, o) for (m, n), o in held.items() if (m, n) not in first} | set(exports)


@pytest.mark.parametrize("small", [200_000, 0])
def test_names_spread_as_exports_do(spark, monkeypatch, small):
    import random

    from plumbline.operators import joins

    monkeypatch.setattr(joins, "SMALL", small)
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(40)) for _ in range(90)] + [(100 + i, 101 + i) for i in range(12)] + [(7, 3), (7, 3), (None, 3), (8, None)]
    exports = [(rng.randrange(40), f"x{rng.randrange(150)}") for _ in range(400)] + [(112, "far"), (3, None), (3, None), (200, "alone")]
    held = fresh = set(exports)
    for _ in range(8):
        fresh = {(a, n) for a, b in edges for m, n in fresh if m == b and b is not None} - held
        held = held | fresh
    got = joins.spread_names(spark.createDataFrame(exports, "module int, name string"), spark.createDataFrame(edges, "importer int, source int")).collect()
    assert len(got) == len(held) and {(r["module"], r["name"]) for r in got} == held and (103, "far") not in held and (104, "far") in held


def test_what_moves_along_edges_grows_with_edges_not_names(spark, tmp_path, monkeypatch):
    import __spark_entry__
    from plumbline.operators import joins
    from plumbline.session import unsent

    monkeypatch.setattr(joins, "SMALL", 100)  # as in larger tables, what modules export isn't sent

    def moved():
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    suppliers = [(s, s % 25) for s in range(400)] + [(3, 3)]
    lines = [(1000 + p, s) for p in range(1000) for s in range(p % 16, 400, 16)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(lines + [(s, (7 * s + k) % 400) for s in range(400) for k in range(30)], "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = moved()
    with unsent(spark):
        got = __spark_entry__.queries()["star_reexport_fixpoint"](spark, str(tmp_path)).collect()
    assert len(got) == len(set(got)) == 25 * 1400
    assert moved() - before < 5 * (len(lines) + 12_000)
