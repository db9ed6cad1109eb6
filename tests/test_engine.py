"""The index over small source trees: build, re-open, refresh, ask."""

import os
import time

import pytest
from pyspark.sql import functions as F

from plumbline.engine import Engine
from plumbline.sources import files
from plumbline.sources.store import Store

TREE = {
    "lib/all.py": "from lib.future.all import *\nfrom lib.core import helper\n",
    "lib/__init__.py": "",
    "lib/future/__init__.py": "",
    "lib/future/all.py": "from lib.future.module import make_ring as Ring, Point\n",
    "lib/future/module.py": '"""Rings."""\ndef make_ring(base, names=None):\n    """Makes a ring."""\n    return base\n\nclass Point:\n    """A point."""\n    def norm(self):\n        """Its norm."""\n        return helper2(self)\n',
    "lib/core.py": '__all__ = ["helper"]\n__all__.append("Hidden2")\ndef helper(x):\n    """Helps."""\n    return x\nclass Hidden: pass\nclass Hidden2: pass\nhelper2 = helper\n',
    "lib/private/all.py": "from lib.private.x import secret\n",
    "lib/private/x.py": "def secret(): pass\n",
    "user/uses.py": "from lib.all import helper\nfrom lib.nowhere import lost\nfrom lib.core import missing\n# helper in a comment\ndef run(y):\n    s = 'helper'\n    return helper(y)\n",
    "user/other.py": "def helper():\n    return 1\nhelper()\n",
    "user/.hidden.py": "hidden_name = 1\n",
    "user/_under.py": "under_name = 1\n",
    "user/skip/x.py": "skipped = 1\n",
    ".gitignore": "ignored/\n",
    "user/ignored/y.py": "ignored_name = 1\n",
    "user/constructors.py": "def buildPolynomialRing(): pass\ndef PolynomialRing(): pass\ndef polynomial_ring_factory(): pass\ndef string_helper(): pass\n",
    "user/imports.py": "from user.constructors import PolynomialRing\n",
}


@pytest.fixture
def tree(tmp_path):
    for name, content in TREE.items():
        p = tmp_path / "src" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    (tmp_path / "src/user/broken.py").write_bytes(b"bad = '\xff\xfe'\n")
    return tmp_path


@pytest.fixture
def engine(spark, tree):
    spark.sparkContext.setCheckpointDir(str(tree / "cp"))
    root = str(tree / "src")
    made = Engine(spark, f"file://{tree}/store", [root], [f"{root}/user"], ["**/skip/**"])
    made.reconcile()
    return made


def names(df, column="name"):
    return [r[column] for r in df.collect()]


def test_listing_keeps_hidden_names_and_skips_ignored(spark, tree):
    root = str(tree / "src")
    held = files.read_texts(files.listing(spark, [root], ["**/skip/**"]))
    found = {p.removeprefix(root + "/") for p in names(held, "path")}
    assert {"user/.hidden.py", "user/_under.py", "lib/__init__.py"} <= found
    assert not {"user/skip/x.py", "user/ignored/y.py", "user/broken.py"} & found
    assert files.module_name(root, f"{root}/lib/future/__init__.py") == "lib.future"
    assert files.namespace("1", [root], [], True) != files.namespace("1", [root], ["x"], True)
    assert files.root_fingerprint(root)[0] == files.root_fingerprint(root)[0]
    wanted = spark.createDataFrame([("lib.future",), ("lib.core",)], "module string")
    assert len(names(files.module_paths(wanted, held), "path")) == 2


def test_search_and_completion(engine):
    assert names(engine.search("PolynomialRing"))[0] == "PolynomialRing"
    assert names(engine.search("poly"))[0] == "PolynomialRing"
    assert names(engine.search("ring"))[0] in ("Ring", "PolynomialRing", "polynomial_ring_factory")
    assert "import" not in names(engine.search("PolynomialRing"), "kind")
    assert "polynomial_ring_factory" in names(engine.completion("poly"))
    assert "len" in names(engine.completion("le"))


def test_exports_follow_stars_and_lists(engine, spark):
    table = {(r["import_module"], r["public_name"]): r for r in engine.store.read("export_table").collect()}
    assert table["lib.all", "Ring"]["name"] == "make_ring" and table["lib.all", "Ring"]["docstring"] == "Makes a ring."
    assert table["lib.all", "Point"]["path"].endswith("lib/future/module.py")
    assert ("lib.all", "secret") not in table and ("lib.core", "Hidden") not in table and ("lib.core", "Hidden2") in table
    assert names(engine.import_candidates("Ring"), "module")[0] in ("lib.all", "lib.future.all")


def test_definition_references_rename(engine, tree):
    root = str(tree / "src")
    here = engine.definition("helper", path=f"{root}/user/uses.py").collect()
    assert len(here) == 1 and here[0]["path"].endswith("lib/core.py") and here[0]["confidence"] == "high"
    target = engine.definition("helper", path=f"{root}/user/uses.py")
    found = {(r["path"].removeprefix(root + "/"), r["start_line"]) for r in engine.references("helper", target).collect()}
    assert ("user/uses.py", 6) in found and ("user/uses.py", 0) in found and ("lib/core.py", 2) in found
    assert not any(p == "user/other.py" or (p, n) in (("user/uses.py", 3), ("user/uses.py", 5)) for p, n in found)
    edits = engine.rename("helper", "assist", target).collect()
    assert [r["path"].removeprefix(root + "/") for r in edits] == ["user/uses.py"]
    with pytest.raises(ValueError):
        engine.rename("helper", "not a name", target)
    calls = engine.incoming_calls("helper", target).collect()
    assert {(r["caller"], r["n_calls"]) for r in calls} == {("run", 1)}


def test_other_answers(engine, spark, tree):
    root = str(tree / "src")
    assert engine.documentation("Ring").first()["docstring"] == "Makes a ring."
    assert engine.documentation("nothing").first()["origin"] == "placeholder"
    codes = {(r["wanted"], r["code"]) for r in engine.unresolved_imports().collect()}
    assert ("lost", "module-missing") in codes and ("missing", "name-missing") in codes and ("helper", "name-missing") not in codes
    help_ = engine.signature_help("x = make_ring(1, ", 0, 17).first()
    assert help_["active"] == 1 and len(help_["parameters"]) == 2
    assert engine.member("Point", "norm").first()["detail"] == "Method Point.norm"
    out = engine.outgoing_calls(spark.createDataFrame([(f"{root}/user/uses.py",)], "path string"))
    assert out.count() == 0  # helper is defined twice, so its name alone decides nothing
    told = engine.batch(spark.createDataFrame([(f"{root}/user/uses.py", 6, 13)], "path string, line int, column int")).first()
    assert told["name"] == "helper" and told["d_path"].endswith("lib/core.py")
    assert engine.type_definition("p = Point()\np.norm()", "p", 1, {"Point": "Point"}).first()["name"] == "Point"
    assert set(engine.answers("Ring", "hover")) == {"definition", "documentation"}
    with pytest.raises(ValueError):
        engine.query("nonsense")
    assert engine.query("status").first()["file_count"] == engine.store.read("files").count()


def test_refresh_of_changed_and_deleted_files(engine, spark, tree):
    root = tree / "src"
    assert set(engine.reconcile()) == {"unchanged", "insert"} and engine.generation == 1  # a file that isn't UTF-8 stays new
    time.sleep(0.01)
    (root / "user/constructors.py").write_text("def RenamedRing(): pass\n")
    os.remove(root / "user/other.py")
    counts = engine.reconcile()
    assert counts["update"] == 1 and counts["delete"] == 1 and engine.generation == 2
    assert names(engine.search("PolynomialRing"), "kind") == ["import"] and names(engine.search("RenamedRing")) == ["RenamedRing"]
    again = Engine(spark, f"file://{tree}/store", engine.roots, engine.editable, engine.excludes)
    assert names(again.search("RenamedRing")) == ["RenamedRing"]
    (root / "user/new.py").write_text("fresh_name = 1\n")
    events = spark.createDataFrame([(str(root / "user/new.py"), "created", 1), (str(root / "user/constructors.py"), "deleted", 2), (str(root / "user/constructors.py"), "changed", 1)], "path string, event string, version long")
    engine.apply_events(events)
    assert names(engine.search("fresh_name")) == ["fresh_name"] and names(engine.search("RenamedRing")) == []


def test_streamed_events(engine, spark, tree):
    root = tree / "src"
    (root / "user/streamed.py").write_text("streamed_name = 1\n")
    inbox = tree / "inbox"
    spark.createDataFrame([(str(root / "user/streamed.py"), "created", 5)], "path string, event string, version long").write.json(str(inbox))
    stream = spark.readStream.schema("path string, event string, version long").json(str(inbox))
    query = engine.watch(stream, str(tree / "stream-cp"))
    assert query.awaitTermination(120)
    assert names(engine.search("streamed_name")) == ["streamed_name"]


def test_cut_short_store_is_rebuilt(engine, spark):
    store: Store = engine.store
    store.replace({"symbols": store.read("symbols").filter(~F.col("path").endswith("core.py"))})
    engine.reconcile()
    assert "helper" in names(engine.search("helper"))


def test_seeding_from_a_peer(engine, spark, tree):
    root = engine.roots[0]
    other = Store(spark, f"file://{tree}/peer")
    other.create()
    other.refresh_counters(engine.store.read("index_root_metadata").select("root", "root_fingerprint", "root_marker"))
    assert other.seed_from(engine.store, root) and other.read("symbols").count() == engine.store.read("symbols").count()
    other.move_counters("file_count", spark.createDataFrame([(root, -10_000)], "root string, delta long"))
    assert other.read("index_root_metadata").first()["file_count"] == 0
    other.delete_roots(spark.createDataFrame([(f"{root}/user",)], "root string"))
    assert not other.read("symbols").filter(F.contains("path", F.lit("/user/"))).count()
    rows = spark.createDataFrame([("s", "n", "m", "k", "d", "sum", None, None, 3), (" ", "n", "m", "k", "d", "sum", None, None, 3), ("t", "n", "m", "k", "d", "", "", None, 3)], other.read("runtime_docs").schema)
    other.write_back_docs(rows)
    assert names(other.read("runtime_docs"), "symbol") == ["s"]


def test_answers_from_before_a_change_still_read(spark, tmp_path):
    from plumbline.sources.store import Conflict, Store

    store = Store(spark, str(tmp_path / "s"))
    store.create()
    row = lambda path: spark.createDataFrame([(path, "m", "1", None)], "path string, module string, fingerprint string, identifier_filter binary")
    store.upsert_paths({"files": row("a")}, row("a"))
    before = store.read("files")
    store.upsert_paths({"files": row("b")}, row("b"))
    assert [r["path"] for r in before.collect()] == ["a"] and store.read("files").count() == 2

    # A change that fails leaves nothing; one that another writer overtakes says so.
    with pytest.raises(ZeroDivisionError):
        with store.transaction():
            store.upsert_paths({"files": row("c")}, row("c"))
            1 / 0
    assert store.read("files").count() == 2
    other = Store(spark, store.folder)
    with pytest.raises(Conflict):
        with store.transaction():
            store.upsert_paths({"files": row("c")}, row("c"))
            other.upsert_paths({"files": row("d")}, row("d"))
    assert sorted(r["path"] for r in store.read("files").collect()) == ["a", "b", "d"]

    # Old versions go when their time is over, and what a writer left that died.
    (tmp_path / "s" / "files" / "left" / "_bucket=1").mkdir(parents=True)
    Store(spark, store.folder, keep_seconds=0).upsert_paths({"files": row("e")}, row("e"))
    named = {at for b, at in store._pointer()["files"].items() if not b.startswith("_")}
    assert {f"files/{p.parent.name}/{p.name}" for p in (tmp_path / "s" / "files").glob("*/_bucket=*")} == named and store.read("files").count() == 4
    assert not (tmp_path / "s" / "files" / "left").exists()


def test_filters_let_other_letters_through(spark):
    from pyspark.sql import functions as F

    from plumbline.functions import bloom

    held = bloom.built(["plain"])
    assert bloom.may_contain(held, "été") and bloom.may_contain(held, "plain") and not bloom.may_contain(held, "absent_name")
    one = spark.range(1).select(F.lit(held).alias("f"))
    assert one.select(bloom.may_contain_expr(F.col("f"), "été"), bloom.may_contain_expr(F.col("f"), "absent_name")).first()[:] == (True, False)
