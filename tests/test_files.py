"""Listing by executors gives what one process finds; refreshes write the buckets that they touch."""

import os

import pytest
from pyspark.sql import functions as F

from plumbline.engine import Engine, TextsEngine
from plumbline.sources import files


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    base = tmp_path_factory.mktemp("wide")
    for i in range(12):
        for j in range(8):
            folder = base / f"pkg{i}" / f"_sub{j}" / "deep"
            folder.mkdir(parents=True)
            for k in range(6):
                (folder.parent / f"m{k}.py").write_text(f"x_{i}_{j}_{k} = {k}\n")
                (folder / f".n{k}.pyx").write_text("y = 1\n")
            (folder / "data.txt").write_text("no")
    (base / ".gitignore").write_text("m5.py\n/pkg3/\n")
    (base / "pkg1" / ".gitignore").write_text("!m5.py\n_sub2/\ndeep/.n1.pyx\n")
    (base / ".git").mkdir()
    (base / ".git" / "x.py").write_text("")
    os.symlink(base / "pkg0", base / "linked")
    return str(base)


@pytest.mark.parametrize("cython", [False, True])
def test_listing_as_one_process_walks(spark, tree, cython):
    # A root inside of another is listed for itself, without the ignore rules above it.
    want = {p: (s, m) for root in (tree, f"{tree}/pkg4") for p, s, m in files.walk(root, ["*pkg2*"], cython)}
    got = files.listing(spark, [f"{tree}/pkg4", tree, f"{tree}/absent"], ["*pkg2*"], cython).collect()
    assert {r["path"]: (r["size"], r["mtime_ns"]) for r in got} == want and len(got) == len(want) > 300
    assert {r["root"] for r in got if "/pkg4/" in r["path"]} == {f"{tree}/pkg4"} and {r["root"] for r in got if "/pkg5/" in r["path"]} == {tree}
    assert files.listing(spark, [], []).count() == 0


def test_some_paths_are_listed_as_all_are(spark, tree):
    whole = {r["path"]: tuple(r) for r in files.listing(spark, [tree], [], True).collect()}
    asked = [os.path.join(d, f) for d, _, names in os.walk(tree) for f in names] + [f"{tree}/none.py", "/elsewhere/a.py", tree]
    got = files.listed(spark.createDataFrame([(p,) for p in asked], "path string"), [tree], [], True).collect()
    assert {r["path"]: tuple(r) for r in got} == whole


def test_texts_come_in_batches_of_bytes(spark, tree):
    listed = files.listing(spark, [tree])
    texts = files.read_texts(listed, batch_bytes=100).collect()
    assert len(texts) == listed.count() and all(open(r["path"]).read() == r["text"] for r in texts)


def parts(engine):
    """The folders of every table."""
    return {name: {b: at for b, at in held.items() if not b.startswith("_")} for name, held in engine.store._pointer().items()}


def test_a_refresh_of_one_file_writes_one_bucket_of_each_table(spark, tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    for i in range(60):
        (root / f"m{i}.py").write_text(f'def f{i}():\n    """Says {i}."""\n    return g\n')
    engine = Engine(spark, str(tmp_path / "store"), [str(root)], [str(root)])
    engine.reconcile()
    before, counted = parts(engine), engine.status().first()
    assert len(before["symbols"]) > 10
    (root / "m7.py").write_text('def f7():\n    """Says 7."""\n    return g\n\ndef more():\n    """Says more."""\n')
    (root / "m61.py").write_text("z = 1\n")
    events = [(f"{root}/m7.py", "changed", 1), (f"{root}/m8.py", "deleted", 1), (f"{root}/m61.py", "created", 1), (f"{root}/gone.py", "changed", 1)]
    os.remove(root / "m8.py")
    engine.apply_events(spark.createDataFrame(events, "path string, event string, version long"))
    after = parts(engine)
    for name in ("files", "symbols", "docs", "reference_spans"):
        changed = {b for b in before[name] | after[name] if before[name].get(b) != after[name].get(b)}
        assert 1 <= len(changed) <= 4, name
        assert all(after[name][b] == at for b, at in before[name].items() if b not in changed)
    # Counters were moved by the difference and are those of a full count.
    now, full = engine.status().first(), engine.store.count_roots(engine.store.read("index_root_metadata").select("root")).first()
    assert (now["file_count"], now["symbol_count"], now["doc_count"]) == (full["file_count"], full["symbol_count"], full["doc_count"])
    assert now["file_count"] == counted["file_count"] and now["doc_count"] == counted["doc_count"]
    # What leaves symbols and documentation as they were leaves the exports unwritten.
    (root / "m9.py").write_text('def f9():\n    """Says 9."""\n    return h\n')
    engine.apply_events(spark.createDataFrame([(f"{root}/m9.py", "changed", 2)], "path string, event string, version long"))
    assert parts(engine)["export_table"] == after["export_table"] and parts(engine)["files"] != after["files"]
    assert engine.store.read("reference_spans").filter("name = 'h'").count() == 1


def test_an_index_of_a_table_looks_at_no_folder(spark, tmp_path, monkeypatch):
    def never(*args):
        raise AssertionError("a local folder was looked at")

    for name in ("root_fingerprint", "normalized", "entries", "namespace"):
        monkeypatch.setattr(files, name, never)
    texts = spark.createDataFrame([("/lib/a.py", "x = 1\n", "1"), ("/lib/b.py", "y = 1\n", "1")], "path string, text string, fingerprint string")
    engine = TextsEngine(spark, str(tmp_path / "store"), texts, "/lib")
    engine.reconcile()
    first = engine.store.read("index_root_metadata").first()["root_fingerprint"]
    other = TextsEngine(spark, str(tmp_path / "store"), texts.withColumn("fingerprint", F.lit("2")), "/lib")
    other.reconcile()
    assert other.store.read("index_root_metadata").first()["root_fingerprint"] != first and other.status().first()["file_count"] == 2
