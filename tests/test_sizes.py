"""What must not grow, and results that only show at size."""

import tracemalloc
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import __spark_entry__
from plumbline.engine import TextsEngine
from plumbline.functions import source
from plumbline.operators import bindings, extract, intervals
from plumbline.session import shared_folder


def test_spans_begin_at_rounded_seconds(spark, tmp_path):
    # 10.6 s is 11 in the SQL, so its span ends at 20011 and the one at 20010.3 s overlaps it.
    at = [datetime(1970, 1, 1, 0, 0, 10, 600_000), datetime(1970, 1, 1, 5, 33, 30, 300_000)]
    pq.write_table(pa.table({"event_id": pa.array([0, 5]), "ts": pa.array(at, pa.timestamp("us")), "user_id": pa.array([1, 1])}), tmp_path / "events.parquet")
    got = __spark_entry__.queries()["nonoverlap_greedy"](spark, str(tmp_path)).collect()
    assert [r["event_id"] for r in got] == [0]


def test_few_intervals_are_not_dealt_to_nodes(spark):
    # Keys of few intervals take no tree, those of many do, and both give the same.
    rows = [(k, s, s + 40, f"i{s}") for k, n in ((1, 3), (2, 60)) for s in range(0, 4 * n, 4)]
    spans = spark.createDataFrame(rows, "k int, start int, end int, label string")
    points = spark.createDataFrame([(k, p) for k in (1, 2, 3) for p in range(0, 300, 7)], "k int, p int")
    best = {"last": F.struct((-F.col("start")).alias("o"), "label")}
    told = {few: intervals.best_holding(points, spans, ["k"], "p", best, few=few) for few in (0, 10, 100)}
    plans = {few: df._jdf.queryExecution().toString() for few, df in told.items()}
    assert "_node" in plans[10] and "_node" not in plans[100]
    want = {(k, p): max(((s, x) for j, s, e, x in rows if j == k and s <= p <= e), default=(None, None))[1] for k in (1, 2, 3) for p in range(0, 300, 7)}
    for df in told.values():
        assert {(r["k"], r["p"]): r["last"] and r["last"]["label"] for r in df.collect()} == want


PARTS = "".join(f'def part_{k}(self, x):\n    """Makes {k}."""\n    return part_{k - 1}(x)\n\n' for k in range(20_000))


def peak(call):
    tracemalloc.start()
    call()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_docstrings_copy_no_rest_of_the_text():
    code = source.Code(PARTS)
    assert peak(lambda: source.docstring_at(code, code.text.index(":") + 1)) < len(PARTS) / 4


def test_trees_are_parsed_piece_by_piece():
    small = PARTS[: PARTS.index("def part_2000(")]
    assert peak(lambda: source.syntax_tree_rows("m", "/a.py", PARTS)) < 4 * peak(lambda: source.syntax_tree_rows("m", "/a.py", small))
    assert source.syntax_tree_rows("m", "/a.py", PARTS) == [(f"part_{k}", "function", 4 * k, None) for k in range(20_000)]


def test_pieces_tell_what_the_whole_tells(monkeypatch):
    decorated = "x = 1\n@a(\n  1)\ndef f():\n    pass\nclass K:\n    def m(self): pass\n"
    texts = [decorated, 'y = """\ndef g(): pass\n"""\ndef h(): pass\n', "if x:\n    pass\ndef f(): pass\nelse:\n    pass\n", "def f(:\n  pass\ndef g(): pass\n", "z = (\ndef f(): pass\n"]
    whole = [(source.syntax_tree_rows("m", "/a.py", t), source.diagnostics(t, "/a.py")) for t in texts]
    monkeypatch.setattr(source, "PIECE", 1)
    assert [(source.syntax_tree_rows("m", "/a.py", t), source.diagnostics(t, "/a.py")) for t in texts] == whole


def test_single_parts_are_those_of_parsed(spark):
    texts = spark.createDataFrame([("/lib/a.py", "a", "f", PARTS[:5000]), ("/lib/b.py", "b", "f", None)], "path string, module string, fingerprint string, text string")
    all_ = extract.parsed(texts)
    for mine, theirs in ((extract.symbols_of(extract.symbol_rows(texts)), extract.symbols_of(all_)), (extract.span_rows(texts), extract.spans_of(all_)), (extract.filter_rows(texts), extract.files_of(all_))):
        assert mine.schema.simpleString() == theirs.schema.simpleString()
        assert mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()


def test_an_index_is_built_without_broadcasts_that_spark_chooses(spark, tmp_path, monkeypatch):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before, seen = spark.conf.get(name), []
    texts = spark.createDataFrame([("/lib/a.py", "f", "def g(): pass\n")], "path string, fingerprint string, text string")
    made = TextsEngine(spark, str(tmp_path), texts, "/lib")
    monkeypatch.setattr(made, "_refresh", lambda *_: seen.append(spark.conf.get(name)))
    made.reconcile()
    assert seen == ["-1"] and spark.conf.get(name) == before
    assert "BroadcastHashJoin" not in made.texts(made.listing())._jdf.queryExecution().toString()


def test_what_places_see_has_a_short_plan(spark):
    texts = spark.createDataFrame([("a", "x = 1\ndef f(p):\n    if p:\n        x = 2\n    return x\n")], "path string, text string")
    shared_folder(spark)
    lines = bindings.logical_lines(texts).checkpoint()
    scopes = bindings.scopes_of(lines)
    places = spark.createDataFrame([("a", "x", 4)], "path string, name string, at int")
    found = bindings.seen_bindings(places, bindings.bindings_of(lines, scopes), scopes, bindings.blocks_of(lines))
    assert found._jdf.queryExecution().analyzed().toString().count("Join ") < 10
    assert [(r["binding_at"], r["relation"], r["sure_at"]) for r in found.collect()] == [(3, "conditional", 0)]
