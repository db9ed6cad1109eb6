"""Ordered operators cut into cells give what one sweep over each key gives, also where one key has nearly all rows."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cells, windows


def hot_rows(n, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng.randint(0, 3 * n), i) for i in range(n)]


def by_key(rows):
    out = {}
    for k, *rest in rows:
        out.setdefault(k, []).append(tuple(rest))
    return out


def test_numbers_run_on_over_cells(spark):
    rows = hot_rows(3000)
    got = cells.numbered(spark.createDataFrame(rows, "k string, at long, id long"), ["k"], ["at", "id"], "n", size=100)
    want = {(k, i): n + 1 for k, held in by_key(rows).items() for n, (_, i) in enumerate(sorted(held))}
    assert {(r["k"], r["id"]): r["n"] for r in got.collect()} == want
    held = cells.celled(spark.createDataFrame(rows, "k string, at long, id long"), ["k"], ["at", "id"], size=100)
    assert held.groupBy("_cell").count().agg(F.max("count")).first()[0] < 500


def greedily(rows):
    out = set()
    for k, held in by_key(rows).items():
        end = None
        for a, b, i in sorted(held):
            if end is None or a >= end:
                out.add((k, i))
                end = b
    return out


@pytest.mark.parametrize("long", [1, 40, 3000, 30_000])
def test_greedy_spans_of_a_hot_key(spark, long):
    rng = random.Random(long)
    rows = [(k, at, at + rng.choice([0, 1, rng.randint(0, long), -5]), i) for k, at, i in hot_rows(4000, long)]
    got = windows.greedy_spans(spark.createDataFrame(rows, "k string, start int, end int, span_id long"), "k", size=150)
    assert got.dtypes == [("k", "string"), ("start", "int"), ("end", "int"), ("span_id", "bigint")]
    found = [(r["k"], r["span_id"]) for r in got.collect()]
    assert set(found) == greedily(rows) and len(found) == len(set(found))


def test_greedy_spans_that_never_meet(spark):
    """Two chains that run side by side for ever: what a cell begins with decides all that follows."""
    rows = [("k", 10 * i + s, 10 * (i + 1) + s, 2 * i + (s > 0)) for i in range(2000) for s in (0, 5)]
    got = windows.greedy_spans(spark.createDataFrame(rows, "k string, start long, end long, span_id long"), "k", size=100)
    assert {r["span_id"] for r in got.collect()} == set(range(0, 4000, 2))


def test_a_key_of_many_spans(spark):
    spans = spark.range(600_000).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("start"), (F.col("id") * 3 + F.col("id") % 11).alias("end"), F.col("id").alias("span_id"))
    got = windows.greedy_spans(spans, "k", size=50_000)
    want, end = 0, 0
    for i in range(600_000):
        if 3 * i >= end:
            want, end = want + 1, 3 * i + i % 11
    assert got.count() == want


def test_last_before_and_runs_of_a_hot_key(spark):
    rows = hot_rows(3000, 5)
    bound = [(k, at, i, f"v{i}") for k, at, i in rows if i % 7 == 0]
    points = spark.createDataFrame(rows, "k string, at long, id long")
    got = windows.last_before(points, spark.createDataFrame(bound, "k string, at long, id long, v string"), "k", "at", ["id", "v"], "id", size=60)
    for r in got.collect():
        before = [(at, i) for k, at, i, _ in bound if k == r["k"] and at < r["at"]]
        assert r["last_id"] == (max(before)[1] if before else None) and r["last_v"] == (f"v{max(before)[1]}" if before else None)

    rng = random.Random(6)
    told = [(k, at, i, rng.choice(["x", "y", None])) for k, at, i in rows]
    want = []
    for k, held in by_key(told).items():
        n, last = 0, object()
        for _, _, v in sorted(held, key=lambda r: r[:2]):
            if v != last or n == 0:
                n += 1
                want.append([k, n, v, 0])
                last = v
            want[-1][3] += 1
    got = windows.value_runs(spark.createDataFrame(told, "k string, at long, id long, v string"), "k", ["at", "id"], "v", size=60).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(w)) for w in want)

    lines = spark.createDataFrame([("hot", i) for i in range(2000) if i % 50], "k string, line long")
    assert sorted(r["n_lines"] for r in windows.runs(lines, ["k"], "line", size=90).collect()) == [49] * 40
    assert windows.runs(lines.limit(0), ["k"], "line").count() == 0 and windows.greedy_spans(spark.createDataFrame([], "k string, start long, end long, span_id long"), "k").count() == 0
