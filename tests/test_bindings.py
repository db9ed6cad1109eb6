"""Intervals that hold points, and bindings that places see, against slow readers."""

import random

from pyspark.sql import functions as F

from plumbline.operators import bindings, intervals
from plumbline.plans.scopes import shapes
from plumbline.sources.tables import table

TEXT = '''import os, numpy as np
from pkg import (a as b,
    c)
x = 1

class K(Base):
    y = 2
    def m(self, p, *rest, q: int = (1, 2), **more):
        if p:
            z, (w, x) = p
            for i, j in rest:
                z += i
        elif q:
            z = 3
        else:
            global x
            z: int = 4
        with open(p) as f, g() as h:
            y = z  # no = binding
        while (n := p()):
            matrix[i, j] = n
            other.z = 5
        def inner(t):
            nonlocal z
            z = t
        return z
try:
    v = "if this: w = 1"
except Error as e:
    v = (1,
         2)
else:
    del v
if x: v = 3
print(v)
'''


def texts(spark, text=TEXT):
    return spark.createDataFrame([("/a.py", text)], "path string, text string")


def test_names_that_lines_bind(spark):
    cases = {
        "x = 1": "x", "a, (b, c) = f(x)": "a b c", "[a, *b] = c": "a b", "m[i] = 2": "", "o.p = 2": "", "x == 2": "", "f(x=1)": "", "x += 1": "x", "x **= 1": "x",
        "x: int = 3": "x", "x: int": "", "for i, j in z:": "i j", "for m[i] in z:": "", "async for q in z:": "q", "with a() as b, c() as (d):": "b d", "except E as e:": "e",
        "except E:": "", "del p, q": "p q", "import a.b, c as d": "a d", "from x import y as z, w": "w z", "from x import (": "", "def f(a, b=1):": "f", "async def g():": "g",
        "class C(D):": "C", "cdef class E:": "E", "cpdef int h(x):": "h", "if (n := f(x)) > 1:": "n", "x <= y": "", "x != y": "", "return x": "", "lambda x: x": "",
    }
    rows = spark.createDataFrame(list(cases.items()), "line string, want string")
    got = {r["line"]: " ".join(r["names"]) for r in rows.withColumn("names", bindings.bound_names(F.col("line"))).collect()}
    assert {k: got[k] for k in cases} == cases
    outer = spark.createDataFrame([("global a, b",), ("nonlocal c",), ("a = 1",)], "line string").select(bindings.outer_names(F.col("line")).alias("n")).collect()
    assert [r["n"] for r in outer] == [["a", "b"], ["c"], []]


def test_scopes_and_blocks_of_a_text(spark):
    lines = bindings.logical_lines(texts(spark)).cache()
    scopes = sorted((r["line"], r["start"], r["end"], r["kind"]) for r in bindings.scopes_of(lines).collect())
    assert scopes == [(5, 6, 25, "class"), (7, 8, 25, "function"), (22, 23, 24, "function")]
    blocks = sorted((r["line"], r["start"], r["end"], r["branch_of"], r["group_end"]) for r in bindings.blocks_of(lines).collect())
    assert blocks == [
        (8, 9, 11, 8, 16), (10, 11, 11, None, 11), (12, 13, 13, 8, 16), (14, 15, 16, 8, 16), (17, 18, 18, None, 18), (19, 20, 21, None, 21),
        (26, 27, 27, None, 27), (28, 29, 30, None, 30), (31, 32, 32, None, 32),
    ]


def test_what_places_see(spark):
    want = {
        ("z", 11): (9, "dominates", 9),  # in the branch that binds
        ("z", 12): (11, "conditional", None),  # where the next branch begins
        ("z", 13): (None, "hidden", None),  # the other branch
        ("z", 25): (16, "conditional", None),  # behind the if
        ("p", 25): (7, "dominates", 7),
        ("more", 10): (7, "dominates", 7),
        ("y", 8): (None, "hidden", None),  # the class's own name is not seen from its method
        ("y", 7): (6, "dominates", 6),
        ("x", 25): (3, "dominates", 3),  # declared global in the method
        ("v", 34): (32, "conditional", None),
        ("n", 20): (19, "dominates", 19),
        ("t", 24): (22, "dominates", 22),
        ("b", 34): (1, "dominates", 1),
    }
    lines = bindings.logical_lines(texts(spark))
    scopes = bindings.scopes_of(lines)
    places = spark.createDataFrame([("/a.py", *at) for at in want], "path string, name string, at int")
    got = bindings.seen_bindings(places, bindings.bindings_of(lines, scopes), scopes, bindings.blocks_of(lines)).collect()
    assert {(r["name"], r["at"]): (r["binding_at"], r["relation"], r["sure_at"]) for r in got} == want


def test_best_and_all_intervals_against_a_slow_reader(spark):
    rng = random.Random(4)
    held = [(rng.choice("ab"), s := rng.randint(-500, 5000), s + rng.choice([0, 1, 7, 8, 63, 700, 6000, -1]), i) for i in range(300)]
    points = [(rng.choice("abc"), rng.randint(-600, 9000)) for _ in range(400)] + [("a", 10)] * 3 + [(None, 5), ("a", None)]
    given = spark.createDataFrame(held, "k string, start long, end long, id int")
    asked = spark.createDataFrame(points, "k string, at long")
    got = intervals.best_holding(asked, given, ["k"], "at", {"first": F.col("id"), "latest": F.struct((-F.col("start")).alias("s"), "id")}).collect()
    want = {p: sorted((-s, i) for k, s, e, i in held if k == p[0] and p[1] is not None and s <= p[1] <= e) for p in points}
    assert len(got) == len(points)
    for r in got:
        found = want[(r["k"], r["at"])]
        assert r["first"] == min((i for _, i in found), default=None)
        assert (tuple(r["latest"]) if r["latest"] else None) == (found[0] if found else None)
    pairs = sorted((r["k"], r["at"], r["id"]) for r in intervals.all_holding(asked, given, ["k"], "at").collect())
    assert pairs == sorted((k, a, i) for k, a in points if a is not None and k for s, i in want[(k, a)])
    assert intervals.best_holding(asked, given.limit(0), ["k"], "at", {"first": F.col("id")}).filter("first is not null").count() == 0


def slow_relation(lines_scopes, lines_blocks, b, p):
    sb, sp, bb, bp = lines_scopes[b], lines_scopes[p], lines_blocks[b], lines_blocks[p]
    if sp[: len(sb)] != sb or (len(sb) < len(sp) and sb and sb[-1][1] == "class"):
        return "hidden"
    if bp[: len(bb)] == bb:
        return "dominates"
    if bb[: len(bp)] == bp:
        return "conditional"
    x, y = next((x, y) for x, y in zip(bb, bp) if x != y)
    return "hidden" if x[1] is not None and x[1] == y[1] else "conditional"


def test_random_texts_against_the_paths_of_their_lines(spark):
    """Relations by comparing the whole paths of scopes and blocks of both lines."""
    rng = random.Random(8)
    rows, wanted, places = [], {}, []
    for t in range(25):
        lines, scopes, blocks, binds = [], [], [], []

        def body(depth, sc, bl):
            for _ in range(rng.randint(1, 4)):
                kind = rng.choice(["bind", "bind", "use", "if", "for", "def", "class"]) if depth < 4 else "bind"
                pad = "    " * depth

                def add(text, sc=sc, bl=bl):
                    lines.append(pad + text)
                    scopes.append(list(sc))
                    blocks.append(list(bl))
                    return len(lines) - 1

                if kind == "bind":
                    n = rng.choice("uvw")
                    binds.append((add(f"{n} = 1"), n, False))
                elif kind == "use":
                    add("print(0)")
                elif kind == "if":
                    g = add("if q:")
                    body(depth + 1, sc, [*bl, (g, g)])
                    for _ in range(rng.randint(0, 2)):
                        e = add("elif r:")
                        body(depth + 1, sc, [*bl, (e, g)])
                    if rng.random() < 0.5:
                        e = add("else:")
                        body(depth + 1, sc, [*bl, (e, g)])
                elif kind == "for":
                    f = add("for i in s:")
                    body(depth + 1, sc, [*bl, (f, None)])
                    if rng.random() < 0.3:
                        e = add("else:")
                        body(depth + 1, sc, [*bl, (e, None)])
                else:
                    d = add(f"def f{len(lines)}(u):" if kind == "def" else f"class C{len(lines)}:")
                    inner = [*sc, (d, "function" if kind == "def" else "class")]
                    if kind == "def":
                        binds.append((d, "u", True))
                    body(depth + 1, inner, bl)

        body(0, [], [])
        rows.append((f"/{t}", "\n".join(lines)))
        own = {b: [*scopes[b], (b, "function")] if p else scopes[b] for b, _, p in binds}
        for p in range(len(lines)):
            for n in "uvw":
                places.append((f"/{t}", n, p))
                seen = []
                for b, m, param in binds:
                    if m == n and b < p:
                        held = dict(enumerate(scopes)) | {b: own[b]}
                        r = slow_relation(held, blocks, b, p) if not param else ("dominates" if scopes[p][: len(own[b])] == own[b] else "hidden")
                        if r != "hidden":
                            seen.append((-len(own[b]), not param, -b, r))
                seen.sort()
                sure = [s for s in seen if s[3] == "dominates"]
                wanted[(f"/{t}", n, p)] = (-seen[0][2], seen[0][3], -sure[0][2] if sure else None) if seen else (None, "hidden", None)
    lines = bindings.logical_lines(spark.createDataFrame(rows, "path string, text string"))
    scopes = bindings.scopes_of(lines)
    asked = spark.createDataFrame(places, "path string, name string, at int")
    got = bindings.seen_bindings(asked, bindings.bindings_of(lines, scopes), scopes, bindings.blocks_of(lines)).collect()
    assert {(r["path"], r["name"], r["at"]): (r["binding_at"], r["relation"], r["sure_at"]) for r in got} == wanted


def test_places_meet_bindings_in_one_sweep_and_large_keys_in_trees(spark, sf):
    scopes, blocks = shapes(spark, sf)
    items = table(spark, sf, "lineitem")
    bound = items.select(F.col("l_suppkey").alias("path"), (F.col("l_partkey") % 11).alias("name"), (F.col("l_orderkey") % 4096).alias("at"), (F.col("l_linenumber") == 1).alias("is_parameter"), F.col("l_linenumber").alias("id"))
    # One text has ten times as many places, two of them null.
    hot = bound.filter("path = 3").select("path", "name", F.explode(F.sequence(F.lit(0), F.lit(4000), F.lit(200))).alias("at"))
    odd = spark.createDataFrame([(3, None, 9), (3, 1, None), (None, 1, 5), (10**6, 1, 5)], "path long, name long, at long")
    places = bound.select("path", "name", (7 * F.col("at") % 4096).alias("at")).unionByName(hot).unionByName(odd)
    told = {n: bindings.seen_bindings(places, bound, scopes, blocks, payload=["id"], once=True, most=n) for n in (0, 2000, 10**9)}
    dealt = told[10**9]._jdf.queryExecution().executedPlan().toString()
    assert dealt.count("MapInArrow") == 1 and "Join" not in dealt and dealt.count("Exchange hashpartitioning(_key") == 1
    assert "MapInArrow" in (mixed := told[2000]._jdf.queryExecution().executedPlan().toString()) and "Join" in mixed
    rows = {n: sorted(map(str, df.select("path", "name", "at", "binding_at", "relation", "sure_at", "id").collect())) for n, df in told.items()}
    assert len(rows[0]) == places.distinct().count() and rows[0] == rows[2000] == rows[10**9]
    whole = bindings.seen_bindings(places.withColumn("at", F.col("at").cast("int")).withColumn("own", F.lit("o")), bound, scopes, blocks, payload=["id"])
    assert whole.count() == places.count() and whole.columns == ["path", "name", "at", "own", "binding_at", "relation", "sure_at", "id"]
    assert sorted(map(str, whole.drop("own").distinct().collect())) == rows[0]


def test_parameters_are_not_seen_in_the_head_of_their_function(spark):
    lines = bindings.logical_lines(texts(spark, "a = 0\ndef f(a,\n      b=1):\n    return a\n"))
    scopes = bindings.scopes_of(lines)
    places = spark.createDataFrame([("/a.py", "a", 2), ("/a.py", "a", 3)], "path string, name string, at int")
    for most in (0, 100):
        got = bindings.seen_bindings(places, bindings.bindings_of(lines, scopes), scopes, bindings.blocks_of(lines), most=most).collect()
        assert {r["at"]: r["binding_at"] for r in got} == {2: 0, 3: 1}


def test_chains_of_branches_and_outer_names_are_told_with_the_lines(spark):
    text = "if a:\n    x = 1\n    if b:\n        pass\n    else:\n        y = 2\nelif c:\n    pass\nelse:\n    z = 3\nfor i in j:\n    pass\nelse:\n    pass\ndef f():\n    if d: pass\n    global x, g\n    h = 1\n    def k():\n        x = 2\nglobal x\nx = 4\nelse:\n    v = 1\n"
    lines = bindings.logical_lines(texts(spark, text))
    plan = [df._jdf.queryExecution().optimizedPlan().toString() for df in (bindings.blocks_of(lines), bindings.scopes_of(lines), bindings.bindings_of(lines))]
    assert not any("Join" in p or "Aggregate" in p for p in plan)
    blocks = sorted((r["line"], r["start"], r["end"], r["branch_of"], r["group_end"]) for r in bindings.blocks_of(lines).collect())
    assert blocks == [
        (0, 1, 5, 0, 9), (2, 3, 3, 2, 5), (4, 5, 5, 2, 5), (6, 7, 7, 0, 9), (8, 9, 9, 0, 9), (10, 11, 11, None, 11), (12, 13, 13, None, 13), (22, 23, 23, None, 23)
    ]
    bound = sorted((r["at"], r["name"]) for r in bindings.bindings_of(lines).collect())
    assert bound == [(1, "x"), (5, "y"), (9, "z"), (10, "i"), (14, "f"), (17, "h"), (18, "k"), (19, "x"), (21, "x"), (23, "v")]
    assert {(r["text_lines"], r["scope"]) for r in lines.filter("line in (17, 19, 21)").collect()} == {(24, 15), (24, 19), (24, None)}
