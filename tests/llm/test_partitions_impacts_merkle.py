"""Learned partitions, the bit-sliced impact index and the Merkle manifest against brute force and on awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import impacts, merkle, partitions, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [
    (1, None, "en", "a", 0),
    (2, "", None, None, None),
    (3, "   \n \t\n", "en", "a", 5),
    (4, "word Word " * 30_000, "en", "b", None),
    (5, "same TEXT here\nand there", "en", "b", 3),
    (5, "same TEXT here\nand there", "en", "b", 3),
    (None, "No id at all", "de", "c", 1),
    (None, "No id at all", "de", "c", 1),
    (6, "Été \U0001f600 naïve ÉTÉ", "fr", None, 2),
    (7, "-", "", "", 1),
]


def docs(spark, rows=None):
    return spark.createDataFrame(AWKWARD if rows is None else rows, DOCS)


def clashing(spark, rows=None):
    given = docs(spark, rows)
    for name in "tree digest row idx n _turn _at _part _by _by0 kids run up proof query q rank score terms tfs held a.b vec_id root".split():
        given = given.withColumn(name, F.lit("clash"))
    return given


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


# --- learned partitions ---


def dot(v, w):
    s = 0.0
    for a, b in zip(v, w):
        s += a * b
    return s


def nearest_slowly(rows, k=20, every=20):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in good:
        if i % every == 0:
            scored = sorted((-dot(v.tolist(), w.tolist()), j) for j, w in good if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def of_query(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def test_recall_on_the_given_vectors(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = nearest_slowly(rows), of_query(queries.op11_partitions(spark, sf))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    whole = {q: dict(found) for q, found in nearest_slowly(rows, k=len(rows)).items()}
    assert all(whole[q][i] == s for q in whole for i, s in got[q])


def test_clusters_are_found_in_few_partitions(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 24)) * 4
    x = centres[rng.integers(0, 40, 6000)] + rng.standard_normal((6000, 24)) * 0.3
    rows = [(i, x[i].astype(np.float32).tolist(), 0) for i in range(len(x))]
    given = vectors(spark, rows)
    model = partitions.fitted(partitions.taking_part(given), 20, 32, 4096, 0.93)
    visits = model.visits(x[::20])
    assert visits.shape[1] == 32 and visits.sum(axis=1).mean() <= 8
    got = of_query(partitions.nearest(given, parts=32, sample=4096))
    exact = x.astype(np.float32).astype(float)
    hits = 0
    for q in got:
        s = exact @ exact[q]
        s[q] = -np.inf
        hits += len({i for i, _ in got[q]} & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 300 and hits >= 0.9 * 20 * 300


def test_parts_of_a_graph_are_balanced():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1000, 8))
    near = np.argsort(-(x @ x.T), axis=1)[:, 1:11]
    part = partitions.balanced_parts(near, 8)
    assert np.bincount(part).tolist() == [125] * 8
    assert (part[near] == part[:, None]).mean() > 2 / 8


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 0), (20, None, 0), (40, [0.0, 0.0], 0), (60, [nan, 1.0], 0), (80, [inf, 1.0], 0), (None, [1.0, 1.0], 0), (100, [], 0)]
    rows += [(120, [None, 1.0], 0), (1, [0.5], 0), (2, [0.5, 7.0, 3.0], 0), (3, [2.0, 2.0], 0), (3, [2.0, 2.0], 0), (140, [1.0, 0.0], 0), (140, [0.5, 0.5], 0)]
    given = vectors(spark, rows).withColumn("part", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("query_id", F.lit(None).cast("long"))
    got = of_query(partitions.nearest(given))
    assert got[0] == [(3, 2.0), (3, 2.0), (140, 1.0), (1, 0.5), (2, 0.5), (140, 0.5)]
    assert got.keys() == {0, 140} and [i for i, _ in got[140]] == [2, 3, 3, 0, 1]
    assert partitions.nearest(vectors(spark, [])).count() == 0
    assert of_query(partitions.nearest(vectors(spark, [(20, [1.0], 0)]))) == {}


def test_thousands_of_one_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i % 7), 1.0, -1.0], 0) for i in range(3000)]
    got = of_query(partitions.nearest(vectors(spark, rows), block=200, chunk=40, parts=8))
    want = nearest_slowly([(i, v) for i, v, _ in rows])
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert got.keys() == want.keys() and hits >= 0.9 * 20 * len(want)


# --- bit-sliced impacts ---


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


def ranked_slowly(texts, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in texts]
    n, length = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 100 - 25 + 25 * c.total() * n // max(1, length)
            s = sum(r * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, r in Counter(terms(text)).items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def searched(given, items, **how):
    return sorted(map(tuple, impacts.ranked_search(given, items, **how).collect()), key=repr)


def test_ranks_as_a_slow_reader(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "x9"]
    texts = [(i % 170, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(180)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 30])))) for i in range(12)] + [(3, "w1 W1 w1, w1 unheard")]
    given = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = ranked_slowly(texts, items)
    assert searched(given, asked) == want
    assert searched(given, asked, segment=7, batch_bytes=40) == want
    assert searched(given, asked, k=3, segment=64) == ranked_slowly(texts, items, 3)


@pytest.mark.parametrize("make", [docs, clashing])
def test_search_of_awkward_texts(spark, make):
    items = [(1, "word here ÉTÉ"), (None, "naïve id"), (2, None), (3, ""), (4, "unheard of"), (1, "word"), (5, "\U0001f600 all same same")]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    assert searched(make(spark), asked) == ranked_slowly([(r[0], r[1]) for r in AWKWARD], items)


def test_search_of_nothing(spark):
    asked = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert impacts.ranked_search(docs(spark, []), asked).count() == 0
    none = impacts.ranked_search(docs(spark), asked.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_slices_add_and_rank_as_numbers():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 200):
        values = rng.integers(0, 2**30, (9, n)) * (rng.random((9, n)) < 0.5)
        width = int(values.sum(axis=0).max()).bit_length() + 1
        slices = impacts.total([impacts.packed(impacts.bits_of(v, width)) for v in values])
        whole = values.sum(axis=0)
        assert impacts.values_at(slices, np.arange(n)).tolist() == whole.tolist()
        got = impacts.best(slices, 20)
        want = sorted(range(n), key=lambda i: (-whole[i], i))[:20]
        assert sorted(got.tolist()) == sorted(i for i in want if whole[i] > 0)


# --- Merkle ---


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tampered(row):
    lower = row[1] and "".join(c.lower() if c < "\x80" else c for c in row[1])
    return (row[0], lower, *row[2:]) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 else row


def climb(nodes, arity=8):
    """The top of a run tree, and for each node its steps: what stands left and right of it on every level."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for i, own in enumerate(at):
            run, place = runs[own // arity], own % arity
            steps[i].append(("".join(run[:place]), "".join(run[place + 1 :])))
            at[i] = own // arity
        level = [h(*run) for run in runs]
    return level[0], steps


def manifest_slowly(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    held = {t: sorted(trees[t], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for t in names}
    tops = {t: climb([leaf(r) for r in held[t]]) for t in names}
    root, upper = climb([tops[t][0] for t in names])
    out = []
    for t, more in zip(names, upper):
        for r, own in zip(held[t], tops[t][1]):
            fold = leaf(tampered(r))
            for left, right in own + more:
                fold = h(left, fold, right)
            out.append((r[0], leaf(r), tops[t][0], root, h(*(x for s in own + more for x in s)), fold, fold == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("make", [docs, clashing])
def test_manifest_of_awkward_rows(spark, make):
    got = merkle.merkle_manifest(make(spark))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == manifest_slowly(AWKWARD)


@pytest.mark.parametrize("n, langs", [(0, 1), (1, 1), (8, 1), (9, 1), (65, 1), (600, 3), (300, 70)])
def test_manifest_of_many_rows(spark, n, langs):
    rng = random.Random(n)
    rows = [(rng.randrange(-50, n), f"Text Number {i % 50}", f"l{min(i % (2 * langs), langs - 1)}", "s", i) for i in range(n)]
    got = sorted(map(tuple, merkle.merkle_manifest(docs(spark, rows).repartition(5)).collect()), key=repr)
    assert got == (manifest_slowly(rows) if rows else [])


def test_equal_rows_are_spread(spark):
    """A third of all rows are one row: the numbering must not gather them in one task."""
    rows = [(7 if i % 3 == 0 else i, "t", "en", "s", 1) for i in range(3000)]
    leaves = docs(spark, rows).select(F.lit("=en").alias("tree"), "doc_id", F.lit("x").alias("digest"))
    got = merkle.numbered(leaves, ["doc_id", "digest"])
    assert sorted(r["idx"] for r in got.collect()) == list(range(3000))
    places = [(r["doc_id"], r["idx"]) for r in got.collect()]
    assert [d for d, _ in sorted(places, key=lambda p: p[1])] == sorted(d for d, _ in places)


@pytest.mark.parametrize("name", ["op12_impacts", "op13_merkle"])
def test_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = con.execute(queries.ORACLES[name]).df()
    key = sorted(got.columns)
    assert sorted(want.columns) == key
    assert sorted(map(repr, got[key].itertuples(index=False, name=None))) == sorted(map(repr, want[key].itertuples(index=False, name=None)))
