"""The suffix tree against a slow one that walks every text token by token."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import suffix_tree

DOCS = "doc_id long, text string, digest string, ask_n int"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def corpus():
    rng = random.Random(3)
    names = [f"W{i}" for i in range(300)]
    phrases = [rng.choices(names, k=4) for _ in range(12)]
    rows = []
    for i in range(150):
        words = []
        while len(words) < 60:
            words += rng.choice(phrases) if rng.random() < 0.6 else [rng.choice(names), f"once{rng.randrange(10**6)}"]
        rows.append((i, " ".join(words), "clash", 1))
    return rows + [(3, rows[3][1], "again", 2), (200, None, None, None), (201, "", None, None), (None, "w1 w2 w1 unheard", None, None)]


def slow_scores(rows, frequent, smoothing, min_count, gain):
    """Contexts as tuples of symbols, counts in dictionaries."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [((r[1] or "").translate(lower).split() + ["<end>"], r[0] is None or not held(r[0])) for r in rows]
    c = Counter(w for t, learned in texts if learned for w in t)
    n, v = sum(c.values()), len(c)
    kind = lambda k: int(math.log2(k)) + 1 if k > 0 else 0
    classes = {0} | {kind(k) for k in c.values() if k <= frequent}
    symbol = lambda w: ("word", w) if c[w] > frequent else ("class", kind(c[w]))

    def less(w):
        if c[w] > frequent:
            return symbol(w)
        return ("class", kind(c[w] - 1) if kind(c[w] - 1) in classes else kind(c[w]))

    mass = Counter()
    share = Counter()
    for w, k in c.items():
        mass[symbol(w)] += k
        share[less(w)] += k
    size = len(classes) + sum(k > frequent for k in c.values())
    root = lambda s: (share[s] + 1) / (n + size)
    seqs = [([("start",), *map(symbol, t)], [None, *map(less, t)], learned) for t, learned in texts]
    counts = defaultdict(Counter)
    kept = {}

    def p(context, s):
        """By the longest retained suffix of ``context``."""
        for k in range(len(context), 0, -1):
            if context[-k:] in kept:
                total, m = kept[context[-k:]]
                return (counts[context[-k:]][s] + m * p(context[-k + 1 :] if k > 1 else (), s)) / (total + m)
        return root(s)

    allowed = None
    for level, m in enumerate(smoothing, 1):
        seen = Counter()
        for seq, other, learned in seqs:
            for i in range(level, len(seq)):
                context = tuple(seq[i - level : i])
                often = level == 1 or counts[context[1:]][other[i]] >= 2
                if learned and often and (allowed is None or context in allowed):
                    counts[context][other[i]] += 1
                    seen[context] += 1
        verdicts = {}
        for context, total in seen.items():
            up = {s: p(context[1:], s) for s in counts[context]}
            nats = sum(k * math.log((k - 1 + m * up[s]) / up[s] / (total - 1 + m)) for s, k in counts[context].items())
            if total >= min_count and nats >= gain:
                verdicts[context] = (total, m)
        kept |= verdicts
        # Longer contexts are looked at where the shorter one has met their last symbol often enough.
        allowed = {x + (s,) for x in seen for s, k in counts[x].items() if k >= min_count}
    out = []
    for (t, _), (seq, _, _) in zip(texts, seqs):
        total = base = 0.0
        for i, w in enumerate(t, 1):
            inside = 1.0 if c[w] > frequent or not c[w] else c[w] / mass[symbol(w)]
            total += math.log10(p(tuple(seq[max(0, i - len(smoothing)) : i]), symbol(w)) * inside)
            base += math.log10((c[w] + 1) / (n + v + 1))
        out.append((len(t), sum(c[w] > 0 for w in t), n, base, total))
    return out, kept, (p, c, classes, frequent, mass)


@pytest.mark.parametrize("batch_bytes", [1 << 20, 2000])
def test_scores_match_a_slow_tree(spark, batch_bytes):
    rows = corpus()
    how = {"frequent": 6, "smoothing": (8.0, 5.0, 3.0), "min_count": 4, "gain": 2.0}
    want, kept, _ = slow_scores(rows, **how)
    assert {len(x) for x in kept} == {1, 2, 3}
    got = suffix_tree.language_scores(spark.createDataFrame(rows, DOCS), batch_bytes=batch_bytes, **how).collect()
    key = lambda d, x: (d is None, d or 0, x[0], round(x[4], 6))
    mine = sorted(((r["doc_id"], (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]), r["held_out"]) for r in got), key=lambda r: key(*r[:2]))
    theirs = sorted(((r[0], w) for r, w in zip(rows, want)), key=lambda r: key(*r))
    assert [m[0] for m in mine] == [t[0] for t in theirs]
    for (doc_id, m, out), (_, w) in zip(mine, theirs):
        assert m[:3] == w[:3] and m[3:] == pytest.approx(w[3:], abs=1e-6) and out == (doc_id is not None and held(doc_id))


def test_probabilities_sum_to_one():
    rows = corpus()
    _, kept, (p, c, classes, frequent, _) = slow_scores(rows, 6, (8.0, 5.0, 3.0), 4, 2.0)
    symbols = [("class", k) for k in classes] + [("word", w) for w, k in c.items() if k > frequent]
    for context in [(), *list(kept)[::40]]:
        assert sum(p(context, s) for s in symbols) == pytest.approx(1)


def test_the_tree_beats_single_words_on_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    r = suffix_tree.language_scores(docs).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert (r["s"] - r["b"]) / r["n"] > 0.4


def test_awkward_tables(spark):
    empty = suffix_tree.language_scores(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.columns[0] == "doc_id"
    one = suffix_tree.language_scores(spark.createDataFrame([(5, None, "x", 1), (5, "a " * 30_000, "x", 1)], DOCS)).collect()
    assert sorted((r["n_tokens"], r["n_known"]) for r in one) == [(1, 1), (30_001, 30_001)]


@pytest.mark.parametrize("top", [3, 1 << 20, (1 << 64) - 1])
def test_hashes_are_sorted_as_numpy_sorts_them(top):
    rng = np.random.default_rng(5)
    some = rng.integers(0, top, 3000, dtype=np.uint64, endpoint=True)
    near = some[:500] ^ np.uint64(1 << 13)  # share their upper bits with another
    keys = rng.permutation(np.r_[some, near, some[:1500], [np.uint64(0), np.uint64(top)]].astype(np.uint64))
    for part in (keys, keys[:1], keys[:0]):
        for got, want in zip(suffix_tree.distinct(part), np.unique(part, return_inverse=True), strict=True):
            assert (got == want).all() and len(got) == len(want)


def test_hashes_that_differ_in_the_lowest_bits_alone_are_told_apart():
    some = np.random.default_rng(6).integers(0, 1 << 62, 3000, dtype=np.uint64)
    keys = np.r_[some, some[:900] ^ np.uint64(1), some[:300], some[:200] ^ np.uint64(2)]
    for got, want in zip(suffix_tree.distinct(keys), np.unique(keys, return_inverse=True), strict=True):
        assert (got == want).all() and len(got) == len(want)


def test_batches_are_not_shuffled(spark):
    plan = suffix_tree.language_scores(spark.createDataFrame(corpus(), DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 4


def test_what_contexts_win_is_the_same_in_every_order(spark):
    """Sums of whole parts of a nat: batches of other sizes retain the same contexts, and tell the same scores to the last bits."""
    docs = spark.createDataFrame(corpus(), DOCS)
    how = {"frequent": 6, "smoothing": (8.0, 5.0, 3.0), "min_count": 4, "gain": 2.0}
    one, other = (
        {(r["doc_id"], r["n_tokens"], round(r["base_score"], 9)): r["score"] for r in suffix_tree.language_scores(docs, batch_bytes=b, **how).collect()}
        for b in (1 << 20, 1500)
    )
    assert one.keys() == other.keys() and all(one[k] == pytest.approx(other[k], abs=1e-12, rel=1e-14) for k in one)
