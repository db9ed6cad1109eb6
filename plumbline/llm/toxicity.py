"""Toxicity: a linear classifier regularised by counterfactuals.

Features of a text are its distinct words and their prefixes of 4 to 6 bytes, which meet inflected forms that no label
has seen. Logistic regression is fitted on the driver to a sample of labelled rows that is bounded by parameter
(``sample`` rows of each class in the order of a digest of their id, and of these as many as ``sample_bytes`` of features
allow). For every training text that names a group, each swap of the identity term for another term of its set is a
counterfactual, kept as the two terms; the squared change of the score is added to the loss, so that the model can't
lean on who is mentioned. Features without a significant difference between the
classes take no part, which keeps long texts from gathering noise.

Only rows whose fold differs from ``held_out`` are learned from, and label, language, source and id are no features.
A null or empty text scores like a text without any known feature. Without labels of both classes the score is the
smoothed share of toxic labels. Repeated rows score alike, one row each; a label given twice counts once, toxic if one
says so, and null labels count for nothing. A label without a document counts in the shares of the classes only. Of
documents that share a labelled id the text that sorts first is learned from. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_rows, fold, python_rows, text_of

#: Terms that name groups of people, in sets whose members can stand for each other.
IDENTITY = (
    ("christian", "jewish", "muslim", "hindu", "buddhist", "atheist"),
    ("christians", "jews", "muslims", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("women", "men"),
    ("woman", "man"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("deaf", "blind", "disabled"),
    ("young", "old"),
)
BUCKETS = 1 << 22
PREFIXES = (4, 5, 6)
#: Bytes of UTF-8: ASCII letters and all bytes above 0x7F stay, the rest separates words.
LETTERS = bytes(c if 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
SWAPS = {t.encode(): [o.encode() for o in group if o != t] for group in IDENTITY for t in group}
FEATURES = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("features", pa.binary()), ("swaps", pa.list_(pa.binary()))])


def words_in(text: str) -> set[bytes]:
    return set(text.lower().encode().translate(LETTERS).split())


def features_of(word: bytes) -> list[int]:
    """Buckets of a word and its prefixes."""
    found = [zlib.crc32(b"w" + word) % BUCKETS]
    found += [zlib.crc32(b"%d" % n + word[:n]) % BUCKETS for n in PREFIXES if len(word) > n]
    return found


def _packed(words: set[bytes]) -> bytes:
    return np.array([f for w in sorted(words) for f in features_of(w)], dtype=np.int32).tobytes()


def learned_labels(labels: DataFrame, held_out: int, folds: int) -> DataFrame:
    """doc_id and toxic of every labelled document outside the held-out fold."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    return known.filter(fold("doc_id", folds) != held_out)


def sample_features(docs: DataFrame, labels: DataFrame, held_out: int, folds: int, sample: int, sample_bytes: int) -> DataFrame:
    """toxic, features and swaps of the sampled training texts: feature buckets of the text, and of the terms it can swap.

    A swap is the features of a term behind those of the other, which are as many as the first number says.
    """
    known = learned_labels(labels, held_out, folds)
    order = (F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    chosen = known.filter("toxic = 1").orderBy(*order).limit(sample).unionByName(
        known.filter("toxic = 0").orderBy(*order).limit(sample)
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in python_rows(batches):
            out = []
            for doc_id, toxic, text in rows:
                words = words_in(text)
                swaps = [swapped(term, other) for term in sorted(words & SWAPS.keys()) for other in SWAPS[term] if other not in words]
                out.append((doc_id, toxic, _packed(words), swaps))
            yield arrow_rows(out, FEATURES)

    # At most 2 * sample rows of two numbers are broadcast; repeated ids meet before their texts are shuffled.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    single = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    told = single.mapInArrow(scan, "doc_id long, toxic int, features binary, swaps array<binary>")
    # At most ``sample`` rows of each class meet here.
    size = F.length("features") + F.aggregate("swaps", F.lit(0), lambda n, x: n + F.length(x))
    ahead = Window.partitionBy("toxic").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return told.withColumn("ahead", F.sum(size).over(ahead)).filter(F.col("ahead").isNull() | (F.col("ahead") + size <= sample_bytes)).drop("ahead")


def swapped(term: bytes, other: bytes) -> bytes:
    own = features_of(term)
    return np.array([len(own), *own, *features_of(other)], dtype=np.int32).tobytes()


class Model:
    """An intercept and the weights of the feature buckets that count."""

    def __init__(self, intercept: float, weights: dict[int, float]) -> None:
        self.intercept, self.weights = intercept, weights
        self.memory: dict[bytes, float] = {}

    def __getstate__(self) -> tuple:
        return self.intercept, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def score(self, text: str) -> float:
        memory, weights, total = self.memory, self.weights, self.intercept
        if len(memory) > 500_000:
            memory.clear()
        # fsum rounds once, whatever the order of the set.
        parts = []
        for word in words_in(text):
            w = memory.get(word)
            if w is None:
                w = memory[word] = math.fsum(weights.get(f, 0.0) for f in features_of(word))
            if w:
                parts.append(w)
        total = math.fsum([total, *parts])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


def fit(rows: list[tuple[int, bytes, list[bytes]]], shares: tuple[float, float], swap_weight: float, l2: float, steps: int, z: float) -> Model:
    """Logistic regression on (toxic, features, swaps). ``shares``: numbers of labels of class 0 and 1."""
    texts = [np.frombuffer(features, dtype=np.int32) for _, features, _ in rows]
    labels = [toxic for toxic, _, _ in rows]
    swaps = [np.frombuffer(x, dtype=np.int32) for _, _, found in rows for x in found]
    y = np.array(labels, dtype=np.float64)
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        share = (shares[1] + 1) / (sum(shares) + 2)
        return Model(math.log(share / (1 - share)), {})
    # One small counter per bucket and class, tested a slice at a time, keeps the driver's memory low.
    counts = np.zeros((2, BUCKETS), dtype=np.int32)
    for ids, label in zip(texts, labels, strict=True):
        counts[label, np.unique(ids)] += 1
    found = []
    for at in range(0, BUCKETS, 1 << 18):
        b, a = counts[:, at : at + (1 << 18)].astype(np.float64)
        p, q, both = (a + 0.5) / (pos + 1), (b + 0.5) / (neg + 1), (a + b + 1) / (pos + neg + 2)
        test = np.abs(p - q) / np.sqrt(both * (1 - both) * (1 / pos + 1 / neg))
        found.append(at + np.flatnonzero((test >= z) & (a + b >= 3)))
    chosen = np.concatenate(found)
    del counts
    column = np.full(BUCKETS, -1, dtype=np.int32)
    column[chosen] = np.arange(len(chosen))
    held = [c[c >= 0] for c in (column[t] for t in texts)]
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    col = np.concatenate(held).astype(np.int64)
    apart = [(column[x[1 + x[0] :]], column[x[1 : 1 + x[0]]]) for x in swaps]
    pair_row = np.repeat(np.arange(len(apart)), [len(u) + len(v) for u, v in apart]) if apart else np.zeros(0, dtype=np.int64)
    pair_col = np.concatenate([np.concatenate(uv) for uv in apart]).astype(np.int64) if apart else np.zeros(0, dtype=np.int64)
    sign = np.concatenate([np.r_[np.ones(len(u)), -np.ones(len(v))] for u, v in apart]) if apart else np.zeros(0)
    used = pair_col >= 0
    pair_row, pair_col, sign = pair_row[used], pair_col[used], sign[used]
    weight = np.where(y == 1, shares[1] / pos, shares[0] / neg)
    weight = weight / weight.sum()
    w, n = np.zeros(len(chosen) + 1), len(chosen)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        margin = w[n] + np.bincount(row, weights=w[col], minlength=len(y))
        err = weight * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y)
        grad = np.r_[np.bincount(col, weights=err[row], minlength=n) + l2 * w[:n], err.sum()]
        if len(apart):
            change = np.bincount(pair_row, weights=sign * w[pair_col], minlength=len(apart))
            grad[:n] += 2 * swap_weight / len(apart) * np.bincount(pair_col, weights=sign * change[pair_row], minlength=n)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 / math.sqrt(1 + step / 50) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return Model(float(w[n]), {int(f): float(x) for f, x in zip(chosen, w[:n], strict=True) if x})


def train(
    docs: DataFrame,
    labels: DataFrame,
    held_out: int = 2,
    folds: int = 4,
    sample: int = 4000,
    sample_bytes: int = 16 << 20,
    swap_weight: float = 1.0,
    l2: float = 1e-4,
    steps: int = 300,
    z: float = 3.0,
) -> Model:
    """The classifier, from at most ``sample`` labelled rows of each class and ``sample_bytes`` of their features."""
    told = sample_features(docs, labels, held_out, folds, sample, sample_bytes).toArrow()
    # In an order that doesn't depend on partitions, so that reruns add in the same order.
    rows = sorted(zip(*(told.column(c).to_pylist() for c in ("toxic", "features", "swaps")), strict=True))
    del told
    counts = {r["toxic"]: r["n"] for r in learned_labels(labels, held_out, folds).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return fit(rows, (counts.get(0, 0), counts.get(1, 0)), swap_weight, l2, steps, z)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, held_out: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, in one pass. The model is bounded by its sample."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.score
        for rows in python_rows(batches):
            yield arrow_rows([(doc_id, out, score(text)) for doc_id, out, text in rows], schema)

    held = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == held_out).alias("held_out"), text_of().alias("text")
    )
    return held.mapInArrow(scan, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int")
    )


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    return scored(docs, train(docs, labels), threshold)


def not_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score stays below ``threshold``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(sent.value.score)

    return docs.filter(score(text_of()) < threshold)
