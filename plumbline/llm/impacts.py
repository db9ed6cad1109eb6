"""Ranked lexical search over a bit-sliced impact index.

A term's impact in a document is an integer: its weight, which falls with the documents that hold it, times a share that
grows with its occurrences and falls with the document's length. The index is cut into segments of some thousand
documents, a row each, their documents in the order of doc_id. For every term of a segment it keeps one bitmap of the
documents that hold it and, over those documents, one bitmap for each bit of their impacts (slice i has bit i).

A query adds the slices of its terms without ever looking at a single document: three sets of slices become two by
bitwise sum and carry, until two are left, which a ripple of carries makes one. A term that occurs r times in the query
is added once for each bit of r, its slices moved up. The best k are then found from the most significant slice
downwards: documents that have the bit are taken as long as they are no more than k, else only they go on.

Two passes over the documents' words: the first keeps, for each document, its length and the occurrences of the terms
that the queries hold, and counts documents and lengths over the whole table; the second makes the segments, which are
written. Queries are sent to the executors in batches of at most ``batch_bytes`` of text (one longer text is a batch of
its own), each with an index of its terms, and every segment answers each query with at most k documents. So a task holds
one segment, and no key gathers more than k rows of a segment.

Terms are maximal runs of letters, digits and characters beyond ASCII, only A-Z lower-cased. A null or empty text has no
terms; such documents count for nothing and such queries get no rows. Equal scores go to the smaller doc_id, null last;
rows that share a doc_id are separate documents, rows that share an item_id separate queries. Only scores above 0 are
returned. Texts of any length are read whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import arrow_rows, discard, python_rows, written

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of unpacked slices that a task keeps for the next queries.
KEPT = 64 << 20
SEGMENT = pa.schema(
    [
        ("doc_ids", pa.list_(pa.int64())),
        ("terms", pa.list_(pa.int32())),
        ("held", pa.list_(pa.int32())),
        ("widths", pa.list_(pa.int32())),
        ("present", pa.binary()),
        ("slices", pa.binary()),
    ]
)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text."""
    return TERM.findall(text.lower()) if text else []


# --- bit slices: arrays of 64-bit words, one row for each bit, least significant first ---


def words_for(n: int) -> int:
    return -(-n // 64)


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as rows of words."""
    out = np.zeros((len(bits), words_for(bits.shape[1]) * 8), dtype=np.uint8)
    short = np.packbits(bits, axis=1, bitorder="little")
    out[:, : short.shape[1]] = short
    return out.view("<u8")


def places(bitmap: np.ndarray) -> np.ndarray:
    """Where a bitmap has ones."""
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def bits_of(values: np.ndarray, width: int) -> np.ndarray:
    return ((values[None, :] >> np.arange(width, dtype=np.int64)[:, None]) & 1).astype(np.uint8)


def carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sets of slices with the sum of three."""
    half = a ^ b
    carry = np.zeros_like(a)
    carry[1:] = ((a & b) | (half & c))[:-1]
    return half ^ c, carry


def total(parts: list[np.ndarray]) -> np.ndarray:
    """The slices of the sum; all parts have as many slices as the sum needs."""
    while len(parts) > 2:
        whole = len(parts) // 3 * 3
        parts = [x for i in range(0, whole, 3) for x in carry_save(*parts[i : i + 3])] + parts[whole:]
    if len(parts) == 1:
        return parts[0]
    a, b = parts
    out, carry = a ^ b, np.zeros_like(a[0])
    both = a & b
    for i in range(len(out)):
        half = out[i].copy()
        out[i] ^= carry
        carry = both[i] | (half & carry)
    return out


def best(slices: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest sums above 0, most of them; among equal ones at the edge the first places."""
    sure = np.zeros_like(slices[0])
    level = np.bitwise_or.reduce(slices, axis=0)
    n_sure, n_level = 0, int(np.bitwise_count(level).sum())
    for i in range(len(slices) - 1, -1, -1):
        if n_sure + n_level <= k:
            break
        up = level & slices[i]
        n_up = int(np.bitwise_count(up).sum())
        if n_sure + n_up > k:
            level, n_level = up, n_up
        else:
            sure, n_sure = sure | up, n_sure + n_up
            level, n_level = level & ~up, n_level - n_up
    return np.concatenate([places(sure), places(level)[: k - n_sure]])


def values_at(slices: np.ndarray, at: np.ndarray) -> np.ndarray:
    ones = (slices[:, at // 64] >> (at % 64).astype(np.uint64)[None, :]) & np.uint64(1)
    return (ones.astype(np.int64) << np.arange(len(slices), dtype=np.int64)[:, None]).sum(axis=0)


# --- the index ---


@dataclass
class ImpactIndex:
    """Segments, and the numbers of the terms they know."""

    segments: DataFrame
    vocabulary: dict[bytes, int]
    documents: int
    length: int


def occurrences(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms in the text), and the known terms with their occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for rows in python_rows(batches):
            out = []
            for doc_id, text in rows:
                found = Counter(map(number, terms_of(text)))
                n = found.total()
                found.pop(None, None)
                out.append((doc_id, n, list(found), list(found.values())))
            yield arrow_rows(out, schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(read, "doc_id long, n long, terms array<int>, tfs array<long>")


def segment_of(rows: list[tuple], weights: dict[int, int], documents: int, length: int) -> tuple:
    """The index row of some documents, as occurrences() has them."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    size = words_for(len(rows)) * 64
    term = np.array([t for r in rows for t in r[2]], dtype=np.int64)
    tf = np.array([x for r in rows for x in r[3]], dtype=np.int64)
    at = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    norm = np.array([100 - 25 + 25 * r[1] * documents // length for r in rows], dtype=np.int64)
    weight = np.array([weights[t] for t in term.tolist()], dtype=np.int64)
    impact = weight * ((1_000_000_000 * tf) // (1000 * tf + 12 * norm[at]))
    order = np.lexsort((at, term))
    order = order[impact[order] > 0]
    term, at, impact = term[order], at[order], impact[order]
    names, starts = np.unique(term, return_index=True)
    held, widths, present, slices = [], [], [], []
    for begin, end in zip(starts, [*starts[1:], len(term)], strict=True):
        own = impact[begin:end]
        bitmap = np.zeros((1, size), dtype=np.uint8)
        bitmap[0, at[begin:end]] = 1
        held.append(int(end - begin))
        widths.append(int(own.max()).bit_length())
        present.append(np.packbits(bitmap, bitorder="little").tobytes())
        slices.append(np.packbits(bits_of(own, widths[-1]), axis=1, bitorder="little").tobytes())
    return [r[0] for r in rows], names.tolist(), held, widths, b"".join(present), b"".join(slices)


def impact_index(docs: DataFrame, vocabulary: Iterable[bytes], segment: int = 8192, postings: int = 2_000_000) -> ImpactIndex:
    """The index of all documents for the terms of ``vocabulary``, in segments of at most so many documents and postings."""
    numbers = {t: i for i, t in enumerate(sorted(set(vocabulary)))}
    held = written(occurrences(docs, numbers), "occurrences")
    one = held.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("length")).first()
    documents, length = one["documents"], one["length"] or 0
    counts = held.select(F.explode("terms").alias("term")).groupBy("term").count()  # a row for each term of the queries at most
    weights = {r["term"]: math.floor(1000 * math.log((2 * documents + 2) / (2 * r["count"] + 1))) for r in counts.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[tuple] = []
        load = 0
        for rows in python_rows(batches):
            for row in rows:
                if not row[2]:
                    continue
                if some and (len(some) == segment or load + len(row[2]) > postings):
                    yield arrow_rows([segment_of(some, shared.value, documents, length)], SEGMENT)
                    some, load = [], 0
                some.append(row)
                load += len(row[2])
        if some:
            yield arrow_rows([segment_of(some, shared.value, documents, length)], SEGMENT)

    schema = "doc_ids array<long>, terms array<int>, held array<int>, widths array<int>, present binary, slices binary"
    segments = written(held.mapInArrow(cut, schema), "segments")
    discard(held)
    return ImpactIndex(segments, numbers, documents, length)


class Segment:
    """The slices of a segment, unpacked as queries ask for them."""

    def __init__(self, row: dict) -> None:
        self.doc_ids = row["doc_ids"]
        self.words = words_for(len(self.doc_ids))
        self.present, self.slices = row["present"], row["slices"]
        self.entry = {}
        begin = 0
        for i, (term, held, width) in enumerate(zip(row["terms"], row["held"], row["widths"], strict=True)):
            self.entry[term] = (i, held, width, begin)
            begin += width * -(-held // 8)
        self.open: dict[int, np.ndarray] = {}
        self.kept = 0

    def term(self, term: int) -> np.ndarray | None:
        """The slices of a term over all documents of the segment."""
        if term not in self.entry:
            return None
        if term not in self.open:
            i, held, width, begin = self.entry[term]
            bitmap = np.frombuffer(self.present, dtype=np.uint8, count=self.words * 8, offset=i * self.words * 8)
            short = np.frombuffer(self.slices, dtype=np.uint8, count=width * -(-held // 8), offset=begin).reshape(width, -1)
            bits = np.zeros((width, self.words * 64), dtype=np.uint8)
            bits[:, places(bitmap)] = np.unpackbits(short, axis=1, count=held, bitorder="little")
            whole = packed(bits)
            while self.open and self.kept + whole.nbytes > KEPT:
                self.kept -= self.open.pop(next(iter(self.open))).nbytes
            self.open[term] = whole
            self.kept += whole.nbytes
        return self.open[term]

    def search(self, query: list[tuple[int, int]], k: int) -> list[tuple[int | None, int]]:
        """The best k documents of a query, a list of terms and their repeats."""
        found = [(self.term(t), repeats) for t, repeats in query if t in self.entry]
        if not found:
            return []
        width = sum(repeats << len(s) for s, repeats in found).bit_length()
        parts = []
        for s, repeats in found:
            for up in range(repeats.bit_length()):
                if repeats >> up & 1:
                    part = np.zeros((width, self.words), dtype="<u8")
                    part[up : up + len(s)] = s
                    parts.append(part)
        slices = total(parts)
        at = best(slices, k)
        return [(self.doc_ids[p], v) for p, v in zip(at.tolist(), values_at(slices, at).tolist(), strict=True)]


def search(index: ImpactIndex, queries: list[tuple[object, list[bytes]]], kind: T.DataType, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of each query, an id and its terms."""
    spark = index.segments.sparkSession
    known = index.vocabulary
    asked = [(item, sorted(Counter(known[t] for t in terms if t in known).items())) for item, terms in queries]
    shared = spark.sparkContext.broadcast([terms for _, terms in asked])
    out = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = Segment(batch.slice(i, 1).to_pylist()[0])
                yield arrow_rows([(q, *row) for q, terms in enumerate(shared.value) for row in held.search(terms, k)], out)

    found = index.segments.mapInArrow(ask, "query int, doc_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(asked)], T.StructType([T.StructField("q", T.IntegerType()), T.StructField("item_id", kind)]))
    return ranked.join(F.broadcast(names), F.col("query") == F.col("q")).select("item_id", "rank", "doc_id", "score")


def batches_of(items: DataFrame, batch_bytes: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Ids and terms of the items that have terms, at most so many bytes of text at a time."""
    texts = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text")).filter(F.octet_length("text") > 0)
    some, load = [], 0
    for r in texts.toLocalIterator():
        if not (terms := terms_of(bytes(r["text"]))):
            continue
        if some and load + len(r["text"]) > batch_bytes:
            yield some
            some, load = [], 0
        some.append((r["item_id"], terms))
        load += len(r["text"])
    if some:
        yield some


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, segment: int = 8192, batch_bytes: int = 4 << 20) -> DataFrame:
    """The k best documents of each item, by the sum of its terms' impacts: item_id, rank, doc_id, score."""
    kind = items.schema["item_id"].dataType
    out = None
    for some in batches_of(items, batch_bytes):
        found = search(impact_index(docs, {t for _, terms in some for t in terms}, segment), some, kind, k)
        out = found if out is None else out.unionByName(found)
    if out is not None:
        return out
    names = T.StructType([T.StructField("item_id", kind)])
    return docs.sparkSession.createDataFrame([], names).selectExpr("item_id", "cast(null as int) rank", "cast(null as long) doc_id", "cast(null as long) score")
