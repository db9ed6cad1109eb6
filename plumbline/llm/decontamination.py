"""Benchmark decontamination: which words of a document lie inside a passage of a benchmark item.

A prefix-filtered set join finds the passages. The sets are the windows of an item: ``width`` consecutive words, or the
whole item if it is shorter. Words are ordered by how many documents of the corpus have them, rarest first; that takes
one pass over the documents, whatever the benchmark's size. A document can hold a whole window only if it has the
window's rarest word, so the prefix of one word is all that is joined. A word of the document that is some window's
prefix gives candidates; the length bound (the window must fit into the document at that place) and the positional
bound (the prefix word's place inside the window fixes where the window begins) leave one place for each, where all
words are compared.

A second pass over the documents finds the passages. If the windows' measured size is at most ``broadcast_bytes`` they go
to every executor and are compared there (a Python worker needs about eight times that for them). A larger benchmark is joined: executors get bit maps of a fixed size of the
prefixes and windows, documents send the windows that these let through, and an equi-join on the whole window keeps
the true ones. Both ways give the same rows.

Null or wordless texts have no words and no hits. Null item texts and items without words are ignored; items with equal
ids count as one, a null id is written "null". A document id may repeat: rows are told apart by their text, and rows that
agree in both have equal results, one each. Other columns are ignored, and come back with the rows that stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_rows, carried, python_rows, restored, text_of, written

#: Bytes of UTF-8: ASCII letters in lower case, ASCII digits and all bytes above 0x7F stay, the rest separates words.
TABLE = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
HITS = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
)
HITS_DDL = "doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


def windows_of(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """All windows of an item: every ``width`` consecutive words, or all words if they are fewer."""
    if len(words) <= width:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """window (its words joined by spaces), size and items: one row for every distinct window."""
    schema = pa.schema([("item", pa.string()), ("window", pa.binary()), ("size", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in python_rows(batches):
            for item, text in rows:
                found = {b" ".join(w): len(w) for w in windows_of(words_of(text), width)}
                if found:
                    yield arrow_rows([(item, window, size) for window, size in found.items()], schema)

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), text_of().alias("text"))
    cuts = named.mapInArrow(cut, "item string, window binary, size int")
    return cuts.groupBy("window", "size").agg(F.collect_set("item").alias("items"))


class Bits:
    """A set of byte strings as a bit map of fixed size: it may take a string for a member, but misses none."""

    def __init__(self, raw: bytes, power: int) -> None:
        self.raw, self.mask = raw, (1 << power) - 1
        self.memory: dict[bytes, bool] = {}

    def __getstate__(self) -> tuple:
        return self.raw, self.mask.bit_length()

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def __contains__(self, member: bytes) -> bool:
        known = self.memory.get(member)
        if known is None:
            if len(self.memory) > 500_000:
                self.memory.clear()
            at = xxhash.xxh64_intdigest(member, 42) & self.mask
            known = self.memory[member] = bool(self.raw[at >> 3] >> (at & 7) & 1)
        return known

    @classmethod
    def of(cls, members: DataFrame, column: Column, power: int) -> Bits:
        """From a column of binaries; 2 ** power bits in parts of 4 KB reach the driver."""
        at = F.xxhash64(column).bitwiseAND((1 << power) - 1) + 1
        parts = members.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit"))
        raw = np.zeros(max(1, (1 << power) // 8), dtype=np.uint8)
        for r in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
            begin = (r["part"] - 1) * 4096
            raw[begin : begin + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)[: len(raw) - begin]
        return cls(raw.tobytes(), power)


def rarity(docs: DataFrame, vocabulary: frozenset | Bits) -> DataFrame:
    """word and n, the number of documents that have it, for the words of ``vocabulary``, and some others of its Bits."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        exact = isinstance(vocabulary, frozenset)
        for rows in python_rows(batches):
            for (text,) in rows:
                words = words_of(text)
                seen.update(vocabulary.intersection(words) if exact else [w for w in set(words) if w in vocabulary])
            if len(seen) > 1_000_000:
                yield arrow_rows(list(seen.items()), schema)
                seen.clear()
        yield arrow_rows(list(seen.items()), schema)

    return docs.select(text_of().alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def prefixed(docs: DataFrame, benchmark: DataFrame, width: int, broadcast_bytes: int, power: int) -> tuple[DataFrame, bool]:
    """The windows with their prefix word, its place at, and n, how many documents have it; and whether they can be broadcast."""
    windows = written(item_windows(benchmark, width), "windows")
    words = windows.select("window", F.posexplode(F.split(F.col("window").cast("string"), " ")).alias("at", "said")).withColumn(
        "word", F.col("said").cast("binary")
    )
    size = F.length("window") + F.aggregate("items", F.lit(0), lambda n, x: n + F.length(x))
    small = (windows.agg(F.sum(size)).first()[0] or 0) <= broadcast_bytes
    vocabulary = words.select("word").distinct()
    known = frozenset(bytes(r["word"]) for r in vocabulary.toLocalIterator()) if small else Bits.of(vocabulary, F.col("word"), power)
    # A word that no document has comes first; its windows can't lead to a hit.
    counted = words.select("window", "at", "word").join(rarity(docs, known), "word", "left")
    rarest = counted.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("least"))
    return written(windows.join(rarest.filter("least.n > 0").select("window", "least.*"), "window"), "prefixes"), small


class Prefixes:
    """Windows under their prefix word, as they go to every executor."""

    def __init__(self, rows: Iterable) -> None:
        self.by_word: dict[bytes, list[tuple[int, list[bytes], list[str]]]] = {}
        for r in rows:
            self.by_word.setdefault(bytes(r["word"]), []).append((r["at"], bytes(r["window"]).split(b" "), r["items"]))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged intervals of hit words, and the items whose windows occur."""
        spans, items = [], set()
        by_word, n = self.by_word, len(words)
        if by_word.keys().isdisjoint(words):
            return [], items
        for i, word in enumerate(words):
            if word in by_word:
                for at, window, found in by_word[word]:
                    start = i - at
                    end = start + len(window)
                    if start >= 0 and end <= n and words[start:end] == window:
                        spans.append((start, end))
                        items.update(found)
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def compared(docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The second pass with all windows at hand."""
    sent = docs.sparkSession.sparkContext.broadcast(Prefixes(prefixes.toLocalIterator()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for rows in python_rows(batches):
            out = []
            for doc_id, text in rows:
                words = words_of(text)
                spans, items = held.hits(words)
                out.append((doc_id, len(words), [a for a, _ in spans], [b for _, b in spans], sorted(items)))
            yield arrow_rows(out, HITS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(scan, HITS_DDL)


def matched(docs: DataFrame, prefixes: DataFrame, power: int) -> DataFrame:
    """The second pass by a join: like compared(), with key, a hash of the text, and one row for all that agree in both."""
    place = lambda word, at, size: F.concat(word, F.concat(F.lit(" "), at.cast("string"), F.lit(" "), size.cast("string")).cast("binary"))
    words, windows = Bits.of(prefixes, F.col("word"), power), Bits.of(prefixes, F.col("window"), power)
    places = Bits.of(prefixes, place(F.col("word"), F.col("at"), F.col("size")), power)
    sizes = sorted(r["size"] for r in prefixes.select("size").distinct().collect())  # at most ``width`` numbers
    sent = docs.sparkSession.sparkContext.broadcast((words, places, windows))
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("found", pa.list_(pa.struct([("start", pa.int32()), ("window", pa.binary())])))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, places, windows = sent.value
        combinations = [(at, size, b" %d %d" % (at, size)) for size in sizes for at in range(size)]
        for rows in python_rows(batches):
            out = []
            for doc_id, key, text in rows:
                said, found = words_of(text), set()
                for i, word in enumerate(said):
                    if word in words:
                        for at, size, suffix in combinations:
                            if i >= at and i - at + size <= len(said) and word + suffix in places:
                                window = b" ".join(said[i - at : i - at + size])
                                if window in windows:
                                    found.add((i - at, window))
                out.append((doc_id, key, len(said), [{"start": a, "window": w} for a, w in sorted(found)]))
            yield arrow_rows(out, schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("key"), text_of().alias("text"))
    seen = texts.mapInArrow(scan, "doc_id long, key long, n_words long, found array<struct<start:int,window:binary>>")
    seen = written(seen.groupBy("doc_id", "key", "n_words").agg(F.first("found").alias("found"), F.count("*").alias("copies")), "candidates")
    true = (
        seen.select("doc_id", "key", F.inline("found"))
        .join(prefixes.select("window", "size", "items"), "window")
        .groupBy("doc_id", "key")
        .agg(
            F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    # Sorted spans are merged one after the other, into a list of which the last may grow.
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] <= last(acc)["end"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(s["end"], last(acc)["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(s)))
    one = true.select("doc_id", "key", F.aggregate("spans", F.slice("spans", 1, 0), step).alias("spans"), "items")
    both = seen.alias("s").join(one.alias("o"), F.col("s.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("s.key") == F.col("o.key")), "left")
    none = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    return both.select(
        "s.doc_id", "s.key", "s.copies", "n_words",
        none("spans.start", "array<int>").alias("starts"), none("spans.end", "array<int>").alias("ends"), none("items", "array<string>").alias("items"),
    )


def find_passages(docs: DataFrame, benchmark: DataFrame, width: int = 13, broadcast_bytes: int = 4 << 20, power: int = 27) -> DataFrame:
    """One row per document: doc_id, n_words, the intervals [starts, ends) of hit words, and the items that occur.

    ``power``: the bit maps of a benchmark that is joined have 2 ** power bits.
    """
    prefixes, small = prefixed(docs, benchmark, width, broadcast_bytes, power)
    if small:
        return compared(docs, prefixes)
    rows = matched(docs, prefixes, power).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.drop("key", "copies", "copy")


def n_hit() -> Column:
    return F.aggregate(F.zip_with("ends", "starts", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, broadcast_bytes: int = 4 << 20, power: int = 27) -> DataFrame:
    """Counts of words, hit words and items per document; contaminated from one hit word in ``share`` on."""
    found = find_passages(docs, benchmark, width, broadcast_bytes, power)
    return found.withColumn("n_hit", n_hit()).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, broadcast_bytes: int = 4 << 20, power: int = 27
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; no text is shuffled if the windows are small."""
    prefixes, small = prefixed(docs, benchmark, width, broadcast_bytes, power)
    if small:
        sent = docs.sparkSession.sparkContext.broadcast(Prefixes(prefixes.toLocalIterator()))

        @F.pandas_udf("boolean")
        def clean(texts):
            def ok(text):
                words = words_of(text)
                n = sum(b - a for a, b in sent.value.hits(words)[0])
                return not (n > 0 and n * share >= len(words))

            return texts.map(ok)

        return docs.filter(clean(text_of()))
    bad = matched(docs, prefixes, power).filter((n_hit() > 0) & (n_hit() * share >= F.col("n_words"))).select("doc_id", "key")
    rows = carried(docs).select("*", F.col("row.doc_id").cast("long").alias("own_id"), F.xxhash64(text_of()).alias("own_key"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("key"))
    return rows.join(bad, same, "left_anti").select(*restored(docs.columns))
