"""SimHash near-duplicates: links between fingerprints of few differing bits, found with pivot distance tables.

A pivot table holds a fingerprint's Hamming distances to many reference fingerprints. By the triangle inequality two
fingerprints within ``radius`` bits differ by at most ``radius`` in every coordinate, so a larger difference discards
the pair; the pairs that survive are verified on the fingerprints themselves.

The references are nested: the lowest 0, 2, 4, ... 64 bits set. One flipped bit then changes just one difference of
neighbouring coordinates. The 32 differences are dealt into six groups; two flipped bits touch at most two of them, so
two linked fingerprints agree on four whole groups, and an equi-join on every choice of four finds them all. More
references, spread over the fingerprint space, sharpen the coordinate test. Equal fingerprints are one entry.

A bucket of more than ``dense`` fingerprints is not paired. There every fingerprint is joined to its 64 neighbours at
one bit and itself: two fingerprints within two bits share a neighbour, and all that share one are within two bits, so
a star per neighbour has the same components. With a radius of one bit they are joined to those neighbours themselves.

Words are runs of other than ASCII white space, with A-Z in lower case; shingles are ``width`` consecutive words,
repeats included; a shorter text is one shingle; a text without words, or null, has fingerprint zero. Repeated rows are
documents of their own. A null id is never the smallest id of a component unless it has no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_rows, bucketed, carried, dealt, discard, python_rows, release, restored, text_of, written
from plumbline.llm.graph import components

GROUPS, AGREE = 6, 4
NESTED = [(1 << 2 * j) - 1 for j in range(33)]
#: Multiples of the golden ratio modulo 2^64 spread evenly over the fingerprint space.
SPREAD = [(0x9E3779B97F4A7C15 * (j + 1)) % (1 << 64) for j in range(31)]
#: How many shingles back a set remembers, lest a pair be made again for its next common shingle.
BACK = 4
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def shingle_hashes(text: str, width: int, seed: int = 42) -> np.ndarray:
    """The 64-bit hashes of a text's shingles in order; none of a text without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    return np.fromiter(
        [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)],
        dtype=np.uint64,
        count=len(starts),
    )


def folded(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of shingle hashes, unsigned."""
    if len(hashes) <= 1:
        return int(hashes[0]) if len(hashes) else 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i, n in enumerate(ones.tolist()) if 2 * n > len(hashes)))


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one text, unsigned."""
    return folded(shingle_hashes(text, width, seed))


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (signed long) of every document, in one pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in python_rows(batches):
            yield arrow_rows([(doc_id, signed(fingerprint(text, width))) for doc_id, text in rows], FINGERPRINTS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(scan, "doc_id long, fp long")


def distance(fp: Column, pivot: int | Column) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(signed(pivot)) if isinstance(pivot, int) else pivot))


def buckets(prints: DataFrame) -> DataFrame:
    """fp and key, a long for every choice of four groups: the differences of neighbouring coordinates in them."""
    fp = F.col("fp")
    codes = []
    for g in range(GROUPS):
        code: Column = F.lit(0)
        for j in range(g * 32 // GROUPS, (g + 1) * 32 // GROUPS):
            step = F.shiftright(distance(fp, NESTED[j]) + 2 - distance(fp, NESTED[j + 1]), 1)  # 0, 1 or 2
            code = code * 3 + step
        codes.append(code.cast("long").alias(f"g{g}"))
    keys = []
    for n, chosen in enumerate(combinations(range(GROUPS), AGREE)):
        key: Column = F.lit(n).cast("long")
        for g in chosen:
            key = key * F.lit(3**6).cast("long") + F.col(f"g{g}")
        keys.append(key)
    return prints.select("fp", *codes).select("fp", F.explode(F.array(*keys)).alias("key"))


def survives(a: Column, b: Column, radius: int) -> Column:
    """No coordinate of the pivot tables differs by more than ``radius``."""
    apart = [F.abs(distance(a, p) - distance(b, p)) for p in NESTED[1::4] + SPREAD[:8]]
    return F.greatest(*apart) <= radius


def links(prints: DataFrame, radius: int = 2, dense: int = 1000) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of the column fp whose components are those of all links."""
    if not 0 <= radius <= GROUPS - AGREE:
        raise ValueError(f"radius must be at most {GROUPS - AGREE}")
    held = written(buckets(prints), "buckets")
    sizes = written(held.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    few = held.join(sizes.filter(F.col("n") <= dense), "key", "left_semi")
    pairs = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .filter(F.col("a") < F.col("b"))
        .filter(survives(F.col("a"), F.col("b"), radius))
        .filter(distance(F.col("a"), F.col("b")) <= radius)
        .select("a", "b")
    )
    if radius == 0 or sizes.filter(F.col("n") > dense).isEmpty():
        return pairs.distinct()
    many = held.join(sizes.filter(F.col("n") > dense), "key", "left_semi").select("fp").distinct()
    if radius == 1:
        flipped = F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)))).alias("b")
        beside = many.select(F.col("fp").alias("a"), flipped).filter("a < b").join(many.withColumnRenamed("fp", "b"), "b", "left_semi")
        return pairs.unionByName(beside.select("a", "b")).distinct()
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)))
    around = many.select("fp", F.explode(near).alias("mid"))
    stars = around.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    spokes = around.join(stars, "mid").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(spokes).distinct()


def rooted(held: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, least and root of every distinct fingerprint of ``held``."""
    roots = components(edges)
    return held.join(roots, held["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def named(prints: DataFrame, held: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``prints``; ``held`` has each fp once with its least id."""
    placed = rooted(held, edges)
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = placed.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, dense: int = 1000) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id of its component."""
    prints = written(fingerprints(docs, width), "prints")
    held = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    return named(prints, held, links(held, radius, dense))


def shingle_set(text: str, width: int) -> np.ndarray:
    """The sorted distinct 32-bit hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, width).astype(np.uint32))


def packed_set(held: np.ndarray) -> bytes:
    """A sorted set by differences, byte plane by byte plane: the high planes are mostly 0 and take no room on disk."""
    return np.diff(held, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked_set(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def text_key() -> Column:
    """With the id it tells rows apart: those that agree in both have the same text."""
    return F.xxhash64(text_of())


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key, fp, the shingle set of every document, and own, a digest of the last two, in one pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("fp", pa.int64()), ("own", pa.int64()), ("shingles", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in python_rows(batches):
            out = []
            for doc_id, key, text in rows:
                hashes = shingle_hashes(text, width)
                fp, held = folded(hashes), packed_set(np.unique(hashes.astype(np.uint32)))
                out.append((doc_id, key, signed(fp), signed(xxhash.xxh64_intdigest(held, fp)), held))
            yield arrow_rows(out, schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), text_of().alias("text"))
    return texts.mapInArrow(scan, "doc_id long, key long, fp long, own long, shingles binary")


def common_shingles(sets: DataFrame, sample: int = 5_000, most: int = 100_000) -> np.ndarray:
    """At most ``most`` shingles that a sample of the sets holds several times, the most frequent last.

    They only order the shingles. Any order finds all pairs; one with rare shingles first has fewer to discard.
    """
    every = max(1, sets.count() // sample)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [unpacked_set(x.as_py()).view(np.int32) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held) if held else [], pa.int32())], names=["token"])

    some = sets.filter(F.pmod(F.xxhash64("own"), F.lit(every)) == 0).select("shingles").mapInArrow(tokens, "token int")
    often = some.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "token").limit(most)
    return often.toArrow().column("token").to_numpy()[::-1].view(np.uint32)


def prefixes(sets: DataFrame, similarity: float, common: np.ndarray) -> DataFrame:
    """token, own, n and at: the first shingles of every set in one order of all, n its size and ``at`` their place.

    Of n shingles the first n - ceil(similarity * n) + 1 are taken. Two sets of this similarity share one of them.
    """
    order = np.argsort(common, kind="stable")
    known, rank = common[order], order.astype(np.int64) + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, owns, sizes, places = [], [], [], []
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = unpacked_set(raw.as_py())
                if not len(held):
                    continue
                ranks = np.zeros(len(held), dtype=np.int64)
                if len(known):
                    to = np.minimum(np.searchsorted(known, held), len(known) - 1)
                    ranks = np.where(known[to] == held, rank[to], 0)
                taken = len(held) - int(np.ceil(similarity * len(held) - 1e-9)) + 1
                tokens.append(held[np.lexsort((held, ranks))[:taken]].view(np.int32))
                owns.append(np.full(taken, own, dtype=np.int64))
                sizes.append(np.full(taken, len(held), dtype=np.int32))
                places.append(np.arange(taken, dtype=np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, owns, sizes, places)], names=["token", "own", "n", "at"])

    return sets.select("own", "shingles").mapInArrow(scan, "token int, own long, n int, at int")


def mark(held: np.ndarray) -> bytes:
    """For each of at least twice as many classes of shingles as the set has (a power of two), whether it has an odd number of them."""
    width = 1 << max(10, (2 * len(held) - 1).bit_length())
    return np.packbits((np.bincount(held & np.uint32(width - 1), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many classes two marks differ: never more than the sets do in shingles. The longer one is folded to the other's classes."""
    x, y = (np.frombuffer(raw, dtype=np.uint64) for raw in sorted((a, b), key=len))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def marks(sets: DataFrame) -> DataFrame:
    """own, n, mark, low and high of every set: its size, its mark, and the mark folded to two 64-bit words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [unpacked_set(raw.as_py()) for raw in batch.column(1)]
            made = [mark(x) for x in held]
            words = [np.bitwise_xor.reduce(np.frombuffer(x, dtype=np.int64).reshape(-1, 2), axis=0) for x in made]
            low, high = (pa.array([int(w[i]) for w in words], pa.int64()) for i in range(2))
            columns = [batch.column(0), pa.array([len(x) for x in held], pa.int32()), pa.array(made, pa.binary()), low, high]
            yield pa.RecordBatch.from_arrays(columns, names=["own", "n", "mark", "low", "high"])

    return sets.select("own", "shingles").mapInArrow(scan, "own long, n int, mark binary, low long, high long")


def unmarked(pairs: DataFrame, marked: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b) without those whose marks() differ in more classes than so similar sets differ in shingles."""
    most = (1 - similarity) / (1 + similarity)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True)
            keep = [differing(x.as_py(), y.as_py()) <= most * n + 1e-6 for n, x, y in columns]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: marked.select(F.col("own").alias(c), F.col("n").alias(f"{c}_n"), F.col("mark").alias(f"{c}_mark"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", F.col("a_n") + F.col("b_n"), "a_mark", "b_mark").mapInArrow(check, "a long, b long")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The fingerprints of those ``pairs`` (a, b) of sets that have this Jaccard similarity or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = (unpacked_set(z.as_py()) for z in (x, y))
                both = len(np.intersect1d(u, v, assume_unique=True)) if min(len(u), len(v)) >= similarity * max(len(u), len(v)) else 0
                keep.append(both >= similarity * max(1, len(u) + len(v) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: sets.select(F.col("own").alias(c), F.col("fp").alias(f"{c}_fp"), F.col("shingles").alias(f"{c}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("a_fp <> b_fp")
    return both.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"), "a_set", "b_set").mapInArrow(check, "a long, b long")


def near_copies(docs: DataFrame, **how) -> DataFrame:
    """Like near_duplicates(), for copies with more changes: components of texts whose shingle sets are similar."""
    prints, held, linked = similar_texts(docs, **how)
    return named(prints.select("doc_id", "fp"), held, linked)


def similar_texts(docs: DataFrame, width: int = 5, similarity: float = 0.8, turns: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The shingled() rows, their distinct fingerprints with the least id of each, and links between those.

    Fingerprints within two bits are linked as they are. Beyond, all pairs of sets with a Jaccard similarity of
    ``similarity`` or more are linked: they share a shingle of their prefixes(). Sets of a shingle are first compared
    with a few of their shingle only, two in each of some ``turns``; then all pairs whose components still differ are,
    which changes no component and spares most pairs of large groups. A shingle's pairs are split by their components.
    """
    spark = docs.sparkSession
    full = written(shingled(docs, width), "shingled")
    sets = bucketed(full.select("own", "fp", "shingles").repartition(dealt(spark), "own").dropDuplicates(["own"]), "sets", "own")
    marked = written(marks(sets), "marks")
    prints = written(full.select("doc_id", "key", "fp"), "prints")
    discard(full)
    del full
    release(spark)
    held = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    first = written(prefixes(sets, similarity, common_shingles(sets)), "prefixes")
    often = first.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1").select("token")
    # Sets of one band differ by less than a fifth in size.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.2))).cast("int")
    shared = first.join(often, "token").join(sets.select("own", "fp"), "own").select("token", "own", "n", "at", "fp", band.alias("band"))
    shared = written(shared, "shared")
    discard(first)
    del first, often
    release(spark)
    linked = written(links(held, 2), "close")
    for few in (True, False):
        roots = written(components(linked).distinct(), "roots")
        linked = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        placed = shared.join(roots, shared["fp"] == roots["node"], "left").select("token", "own", "n", "at", "band", F.coalesce("root", "fp").alias("root"))
        mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
        still = written(placed.join(mixed.select("token"), "token"), "open")
        tried = written(some_pairs(still, turns, similarity) if few else all_pairs(still.join(marked.select("own", "low", "high"), "own"), similarity), "tried")
        discard(still)
        pairs = written(unmarked(tried, marked, similarity), "pairs")
        discard(tried)
        linked = written(linked.unionByName(similar(pairs, sets, similarity)), "similar")
        discard(pairs)
        del placed, mixed, still, tried, pairs
        release(spark)
    discard(sets)
    discard(marked)
    discard(shared)
    return prints, held, linked


def some_pairs(rows: DataFrame, turns: int, similarity: float) -> DataFrame:
    """For every set, in each turn, at most two of its shingles' and band's sets of another component, if they can be similar enough."""
    share = similarity / (1 + similarity)
    rows = rows.withColumn("rest", F.col("n") - F.col("at"))
    picks = [F.struct(F.xxhash64("own", F.lit(turn)).alias("h"), "own", "root", "n", "rest") for turn in range(turns)]
    ends = rows.groupBy("token", "band").agg(*(f(p).alias(f"{f.__name__}{t}") for t, p in enumerate(picks) for f in (F.min, F.max)))
    both = rows.join(ends, ["token", "band"])
    chosen = [f"{f.__name__}{t}" for t in range(turns) for f in (F.min, F.max)]

    def other(c: str) -> Column:
        sizes = F.least(F.col("n"), F.col(f"{c}.n")) >= F.lit(similarity) * F.greatest(F.col("n"), F.col(f"{c}.n")) - 1e-6
        enough = F.least(F.col("rest"), F.col(f"{c}.rest")) >= share * (F.col("n") + F.col(f"{c}.n")) - 1e-6
        return F.when((F.col(f"{c}.root") != F.col("root")) & sizes & enough, F.col(c))

    best = both.groupBy("own").agg(*((F.min if c.startswith("min") else F.max)(other(c)).alias(c) for c in chosen))
    partner = best.select("own", F.explode(F.array(*(F.col(f"{c}.own") for c in chosen))).alias("other")).filter("other is not null")
    return partner.select(F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).distinct()


def all_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """The distinct meetings()."""
    return meetings(rows, similarity).distinct()


def meetings(rows: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of sets of different components that share a shingle, but for those that can't be similar enough.

    The first shingle that two similar sets share has all others behind it in both, so what is left from there on (rest)
    must be enough in both. Only that shingle need give the pair: each row knows the last BACK shingles of its set before
    it, and two rows that have one of these in common give none, as that shingle has more behind it. Sets of a shingle,
    component and band of sizes are first judged together, by their smallest size, largest rest and, where all agree,
    the shingles before and marks; only where these allow a similar pair they are taken one by one. Marks (low and high)
    differ in no more bits than the sets in shingles.
    """
    share = similarity / (1 + similarity)
    # Sizes of similar sets lie in one band or two neighbouring ones.
    width = 1.0001 / similarity
    back = Window.partitionBy("own").orderBy("at").rowsBetween(-BACK, -1)
    held = rows.withColumn("before", F.collect_list("token").over(back)).select(
        "token", "own", "n", "root", "before", "low", "high", (F.col("n") - F.col("at")).alias("rest"), F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(width))).cast("int").alias("band")
    )
    held = written(held, "placed")
    alike = F.when(F.min("before") == F.max("before"), F.min("before")).otherwise(F.array().cast("array<int>"))
    marked = [F.when((F.min("low") == F.max("low")) & (F.min("high") == F.max("high")), F.min(c)).alias(c) for c in ("low", "high")]
    sized = [F.min("n").alias("least"), F.max("n").alias("n"), F.max("rest").alias("rest")]
    kinds = held.groupBy("token", "band", "root").agg(*sized, alike.alias("before"), *marked)
    side = lambda df, c: df.select("token", *(F.col(n).alias(f"{c}_{n}") for n in df.columns if n != "token"))
    enough = lambda a, b, m, n: F.least(a, b) >= share * (F.col(m) + F.col(n)) - 1e-6
    bits = F.bit_count(F.col("a_low").bitwiseXOR(F.col("b_low"))) + F.bit_count(F.col("a_high").bitwiseXOR(F.col("b_high")))
    near = F.coalesce(bits <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("a_n") + F.col("b_n")) + 1e-6, F.lit(True))
    bands = F.explode(F.sequence(F.col("a_band") - 1, F.col("a_band") + 1)).alias("b_band")
    apart = (
        side(kinds, "a")
        .select("*", bands)
        .join(side(kinds, "b"), ["token", "b_band"])
        .filter((F.col("a_root") < F.col("b_root")) & enough("a_rest", "b_rest", "a_least", "b_least") & near & ~F.arrays_overlap("a_before", "b_before"))
        .select("token", "a_band", "a_root", "b_band", "b_root", F.col("b_least").alias("least"), F.col("b_rest").alias("most"), F.col("b_before").alias("theirs"))
    )
    one = apart.join(side(held, "a"), ["token", "a_band", "a_root"]).filter(enough("a_rest", "most", "a_n", "least") & ~F.arrays_overlap("a_before", "theirs"))
    both = one.drop("theirs").join(side(held, "b"), ["token", "b_band", "b_root"])
    sizes = F.least("a_n", "b_n") >= F.lit(similarity) * F.greatest("a_n", "b_n") - 1e-6
    first = both.filter(sizes & enough("a_rest", "b_rest", "a_n", "b_n") & near & ~F.arrays_overlap("a_before", "b_before"))
    return first.select(F.least("a_own", "b_own").alias("a"), F.greatest("a_own", "b_own").alias("b"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """Of every component of near_copies() the row of the smallest doc_id, and of rows that share it that of the least text key.

    Rows without an id rank behind all others. Of rows that agree in id and text the one that sorts first stays; where a
    column has a type that can't be sorted, any of them.
    """
    prints, held, linked = similar_texts(docs, **how)
    placed = rooted(held, linked).select("fp", "root")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    best = prints.select("doc_id", "key", "fp").join(placed, "fp").groupBy("root").agg(F.min(rank).alias("best"))
    # Keys without nulls: the rows, grouped by them, need not move again to be joined.
    named_by = lambda doc_id, key: (F.col(doc_id).isNull().alias("no_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("own_id"), key.alias("own_key"))
    kept = written(best.select(*named_by("best.doc_id", F.col("best.key"))), "kept")
    rows = carried(docs).select("*", *named_by("row.doc_id", text_key()))
    one = F.struct("row", "text")
    sortable = "map<" not in rows.schema.simpleString() and "variant" not in rows.schema.simpleString()
    # Equal rows meet before the shuffle; the join needs no other.
    keys = ["no_id", "own_id", "own_key"]
    single = rows.groupBy(*keys).agg((F.min(one) if sortable else F.first(one)).alias("one"))
    return single.join(kept, keys, "left_semi").select("one.*").select(*restored(docs.columns))
