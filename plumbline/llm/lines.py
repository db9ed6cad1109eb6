"""Line dedup over content-defined chunks of lines, by DataFrame functions alone.

Every line has a 28-bit hash of its digest. A rolling hash over two line hashes places chunk boundaries: a line ends a
chunk where the rolling hash is a local minimum. So boundaries depend on nearby lines only, shift with them when lines
are inserted or removed, and no inner chunk has fewer than two lines; the mean is three. Chunks of two or more lines
that occur again anywhere are removed, but for the first occurrence by (doc_id, text digest, chunk number). Of a
passage that stands among other lines, what lies outside its own boundaries stays: the shorter, the more.

Chunks meet by digest first: counts are combined before the shuffle. Only chunks whose digest repeats carry their text,
and a chunk is removed only if its bytes equal those of the first chunk of its digest; the join has one row per digest
on the other side, so it can be split where a chunk is very common.

Null text stays null and empty text empty; both have no chunks. A null doc_id ranks first. Rows that agree in doc_id and
text are one document: they are no repeats of each other and get the same result. All columns come back, whatever their
names; text is what stays, and n_chars, if there is one, its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import carried, restored, written

#: The rolling hash is (a * BASE + b) mod PRIME over two line hashes.
BASE, PRIME = 1_000_003, 2_147_483_647


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def with_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` with chunks, an array of (chunk from 0, lines, body), null for null and empty texts.

    ``docs`` must have no other columns of the names text, lines, hashes, rolled, ends and chunks.
    """
    h, r, e = F.col("hashes"), F.col("rolled"), F.col("ends")
    last = F.size(r) - 1
    before = lambda i: F.when(i > 0, F.get(h, i - 1)).otherwise(F.lit(0).cast("long"))
    rolled = F.transform(h, lambda x, i: (before(i) * F.lit(BASE).cast("long") + x) % F.lit(PRIME).cast("long"))
    lowest = lambda x, i: (i > 0) & (i < last - 1) & (x < F.get(r, i - 1)) & (x <= F.get(r, i + 1))
    ends = F.filter(F.transform(r, lambda x, i: F.when(lowest(x, i) | (i == last), i)), lambda i: i.isNotNull())
    behind = lambda n: F.when(n > 0, F.get(e, n - 1)).otherwise(F.lit(-1))
    pieces = F.transform(
        e,
        lambda end, n: F.struct(
            n.alias("chunk"),
            (end - behind(n)).alias("lines"),
            F.array_join(F.slice("lines", behind(n) + 2, end - behind(n)), "\n").alias("body"),
        ),
    )
    # Each array is used several times by the next step, so that the optimizer keeps the steps apart.
    return (
        docs.withColumn("lines", F.split(F.nullif(F.col("text").cast("string"), F.lit("")), "\n", -1))
        .withColumn("hashes", F.transform("lines", line_hash))
        .withColumn("rolled", rolled)
        .withColumn("ends", ends)
        .withColumn("chunks", pieces)
        .drop("lines", "hashes", "rolled", "ends")
    )


def own_key() -> Column:
    return F.md5(F.col("text").cast("string").cast("binary"))


def _same(held: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join by document. Both joins of kept_lines() shuffle the documents alike, so one exchange of texts serves them."""
    same = F.col("own_id").eqNullSafe(F.col("id")) & F.col("own_key").eqNullSafe(F.col("key"))
    return held.join(other.hint("merge"), same, how)


def candidates(held: DataFrame) -> DataFrame:
    """id, key and the array marks of (chunk, digest, is_first), for documents with chunks whose digest repeats."""
    chunks = with_chunks(held.select(F.col("own_id").alias("id"), F.col("own_key").alias("key"), "text"))
    place = F.struct("id", "key", "chunk")
    # An outer generator: for others the optimizer pushes a filter on the array, and so its whole making, below the steps.
    keyed = (
        chunks.select("id", "key", F.inline_outer("chunks"))
        .filter("lines > 1")
        .select("id", "key", "chunk", F.xxhash64("body", "lines").alias("digest"))
    )
    keyed = written(keyed, "chunk-digests")
    # Rows that agree in doc_id and text have equal places, so the first and last place tell whether a chunk repeats.
    seen = keyed.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    seen = written(seen.filter(~F.col("first").eqNullSafe(F.col("last"))).drop("last"), "repeated-digests")
    mark = F.struct("chunk", "digest", place.eqNullSafe(F.col("first")).alias("is_first"))
    marked = keyed.join(seen.hint("merge"), "digest").groupBy("id", "key").agg(F.collect_set(mark).alias("marks"))
    return written(marked, "candidate-chunks")


def kept_lines(docs: DataFrame) -> DataFrame:
    """row (see carried()), the text that stays, and total and removed, the numbers of lines before and removed."""
    held = carried(docs).select("*", F.col("row.doc_id").cast("long").alias("own_id"), own_key().alias("own_key"))
    bodies = (
        with_chunks(_same(held.drop("row"), candidates(held), "inner"))
        .select("id", "key", "chunks", F.explode_outer("marks").alias("mark"))
        .select("id", "key", "mark.*", F.get("chunks", F.col("mark.chunk"))["body"].alias("body"))
    )
    firsts = bodies.filter("is_first").groupBy("digest").agg(F.first("body").alias("first_body"))
    gone = (
        bodies.filter("not is_first")
        .join(firsts.hint("merge"), "digest")
        .filter(F.col("body") == F.col("first_body"))
        .groupBy("id", "key")
        .agg(F.collect_set("chunk").alias("gone"))
    )
    joined = with_chunks(_same(held, gone, "left"))
    stays = F.filter("chunks", lambda c: ~F.array_contains("gone", c["chunk"]))
    count = lambda chunks: F.aggregate(chunks, F.lit(0), lambda n, c: n + c["lines"])
    lost = F.col("gone").isNotNull()
    return joined.select(
        "row",
        F.when(lost, F.array_join(F.transform(stays, lambda c: c["body"]), "\n")).otherwise(F.col("text").cast("string")).alias("text"),
        F.coalesce(count("chunks"), F.lit(0)).cast("long").alias("total"),
        F.when(lost, count(F.filter("chunks", lambda c: F.array_contains("gone", c["chunk"])))).otherwise(0).cast("long").alias("removed"),
    )


def dedup_chunks(docs: DataFrame) -> DataFrame:
    """``docs`` with the text that stays."""
    length = lambda c: F.char_length("text").cast("long").alias(c)
    columns = [length(c) if c == "n_chars" else held for c, held in zip(docs.columns, restored(docs.columns), strict=True)]
    return kept_lines(docs).select(*columns)


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest of the text that stays, per document."""
    return kept_lines(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.col("total").alias("n_lines"),
        F.col("removed").alias("n_removed"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"),
    )
