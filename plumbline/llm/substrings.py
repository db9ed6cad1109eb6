"""Substring dedup: normalised pieces of lines are hashed, and repeats of an earlier occurrence are removed.

Units are the lines of a text, cut further behind the marks that end a sentence or a clause, so that a passage repeated
in the middle of a line is seen too, but for the parts of a clause at its ends. A unit is normalised (lower case, single
spaces) and reduced to a 128-bit digest. Digests are grouped over all documents; the occurrence of the lowest (doc_id,
text digest, start) stays and all others are repeats. Short clauses meet by chance, so repeats are removed only in runs
of neighbouring units that hold ``min_words`` words or more. Offsets are code points of the original text, and what
stays keeps its original offsets.

Grouping counts on the map side first; the join back to the units has one row per repeated digest on the other side and
can be split where a digest is very common. A document's units are bounded by its own text.

Null and empty texts have no units. A null doc_id ranks before all others. Rows that agree in doc_id and text are one
document and are not repeats of each other. Other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_rows, carried, python_rows, restored, text_of, written

#: A piece of one line up to and with the marks that end a sentence or clause, if white space or the end follows them.
UNIT = re.compile(r"\S(?:[^\n.!?,;:]+|[.!?,;:]+(?!\s|\Z))*[.!?,;:]*")
#: Units that are made into one batch.
ROWS = 20_000
UNITS = pa.schema(
    [("doc_id", pa.int64()), ("doc_key", pa.int64()), ("unit", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("digest", pa.binary())]
)


def units_of(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of the units of a text."""
    out = []
    for m in UNIT.finditer(text):
        words = m[0].lower().split()
        out.append((m.start(), m.start() + len(m[0].rstrip()), len(words), xxhash.xxh3_128_digest(" ".join(words))))
    return out


def text_key(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text)
    return value - (1 << 64) if value >= 1 << 63 else value


def hashed_units(docs: DataFrame) -> DataFrame:
    """One row per unit of every document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for rows in python_rows(batches):
            for doc_id, text in rows:
                key = text_key(text)
                found += [(doc_id, key, n, *u) for n, u in enumerate(units_of(text))]
                if len(found) >= ROWS:
                    yield arrow_rows(found, UNITS)
                    found = []
        if found:
            yield arrow_rows(found, UNITS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        scan, "doc_id long, doc_key long, unit int, start int, end int, words int, digest binary"
    )


def repeated_spans(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """One row per removed span: doc_id, doc_key, start, end, n_units, n_words, first_ids (where its units stay)."""
    units = written(hashed_units(docs), "units")
    place = F.struct("doc_id", "doc_key", "start")
    firsts = written(
        units.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "firsts"
    )
    repeats = units.join(firsts, "digest").filter(~place.eqNullSafe(F.col("first")))
    own = repeats.select("doc_id", "doc_key", "unit", "start", "end", "words", F.col("first.doc_id").alias("first_id"))
    own = own.repartition("doc_id", "doc_key").dropDuplicates(["doc_id", "doc_key", "unit"])
    order = Window.partitionBy("doc_id", "doc_key").orderBy("unit")
    runs = own.withColumn("run", F.col("unit") - F.row_number().over(order)).groupBy("doc_id", "doc_key", "run")
    return (
        runs.agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.count("*").alias("n_units"),
            F.sum("words").alias("n_words"),
            F.sort_array(F.collect_set("first_id")).alias("first_ids"),
        )
        .filter(F.col("n_words") >= min_words)
        .drop("run")
    )


def without_repeats(docs: DataFrame, min_words: int = 20) -> DataFrame:
    """``docs`` with ``kept``, an array of (start, end, text) of what stays of each text, with original offsets.

    The input may have any other columns; they come back unchanged. If one is called kept, the new one is called kept_,
    and so on.
    """

    @F.pandas_udf("long")
    def keyed(texts):
        return texts.map(text_key)

    name = "kept"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    spans = repeated_spans(docs, min_words).groupBy("doc_id", "doc_key").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cut")
    )
    held = carried(docs).select("*", F.col("row.doc_id").cast("long").alias("own_id"), keyed(text_of()).alias("own_key"))
    joined = held.join(spans, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("doc_key")), "left")
    cut = F.coalesce("cut", F.array().cast("array<struct<start:int,end:int>>"))
    begins = F.concat(F.array(F.lit(0)), F.transform(cut, lambda s: s["end"]))
    ends = F.concat(F.transform(cut, lambda s: s["start"]), F.array(F.char_length(text_of())))
    pieces = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.substring(text_of(), a + 1, b - a).alias("text")))
    return joined.select(*restored(docs.columns), F.filter(pieces, lambda p: p["end"] > p["start"]).alias(name))


def repeats_query(docs: DataFrame, min_words: int = 20) -> DataFrame:
    return repeated_spans(docs, min_words).drop("doc_key")
