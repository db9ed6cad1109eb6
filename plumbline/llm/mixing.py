"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order that a digest of the id fixes, repeated at most ``repeats``
times. A document is served in packets of ``packet`` words, its last one shorter; ``packet`` is the ``packets``-th part
of the budget, so only documents that are large against the whole mix are cut into several. A packet's virtual finish
time is the number of words that its source has served with it, divided by the source's target. All packets of all
sources are sorted by finish time, and the mix ends where their running total reaches the budget: what lies before is
taken, the packet at that place in part. A source so ends within a few packets of its target.

Targets share the budget by weight, and none exceeds ``repeats`` times its source's size: what a source can't take is
shared by weight among the others until none is above.

Order is exact without one sorted partition. The shuffled order of a source is cut into ``BINS`` ranges of equal width,
and packets are range-sorted by finish time, then source, then place in its queue, so that packets of one time are split
too (a million sources of one document each all end at the same times). Sums of whole ranges give the offsets, and rows
are sorted inside a range. A hot source spreads over all ranges of both. Rows that agree in source, id, size and shuffled
place are counted before they are sorted, and dealt out again behind it.

A null text, or one without words, has size 0 and takes nothing. A null source is a source of its own, after all
others. Documents without an id are shuffled by their text. Repeated rows are separate documents; rows that also agree
in id and size are interchangeable. An empty table gives an empty result. Other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, ranged, running, text_of, written

#: Ranges of the shuffled order of a source. Three hex digits.
BINS = 4096


def sized(docs: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, the number of words and the shuffled order's key of every document."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.md5(text_of().cast("binary"))), F.lit(f":{seed}")).cast("binary")).alias("key"),
    )


def targets(sources: DataFrame, weights: Sequence[int], repeats: int) -> DataFrame:
    """source, place (from 1, in code point order), source_size and target from (source, source_size).

    Sources in code point order take the ``weights`` in turn. With the sources sorted by how soon they fill up, the first
    k are full exactly if the level that the rest would reach lies above their own. Both orders are range-sorted.
    """
    named = sources.withColumn("last", F.col("source").isNull())
    placed = running(ranged(named, ["last", "source"], "sources"), ["last", "source"], {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")
    capped = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(repeats).cast("long"))
    order = ["fills_at", "last", "source"]
    timed = ranged(capped.withColumn("fills_at", F.col("cap") / F.col("weight")), order, "fills")
    sums = written(running(timed, order, {"caps": F.col("cap"), "weighed": F.col("weight")}), "levels")
    whole = sums.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights")).first()
    level = (F.lit(whole["total"] or 0) - F.col("caps") + F.col("cap")) / (F.lit(whole["weights"] or 1) - F.col("weighed") + F.col("weight"))
    leveled = sums.withColumn("level", level).withColumn("fills", F.col("level") * F.col("weight") >= F.col("cap"))
    # The level of the first source that doesn't fill up holds for all after it.
    top = leveled.agg(F.max(F.when(~F.col("fills"), F.col("level"))).alias("top")).first()["top"]
    return leveled.select(
        "source",
        "place",
        "source_size",
        F.when(F.col("fills"), F.col("cap").cast("double")).otherwise(F.lit(top).cast("double") * F.col("weight")).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    repeats: int = 3,
    seed: str = "mix",
    budget: int | None = None,
    packets: int = 1 << 17,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and first_finish, when its first packet is served.

    ``budget`` is the number of words to take, by default all sizes together. taken counts repeats.
    """
    alike = sized(docs, seed).groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("times"))
    rows = written(alike.withColumn("bin", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")), "sized")
    per_bin = rows.groupBy("source", "bin").agg(F.sum(F.col("size") * F.col("times")).alias("bin_size"))
    ahead = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bin.select("source", "bin", F.coalesce(F.sum("bin_size").over(ahead), F.lit(0).cast("long")).alias("bin_start"))
    sources = per_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    goal = targets(sources, weights, repeats)
    one = sources.agg(F.sum("source_size").alias("total"), F.count("*").alias("n")).first()
    total = one["total"] or 0
    budget = total if budget is None else min(budget, total)
    packet = max(1, -(-budget // packets))
    if budget < total:
        goal = goal.withColumn("target", F.col("target") * (budget / total))
    known = (
        offsets.alias("o")
        .join(goal.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source")))
        .select(F.col("o.source").alias("bin_source"), F.col("o.bin").alias("bin_no"), "bin_start", "place", "source_size", "target")
    )
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("bin_source")) & (F.col("bin") == F.col("bin_no")))
    within = Window.partitionBy("bin_source", "bin").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.col("bin_start") + F.coalesce(F.sum(F.col("size") * F.col("times")).over(within), F.lit(0).cast("long"))
    # Rows that are alike come up one behind the other, some hundred in a piece.
    piece = 256
    pieces = placed.withColumn("begun", begun).withColumn("_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(piece).cast("long"))))
    if rows.filter(F.col("times") > 64 * piece).limit(1).count():
        pieces = pieces.repartition("key", "doc_id", "_first")
    turn = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(piece).cast("long"), F.col("times") - F.col("_first"))))
    queued = written(
        pieces.withColumn("_turn", turn)
        .withColumn("served", F.col("begun") + (F.col("_first") + F.col("_turn")) * F.col("size"))
        .select("doc_id", "place", "size", "source_size", "target", "served"),
        "queued",
    )
    plan = schedule(queued, repeats, budget, packet, one["n"])
    # Documents of no words, and those that never come up, take nothing.
    every = plan.select("doc_id", "place", "served", "size", "source_size", "target", "words", "finish").unionByName(
        queued.withColumn("words", F.lit(0).cast("long")).withColumn("finish", F.lit(None).cast("double"))
    )
    # Within a source ``served`` tells documents of some words apart; of those without, equal rows are counted.
    per_row = every.groupBy("place", "served", "doc_id", "size", "source_size", "target").agg(
        F.sum("words").alias("taken"), F.min("finish").alias("first_finish"), F.count_if(F.col("finish").isNull()).alias("n")
    )
    return per_row.select(
        "doc_id", "size", "source_size", "target", "taken", "first_finish", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")
    ).drop("copy")


def schedule(queued: DataFrame, repeats: int, budget: int, packet: int, sources: int) -> DataFrame:
    """The mix itself: one row per packet that is served, with its virtual finish time, and the words that are taken of it.

    Packets are range-sorted by finish time over all sources, and cut where the running total reaches the budget.
    """
    copies = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy")
    begin = F.col("served") - F.col("size") + F.col("copy").cast("long") * F.col("source_size")
    # When all sources have got their targets no words are left but those of one packet each, so nothing further behind
    # a target can come up: leaving it out spares rows and changes nothing.
    behind = F.col("target") + packet * (sources + 1)
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / packet).cast("long"))
    rows = (
        queued.filter("size > 0")
        .select("*", copies)
        .withColumn("begin", begin)
        .filter(F.col("begin") < behind)
        .select("*", F.explode(pieces).alias("piece"))
        .withColumn("words", F.least(F.lit(packet).cast("long"), F.col("size") - F.col("piece") * packet))
        .withColumn("end", F.col("begin") + F.col("piece") * packet + F.col("words"))
        .withColumn("finish", F.col("end") / F.col("target"))
    )
    order = ["finish", "place", "end"]
    return (
        running(ranged(written(rows, "served"), order, "packets"), order, {"total": F.col("words")})
        .withColumn("words", F.least(F.col("words"), budget - F.col("total") + F.col("words")))
        .filter("words > 0")
    )
