"""A Merkle manifest of a table: a digest of every row, trees of runs above them, a root, and a proof for every row.

A leaf is H, the lower-case hex sha256, over the named columns in turn: ``-`` for a null, else the count of UTF-8 bytes,
a colon and the value. Rows of one ``tree`` value ascend by ``order``; as long as several nodes of a tree remain, every
``arity`` consecutive ones become one node, the H of their digests as hex text. What remains is the tree's subroot. The
subroots, by tree (null first, bytewise), are built up to the root in the same way.

Bottom-up, every level is a written table whose nodes hold their children's digests. Top-down, a level joins its parents:
a node prepends its siblings, left and right of it, to the proof that its parent has inherited, and so on to the leaves.
A row's place in its tree comes from a sort by ranges and the counts of the ranges before, so a tree that holds most of
the rows is spread like any other. No node has more than ``arity`` children, no proof more than (arity - 1) digests a
level.

Rows with a null in ``order`` come first in their tree. Rows equal in ``order`` ascend by their leaf; equal rows are
separate leaves. An empty table has no leaves, no root and gives no rows. Texts of any length are hashed whole. Columns
other than the named ones take no part and may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import discard, written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tables of at most so many rows, one a tree, go to all executors.
SMALL = 10_000


def leaf_of(values: list[Column]) -> Column:
    """H of the values, each with its length, so that no two rows of values read alike."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in shown)), 256)


def tree_of(value: Column) -> Column:
    """A key that is never null and sorts as the values do, null first."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with idx, the place from 0 in its tree, and n, the leaves of its tree; written."""
    # Equal rows are told apart only to spread them; which of them comes first makes no difference.
    spread = leaves.withColumn("_turn", F.monotonically_increasing_id())
    keys = ["tree", *order, "_turn"]
    sorted_rows = written(
        spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_turn").withColumn("_at", F.monotonically_increasing_id()), "leaves-sorted"
    )
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # One row for each range.
    counts = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_held"))
    before = counts.select("_part", (F.sum("_held").over(Window.orderBy("_part")) - F.col("_held")).alias("_before"))
    placed = sorted_rows.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + within)
    trees = placed.groupBy(F.col("tree").alias("of_tree")).agg(F.min("_rank").alias("_first"), F.count("*").alias("n"))
    seen = written(trees, "trees")
    trees = F.broadcast(seen) if seen.limit(SMALL + 1).count() <= SMALL else seen
    out = placed.join(trees, F.col("tree") == F.col("of_tree")).withColumn("idx", F.col("_rank") - F.col("_first"))
    out = written(out.drop("_part", "_before", "_at", "_rank", "_first", "of_tree"), "leaves")
    discard(sorted_rows)
    discard(seen)
    return out


def built(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """The levels, each written: tree, idx, digest, n (nodes of the tree on this level) and, above the leaves, kids."""
    levels = [leaves]
    while not (wide := levels[-1].filter("n > 1")).isEmpty():
        up = wide.groupBy("tree", F.floor(F.col("idx") / arity).alias("up")).agg(
            F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"), F.max("n").alias("below")
        )
        kids = F.transform("run", lambda x: x["digest"])
        levels.append(
            written(
                up.select(
                    "tree", F.col("up").alias("idx"), F.sha2(F.array_join(kids, ""), 256).alias("digest"), F.ceil(F.col("below") / arity).alias("n"), kids.alias("kids")
                ),
                f"level-{len(levels)}",
            )
        )
    return levels


def step(kids: Column, at: Column) -> Column:
    """What stands left and right of child ``at`` (from 0) in its run."""
    left = F.array_join(F.slice(kids, F.lit(1), at), "")
    right = F.array_join(F.slice(kids, at + 2, F.size(kids)), "")
    return F.struct(left.alias("l"), right.alias("r"))


def pushed(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The leaves with proof, the steps from themselves to the root, and what ``tops`` knows of their tree.

    ``tops``: tree, proof (of the tree's top node) and more columns, which are handed down.
    """
    more = [c for c in tops.columns if c not in ("tree", "proof")]
    handed = None
    for level in reversed(levels):
        whole = level.filter("n = 1").join(tops, "tree")
        if handed is not None:
            above = handed.select(F.col("tree").alias("of_tree"), F.col("idx").alias("up"), F.col("kids").alias("run"), F.col("proof").alias("rest"), *more)
            of = F.floor(F.col("idx") / arity)
            at = (F.col("idx") - F.col("up") * arity).cast("int")
            proof = F.concat(F.array(step(F.col("run"), at)), F.col("rest"))
            below = level.filter("n > 1").join(above, (F.col("tree") == F.col("of_tree")) & (of == F.col("up"))).withColumn("proof", proof)
            whole = whole.unionByName(below.select(*whole.columns))
        handed = whole
    return handed


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``proof``."""
    return F.aggregate(proof, leaf, lambda digest, s: F.sha2(F.concat(s["l"], digest, s["r"]), 256))


def proof_digest(proof: Column) -> Column:
    """H of all siblings, from the leaf's run upwards, each level from left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def manifest(rows: DataFrame, digest: Column, tree: Column, order: list[Column], carry: dict[str, Column] | None = None, arity: int = 8) -> DataFrame:
    """A row for each row: the carried columns, digest (its leaf), tree, idx, subroot, root and proof."""
    carry = carry or {}
    named = [c.alias(f"_by{i}") for i, c in enumerate(order)]
    by = [f"_by{i}" for i in range(len(order))]
    held = F.struct(*(c.alias(k) for k, c in carry.items())) if carry else F.struct(F.lit(0).alias("none"))
    leaves = numbered(rows.select(tree_of(tree).alias("tree"), *named, digest.alias("digest"), held.alias("row")), [*by, "digest"]).drop(*by)
    levels = built(leaves, arity)
    tops = reduce(DataFrame.unionByName, (x.filter("n = 1").select("tree", "digest") for x in levels))
    # The upper tree has a leaf for each tree; "tree" is then its row, and one key holds it together.
    upper = numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("_by"), "digest"), ["_by"])
    above = built(upper, arity)
    top = above[-1].select("tree", F.array().cast("array<struct<l:string,r:string>>").alias("proof"), F.col("digest").alias("root"))
    trees = pushed(above, F.broadcast(top), arity).select(F.col("_by").alias("tree"), "proof", F.col("digest").alias("subroot"), "root")
    trees = written(trees, "subroots")
    if trees.limit(SMALL + 1).count() <= SMALL:
        trees = F.broadcast(trees)
    return pushed(levels, trees, arity)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text with A-Z in lower case where 3 divides the crc32 of the id; as it is elsewhere and for null ids."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)


def merkle_manifest(docs: DataFrame, arity: int = 8) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, a row for each document.

    The proof is checked on a copy of the table in which some texts have been changed: ``folded_root`` is what the
    changed row gives with the siblings of the manifest, and ``verified`` whether that is the root.
    """
    columns = {c: F.col(c) for c in COLUMNS}
    changed = leaf_of([tampered_text(columns["doc_id"], columns["text"]) if c == "text" else columns[c] for c in COLUMNS])
    proved = manifest(
        docs, leaf_of(list(columns.values())), columns["lang"], [columns["doc_id"]], {"doc_id": columns["doc_id"], "changed": changed}, arity
    )
    fold = folded(F.col("row.changed"), F.col("proof"))
    out = proved.select(
        F.col("row.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
