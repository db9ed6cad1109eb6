"""Ranked search, prefix completion and candidate lists over (name, module, ...) rows.

Every function is one pass over the rows with a per-partition top-k; only the best rows of each partition are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.layout import prefix_range
from plumbline.operators.rows import best_per_key

#: The column that holds a name in lower case, by which prefixes are ranges.
NAME_KEY = "name_key"
#: Result limits by search mode, and preference of kinds and file extensions.
LIMITS = {"palette": 50, "workspace": 200, "all": 1000}
KIND_ORDER = ("class", "function", "method", "variable", "cython", "module", "import")
EXTENSION_ORDER = {"implementation": ("pyx", "py", "pxd", "pxi"), "declaration": ("pxd", "pyx", "py", "pxi"), "any": ("py", "pyx", "pxd", "pxi")}


def literal_like(term: str) -> str:
    """``term`` as a LIKE pattern that stands for itself, with ~ as the escape sign."""
    return re.sub(r"([~%_])", r"~\1", term)


def order_of(value: Column, order: Sequence[str]) -> Column:
    """The place of ``value`` in ``order``; behind all others if it isn't there."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)), F.lit(len(order) + 1)).cast("int")


def extension_of(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def kind_rank(kind: Column) -> Column:
    return order_of(F.lower(kind), KIND_ORDER)


def role_rank(path: Column, role: str = "any") -> Column:
    """How well the file's extension suits a role."""
    return order_of(extension_of(path), EXTENSION_ORDER[role])


def search_rank(name: Column, module: Column, term: str, word_breaks: str | None = "_") -> Column:
    """0 exact, 1 prefix, 2 prefix of an inner word (unless word_breaks is None), 3 inside, 4 inside the module, else 5."""
    term = term.lower()
    low = F.lower(name)
    rank = F.when(low == term, 0).when(low.startswith(term), 1)
    if word_breaks is not None:
        rank = rank.when(low.rlike(f"[{re.escape(word_breaks)}]\\Q{term}\\E"), 2)
    return rank.when(low.contains(term), 3).when(F.lower(module).contains(term), 4).otherwise(5).cast("int")


def ranked_search(
    symbols: DataFrame, term: str, limit: int, word_breaks: str | None = "_", tie_breakers: Sequence[str] = (), others: bool = False
) -> DataFrame:
    """The ``limit`` best rows for ``term``: by rank, then kind and extension where known, length, name and module.

    ``others`` keeps rows that don't hold the term, behind all that do.
    """
    ranked = symbols.withColumn("rank", search_rank(F.col("name"), F.col("module"), term, word_breaks))
    ranked = ranked if others else ranked.filter("rank < 5")
    known = [kind_rank(F.col("kind"))] if "kind" in symbols.columns else []
    known += [role_rank(F.col("path"))] if "path" in symbols.columns else []
    return ranked.orderBy("rank", *known, F.length("name"), "name", "module", *tie_breakers).limit(limit)


def like_search(symbols: DataFrame, term: str, limit: int, literal: bool = False, tie_breakers: Sequence[str] = ()) -> DataFrame:
    """Rows whose name or module is LIKE %term%; without ``literal`` a ``_`` or ``%`` of the term is a wildcard."""
    pattern = f"%{literal_like(term.lower()) if literal else term.lower()}%"
    hit = F.expr(f"lower(name) LIKE {_sql(pattern)} ESCAPE '~' OR lower(module) LIKE {_sql(pattern)} ESCAPE '~'")
    return ranked_search(symbols.filter(hit), term, limit, None, tie_breakers, others=True)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rerank(found: DataFrame, term: str, limit: int) -> DataFrame:
    """Search results once more by four levels; if exact names exist only they stay; one row per position."""
    low, term = F.lower("name"), term.lower()
    level = F.when(low == term, 0).when(low.startswith(term), 1).when(low.contains(term), 2).otherwise(3)
    ranked = found.withColumn("level", level.cast("int"))
    exact = ranked.filter("level = 0").limit(1).select(F.lit(1).alias("_exact"))
    held = ranked.join(F.broadcast(exact), how="left").filter(F.col("_exact").isNull() | (F.col("level") == 0)).drop("_exact")
    one = best_per_key(held, ["path", "start_line", "start_character"], ["level", "name", "module"])
    return one.orderBy("level", F.length("name"), "name", "module", "path", "start_line").limit(limit)


def prefix_filter(symbols: DataFrame, prefix: str) -> DataFrame:
    """Names that begin with ``prefix``, case-insensitively; a range of the lower-case key where rows have one."""
    if NAME_KEY in symbols.columns:
        return symbols.filter(prefix_range(NAME_KEY, prefix.lower()))
    return symbols.filter(F.lower("name").startswith(prefix.lower()))


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the lower-case name as a key, whose order and prefixes files can be skipped by."""
    return rows.withColumn(NAME_KEY, F.lower("name"))


def prefix_top(symbols: DataFrame, prefix: str, limit: int, best: Sequence[Column | str]) -> DataFrame:
    """The best row (least ``best``) per lower-case name among the names with ``prefix``, by name and module."""
    held = prefix_filter(symbols, prefix).withColumn("label", F.lower("name"))
    return best_per_key(held, ["label"], best).orderBy("name", "module").limit(limit)


def multi_term(rows: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose text contains every white-space separated term of ``query``."""
    for term in query.lower().split():
        rows = rows.filter(F.lower(column).contains(term))
    return rows


def member_candidates(members: DataFrame, family: str, preferred: Sequence[str], limit: int = 5) -> DataFrame:
    """Members by: owner of the family, preferred module, kind, module, path and line; at most ``limit`` (the candidate cap)."""
    fits = (F.col("owner_type") == family).cast("int")
    liked = F.col("module").isin(list(preferred)).cast("int") if preferred else F.lit(0)
    return members.orderBy(fits.desc(), liked.desc(), kind_rank(F.col("kind")), "module", "path", "start_line").limit(limit)


def hot_set(rows: DataFrame, column: str, n: int = 256) -> DataFrame:
    """The first ``n`` distinct values in alphabetical order, for a small front table."""
    return rows.select(column).distinct().orderBy(column).limit(n)


def plain_rank(rows: DataFrame, term: str, limit: int) -> DataFrame:
    """The older ranking: exact 0, prefix 1, contained 2, then name."""
    low, term = F.lower("name"), term.lower()
    score = F.when(low == term, 0).when(low.startswith(term), 1).when(low.contains(term), 2).cast("int")
    return rows.withColumn("score", score).filter("score is not null").orderBy("score", "name").limit(limit)


def viewer_list(rows: DataFrame, query: str, buckets: Mapping[str, Sequence[str]], limit: int = 500) -> DataFrame:
    """Rows that match all terms, ``limit`` of them, with the bucket that their kind belongs to."""
    group = F.lit("other")
    for name, kinds in reversed(list(buckets.items())):
        group = F.when(F.lower("kind").isin(list(kinds)), name).otherwise(group)
    return multi_term(rows, "search_text", query).orderBy("name", "module").limit(limit).withColumn("bucket", group)
