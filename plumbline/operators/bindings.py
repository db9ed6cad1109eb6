"""Which binding of a name a place sees: lexical scopes, control-flow blocks, and three relations.

A text has scopes (the bodies of functions and classes) and blocks (the bodies of if, for, while, try, with and so on),
both as intervals of lines that nest. A binding is seen from a place behind it if the place lies in the scope that binds,
and, where that is a class, in no scope inside of it. A binding that is seen

* dominates the place if the place lies in the innermost block of the binding,
* is hidden if binding and place lie in different branches of one if, and
* is conditional otherwise: control may have reached it or not.

All three are unions of intervals: behind the binding to the end of its block it dominates; from there to the end of the
next block outside, but for the other branches of its own if, it is conditional, and so on up to its scope. (The lines
between the branches of an if, where elif and else stand, lie in none of them: what a branch binds is conditional there.)
So there are no pairs of places and bindings and no window per text: the rows of a text stream through one sweep over its
lines (``sweep``), and of a text of very many rows the best binding of a place is a question for ``intervals.best_holding``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import source
from plumbline.operators import sweep
from plumbline.operators.extract import each_text
from plumbline.operators.intervals import all_holding, best_holding
from plumbline.session import shared_folder, unsent

#: Words that begin a block, and words that begin a scope.
SCOPE = r"^(?:(class|cdef class)\s|(?:async\s+)?(def)\s|(?:cpdef|cdef)\s[^=]*\()"
BLOCK = r"^(?:(if) |(elif |else ?:)|(?:async )?for |while |try ?:|except[ :]|finally ?:|(?:async )?with |match |case )"
NAME = r"[A-Za-z_]\w*"
#: The same for Python; white space and letters are those of ASCII, as in Spark's expressions.
SCOPES, BLOCKS, OUTER = (re.compile(p, re.ASCII) for p in (SCOPE, BLOCK, r"^(?:global|nonlocal)\s+([^;#]*)"))
#: An assignment to names alone, with what may stand before its sign.
TARGETS = r"^([\w\s,*()\[\]]+?)\s*(?<![=!<>:+\-*/%@&|^])=(?!=)"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _words(text: Column) -> Column:
    return _all(text, f"({NAME})")


def bound_names(line: Column) -> Column:
    """The names that a line of code (without its indent) binds or deletes, as a sorted array.

    Assignments to names and to tuples of names, annotated and augmented ones, walrus, definitions, del, the targets of
    for, what with and except call their values, and imports. Items and attributes are no names.
    """
    none = F.array().cast("array<string>")
    # Most lines hold none of the signs and words that an expression needs, and finding that is cheaper than the expression.
    held = lambda *signs: reduce(lambda x, y: x | y, (line.contains(sign) for sign in signs))
    targets = F.regexp_extract(line, TARGETS, 1)
    plain = F.when(held("=") & (targets != "") & ~targets.rlike(r"\w\s*[(\[]") & ~targets.rlike(r"\w\s+\w"), _words(targets)).otherwise(none)
    named = F.regexp_extract(line, rf"^(?:(?:async\s+)?def|cdef class|class|cpdef\s[^(]*?|cdef\s[^(=]*?)\s*\b({NAME})\s*[(:]", 1)
    other = F.regexp_extract(line, rf"^({NAME})\s*(?::[^=]+?=(?!=)|(?:\*\*|//|<<|>>|[-+*@/%&|^])=)", 1)
    single = F.array(F.when(held("def", "class"), named).otherwise(""), F.when(held("="), other).otherwise(""))
    loop = F.regexp_extract(line, r"^(?:async )?for\s+(.+?)\s+in\s", 1)
    gone = F.regexp_extract(line, r"^del\s+(.+)$", 1)
    whole = lambda word, text: F.when(held(word) & (text != "") & ~text.rlike(r"\w\s*[(\[.]"), _words(text)).otherwise(none)
    called = F.when(line.rlike(r"^(?:async )?with |^except "), _all(line, rf"\sas\s+\(?\s*({NAME})")).otherwise(none)
    imports = F.coalesce(
        F.nullif(F.regexp_extract(line, r"^from\s+\S+\s+c?import\s+\(?\s*([^()#]*)", 1), F.lit("")), F.regexp_extract(line, r"^c?import\s+([^#]*)", 1)
    )
    each = F.filter(F.transform(F.split(imports, ","), lambda x: F.trim(x)), lambda x: x != "")
    own = F.transform(each, lambda x: F.when(x.rlike(r"\sas\s"), F.regexp_extract(x, rf"\sas\s+({NAME})", 1)).otherwise(F.regexp_extract(x, rf"^({NAME})", 1)))
    inner = F.when(held(":="), _all(line, rf"({NAME})\s*:=")).otherwise(none)
    found = F.concat(plain, single, whole("for", loop), whole("del", gone), called, F.when(held("import"), own).otherwise(none), inner)
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))


def outer_names(line: Column) -> Column:
    """The names that a line declares to be bound outside (global, nonlocal)."""
    return F.filter(F.transform(F.split(F.regexp_extract(line, r"^(?:global|nonlocal)\s+([^;#]*)", 1), ","), lambda x: F.trim(x)), lambda x: x != "")


def _logical(code: source.Code) -> Iterator[tuple[int, int, int, str]]:
    """(first line, last line, indent, code) of the logical lines that hold code: open brackets go on in the next line."""
    depth, held = 0, None
    for n, row in enumerate(code.code.split("\n")):
        if held is None and not row.strip():
            continue
        if held is None:
            held = [n, n, len(row) - len(row.lstrip()), row.strip()]
        else:
            held[1] = n
            held[3] += " " + row.strip()
        depth = max(0, depth + row.count("(") + row.count("[") + row.count("{") - row.count(")") - row.count("]") - row.count("}"))
        if not depth and not row.rstrip().endswith("\\"):
            yield tuple(held)
            held = None
    if held:
        yield tuple(held)


def _declared(code: str) -> list[str]:
    """What ``outer_names`` tells of one line."""
    found = OUTER.match(code)
    return [n for n in (x.strip(" ") for x in found[1].split(",")) if n] if found else []


def _placed(path: str, text: str | None) -> Iterator[tuple]:
    """The rows of ``logical_lines`` of one text: a sweep for the ends of lines, one for scopes and chains of branches."""
    found = list(_logical(source.Code(text or "")))
    end, after, stack = (found[-1][1] + 1 if found else 0), [0] * len(found), []
    for i, (first, _, indent, _) in enumerate(found):
        while stack and found[stack[-1]][2] >= indent:
            after[stack.pop()] = first
        stack.append(i)
    for i in stack:
        after[i] = end
    within, held, outer = [None] * len(found), [], {}
    heads, group, group_ends = {}, [None] * len(found), {}
    for i, ((first, last, indent, code), stop) in enumerate(zip(found, after)):
        while held and held[-1][1] < first:
            held.pop()
        within[i] = held[-1][0] if held else None
        if held and code.startswith(("global", "nonlocal")):
            outer.setdefault(within[i], []).extend(_declared(code))
        if last + 1 <= stop - 1 and SCOPES.match(code):
            held.append((last + 1, stop - 1))
        if block := BLOCKS.match(code):
            # A branch belongs to the if whose branch ended here, at the same indent.
            goes_on = block[2] is not None
            head = heads.pop((first, indent), None)
            group[i] = (head if goes_on else first if block[1] else None)
            heads[stop, indent] = group[i]
            if group[i] is not None:
                group_ends[group[i]] = max(group_ends.get(group[i], -1), stop - 1)
    lines = (text or "").count("\n")
    for (first, last, indent, code), stop, scope, branch_of in zip(found, after, within, group):
        yield path, first, last, indent, code, stop, scope, outer.get(scope), branch_of, group_ends.get(branch_of), lines


def logical_lines(texts: DataFrame) -> DataFrame:
    """path, line, last_line, indent, code and after (the next line of code that is no deeper), of the lines of (path, text).

    Strings and comments are blank. scope: where the innermost scope around the line starts; outer: the names that this
    scope declares to be outer ones; branch_of and group_end: the if that a block belongs to (null for other blocks), and
    the last line of its branches; text_lines: the line breaks of the text. All of a text is told by two sweeps over it.
    """
    columns = "path string, line int, last_line int, indent int, code string, after int, scope int, outer array<string>, branch_of int, group_end int, text_lines int"
    return each_text(texts.select("path", "text"), columns, _placed)


def scopes_of(lines: DataFrame) -> DataFrame:
    """path, line, start, end and kind (function, class) of the bodies of definitions."""
    kind = F.when(F.regexp_extract("code", SCOPE, 1) != "", "class").otherwise("function")
    held = lines.filter(F.col("code").rlike(SCOPE)).select("path", "line", (F.col("last_line") + 1).alias("start"), (F.col("after") - 1).alias("end"), kind.alias("kind"))
    return held.filter("start <= end")


def blocks_of(lines: DataFrame) -> DataFrame:
    """path, line, start, end, branch_of (the line of its if; null for other blocks) and group_end of control-flow blocks.

    A branch belongs to the if whose branch ended where it begins; else of a loop or a try does not belong to one.
    """
    held = lines.filter(F.col("code").rlike(BLOCK)).select("path", "line", (F.col("last_line") + 1).alias("start"), (F.col("after") - 1).alias("end"), "branch_of", "group_end")
    return held.filter("start <= end").withColumn("group_end", F.coalesce("group_end", "end"))


def regions(bindings: DataFrame, scopes: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """``bindings`` (key, at, is_parameter, ...) with the intervals from which they are seen: start, end, relation, scope, own, gap.

    scope: the first line of the scope that binds (-1: the whole text). own: that line if the scope is a class, which is
    seen from its own lines only; else -1. gap: an if whose lines between its branches alone see the binding there; else
    -1. A parameter stands at the line of its function and belongs to its body.
    """
    far = 2**31
    inner = F.struct((-F.col("start")).alias("o"), "start", "end", "kind")
    named = scopes.select(F.col(key), F.col("line").alias("at"), F.lit(True).alias("is_parameter"), inner.alias("_body"))
    placed = best_holding(bindings, scopes, [key], "at", {"_scope": inner})
    placed = placed.join(named, [key, "at", "is_parameter"], "left").withColumn("_scope", F.coalesce("_body", "_scope")).drop("_body")
    top, bottom = F.coalesce("_scope.start", F.lit(-1)), F.coalesce("_scope.end", F.lit(far))
    held = placed.withColumns({"scope": top, "_last": bottom, "own": F.when(F.col("_scope.kind") == "class", top).otherwise(-1)}).drop("_scope")
    # The blocks around a line, innermost first; nesting bounds the list.
    lines = bindings.filter("not is_parameter").select(key, "at").distinct()
    chain = all_holding(lines, blocks.select(key, "start", "end", "group_end", "branch_of"), [key], "at").groupBy(key, "at").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("start", "end", "group_end", "branch_of")))).alias("_chain")
    )
    full = held.join(chain, [key, "at"], "left")
    inside = F.when(F.col("is_parameter"), F.array().cast(full.schema["_chain"].dataType)).otherwise(
        F.filter(F.coalesce("_chain", F.array().cast(full.schema["_chain"].dataType)), lambda b: b["start"] >= F.col("scope"))
    )
    full = full.withColumn("_inside", inside)
    ends = F.concat(F.transform("_inside", lambda b: b["end"].cast("long")), F.array(F.col("_last").cast("long")))
    seen = lambda start, end, relation, gap: F.struct(
        start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(relation).alias("relation"), gap.cast("long").alias("gap")
    )
    nowhere = F.lit(-1)
    first = F.when(F.col("is_parameter"), F.greatest(F.col("at") + 1, "scope")).otherwise(F.col("at") + 1)
    sure = seen(first, F.get(ends, F.lit(0)), "dominates", nowhere)
    maybe = F.transform("_inside", lambda b, i: seen(b["group_end"] + 1, F.get(ends, i + 1), "conditional", nowhere))
    between = F.transform(
        F.filter("_inside", lambda b: b["branch_of"].isNotNull()), lambda b: seen(b["end"] + 1, b["group_end"], "conditional", b["branch_of"])
    )
    return full.select(*bindings.columns, "scope", "own", F.inline(F.concat(F.array(sure), maybe, between))).filter("start <= end")


def seen_bindings(
    places: DataFrame,
    bindings: DataFrame,
    scopes: DataFrame,
    blocks: DataFrame,
    key: str = "path",
    name: str = "name",
    payload: Sequence[str] = (),
    once: bool = False,
    most: int = sweep.ROWS,
) -> DataFrame:
    """``places`` (key, name, at) with the binding they see: binding_at, relation, sure_at and the payload.

    Of the bindings that are seen: the deepest scope first, parameters before others, then the nearest line, then the
    least payload. ``relation`` is dominates or conditional, or hidden where none is seen; ``sure_at`` is the line of the
    best binding that dominates, whose type is certain if it is the one that is seen. With ``once``, equal places are one row.

    A key is swept by one task, which gets its rows sorted and keeps only what is open; keys of more than ``most`` rows
    take trees of intervals instead. All is read twice: rows are counted first.
    """
    with unsent(places.sparkSession):
        rows = sweep.events(places, bindings, scopes, blocks, key, name, payload)
        large = sweep.large_keys(rows, "_key", most)
        if large is None:
            return sweep.seen(rows, places, bindings, key, name, payload, once)
        swept = sweep.seen(rows.join(F.broadcast(large), "_key", "left_anti"), places, bindings, key, name, payload, once)
        own = large.withColumnRenamed("_key", key)
        parts = [df.join(F.broadcast(own), key, "left_semi").select(*df.columns) for df in (places, bindings, scopes, blocks)]
        parts[0] = parts[0].distinct() if once else parts[0]
        return swept.unionByName(_seen(*parts, key, name, payload))


def _seen(places: DataFrame, bindings: DataFrame, scopes: DataFrame, blocks: DataFrame, key: str, name: str, payload: Sequence[str]) -> DataFrame:
    """What is kept on the way (checkpoints) ends the plan that the driver holds."""
    shared_folder(places.sparkSession)
    ranked = F.struct((-F.col("scope")).alias("s"), (~F.col("is_parameter")).alias("p"), (-F.col("at")).alias("a"), *payload, "relation")
    best = {"_any": ranked, "_sure": F.when(F.col("relation") == "dominates", ranked)}
    branches = blocks.filter("branch_of is not null")
    spans = branches.groupBy(key, "branch_of").agg(F.min("start").alias("start"), F.max("group_end").alias("end"))
    # The innermost scope, branch and if around every line, by one question; intervals of the other kinds say nothing.
    kinds = (("_scope", scopes, F.struct((-F.col("start").cast("long")).alias("o"), F.col("start").cast("long").alias("start"), "kind")),)
    kinds += tuple((c, df, F.struct((-F.col("start").cast("long")).alias("o"), F.col("branch_of").cast("long").alias("branch_of"))) for c, df in (("_branch", branches), ("_span", spans)))
    named = [df.select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), own.alias(c)) for c, df, own in kinds]
    around_all = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), named)
    wanted = places.select(key, name, "at").distinct().checkpoint()
    around = best_holding(wanted.select(key, "at").distinct(), around_all, [key], "at", {c: F.col(c) for c, _, _ in kinds}).checkpoint()
    owns = F.when(F.col("_scope.kind") == "class", F.array(F.lit(-1).cast("long"), F.col("_scope.start"))).otherwise(F.array(F.lit(-1).cast("long")))
    between = F.col("_span").isNotNull() & ~F.col("_span.branch_of").eqNullSafe(F.col("_branch.branch_of"))
    gaps = F.when(between, F.array(F.lit(-1).cast("long"), F.col("_span.branch_of"))).otherwise(F.array(F.lit(-1).cast("long")))
    views = around.select(key, "at", gaps.alias("_gaps"), F.explode(owns).alias("own")).select(key, "at", "own", F.explode("_gaps").alias("gap"))
    asked = wanted.join(views, [key, "at"]).checkpoint()
    # Of the intervals only what lies between the first and the last place that asks for them is kept.
    far = asked.groupBy(key, name, "own", "gap").agg(F.min("at").alias("_low"), F.max("at").alias("_high"))
    spread = regions(bindings.select(key, name, "at", "is_parameter", *payload), scopes, blocks, key).withColumn("own", F.col("own").cast("long"))
    cut = spread.join(far, [key, name, "own", "gap"]).withColumns({"start": F.greatest("start", "_low"), "end": F.least("end", "_high")})
    cut = cut.filter("start <= end").drop("_low", "_high").checkpoint()
    found = best_holding(asked, cut, [key, name, "own", "gap"], "at", best).groupBy(key, name, "at").agg(F.min("_any").alias("_any"), F.min("_sure").alias("_sure"))
    return places.join(found, [key, name, "at"], "left").select(
        *places.columns, (-F.col("_any.a")).alias("binding_at"), F.coalesce("_any.relation", F.lit("hidden")).alias("relation"), (-F.col("_sure.a")).alias("sure_at"),
        *(F.col(f"_any.{p}").alias(p) for p in payload),
    )


def bindings_of(lines: DataFrame, scopes: DataFrame | None = None, also: Sequence[str] = ()) -> DataFrame:
    """path, name, at, is_parameter and ``also`` of what the lines bind; names that their scope declares to be outer ones bind nothing in it.

    Lines know their scope, so ``scopes`` is not needed; callers may give it.
    """
    names = bound_names(F.col("code"))
    free_names = F.when(F.col("outer").isNull(), names).otherwise(F.array_except(names, "outer"))
    free = lines.select("path", F.explode(free_names).alias("name"), F.col("line").alias("at"), F.lit(False).alias("is_parameter"), *also)
    head = F.regexp_extract("code", r"^(?:async\s+)?(?:def|cpdef|cdef)\b[^(]*\((.*)\)[^()]*$", 1)
    # Commas inside of brackets and defaults are no separators.
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(head, r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", ""), r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", ""), r"[=:][^,]*", "")
    names = F.transform(F.split(flat, ","), lambda p: F.regexp_extract(F.trim(p), rf"({NAME})\s*$", 1))
    given = lines.filter(F.col("code").rlike(SCOPE) & (head != "")).select("path", F.explode(F.filter(names, lambda n: n != "")).alias("name"), F.col("line").alias("at"), F.lit(True).alias("is_parameter"), *also)
    return free.unionByName(given)
