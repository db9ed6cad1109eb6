"""What places see, by one sweep over the lines of a key: scopes and blocks open and close, bindings are kept in the innermost.

All that is known of a key goes to one task once, sorted by line, and streams through it. Memory holds what is open and
the last binding of each name there, not the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: What a row is; at a line, places come before bindings, which they don't see there.
BLOCK, FUNCTION, CLASS, PLACE, BINDING, PARAMETER = range(6)
FAR = 2**62
#: Rows of a key that one task may sweep, and groups of keys that are counted first.
ROWS, GROUPS = 1 << 21, 1 << 16

#: A binding: its line and its payload.
Bound = tuple[int, tuple]


def _later(held: dict[object, Bound], more: dict[object, Bound]) -> dict[object, Bound]:
    """Both, of each name the binding on the later line."""
    if not held:
        return more
    for name, bound in more.items():
        if name not in held or held[name][0] < bound[0]:
            held[name] = bound
    return held


class Frame:
    """An open scope or block: its own bindings (sure), those of blocks that ended in it (maybe), and ifs that go on (groups)."""

    __slots__ = ("start", "end", "kind", "group_end", "branch_of", "home", "parameters", "sure", "maybe", "groups")

    def __init__(self, start: int, end: int, kind: int, group_end: int = 0, branch_of: int | None = None) -> None:
        self.start, self.end, self.kind, self.group_end, self.branch_of = start, end, kind, group_end, branch_of
        self.home = self
        self.parameters, self.sure, self.maybe, self.groups = {}, {}, {}, []

    def end_groups(self, at: int) -> None:
        """Bindings of the ifs that ended before ``at`` are ones that may have been reached."""
        for _, _, names in (g for g in self.groups if g[0] < at):
            self.maybe = _later(self.maybe, names)
        self.groups = [g for g in self.groups if g[0] >= at]


class Sweep:
    """The scopes and blocks that are open at a line, which only grows."""

    def __init__(self) -> None:
        self.open, self.waiting, self.heads = [Frame(-1, FAR, FUNCTION)], [], {}

    def announce(self, frame: Frame, line: int | None = None) -> None:
        """``frame`` opens at its start; parameters at ``line`` are its own."""
        self.waiting.append(frame)
        if line is not None:
            self.heads.setdefault(line, []).append(frame)

    def reach(self, at: int) -> None:
        if self.waiting:
            ready = sorted((f for f in self.waiting if f.start <= at), key=lambda f: (f.start, -f.end, f.kind == BLOCK))
            for frame in ready:
                self._close(frame.start)
                if frame.kind == BLOCK:
                    frame.home = self.open[-1].home
                self.open.append(frame)
            if ready:
                self.waiting = [f for f in self.waiting if f.start > at]
        self._close(at)

    def _close(self, at: int) -> None:
        while self.open[-1].end < at:
            frame = self.open.pop()
            if frame.kind != BLOCK:
                continue
            frame.end_groups(FAR)
            names, below = _later(frame.maybe, frame.sure), self.open[-1]
            if names and frame.group_end >= at:
                below.groups.append((frame.group_end, frame.branch_of, names))
            elif names:
                below.maybe = _later(below.maybe, names)

    def bind(self, name: object, at: int, payload: tuple, is_parameter: bool) -> None:
        """Of equal lines the first binding stays."""
        if is_parameter:
            held = [f.parameters for f in self.heads.get(at, ())] or [self.open[-1].home.parameters]
        else:
            held = [self.open[-1].sure]
        for names in held:
            if name not in names or names[name][0] < at:
                names[name] = at, payload

    def see(self, name: object, at: int) -> tuple[Bound | None, str, Bound | None]:
        """The binding that is seen, its relation, and the best one that dominates.

        Scopes go from the innermost outwards, and so do the blocks of a scope: an inner one began behind all that the outer holds.
        """
        found, home, above = None, None, None
        own = self.open[-1].home
        for frame in reversed(self.open):
            inner, above = above, frame
            if frame.home.kind == CLASS and frame.home is not own:
                continue
            if frame.home is not home:
                home = frame.home
                if name in home.parameters:
                    bound = home.parameters[name]
                    return (found, "conditional", bound) if found else (bound, "dominates", bound)
            sure = frame.sure.get(name)
            if not found:
                if frame.groups:
                    frame.end_groups(at)
                found = frame.maybe.get(name)
                for _, branch_of, names in frame.groups:
                    # Between the branches of an if, all of them may have been reached; in one, no other.
                    if branch_of is not None and not (inner and inner.branch_of == branch_of) and name in names and (not found or found[0] < names[name][0]):
                        found = names[name]
                if sure and (not found or found[0] < sure[0]):
                    return sure, "dominates", sure
            if sure:
                return found, "conditional", sure
        return found, "conditional" if found else "hidden", None


def events(places: DataFrame, bindings: DataFrame, scopes: DataFrame, blocks: DataFrame, key: str, name: str, payload: Sequence[str]) -> DataFrame:
    """A row for each of them: _key, _at, _what, three numbers, _name, the payload of bindings and the other columns of places."""
    more = [c for c in places.columns if c not in (key, name, "at")]
    none = F.lit(None)
    long = lambda c: F.col(c).cast("long")
    types = {**{"_name": places.schema[name].dataType}, **{f"_b{i}": bindings.schema[c].dataType for i, c in enumerate(payload)}, **{f"_p{i}": places.schema[c].dataType for i, c in enumerate(more)}}

    def row(df: DataFrame, at: object, what: object, numbers: Sequence[object] = (F.lit(0), F.lit(0), none), **own: object) -> DataFrame:
        other = [own.get(c, none.cast(t)).alias(c) for c, t in types.items()]
        return df.select(F.col(key).alias("_key"), at.alias("_at"), what.cast("int").alias("_what"), *(n.cast("long").alias(f"_n{i}") for i, n in enumerate(numbers)), *other)

    kind = F.when(F.col("kind") == "class", CLASS).otherwise(FUNCTION)
    spans = [df.filter(F.col(key).isNotNull() & (F.col("start") <= F.col("end"))) for df in (scopes, blocks)]
    bound = bindings.filter(F.col(key).isNotNull() & F.col(name).isNotNull() & F.col("at").isNotNull())
    each = [
        row(spans[0], F.least(long("line"), long("start")), kind, [F.col("start"), F.col("end"), F.col("line")]),
        row(spans[1], long("start"), F.lit(BLOCK), [F.col("end"), F.coalesce("group_end", "end"), F.col("branch_of")]),
        row(places, long("at"), F.lit(PLACE), _name=F.col(name), **{f"_p{i}": F.col(c) for i, c in enumerate(more)}),
        row(bound, long("at"), F.when(F.col("is_parameter"), PARAMETER).otherwise(BINDING), _name=F.col(name), **{f"_b{i}": F.col(c) for i, c in enumerate(payload)}),
    ]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


def large_keys(rows: DataFrame, key: str, most: int) -> DataFrame | None:
    """The keys of more than ``most`` rows, if there are any; fewer than one for ``most`` rows.

    Rows are counted by groups of keys first, so that keys that are none move no row each.
    """
    group = F.pmod(F.hash(key), F.lit(GROUPS))
    full = [r[0] for r in rows.groupBy(group.alias("g")).agg(F.count("*").alias("n")).filter(F.col("n") > most).collect()]
    if not full:
        return None
    counts = rows.filter(F.col(key).isNotNull() & group.isin(full)).groupBy(key).agg(F.count("*").alias("_n"))
    found = counts.filter(F.col("_n") > most).select(key).checkpoint()
    return None if found.isEmpty() else found


def seen(rows: DataFrame, places: DataFrame, bindings: DataFrame, key: str, name: str, payload: Sequence[str], once: bool) -> DataFrame:
    """``places`` with binding_at, relation, sure_at and the payload, from the rows that ``events`` makes; equal places one time if ``once``."""
    more = [c for c in places.columns if c not in (key, name, "at")]
    place = {key: "_key", name: "_name", "at": "_at"} | {c: f"_p{i}" for i, c in enumerate(more)}
    at_type = bindings.schema["at"].dataType
    told = [StructField("binding_at", at_type), StructField("relation", StringType()), StructField("sure_at", at_type)]
    schema = StructType([*(StructField(c, places.schema[c].dataType) for c in places.columns), *told, *(StructField(p, bindings.schema[p].dataType) for p in payload)])
    own = [place[c] for c in places.columns]
    dealt = rows.repartition("_key").sortWithinPartitions("_key", "_at", "_what", *(f"_b{i}" for i in range(len(payload))))
    return dealt.mapInArrow(_run(own, len(payload), schema, once and not more), schema)


def _listed(column: pa.Array) -> list:
    """The values in Python; whole numbers without nulls the fast way."""
    return column.to_numpy().tolist() if pa.types.is_integer(column.type) and not column.null_count else column.to_pylist()


def _run(own: Sequence[str], width: int, schema: StructType, once: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from pyspark.sql.pandas.types import to_arrow_schema

    names = "_key", "_at", "_what", "_n0", "_n1", "_n2", "_name"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = to_arrow_schema(schema)
        now, sweep, line, asked = None, None, None, set()
        for batch in batches:
            loads = zip(*(batch.column(f"_b{i}").to_pylist() for i in range(width))) if width else repeat(())
            taken, found = [], []
            for i, (key, at, what, n0, n1, n2, name, load) in enumerate(zip(*(_listed(batch.column(c)) for c in names), loads)):
                if sweep is None or key != now:
                    now, sweep, line = key, Sweep(), None
                    asked.clear()
                if what == BLOCK:
                    sweep.announce(Frame(at, n0, BLOCK, n1, n2))
                    continue
                if what < PLACE:
                    sweep.announce(Frame(n0, n1, what), n2)
                    continue
                if at is not None and (sweep.waiting or sweep.open[-1].end < at):
                    sweep.reach(at)
                if what != PLACE:
                    sweep.bind(name, at, load, what == PARAMETER)
                    continue
                if once:
                    if at != line:
                        line = at
                        asked.clear()
                    if name in asked:
                        continue
                    asked.add(name)
                taken.append(i)
                found.append(sweep.see(name, at) if at is not None else (None, "hidden", None))
            if taken:
                index = pa.array(taken, pa.int32())
                columns = [batch.column(c).take(index) for c in own]
                columns += [[b and b[0] for b, _, _ in found], [r for _, r, _ in found], [s and s[0] for _, _, s in found]]
                columns += [[b and b[1][i] for b, _, _ in found] for i in range(width)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(columns, form)], schema=form)

    return run
