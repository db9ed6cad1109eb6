"""Language-model scores by a probabilistic suffix tree, beside a smoothed unigram score.

Tokens are the words of a text (runs of other than ASCII white space, A-Z in lower case) and one end. As in the unigram
score, all words that the training texts lack are one event. A word seen more than ``frequent`` times in training is a
symbol of its own, so the alphabet grows with the corpus; the others share the symbol of their class of about the same
count: 0, 1, 2-3, 4-7 and so on. The probability of a token is that of its symbol after the symbols before it, times
the word's share of its class. Training counts a word of a class by the class it would have without this one
occurrence, so words seen once stand for new ones. Only symbols that exist take part, and probabilities sum to one.

The tree predicts symbols from contexts of up to ``depth`` symbols. Level by level, a context is counted where it was
seen ``min_count`` times or more, and retained where its next-symbol distribution diverges from that of its longest
retained suffix: leaving each occurrence out in turn, predicting it by the context must win ``gain`` nats. A retained
context's distribution is (n + m * p) / (N + m), with p that of its longest retained suffix, N its count, n that with
the symbol, and m the level's ``smoothing``; the longest retained context of a position gives its probability. Behind two symbols or more
only those next symbols count that were seen twice or more behind the context one symbol shorter; N counts the same.

Texts are cut into batches of about ``batch_bytes``, a longer text being one of its own. A batch is one row: its texts as
one sequence. Whatever must be counted over the corpus (words, symbols behind contexts, contexts) is reduced to the
distinct keys of a batch with their counts; keys go to buckets by ranges of their hash, are summed there, and the sums
go back to the batches that asked, in the order of the keys. Each level is two such exchanges, the second along with the
first of the next level. No task holds more than a batch or a bucket, nothing is broadcast, and only the histogram of
counts up to ``frequent`` reaches the driver. Words are told apart by hashes of 64 bits, contexts by the upper 52.

Null text counts as empty: one end. Repeated rows are documents of their own, and all count. Ids may be null (they are
learned from). An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bucketed, discard, fold, python_rows, release, text_of, written

END_WORD = b"\n"
#: Hashes of the start of a text and of the classes by count.
START = np.uint64(xxhash.xxh64_intdigest(b"start", 1))
#: The low bits of a context's hash are 0, which saves a quarter of what is shuffled.
TAIL = np.uint64(12)
CLASS = np.array([xxhash.xxh64_intdigest(b"class %d" % k, 1) for k in range(64)], dtype=np.uint64)
#: A symbol counts behind a context if it was seen so often behind the context that is one symbol shorter.
FEW = 2
#: What an occurrence wins is rounded to so many parts of a nat, so that sums are exact and the same in every order.
PARTS = 1 << 20
WORDS = 0  # the exchange of word counts; 2 * level is that of symbols behind contexts, 2 * level + 1 that of contexts

STATE = pa.schema(
    [("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())),
     ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("inside", pa.list_(pa.float64())), ("tokens", pa.binary()), ("table", pa.list_(pa.binary()))]
)
STATE_DDL = (
    "batch long, doc_ids array<long>, held array<boolean>, sizes array<long>, known array<long>, base array<double>, "
    "inside array<double>, tokens binary, table array<binary>"
)
ASKED = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("keys", pa.binary()), ("n", pa.binary()), ("won", pa.binary())])
ASKED_DDL = "batch long, kind int, bucket long, keys binary, n binary, won binary"
TOLD = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("n", pa.binary()), ("count", pa.int64()), ("words", pa.int64()), ("mass", pa.int64())])
TOLD_DDL = "batch long, kind int, bucket long, n binary, count long, words long, mass long"
SUMS = pa.schema([("batch", pa.int64()), ("kinds", pa.list_(pa.int32())), ("sums", pa.list_(pa.binary()))])
SUMS_DDL = "batch long, kinds array<int>, sums array<binary>"
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def packed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes))


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys by their differences: most ascend."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, np.uint64), dtype=np.uint64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like np.unique with the inverse, for hashes: the upper bits of a key and its place are sorted as one number.

    A million hashes hardly ever differ in the lower bits alone, which make room for the place; then the keys are sorted again.
    """
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int32)
    least = keys.min()
    spare = np.uint64(min(63, 64 - int(keys.max() - least).bit_length()))
    room = np.uint64((len(keys) - 1).bit_length())
    both = keys - least
    both <<= spare
    both >>= room
    both <<= room
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    both &= (np.uint64(1) << room) - np.uint64(1)
    order = both.view(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    inverse = np.empty(len(keys), dtype=np.int32)
    inverse[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return ordered[first], inverse


def after(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The hash of a context followed by a symbol, which is also that of the context one symbol longer."""
    with np.errstate(over="ignore"):
        x = context * np.uint64(0x9E3779B97F4A7C15) + symbol
        for _ in range(2):
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x >>= TAIL
    x <<= TAIL
    return x


def asking(batch: int, kind: int, keys: np.ndarray, n: np.ndarray, won: np.ndarray | None, bits: int) -> pa.RecordBatch:
    """One row per bucket for ascending ``keys``."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, dtype=np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    used = [(b, x, y) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
    columns = [
        [batch] * len(used),
        [kind] * len(used),
        [b for b, _, _ in used],
        [packed_keys(keys[x:y]) for _, x, y in used],
        [packed(n[x:y].astype(np.uint64)) for _, x, y in used],
        [None if won is None else packed(won[x:y]) for _, x, y in used],
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ASKED, strict=True)], schema=ASKED)


class Batch:
    """Distinct words of some documents, and the documents as indexes into them."""

    def __init__(self) -> None:
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.docs: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, out: bool, text: str) -> None:
        raw = text.encode()
        tokens = raw.lower().split()
        tokens.append(END_WORD)
        index = self.words
        self.ids.append(np.fromiter([index[t] for t in tokens], dtype=np.int32, count=len(tokens)))
        self.docs.append((doc_id, out, len(tokens)))
        self.bytes += len(raw)

    def state(self, number: int) -> pa.RecordBatch:
        digest = xxhash.xxh64_intdigest
        keys, to = np.unique(np.fromiter((digest(w) for w in self.words), dtype=np.uint64, count=len(self.words)), return_inverse=True)
        # Words seen often in the batch come first, in classes within which hashes ascend: small indexes take less room.
        ids = np.concatenate(self.ids)
        seen = np.bincount(ids, minlength=len(to))
        often = np.empty(len(keys), dtype=np.int64)
        often[to] = np.minimum(np.log2(seen).astype(np.int64), 7)
        order = np.argsort(-often, kind="stable")
        place = np.empty(len(keys), dtype=np.int32)
        place[order] = np.arange(len(keys), dtype=np.int32)
        keys, ids = keys[order], place[to][ids]
        state = [[number], *([list(x)] for x in zip(*self.docs, strict=True)), [None], [None], [None], [packed(ids)], [[packed_keys(keys)]]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(state, STATE, strict=True)], schema=STATE)


def batched(docs: DataFrame, held_out: int, folds: int, batch_bytes: int) -> DataFrame:
    """One row of STATE for every batch of texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held = Batch()
        for rows in python_rows(batches):
            for row in rows:
                held.add(*row)
                if held.bytes >= batch_bytes:
                    yield held.state(number)
                    held, number = Batch(), number + 1
        if held.docs:
            yield held.state(number)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == held_out).alias("held_out"), text_of().alias("text")
    ).mapInArrow(scan, STATE_DDL)


def asked_words(states: DataFrame, bits: int) -> DataFrame:
    """The first question: how often each word of a batch occurs in training texts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.select(["batch", "held", "sizes", "tokens", "table"]).to_pylist():
                keys, ids = unpacked_keys(row["table"][0]), unpacked(row["tokens"], np.int32)
                n, order = np.bincount(ids[~np.repeat(row["held"], row["sizes"])], minlength=len(keys)), np.argsort(keys)
                yield asking(row["batch"], WORDS, keys[order], n[order], None, bits)

    return states.mapInArrow(ask, ASKED_DDL)


def tallied(asked: DataFrame, frequent: int, smoothing: Sequence[float], min_count: int, gain: float) -> DataFrame:
    """What each batch is told: the sum of each key it asked for; for contexts that sum if they are retained, else 0."""

    def tally(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("batch")
        kind = rows.column("kind")[0].as_py()
        parts = [unpacked_keys(x.as_py()) for x in rows.column("keys")]
        keys, to = distinct(np.concatenate(parts))
        sums = lambda name, t: np.bincount(to, weights=np.concatenate([unpacked(x.as_py(), t) for x in rows.column(name)]), minlength=len(keys))
        n = sums("n", np.uint64)
        if kind % 2:
            m = smoothing[kind // 2 - 1]
            nats = sums("won", np.int64) / PARTS - n * np.log(np.maximum(n - 1, 0) + m)
            n = np.where((n >= min_count) & (nats >= gain), n, 0)
        n = n.astype(np.uint64)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        told = [packed(x) for x in np.split(n[to], cuts)]
        none = pa.nulls(len(told), pa.int64())
        out = [pa.Table.from_arrays([*(rows.column(c) for c in ("batch", "kind", "bucket")), pa.array(told, pa.binary()), none, none, none], schema=TOLD)]
        if kind == WORDS:
            # How many words of each count there are; those above ``frequent`` together.
            counts, words = np.unique(np.minimum(n, frequent + 1), return_counts=True)
            mass = np.bincount(np.searchsorted(counts, np.minimum(n, frequent + 1)), weights=n, minlength=len(counts))
            blank = [pa.nulls(len(counts), TOLD.field(c).type) for c in ("batch", "kind", "bucket", "n")]
            out.append(pa.Table.from_arrays([*blank, *(pa.array(x.astype(np.int64)) for x in (counts, words, mass))], schema=TOLD))
        return pa.concat_tables(out)

    return asked.groupBy("kind", "bucket").applyInArrow(tally, TOLD_DDL)


def answers(told: pa.Table) -> dict[int, np.ndarray]:
    """For every exchange, the sums in the order of the keys that were asked for."""
    parts: defaultdict[int, list[np.ndarray]] = defaultdict(list)
    ordered = told.sort_by([("kind", "ascending"), ("bucket", "ascending")])
    for kind, n in zip(ordered.column("kind").to_pylist(), ordered.column("n"), strict=True):
        parts[kind].append(unpacked(n.as_py(), np.uint64))
    return {kind: np.concatenate(x).astype(np.float64) for kind, x in parts.items()}


def gathered(told: pa.Table) -> pa.Table:
    """All that a batch is told, as one row."""
    found = answers(told)
    row = [[told.column("batch")[0].as_py()], [list(found)], [[packed(n.astype(np.uint64)) for n in found.values()]]]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(row, SUMS, strict=True)], schema=SUMS)


class Alphabet:
    """Symbols and their smoothed shares of all training tokens, from the histogram of word counts."""

    def __init__(self, histogram: dict[int, tuple[int, int]], frequent: int) -> None:
        """``histogram``: for a count, the number of words and of tokens; for ``frequent`` + 1, those of all above."""
        self.frequent = frequent
        seen = {c: x for c, x in histogram.items() if c > 0}
        self.tokens, self.words = sum(m for _, m in seen.values()), sum(w for w, _ in seen.values())
        self.class_mass, less = np.zeros(64), np.zeros(64)
        low = np.array([c for c in sorted(seen) if c <= frequent], dtype=np.int64)
        exists = np.zeros(64, dtype=bool)
        exists[0] = True
        exists[self.class_of(low)] = True
        self.exists = exists
        for c, own, without in zip(low.tolist(), self.class_of(low).tolist(), self.less_of(low).tolist(), strict=True):
            self.class_mass[own] += seen[c][1]
            less[without] += seen[c][1]
        self.size = int(exists.sum()) + seen.get(frequent + 1, (0, 0))[0]
        self.class_share = (less + 1) / (self.tokens + self.size)

    @staticmethod
    def class_of(c: np.ndarray) -> np.ndarray:
        """0 for 0, 1 for 1, 2 for 2 and 3, and so on."""
        return np.where(c > 0, np.floor(np.log2(np.maximum(c, 1))) + 1, 0).astype(np.int64)

    def less_of(self, c: np.ndarray) -> np.ndarray:
        """The class that a word has without one of its occurrences, if there is such a class."""
        less = self.class_of(c - 1)
        return np.where(self.exists[less], less, self.class_of(c))

    def symbols(self, keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words: symbol, symbol without one occurrence, their shares, and log10 of the word's part of its symbol."""
        own = c > self.frequent
        classes, less = self.class_of(c), self.less_of(np.maximum(c, 1))
        symbol, other = np.where(own, keys, CLASS[classes]), np.where(own, keys, CLASS[less])
        share = (c + 1) / (self.tokens + self.size)
        inside = np.where(own | (c == 0), 0.0, np.log10(np.maximum(c, 1) / np.maximum(self.class_mass[classes], 1)))
        return symbol, other, np.where(own, share, self.class_share[classes]), np.where(own, share, self.class_share[less]), inside


def spelled(state: pa.Table, told: pa.Table, alphabet: Alphabet) -> pa.Table:
    """The batch with its texts as symbols instead of words, and with what needs no context."""
    row = {c: state.column(c)[0].as_py() for c in ("batch", "doc_ids", "held", "sizes", "tokens", "table")}
    keys, ids = unpacked_keys(row["table"][0]), unpacked(row["tokens"], np.int32)
    c = np.empty(len(keys))
    c[np.argsort(keys)] = answers(told)[WORDS]
    inside = alphabet.symbols(keys, c)[4]
    starts = np.cumsum([0, *row["sizes"][:-1]])
    base = np.log10((c + 1) / (alphabet.tokens + alphabet.words + 1))
    per_doc = [np.add.reduceat(x[ids], starts) for x in ((c > 0).astype(np.int64), base, inside)]
    # Words of a class differ no more: one entry stands for all of one count. Frequent entries have small indexes.
    own = c > alphabet.frequent
    _, first, to = np.unique(np.where(own, keys, c.astype(np.uint64)), return_index=True, return_inverse=True)
    order = np.argsort(-np.bincount(to[ids], minlength=len(first)), kind="stable")
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order))
    table = [packed(x[first][order]) for x in (np.where(own, keys, np.uint64(0)), c.astype(np.uint64))]
    out = [[row["batch"]], [row["doc_ids"]], [row["held"]], [row["sizes"]], *([x.tolist()] for x in per_doc), [packed(place[to][ids])], [table]]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, STATE, strict=True)], schema=STATE)


def keys_in(keys: np.ndarray, part: int, parts: int) -> slice:
    """Where ascending keys are in one of ``parts``, a power of two, equal ranges."""
    cut = lambda p: len(keys) if p == parts else int(np.searchsorted(keys, np.uint64(p * ((1 << 64) // parts))))
    return slice(cut(part), cut(part + 1))


class Walk:
    """A batch's way down the tree, as far as the corpus has answered; it ends with questions or with scores."""

    def __init__(self, state: pa.Table, told: dict[int, np.ndarray], alphabet: Alphabet, smoothing: Sequence[float], min_count: int) -> None:
        self.row = {c: state.column(c)[0].as_py() for c in STATE.names}
        self.told, self.smoothing, self.min_count = told, smoothing, min_count
        tokens = unpacked(self.row["tokens"], np.int32)
        keys, c = (unpacked(x, np.uint64) for x in self.row["table"])
        symbol, less, share, less_share, _ = alphabet.symbols(keys, c.astype(np.float64))
        self.tokens, self.symbol, self.less, self.other = tokens, symbol, less, symbol != less
        self.p, self.less_p = share[tokens], less_share[tokens]
        # Contexts of one symbol are entries of the table, or the start: they need no sorting of the texts.
        self.single, to = np.unique(np.r_[symbol, START], return_inverse=True)
        to = to.astype(np.int32)
        self.single_of = np.r_[to[-1:], to[tokens[:-1]]]
        self.start_of = to[-1]
        sizes = np.array(self.row["sizes"], dtype=np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.place = np.arange(len(tokens), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), sizes)
        self.learned = ~np.repeat(np.array(self.row["held"], dtype=bool), sizes)
        self.questions: list[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]] = []
        self.finished = self.go()

    def go(self) -> bool:
        of = self.single_of
        of[self.starts] = self.start_of
        used = np.flatnonzero(np.bincount(of, minlength=len(self.single)))
        new = np.zeros(len(self.single), dtype=np.int32)
        new[used] = np.arange(len(used))
        keys, of = self.single[used], new[of]
        del self.single_of
        at = np.arange(len(of), dtype=np.int32)
        n_scored = n_less = np.zeros(0)  # behind one symbol all symbols count
        for level in range(1, len(self.smoothing) + 1):
            # keys[of] are the contexts at the positions ``at``, n_scored and n_less the counts behind the shorter context.
            m = self.smoothing[level - 1]
            learned = self.learned[at]
            asks = n_scored >= FEW if level > 1 else slice(None)
            counts = learned & (n_less >= FEW) if level > 1 else learned
            token = self.tokens[at]
            differs = counts & self.other[token]
            same = counts & ~differs
            others = np.count_nonzero(differs)
            events, to = distinct(np.r_[after(keys[of[asks]], self.symbol[token[asks]]), after(keys[of[differs]], self.less[token[differs]])])
            to_scored, to_less = np.full(len(at), -1, dtype=np.int32), np.full(len(at), -1, dtype=np.int32)
            to_scored[asks] = to[: len(to) - others]
            to_less[same] = to_scored[same]
            to_less[differs] = to[len(to) - others :]
            del to, same, differs, token
            if 2 * level not in self.told:
                self.questions.append((2 * level, events, np.bincount(to_less[counts], minlength=len(events)), None))
                return False
            n = np.r_[self.told[2 * level], 0.0]
            n_scored, n_less = n[to_scored], n[to_less]
            if 2 * level + 1 in self.told:
                total = self.told[2 * level + 1][of]
                kept = total > 0
                here = at[kept]
                self.p[here] = (n_scored[kept] + m * self.p[here]) / (total[kept] + m)
                self.less_p[here] = np.where(self.learned[here], (n_less[kept] + m * self.less_p[here]) / (total[kept] + m), self.less_p[here])
            elif 2 * level + 1 not in [q[0] for q in self.questions]:
                p = self.less_p[at[counts]]
                won = np.rint(np.log((n_less[counts] - 1 + m * p) / p) * PARTS)
                seen = of[counts]
                won = np.bincount(seen, weights=won, minlength=len(keys)).astype(np.int64)
                self.questions.append((2 * level + 1, keys, np.bincount(seen, minlength=len(keys)), won))
            # A context one symbol longer: what stood at the position before, if it was seen often enough.
            often = np.zeros(len(self.tokens), dtype=bool)
            often[at] = n_scored >= self.min_count
            which = np.zeros(len(self.tokens), dtype=np.int32)
            which[at] = to_scored
            behind = np.zeros((2, len(self.tokens)))
            behind[:, at] = n_scored, n_less
            at = np.flatnonzero(np.r_[False, often[:-1]] & (self.place >= level))
            n_scored, n_less = behind[:, at]
            chosen = which[at - 1]
            used = np.flatnonzero(np.bincount(chosen, minlength=len(events)))
            new = np.zeros(len(events), dtype=np.int32)
            new[used] = np.arange(len(used))
            keys, of = events[used], new[chosen]
        return not self.questions

    def asked(self, bits: int, part: int = 0, parts: int = 1) -> list[pa.RecordBatch]:
        """The questions to one of ``parts`` equal ranges of buckets."""
        return [asking(self.row["batch"], kind, *(x if x is None else x[keys_in(keys, part, parts)] for x in (keys, n, won)), bits) for kind, keys, n, won in self.questions]

    def scores(self) -> pa.Table:
        total = np.add.reduceat(np.log10(self.p), self.starts) + np.array(self.row["inside"])
        columns = [self.row[c] for c in ("doc_ids", "held", "sizes", "known", "base")] + [total]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, SCORES, strict=True)], schema=SCORES)


def language_scores(
    docs: DataFrame,
    held_out: int = 2,
    folds: int = 7,
    frequent: int = 32,
    smoothing: Sequence[float] = (300.0, 100.0, 40.0),
    min_count: int = 8,
    gain: float = 4.0,
    batch_bytes: int = 8 << 20,
    bucket_tokens: int = 4_000_000,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    The tree is as deep as ``smoothing`` has levels. A bucket gets the keys of about ``bucket_tokens`` tokens.
    """
    if frequent < 1 or min_count < 2:
        raise ValueError("frequent must be 1 at least, min_count 2")
    spark = docs.sparkSession
    # Every batch is a file of its bucket; so batches are never shuffled, only the sums go to them.
    states = bucketed(batched(docs, held_out, folds, batch_bytes), "batches", "batch")
    tokens = states.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
    bits = (tokens // bucket_tokens).bit_length()
    tally = lambda rows: tallied(rows, frequent, smoothing, min_count, gain)
    words = written(tally(asked_words(states, bits)), "word-counts")
    histogram = {
        r["count"]: (r["words"], r["mass"])
        for r in words.filter("batch is null").groupBy("count").agg(F.sum("words").alias("words"), F.sum("mass").alias("mass")).collect()
    }
    alphabet = Alphabet(histogram, frequent)
    per_batch = lambda df: df.filter("batch is not null").select(F.col("batch").alias("of"), "kind", "bucket", "n").groupBy("of")
    release(spark)
    held = bucketed(states.groupBy("batch").cogroup(per_batch(words)).applyInArrow(lambda s, t: spelled(s, t, alphabet), STATE_DDL), "symbols", "batch")
    discard(states)
    discard(words)
    del states, words
    release(spark)

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[Callable[[], Walk]]:
        """Walks that have not begun: two at a time would take twice the memory."""
        for rows in batches:
            for i in range(rows.num_rows):
                row = rows.slice(i, 1)
                told: defaultdict[int, list[np.ndarray]] = defaultdict(list)
                for k in range((rows.num_columns - len(STATE)) // 2):
                    kinds, sums = (row.column(f"{c}_{k}")[0].as_py() or [] for c in ("kinds", "sums"))
                    for kind, n in zip(kinds, sums, strict=True):
                        told[kind].append(unpacked(n, np.uint64).astype(np.float64))
                answered = {kind: np.concatenate(x) for kind, x in told.items()}
                del told
                yield partial(Walk, pa.Table.from_batches([row]), answered, alphabet, smoothing, min_count)

    def asking_part(part: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for walk in walks(batches):
                yield from walk().asked(bits, part, parts)

        return ask

    def ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for walk in walks(batches):
            yield from walk().scores().to_batches()

    # A batch's state and what it was told lie in the same bucket: no join shuffles. Sums go there once, when the questions are off the disks.
    known, tables = held, 0
    for k in range(len(smoothing) + 1):
        asking_now = known
        # Symbols behind contexts of one and two symbols are the most: half of them is on the disks at a time.
        parts = 2 if k < 2 and bits else 1
        for part in range(parts):
            told = written(tally(asking_now.mapInArrow(asking_part(part, parts), ASKED_DDL)), "told")
            release(spark)
            sums = bucketed(told.groupBy("batch").applyInArrow(gathered, SUMS_DDL), "sums", "batch")
            discard(told)
            release(spark)
            known = known.join(sums.withColumnsRenamed({"kinds": f"kinds_{tables}", "sums": f"sums_{tables}"}).hint("merge"), "batch", "left")
            tables += 1
    found = known.mapInArrow(ending, SCORES_DDL)
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(alphabet.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
