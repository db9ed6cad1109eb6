"""Secret scan: fixed patterns, and a token-efficiency test for strings that no pattern knows.

Random strings cost a subword vocabulary many tokens: a candidate (a run of 16 or more of the characters that keys are
made of, with letters among them) whose characters per token fall below ``ratio`` is reported as kind ``dense``. Digests
of usual lengths, UUIDs, plain numbers, addresses, versions and identifiers made of words are known and left out; a word
of small letters alone is one of those only up to ``WORD_LETTERS``, longer ones are for the ratio to decide. Spans that
a pattern reports stay whatever the test says; a candidate that touches one adds nothing.

Null text counts as empty and gives no spans. Positions are code points, ends are exclusive. Every row gives one row,
repeated rows included; other input columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_rows, python_rows, text_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The order in which kinds of equal start are listed.
KINDS = ("assign", "access", "hex", "dense")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
SHORTEST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: The longest run of small letters that counts as a word by itself.
WORD_LETTERS = 19
#: A word of up to WORD_LETTERS letters, camel case words, one small letter, or capitals, with up to four digits behind. No
#: text matches in two ways, and a run of separators is taken whole, so a text that fails does so in linear time.
PART = r"(?:(?:[A-Z]?+[a-z]{2,19}+(?![a-z]))+|[a-z]|[A-Z]{1,15}+)?[0-9]{0,4}"
#: Known digests, UUIDs, numbers and dates, and identifiers or paths whose parts are words.
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
    r"|[0-9+/_=-]+"
    rf"|{PART}(?:[/_=+-]++{PART})*)"
)
SPANS = pa.schema([("doc_id", pa.int64()), ("kinds", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


@lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary file as an encoder, once per worker."""
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plumbline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) that the fixed patterns report: leftmost, not overlapping within a kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    # A maximal run of one class matches at its start or nowhere, so the length can stand in the pattern.
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def dense_spans(text: str, known: list[tuple[int, int, str]], vocabulary: str, ratio: float) -> list[tuple[int, int, str]]:
    """Candidates with few characters per token that touch none of the ``known`` spans, which are sorted by start."""
    found = []
    covered: list[tuple[int, int]] = []
    for a, b, _ in known:
        if covered and a <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(b, covered[-1][1]))
        else:
            covered.append((a, b))
    at = 0
    for m in CANDIDATE.finditer(text):
        run, start, end = m[0], m.start(), m.end()
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if at < len(covered) and covered[at][0] < end:
            continue
        if not any(c.isalpha() for c in run) or KNOWN.fullmatch(run):
            continue
        # Rules glued to a key, long runs of few tokens, don't make up for it.
        core = run.strip("+/_=-")
        core = core if len(core) >= SHORTEST else run
        if len(core) < ratio * len(encoder(vocabulary).encode_ordinary(core)):
            found.append((start, end, "dense"))
    return found


def scan_secrets(docs: DataFrame, vocabulary: str = VOCABULARY, ratio: float = 2.0) -> DataFrame:
    """One row per document: doc_id and the arrays kinds, starts and ends of its spans, ordered by start, then kind.

    One pass over the texts without a shuffle; a worker holds a few hundred texts at a time. ``vocabulary`` is a rank
    file at the same path on every machine.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in python_rows(batches):
            out = []
            for doc_id, text in rows:
                base = pattern_spans(text)
                spans = sorted(base + dense_spans(text, base, vocabulary, ratio), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                out.append((doc_id, [s[2] for s in spans], [s[0] for s in spans], [s[1] for s in spans]))
            yield arrow_rows(out, SPANS)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        scan, "doc_id long, kinds array<string>, starts array<long>, ends array<long>"
    )


def secret_digest(docs: DataFrame, vocabulary: str = VOCABULARY, ratio: float = 2.0) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text, per document."""
    spans = scan_secrets(docs, vocabulary, ratio).withColumn(
        "said", F.arrays_zip("kinds", "starts", "ends")
    )
    shown = lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("said", lambda s: s["kinds"] != "dense")
    return spans.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(F.array_join(F.transform(base, shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("said", shown), ",").alias("spans"),
    )


def digest_of(spans: list[tuple[int, int, str]]) -> str:
    """The digest of base spans, as the query gives it (for tests)."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
