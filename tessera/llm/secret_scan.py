"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

Ordinary words and identifiers take few tokens for their length under a byte-pair vocabulary; random strings take many. A
candidate (a run of 16 or more letters, digits and a few signs) whose characters per token fall below a threshold is
reported, unless it is a known digest (hexadecimal of a digest's length), a UUID, a path or name whose own segments each take
few tokens, or overlaps a span of the fixed patterns. A random segment of 16 or more characters is reported in any path.
"""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, text_or_empty

# Kinds and patterns of the base scan, in order.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = ("passw", "secret", "token", "api")

#: Candidates of the token-efficiency test and its threshold.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MAX_CHARS_PER_TOKEN = 1.9
#: A path or name is cut at these signs; shorter segments than this, and numbers, tell nothing.
SEGMENT = re.compile(r"[A-Za-z0-9]+")
LEAST_SEGMENT = 4
#: From this length on a segment counts by itself; shorter ones must make up this share of a path or name.
LONG_SEGMENT = 16
COSTLY_SHARE = 0.5
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?![A-Za-z0-9])")


@functools.cache
def _encoding(path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("secret-scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    spans = []
    lower = text.lower()
    if any(hint in lower for hint in HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def random_spans(text: str, base: list[tuple[int, int, int]], path: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of random-looking strings outside the base spans, which are in order of their starts."""
    spans = []
    at, reach = 0, 0
    for m in CANDIDATE.finditer(text):
        word = m.group()
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if m.start() < reach:
            continue
        costly = [len(part) for part in _costly_segments(word, path)]
        if costly and (max(costly) >= LONG_SEGMENT or (sum(costly) >= COSTLY_SHARE * len(word) and _costly(word, path))):
            spans.append((m.start(), 3, m.end()))
    return spans


def _costly(word: str, path: str) -> bool:
    return len(word) < MAX_CHARS_PER_TOKEN * len(_encoding(path).encode_ordinary(word))


def _costly_segments(word: str, path: str) -> list[str]:
    """The segments of a word that take many tokens; whole-word UUIDs, digests, numbers and short segments don't count."""
    return [
        part
        for part in SEGMENT.findall(UUID.sub("/", word))
        if len(part) >= LEAST_SEGMENT and not part.isdigit() and not (len(part) in DIGESTS and HEX_ONLY.fullmatch(part)) and _costly(part, path)
    ]


def find(text: str, path: str) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind number, end) in code points, by start and then kind."""
    base = base_spans(text)
    more = random_spans(text, base, path)
    return sorted(base + more) if more else base


def scan(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row; null text is empty and has none; repeated rows repeat."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t, path)] for t in batch.column(1).to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, kind)], ["doc_id", "spans"])

    return map_batches(documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


def redact(documents: DataFrame, path: str, mark: str = "[secret]") -> DataFrame:
    """documents with every span replaced by a mark; all columns and rows stay, null text stays null.

    Of an assignment only the value goes with its name, as the span has both; overlapping spans share one mark.
    """
    names = documents.columns
    position = names.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for start, _, end in find(text, path):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]]) if out else text

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(k) for k in range(len(names))]
        columns[position] = pa.array([clean(t) for t in columns[position].to_pylist()], columns[position].type)
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(documents, run, documents.schema)
