"""Best-fit packing of tokenised documents into fixed-length sequences by large-item matching.

Lengths are whole numbers up to the capacity, so the corpus is described by one count per length: that histogram (at most
`capacity` rows, whatever the input) is packed on the driver, and every piece finds its place by its rank among the pieces
of its length. Pieces above a third of the capacity are matched at most two to a sequence, the longest with the longest that
fits beside it; the shorter ones then go, longest first, into the tightest gap that holds them, else into new sequences.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import map_batches, materialize, text_or_empty, unused

CAPACITY = 1024
END_ID = 2
#: tiktoken's splitter goes back over runs of blanks and gives up near a million; texts with a run of this length take the other encoder.
LONG_BLANKS = re.compile(r"\s{50000}")


class _Encoder:
    """The ids of a text as little-endian unsigned 32-bit integers.

    The vocabulary file of the tokenizers library is read once more as ranks, which tiktoken's faster byte-pair encoder takes;
    ids agree because the file numbers its tokens in the order of their merges (compared on every code point and on random
    strings). Texts with an added token or a very long run of blanks, and vocabularies of another form, go to the tokenizers
    library itself.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.added = [t["content"] for t in content.get("added_tokens", [])]
        ranks = _ranks(content, set(self.added))
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(t in text for t in self.added) or LONG_BLANKS.search(text):
            return self.whole(text)
        return array("I", self.fast.encode_ordinary(text)).tobytes()


def _ranks(content: dict, added: set[str]) -> dict[bytes, int] | None:
    """Token bytes to rank of a plain byte-level vocabulary that numbers its tokens in the order of its merges, else None."""
    model, split = content["model"], content.get("pre_tokenizer") or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or content.get("normalizer"):
        return None
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    code = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    tokens = {t: i for t, i in model["vocab"].items() if t not in added}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(c not in code for t in tokens for c in t) or [tokens.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
        return None
    return {bytes(code[c] for c in t): i for t, i in tokens.items()}


@functools.cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if it fits, else full pieces after a first one of the remainder."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    starts = ([0] if head else []) + list(range(head, n, capacity))
    return [(s, head if head and s == 0 else capacity) for s in starts]


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenised pieces (doc_id, piece, start, length, ids_crc32[, ids array<long>]) of every row; each document ends in end_id.

    Null text is empty and gives one piece, the end id alone. Other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, end = _encoder(path), struct.pack("<I", end_id)
        rows, number, start, length, crc, ids = [], [], [], [], [], []
        for at, text in enumerate(batch.column(1).to_pylist()):
            whole = encoder.encode(text) + end
            for k, (s, n) in enumerate(cut(len(whole) // 4, capacity)):
                part = whole[4 * s : 4 * (s + n)]
                rows.append(at)
                number.append(k)
                start.append(s)
                length.append(n)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(np.frombuffer(part, dtype="<u4").astype(np.int64))
        columns = [batch.column(0).cast(pa.int64()).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(ids, pa.list_(pa.int64())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return map_batches(documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for counts[length] pieces: rows (length, low, high, sequence, each, offset).

    The pieces of a length with ranks low <= r < high go, `each` to a sequence, to sequence + (r-low)//each at
    offset + (r-low)%each * length. There are a few rows per length, however many pieces.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    widths: list[int] = []
    sequences = 0

    def put(length: int, bins: int, each: int, base: int, offset: int, total: int | None = None) -> None:
        many = bins * each if total is None else total
        out.append((length, used[length], used[length] + many, base, each, offset))
        used[length] += many
        left[length] -= many

    def leave(gap: int, base: int, bins: int) -> None:
        if gap and bins:
            if gap not in gaps:
                gaps[gap] = []
                insort(widths, gap)
            gaps[gap].append((base, bins))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect_left(large, capacity - a + 1) - 1
            while at >= 0 and (left[large[at]] < (2 if large[at] == a else 1)):
                at -= 1
            b = large[at] if at >= 0 else 0
            bins = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
            if a == b:
                put(a, bins, 2, sequences, 0)
            else:
                put(a, bins, 1, sequences, 0)
                if b:
                    put(b, bins, 1, sequences, a)
            leave(capacity - a - b, sequences, bins)
            sequences += bins
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(widths, s)
            if at == len(widths):
                gap, bins, base = capacity, -(-left[s] // (capacity // s)), sequences
                sequences += bins
            else:
                gap = widths[at]
                base, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    widths.pop(at)
            each = gap // s
            full = min(bins, left[s] // each)
            if full:
                put(s, full, each, base, capacity - gap)
                leave(gap - each * s, base, full)
            if full < bins:
                rest = min(left[s], each)
                if rest:
                    put(s, 1, each, base + full, capacity - gap, rest)
                    leave(gap - rest * s, base + full, 1)
                    full += 1
                leave(gap, base + full, bins - full)
    return out


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...).

    Repeated rows are packed once each. An empty table stays empty. Pieces are ranked within salted groups whose counts per
    length are summed beforehand, so no length meets in one task; the salt is written with the rows and differs between rows
    that are equal, null ids too.
    """
    spark = cut_pieces.sparkSession
    names, salt = cut_pieces.columns, unused(cut_pieces.columns, "salt")
    stored = materialize(cut_pieces.withColumn(salt, F.xxhash64(F.monotonically_increasing_id())), "packing")
    total = stored.count()
    buckets = max(256, total // 50_000)
    salted = stored.withColumn("__bucket", F.pmod(salt, F.lit(buckets)))
    counts = materialize(salted.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("rows")), "packing-counts")
    histogram = {int(r["length"]): int(r["rows"]) for r in counts.groupBy("length").agg(F.sum("rows").alias("rows")).collect()}
    places = spark.createDataFrame(plan(histogram, capacity), "length long, low long, high long, base long, each long, at long")
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__before"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("__bucket", "length").orderBy("doc_id", "piece", salt)) - 1)
    ranked = ranked.join(starts, ["length", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    placed = ranked.join(F.broadcast(places), "length").where("__rank >= low and __rank < high")
    step = F.col("__rank") - F.col("low")
    return placed.select(*names, (F.col("base") + F.floor(step / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + step % F.col("each") * F.col("length")).cast("long").alias("offset"))
