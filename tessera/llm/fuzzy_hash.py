"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes ends a chunk wherever its low bits are zero, so chunks follow content, not offsets; each chunk
gives twelve bits of the signature. The block size (expected chunk length) is the smallest power of two from 4 that gives at
most 64 chunks, and a second signature is made at twice that size. Fingerprints are compared where their block sizes are
equal or differ by a factor of two, by the edit distance of the signatures (insertions and deletions, as a share of both).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from tessera.llm.common import text_or_empty

MAX_CHUNKS = 64
SMALLEST_BLOCK = 4
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
PAIRS = [a + b for a in LETTERS for b in LETTERS]
#: Rows that a stretch of neighbours has at least, about, and the stretches that a task gets at most, about.
STRETCH_ROWS = 1000
STRETCHES_A_TASK = 20
#: Stands for a null doc_id, which comes after all others in descending order.
NO_ID = -(1 << 63)
#: Bits of a text's hash that order rows of one id.
TAG_BITS = 31

MULTIPLIER = np.uint32(0x9E3779B1)
CHUNK_BASE = 0x85EBCA6B
_powers: list[np.ndarray] = []


def _chunk_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of CHUNK_BASE and of its inverse modulo 2**32, n of them at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 2 * n)
        tables = []
        for base in (CHUNK_BASE, pow(CHUNK_BASE, -1, 1 << 32)):
            steps = np.full(size, base, np.uint32)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps, dtype=np.uint32))
        _powers[:] = tables
    return _powers[0], _powers[1]


def _mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint32(15))
    values = values * np.uint32(0x2C1B3C6D)
    return values ^ (values >> np.uint32(13))


def fingerprint(text: str) -> str:
    """block:signature:signature at twice the block; two letters per chunk. Empty text gives `4::`."""
    data = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    n = len(data)
    if not n:
        return f"{SMALLEST_BLOCK}::"
    with np.errstate(over="ignore"):
        m1, m2, m4 = MULTIPLIER, MULTIPLIER * MULTIPLIER, (MULTIPLIER * MULTIPLIER) * (MULTIPLIER * MULTIPLIER)
    two = data.copy()
    two[1:] += data[:-1] * m1
    three = two.copy()
    three[2:] = two[2:] + data[:-2] * m2
    rolling = two.copy()
    rolling[2:] += two[:-2] * m2
    rolling[4:] += three[:-4] * m4
    rolling = _mix(rolling)
    level = max(2, (n // MAX_CHUNKS).bit_length() - 1)
    while True:
        ends = np.flatnonzero((rolling & np.uint32((1 << level) - 1)) == 0)
        if len(ends) < MAX_CHUNKS and level > 2:
            level -= 1
            continue
        break
    while len(ends) >= MAX_CHUNKS:
        level += 1
        ends = ends[(rolling[ends] & np.uint32((1 << level) - 1)) == 0]
    up, down = _chunk_powers(n)
    starts = np.concatenate([np.zeros(1, np.int64), ends + 1])
    if starts[-1] == n:
        starts = starts[:-1]
    sums = np.add.reduceat((data + np.uint32(1)) * up[:n], starts, dtype=np.uint32)
    coarse = np.flatnonzero(np.concatenate([np.ones(1, bool), (rolling[starts[1:] - 1] & np.uint32((2 << level) - 1)) == 0]))
    merged = np.add.reduceat(sums, coarse, dtype=np.uint32)
    fine_text = "".join([PAIRS[s] for s in (_mix(sums * down[starts]) >> np.uint32(20)).tolist()])
    coarse_text = "".join([PAIRS[s] for s in (_mix(merged * down[starts[coarse]]) >> np.uint32(20)).tolist()])
    return f"{1 << level}:{fine_text}:{coarse_text}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence of two signatures in chunks, by one bit per chunk of a."""
    places: dict[str, int] = {}
    size = len(a) // 2
    for k in range(size):
        s = a[2 * k : 2 * k + 2]
        places[s] = places.get(s, 0) | 1 << k
    full = (1 << size) - 1
    row = full
    for k in range(0, len(b), 2):
        found = places.get(b[k : k + 2])
        if found:
            hit = row & found
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def _alike(a: str, b: str) -> float:
    return 2.0 * _common(a, b) / ((len(a) + len(b)) // 2) if a and b else float(a == b)


def likeness(a: str, b: str) -> float:
    """From 0 to 1: one less the edit distance over both lengths, the better of the comparable signatures; 0 where no block sizes agree."""
    if a == b:
        return 1.0
    size_a, fine_a, coarse_a = a.split(":")
    size_b, fine_b, coarse_b = b.split(":")
    block_a, block_b = int(size_a), int(size_b)
    if not fine_a or not fine_b:
        return 0.0
    if block_a == block_b:
        return max(_alike(fine_a, fine_b), _alike(coarse_a, coarse_b))
    if block_a == 2 * block_b:
        return _alike(fine_a, coarse_b)
    if block_b == 2 * block_a:
        return _alike(coarse_a, fine_b)
    return 0.0


def edited(text: str, following: str) -> str:
    """A text whose last half (rounded down) is replaced by as much of the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class _Stretches:
    """The order of (key descending, tag ascending), cut into stretches of which none holds much more than its share of rows.

    Keys are cut at approximate quantiles; a key that fills more than one share has its rows cut by their tags. Stretches have
    numbers (key part, tag part); what the driver holds is a few values for each, and they are as many as tasks need.
    """

    def __init__(self, keyed: DataFrame) -> None:
        tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = keyed.count()
        wanted = max(1, min(STRETCHES_A_TASK * tasks, -(-rows // STRETCH_ROWS)))
        found = [min(int(c), (1 << 63) - 1) for c in keyed.approxQuantile("key", [k / wanted for k in range(1, wanted)], 0.25 / wanted)] if wanted > 1 else []
        # A key that is several quantiles gets a part of its own.
        alone = {c for c, after in zip(found, found[1:], strict=False) if c == after}
        self.spots = np.array(sorted({*found, *(c - 1 for c in alone if c > NO_ID)}), np.int64)
        single = [c in alone for c in self.spots.tolist()] + [False]
        parts = {r["part"]: r["count"] for r in keyed.select(self._part()("key").alias("part")).groupBy("part").count().collect()}
        share = max(1, -(-rows // wanted))
        self.cuts = {p: max(1, -(-n // share)) if single[p] else 1 for p, n in parts.items()}
        ends = keyed.select(self.number()("key", "tag").alias("stretch"), F.struct(F.col("key"), (-F.col("tag")).alias("tag")).alias("place"))
        self.tops = {r["stretch"]: (r["top"]["key"], -r["top"]["tag"]) for r in ends.groupBy("stretch").agg(F.max("place").alias("top")).collect()}
        order = sorted(self.tops, key=lambda s: (-(s >> 32), s & 0xFFFFFFFF))
        #: The stretch before each, round the end.
        self.before = {s: order[k - 1] for k, s in enumerate(order)}

    def _part(self):
        spots = self.spots

        @F.pandas_udf(IntegerType())
        def part(keys: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(spots, keys.to_numpy()), dtype="int32")

        return part

    def number(self):
        """A function of key and tag: the stretch's number, the key's part above the tag's."""
        spots = self.spots
        cuts = np.array([self.cuts.get(p, 1) for p in range(len(spots) + 1)], np.int64)

        @F.pandas_udf(LongType())
        def stretch(keys: pd.Series, tags: pd.Series) -> pd.Series:
            part = np.searchsorted(spots, keys.to_numpy()).astype(np.int64)
            return pd.Series((part << 32) + ((tags.to_numpy() * cuts[part]) >> TAG_BITS))

        return stretch

    def targets(self):
        """A function of key and tag: the stretches that a row goes to, twice the number, plus one where it's the guest of the stretch before."""
        number, tops, before = self.number().func, self.tops, self.before

        @F.pandas_udf(ArrayType(LongType()))
        def targets(keys: pd.Series, tags: pd.Series) -> pd.Series:
            own = number(keys, tags)
            return pd.Series([[2 * s, 2 * before[s] + 1] if tops[s] == (k, t) else [2 * s] for s, k, t in zip(own.tolist(), keys.tolist(), tags.tolist(), strict=True)])

        return targets


def neighbours(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is the one with the next smaller doc_id (null ids last, ties by a hash of the text; after the last the
    first, which for a single row is the row itself; rows equal in id and text follow one another). Null text is empty; an
    empty table gives an empty result; other columns are not read; texts of any length are read whole.

    The order is cut into stretches of neighbours; a stretch is sorted where it is, and the first row of each is also sent to
    the stretch before it, so texts are shuffled once and no ordering and no id meets in one task.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key")
    tag = F.shiftrightunsigned(F.xxhash64(text_or_empty()), 64 - TAG_BITS).alias("tag")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), key, tag)
    stretches = _Stretches(documents.select(key, tag))
    placed = rows.withColumn("target", F.explode(stretches.targets()("key", "tag")))
    placed = placed.select("doc_id", "text", F.shiftright("target", 1).alias("stretch"), (F.col("target") % 2).alias("guest"), "key", "tag")
    ordered = placed.repartition("stretch").sortWithinPartitions("stretch", "guest", F.desc("key"), "tag", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None
        place = None
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, stretch, guest in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if stretch != place:
                    place, waiting = stretch, None
                if guest and waiting is None:
                    continue
                own = fingerprint(text)
                if waiting is not None:
                    last_id, last, print_ = waiting
                    changed = edited(last, text)
                    changed_print = fingerprint(changed)
                    out.append((last_id, len(last), hashlib.sha256(changed.encode()).hexdigest(), print_, changed_print, likeness(print_, changed_print), likeness(print_, own)))
                waiting = None if guest else (doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if k else pa.array(c, pa.int64()) for k, c in enumerate(zip(*out, strict=True))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.select("doc_id", "text", "stretch", "guest").mapInArrow(run, schema)
