"""Near copies by the Jaccard similarity of five-word shingles.

MinHash signatures in bands give candidates: pairs at similarity 0.8 share one of 16 bands of 5 values with probability 0.998,
at 0.85 with 0.9999. Each candidate pair is decided by the exact similarity of its shingle sets (64-bit hashes).

Texts of equal sets count once. The sets of a bucket are read in order of doc_id, each against those before it that were no
copies themselves, so a large group of copies takes about as many comparisons as it has members. A bucket with more than
BUCKET_WORDS shingles is dealt to as many parts by a hash, and what is left of it is dealt anew until it fits one part; where
that leaves more than half, its texts aren't copies of each other, and each two parts are compared once.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, materialize, text_or_empty, unused

WORDS = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 5
#: Bands looked at in turn; what is found in one turn is left out of the next.
TURNS = ((0, 2), (2, 6), (6, BANDS))
#: Shingles of a part of a bucket, which one task holds at a time.
BUCKET_WORDS = 300_000
#: Stands for a null doc_id: such rows come last.
NO_ID = (1 << 63) - 1
SEEDS = np.random.default_rng(20_240_611).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; words are those of simhash.fingerprint()."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(parts) < WORDS:
        return np.array([digest(b" ".join(parts), 42)], np.uint64)
    return np.unique(np.array([digest(b" ".join(run), 42) for run in zip(*(parts[k:] for k in range(WORDS)), strict=False)], np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    """The key of each band of a set's signature, as signed longs."""
    least = np.full(len(SEEDS), np.iinfo(np.uint64).max)
    for at in range(0, len(found), 4096):
        least = np.minimum(least, (found[at : at + 4096][None] * SEEDS[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id")


def _mark() -> Column:
    return F.xxhash64(text_or_empty()).alias("mark")


def _signatures(documents: DataFrame) -> DataFrame:
    """(id, mark, node, n, keys) per row with words: node is a hash of the set, n its size."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sets = [shingles(t) for t in batch.column(2).to_pylist()]
        full = [k for k, found in enumerate(sets) if len(found)]
        if not full:
            return None
        nodes = pa.array([xxhash.xxh64_intdigest(sets[k].tobytes()) - (1 << 63) for k in full], pa.int64())
        rest = [pa.array([len(sets[k]) for k in full], pa.int32()), pa.array([band_keys(sets[k]) for k in full], pa.list_(pa.int64()))]
        at = pa.array(full)
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), nodes, *rest], ["id", "mark", "node", "n", "keys"])

    return map_batches(documents.select(_id(), _mark(), text_or_empty().alias("text")), run, "id long, mark long, node long, n int, keys array<long>")


def _sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, mark, grams) of the rows in wanted (id, mark)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t).view(np.int64) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["id", "mark", "grams"])

    rows = documents.select(_id(), _mark(), text_or_empty().alias("text")).join(wanted, ["id", "mark"], "left_semi")
    return map_batches(rows, run, "id long, mark long, grams array<long>").dropDuplicates(["id", "mark"])


def _compare(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, mark) of the sets of dealt (band, key, part, id, mark) near to one before them in their part that isn't itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, postings, sizes = None, {}, []
        for batch in batches:
            places = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            offsets, values = batch.column(5).offsets.to_numpy(), batch.column(5).values.to_numpy()
            found = []
            for row, here in enumerate(places):
                if here != place:
                    place, postings, sizes = here, {}, []
                grams = values[offsets[row] : offsets[row + 1]].tolist()
                lists = [postings[g] for g in grams if g in postings]
                if lists:
                    common = np.bincount(np.fromiter(itertools.chain.from_iterable(lists), np.int64))
                    others = len(grams) + np.array(sizes[: len(common)]) - common
                    if (common >= SIMILARITY * others).any():
                        found.append(row)
                        continue
                for g in grams:
                    postings.setdefault(g, []).append(len(sizes))
                sizes.append(len(grams))
            if found:
                at = pa.array(found)
                yield pa.RecordBatch.from_arrays([batch.column(3).take(at), batch.column(4).take(at)], ["id", "mark"])

    rows = dealt.select("band", "key", "part", "id", "mark").join(sets, ["id", "mark"]).select("band", "key", "part", "id", "mark", "grams")
    rows = rows.repartition("band", "key", "part").sortWithinPartitions("band", "key", "part", "id", "mark")
    return materialize(rows.mapInArrow(run, "id long, mark long").distinct(), "copies-near")


def _copies(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, mark) of the sets in buckets (band, key, id, mark, n) near to one before them."""
    parts = F.ceil(F.col("words") / BUCKET_WORDS)
    gone: DataFrame | None = None
    for turn in itertools.count():
        weights = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("words")).where("rows > 1")
        weights = materialize(weights.select("band", "key", "words", parts.alias("parts")), "copies-weights")
        dealt = rows.join(weights, ["band", "key"]).withColumn("part", F.pmod(F.xxhash64("id", "mark", F.lit(turn)), "parts"))
        near = _compare(dealt, sets)
        gone = near if gone is None else gone.unionByName(near)
        large = weights.where("parts > 1").select("band", "key", F.col("words").alias("before"))
        if large.isEmpty():
            return gone
        left = materialize(rows.join(large, ["band", "key"]).join(near, ["id", "mark"], "left_anti"), "copies-left")
        weights = left.groupBy("band", "key").agg(F.sum("n").alias("words"), F.first("before").alias("before"))
        weights = materialize(weights.select("band", "key", parts.alias("parts"), (F.col("words") * 2 > F.col("before")).alias("stuck")), "copies-weights")
        stuck = left.join(weights.where("stuck").drop("stuck"), ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("id", "mark", F.lit(-1)), "parts"))
        stuck = stuck.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        pair = F.least("own", "other") * F.col("parts") + F.greatest("own", "other")
        gone = gone.unionByName(_compare(stuck.withColumn("part", pair), sets))
        rows = materialize(left.join(weights.where("not stuck").select("band", "key"), ["band", "key"]).select("band", "key", "id", "mark", "n"), "copies-rows")
        if rows.isEmpty():
            return gone


def keep_first(documents: DataFrame) -> DataFrame:
    """The documents without near copies, with all their columns: no two of those that stay are near copies (but for the bands'
    misses), and each that goes is a near copy of one before it, by doc_id (null last) and then a hash of the text.

    Texts without words stay; of rows with equal doc_id and text all stay or all go. Texts of any length are read whole; an
    empty table gives an empty table.
    """
    prints = materialize(_signatures(documents), "copies-signatures")
    items = materialize(prints.groupBy("node").agg(F.min(F.struct("id", "mark", "n", "keys")).alias("first")).select("first.*"), "copies-items")
    keyed = items.select("id", "mark", "n", F.posexplode("keys").alias("band", "key"))
    shared = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    buckets = materialize(keyed.join(shared, ["band", "key"]), "copies-buckets")
    sets = materialize(_sets(documents, buckets.select("id", "mark").distinct()), "copies-sets")
    gone: DataFrame | None = None
    for first, last in TURNS:
        rows = buckets.where((F.col("band") >= first) & (F.col("band") < last))
        if gone is not None:
            rows = materialize(rows.join(gone, ["id", "mark"], "left_anti"), "copies-rows")
        found = _copies(rows, sets)
        gone = materialize(found if gone is None else gone.unionByName(found), "copies-gone").distinct()
    stay = items.select("id", "mark").join(gone, ["id", "mark"], "left_anti")
    drop = materialize(prints.select("id", "mark").join(stay, ["id", "mark"], "left_anti").distinct(), "copies-gone")
    own_id, own_mark = unused(documents.columns, "id"), unused(documents.columns, "mark")
    marked = documents.withColumn(own_id, _id()).withColumn(own_mark, _mark())
    return marked.join(drop.toDF(own_id, own_mark), [own_id, own_mark], "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
