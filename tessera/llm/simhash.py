"""SimHash near-duplicate grouping with pigeonring filtering.

A 64-bit fingerprint is the majority vote of the XXH64 values of a text's word shingles. Fingerprints link at 2 or fewer
differing bits. The pigeonring principle: with three segments in a ring and two differing bits in all, some segment starts a
chain whose cumulative differences stay within the proportional budgets floor(2*1/3)=0, floor(2*2/3)=1, 2. The ring is used
again over the bits outside the starting segments found so far: twice for all, so a candidate shares about 36 bits, and again
for each bucket of fingerprints that is still large, down to rings of so few bits that no bucket can be. Each chain is tested
before the full Hamming check.

Texts of any length are read whole.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.llm.common import components, map_batches, materialize, text_or_empty, unused

BITS = 64
MAX_DISTANCE = 2
#: Buckets of more fingerprints than this go through another ring.
BUCKET_LIMIT = 1024
#: Rings that every fingerprint goes through.
RINGS = 2


def ring(free: list[int], start: int) -> tuple[list[int], list[int], list[int]]:
    """Three segments of the free bits (numbered from the most significant), from segment number `start` round."""
    third = len(free) // 3
    cut = (len(free) - 2 * third, len(free) - third)
    parts = (free[: cut[0]], free[cut[0] : cut[1]], free[cut[1] :])
    return parts[start], parts[(start + 1) % 3], parts[(start + 2) % 3]


def _mask(bits: list[int]) -> int:
    return sum(1 << (BITS - 1 - b) for b in bits)


@functools.cache
def masks(path: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Of the rings with these starting segments: the mask of all starting segments (the key), and of each ring's chain of two."""
    free, key, chains = list(range(BITS)), 0, []
    for start in path:
        first, second, _ = ring(free, start)
        key |= _mask(first)
        chains.append(_mask(first + second))
        free = [b for b in free if b not in first]
    return key, tuple(chains)


def paths(depth: int) -> list[tuple[int, ...]]:
    """The starting segments of `depth` rings, in the order of their numbers in base three."""
    return list(itertools.product(range(3), repeat=depth))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text; 0 where it has no words.

    A-Z are lower-cased, words are runs of anything but space and the controls 09-0D, and a text of fewer words than a
    shingle has one shingle of all its words.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        values = [digest(b" ".join(parts), 42)]
    else:
        values = [digest(b" ".join(run), 42) for run in zip(*(parts[k:] for k in range(words)), strict=False)]
    lanes = np.array(values, dtype=">u8").view(np.uint8).reshape(-1, 8)
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(lanes), 4096):
        votes += np.unpackbits(lanes[at : at + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(votes * 2 > len(values)).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of each document; fp is the fingerprint as a signed long. Null text has no words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), dtype=np.uint64, count=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return map_batches(documents.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, "doc_id long, fp long")


def _bucket_links(depth: int):
    """A batch function: rows (path, key, fp) sorted by (path, key) to a spanning forest of the links of each bucket.

    A bucket has at most BUCKET_LIMIT rows, so what is held between batches is bounded.
    """

    def solve(table: pa.Table) -> pa.RecordBatch:
        path, key = table.column("path").to_numpy(), table.column("key").to_numpy()
        fps = table.column("fp").to_numpy().view(np.uint64)
        same = np.stack([path.astype(np.int64), key], axis=1)
        edges = [0, *(np.flatnonzero((same[1:] != same[:-1]).any(axis=1)) + 1).tolist(), len(fps)]
        out_a, out_b = [], []
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            chains = masks(paths(depth)[path[start]])[1]
            members = fps[start:end]
            for row in range(len(members) - 1):
                differs = members[row + 1 :] ^ members[row]
                at = np.arange(len(differs))
                for chain in reversed(chains):
                    at = at[np.bitwise_count(differs[at] & np.uint64(chain)) <= 1]
                at = at[np.bitwise_count(differs[at]) <= MAX_DISTANCE]
                if len(at):
                    out_a.append(np.full(len(at), members[row]))
                    out_b.append(members[row + 1 :][at])
        if not out_a:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
        a, b = _forest(np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            path, key = table.column("path").to_numpy(), table.column("key").to_numpy()
            others = np.flatnonzero((path != path[-1]) | (key != key[-1]))
            last = int(others[-1]) + 1 if len(others) else 0
            if last:
                yield solve(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            yield solve(rest)

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges (a, b): those that join two trees, by union-find."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    kept = []
    pairs = index.reshape(2, -1).T.tolist()
    for at, (x, y) in enumerate(pairs):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(at)
    return a[kept], b[kept]


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between different fingerprints fp of `distinct` that join just what 2 or fewer differing bits join.

    Of two fingerprints in one bucket that differ in at most two bits, one more ring over the bits outside the key finds again
    a segment where they agree; so a bucket's links are all among those of its parts, and each ring makes a large bucket's
    parts share more bits, until the free bits allow no more than BUCKET_LIMIT fingerprints.
    """
    keyed = _keyed(distinct.select("fp", F.lit(0).alias("path")), RINGS, RINGS)
    edges: DataFrame | None = None
    for depth in itertools.count(RINGS):
        counts = materialize(keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "simhash-buckets")
        small = keyed.join(counts.where(F.col("rows") <= BUCKET_LIMIT).drop("rows"), ["path", "key"])
        small = small.select("path", "key", "fp").repartition("path", "key").sortWithinPartitions("path", "key")
        found = small.mapInArrow(_bucket_links(depth), "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        large = counts.where(F.col("rows") > BUCKET_LIMIT).drop("rows")
        if large.isEmpty():
            return edges
        keyed = materialize(_keyed(keyed.join(large, ["path", "key"]).select("fp", "path"), depth + 1, 1), "simhash-large")


def _keyed(rows: DataFrame, depth: int, added: int) -> DataFrame:
    """(path, key, fp): each row (fp, path) in the 3**added ways to start `added` more rings, which makes `depth` in all."""
    ways = 3**added
    key_masks = F.array(*[F.lit(_signed(masks(p)[0])) for p in paths(depth)])
    longer = rows.select("fp", F.explode(F.sequence(F.col("path") * ways, F.col("path") * ways + ways - 1)).alias("path"))
    return longer.select("path", F.col("fp").bitwiseAND(F.element_at(key_masks, F.col("path") + 1)).alias("key"), "fp")


def _grouped(documents: DataFrame, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """prints (doc_id, fp); known (fp, known_id) for fingerprints of several rows or with links; roots (fp, root, first_id)."""
    prints = materialize(fingerprints(documents, words), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")), "simhash-distinct")
    groups = components(links(distinct.select("fp")), "simhash-components")
    roots = distinct.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "rows", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    roots = materialize(roots, "simhash-roots")
    smallest = roots.where("linked").groupBy("root").agg(F.min("first_id").alias("smallest"))
    known = roots.where("linked or rows > 1").join(smallest, "root", "left").select("fp", F.coalesce("smallest", "first_id").alias("known_id"))
    return prints, materialize(known, "simhash-known"), roots


def near_duplicates(documents: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of documents.

    fingerprint is 16 lowercase hexadecimal digits; component_id is the smallest doc_id reachable by links of 2 or fewer
    differing bits, the row's own included (null where the whole component has only null ids). Equal texts, repeated rows and
    texts without words meet at equal fingerprints; an empty table gives an empty result; other columns are not read.
    """
    prints, known, _ = _grouped(documents, words)
    out = prints.join(known, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("known_id", "doc_id").alias("component_id"))


def keep_first(documents: DataFrame, words: int = 3) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest doc_id stays, with all its columns.

    Rows that share a doc_id fall together if one of them is a copy of a smaller doc_id; of those that stay, equal texts stay
    once. Rows with null doc_id go if their component holds an id; of a component without ids one row stays.
    """
    prints, known, roots = _grouped(documents, words)
    marked = prints.join(known, "fp", "left").select("doc_id", F.coalesce("known_id", "doc_id").alias("component_id"))
    copies = materialize(marked.where("doc_id <> component_id").select("doc_id").distinct(), "simhash-copies")
    kept = documents.where("doc_id is not null").join(copies, "doc_id", "left_anti")
    repeated = materialize(prints.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "simhash-repeated")
    if not repeated.isEmpty():
        mark = unused(documents.columns, "mark")
        once = kept.join(repeated, "doc_id", "left_semi").withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(once.drop(mark))
    if not prints.where("doc_id is null").isEmpty():
        bare = roots.groupBy("root").agg(F.min("first_id").alias("smallest"), F.min(F.when(F.col("first_id").isNull(), F.col("fp"))).alias("fp")).where("smallest is null")
        own = unused(documents.columns, "fp")
        nulls = documents.where("doc_id is null").withColumn(own, _fingerprint_column(text_or_empty(), F.lit(words)))
        nulls = nulls.join(bare.select(F.col("fp").alias(own)), own, "left_semi").dropDuplicates([own])
        kept = kept.unionByName(nulls.drop(own))
    return kept.select(*[F.col(f"`{c}`") for c in documents.columns])


@F.pandas_udf(LongType())
def _fingerprint_column(texts: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([_signed(fingerprint(t, int(n))) for t, n in zip(texts, words, strict=True)], dtype="int64")
