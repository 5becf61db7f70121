"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by pseudo-rotations (three rounds of random signs and a fast Hadamard transform) and assigned to the
nearest signed axis; each of several tables has its own rotation. A query probes the axes nearest to it in every table, and
all vectors found there are ranked exactly, in double precision on the original vectors. A query that finds fewer than k is
ranked against all vectors instead, so that small tables and outliers lose nothing.

Every row is indexed. A bucket is split into blocks of bounded size, for vectors and for queries alike, by counts taken
beforehand, and each pair of blocks is one small matrix product that gives at most k rows per query; no pair of vectors
leaves a task unless it is among the k nearest that the task has seen for its query. Repeated rows count
once; of equal vectors only the k+1 smallest ids can be among the nearest, so the rest need no comparison; this changes no
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Tables and probes per table; recall at 10 on random unit vectors of 64 dimensions is 0.95 to 0.99 (README). Few tables with
#: many probes find what many tables with few probes find, and a vector is copied once per table.
TABLES = 3
PROBES = 40
#: Vectors and queries of a block.
BLOCK = 4096
SEED = 20_240_607
#: Answers that a task gathers before it passes them on.
HELD = 200_000


def rotate(unit: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """The pseudo-rotation of a table applied to rows, padded with zeros to a power of two."""
    width = 1 << max(0, (unit.shape[1] - 1).bit_length())
    out = np.zeros((len(unit), width))
    out[:, : unit.shape[1]] = unit
    signs = np.random.default_rng([seed, table, width]).choice([-1.0, 1.0], (3, width))
    for turn in signs:
        out *= turn
        step = 1
        while step < width:
            halves = out.reshape(len(out), -1, 2, step)
            out = np.stack([halves[:, :, 0] + halves[:, :, 1], halves[:, :, 0] - halves[:, :, 1]], axis=2).reshape(len(out), width)
            step *= 2
        out /= np.sqrt(width)
    return out


def axes(rotated: np.ndarray, count: int) -> np.ndarray:
    """The numbers of the `count` nearest signed axes per row, nearest first: 2*i for +axis i, 2*i+1 for -axis i."""
    scores = np.empty((len(rotated), 2 * rotated.shape[1]))
    scores[:, 0::2], scores[:, 1::2] = rotated, -rotated
    count = min(count, scores.shape[1])
    if count == 1:
        return scores.argmax(axis=1)[:, None]
    part = np.argpartition(-scores, count - 1, axis=1)[:, :count]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(scores, part, 1), axis=1, kind="stable"), 1)


def usable(rows: DataFrame, number: str = "double") -> DataFrame:
    """(vec_id, embedding) of the vectors that take part: not null, of finite components, not zero."""
    values = F.col("embedding").cast(f"array<{number}>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    nonzero = F.exists(values, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & nonzero)


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _hashed(rows: DataFrame, probes: int, tables: int, query: bool) -> DataFrame:
    """(dims, cells, kind, vec_id, embedding): the probed axes of all tables; kind 0 for indexed vectors, 1 for queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for dims in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dims))
                vectors = _stack(part.column(1))
                unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
                unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                near = np.concatenate([axes(rotate(unit, table), probes).astype(np.int64) + (table << 32) for table in range(tables)], axis=1)
                starts = np.arange(len(part) + 1, dtype=np.int32) * near.shape[1]
                cells = pa.ListArray.from_arrays(pa.array(starts), pa.array(near.ravel()))
                kinds = pa.array(np.full(len(part), int(query), np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), dims, np.int32)), cells, kinds, part.column(0), part.column(1)], ["dims", "cells", "kind", "vec_id", "embedding"])

    return rows.mapInArrow(run, f"dims int, cells array<long>, kind int, vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}")


def _nearest(queries: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query_id, vec_ids, distances) of the k nearest ids, each with its nearest row: a matrix product selects, differences decide."""
    by_id = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], ids[by_id][1:] != ids[by_id][:-1]]))
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (vectors * vectors).sum(axis=1)
    for start in range(0, len(queries), 256):
        block = queries[start : start + 256]
        with np.errstate(over="ignore", invalid="ignore"):
            own = (block * block).sum(axis=1)
            rough = own[:, None] + squares[None] - 2.0 * (block @ vectors.T)
        slack = 1e-9 * (own + squares.max()) if len(squares) else own
        for row in range(len(block)):
            others = ids != query_ids[start + row]
            if not np.isfinite(rough[row]).all():
                chosen = np.flatnonzero(others)
            else:
                values = np.where(others, rough[row], np.inf)
                least = values if len(starts) == len(ids) else np.minimum.reduceat(values[by_id], starts)
                bound = np.partition(least, k - 1)[k - 1] if len(least) > k else np.inf
                chosen = np.flatnonzero(others & (values <= bound + slack[row]))
            if len(chosen):
                differs = vectors[chosen] - block[row]
                scale = np.abs(differs).max() or 1.0
                with np.errstate(over="ignore"):
                    exact = np.sqrt((differs * differs).sum(axis=1))
                if not np.isfinite(exact).all():
                    exact = scale * np.sqrt(((differs / scale) ** 2).sum(axis=1))
                order = np.lexsort((ids[chosen], exact))
                order = order[np.sort(np.unique(ids[chosen][order], return_index=True)[1])][:k]
                yield int(query_ids[start + row]), ids[chosen][order], exact[order]


def search(rows: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest rows found, all if there are fewer, by Euclidean distance, ties to the smaller vec_id.

    rows and queries have (vec_id, embedding). A row with a query's own vec_id is no candidate of it. Vectors that are null,
    zero or hold null or non-finite components, and rows without vec_id, take no part; vectors of other lengths than the
    query's are no candidates. A vec_id that repeats answers once, with its nearest vector.
    """
    kinds = {frame.schema["embedding"].dataType.simpleString() for frame in (rows, queries)}
    number = "float" if kinds == {"array<float>"} else "double"
    vectors = usable(rows, number).dropDuplicates(["vec_id", "embedding"])
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    distinct = vectors.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= k + 1).drop("place")
    hashed = _hashed(distinct, 1, tables, False).unionByName(_hashed(usable(queries, number), probes, tables, True))
    hashed = materialize(hashed, "polytope")
    answers = materialize(_ranked(hashed, k), "polytope-answers")
    full = answers.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = hashed.where("kind = 1").join(full, "vec_id", "left_anti").select(hashed.columns).dropDuplicates(["vec_id", "embedding"])
    short = materialize(short, "polytope-short")
    if short.isEmpty():
        return answers
    exact = _ranked(hashed.where("kind = 0").unionByName(short).withColumn("cells", F.array(F.lit(0).cast("long"))), k)
    return answers.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").select(answers.columns).unionByName(exact)


def _ranked(indexed: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest of the vectors that share a cell with it."""
    hashed = indexed.select("dims", F.explode("cells").alias("cell"), "kind", "vec_id", "embedding")
    counts = hashed.groupBy("dims", "cell").agg(F.sum(1 - F.col("kind")).alias("n"), F.sum("kind").alias("q")).where("n > 0 and q > 0")
    counts = materialize(counts.select("dims", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), F.ceil(F.col("q") / BLOCK).cast("int").alias("groups")), "polytope-counts")
    salt = F.xxhash64("vec_id", "cell")
    both = hashed.join(counts, ["dims", "cell"])
    mine = F.when(F.col("kind") == 0, F.pmod(salt, F.col("parts"))).otherwise(F.pmod(salt, F.col("groups")))
    other = F.when(F.col("kind") == 0, F.col("groups")).otherwise(F.col("parts"))
    spread = both.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), (other - 1).cast("int"))))
    part = F.when(F.col("kind") == 0, F.col("mine")).otherwise(F.col("other")).cast("int")
    group = F.when(F.col("kind") == 0, F.col("other")).otherwise(F.col("mine")).cast("int")
    blocks = spread.select("dims", "cell", part.alias("part"), group.alias("group"), "kind", "vec_id", "embedding")
    blocks = blocks.repartition("dims", "cell", "part", "group").sortWithinPartitions("dims", "cell", "part", "group", "kind")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, float]] = {}
        place, parts = None, []
        vectors_here = ids_here = None

        def flush() -> pa.RecordBatch:
            triples = [(q, v, d) for q, found in held.items() for v, d in sorted(found.items(), key=lambda x: (x[1], x[0]))[:k]]
            held.clear()
            columns = list(zip(*triples, strict=True)) if triples else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(5)], axis=1)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            ids = batch.column(5).to_numpy()
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                if start == end:
                    continue
                here = tuple(keys[start, :4].tolist())
                if here != place:
                    place, parts, vectors_here = here, [], None
                values = _stack(batch.column(6).slice(start, end - start))
                if keys[start, 4] == 0:
                    parts.append((values, ids[start:end]))
                    vectors_here = None
                elif parts:
                    if vectors_here is None:
                        vectors_here, ids_here = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    for query, found, scores in _nearest(values, vectors_here, ids[start:end], ids_here, k):
                        known = held.setdefault(query, {})
                        for v, d in zip(found.tolist(), scores.tolist(), strict=True):
                            if d < known.get(v, np.inf) or v not in known:
                                known[v] = d
                        if len(known) > 8 * k:
                            held[query] = dict(sorted(known.items(), key=lambda x: (x[1], x[0]))[:k])
            if len(held) * k > HELD:
                yield flush()
        yield flush()

    found = blocks.mapInArrow(solve, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
