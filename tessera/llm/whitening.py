"""Embedding whitening by distributed block matrices.

Entries become integers, and the distinct integer vectors (the fit list) give exact sums and so an exact mean. Centred rows are
indexed into blocks of Spark MLlib's BlockMatrix; the transposed matrix of the fit list times itself is its scatter, summed over
split middle blocks so that no task holds more than a few blocks. The scatter (dimensions x dimensions) is decomposed on the
driver, and the block matrix of all rows times the whitening matrix projects them.

What reaches the driver: the sums, the scatter, and the block numbers that BlockMatrix plans its product with (a few bytes a
block; blocks grow with the table, to 4 million entries).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Components at most.
COMPONENTS = 16
#: Least rows and most entries of a block; the most blocks while blocks can still grow; blocks that one product task multiplies.
BLOCK_ROWS = 1024
BLOCK_ENTRIES = 4_000_000
MANY_BLOCKS = 50_000
BLOCKS_A_TASK = 8

# The integers x = floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: SCALE * entry is held to this range, in which doubles are exact.
LIMIT = float(1 << 52)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, x): the integer vectors of rows whose embedding isn't null or empty and whose entries are finite.

    All vectors have one length: the one that most rows have, of equally frequent ones the longer. Others take no part.
    """
    values = F.col("embedding").cast("array<double>")
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    longest = kept.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    held = F.transform(values, lambda v: F.floor(F.greatest(F.least(v * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))) + OFFSET)
    return kept.where(F.size("embedding") == (longest[0]["dims"] if longest else 0)).select("vec_id", held.alias("x"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written, with a column `index`: 0, 1, 2 ... without gaps, by places in the written parts and the parts' counts."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialize(df.withColumn("part", F.spark_partition_id()).withColumn("place", place), name)
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("part").count().select("part", F.coalesce(before, F.lit(0)).alias("start"))
    return placed.join(starts, "part").select(*df.columns, (F.col("start") + F.col("place")).alias("index"))


def _block_rows(rows: int, dims: int) -> int:
    return max(1, min(max(BLOCK_ROWS, -(-rows // MANY_BLOCKS)), BLOCK_ENTRIES // dims))


def block_matrix(df: DataFrame, rows: int, dims: int) -> BlockMatrix:
    """The block matrix of df (index, values): row `index` holds values, rows that aren't there are zero."""
    vectors = MLUtils.convertVectorColumnsFromML(df.select("index", array_to_vector("values").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, rows, dims).toBlockMatrix(_block_rows(rows, dims), dims)


def scatter(matrix: BlockMatrix, rows: int, dims: int) -> np.ndarray:
    """The transposed matrix times the matrix; each product task multiplies a few blocks, then the products are added up.

    Planning and both factors read the blocks, so they are kept meanwhile, on disk where memory is short; a lost executor's are
    made anew.
    """
    matrix.persist(StorageLevel.MEMORY_AND_DISK)
    blocks = -(-rows // _block_rows(rows, dims))
    splits = min(blocks, max(matrix._java_matrix_wrapper._sc.defaultParallelism, -(-blocks // BLOCKS_A_TASK)))
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    found = BlockMatrix(product, dims, dims).toLocalMatrix().toArray()
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)
    return found


def _centred(df: DataFrame, keep: str, count: int, sums: list[int]) -> DataFrame:
    """df's columns of `keep`, and values: x - sums/count, and deviation: sum of (count*x - sums)^2, null beyond 64 bits."""
    names = keep.split(",")
    most = max(map(abs, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("x")
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(sums))
            if x.size and count * int(np.abs(x).max()) + most >= 1 << 62:
                x = x.astype(object)
            apart = count * x - np.array(sums, dtype=x.dtype)
            if x.size and len(sums) * int(np.abs(apart).max()) ** 2 < 1 << 63:
                total = (apart * apart).sum(axis=1).tolist()
            else:
                total = [t if t < 1 << 63 else None for t in (sum(int(d) * int(d) for d in row) for row in apart)]
            values = (apart / count).astype(np.float64)
            starts = np.arange(len(column) + 1, dtype=np.int32) * len(sums)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), lists, pa.array(total, pa.int64())], [*names, "values", "deviation"])

    kept = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
    return df.select(*names, "x").mapInArrow(run, f"{kept}, values array<double>, deviation long")


def _summed(column: Column, kind: str) -> Column:
    return F.sum(column.cast(kind))


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row of rows (vec_id, embedding) and component.

    Components are unit eigenvectors of the covariance of the fit list, numbered from 1 by falling eigenvalue; whitened is the
    centred integer vector projected on one, over the root of its eigenvalue, and explained the eigenvalue's share of the trace.
    identity_error is measured on the whitened values of the fit list: the largest absolute entry of their covariance minus
    the identity.

    Null vectors, empty ones and those with null or non-finite entries take no part, nor do vectors of another length than
    most. A null vec_id stays, and repeated rows are answered each, but count once in the fit list. Entries beyond 2^46 count
    as that. A component without variance has explained 0 and null whitened, and stays out of identity_error (0 if no
    component has variance). An empty table gives an empty result. Only vec_id and embedding are read.
    """
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    everyone = numbered(usable(rows), "whitening-rows")
    total = everyone.count()
    if total == 0:
        return spark.createDataFrame([], schema)
    fitted = materialize(everyone.groupBy("x").agg(F.min("index").alias("index")), "whitening-fit")
    parts = fitted.select(F.posexplode("x").alias("at", "entry")).groupBy("at").agg(_summed(F.col("entry"), "decimal(20,0)").alias("total"), F.count("*").alias("n"))
    found = sorted(parts.collect(), key=lambda r: r["at"])
    count, sums = found[0]["n"], [int(r["total"]) for r in found]
    dims = len(sums)

    fit_rows = _centred(fitted, "index", count, sums)
    covariance = scatter(block_matrix(fit_rows, total, dims), total, dims) / count
    spread, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-spread, kind="stable")[: min(components, dims)]
    spread, axes = np.maximum(spread[order], 0.0), axes[:, order]
    varied = int((spread > spread[0] * dims * np.finfo(float).eps).sum()) if spread[0] > 0 else 0
    trace = float(np.trace(covariance))
    shares = [float(s / trace) if k < varied else 0.0 for k, s in enumerate(spread)]

    centred = materialize(_centred(everyone, "vec_id,index", count, sums), "whitening-centred")
    error = 0.0
    if varied:
        whitener = axes[:, :varied] / np.sqrt(spread[:varied])
        local = spark.sparkContext.parallelize([((0, 0), Matrices.dense(dims, varied, whitener.ravel(order="F").tolist()))], 1)
        projected = block_matrix(centred, total, dims).multiply(BlockMatrix(local, dims, varied, dims, varied))
        lines = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
        lines = lines.select("index", vector_to_array("vector").alias("white"))
        answers = materialize(centred.select("vec_id", "index", "deviation").join(lines, "index"), "whitening-projected")
        error = _identity_error(answers.join(fitted.select("index"), "index", "left_semi"), count, total, varied)
    else:
        answers = centred.select("vec_id", "index", "deviation", F.array().cast("array<double>").alias("white"))
    each = answers.select("vec_id", "deviation", "white", F.explode(F.sequence(F.lit(1), F.lit(len(order)))).alias("component"))
    white = F.try_element_at("white", F.col("component"))
    return each.select("vec_id", F.col("component").cast("int").alias("component"), F.lit(count).cast("long").alias("n"), "deviation", white.alias("whitened"), F.element_at(F.array(*map(F.lit, shares)), F.col("component")).alias("explained"), F.lit(error).alias("identity_error"))


def _identity_error(fit: DataFrame, count: int, total: int, varied: int) -> float:
    """The largest absolute entry of the covariance of fit's (index, white), centred before multiplying, minus the identity."""
    means = fit.select(F.posexplode("white").alias("at", "entry")).groupBy("at").agg((F.sum("entry") / count).alias("mean"))
    mean = F.array(*[F.lit(float(r["mean"])) for r in sorted(means.collect(), key=lambda r: r["at"])])
    values = F.zip_with("white", mean, lambda y, m: y - m)
    found = scatter(block_matrix(fit.select("index", values.alias("values")), total, varied), total, varied) / count
    return float(np.abs(found - np.eye(varied)).max())
