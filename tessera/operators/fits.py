"""Fits by group: least squares with any number of unknowns, trimmed refits, enclosing ellipses, neutral axes, minimum norms.

Sums are aggregated before they are shuffled, so a group of any size is a few numbers per task; a group's small system is solved
where its sums meet. What rows of a group are joined with is written first, so that its size is known: a small table goes to the
rows, which aren't dealt by group. Quantiles are exact and taken by stretches. Null keys are a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tessera.operators import stretches
from tessera.sources.shared import shared_path

#: Singular values below this share of the largest count as zero.
SMALLEST = 1e-12


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder, so that what uses it more than once doesn't compute it again, and joins know its size."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sound(*columns: Column) -> Column:
    """True where no column is null, not a number or infinite."""
    return reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) for c in columns])


def least_squares(rows: DataFrame, keys: Sequence[str], x: Sequence[str | Column], y: Sequence[str | Column], weight: str | Column | None = None, ridge: float = 0.0, least: int = 1) -> DataFrame:
    """(keys, n, rank, coefficients): per group the coefficients of every y (outer array) by every x that minimise the weighted
    squares, plus ridge times their own squares.

    Groups of fewer than `least` rows are left out. Where the x of a group don't determine the coefficients (rank below their
    number) the solution of least norm is given. Rows with a null or non-finite value, or without a positive weight, take no part.
    """
    xs, ys = ([F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in columns] for columns in (x, y))
    share = F.lit(1.0) if weight is None else (F.col(weight) if isinstance(weight, str) else weight).cast("double")
    laid = rows.select(*keys, *[c.alias(f"__x{i}") for i, c in enumerate(xs)], *[c.alias(f"__y{i}") for i, c in enumerate(ys)], share.alias("__w"))
    ins, outs = [F.col(f"__x{i}") for i in range(len(xs))], [F.col(f"__y{i}") for i in range(len(ys))]
    laid = laid.where(sound(*ins, *outs, F.col("__w")) & (F.col("__w") > 0))
    pairs = [F.sum(F.col("__w") * ins[i] * ins[j]).alias(f"__p{i}_{j}") for i in range(len(ins)) for j in range(i, len(ins))]
    products = [F.sum(F.col("__w") * a * b).alias(f"__q{k}_{i}") for k, b in enumerate(outs) for i, a in enumerate(ins)]
    sums = laid.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *pairs, *products).where(F.col("n") >= least)
    upper = F.array(*[F.col(f"__p{i}_{j}") for i in range(len(ins)) for j in range(i, len(ins))])
    right = F.array(*[F.col(f"__q{k}_{i}") for k in range(len(outs)) for i in range(len(ins))])
    systems = sums.select(*keys, "n", upper.alias("__p"), right.alias("__q"))
    size, targets = len(ins), len(outs)
    schema = StructType(systems.drop("__p", "__q").schema.fields + StructType.fromDDL("rank int, coefficients array<array<double>>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_, columns_ = np.triu_indices(size)
        for batch in batches:
            count, ranks, found = batch.num_rows, [], []
            flat = batch.column(batch.num_columns - 2).flatten().to_numpy().reshape(count, -1)
            sides = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(count, targets, size)
            for one, side in zip(flat, sides, strict=True):
                normal = np.zeros((size, size))
                normal[rows_, columns_] = normal[columns_, rows_] = one
                # Columns are brought to one scale, so that small units aren't taken for dependence.
                scale = np.sqrt(np.where(np.diag(normal) > 0, np.diag(normal), 1.0))
                ranks.append(int(np.linalg.matrix_rank(normal / np.outer(scale, scale), tol=size * SMALLEST, hermitian=True)))
                if ranks[-1] == size or ridge > 0:
                    found.append(np.linalg.solve(normal + ridge * np.eye(size), side.T).T.tolist())
                else:
                    found.append((np.linalg.pinv(normal, rcond=SMALLEST, hermitian=True) @ side.T).T.tolist())
            columns = [*batch.columns[:-2], pa.array(ranks, pa.int32()), pa.array(found, pa.list_(pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-2], "rank", "coefficients"])

    return systems.mapInArrow(run, schema)


def joined(rows: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with what found holds for their keys, null keys too; keys without a row in found give null.

    Where a key may hold most rows, found should be written: else rows are dealt by key.
    """
    names = {k: f"__of_{i}" for i, k in enumerate(keys)}
    other = found.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in found.columns if c not in names])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]) if names else F.lit(True)
    return rows.join(other, same, "left").drop(*names.values())


def predicted(coefficients: Column, k: int, x: Sequence[Column], low: float | None = None, high: float | None = None) -> Column:
    """The k-th y by fitted coefficients, held to low..high if given; null where the coefficients are."""
    value = reduce(lambda a, b: a + b, [coefficients[k][i] * c for i, c in enumerate(x)])
    value = value if low is None else F.greatest(value, F.lit(low))
    value = value if high is None else F.least(value, F.lit(high))
    return F.when(coefficients.isNotNull(), value)


def trimmed_fit(rows: DataFrame, keys: Sequence[str], x: Sequence[Column], y: Sequence[Column], keep: float = 0.99) -> DataFrame:
    """(keys, n, coefficients, p50, p95): least squares, once more without the rows whose residual is above the `keep` quantile of
    their group, and quantiles of the residuals (lengths over all y) that are left."""
    names = [f"__x{i}" for i in range(len(x))] + [f"__y{i}" for i in range(len(y))]
    laid = rows.select(*keys, *[c.cast("double").alias(n) for c, n in zip([*x, *y], names, strict=True)])
    laid = laid.where(sound(*map(F.col, names)))

    def residuals(kept: DataFrame, fit: DataFrame) -> DataFrame:
        both = joined(kept, fit.select(*keys, "coefficients"), keys)
        missed = [F.col(f"__y{k}") - predicted(F.col("coefficients"), k, [F.col(n) for n in names[: len(x)]]) for k in range(len(y))]
        return both.withColumn("__r", F.sqrt(reduce(lambda a, b: a + b, [m * m for m in missed]))).drop("coefficients")

    inner, outer = names[: len(x)], names[len(x) :]
    laid = written(laid, "fit-rows")
    first = written(residuals(laid, written(least_squares(laid, keys, inner, outer), "fit-first")), "fit-residuals")
    limits = written(stretches.quantiles(first, keys, "__r", [keep]), "fit-limits")
    kept = joined(first, limits, keys).where(F.col("__r") <= F.col("q")[0]).drop("q", "__r")
    kept = written(kept, "fit-kept")
    fit = written(least_squares(kept, keys, inner, outer), "fit")
    left = stretches.quantiles(residuals(kept, fit), keys, "__r", [0.5, 0.95])
    return joined(fit, left, keys).select(*keys, "n", "coefficients", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"))


def ellipse_place(a: Column, b: Column, ellipse: Column) -> Column:
    """The distance of (a, b) from an ellipse's centre in its own measure: 1 on the ellipse."""
    da, db = a - ellipse["center_a"], b - ellipse["center_b"]
    cos, sin = F.cos(ellipse["angle"]), F.sin(ellipse["angle"])
    along, across = (da * cos + db * sin) / ellipse["major"], (db * cos - da * sin) / ellipse["minor"]
    return F.sqrt(along * along + across * across)


def _enclosing(points: DataFrame, keys: Sequence[str], coverage: float) -> DataFrame:
    """(keys, n, ellipse): axes along the main direction; centre by medians, half axes by quantiles of the distances from it."""
    moments = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"), F.covar_samp("a", "b").alias("vab"))
    turn = F.coalesce(0.5 * F.atan2(2 * F.col("vab"), F.col("va") - F.col("vb")), F.lit(0.0))
    moments = written(moments, "ellipse-moments")
    turned = joined(points, moments.select(*keys, turn.alias("turn")), keys)
    u, v = F.col("a") * F.cos("turn") + F.col("b") * F.sin("turn"), F.col("b") * F.cos("turn") - F.col("a") * F.sin("turn")
    axes = turned.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("axis"), u.alias("at")), F.struct(F.lit(1).alias("axis"), v.alias("at")))).alias("p")).select(*keys, "p.axis", "p.at")
    axes = written(axes, "ellipse-axes")
    middles = written(stretches.quantiles(axes, [*keys, "axis"], "at", [0.5]).select(*keys, "axis", F.col("q")[0].alias("middle")), "ellipse-middles")
    apart = joined(axes, middles, [*keys, "axis"]).withColumn("far", F.abs(F.col("at") - F.col("middle")))
    reaches = stretches.quantiles(apart, [*keys, "axis"], "far", [1 - (1 - coverage) / 2]).select(*keys, "axis", F.col("q")[0].alias("reach"))
    sides = joined(middles, reaches, [*keys, "axis"]).groupBy(*keys).agg(*[F.max(F.when(F.col("axis") == k, F.col(c))).alias(f"{c}{k}") for c in ("middle", "reach") for k in (0, 1)])
    whole = joined(moments.select(*keys, "n", turn.alias("turn")), sides, keys)
    cos, sin, long = F.cos("turn"), F.sin("turn"), F.col("reach0") >= F.col("reach1")
    ellipse = F.struct(
        (F.col("middle0") * cos - F.col("middle1") * sin).alias("center_a"), (F.col("middle0") * sin + F.col("middle1") * cos).alias("center_b"),
        F.greatest("reach0", "reach1").alias("major"), F.least("reach0", "reach1").alias("minor"), (F.col("turn") + F.when(long, 0.0).otherwise(np.pi / 2)).alias("angle"),
    )
    return written(whole.select(*keys, "n", ellipse.alias("ellipse")), "ellipse")


def enclosing_ellipse(rows: DataFrame, keys: Sequence[str], a: str, b: str, coverage: float, trim: float = 0.995, least: int = 1000) -> DataFrame:
    """(keys, n, trimmed, center_a, center_b, major, minor, angle_deg): per group an ellipse that holds the share `coverage` of its points.

    It follows the outline, not the density: axes by quantiles. Once, points farther than the `trim` quantile are left out, if
    there are any and `least` are left, and the fit is repeated; then both axes are scaled so that the coverage holds exactly.
    Points with a null or non-finite value take no part; a group without spread has half axes of 0.
    """
    points = rows.select(*keys, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).where(sound(F.col("a"), F.col("b")))
    points = written(points, "ellipse-points")
    first = joined(points, _enclosing(points, keys, coverage), keys)
    placed = written(first.withColumn("d", ellipse_place(F.col("a"), F.col("b"), F.col("ellipse"))).drop("ellipse", "n"), "ellipse-placed")
    limits = written(stretches.quantiles(placed, keys, "d", [trim]).select(*keys, F.col("q")[0].alias("limit")), "ellipse-limits")
    judged = joined(placed, limits, keys)
    counts = judged.groupBy(*keys).agg(F.count_if(F.col("d") > F.col("limit")).alias("over"), F.count_if(F.col("d") <= F.col("limit")).alias("within"))
    counts = written(counts, "ellipse-counts")
    cutting = (F.col("over") > 0) & (F.col("within") >= least)
    marked = joined(judged, counts.select(*keys, F.when(cutting, F.col("over")).otherwise(0).alias("trimmed")), keys)
    kept = marked.where((F.col("trimmed") == 0) | (F.col("d") <= F.col("limit"))).select(*keys, "a", "b", "trimmed")
    kept = written(kept, "ellipse-kept")
    fit = _enclosing(kept, keys, coverage)
    again = joined(kept, fit, keys).withColumn("d", ellipse_place(F.col("a"), F.col("b"), F.col("ellipse")))
    scales = stretches.quantiles(again, keys, "d", [coverage]).select(*keys, F.col("q")[0].alias("scale"))
    cut = kept.groupBy(*keys).agg(F.max("trimmed").cast("long").alias("trimmed"))
    whole = joined(joined(fit, scales, keys), cut, keys)
    scale = F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    return whole.select(*keys, "n", "trimmed", "ellipse.center_a", "ellipse.center_b", *[(F.col(f"ellipse.{c}") * scale).alias(c) for c in ("major", "minor")], F.degrees("ellipse.angle").alias("angle_deg"))


# Edges of the luma bands of a neutral axis, the chroma up to which a pixel is near neutral, and a band's least pixels.
BAND_EDGES, NEUTRAL, LEAST_PIXELS, LEAST_SHARE = (0, 16, 48, 96, 160, 208, 240, 256), 14.0, 32, 0.0005


def neutral_axis(pixels: DataFrame, key: str, damping: float) -> DataFrame:
    """(key, band from 0, n, da, db): for every image and luma band -damping times the median drift of its near-neutral pixels.

    pixels has (key, l, a, b) on 0..255, 128 being neutral. A band with too few near-neutral pixels (32, and a two-thousandth of
    the image) has 0 and its count. Pixels are grouped by image and band, so a group is a part of one image.
    """
    da, db = F.col("a") - 128, F.col("b") - 128
    band = reduce(lambda found, k: found.when((F.col("l") >= BAND_EDGES[k]) & (F.col("l") < BAND_EDGES[k + 1]), k), range(1, 7), F.when((F.col("l") >= BAND_EDGES[0]) & (F.col("l") < BAND_EDGES[1]), 0))
    near = pixels.where(sound(F.col("l"), F.col("a"), F.col("b"))).withColumn("band", F.when(F.sqrt(da * da + db * db) <= NEUTRAL, band))
    sizes = pixels.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    bands = sizes.select(key, "size", F.explode(F.array(*map(F.lit, range(7)))).alias("band"))
    drift = near.where(F.col("band").isNotNull()).groupBy(key, "band").agg(F.count(F.lit(1)).alias("n"), F.median(da).alias("ma"), F.median(db).alias("mb"))
    whole = joined(bands, drift, [key, "band"])
    enough = F.col("n") >= F.greatest(F.lit(LEAST_PIXELS), F.floor(F.col("size") * LEAST_SHARE))
    return whole.select(key, "band", F.coalesce("n", F.lit(0)).alias("n"), *[F.when(enough, -damping * F.col(m)).otherwise(0.0).alias(o) for m, o in (("ma", "da"), ("mb", "db"))])


def minimum_norm(rows: DataFrame, jacobian: str, error: str, name: str = "delta") -> DataFrame:
    """Add the smallest change of the parameters that takes the errors away, to first order, as an array.

    jacobian holds, per parameter, its effect on every error. Where the errors can't all go, the squares that are left are
    least. Null, empty, ragged or non-finite rows give null.
    """
    schema = rows.schema.fields

    def solved(effects: list | None, errors: list | None) -> list[float] | None:
        if not effects or not errors or any(e is None or len(e) != len(errors) for e in effects):
            return None
        matrix, side = np.array(effects, float), np.array(errors, float)
        if not (np.isfinite(matrix).all() and np.isfinite(side).all()):
            return None
        return (-np.linalg.pinv(matrix.T) @ side).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (jacobian, error)]
            found = [solved(e, f) for e, f in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*schema, StructField(name, ArrayType(DoubleType()))]))
