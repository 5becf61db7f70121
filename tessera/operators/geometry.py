"""Boxes, crops, grids of windows, resampling and curve tools over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import stretches

# Weights of the crop score.
WEIGHTS = (("center", 0.45), ("thirds", 0.35), ("headroom", 0.12), ("coverage", 0.08))


def extents(pixels: DataFrame, keys: Sequence[str], inside: Column, height: int, width: int) -> DataFrame:
    """Bounding box of the pixels that are inside, on 0..1."""
    return pixels.where(inside).groupBy(*keys).agg((F.min("x") / width).alias("x0"), (F.min("y") / height).alias("y0"), ((F.max("x") + 1) / width).alias("x1"), ((F.max("y") + 1) / height).alias("y1"))


def crop_windows(boxes: DataFrame, ratios: Sequence[float], scales: Sequence[float] = (1.0, 0.95, 0.90, 0.85), steps: int = 4) -> DataFrame:
    """Candidate windows (ratio, scale, wx0, wy0, wx1, wy1) for every box: scales of the largest window of a ratio, slid in steps."""
    r, s = F.col("ratio"), F.col("scale")
    out = boxes.withColumn("ratio", F.explode(F.array(*[F.lit(float(x)) for x in ratios]))).withColumn("scale", F.explode(F.array(*[F.lit(float(x)) for x in scales])))
    out = out.withColumn("w", s * F.least(F.lit(1.0), r)).withColumn("h", s * F.least(F.lit(1.0), 1 / r))
    out = out.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    x, y = (1 - F.col("w")) * F.col("i") / steps, (1 - F.col("h")) * F.col("j") / steps
    return out.select(*boxes.columns, "ratio", "scale", "i", "j", x.alias("wx0"), y.alias("wy0"), (x + F.col("w")).alias("wx1"), (y + F.col("h")).alias("wy1"))


def overlap() -> Column:
    """Share of the box x0, y0, x1, y1 that lies in the window."""
    across = F.greatest(F.lit(0.0), F.least("x1", "wx1") - F.greatest("x0", "wx0"))
    down = F.greatest(F.lit(0.0), F.least("y1", "wy1") - F.greatest("y0", "wy0"))
    return across * down / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))


def crop_score() -> Column:
    """Weighted sum of centring, nearness to a third, headroom and coverage of the box in the window."""
    w, h = F.col("wx1") - F.col("wx0"), F.col("wy1") - F.col("wy0")
    cx, cy = ((F.col("x0") + F.col("x1")) / 2 - F.col("wx0")) / w, ((F.col("y0") + F.col("y1")) / 2 - F.col("wy0")) / h
    parts = {
        "center": 1 - F.least(F.lit(1.0), F.hypot(cx - 0.5, cy - 0.5) * 2), "thirds": 1 - F.least(F.lit(1.0), F.least(F.abs(cx - 1 / 3), F.abs(cx - 2 / 3)) * 3),
        "headroom": F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("y0") - F.col("wy0")) / h / 0.2)), "coverage": F.least(F.lit(1.0), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (w * h)),
    }
    return sum((weight * parts[name] for name, weight in WEIGHTS[1:]), WEIGHTS[0][1] * parts[WEIGHTS[0][0]])


def best_windows(boxes: DataFrame, keys: Sequence[str], ratios: Sequence[float], least: float, scales: Sequence[float] = (1.0, 0.95, 0.90, 0.85), steps: int = 4) -> DataFrame:
    """(keys, ratio, scale, i, j, score): per box and ratio the window of the highest score (to six digits) that holds the share `least` of the box.

    Equal scores go by the larger scale, then the smaller i and j. Score and place in that order are one number, so that the best
    is a plain maximum: a task holds one number per box and ratio, however many windows they have. Boxes without such a window
    are left out.
    """
    scales, side = sorted(set(map(float, scales)), reverse=True), steps + 1
    levels, n = F.array(*map(F.lit, scales)), len(scales) * side * side
    windows = crop_windows(boxes, ratios, scales, steps).where(overlap() >= least)
    place = ((F.array_position(levels, F.col("scale")) - 1) * side + F.col("i")) * side + F.col("j")
    score = F.round(F.round(crop_score(), 6) * 1e6).cast("long")
    best = windows.groupBy(*keys, "ratio").agg(F.max(score * n + (n - 1 - place)).alias("__best")).withColumn("__place", n - 1 - F.pmod("__best", F.lit(n)))
    scale = F.element_at(levels, (F.floor(F.col("__place") / (side * side)) + 1).cast("int"))
    i, j = F.pmod(F.floor(F.col("__place") / side), F.lit(side)).cast("int"), F.pmod("__place", F.lit(side)).cast("int")
    return best.select(*keys, "ratio", scale.alias("scale"), i.alias("i"), j.alias("j"), (F.floor(F.col("__best") / n) / F.lit(1e6)).alias("score"))


def downsample(pixels: DataFrame, key: str, factor: int) -> DataFrame:
    """Area means over factor x factor blocks."""
    return pixels.groupBy(key, F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.avg("v").alias("v"))


def resample_rows(pixels: DataFrame, key: str, width: int, target: int) -> DataFrame:
    """Each row of an image at another width: linear weights of the two nearest columns, by a join with a table of taps."""
    spark = pixels.sparkSession
    taps = []
    for t in range(target):
        at = min(max((t + 0.5) * width / target - 0.5, 0.0), width - 1.0)
        low = min(int(at), width - 2)
        taps += [(t, low, 1 - (at - low)), (t, low + 1, at - low)]
    table = spark.createDataFrame(taps, "tx int, x int, weight double")
    return pixels.join(F.broadcast(table), "x").groupBy(key, "y", F.col("tx").alias("x")).agg(F.sum(F.col("weight") * F.col("v")).alias("v"))


def merge_near(rows: DataFrame, key: str, at: str, value: str, gap: float) -> DataFrame:
    """Knots nearer than a gap to the one before become one at their mean."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) >= gap).cast("int"), F.lit(1))
    runs = rows.withColumn("__new", new).withColumn("knot", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "knot").agg(F.avg(at).alias(at), F.avg(value).alias(value), F.count(F.lit(1)).alias("n"))


def roughness(rows: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Mean squared step, and how far the sequence falls in all."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("__d", step).groupBy(key).agg(F.avg(F.col("__d") * F.col("__d")).alias("variation"), F.sum(F.greatest(F.lit(0.0), -F.col("__d"))).alias("falls"))


def match_quantiles(left: DataFrame, right: DataFrame, key: str, value: str, steps: int) -> DataFrame:
    """(key, q, source, target): equal quantiles of two samples, a curve that maps one distribution to the other."""
    at = [k / steps for k in range(steps + 1)]
    a = stretches.quantiles(left, [key], value, at).withColumnRenamed("q", "a")
    b = stretches.quantiles(right, [key], value, at).withColumnRenamed("q", "b")
    return a.join(b, key).select(key, F.posexplode(F.arrays_zip("a", "b")).alias("q", "p")).select(key, "q", F.col("p.a").alias("source"), F.col("p.b").alias("target"))
