"""Measurement over pixel tables: statistics, histograms, zones, trimmed means, colour measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixels(images: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """(key, y, x, v) of flat arrays of values, row by row."""
    return images.select(key, F.posexplode(values).alias("pos", "v")).select(key, F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).alias("x"), F.col("v").cast("double").alias("v"))


def image_stats(rows: DataFrame, key: str, value: str = "v") -> DataFrame:
    """Mean, share at or above 250 and at or below 5, and deviation over mean (0 for a mean near 0) of values on 0..255."""
    v = F.col(value)
    return rows.groupBy(key).agg(F.avg(v).alias("mean"), F.avg((v >= 250).cast("double")).alias("highlight"), F.avg((v <= 5).cast("double")).alias("shadow"), F.when(F.avg(v) < 1e-6, 0.0).otherwise(F.stddev_pop(v) / F.avg(v)).alias("contrast"))


def proxies(rows: DataFrame, key: str, value: str = "v") -> DataFrame:
    """Tonal range (p95 less p05) and haze (1 less range over p95) of values on 0..1."""
    ends = F.percentile(value, F.array(F.lit(0.05), F.lit(0.95)))
    return rows.groupBy(key).agg(ends.alias("p")).select(key, (F.col("p")[1] - F.col("p")[0]).alias("tonal_range"), F.when(F.col("p")[1] <= 1e-6, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.col("p")[1] - F.col("p")[0]) / F.col("p")[1]))).alias("haze"))


def histogram(rows: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(keys, bin from 0, n): equal bins, the last closed; empty bins are left out."""
    inside = rows.where(F.col(value).between(low, high))
    return inside.groupBy(*keys, (F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)) - 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def zones(rows: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """Means of the 3 x 3 grid, its rows and the whole, in one pass; the last row and column of zones take the rest."""
    zy = F.least(F.floor(F.col("y") / (height // 3)), F.lit(2)).cast("int")
    zx = F.least(F.floor(F.col("x") / (width // 3)), F.lit(2)).cast("int")
    cut = rows.select(key, zy.alias("zy"), zx.alias("zx"), "v")
    return cut.groupingSets([[key, "zy", "zx"], [key, "zy"], [key]], key, "zy", "zx").agg(F.avg("v").alias("mean"))


def trimmed_mean(rows: DataFrame, key: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Mean of the values between two quantiles of each key."""
    w = Window.partitionBy(key)
    ends = rows.withColumn("a", F.percentile("v", low).over(w)).withColumn("b", F.percentile("v", high).over(w))
    return ends.where(F.col("v").between(F.col("a"), F.col("b"))).groupBy(key).agg(F.avg("v").alias("trimmed"))


def colorfulness(r: Column, g: Column, b: Column) -> Column:
    """An aggregate: spread and mean of the opponent channels, as a percentage."""
    rg, yb = r - g, 0.5 * (r + g) - b
    return (F.sqrt(F.var_pop(rg) + F.var_pop(yb)) + 0.15 * (F.avg(F.abs(rg)) + F.avg(F.abs(yb)))) / (2**0.5 + 0.3) * 100


def gradients(rows: DataFrame, key: str, power: float = 1.0) -> DataFrame:
    """Minkowski sum of forward differences over x and y."""
    dx = F.col("v") - F.lag("v").over(Window.partitionBy(key, "y").orderBy("x"))
    dy = F.col("v") - F.lag("v").over(Window.partitionBy(key, "x").orderBy("y"))
    return rows.withColumn("dx", dx).withColumn("dy", dy).groupBy(key).agg(F.pow(F.sum(F.coalesce(F.pow(F.abs("dx"), power), F.lit(0.0)) + F.coalesce(F.pow(F.abs("dy"), power), F.lit(0.0))), 1 / power).alias("edge"))


def box_blur(rows: DataFrame, key: str, radius: int) -> DataFrame:
    """Mean of the window of 2*radius+1 both ways, cut at the borders: a separable pair of window sums."""
    across = Window.partitionBy(key, "y").orderBy("x").rowsBetween(-radius, radius)
    down = Window.partitionBy(key, "x").orderBy("y").rowsBetween(-radius, radius)
    first = rows.withColumn("__s", F.sum("v").over(across)).withColumn("__n", F.count("v").over(across))
    return first.withColumn("blurred", F.sum("__s").over(down) / F.sum("__n").over(down)).drop("__s", "__n")


def local_contrast(rows: DataFrame, key: str, strength: float, radius: int) -> DataFrame:
    """Value plus strength times its distance from the local mean."""
    return box_blur(rows, key, radius).withColumn("sharp", F.col("v") + strength * (F.col("v") - F.col("blurred"))).drop("blurred")


def guided_filter(rows: DataFrame, key: str, radius: int, eps: float) -> DataFrame:
    """Edge-preserving smoothing of an image by itself: local linear fits, averaged, by window sums."""
    across = Window.partitionBy(key, "y").orderBy("x").rowsBetween(-radius, radius)
    down = Window.partitionBy(key, "x").orderBy("y").rowsBetween(-radius, radius)

    def mean(df: DataFrame, column: Column, name: str) -> DataFrame:
        return df.withColumn("__s", F.sum(column).over(across)).withColumn("__n", F.count(column).over(across)).withColumn(name, F.sum("__s").over(down) / F.sum("__n").over(down)).drop("__s", "__n")

    out = mean(mean(rows, F.col("v"), "__m"), F.col("v") * F.col("v"), "__q")
    out = out.withColumn("__a", (F.col("__q") - F.col("__m") * F.col("__m")) / (F.col("__q") - F.col("__m") * F.col("__m") + eps)).withColumn("__b", F.col("__m") * (1 - F.col("__a")))
    out = mean(mean(out, F.col("__a"), "__ma"), F.col("__b"), "__mb")
    return out.withColumn("smooth", F.col("__ma") * F.col("v") + F.col("__mb")).drop("__m", "__q", "__a", "__b", "__ma", "__mb")
