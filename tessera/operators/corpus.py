"""Corpus analytics: percentile tables, bands, A/B comparison, rank correlation, sampling by rank, golden comparison, interpolation joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import stretches


def percentile_table(rows: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, metric, n, p25, p50, p75, low, high): exact percentiles of each metric, in long form."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("s")).select(*by, "s.metric", "s.v")
    keys = [*by, "metric"]
    found = long.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    parts = stretches.quantiles(long, keys, "v", (0.25, 0.5, 0.75)).select(*[F.col(k).alias(f"__{k}") for k in keys], "q")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return found.join(parts, same, "left").select(*keys, "n", *[F.col("q")[i].alias(name) for i, name in enumerate(("p25", "p50", "p75"))], "low", "high")


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Add the rank of value over the whole table, ties sharing their mean rank, without a whole-table sort.

    Rows are counted per value, and the values' places come from the running count over stretches of them.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
    laid = stretches.placed(counts, [], ["__value"], "__n")
    ranks = laid.select("__value", (F.col("__used") - F.col("__n") + (F.col("__n") + 1) / 2).alias(name))
    return rows.join(ranks, F.col(value) == F.col("__value"), "left").drop("__value")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho): correlation of average ranks, 0 where either has no variance."""
    ranked = average_ranks(average_ranks(rows, x, "__rx"), y, "__ry")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.try_divide(F.covar_pop("__rx", "__ry"), F.stddev_pop("__rx") * F.stddev_pop("__ry")), F.lit(0.0)).alias("rho"))


def linspace_sample(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """n evenly spaced rows per key, first and last included, all of a smaller key."""
    ranked = stretches.placed(rows, keys, order).withColumn("__at", F.col("__place") - 1).drop("__place")
    step = (F.col("__size") - 1) / F.lit(max(1, n - 1))
    nearest = F.round(F.col("__at") / step)
    picked = (F.col("__size") <= n) | ((nearest <= n - 1) & (F.floor(nearest * step + 0.5) == F.col("__at")))
    return ranked.where(picked).drop("__at", "__size")


def round_robin(rows: DataFrame, key: str, order: Sequence[str], per_group: int) -> DataFrame:
    """At most per_group rows of each group with their turn (from 1): turn, then group, is the order of drawing."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("turn") <= per_group)


def halves(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Label the lower half (rounded down) of each key `spike`, the upper `flat`."""
    ranked = stretches.placed(rows, keys, order)
    return ranked.withColumn("half", F.when(F.col("__place") <= F.floor(F.col("__size") / 2), "spike").otherwise("flat")).drop("__place", "__size")


def compare(expected: DataFrame, actual: DataFrame, keys: Sequence[str], abs_tol: float, rel_tol: float) -> DataFrame:
    """(keys, expected, actual, delta, verdict) of expected rows: matched, failed or missing by absolute and relative tolerance."""
    joined = expected.join(actual, list(keys), "left")
    delta = F.abs(F.col("actual") - F.col("expected"))
    allowed = abs_tol + F.when(F.abs("expected") > 1.5, rel_tol * F.abs("expected")).otherwise(0.0)
    return joined.select(*keys, "expected", "actual", delta.alias("delta"), F.when(F.col("actual").isNull(), "missing").when(delta <= allowed, "matched").otherwise("failed").alias("verdict"))


def diff(fresh: DataFrame, existing: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed rows of two tables, nulls equal."""
    a, b = fresh.select(key, F.col(value).alias("__a"), F.lit(True).alias("__in_a")), existing.select(key, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    joined = a.join(b, key, "full")
    change = F.when(F.col("__in_b").isNull(), "added").when(F.col("__in_a").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return joined.select(key, change.alias("change")).where("change is not null")


def regressions(new: DataFrame, old: DataFrame, key: str, value: str, factor: float = 1.2) -> DataFrame:
    """(key, old, new, ratio, slower) of the keys on both sides."""
    return new.select(key, F.col(value).alias("new")).join(old.select(key, F.col(value).alias("old")), key).select(key, "old", "new", F.try_divide("new", "old").alias("ratio"), (F.col("new") > factor * F.col("old")).alias("slower"))


def interpolate(value: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise-linear lookup in a small table with constant ends, as one expression."""
    points = sorted(points)
    out = F.when(value <= points[0][0], float(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points[:-1], points[1:], strict=True):
        if x1 > x0:
            out = out.when(value <= x1, y0 + (value - x0) * ((y1 - y0) / (x1 - x0)))
    return F.when(value.isNotNull(), out.otherwise(float(points[-1][1])))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, value: str, tie: str) -> DataFrame:
    """Add to left the value of the last right row of its key at or before it: both sides in one sorted stream, no range join.

    The streams are merged by a union and a window, so a key's rows are sorted once, however many matches there are. A key is
    cut into stretches; the last value of those before goes to the rows that find none in their own.
    """
    l = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType))
    r = right.select(*keys, at, F.lit(0).alias("__side"), F.col(value).alias("__v"))
    both = l.unionByName(r, allowMissingColumns=True)
    order = (at, "__side", tie)
    dealt = stretches.cut(both, keys, order)
    inside = Window.partitionBy(*keys, "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("__here", F.last("__v", ignorenulls=True).over(inside))
    ends = dealt.groupBy(*keys, "__stretch").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order))).alias("__end"))
    ends = ends.select(*keys, "__stretch", F.last("__end", ignorenulls=True).over(stretches.before(keys)).alias("__past"))
    found = stretches.carry(local.where("__side = 1"), ends, keys)
    return found.withColumn(f"last_{value}", F.coalesce("__here", "__past")).drop("__side", "__v", "__here", "__past")


def window_sums(rows: DataFrame, value: str, windows: Sequence[tuple[float, float, float]]) -> Column:
    """The sum of the amounts of all closed windows (low, high, amount) that hold a value."""
    out = F.lit(0.0)
    for low, high, amount in windows:
        out = out + F.when(F.col(value).between(low, high), float(amount)).otherwise(0.0)
    return out


def kernel_mean(rows: DataFrame, key: str, at: str, value: str, centres: Sequence[float], sigma: float) -> DataFrame:
    """Gaussian-weighted means of value at fixed centres per key, in one aggregation."""
    sums = []
    for i, centre in enumerate(centres):
        weight = F.exp(-F.pow((F.col(at) - centre) / sigma, 2) / 2)
        sums += [F.sum(weight * F.col(value)).alias(f"__s{i}"), F.sum(weight).alias(f"__w{i}")]
    found = rows.groupBy(key).agg(*sums)
    return found.select(key, F.explode(F.array(*[F.struct(F.lit(float(c)).alias("centre"), F.try_divide(f"__s{i}", f"__w{i}").alias("mean")) for i, c in enumerate(centres)])).alias("k")).select(key, "k.*")


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that fails (a check is true where it fails), null if none."""
    return F.coalesce(*[F.when(F.coalesce(failed, F.lit(False)), F.lit(name)) for failed, name in checks])
