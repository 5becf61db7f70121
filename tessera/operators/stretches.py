"""Order within keys where one key may hold most rows: ranks, running sums and exact quantiles without sorting a key in one task.

Rows are dealt by range of (keys, order) into stretches and written once, so that a stretch is the same in every use. Windows
run within (keys, stretch); one row per key and stretch carries what the stretches before it hold. Null keys are keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import shared_path


def columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def cut(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Add __stretch: rows of a smaller number stand before, in (keys, order); rows equal in both share a stretch."""
    path = shared_path(rows.sparkSession, "stretches")
    dealt = rows.repartitionByRange(*columns([*keys, *order])).withColumn("__stretch", F.spark_partition_id())
    dealt.write.parquet(path)
    return rows.sparkSession.read.schema(dealt.schema).parquet(path)


def before(keys: Sequence[str]):
    """The window over the stretches of a key before the row's own; of few rows, one per stretch."""
    return Window.partitionBy(*keys).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)


def carry(rows: DataFrame, ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join what ends holds per (keys, __stretch) to the rows and drop the stretch; null keys match."""
    names = {k: f"__of_{i}" for i, k in enumerate([*keys, "__stretch"])}
    renamed = ends.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in ends.columns if c not in names])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return rows.join(renamed, same).drop("__stretch", *names.values())


def placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], amount: str | None = None) -> DataFrame:
    """Add __place (from 1) and __size (rows) within the key; with an amount also __used, its running sum, and __total, its whole sum.

    A null amount adds nothing. The order should be unique within a key; ties are in any order.
    """
    dealt = cut(rows, keys, order)
    added = F.coalesce(F.col(amount), F.lit(0)) if amount else F.lit(0)
    ends = dealt.groupBy(*keys, "__stretch").agg(F.count(F.lit(1)).alias("__n"), F.sum(added).alias("__sum"))
    whole = Window.partitionBy(*keys)
    ends = ends.select(
        *keys, "__stretch", F.coalesce(F.sum("__n").over(before(keys)), F.lit(0)).alias("__shift"), F.coalesce(F.sum("__sum").over(before(keys)), F.lit(0)).alias("__below"),
        F.sum("__n").over(whole).alias("__size"), F.sum("__sum").over(whole).alias("__total"),
    )
    inside = Window.partitionBy(*keys, "__stretch").orderBy(*columns(order))
    local = dealt.withColumn("__at", F.row_number().over(inside))
    if amount:
        local = local.withColumn("__sum", F.sum(added).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = carry(local, ends, keys).withColumn("__place", F.col("__at") + F.col("__shift"))
    out = out.withColumn("__used", F.col("__sum") + F.col("__below")) if amount else out.drop("__total")
    return out.drop("__at", "__sum", "__shift", "__below")


def previous(dealt: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add name to cut rows: a struct with the value (v) of the row before in its key, null on the key's first row."""
    inside, held = Window.partitionBy(*keys, "__stretch").orderBy(*columns(order)), F.struct(F.col(value).alias("v"))
    local = dealt.withColumn(name, F.lag(held).over(inside))
    ends = dealt.groupBy(*keys, "__stretch").agg(F.max_by(held, F.struct(*columns(order))).alias("__end"))
    ends = ends.select(*keys, "__stretch", F.lag("__end").over(Window.partitionBy(*keys).orderBy("__stretch")).alias("__tail"))
    return carry(local.withColumn("__stretch_too", F.col("__stretch")), ends, keys).withColumnRenamed("__stretch_too", "__stretch").withColumn(name, F.coalesce(name, "__tail")).drop("__tail")


def since(dealt: DataFrame, keys: Sequence[str], order: Sequence[str], marked: Column) -> DataFrame:
    """Add __since to cut rows and drop the stretch: rows from the last marked one (0 there) to this one; before any, the place from 1."""
    inside = Window.partitionBy(*keys, "__stretch").orderBy(*columns(order))
    local = dealt.withColumn("__at", F.row_number().over(inside)).withColumn("__mark", F.when(marked, F.col("__at")))
    local = local.withColumn("__mark", F.max("__mark").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy(*keys, "__stretch").agg(F.count(F.lit(1)).alias("__n"), F.max("__mark").alias("__last"))
    ends = ends.withColumn("__shift", F.coalesce(F.sum("__n").over(before(keys)), F.lit(0)))
    ends = ends.select(*keys, "__stretch", "__shift", F.coalesce(F.max(F.col("__last") + F.col("__shift")).over(before(keys)), F.lit(0)).alias("__carried"))
    last = F.coalesce(F.col("__mark") + F.col("__shift"), F.col("__carried"))
    return carry(local, ends, keys).withColumn("__since", F.col("__at") + F.col("__shift") - last).drop("__at", "__mark", "__shift", "__carried")


def digests(rows: DataFrame, keys: Sequence[str], order: Sequence[str], text: Column, block: int = 1000) -> DataFrame:
    """(keys, n, digest): a digest of each key's ordered texts, by blocks of a fixed number of rows.

    The rows of a block are joined by commas and digested (MD5); the block digests, joined likewise, are digested again, so that
    no row holds a key's whole list and the result is the same however the rows are dealt. Null texts are empty.
    """
    laid = placed(rows.select(*dict.fromkeys([*keys, *order]), F.coalesce(text, F.lit("")).alias("__text")), keys, order)
    blocks = laid.groupBy(*keys, F.floor((F.col("__place") - 1) / block).alias("__block")).agg(F.count(F.lit(1)).alias("__n"), F.array_sort(F.collect_list(F.struct("__place", "__text"))).alias("__rows"))
    each = blocks.select(*keys, "__n", F.struct("__block", F.md5(F.array_join(F.transform("__rows", lambda r: r["__text"]), ",")).alias("d")).alias("__part"))
    whole = each.groupBy(*keys).agg(F.sum("__n").alias("n"), F.array_sort(F.collect_list("__part")).alias("__parts"))
    return whole.select(*keys, "n", F.md5(F.array_join(F.transform("__parts", lambda r: r["d"]), ",")).alias("digest"))


def value_counts(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, __v, __n): how often each value stands in a group; nulls are left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))


def quantiles(rows: DataFrame, by: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """(by, q): the exact quantiles of value per group as an array, interpolated between neighbours; groups without a value are left out.

    Values are counted first, so a value that repeats is one row; the counts give the places.
    """
    return quantiles_of_counts(value_counts(rows, by, value), by, at)


def quantiles_of_counts(counts: DataFrame, by: Sequence[str], at: Sequence[float]) -> DataFrame:
    """quantiles() of value_counts(): each value once per group, with its number of rows."""
    laid = placed(counts, by, ["__v"], "__n")
    picks = []
    for i, q in enumerate(at):
        where = (F.col("__total") - 1) * F.lit(float(q))
        for name, place in (("low", F.floor(where)), ("high", F.ceil(where))):
            picks.append(F.max(F.when((F.col("__used") > place) & (F.col("__used") - F.col("__n") <= place), F.col("__v"))).alias(f"__{name}{i}"))
    found = laid.groupBy(*by).agg(F.max("__total").alias("__total"), *picks)
    out = []
    for i, q in enumerate(at):
        where, low, high = (F.col("__total") - 1) * F.lit(float(q)), F.col(f"__low{i}"), F.col(f"__high{i}")
        share = where - F.floor(where)
        out.append(F.when(low == high, low).otherwise((F.lit(1.0) - share) * low + share * high))
    return found.select(*by, F.array(*out).alias("q"))
