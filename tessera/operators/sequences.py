"""Ordered operators: bursts (gaps and islands), runs, snapshots, and a global running count without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import stretches


def differs(column: str, window, tolerance: float | None = None) -> Column:
    """Whether a value differs from the row before by the tolerance or more (or at all); null on either side matches."""
    before = F.lag(column).over(window)
    broken = F.abs(F.col(column) - before) >= tolerance if tolerance is not None else F.col(column) != before
    return F.coalesce(broken, F.lit(False))


def bursts(frames: DataFrame, keys: Sequence[str], time: str, tie: str, gap: float, tolerances: dict[str, float | None] | None = None) -> DataFrame:
    """Add island (from 1 per key) : a row opens one when it is more than gap seconds after the one before, or an attribute differs.

    Rows without a time form no burst: their island is null.
    """
    w = Window.partitionBy(*keys).orderBy(time, tie)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    timed = frames.where(F.col(time).isNotNull())
    broken = F.coalesce(seconds - F.lag(seconds).over(w) > gap, F.lit(True))
    for column, tolerance in (tolerances or {}).items():
        broken = broken | differs(column, w, tolerance)
    marked = timed.withColumn("__new", broken.cast("int"))
    out = marked.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    return out.unionByName(frames.where(F.col(time).isNull()).withColumn("island", F.lit(None).cast("long")))


def split_oversized(rows: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """Add chunk (from 0), place (from 1) and size of the row's island; chunks have at most limit rows."""
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("place", place).withColumn("size", F.count(F.lit(1)).over(w)).withColumn("chunk", F.floor((F.col("place") - 1) / limit).cast("int"))


def global_bursts(frames: DataFrame, time: str, tie: str, gap: float, keys: Sequence[str] = ()) -> DataFrame:
    """Islands over the whole table (or per key, where one key may hold most rows) without sorting more than a stretch of time in one task.

    The first row of a stretch compares itself with the last row of the one before it; island numbers of a stretch start after
    those of all before. Only one row per stretch (its ends and its count) meets in one place.
    """
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    dealt = stretches.cut(frames.where(F.col(time).isNotNull()).withColumn("__at", seconds), keys, ["__at", tie])
    w = Window.partitionBy(*keys, "__stretch").orderBy("__at", tie)
    local = dealt.withColumn("__before", F.lag("__at").over(w)).withColumn("__new", F.coalesce((F.col("__at") - F.col("__before") > gap).cast("int"), F.lit(0)))
    local = local.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy(*keys, "__stretch").agg(F.min("__at").alias("__start"), F.max("__at").alias("__end"), F.max("__run").alias("__inner"))
    across = Window.partitionBy(*keys).orderBy("__stretch")
    opened = F.coalesce((F.col("__start") - F.lag("__end").over(across) > gap).cast("int"), F.lit(1))
    steps = ends.withColumn("__opened", opened).withColumn("__total", F.sum(F.col("__opened") + F.col("__inner")).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    offsets = steps.select(*keys, "__stretch", (F.col("__total") - F.col("__inner")).alias("__offset"))
    return stretches.carry(local, offsets, keys).withColumn("island", F.col("__run") + F.col("__offset")).drop("__at", "__before", "__new", "__run", "__offset")


def run_lengths(rows: DataFrame, keys: Sequence[str], order: Sequence[str], below: Column, needed: int) -> DataFrame:
    """Add streak (consecutive rows for which below holds, 0 after a breach or a null) and converged (streak >= needed)."""
    marked = stretches.since(stretches.cut(rows.withColumn("__ok", F.coalesce(below, F.lit(False))), keys, order), keys, order, ~F.col("__ok"))
    return marked.withColumnRenamed("__since", "streak").withColumn("converged", F.col("streak") >= needed).drop("__ok")


def contains_chain(events: DataFrame, key: str, kind: str, order: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """(key, found): whether a key's events contain the wanted kinds in this order, each after the one before.

    The earliest event that ends each prefix of the chain is found by a partial aggregation per step, so no key's events meet in
    one row; the steps are as many as kinds are wanted. An empty chain is in every key; a null key
    holds no other.
    """
    keys, at = events.select(key).distinct(), F.struct(*[F.col(o) for o in order])
    reached = None
    for step in wanted:
        rows = events.where(F.col(kind) == step).select(key, at.alias("__at"))
        if reached is not None:
            rows = rows.join(reached, key).where(F.col("__at") > F.col("__from"))
        reached = rows.groupBy(key).agg(F.min("__at").alias("__from"))
    if reached is None:
        return keys.withColumn("found", F.lit(True))
    ends = reached.select(F.col(key).alias("__key"), F.lit(True).alias("__hit"))
    return keys.join(ends, F.col(key).eqNullSafe(F.col("__key")), "left").select(key, F.coalesce("__hit", F.lit(False)).alias("found"))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Upsert view of a log: the last row per key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def carried(column: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    """The last non-null value before the row."""
    return F.last(column, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
