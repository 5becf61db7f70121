"""Trails of work: traces of items as rows, iterations, promotions, sticky states, and measures inside masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import stretches

# A region is reliable from this confidence and share of the image on; highlights clip from this luminance on.
CONFIDENCE, AREA, CLIP = 0.6, 0.005, 250.0


def trace_rows(items: DataFrame, key: str, trace: str, columns: Sequence[str]) -> DataFrame:
    """One row per event of each item's trace with the item's key and fixed columns: others are ignored, missing ones null.

    An item with an empty or null trace gives no row.
    """
    fields = {f.name for f in items.schema[trace].dataType.elementType.fields}
    events = items.select(key, F.explode(trace).alias("__event"))
    return events.select(key, *[(F.col(f"__event.{c}") if c in fields else F.lit(None).cast("string")).alias(c) for c in columns])


def iterations(events: DataFrame, key: str, order: Sequence[str], decides: Column, value: Column, metadata: Column) -> DataFrame:
    """The deciding events with their iteration: its value, else that of the metadata, else the event's place in its trace."""
    placed = stretches.placed(events, [key], order)
    return placed.withColumn("iteration", F.coalesce(value, metadata, F.col("__place"))).where(decides).drop("__place", "__size")


def promotes(trial: Column, current: Column, least: float, relative: float) -> Column:
    """Whether a trial gains enough on the current score: at least a fixed step and a share of the score."""
    return F.coalesce(trial - current >= F.greatest(F.lit(float(least)), F.lit(float(relative)) * F.abs(current)), F.lit(False))


def sticky(rows: DataFrame, keys: Sequence[str], order: Sequence[str], fingerprint: str) -> DataFrame:
    """Add reset (the fingerprint differs from the row before, nulls equal; the first row resets) and age (rows since the reset, from 0)."""
    dealt = stretches.previous(stretches.cut(rows, keys, order), keys, order, fingerprint, "__before")
    marked = dealt.withColumn("reset", F.col("__before").isNull() | ~F.col(fingerprint).eqNullSafe(F.col("__before.v"))).drop("__before")
    return stretches.since(marked, keys, order, F.col("reset")).withColumnRenamed("__since", "age")


def regions(pixels: DataFrame, masks: Sequence[tuple[str, float, int, int, int, int]], key: str, value: str) -> DataFrame:
    """(key, mask_id, confidence, area_ratio, reliable, mean_luminance, highlight_clip_ratio) per image and mask.

    masks are (mask_id, confidence, y0, y1, x0, x1), ends included: a few boxes, stated as an array in every pixel's row, so
    that one aggregation measures all. A mask without a pixel is unreliable, without a mean, and clips nothing.
    """
    names = ("mask_id", "confidence", "y0", "y1", "x0", "x1")
    boxes = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, mask, strict=True)]) for mask in masks])
    each = pixels.select(key, "y", "x", value, F.explode(boxes).alias("m"))
    inside = F.col("y").between(F.col("m.y0"), F.col("m.y1")) & F.col("x").between(F.col("m.x0"), F.col("m.x1"))
    found = each.groupBy(key, F.col("m.mask_id").alias("mask_id"), F.col("m.confidence").alias("confidence")).agg(
        F.count(F.lit(1)).alias("__all"), F.count_if(inside).alias("__n"), F.avg(F.when(inside, F.col(value))).alias("__mean"), F.count_if(inside & (F.col(value) >= CLIP)).alias("__clipped"),
    )
    area = F.col("__n") / F.col("__all")
    clipped = F.coalesce(F.try_divide("__clipped", "__n"), F.lit(0.0))
    return found.select(key, "mask_id", "confidence", F.round(area, 6).alias("area_ratio"), ((F.col("__n") > 0) & (F.col("confidence") >= CONFIDENCE) & (area >= AREA)).alias("reliable"), F.round("__mean", 2).alias("mean_luminance"), F.round(clipped, 6).alias("highlight_clip_ratio"))


def spread_sample(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, must: Column | None = None) -> DataFrame:
    """First, last and evenly spaced rows per key (n in all, places rounded down; all of a smaller key), and the rows that must be there."""
    ranked = stretches.placed(rows, keys, order)
    at, last = F.col("__place") - 1, F.col("__size") - 1
    turn = F.floor(F.try_divide(at * (n - 1) + last - 1, last))
    picked = (F.col("__size") <= n) | ((turn <= n - 1) & (F.floor(turn * last / (n - 1)) == at))
    return ranked.where(picked | F.coalesce(must, F.lit(False)) if must is not None else picked).drop("__place", "__size")


def all_reasons(*checks: tuple[Column, str]) -> Column:
    """The names of all checks that fail, in order; a null check doesn't fail."""
    return F.array_compact(F.array(*[F.when(failed, F.lit(name)) for failed, name in checks]))


def request_fingerprint(prompt: Column, locked: Column, params: Column) -> Column:
    """SHA-256 of the prompt, the sorted locks and the parameters as text; null parts are empty."""
    locks = F.array_join(F.array_sort(F.coalesce(locked, F.array().cast("array<string>"))), ",")
    return F.sha2(F.concat_ws("|", F.coalesce(prompt, F.lit("")), locks, F.coalesce(params, F.lit(""))), 256)
