"""Batch selection: hard filter, composite score, ranked selection with confidence, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import stretches

# Filter limits, score weights, calibration anchors (raw p25 and p75, mapped to 2 and 4).
LIMITS = (("motion_blur", ">", 0.35), ("low_detail", "<", 3.0), ("highlight_clip", ">", 0.03), ("shadow_clip", ">", 0.20))
ANCHORS = {
    "overall": (-0.637, -0.272), "quality": (-0.790, 0.058), "composition": (-0.886, -0.411), "lighting": (0.146, 0.811), "color": (0.541, 0.693), "depth_of_field": (-0.452, 0.609), "content": (-0.790, -0.271),
}


def reject_reasons(motion: Column, detail: Column, highlight: Column, shadow: Column) -> Column:
    """Names of the limits that are broken, in fixed order; missing values break none."""
    broken = [F.when(value > limit if sign == ">" else value < limit, F.lit(name)) for value, (name, sign, limit) in zip((motion, detail, highlight, shadow), LIMITS, strict=True)]
    return F.array_compact(F.array(*broken))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def composite_score(mean: Column, detail: Column, contrast: Column) -> Column:
    """0 to 5, to three places: lighting, quality, composition and colour by fixed weights."""
    lighting = 5 - 4 * F.abs(mean / 255 - 0.5)
    quality = clip(detail / 15, 0.0, 1.0) * 3 + 1.5
    composition = clip(contrast / 0.8, 0.0, 1.0) * 2 + 1.8
    return F.round(clip(0.35 * lighting + 0.30 * quality + 0.20 * composition + 0.15 * 3.2, 0.0, 5.0), 3)


def calibrate(raw: Column, dimension: str) -> Column:
    low, high = ANCHORS[dimension]
    return clip(2 + (raw - low) * (2 / (high - low)), 0.0, 5.0)


def select_top(rows: DataFrame, keys: Sequence[str], score: str, tie: str, n: int = 3, ties_share: bool = False) -> DataFrame:
    """The n best rows per key with place (from 0) and confidence; with ties_share equal scores share the first's confidence."""
    w = Window.partitionBy(*keys)
    order = w.orderBy(F.desc(score), tie)
    ranked = rows.withColumn("place", F.row_number().over(order) - 1).withColumn("__tied", F.rank().over(w.orderBy(F.desc(score))) - 1).withColumn("__size", F.least(F.count(F.lit(1)).over(w), F.lit(n)))
    position = F.col("__tied") if ties_share else F.col("place")
    confidence = F.round(clip(0.50 + F.col(score) / 10 + (F.col("__size") - position) * 0.02, 0.0, 0.98), 3)
    return ranked.where(F.col("place") < n).withColumn("confidence", confidence).drop("__tied", "__size")


def status(passed: Column, confidence: Column) -> Column:
    return F.when(~passed, "rejected").when(confidence.isNull(), "skipped").when(confidence < 0.5, "manual_review").when(confidence >= 0.6, "recommended").otherwise("candidate")


def keep_newest(rows: DataFrame, keys: Sequence[str], time: str, tie: str, count: int) -> DataFrame:
    """The newest `count` rows per key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie)))).where(F.col("__n") <= count).drop("__n")


def within_bytes(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], size: str, budget: int) -> DataFrame:
    """Newest first while the sizes sum to at most the budget; the newest always stays."""
    return stretches.placed(rows, keys, order, size).withColumn("used", F.col("__used")).where((F.col("used") <= budget) | (F.col("__place") == 1)).drop("__place", "__size", "__used", "__total")
