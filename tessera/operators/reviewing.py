"""Judgement of measurements, the review queue, nested metrics by name, and text forms of values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cut-offs of the two-tier judgement and of the issue codes.
CLIP_ISSUE, CLIP_NOTE, SHADOW_ISSUE, LOW_CONTRAST = 0.03, 0.01, 0.08, 0.2
FACE_DARK, FACE_BRIGHT, IMAGE_DARK, IMAGE_BRIGHT = 85.0, 160.0, 75.0, 170.0
CODE_FACE_DARK = 75.0
STRONG_MOTION, DENSE_HAZE = 0.8, 0.45


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def judge(mean: Column, face: Column, highlight: Column, shadow: Column, contrast: Column, motion: Column, haze: Column) -> tuple[Column, Column]:
    """(issues, notes) as arrays of codes; face is null unless reliable, and then stands for the whole image's mean."""
    hot, dark = _zero(highlight), _zero(shadow)
    level = F.when(face.isNotNull(), F.when(face < FACE_DARK, "face_dark").when(face > FACE_BRIGHT, "face_bright")).when(mean < IMAGE_DARK, "image_dark").when(mean > IMAGE_BRIGHT, "image_bright")
    fine = F.when(level.isNull(), F.when(face.isNotNull(), "face_fine").when(mean.isNotNull(), "image_fine"))
    issues = F.array(F.when(hot > CLIP_ISSUE, "highlight"), F.when(dark > CLIP_ISSUE, "shadow"), level, F.when(_zero(contrast) < LOW_CONTRAST, "low_contrast"))
    notes = F.array(F.when((hot <= CLIP_ISSUE) & (hot > CLIP_NOTE), "highlight_near"), F.when((dark <= CLIP_ISSUE) & (dark > CLIP_NOTE), "shadow_near"), fine, F.when(motion > STRONG_MOTION, "motion"), F.when(haze > DENSE_HAZE, "haze"))
    return F.array_compact(issues), F.array_compact(notes)


def issue_codes(mean: Column, face: Column, highlight: Column, shadow: Column, contrast: Column) -> Column:
    """The issue codes of a scan, in order."""
    level = F.when(face.isNotNull(), F.when(face < CODE_FACE_DARK, "face_dark").when(face > FACE_BRIGHT, "face_bright")).when(mean < IMAGE_DARK, "image_dark").when(mean > IMAGE_BRIGHT, "image_bright")
    return F.array_compact(F.array(F.when(_zero(highlight) > CLIP_ISSUE, "highlight"), F.when(_zero(shadow) > SHADOW_ISSUE, "shadow"), level, F.when(_zero(contrast) < LOW_CONTRAST, "low_contrast")))


def exposure_step(issues: Column, mean: Column, face: Column, highlight: Column) -> Column:
    """The exposure correction of the first issue that has one; dark images get one in proportion, within bounds."""
    hot = _zero(highlight)

    def has(code: str) -> Column:
        return F.array_contains(issues, code)

    return (
        F.when(has("highlight"), F.when(hot > 0.08, -0.35).when(hot > 0.05, -0.30).otherwise(-0.20))
        .when(has("face_bright") | _true(face > FACE_BRIGHT), -0.25)
        .when(has("face_dark") | _true(face < FACE_DARK), 0.25)
        .when(has("image_bright"), -0.25)
        .when(has("image_dark"), F.greatest(F.lit(0.15), F.least(F.lit(0.45), (78 - _zero(mean)) / 22)))
        .when(has("shadow"), 0.15)
        .otherwise(0.0)
    )


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def review_queue(log: DataFrame, key: str, order: Sequence[str], action: str) -> DataFrame:
    """log with status and outcome: a key's item is pending from its enqueue on (a later one overwrites it), and the first accept,
    reject or edit after that decides; other actions, and any before the first enqueue, are errors and change nothing.

    status is the item's after the row (null while there is none); outcome is ok, overwritten or error. Other actions than these
    four change nothing and are ok. A window per key and item, no state beyond it.
    """
    w = Window.partitionBy(key).orderBy(*order)
    added = F.col(action) == "enqueue"
    verdict = F.when(F.col(action) == "accept", "accepted").when(F.col(action) == "reject", "rejected").when(F.col(action) == "edit", "edited")
    items = log.withColumn("__item", F.count_if(added).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__verdict", verdict)
    own = Window.partitionBy(key, "__item").orderBy(*order)
    decided = F.first("__verdict", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    earlier = F.count("__verdict").over(own.rowsBetween(Window.unboundedPreceding, -1))
    status = F.when(F.col("__item") > 0, F.coalesce(decided, F.lit("pending")))
    outcome = F.when(added, F.when(F.col("__item") > 1, "overwritten").otherwise("ok")).when(F.col("__verdict").isNotNull() & ((F.col("__item") == 0) | (earlier > 0)), "error").otherwise("ok")
    return items.withColumn("status", status).withColumn("outcome", outcome).drop("__item", "__verdict")


def flatten(groups: Mapping[str, Mapping[str, Column]]) -> Column:
    """A map of dotted names to values from nested groups; null values are left out."""
    entries = [F.struct(F.lit(f"{g}.{n}" if g else n).alias("key"), v.cast("double").alias("value")) for g, values in groups.items() for n, v in values.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def metric(metrics: Column, name: str) -> Column:
    """A metric by name: as it is, else without leading `metrics.`, else in the nested group `metrics`; null if there is none."""
    plain = name
    while plain.startswith("metrics."):
        plain = plain.removeprefix("metrics.")
    return F.coalesce(*[F.try_element_at(metrics, F.lit(n)) for n in dict.fromkeys([name, plain, f"metrics.{plain}"])])


def compact(number: Column, places: int = 4) -> Column:
    """A number with at most so many decimals, without trailing zeros or point."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", number), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def changed(name: str, before: Column, after: Column) -> Column:
    """`name: before → after` where a value changes, else null."""
    return F.when(~before.eqNullSafe(after), F.concat(F.lit(f"{name}: "), F.coalesce(compact(before), F.lit("-")), F.lit(" → "), F.coalesce(compact(after), F.lit("-"))))


def normal_space(text: Column) -> Column:
    """White space runs as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def labelled(code: Column, labels: Mapping[int, str]) -> Column:
    """The label of a code, or the code itself as text."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code.cast("int")), code.cast("string"))


def promoted(gain: Column, current: Column, least: float, share: float) -> Column:
    """Whether a gain is worth keeping: at least `least` and the share of the present value."""
    return F.coalesce(gain >= F.greatest(F.lit(least), share * F.abs(current)), F.lit(False))
