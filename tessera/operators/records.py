"""Records: prompt lines within a budget, changes between snapshots, boxes, positions, labels, strides, weights and name sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lines and characters of a prompt, characters of a recommendation, changes named in a summary, least area of a box.
PROMPT_LINES, PROMPT_CHARS, ADVICE_CHARS, NAMED_CHANGES, LEAST_AREA = 5, 1200, 120, 4, 0.01
# Limits of the photo labels (motion and clipping above, detail below), and the least score of a good one.
LABEL_LIMITS = {"motion": 0.35, "detail": 3.0, "highlight": 0.08, "shadow": 0.20}
GOOD_SCORE = 3.0
# The label of contents without one, the recommendation's form, and the one without any content.
NO_LABEL, ADVICE, NO_ADVICE = "知识", "综合建议（来源 %s / %s）：%s", "没有找到足够相关知识，建议参考通用修图流程或人工复核。"


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def prompt(found: DataFrame, key: str, label: str, content: str, confidence: str, tie: str) -> DataFrame:
    """(key, prompt): per key the surest contents as lines `[label] content (conf=0.00)`, within a number of lines and characters.

    Contents that agree but for white space and case count once, as the surest (ties by the tie column); empty ones don't count. The
    line that passes the budget is cut and ends in an ellipsis; later ones go. Each step keeps a few rows per key, so nothing but the
    repeats is sorted, and those by key and content. Null confidence is 0; a key without a content has no row.
    """
    rows = found.select(key, tie, squeezed(F.col(label)).alias("__label"), squeezed(F.col(content)).alias("__content"), F.coalesce(F.col(confidence).cast("double"), F.lit(0.0)).alias("__conf"))
    best = F.struct((-F.col("__conf")).alias("c"), F.col(tie).alias("t"), F.col("__label").alias("label"), F.col("__content").alias("content"))
    once = rows.where("__content <> ''").groupBy(key, F.sha2(F.lower("__content"), 256).alias("__same")).agg(F.min(best).alias("__best"))
    top = once.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__best.c", "__best.t"))).where(F.col("__n") <= PROMPT_LINES)
    head = F.when(F.col("__best.label") != "", F.col("__best.label")).otherwise(NO_LABEL)
    line = F.format_string("[%s] %s (conf=%.2f)", head, F.col("__best.content"), -F.col("__best.c"))
    lists = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__n", line.alias("line")))).alias("__lines"))

    def add(text: Column, one: Column) -> Column:
        free = F.lit(PROMPT_CHARS) - F.length(text) - F.when(text == "", 0).otherwise(1)
        whole = F.when(F.length(one["line"]) <= free, one["line"]).otherwise(F.concat(F.rtrim(F.substring(one["line"], F.lit(1), free - 1)), F.lit("…")))
        return F.when(free <= 0, text).otherwise(F.concat(text, F.when(text == "", "").otherwise("\n"), whole))

    return lists.select(key, F.aggregate("__lines", F.lit(""), add).alias("prompt"))


def advice(items: Column) -> Column:
    """One line from the first of sorted (source, ref, content) structs, its content cut; a fixed line without any. Null parts are empty."""
    first = F.try_element_at(items, F.lit(1))
    return F.when(first.isNull(), NO_ADVICE).otherwise(F.format_string(ADVICE, *[F.coalesce(c, F.lit("")) for c in (first["source"], first["ref"], F.substring(first["content"], 1, ADVICE_CHARS))]))


def change_summary(before: Column, after: Column) -> Column:
    """`name: old → new` of the sorted names whose text differs between two maps, the first few, and how many more; null maps are empty."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(before, none), F.coalesce(after, none)
    names = F.array_sort(F.array_union(F.map_keys(old), F.map_keys(new)))
    differing = F.filter(names, lambda k: ~F.try_element_at(old, k).eqNullSafe(F.try_element_at(new, k)))
    shown = F.transform(F.slice(differing, 1, NAMED_CHANGES), lambda k: F.concat(k, F.lit(": "), F.coalesce(F.try_element_at(old, k), F.lit("None")), F.lit(" → "), F.coalesce(F.try_element_at(new, k), F.lit("None"))))
    more = F.size(differing) - NAMED_CHANGES
    return F.concat(F.array_join(shown, ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def main_box(faces: Column, subjects: Column) -> Column:
    """The largest box (l, t, r, b) of the faces, or of the subjects where there is no face; those under a hundredth don't count."""
    boxes = F.when(F.size(F.coalesce(faces, F.array().cast("array<array<double>>"))) > 0, faces).otherwise(subjects)

    def area(b: Column) -> Column:
        return (F.element_at(b, 3) - F.element_at(b, 1)) * (F.element_at(b, 4) - F.element_at(b, 2))

    valid = F.filter(boxes, lambda b: area(b) >= LEAST_AREA)
    return F.aggregate(valid, F.lit(None).cast("array<double>"), lambda best, b: F.when(best.isNull() | (area(b) > area(best)), b).otherwise(best))


def position(latitude: Column, longitude: Column, altitude: Column, below: Column) -> Column:
    """A struct (lat, lon, altitude), six decimals; null unless both angles are known. A height marked below the sea is negative."""
    height = F.when(F.coalesce(F.trim(below), F.lit("")).isin("1", "B", "b"), -F.abs(altitude)).otherwise(altitude)
    return F.when(latitude.isNotNull() & longitude.isNotNull(), F.struct(F.round(latitude, 6).alias("lat"), F.round(longitude, 6).alias("lon"), F.round(height, 6).alias("altitude")))


def photo_label(score: Column, motion: Column, detail: Column, highlight: Column, shadow: Column) -> tuple[Column, Column]:
    """(label, reasons): skip_bad with any reason, else good from the least score on, else mediocre. A null measure gives no reason."""
    checks = (
        (motion > LABEL_LIMITS["motion"], "motion_blur"), (detail < LABEL_LIMITS["detail"], "low_sharpness"),
        (highlight > LABEL_LIMITS["highlight"], "highlight_clip"), (shadow > LABEL_LIMITS["shadow"], "shadow_clip"),
    )
    reasons = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for failed, name in checks]))
    return F.when(F.size(reasons) > 0, "skip_bad").when(score >= GOOD_SCORE, "good").otherwise("mediocre"), reasons


def strided(place: Column, size: Column, cap: int) -> Column:
    """Whether a row (place from 1) is among the evenly strided ones of a group that has more than cap rows; all of a smaller one."""
    return (size <= cap) | ((place - 1) % F.ceil(size / cap) == 0)


def knot_weights(at: Column, knots: Sequence[float]) -> Column:
    """An array of structs (knot from 0, weight): the knots of a piecewise-linear lookup that count at a place, with their shares.

    knots ascend; equal ones stand for the mean of their values, so what falls to such a place is shared evenly among them.
    """
    places: dict[float, list[int]] = {}
    for number, knot in enumerate(map(float, knots)):
        places.setdefault(knot, []).append(number)
    if list(places) != sorted(places):
        raise ValueError("knots must ascend")
    own = list(places.items())

    def of(numbers: list[int], weight: Column) -> list[Column]:
        return [F.struct(F.lit(n).alias("knot"), (weight / len(numbers)).alias("weight")) for n in numbers]

    out = F.when(at <= own[0][0], F.array(*of(own[0][1], F.lit(1.0))))
    for (low, below), (high, above) in zip(own, own[1:], strict=False):
        share = (at - low) / (high - low)
        out = out.when(at < high, F.filter(F.array(*of(below, 1 - share), *of(above, share)), lambda w: w["weight"] > 0))
    return F.when(at.isNotNull(), out.otherwise(F.array(*of(own[-1][1], F.lit(1.0)))))


def marked_kind(message: Column, markers: Sequence[tuple[str, str]], other: str) -> Column:
    """The kind of the first marker that a message contains, in any case."""
    low, out = F.lower(F.coalesce(message, F.lit(""))), F
    for marker, kind in markers:
        out = out.when(F.contains(low, F.lit(marker.lower())), kind)
    return out.otherwise(other)


def same_members(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, whatever their order and number; null arrays are empty."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (a, b))
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
