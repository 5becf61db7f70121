"""Parameter patches: validation against a schema table, review, ordered application, and map merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slot:
    """A parameter's range, or its allowed words."""

    low: float | None = None
    high: float | None = None
    words: tuple[str, ...] = ()


# Parameters that patches may touch, with their ranges.
SLOTS: dict[str, Slot] = {
    "exposure.ev": Slot(-5, 5), "exposure.metering_mode": Slot(words=("auto", "manual")), "tone.brightness": Slot(-2, 2), "tone.shadows": Slot(-1, 1), "tone.highlights": Slot(-1, 1),
    "saturation.amount": Slot(-1, 1), "vibrance.strength": Slot(0, 1), "dehaze.strength": Slot(0, 1), "clarity.strength": Slot(-1, 1), "white_balance.temperature": Slot(2500, 10000), "white_balance.tint": Slot(-150, 150),
}


def reason(patch: Mapping[str, Column], current: Column, locked: Sequence[str] = (), slots: Mapping[str, Slot] = SLOTS) -> Column:
    """The first check a patch (param, op, value, word) fails, null if none: shape, reference, op, word, range (of the value it leads to), locked."""
    param, op, value, word = patch["param"], patch["op"], patch["value"], patch["word"]
    target = F.when(op == "delta", F.coalesce(current, F.lit(0.0)) + value).otherwise(value)
    in_range, good_word, is_word = F.lit(False), F.lit(False), F.lit(False)
    for name, slot in slots.items():
        if slot.words:
            is_word = is_word | (param == name)
            good_word = good_word | ((param == name) & word.isin(*slot.words))
        else:
            in_range = in_range | ((param == name) & target.between(slot.low, slot.high))
    lock = F.lit(False)
    for name in locked:
        lock = lock | (param == name) | param.startswith(name + ".")
    checks = (
        ((param.isNull() | op.isNull() | (value.isNull() & word.isNull())), "shape"), (~param.isin(*slots), "reference"), (~op.isin("set", "delta"), "op"), (is_word & ~F.coalesce(good_word, F.lit(False)), "word"),
        (~is_word & (value.isNull() | F.isnan(value) | ~F.coalesce(in_range, F.lit(False))), "range"), (lock, "locked"),
    )
    return F.coalesce(*[F.when(F.coalesce(failed, F.lit(False)), F.lit(name)) for failed, name in checks])


def review(patches: DataFrame, current: str, locked: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) of rows with columns param, op, value, word and the map of current values."""
    found = reason({c: F.col(c) for c in ("param", "op", "value", "word")}, F.try_element_at(F.col(current), F.col("param")), locked)
    marked = patches.withColumn("reason", found)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def apply(patches: DataFrame, key: str, order: Sequence[str], start: Mapping[str, float] | None = None) -> DataFrame:
    """(key, param, value) after an ordered fold of each key's patches, clamped at every step."""
    edits = patches.groupBy(key, "param").agg(F.array_sort(F.collect_list(F.struct(*order, "op", "value"))).alias("edits"))
    low = F.coalesce(*[F.when(F.col("param") == n, float(s.low)) for n, s in SLOTS.items() if s.low is not None])
    high = F.coalesce(*[F.when(F.col("param") == n, float(s.high)) for n, s in SLOTS.items() if s.high is not None])
    begin = F.coalesce(*[F.when(F.col("param") == n, float(v)) for n, v in (start or {}).items()], F.lit(0.0))

    def step(state: Column, edit: Column) -> Column:
        value = F.when(edit["op"] == "set", edit["value"]).otherwise(state + edit["value"])
        return F.when(edit["value"].isNotNull() & ~F.isnan(edit["value"]), F.greatest(low, F.least(high, value))).otherwise(state)

    return edits.select(key, "param", F.aggregate("edits", begin, step).alias("value"))


def merge(base: Column, update: Column) -> Column:
    """Right-biased merge of two maps."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(base, lambda k, v: ~F.map_contains_key(update, k))), F.map_entries(update)))


def merge_deep(base: Column, update: Column) -> Column:
    """Right-biased merge of two maps of maps."""
    return F.map_zip_with(base, update, lambda k, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merge(a, b)))


def without(params: Column, names: Sequence[str]) -> Column:
    return F.map_filter(params, lambda k, v: ~k.isin(*names))
