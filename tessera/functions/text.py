"""String, number-parsing and JSON expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def sentences(text: Column) -> Column:
    """Parts between Chinese and English marks and line ends, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "[，,;；。.!！\n]"), lambda x: F.trim(x)), lambda x: x != "")


def degree(segment: Column, words: Sequence[tuple[str, float]], cap: float = 3.0) -> Column:
    """The product of the multipliers of all words that a segment contains, cut at the cap."""
    out = F.lit(1.0)
    for word, factor in words:
        out = out * F.when(segment.contains(word), float(factor)).otherwise(1.0)
    return F.least(F.lit(cap), out)


def first_rule(segment: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The name of the first regular expression that a segment matches, null if none."""
    return F.coalesce(*[F.when(segment.rlike(pattern), F.lit(name)) for pattern, name in rules])


def parse_condition(key: Column) -> Column:
    """`if_<metric>_<op>_<number>` as a struct (metric, op, value); null where it has another form."""
    form = r"^if_(.+)_(gt|ge|lt|le|eq)_(-?[0-9]+(?:\.[0-9]+)?)$"
    parts = [F.regexp_extract(key, form, i) for i in (1, 2, 3)]
    return F.when(key.rlike(form), F.struct(parts[0].alias("metric"), parts[1].alias("op"), parts[2].try_cast("double").alias("value")))


def parse_action(key: Column) -> Column:
    """`<param>_<number>` as (param, value); without a number the value is 1."""
    form = r"^(.+)_(-?[0-9]+(?:\.[0-9]+)?)$"
    return F.when(key.rlike(form), F.struct(F.regexp_extract(key, form, 1).alias("param"), F.regexp_extract(key, form, 2).try_cast("double").alias("value"))).otherwise(F.struct(key.alias("param"), F.lit(1.0).alias("value")))


def ratio(text: Column) -> Column:
    """`a/b` divided (a zero denominator keeps a), `f/2.8` as 2.8, plain numbers as they are; null for anything else."""
    bare = F.regexp_replace(F.trim(text), "^[fF]/", "")
    parts = F.split(bare, "/")
    top, bottom = parts[0].try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    return F.when(F.size(parts) == 2, F.when(bottom == 0, top).otherwise(top / bottom)).when(F.size(parts) == 1, top)


def aspect(text: Column) -> Column:
    """`w:h` or a number as a ratio; null unless positive."""
    parts = F.split(text, ":")
    value = F.when(F.size(parts) == 2, F.try_divide(parts[0].try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double"))).otherwise(text.try_cast("double"))
    return F.when(value > 0, value)


def shutter(seconds: Column) -> Column:
    """`1/n` where that is within two per cent, else the number of seconds."""
    n = F.round(1 / seconds)
    return F.when(seconds > 0, F.when((seconds < 1) & (F.abs(1 / n - seconds) <= 0.02 * seconds), F.concat(F.lit("1/"), n.cast("long").cast("string"))).otherwise(F.round(seconds, 4).cast("string")))


def flash(tag: Column) -> Column:
    """on, off or unknown by the bits of the tag: 0x20 says there is no flash, 0x01 that it fired."""
    code = tag.try_cast("int")
    return F.when(code.isNull(), "unknown").when(code.bitwiseAND(F.lit(0x20)) != 0, "off").when(code.bitwiseAND(F.lit(0x01)) != 0, "on").otherwise("off")


def degrees(parts: Column) -> Column:
    """Degrees, minutes and seconds (one to three numbers) as degrees."""
    return parts[0] + F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(0.0)) / 60 + F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit(0.0)) / 3600


def signed(value: Column, reference: Column) -> Column:
    return F.when(F.upper(reference).isin("S", "W"), -value).otherwise(value)


def slug(text: Column) -> Column:
    """Lower case, every run of other characters than letters and digits one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def truncated(text: Column, limit: int) -> Column:
    return F.struct(F.substring(text, 1, limit).alias("text"), (F.length(text) > limit).alias("cut"))


def fingerprint(*values: Column) -> Column:
    """SHA-256 of values joined by a separator, nulls empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(v.cast("string"), F.lit("")) for v in values]), 256)


def is_subsequence(small: Column, big: Column) -> Column:
    """Whether an array's elements occur in another in order."""
    return F.aggregate(big, F.lit(0), lambda at, x: F.when((at < F.size(small)) & (F.try_element_at(small, at + 1) == x), at + 1).otherwise(at)) == F.size(small)


def fold_edits(edits: Column, start: Column, low: float, high: float) -> Column:
    """An ordered fold of (op, value) edits: set replaces, delta adds, every step clamped; edits without a finite value are left out."""

    def step(state: Column, edit: Column) -> Column:
        value = F.when(edit["op"] == "set", edit["value"]).otherwise(state + edit["value"])
        good = edit["value"].isNotNull() & ~F.isnan(edit["value"])
        return F.when(good, F.greatest(F.lit(low), F.least(F.lit(high), value))).otherwise(state)

    return F.aggregate(edits, start.cast("double"), step)


def looks_like_path(text: Column) -> Column:
    return text.rlike(r"^(/|~|\.{1,2}/|[A-Za-z]:[\\/])|\.\./")
