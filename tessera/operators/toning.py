"""Tone keys, control-point curves, hue bands, chroma limits and highlight desaturation: column expressions over a pixel's channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import color
from tessera.operators.corpus import interpolate
from tessera.operators.kernels import clip, smoothstep

# Weights of linear luminance.
LUMINANCE = (0.2126, 0.7152, 0.0722)
# Per tone key the band (rises from, full from, falls over) of luminance, and the gain of a full key.
TONE_KEYS = {"highlights": (0.55, 0.78, 0.28), "shadows": (0.00, 0.14, 0.36), "whites": (0.75, 0.90, 0.16), "blacks": (0.00, 0.08, 0.20)}
TONE_GAIN = 0.7
# Chroma under which a colour counts as neutral, saturation of full and of no treatment, luma of desaturation.
NEUTRAL_CHROMA, PROTECT_FROM, PROTECT_TO, DESATURATE_FROM, DESATURATE_OVER = 0.02, 0.08, 0.32, 0.55, 0.30


def band(x: Column, low: float, full: float, fall: float) -> Column:
    """A smooth weight: 0 up to low, 1 at full, 0 again from full + fall on; where low is 0 it rises from black."""
    return smoothstep((x - low) / (full - low)) * (1 - smoothstep((x - full) / fall))


def tone_keys(rgb: Sequence[Column], keys: dict[str, Column]) -> list[Column]:
    """Linear channels after the tone keys (-1 to 1 each, in the order of TONE_KEYS): up mixes with white, down scales.

    The weight comes from the pixel's first luminance, one for all channels, so that grey stays grey; black and white stay.
    """
    light = color.dot(LUMINANCE, list(rgb))
    out = list(rgb)
    for name, limits in TONE_KEYS.items():
        if name in keys:
            share = clip(F.abs(keys[name]) * TONE_GAIN * band(light, *limits), 0.0, 1.0)
            out = [c * (1 - share) + F.when(keys[name] > 0, share).otherwise(0.0) for c in out]
    return out


def bound(value: Column, then) -> Column:
    """then(value) with the value computed once, however often it stands there."""
    return F.element_at(F.transform(F.array(value), then), 1)


def curves(rgb: Sequence[Column], whole: Sequence[tuple[float, float]], channels: Sequence[Sequence[tuple[float, float]] | None], luma: Sequence[tuple[float, float]] | None) -> Column:
    """An array of the channels after control-point curves: the common one, each channel's own, then one of the luma that scales
    all channels alike, clipped to 0..1 (only where there is one)."""

    def through(c: Column, points: Sequence[tuple[float, float]] | None) -> Column:
        return bound(c, lambda v: interpolate(v, points)) if points else c

    out = F.array(*[through(through(c, whole), points) for c, points in zip(rgb, channels, strict=True)])
    if not luma:
        return out

    def scaled(done: Column) -> Column:
        light = color.dot(LUMINANCE, [F.element_at(done, k) for k in (1, 2, 3)])
        scale = bound(light, lambda v: interpolate(v, luma) / F.greatest(v, F.lit(1e-9)))
        return bound(scale, lambda k: F.transform(done, lambda c: clip(c * k, 0.0, 1.0)))

    return bound(out, scaled)


def folded(start: dict[str, Column], bands: Sequence[tuple[float, float, float, float, float]], smooth: float, step) -> Column:
    """A struct of the start values after step(state, weight, band) for band after band, as one aggregate over an array of bands.

    The weight of a band is 1 within half its width of the centre and falls by a raised cosine over smooth times that.
    """
    names = ("centre", "width", "shift", "saturation", "luminance")
    rows = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, one, strict=True)]) for one in bands])

    def merged(state: Column, one: Column) -> Column:
        half, gap = one["width"] / 2, F.abs(F.pmod(state["h"] - one["centre"] + 180, F.lit(360.0)) - 180)
        beyond = (gap - half) / F.greatest(half * smooth, F.lit(1e-6))
        weight = F.when(beyond <= 0, 1.0).when(beyond >= 1, 0.0).otherwise(0.5 * (1 + F.cos(beyond * F.pi())))
        return bound(weight, lambda w: step(state, w, one))

    return F.aggregate(rows, F.struct(*[c.cast("double").alias(n) for n, c in start.items()]), merged)


def hue_bands(rgb: Sequence[Column], bands: Sequence[tuple[float, float, float, float, float]], smooth: float = 1.0) -> Column:
    """A struct (h, s, v, guard) after HSV bands (centre, width, hue shift, saturation %, luminance %), one after the other.

    Hue and luminance change by the guard, the first saturation, so that greys don't.
    """
    h, s, v = color.rgb_to_hsv(*rgb)

    def step(state: Column, w: Column, one: Column) -> Column:
        guarded = w * state["guard"]
        return F.struct(
            F.pmod(state["h"] + one["shift"] * guarded, F.lit(360.0)).alias("h"), clip(state["s"] * (1 + one["saturation"] / 100 * w), 0.0, 1.0).alias("s"),
            F.greatest(F.lit(0.0), state["v"] * (1 + one["luminance"] / 100 * guarded)).alias("v"), state["guard"].alias("guard"),
        )

    return folded({"h": h, "s": s, "v": v, "guard": clip(s, 0.0, 1.0)}, bands, smooth, step)


def limited_chroma(boosted: Column, chroma: Column, most: Column) -> Column:
    """A raised chroma bent by tanh towards the most there is room for; one that isn't raised, or has no room, stays."""
    room = most - chroma
    return F.when((boosted > chroma) & (room > 1e-9), chroma + room * F.tanh((boosted - chroma) / F.when(room > 1e-9, room).otherwise(1.0))).otherwise(boosted)


def chroma_bands(lch: Sequence[Column], bands: Sequence[tuple[float, float, float, float, float]], envelope: Sequence[tuple[float, float]], smooth: float = 1.0) -> Column:
    """A struct (l, c, h, guard) after bands as in hue_bands; raised chroma is limited by the envelope of chroma over lightness."""
    lightness, chroma, hue = lch

    def step(state: Column, w: Column, one: Column) -> Column:
        guarded = w * state["guard"]
        raised = limited_chroma(state["c"] * (1 + one["saturation"] / 100 * guarded), state["c"], interpolate(state["l"], envelope))
        return F.struct(
            clip(state["l"] * (1 + one["luminance"] / 100 * guarded), 0.0, 1.0).alias("l"), raised.alias("c"), F.pmod(state["h"] + one["shift"] * guarded, F.lit(360.0)).alias("h"), state["guard"].alias("guard"),
        )

    return folded({"l": lightness, "c": chroma, "h": hue, "guard": smoothstep(chroma / NEUTRAL_CHROMA)}, bands, smooth, step)


def saturation_guard(rgb: Sequence[Column]) -> Column:
    """0 for near-neutral colours, 1 for saturated ones, smooth between."""
    top, low = F.greatest(*rgb), F.least(*rgb)
    return smoothstep((F.when(top > 0, (top - low) / top).otherwise(0.0) - PROTECT_FROM) / (PROTECT_TO - PROTECT_FROM))


def desaturated_highlights(rgb: Sequence[Column], strength: float) -> list[Column]:
    """Bright near-neutral colours drawn towards their luma; saturated ones stay."""
    light = color.dot(LUMINANCE, list(rgb))
    weight = smoothstep((light - DESATURATE_FROM) / DESATURATE_OVER) * (1 - saturation_guard(rgb)) * strength
    return [c * (1 - weight) + light * weight for c in rgb]
