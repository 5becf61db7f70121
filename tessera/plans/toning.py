"""Queries of tone keys, curves, hue and chroma bands and highlight desaturation, over the colours of embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import color
from tessera.operators import toning
from tessera.plans.measure import _OK, RGB_SQL, rgb_pixels

KEYS = {"highlights": -0.6, "shadows": 0.5, "whites": 0.4, "blacks": -0.8}
WHOLE = ((0.0, 0.05), (0.3, 0.25), (0.7, 0.8), (1.0, 0.98))
RED = ((0.0, 0.0), (0.5, 0.6), (1.0, 1.0))
LUMA = ((0.0, 0.0), (0.4, 0.5), (1.0, 0.9))
BANDS = ((29.0, 45.0, 10.0, 40.0, -10.0), (140.0, 60.0, -15.0, -30.0, 20.0), (250.0, 50.0, 5.0, 80.0, 5.0))
ENVELOPE = ((0.0, 0.0), (0.45, 0.3), (0.7, 0.32), (1.0, 0.0))


def _rgb():
    return [F.col(c) for c in "rgb"]


def _means(rows: DataFrame, digits: int = 6) -> DataFrame:
    return rows.groupBy("vec_id").agg(*[F.round(F.avg(c), digits).alias(c) for c in rows.columns if c != "vec_id"])


def tone_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean channels per image after four tone keys."""
    found = toning.tone_keys(_rgb(), {k: F.lit(v) for k, v in KEYS.items()})
    return _means(rgb_pixels(spark, sf_dir).select("vec_id", *[c.alias(n) for n, c in zip("rgb", found, strict=True)]))


def point_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean channels per image after a common curve, one of red and one of luma."""
    found = rgb_pixels(spark, sf_dir).select("vec_id", toning.curves(_rgb(), WHOLE, (RED, None, None), LUMA).alias("t"))
    return _means(found.select("vec_id", *[F.element_at("t", k).alias(n) for k, n in enumerate("rgb", 1)]))


def hue_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hue, saturation and value of every colour after three bands."""
    found = rgb_pixels(spark, sf_dir).select("vec_id", "n", toning.hue_bands(_rgb(), BANDS, 0.8).alias("t"))
    return found.select("vec_id", "n", *[F.round(F.col(f"t.{c}"), 5).alias(c) for c in "hsv"])


def chroma_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lightness and chroma per image after three bands with limited chroma."""
    lightness, a, b = color.srgb_to_oklab(*_rgb())
    lch = rgb_pixels(spark, sf_dir).select("vec_id", lightness.alias("l"), *[c.alias(n) for n, c in zip(("c", "h"), color.polar(a, b), strict=True)])
    found = lch.select("vec_id", toning.chroma_bands([F.col(c) for c in "lch"], BANDS, ENVELOPE).alias("t"))
    return _means(found.select("vec_id", "t.l", "t.c"), 5)


def desaturated_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean channels per image with bright neutral colours drawn to their luma, and the mean guard of saturated ones."""
    found = toning.desaturated_highlights(_rgb(), 0.8)
    return _means(rgb_pixels(spark, sf_dir).select("vec_id", *[c.alias(n) for n, c in zip("rgb", found, strict=True)], toning.saturation_guard(_rgb()).alias("guard")))


QUERIES = {f.__name__: f for f in (tone_keys, point_curves, hue_bands, chroma_bands, desaturated_highlights)}

_LIGHT = "(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)"


def _step(x: str) -> str:
    """Smoothstep of x, clipped to 0..1."""
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"
    return f"({t} * {t} * (3 - 2 * {t}))"


def _line(x: str, points) -> str:
    """Piecewise-linear lookup with constant ends."""
    cases = "".join(f" WHEN {x} <= {x1} THEN {y0} + ({x} - {x0}) * ({(y1 - y0) / (x1 - x0)!r}::DOUBLE)" for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False))
    return f"(CASE WHEN {x} <= {points[0][0]} THEN {points[0][1]}::DOUBLE{cases} ELSE {points[-1][1]}::DOUBLE END)"


def _keyed() -> str:
    """The tone keys, one after the other, by the first luminance."""
    ctes, source = [f"k0 AS (SELECT vec_id, r, g, b, {_LIGHT} AS y FROM rgb)"], "k0"
    for i, (name, (low, full, fall)) in enumerate(toning.TONE_KEYS.items(), 1):
        share = f"least(1.0, {abs(KEYS[name]) * toning.TONE_GAIN!r}::DOUBLE * {_step(f'(y - {low}) / ({full} - {low})')} * {_step(f'({full} + {fall} - y) / {fall}')})"
        up = 1 if KEYS[name] > 0 else 0
        ctes += [f"d{i} AS (SELECT *, {share} AS d FROM {source})", f"k{i} AS (SELECT vec_id, y, " + ", ".join(f"{c} * (1 - d) + {up} * d AS {c}" for c in "rgb") + f" FROM d{i})"]
        source = f"k{i}"
    return ", ".join(ctes)


def _banded(source: str, smooth: float, update) -> str:
    """The bands as a chain of steps: gap to the centre, weight, update."""
    ctes = []
    for i, (centre, width, shift, saturation, luminance) in enumerate(BANDS):
        edge = width / 2 * smooth
        ctes.append(f"g{i} AS (SELECT *, abs(((h - {centre} + 180 + 720) % 360) - 180) AS gap FROM {source})")
        ctes.append(f"w{i} AS (SELECT *, CASE WHEN gap <= {width / 2} THEN 1.0::DOUBLE WHEN gap >= {width / 2 + edge} THEN 0.0::DOUBLE ELSE 0.5 * (1 + cos((gap - {width / 2}) / {edge} * pi())) END AS w FROM g{i})")
        ctes += update(i, shift, saturation / 100, luminance / 100)
        source = f"b{i}"
    return ", ".join(ctes)


def _hsv_update(i: int, shift: float, saturation: float, luminance: float) -> list[str]:
    return [f"b{i} AS (SELECT vec_id, n, (h + {shift} * w * guard + 360) % 360 AS h, greatest(0.0, least(1.0, s * (1 + {saturation} * w))) AS s, greatest(0.0, v * (1 + {luminance} * w * guard)) AS v, guard FROM w{i})"]


def _lch_update(i: int, shift: float, saturation: float, luminance: float) -> list[str]:
    return [
        f"e{i} AS (SELECT *, c * (1 + {saturation} * w * guard) AS up, {_line('l', ENVELOPE)} - c AS room FROM w{i})",
        f"b{i} AS (SELECT vec_id, greatest(0.0, least(1.0, l * (1 + {luminance} * w * guard))) AS l, CASE WHEN up > c AND room > 1e-9 THEN c + room * tanh((up - c) / room) ELSE up END AS c, (h + {shift} * w * guard + 360) % 360 AS h, guard FROM e{i})",
    ]


_MEAN = "round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b"
_HSV = "m AS (SELECT *, greatest(r, g, b) AS t, least(r, g, b) AS lo FROM rgb), p AS (SELECT vec_id, n, CASE WHEN t - lo <= 0 THEN 0.0::DOUBLE WHEN t = r THEN (60 * (g - b) / (t - lo) + 360) % 360 WHEN t = g THEN 60 * (b - r) / (t - lo) + 120 ELSE 60 * (r - g) / (t - lo) + 240 END AS h, CASE WHEN t <= 0 THEN 0.0::DOUBLE ELSE (t - lo) / t END AS s, t AS v FROM m), b_ AS (SELECT *, s AS guard FROM p)"

ORACLES = {
    "tone_keys": f"WITH {RGB_SQL}, {_keyed()} SELECT vec_id, {_MEAN} FROM k{len(KEYS)} GROUP BY vec_id",
    "point_curves": f"""
        WITH {RGB_SQL}, a AS (SELECT vec_id, {_line("r", WHOLE)} AS r, {_line("g", WHOLE)} AS g, {_line("b", WHOLE)} AS b FROM rgb), c AS (SELECT vec_id, {_line("r", RED)} AS r, g, b FROM a),
        y AS (SELECT *, {_LIGHT} AS y FROM c), k AS (SELECT *, {_line("y", LUMA)} / greatest(y, 1e-9) AS k FROM y), z AS (SELECT vec_id, {", ".join(f"greatest(0.0, least(1.0, {c} * k)) AS {c}" for c in "rgb")} FROM k)
        SELECT vec_id, {_MEAN} FROM z GROUP BY vec_id""",
    "hue_bands": f"WITH {RGB_SQL}, {_HSV}, {_banded('b_', 0.8, _hsv_update)} SELECT vec_id, n, round(h, 5) AS h, round(s, 5) AS s, round(v, 5) AS v FROM b{len(BANDS) - 1}",
    "chroma_bands": f"WITH {_OK}, b_ AS (SELECT vec_id, ok_l AS l, chroma AS c, hue AS h, {_step(f'chroma / {toning.NEUTRAL_CHROMA}')} AS guard FROM lch), {_banded('b_', 1.0, _lch_update)} SELECT vec_id, round(avg(l), 5) AS l, round(avg(c), 5) AS c FROM b{len(BANDS) - 1} GROUP BY vec_id",
    "desaturated_highlights": f"""
        WITH {RGB_SQL}, y AS (SELECT *, {_LIGHT} AS y, CASE WHEN greatest(r, g, b) > 0 THEN 1 - least(r, g, b) / greatest(r, g, b) ELSE 0.0 END AS s FROM rgb),
        q AS (SELECT *, {_step("(s - 0.08) / 0.24")} AS guard, {_step("(y - 0.55) / 0.30")} AS bright FROM y), w AS (SELECT *, bright * (1 - guard) * 0.8 AS w FROM q),
        z AS (SELECT vec_id, guard, {", ".join(f"{c} * (1 - w) + y * w AS {c}" for c in "rgb")} FROM w) SELECT vec_id, {_MEAN}, round(avg(guard), 6) AS guard FROM z GROUP BY vec_id""",
}
