"""Colour adaptation, tone and lookup kernels, crop rectangles: column expressions over a row's numbers and arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published Bradford cone response matrix and its inverse.
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
BRADFORD_INVERSE = ((0.9869929, -0.1470543, 0.1599627), (0.4323053, 0.5183603, 0.0492912), (-0.0085287, 0.0400428, 0.9684867))
# Colour temperatures of the numbered light sources of the EXIF standard.
LIGHT_SOURCES = {
    1: 5500, 2: 4150, 3: 2850, 4: 5500, 9: 5500, 10: 6500, 11: 7500, 12: 6400, 13: 5050, 14: 4150, 15: 3525, 16: 2925, 17: 2850, 18: 5500, 19: 6500, 20: 5500, 21: 6500, 22: 7500, 23: 5000, 24: 3200,
}


def clip(value: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(F.greatest(value, low), high)


def times(matrix: Sequence[Sequence[float]], vector: Sequence[Column]) -> list[Column]:
    """A constant 3x3 matrix times a vector of columns."""
    return [sum((F.lit(m) * v for m, v in zip(row[1:], vector[1:], strict=True)), F.lit(row[0]) * vector[0]) for row in matrix]


def xy_to_xyz(x: Column, y: Column) -> list[Column]:
    """A chromaticity as XYZ of luminance 1."""
    return [x / y, F.lit(1.0), (1 - x - y) / y]


def bradford(xyz: Sequence[Column], source: Sequence[Column], target: Sequence[Column]) -> list[Column]:
    """XYZ seen under the source white as it is under the target white; a white without cone response scales by one."""
    cones = times(BRADFORD, xyz)
    whites = zip(times(BRADFORD, source), times(BRADFORD, target), strict=True)
    scaled = [c * F.when(s > 0, F.greatest(t, F.lit(0.0)) / s).otherwise(1.0) for c, (s, t) in zip(cones, whites, strict=True)]
    return times(BRADFORD_INVERSE, scaled)


def light_source_kelvin(code: Column) -> Column:
    """The colour temperature of a numbered light source, 0 for unknown ones."""
    known = F.create_map(*[F.lit(x) for pair in LIGHT_SOURCES.items() for x in (pair[0], float(pair[1]))])
    return F.coalesce(F.try_element_at(known, code.cast("int")), F.lit(0.0))


def reciprocal_blend(kelvin: Column, first: Column, second: Column) -> Column:
    """The share (0 to 1) of the second illuminant by reciprocal temperature; 0 where a temperature isn't positive or both agree."""
    share = (1 / kelvin - 1 / first) / (1 / second - 1 / first)
    return F.when((kelvin > 0) & (first > 0) & (second > 0) & (first != second), clip(share, 0.0, 1.0)).otherwise(0.0)


def lerp(a: Column, b: Column, share: Column) -> Column:
    """Arrays blended by element, over their common length; one missing side gives the other."""
    size = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(a, F.lit(1), size), F.slice(b, F.lit(1), size), lambda x, y: x * (1 - share) + y * share)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def bucket_curve(kelvin: Column, buckets: Sequence[tuple[float, Sequence[float]]]) -> Column:
    """The curve between the two buckets that bracket a temperature; beyond the ends the outermost curve."""
    buckets = sorted(buckets)
    curves = [F.array(*[F.lit(float(v)) for v in values]) for _, values in buckets]
    if len(buckets) == 1:
        return curves[0]
    out = F.when(kelvin <= buckets[0][0], curves[0])
    for (low, _), (high, _), a, b in zip(buckets, buckets[1:], curves, curves[1:], strict=False):
        out = out.when(kelvin < high, lerp(a, b, (kelvin - low) / (high - low)))
    return out.otherwise(curves[-1])


def kelvin_gains(kelvin: Column) -> list[Column]:
    """Red, green and blue gains of a temperature (1000 to 40 000 K), green 1, by the published piecewise fit of black-body colours."""
    t = clip(kelvin, 1000.0, 40000.0) / 100
    warm = t - 60
    red = F.when(t <= 66, 255.0).otherwise(329.698727446 * F.pow(F.when(warm > 0, warm), F.lit(-0.1332047592)))
    green = F.when(t <= 66, 99.4708025861 * F.ln(t) - 161.1195681661).otherwise(288.1221695283 * F.pow(F.when(warm > 0, warm), F.lit(-0.0755148492)))
    blue = F.when(t >= 66, 255.0).when(t <= 19, 0.0).otherwise(138.5177312231 * F.ln(F.when(t > 10, t - 10)) - 305.0447927307)
    r, g, b = (clip(c, 0.0, 255.0) / 255 for c in (red, green, blue))
    g = F.greatest(g, F.lit(1e-6))
    return [r / g, F.lit(1.0), b / g]


def smoothstep(x: Column) -> Column:
    x = clip(x, 0.0, 1.0)
    return x * x * (3 - 2 * x)


def filmic(x: Column, contrast: Column, toe: Column, shoulder: Column) -> Column:
    """The parametric tone curve at x in 0..1: power, soft shoulder, contrast about the middle, lifted toe; its ends are 0 and 1."""
    y = F.pow(x, F.lit(1 / 2.2))
    y = F.when(shoulder > 0, y * (1 - smoothstep((x - shoulder) / 0.25) * 0.15)).otherwise(y)
    k = 1 + 6 * contrast

    def logistic(v: Column) -> Column:
        return 1 / (1 + F.exp(-k * (v - 0.5) * 2))

    low, high = logistic(F.lit(0.0)), logistic(F.lit(1.0))
    bent = y * (1 - contrast * 0.5) + (logistic(x) - low) / (high - low) * contrast * 0.5
    top = F.when(shoulder > 0, 1 - smoothstep((1 - shoulder) / 0.25) * 0.15).otherwise(1.0) * (1 - contrast * 0.5) + contrast * 0.5
    y = F.when(contrast > 0, bent / top).otherwise(y)
    lift = toe * 0.08
    y = F.when(toe > 0, (y + lift) / (1 + lift)).otherwise(y)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(clip(y, 0.0, 1.0))


def nearest_entry(x: Column, table: Column) -> Column:
    """The entry of a table over 0..1 nearest to x."""
    return F.element_at(table, (clip(x, 0.0, 1.0) * (F.size(table) - 1) + 0.5).cast("int") + 1)


def inverse(y: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The x at which the piecewise-linear curve through knots with rising y reaches y; the ends beyond them."""
    out = F.when(y <= knots[0][1], F.lit(knots[0][0]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out = out.when(y <= y1, x0 + (y - y0) * ((x1 - x0) / (y1 - y0)))
    return out.otherwise(F.lit(knots[-1][0]))


def tetrahedral(table: Column, size: int, position: Sequence[Column]) -> Column:
    """A cube table (size**3 entries, the last axis fastest) at a position in 0..1 per axis, from the four corners of a tetrahedron."""
    scaled = [clip(p, 0.0, 1.0) * (size - 1) for p in position]
    base = [F.least(F.floor(s), F.lit(size - 2)).cast("int") for s in scaled]
    parts = [s - b for s, b in zip(scaled, base, strict=True)]
    steps = (size * size, size, 1)
    at = sum((b * F.lit(n) for b, n in zip(base[1:], steps[1:], strict=True)), base[0] * F.lit(steps[0])) + 1
    order = F.sort_array(F.array(*[F.struct(p.alias("part"), F.lit(-k).alias("axis"), F.lit(n).alias("step")) for k, (p, n) in enumerate(zip(parts, steps, strict=True))]), asc=False)
    first, second, third = (F.element_at(order, k) for k in (1, 2, 3))
    corners = [at, at + first["step"], at + first["step"] + second["step"], at + sum(steps)]
    weights = [1 - first["part"], first["part"] - second["part"], second["part"] - third["part"], third["part"]]
    return sum((F.element_at(table, c.cast("int")) * w for c, w in zip(corners[1:], weights[1:], strict=True)), F.element_at(table, at.cast("int")) * weights[0])


def wrapped_linear(table: Column, size: int, angle: Column) -> Column:
    """A table round the circle (size entries from 0 degrees on) at an angle, linear between entries, the last next to the first."""
    place = F.pmod(angle, F.lit(360.0)) / 360 * size
    low = F.floor(place).cast("int")
    share = place - low
    return F.element_at(table, low % size + 1) * (1 - share) + F.element_at(table, (low + 1) % size + 1) * share


def free_crop(width: Column, height: Column, box: Sequence[Column]) -> list[Column]:
    """A pixel rectangle (x, y, width, height) kept inside the image; the whole image where a side isn't positive."""
    x, y, w, h = (F.bround(b, 0) for b in box)
    x0, y0 = clip(x, F.lit(0.0), F.greatest(width - 1, F.lit(0))), clip(y, F.lit(0.0), F.greatest(height - 1, F.lit(0)))
    inside = [x0, y0, clip(w, F.lit(1.0), F.greatest(width - x0, F.lit(1.0))), clip(h, F.lit(1.0), F.greatest(height - y0, F.lit(1.0)))]
    known = F.coalesce((box[2] > 0) & (box[3] > 0), F.lit(False))
    return [F.when(known, i).otherwise(o).cast("int") for i, o in zip(inside, (F.lit(0), F.lit(0), width, height), strict=True)]


def ratio_crop(width: Column, height: Column, aspect: Column, centre: Sequence[Column]) -> list[Column]:
    """The largest rectangle of an aspect ratio about a centre (in shares of the image), moved inside; the whole image without a ratio."""
    wide = width / height >= aspect
    w = F.least(F.when(wide, F.greatest(F.lit(1.0), F.bround(height * aspect, 0))).otherwise(width.cast("double")), width.cast("double"))
    h = F.least(F.when(wide, height.cast("double")).otherwise(F.greatest(F.lit(1.0), F.bround(width / aspect, 0))), height.cast("double"))
    x = clip(F.bround(centre[0] * width - w / 2, 0), F.lit(0.0), F.greatest(width - w, F.lit(0.0)))
    y = clip(F.bround(centre[1] * height - h / 2, 0), F.lit(0.0), F.greatest(height - h, F.lit(0.0)))
    known = F.coalesce(aspect > 0, F.lit(False))
    return [F.when(known, i).otherwise(o).cast("int") for i, o in zip((x, y, w, h), (F.lit(0), F.lit(0), width, height), strict=True)]


def huber(error: Column, delta: float) -> Column:
    """Half the square within delta, straight beyond."""
    size = F.abs(error)
    return F.when(size <= delta, 0.5 * error * error).otherwise(delta * (size - 0.5 * delta))


def guarded_ratio(a: Column, b: Column, least: float) -> Column:
    """a over b, the divisor kept at least `least` away from zero."""
    return a / F.when(F.abs(b) < least, F.when(b < 0, -least).otherwise(least)).otherwise(b)
