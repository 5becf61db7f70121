"""Colour science as column expressions: transfer curves, OKLab, CIELAB, HSV, colour temperature, colour difference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published matrices and constants (OKLab, sRGB to XYZ D65, D65 white, BT.709 luma).
OKLAB_M1 = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OKLAB_M2 = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
OKLAB_M2_INVERSE = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
OKLAB_M1_INVERSE = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
SRGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
D65 = (0.95047, 1.0, 1.08883)
LUMA = (0.2126, 0.7152, 0.0722)

Triple = tuple[Column, Column, Column]


def dot(weights: Sequence[float], values: Sequence[Column]) -> Column:
    return sum((w * v for w, v in zip(weights[1:], values[1:], strict=True)), weights[0] * values[0])


def apply_matrix(matrix: Sequence[Sequence[float]], values: Triple) -> Triple:
    return tuple(dot(row, values) for row in matrix)


def luma(r: Column, g: Column, b: Column) -> Column:
    return dot(LUMA, (r, g, b))


def srgb_decode(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def srgb_encode(x: Column) -> Column:
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, 1 / 2.4) - 0.055)


def srgb_to_oklab(r: Column, g: Column, b: Column) -> Triple:
    lms = apply_matrix(OKLAB_M1, (srgb_decode(r), srgb_decode(g), srgb_decode(b)))
    return apply_matrix(OKLAB_M2, tuple(F.cbrt(x) for x in lms))


def oklab_to_srgb(lightness: Column, a: Column, b: Column) -> Triple:
    """Clipped to 0..1."""
    lms = tuple(x * x * x for x in apply_matrix(OKLAB_M2_INVERSE, (lightness, a, b)))
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), srgb_encode(F.greatest(F.lit(0.0), x)))) for x in apply_matrix(OKLAB_M1_INVERSE, lms))


def polar(a: Column, b: Column) -> tuple[Column, Column]:
    """(chroma, hue in degrees, 0 to 360)."""
    return F.hypot(a, b), F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))


def linear_to_lab(r: Column, g: Column, b: Column) -> Triple:
    def f(t: Column) -> Column:
        return F.when(t > (6 / 29) ** 3, F.cbrt(t)).otherwise(t / (3 * (6 / 29) ** 2) + 4 / 29)

    x, y, z = (f(v / w) for v, w in zip(apply_matrix(SRGB_TO_XYZ, (r, g, b)), D65, strict=True))
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def rgb_to_hsv(r: Column, g: Column, b: Column) -> Triple:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    hue = F.when(span <= 0, 0.0).when(top == r, F.pmod(60 * (g - b) / span, F.lit(360.0))).when(top == g, 60 * (b - r) / span + 120).otherwise(60 * (r - g) / span + 240)
    return hue, F.when(top <= 0, 0.0).otherwise(span / top), top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Triple:
    def channel(n: float) -> Column:
        k = F.pmod(h / 60 + n, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return channel(5.0), channel(3.0), channel(1.0)


def xy_to_cct(x: Column, y: Column) -> Column:
    """McCamy's cubic."""
    n = (x - 0.3320) / (0.1858 - y)
    return 449.0 * n * n * n + 3525.0 * n * n + 6823.3 * n + 5520.33


def temp_to_xy(kelvin: Column) -> tuple[Column, Column]:
    """The Planckian locus by Kim's piecewise cubics."""
    t = 1000.0 / kelvin
    x = F.when(kelvin <= 4000, -0.2661239 * t * t * t - 0.2343589 * t * t + 0.8776956 * t + 0.179910).otherwise(-3.0258469 * t * t * t + 2.1070379 * t * t + 0.2226347 * t + 0.240390)
    low = -1.1063814 * x * x * x - 1.34811020 * x * x + 2.18555832 * x - 0.20219683
    middle = -0.9549476 * x * x * x - 1.37418593 * x * x + 2.09137015 * x - 0.16748867
    high = 3.0817580 * x * x * x - 5.87338670 * x * x + 3.75112997 * x - 0.37001483
    return x, F.when(kelvin <= 2222, low).when(kelvin <= 4000, middle).otherwise(high)


def delta_e_2000(rows: DataFrame, lab1: Sequence[str], lab2: Sequence[str], name: str) -> DataFrame:
    """Add the CIEDE2000 difference of two Lab triples of columns. Steps are columns of their own, so that no step is computed twice."""
    c = F.col
    l1, a1, b1 = lab1
    l2, a2, b2 = lab2
    kept = rows.columns
    seventh = F.pow((F.hypot(c(a1), c(b1)) + F.hypot(c(a2), c(b2))) / 2, 7)
    out = rows.withColumn("__g", 1 + 0.5 * (1 - F.sqrt(seventh / (seventh + 25.0**7))))
    out = out.withColumns({"__a1": c(a1) * c("__g"), "__a2": c(a2) * c("__g")})
    (c1, h1), (c2, h2) = polar(c("__a1"), c(b1)), polar(c("__a2"), c(b2))
    out = out.withColumns({"__c1": c1, "__h1": h1, "__c2": c2, "__h2": h2}).withColumns({"__gap": c("__h2") - c("__h1"), "__sum": c("__h1") + c("__h2"), "__gray": c("__c1") * c("__c2") == 0})
    turn = F.when(c("__gray"), 0.0).when(F.abs("__gap") <= 180, c("__gap")).when(c("__gap") > 180, c("__gap") - 360).otherwise(c("__gap") + 360)
    middle = F.when(c("__gray"), c("__sum")).when(F.abs("__gap") <= 180, c("__sum") / 2).when(c("__sum") < 360, (c("__sum") + 360) / 2).otherwise((c("__sum") - 360) / 2)
    out = out.withColumns({"__dh": turn, "__h": middle, "__c": (c("__c1") + c("__c2")) / 2, "__off": F.pow((c(l1) + c(l2)) / 2 - 50, 2)})
    h = c("__h")
    t = 1 - 0.17 * F.cos(F.radians(h - 30)) + 0.24 * F.cos(F.radians(2 * h)) + 0.32 * F.cos(F.radians(3 * h + 6)) - 0.20 * F.cos(F.radians(4 * h - 63))
    out = out.withColumns({"__t": t, "__c7": F.pow("__c", F.lit(7.0))})
    out = out.withColumns({
        "__x": (c(l2) - c(l1)) / (1 + 0.015 * c("__off") / F.sqrt(20 + c("__off"))), "__y": (c("__c2") - c("__c1")) / (1 + 0.045 * c("__c")),
        "__z": 2 * F.sqrt(c("__c1") * c("__c2")) * F.sin(F.radians(c("__dh") / 2)) / (1 + 0.015 * c("__c") * c("__t")),
        "__r": -F.sin(F.radians(60 * F.exp(-F.pow((h - 275) / 25, 2)))) * 2 * F.sqrt(c("__c7") / (c("__c7") + 25.0**7)),
    })
    x, y, z = c("__x"), c("__y"), c("__z")
    return out.select(*kept, F.sqrt(F.greatest(F.lit(0.0), x * x + y * y + z * z + c("__r") * y * z)).alias(name))


def smoothstep(y: Column, balance: float, width: float = 0.5) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - (balance - width / 2)) / width))
    return t * t * (3 - 2 * t)


def ring_mask(hue: Column, center: float, width: float, smooth: float = 1.0) -> Column:
    """1 within half the width of the centre, falling to 0 by a raised cosine over smooth times that."""
    gap = F.abs(F.pmod(hue - center + 180, F.lit(360.0)) - 180)
    edge = max(1e-6, width / 2 * smooth)
    return F.when(gap <= width / 2, 1.0).when(gap >= width / 2 + edge, 0.0).otherwise(0.5 * (1 + F.cos((gap - width / 2) / edge * 3.141592653589793)))


def ellipse_distance(a: Column, b: Column, cx: float, cy: float, major: float, minor: float, degrees: float) -> Column:
    """Distance from an ellipse's centre in its own half-axes."""
    from math import cos, radians, sin

    c, s = cos(radians(degrees)), sin(radians(degrees))
    dx, dy = a - cx, b - cy
    return F.hypot((dx * c + dy * s) / major, (dy * c - dx * s) / minor)


def soft_band(distance: Column, band: float) -> Column:
    """1 up to the edge, falling smoothly to 0 within the band."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 + band - distance) / band))
    return t * t * (3 - 2 * t)


def highlight_rolloff(x: Column, knee: float = 0.9) -> Column:
    return F.when(x <= knee, x).otherwise(knee + (1 - knee) * F.tanh((x - knee) / (1 - knee)))


def root_polynomial(r: Column, g: Column, b: Column) -> list[Column]:
    """Features of degree two: channels and the roots of their products."""
    return [r, g, b, F.sqrt(r * g), F.sqrt(g * b), F.sqrt(r * b)]
