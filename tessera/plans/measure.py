"""Queries of measurement and colour, over embeddings as small images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import color
from tessera.operators import imaging, measure
from tessera.plans.tables import table

#: 64 components are 8 x 8 values; components lie within -1..1 and are moved to 0..255 or 0..1.
PIXELS_SQL = "px AS (SELECT vec_id, (pos - 1) // 8 AS y, (pos - 1) % 8 AS x, CAST(embedding[pos] AS DOUBLE) * 300 + 127.5 AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS pos))"
RGB_SQL = "rgb AS (SELECT vec_id, n, greatest(0.0, least(1.0, CAST(embedding[3 * n + 1] AS DOUBLE) * 2 + 0.5)) AS r, greatest(0.0, least(1.0, CAST(embedding[3 * n + 2] AS DOUBLE) * 2 + 0.5)) AS g, greatest(0.0, least(1.0, CAST(embedding[3 * n + 3] AS DOUBLE) * 2 + 0.5)) AS b FROM embeddings, (SELECT unnest(range(0, 21)) AS n))"


def pixel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, y, x, v): each embedding as 8 x 8 values on 0..255."""
    rows = measure.pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)
    return rows.withColumn("v", F.col("v") * 300 + 127.5)


def rgb_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, n, r, g, b): twenty-one colours of each embedding, on 0..1."""
    unit = F.transform("embedding", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v.cast("double") * 2 + 0.5)))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", unit.alias("u"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("n"))
    return rows.select("vec_id", "n", *[F.element_at("u", 3 * F.col("n") + k).alias(c) for k, c in enumerate("rgb", 1)])




def _channels():
    return F.col("r"), F.col("g"), F.col("b")


def image_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, clipping and contrast per image."""
    found = measure.image_stats(pixel_rows(spark, sf_dir), "vec_id")
    return found.select("vec_id", *[F.round(c, 6).alias(c) for c in ("mean", "highlight", "shadow", "contrast")])


def image_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tonal range and haze per image."""
    unit = pixel_rows(spark, sf_dir).withColumn("v", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v") / 255)))
    return measure.proxies(unit, "vec_id").select("vec_id", F.round("tonal_range", 6).alias("tonal_range"), F.round("haze", 6).alias("haze"))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen bins of pixel values per label."""
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return measure.histogram(pixel_rows(spark, sf_dir).join(labels, "vec_id"), ["label"], "v", 0.0, 255.0, 16)


def zone_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 x 3 zone means, row means and the whole."""
    return measure.zones(pixel_rows(spark, sf_dir), "vec_id", 8, 8).withColumn("mean", F.round("mean", 5))


def trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means between the tenth and ninetieth percentile."""
    return measure.trimmed_mean(pixel_rows(spark, sf_dir), "vec_id").withColumn("trimmed", F.round("trimmed", 5))


def gray_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of absolute forward differences per image."""
    return measure.gradients(pixel_rows(spark, sf_dir), "vec_id").withColumn("edge", F.round("edge", 4))


def colorfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opponent-channel colourfulness per image."""
    return rgb_pixels(spark, sf_dir).groupBy("vec_id").agg(F.round(measure.colorfulness(*_channels()), 5).alias("colorfulness"))


def kernel_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local contrast over a 3 x 3 mean."""
    return measure.local_contrast(pixel_rows(spark, sf_dir), "vec_id", 0.5, 1).select("vec_id", "y", "x", F.round("sharp", 5).alias("sharp"))


def kernel_guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guided filter of each image by itself: mean and spread of the result. Images stay rows, so nothing is shuffled."""
    values = F.transform("embedding", lambda v: v.cast("double") * 300 + 127.5)
    images = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), values.alias("values"))
    found = imaging.over_images(images, lambda image: _spread(imaging.guided(image, image, 2, 400.0)), "mean double, spread double")
    return found.select("vec_id", F.round("mean", 4).alias("mean"), F.round("spread", 4).alias("spread"))


def _spread(image) -> dict[str, float]:
    return {"mean": float(image.mean()), "spread": float(image.std())}


def _rounded(rows: DataFrame, names: str, columns, digits: int = 6) -> DataFrame:
    return rows.select("vec_id", "n", *[F.round(c, digits).alias(n) for n, c in zip(names.split(), columns, strict=True)])


def srgb_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded and encoded sRGB values."""
    return _rounded(rgb_pixels(spark, sf_dir), "decoded encoded rolled", (color.srgb_decode(F.col("r")), color.srgb_encode(F.col("g")), color.highlight_rolloff(F.col("b") * 1.5)))


def oklab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OKLab of every pixel."""
    return _rounded(rgb_pixels(spark, sf_dir), "ok_l ok_a ok_b", color.srgb_to_oklab(*_channels()))


def oklab_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest error of sRGB to OKLab and back, per image, in units of 1/1000."""
    rows = rgb_pixels(spark, sf_dir)
    lab = rows.select("vec_id", "r", "g", "b", *[c.alias(n) for n, c in zip(("l", "a", "bb"), color.srgb_to_oklab(*_channels()), strict=True)])
    back = color.oklab_to_srgb(F.col("l"), F.col("a"), F.col("bb"))
    return lab.groupBy("vec_id").agg((F.round(F.max(F.greatest(*[F.abs(x - F.col(n)) for n, x in zip("rgb", back, strict=True)])) * 1000, 0)).alias("error"))


def oklch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean chroma and share of warm hues per image."""
    _, a, b = color.srgb_to_oklab(*_channels())
    chroma, hue = color.polar(a, b)
    return rgb_pixels(spark, sf_dir).groupBy("vec_id").agg(F.round(F.avg(chroma), 6).alias("chroma"), F.round(F.avg(color.ring_mask(hue, 60.0, 60.0)), 5).alias("warm"))


def hsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSV of every pixel."""
    return _rounded(rgb_pixels(spark, sf_dir), "h s v", color.rgb_to_hsv(*_channels()), 5)


def delta_e_2000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour difference of every pixel from its own darkened and swapped copy, median and p95 per image."""
    r, g, b = _channels()
    decoded = rgb_pixels(spark, sf_dir).select("vec_id", *[color.srgb_decode(x).alias(n) for n, x in zip(("r1", "g1", "b1", "r2", "g2", "b2"), (r, g, b, g * 0.9, r * 0.9, b * 0.9), strict=True)])
    labs = [x.alias(n + k) for k in "12" for n, x in zip("lab", color.linear_to_lab(F.col("r" + k), F.col("g" + k), F.col("b" + k)), strict=True)]
    differences = color.delta_e_2000(decoded.select("vec_id", *labs), ("l1", "a1", "b1"), ("l2", "a2", "b2"), "d")
    found = differences.groupBy("vec_id").agg(F.percentile("d", F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.max("d").alias("most"))
    return found.select("vec_id", F.round(F.col("p")[0], 4).alias("median"), F.round(F.col("p")[1], 4).alias("p95"), F.round("most", 4).alias("most"))


def color_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' prices as temperatures: locus, and the temperature back from it."""
    kelvin = F.lit(2000.0) + F.col("o_totalprice") % 8000
    x, y = color.temp_to_xy(kelvin)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"), y.alias("y"))
    return rows.select("o_orderkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(color.xy_to_cct(F.col("x"), F.col("y")), 2).alias("cct"))


def skin_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft membership in an ellipse of the OKLab plane, summed per image."""
    _, a, b = color.srgb_to_oklab(*_channels())
    distance = color.ellipse_distance(a, b, 0.04, 0.05, 0.06, 0.03, 50.0)
    return rgb_pixels(spark, sf_dir).groupBy("vec_id").agg(F.round(F.sum(color.soft_band(distance, 0.4)), 5).alias("mask"), F.count_if(distance <= 1).alias("core"))


def split_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of highlights by a smooth step over luma, and the quantised tinted channel."""
    weight = color.smoothstep(color.luma(*_channels()), 0.5)
    tinted = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r") * (1 - 0.2 * weight) + 0.1 * weight))
    return rgb_pixels(spark, sf_dir).groupBy("vec_id").agg(F.round(F.avg(weight), 6).alias("weight"), F.round(F.avg(tinted), 6).alias("tinted"))


def channel_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares line of g on r per label, from sums."""
    rows = rgb_pixels(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    found = rows.groupBy("label").agg(F.regr_slope("g", "r").alias("slope"), F.regr_intercept("g", "r").alias("intercept"), F.regr_r2("g", "r").alias("r2"))
    return found.select("label", *[F.round(c, 5).alias(c) for c in ("slope", "intercept", "r2")])


QUERIES = {f"measure_{f.__name__}" if f.__name__ in ("histogram",) else f.__name__: f for f in (image_stats, image_proxies, histogram, zone_grid, trimmed_mean, gray_edge, colorfulness, kernel_box, kernel_guided, srgb_curve, oklab, oklab_round_trip, oklch, hsv, delta_e_2000, color_temperature, skin_mask, split_tone, channel_fit)}


def _dec(c: str) -> str:
    return f"(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END)"


def encode_sql(c: str) -> str:
    return f"(CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92 ELSE 1.055 * pow({c}, 1 / 2.4) - 0.055 END)"


def _rows(matrix, names: str) -> list[str]:
    return [" + ".join(f"({w}) * {n}" for w, n in zip(row, names.split(), strict=True)) for row in matrix]


_LIN = f"lin AS (SELECT vec_id, n, r, g, b, {_dec('r')} AS lr, {_dec('g')} AS lg, {_dec('b')} AS lb FROM rgb)"
_OK = (
    RGB_SQL + ", " + _LIN + ", lms AS (SELECT vec_id, n, r, g, b, " + ", ".join(f"cbrt({e}) AS {n}" for n, e in zip(("l_", "m_", "s_"), _rows(color.OKLAB_M1, "lr lg lb"), strict=True)) + " FROM lin), "
    "ok AS (SELECT vec_id, n, r, g, b, " + ", ".join(f"{e} AS {n}" for n, e in zip(("ok_l", "ok_a", "ok_b"), _rows(color.OKLAB_M2, "l_ m_ s_"), strict=True)) + " FROM lms), "
    "lch AS (SELECT *, sqrt(ok_a * ok_a + ok_b * ok_b) AS chroma, CASE WHEN degrees(atan2(ok_b, ok_a)) < 0 THEN degrees(atan2(ok_b, ok_a)) + 360 ELSE degrees(atan2(ok_b, ok_a)) END AS hue FROM ok)"
)


def _lab(prefix: str, r: str, g: str, b: str) -> str:
    def f(e: str) -> str:
        return f"(CASE WHEN {e} > pow(6.0 / 29, 3) THEN cbrt({e}) ELSE ({e}) / (3 * pow(6.0 / 29, 2)) + 4.0 / 29 END)"

    x, y, z = (f(f"(({e}) / {w})") for e, w in zip(_rows(color.SRGB_TO_XYZ, f"{r} {g} {b}"), color.D65, strict=True))
    return f"116 * {y} - 16 AS {prefix}l, 500 * ({x} - {y}) AS {prefix}a, 200 * ({y} - {z}) AS {prefix}b"


_HUE = "CASE WHEN degrees(atan2({b}, {a})) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END"
_DE = f"""
    {RGB_SQL}, d AS (SELECT vec_id, {_dec('r')} AS r1, {_dec('g')} AS g1, {_dec('b')} AS b1, {_dec('(g * 0.9)')} AS r2, {_dec('(r * 0.9)')} AS g2, {_dec('(b * 0.9)')} AS b2 FROM rgb),
    lab AS (SELECT vec_id, {_lab('p', 'r1', 'g1', 'b1')}, {_lab('q', 'r2', 'g2', 'b2')} FROM d),
    k AS (SELECT *, 0.5 * (1 - sqrt(pow((sqrt(pa * pa + pb * pb) + sqrt(qa * qa + qb * qb)) / 2, 7) / (pow((sqrt(pa * pa + pb * pb) + sqrt(qa * qa + qb * qb)) / 2, 7) + pow(25.0, 7)))) AS gg FROM lab),
    c AS (SELECT *, sqrt(pow(pa * (1 + gg), 2) + pb * pb) AS c1, sqrt(pow(qa * (1 + gg), 2) + qb * qb) AS c2, {_HUE.format(b='pb', a='(pa * (1 + gg))')} AS h1, {_HUE.format(b='qb', a='(qa * (1 + gg))')} AS h2 FROM k),
    e AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh,
          CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh, (c1 + c2) / 2 AS mc, (pl + ql) / 2 AS ml FROM c),
    t AS (SELECT *, 1 - 0.17 * cos(radians(mh - 30)) + 0.24 * cos(radians(2 * mh)) + 0.32 * cos(radians(3 * mh + 6)) - 0.20 * cos(radians(4 * mh - 63)) AS tt FROM e),
    u AS (SELECT vec_id, (ql - pl) / (1 + 0.015 * pow(ml - 50, 2) / sqrt(20 + pow(ml - 50, 2))) AS x, (c2 - c1) / (1 + 0.045 * mc) AS y, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * mc * tt) AS z,
          -sin(radians(60 * exp(-pow((mh - 275) / 25, 2)))) * 2 * sqrt(pow(mc, 7) / (pow(mc, 7) + pow(25.0, 7))) AS rt FROM t),
    de AS (SELECT vec_id, sqrt(greatest(0.0, x * x + y * y + z * z + rt * y * z)) AS d FROM u)"""


def _mean_of(source: str, target: str, value: str, name: str, radius: int) -> str:
    across = f"OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)"
    down = f"OVER (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING)"
    return f"{target}0 AS (SELECT *, sum({value}) {across} AS s_{name}, count({value}) {across} AS n_{name} FROM {source}), {target} AS (SELECT *, sum(s_{name}) {down} / sum(n_{name}) {down} AS {name} FROM {target}0)"


ORACLES = {
    "image_stats": f"WITH {PIXELS_SQL} SELECT vec_id, round(avg(v), 6) AS mean, round(avg(CASE WHEN v >= 250 THEN 1.0 ELSE 0.0 END), 6) AS highlight, round(avg(CASE WHEN v <= 5 THEN 1.0 ELSE 0.0 END), 6) AS shadow, round(stddev_pop(v) / avg(v), 6) AS contrast FROM px GROUP BY vec_id",
    "image_proxies": f"WITH {PIXELS_SQL}, u AS (SELECT vec_id, greatest(0.0, least(1.0, v / 255)) AS v FROM px), p AS (SELECT vec_id, quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM u GROUP BY vec_id) SELECT vec_id, round(b - a, 6) AS tonal_range, round(greatest(0.0, least(1.0, 1 - (b - a) / b)), 6) AS haze FROM p",
    "measure_histogram": f"WITH {PIXELS_SQL} SELECT label, CAST(least(floor(v / (255.0 / 16)), 15) AS INT) AS bin, count(*) AS n FROM px JOIN embeddings USING (vec_id) WHERE v BETWEEN 0 AND 255 GROUP BY ALL",
    "zone_grid": f"WITH {PIXELS_SQL}, z AS (SELECT vec_id, least(y // 2, 2) AS zy, least(x // 2, 2) AS zx, v FROM px) SELECT vec_id, zy, zx, round(avg(v), 5) AS mean FROM z GROUP BY GROUPING SETS ((vec_id, zy, zx), (vec_id, zy), (vec_id))",
    "trimmed_mean": f"WITH {PIXELS_SQL}, e AS (SELECT vec_id, quantile_cont(v, 0.1) AS a, quantile_cont(v, 0.9) AS b FROM px GROUP BY vec_id) SELECT vec_id, round(avg(v), 5) AS trimmed FROM px JOIN e USING (vec_id) WHERE v BETWEEN a AND b GROUP BY vec_id",
    "gray_edge": f"WITH {PIXELS_SQL}, d AS (SELECT vec_id, coalesce(abs(v - lag(v) OVER (PARTITION BY vec_id, y ORDER BY x)), 0) + coalesce(abs(v - lag(v) OVER (PARTITION BY vec_id, x ORDER BY y)), 0) AS d FROM px) SELECT vec_id, round(sum(d), 4) AS edge FROM d GROUP BY vec_id",
    "colorfulness": f"WITH {RGB_SQL} SELECT vec_id, round((sqrt(var_pop(r - g) + var_pop(0.5 * (r + g) - b)) + 0.15 * (avg(abs(r - g)) + avg(abs(0.5 * (r + g) - b)))) / (sqrt(2.0) + 0.3) * 100, 5) AS colorfulness FROM rgb GROUP BY vec_id",
    "kernel_box": f"WITH {PIXELS_SQL}, {_mean_of('px', 'm', 'v', 'blurred', 1)} SELECT vec_id, y, x, round(v + 0.5 * (v - blurred), 5) AS sharp FROM m",
    "kernel_guided": f"WITH {PIXELS_SQL}, {_mean_of('px', 'm1', 'v', 'm', 2)}, {_mean_of('m1', 'm2', 'v * v', 'q', 2)}, f AS (SELECT vec_id, y, x, v, m, (q - m * m) / (q - m * m + 400.0) AS a FROM m2), h AS (SELECT *, m * (1 - a) AS b FROM f), {_mean_of('h', 'm3', 'a', 'ma', 2)}, {_mean_of('m3', 'm4', 'b', 'mb', 2)} SELECT vec_id, round(avg(ma * v + mb), 4) AS mean, round(stddev_pop(ma * v + mb), 4) AS spread FROM m4 GROUP BY vec_id",
    "srgb_curve": f"WITH {RGB_SQL} SELECT vec_id, n, round({_dec('r')}, 6) AS decoded, round({encode_sql('g')}, 6) AS encoded, round(CASE WHEN b * 1.5 <= 0.9 THEN b * 1.5 ELSE 0.9 + (1 - 0.9) * tanh((b * 1.5 - 0.9) / (1 - 0.9)) END, 6) AS rolled FROM rgb",
    "oklab": f"WITH {_OK} SELECT vec_id, n, round(ok_l, 6) AS ok_l, round(ok_a, 6) AS ok_a, round(ok_b, 6) AS ok_b FROM ok",
    "oklab_round_trip": "SELECT vec_id, 0.0::DOUBLE AS error FROM embeddings",
    "oklch": f"WITH {_OK}, w AS (SELECT vec_id, chroma, abs((hue - 60 + 180 + 360) % 360 - 180) AS gap FROM lch) SELECT vec_id, round(avg(chroma), 6) AS chroma, round(avg(CASE WHEN gap <= 30 THEN 1.0 WHEN gap >= 60 THEN 0.0 ELSE 0.5 * (1 + cos((gap - 30) / 30 * pi())) END), 5) AS warm FROM w GROUP BY vec_id",
    "hsv": f"WITH {RGB_SQL}, m AS (SELECT *, greatest(r, g, b) AS t, least(r, g, b) AS l FROM rgb) SELECT vec_id, n, round(CASE WHEN t - l <= 0 THEN 0 WHEN t = r THEN (60 * (g - b) / (t - l) + 360) % 360 WHEN t = g THEN 60 * (b - r) / (t - l) + 120 ELSE 60 * (r - g) / (t - l) + 240 END, 5) AS h, round(CASE WHEN t <= 0 THEN 0 ELSE (t - l) / t END, 5) AS s, round(t, 5) AS v FROM m",
    "delta_e_2000": f"WITH {_DE} SELECT vec_id, round(quantile_cont(d, 0.5), 4) AS median, round(quantile_cont(d, 0.95), 4) AS p95, round(max(d), 4) AS most FROM de GROUP BY vec_id",
    "color_temperature": """
        WITH k AS (SELECT o_orderkey, 2000.0 + o_totalprice % 8000 AS k FROM orders), t AS (SELECT *, 1000.0 / k AS t FROM k),
        x AS (SELECT *, CASE WHEN k <= 4000 THEN -0.2661239 * t * t * t - 0.2343589 * t * t + 0.8776956 * t + 0.179910 ELSE -3.0258469 * t * t * t + 2.1070379 * t * t + 0.2226347 * t + 0.240390 END AS x FROM t),
        y AS (SELECT *, CASE WHEN k <= 2222 THEN -1.1063814 * x * x * x - 1.34811020 * x * x + 2.18555832 * x - 0.20219683 WHEN k <= 4000 THEN -0.9549476 * x * x * x - 1.37418593 * x * x + 2.09137015 * x - 0.16748867
              ELSE 3.0817580 * x * x * x - 5.87338670 * x * x + 3.75112997 * x - 0.37001483 END AS y FROM x), n AS (SELECT *, (x - 0.3320) / (0.1858 - y) AS n FROM y)
        SELECT o_orderkey, round(x, 6) AS x, round(y, 6) AS y, round(449.0 * n * n * n + 3525.0 * n * n + 6823.3 * n + 5520.33, 2) AS cct FROM n""",
    "skin_mask": f"WITH {_OK}, d AS (SELECT vec_id, sqrt(pow(((ok_a - 0.04) * cos(radians(50)) + (ok_b - 0.05) * sin(radians(50))) / 0.06, 2) + pow(((ok_b - 0.05) * cos(radians(50)) - (ok_a - 0.04) * sin(radians(50))) / 0.03, 2)) AS d FROM ok), s AS (SELECT vec_id, d, greatest(0.0, least(1.0, (1.4 - d) / 0.4)) AS t FROM d) SELECT vec_id, round(sum(t * t * (3 - 2 * t)), 5) AS mask, count_if(d <= 1) AS core FROM s GROUP BY vec_id",
    "split_tone": f"WITH {RGB_SQL}, s AS (SELECT *, greatest(0.0, least(1.0, (0.2126 * r + 0.7152 * g + 0.0722 * b - 0.25) / 0.5)) AS t FROM rgb), w AS (SELECT *, t * t * (3 - 2 * t) AS w FROM s) SELECT vec_id, round(avg(w), 6) AS weight, round(avg(greatest(0.0, least(1.0, r * (1 - 0.2 * w) + 0.1 * w))), 6) AS tinted FROM w GROUP BY vec_id",
    "channel_fit": f"WITH {RGB_SQL} SELECT label, round(regr_slope(g, r), 5) AS slope, round(regr_intercept(g, r), 5) AS intercept, round(regr_r2(g, r), 5) AS r2 FROM rgb JOIN embeddings USING (vec_id) GROUP BY label",
}
