"""Queries of fits by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import color
from tessera.operators import fits
from tessera.plans.measure import _OK, RGB_SQL, rgb_pixels
from tessera.plans.tables import table


def plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by quantity and discount with an offset, weighted by tax, with a little ridge, per return flag and status."""
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL")
    found = fits.least_squares(lines, ["l_returnflag", "l_linestatus"], [F.lit(1.0), F.col("l_quantity"), F.col("l_discount") * 100], ["l_extendedprice"], 1 + F.col("l_tax"), ridge=0.5, least=2)
    return found.select("l_returnflag", "l_linestatus", "n", "rank", *[F.round(F.col("coefficients")[0][i], 2).alias(c) for i, c in enumerate(("offset", "by_quantity", "by_discount"))])


def _features() -> list:
    return [F.col("r"), F.col("g"), F.col("b"), F.sqrt(F.col("r") * F.col("g")), F.sqrt(F.col("g") * F.col("b")), F.sqrt(F.col("r") * F.col("b"))]


def _targets() -> list:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return [0.9 * r + 0.1 * g + 0.02 * b * b, 0.05 * r + 0.9 * g + 0.05 * b, 0.1 * g + 0.9 * b + 0.02 * r * g]


def matrix_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three colours by six root-polynomial features per label, refitted without the largest residuals, with quantiles of those left."""
    pixels = rgb_pixels(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    found = fits.trimmed_fit(pixels, ["label"], _features(), _targets())
    return found.select("label", "n", F.posexplode("coefficients").alias("channel", "row"), "p50", "p95").select("label", "n", "channel", *[F.round(F.col("row")[i], 5).alias(f"c{i}") for i in range(6)], F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def matrix_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted matrix of each label applied to its pixels, held to 0..1: the mean residual per image."""
    pixels = rgb_pixels(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    found = fits.least_squares(pixels, ["label"], _features(), _targets(), least=100)
    both = fits.joined(pixels, fits.written(found.select("label", "coefficients"), "matrices"), ["label"])
    missed = sum((F.abs(t - fits.predicted(F.col("coefficients"), k, _features(), 0.0, 1.0)) for k, t in enumerate(_targets())), F.lit(0.0))
    return both.groupBy("vec_id").agg(F.round(F.avg(missed), 6).alias("missed"))


def _lab_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, a, b = color.srgb_to_oklab(F.col("r"), F.col("g"), F.col("b"))
    pixels = rgb_pixels(spark, sf_dir).select("vec_id", a.alias("a"), b.alias("b"))
    return pixels.join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")


def enclosing_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ellipse about 96 % of each label's colours in the a-b plane."""
    found = fits.enclosing_ellipse(_lab_plane(spark, sf_dir), ["label"], "a", "b", 0.96, least=500)
    return found.select("label", "n", "trimmed", *[F.round(c, 5).alias(c) for c in ("center_a", "center_b", "major", "minor")], F.round("angle_deg", 3).alias("angle_deg"))


def neutral_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of near-neutral colours by luma band, images being 64 neighbouring embeddings."""
    opponents = rgb_pixels(spark, sf_dir).select(F.floor(F.col("vec_id") / 64).alias("sheet"), (F.col("g") * 255).alias("l"), (128 + (F.col("r") - F.col("g")) * 40).alias("a"), (128 + (F.col("g") - F.col("b")) * 40).alias("b"))
    return fits.neutral_axis(opponents, "sheet", 0.8).select("sheet", "band", "n", F.round("da", 6).alias("da"), F.round("db", 6).alias("db"))


def minimum_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest change of three parameters that takes two errors away, effects and errors being values of each embedding."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    asked = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.slice(e, 1, 2), F.slice(e, 3, 2), F.slice(e, 5, 2)).alias("effects"), F.slice(e, 7, 2).alias("errors"))
    found = fits.minimum_norm(asked, "effects", "errors")
    return found.select("vec_id", *[F.round(F.col("delta")[i], 4).alias(f"d{i}") for i in range(3)])


QUERIES = {f.__name__: f for f in (plane_fit, matrix_fit, matrix_apply, enclosing_ellipse, neutral_axis, minimum_norm)}


def _turned(source: str) -> str:
    """One enclosing fit of points (label, a, b) of a source, as CTE bodies t, mid, reach and fit."""
    return f"""
        t_{source} AS (SELECT label, coalesce(0.5 * atan2(2 * covar_samp(a, b), var_samp(a) - var_samp(b)), 0.0) AS turn, count(*) AS n FROM {source} GROUP BY label),
        uv_{source} AS (SELECT label, n, turn, a, b, a * cos(turn) + b * sin(turn) AS u, b * cos(turn) - a * sin(turn) AS v FROM {source} JOIN t_{source} USING (label)),
        mid_{source} AS (SELECT label, median(u) AS mu, median(v) AS mv FROM uv_{source} GROUP BY label),
        fit_{source} AS (SELECT label, n, turn, mu, mv, quantile_cont(abs(u - mu), 0.98) AS ru, quantile_cont(abs(v - mv), 0.98) AS rv FROM uv_{source} JOIN mid_{source} USING (label) GROUP BY label, n, turn, mu, mv),
        place_{source} AS (SELECT uv.*, mu, mv, ru, rv, sqrt(pow((u - mu) / ru, 2) + pow((v - mv) / rv, 2)) AS d FROM uv_{source} uv JOIN fit_{source} f USING (label))
    """


ORACLES = {
    "plane_fit": """
        WITH s AS (
            SELECT l_returnflag, l_linestatus, count(*) AS n, sum(w) + 0.5 AS a, sum(w * x) AS b, sum(w * y) AS c, sum(w * x * x) + 0.5 AS d, sum(w * x * y) AS e, sum(w * y * y) + 0.5 AS f, sum(w * p) AS p, sum(w * x * p) AS q, sum(w * y * p) AS r
            FROM (SELECT l_returnflag, l_linestatus, CAST(1 + l_tax AS DOUBLE) AS w, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) * 100 AS y, CAST(l_extendedprice AS DOUBLE) AS p FROM lineitem) GROUP BY ALL HAVING count(*) >= 2
        ), det AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM s)
        SELECT l_returnflag, l_linestatus, n, 3 AS rank, round((p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det, 2) AS "offset",
               round((a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c)) / det, 2) AS by_quantity, round((a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / det, 2) AS by_discount
        FROM det""",
    "enclosing_ellipse": f"""
        WITH {_OK}, p1 AS (SELECT label, ok_a AS a, ok_b AS b FROM ok JOIN embeddings USING (vec_id)), {_turned("p1")},
        lim AS (SELECT label, quantile_cont(d, 0.995) AS lim FROM place_p1 GROUP BY label),
        cnt AS (SELECT label, count(*) FILTER (d > lim) AS over_, count(*) FILTER (d <= lim) AS within_ FROM place_p1 JOIN lim USING (label) GROUP BY label),
        p2 AS (SELECT label, a, b FROM place_p1 JOIN lim USING (label) JOIN cnt USING (label) WHERE NOT (over_ > 0 AND within_ >= 500) OR d <= lim), {_turned("p2")},
        sc AS (SELECT label, quantile_cont(d, 0.96) AS k FROM place_p2 GROUP BY label)
        SELECT label, n, CAST(CASE WHEN over_ > 0 AND within_ >= 500 THEN over_ ELSE 0 END AS BIGINT) AS trimmed, round(mu * cos(turn) - mv * sin(turn), 5) AS center_a, round(mu * sin(turn) + mv * cos(turn), 5) AS center_b,
               round(greatest(ru, rv) * k, 5) AS major, round(least(ru, rv) * k, 5) AS minor, round(degrees(turn + CASE WHEN ru >= rv THEN 0 ELSE pi() / 2 END), 3) AS angle_deg
        FROM fit_p2 JOIN sc USING (label) JOIN cnt USING (label)""",
    "neutral_axis": f"""
        WITH {RGB_SQL}, px AS (SELECT vec_id // 64 AS sheet, g * 255 AS l, 128 + (r - g) * 40 AS a, 128 + (g - b) * 40 AS b FROM rgb),
        bands(band, lo, hi) AS (VALUES (0, 0, 16), (1, 16, 48), (2, 48, 96), (3, 96, 160), (4, 160, 208), (5, 208, 240), (6, 240, 256)),
        sizes AS (SELECT sheet, count(*) AS size FROM px GROUP BY sheet),
        drift AS (SELECT sheet, band, count(*) AS n, median(a - 128) AS ma, median(b - 128) AS mb FROM px JOIN bands ON l >= lo AND l < hi WHERE sqrt(pow(a - 128, 2) + pow(b - 128, 2)) <= 14 GROUP BY sheet, band)
        SELECT sheet, band, coalesce(n, 0) AS n, CASE WHEN n >= greatest(32, floor(size * 0.0005)) THEN round(-0.8 * ma, 6) ELSE 0.0 END AS da, CASE WHEN n >= greatest(32, floor(size * 0.0005)) THEN round(-0.8 * mb, 6) ELSE 0.0 END AS db
        FROM (SELECT sheet, size, band FROM sizes, bands) LEFT JOIN drift USING (sheet, band)""",
    "minimum_norm": """
        WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
        g AS (SELECT *, e[1] * e[1] + e[3] * e[3] + e[5] * e[5] AS aa, e[1] * e[2] + e[3] * e[4] + e[5] * e[6] AS ab, e[2] * e[2] + e[4] * e[4] + e[6] * e[6] AS bb FROM v),
        k AS (SELECT *, (bb * e[7] - ab * e[8]) / (aa * bb - ab * ab) AS p, (aa * e[8] - ab * e[7]) / (aa * bb - ab * ab) AS q FROM g)
        SELECT vec_id, round(-(e[1] * p + e[2] * q), 4) AS d0, round(-(e[3] * p + e[4] * q), 4) AS d1, round(-(e[5] * p + e[6] * q), 4) AS d2 FROM k""",
}
