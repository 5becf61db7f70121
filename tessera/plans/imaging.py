"""Queries of whole images: sheets of up to 64 x 64 values, each made of 64 neighbouring embeddings as its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import imaging
from tessera.plans.tables import table

SHEET_ROWS = 64


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sheet, height, width, values on 0..255): the embeddings of 64 neighbouring ids, one a row, in order of id."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / SHEET_ROWS).alias("sheet"), F.struct("vec_id", "embedding").alias("row"))
    unit = F.flatten(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["embedding"]))
    values = F.transform(unit, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), v.cast("double") * 300 + 127.5)))
    return rows.groupBy("sheet").agg(F.count("row").cast("int").alias("height"), F.lit(64).alias("width"), values.alias("values"))


SHEETS_SQL = """
    numbered AS (SELECT vec_id // 64 AS sheet, row_number() OVER (PARTITION BY vec_id // 64 ORDER BY vec_id) - 1 AS y, embedding FROM embeddings),
    px AS (SELECT sheet, y, x - 1 AS x, greatest(0.0, least(255.0, CAST(embedding[x] AS DOUBLE) * 300 + 127.5)) AS v FROM numbered, (SELECT unnest(range(1, 65)) AS x)),
    sizes AS (SELECT sheet, max(y) + 1 AS h, 64 AS w FROM px GROUP BY sheet)
"""


def colour_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sheet, height, width, values): the sheets as rows of 20 colours on 0..1, the last four values of a row unused."""
    cut = F.flatten(F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.slice("values", y * 64 + 1, 60)))
    return sheets(spark, sf_dir).select("sheet", "height", F.lit(20).alias("width"), F.transform(cut, lambda v: v / 255).alias("values"))


def sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laplacian variance before and after a median, the noise ratio and the share of high frequencies."""
    found = imaging.sharpness(sheets(spark, sf_dir), radius=20.0)
    return found.select("sheet", F.round("lap_raw", 3).alias("lap_raw"), F.round("lap_denoised", 3).alias("lap_denoised"), F.round("noise_ratio", 6).alias("noise_ratio"), F.round("high_share", 6).alias("high_share"))


def motion_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction and strength of motion blur by the spectrum over 36 directions."""
    return imaging.motion_blur(sheets(spark, sf_dir)).select("sheet", "angle", F.round("strength", 6).alias("strength"), "blurred")


def horizon_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The angle that levels each sheet's main edges, by a sweep of projections."""
    found = imaging.horizons(sheets(spark, sf_dir))
    return found.select("sheet", "horizon_angle", F.round("horizon_confidence", 6).alias("horizon_confidence"))


def horizon_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The horizon by votes of the lines along the edges of each embedding as 8 x 8 values."""
    from tessera.plans.measure import pixel_rows

    lines = imaging.edge_lines(pixel_rows(spark, sf_dir), "vec_id", 30.0).withColumn("sky", F.when(F.col("vec_id") % 2 == 0, 0.5).otherwise(0.1))
    found = imaging.line_votes(lines, "vec_id", 2, F.col("sky"))
    return found.select("vec_id", F.round("angle", 6).alias("angle"), F.round("confidence", 6).alias("confidence"), "votes", "has_horizon")


def _asked() -> list[Column]:
    turn = F.col("sheet") % 5
    return [F.when(turn == 1, 90.0).when(turn == 2, 10.0).otherwise(0.0).alias("rotation"), (F.col("sheet") % 2 == 0).alias("across"), (turn == 3).alias("down"), (turn == 4).alias("level")]


def image_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets flipped, turned or levelled, as pixels."""
    whole = sheets(spark, sf_dir).select("*", *_asked())
    found = imaging.compose(whole, "rotation", "across", "down", "level")
    return found.select("sheet", "turn", F.posexplode("values").alias("place", "v")).select("sheet", "turn", "place", F.round("v", 6).alias("v"))


def image_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets flipped both ways or one, as pixels."""
    whole = sheets(spark, sf_dir).select("*", F.lit(0.0).alias("rotation"), (F.col("sheet") % 2 == 0).alias("across"), (F.col("sheet") % 3 == 0).alias("down"), F.lit(False).alias("level"))
    found = imaging.compose(whole, "rotation", "across", "down", "level")
    return found.select("sheet", F.posexplode("values").alias("place", "v")).select("sheet", F.col("place").cast("long").alias("place"), F.round("v", 6).alias("v"))


def region_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two regional edits a colour sheet, one after the other, under feathered masks made of its own values: pixels and coverage."""
    whole = colour_sheets(spark, sf_dir)
    luma = F.transform(F.sequence(F.lit(0), F.col("height") * 20 - 1), lambda p: F.element_at("values", 3 * p + 2))
    bright, dark = F.transform(luma, lambda v: (v > 0.5).cast("double")), F.transform(luma, lambda v: 1 - v)

    def region(name: str, exposure: float, saturation: float, warmth: float, mask: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.lit(exposure).alias("exposure"), F.lit(saturation).alias("saturation"), F.lit(warmth).alias("warmth"), F.col("height").alias("height"), F.lit(20).alias("width"), mask.alias("mask"))

    asked = F.array(region("sky", 0.5, 0.3, -0.4, bright), region("face", -0.3, 0.0, 0.5, dark), region("none", 0.0, 0.0, 0.0, dark))
    found = imaging.apply_regions(whole.withColumn("regions", asked), "regions")
    cover = F.map_from_arrays("regions_applied", F.transform("mask_coverage", lambda c: F.round(c, 6)))
    return found.select("sheet", F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.array_join("regions_applied", ",").alias("applied"), F.element_at(cover, F.lit("sky")).alias("sky_cover"), F.element_at(cover, F.lit("face")).alias("face_cover"))


def masked_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour sheets smoothed where they are dark."""
    whole = colour_sheets(spark, sf_dir)
    mask = F.transform(F.sequence(F.lit(0), F.col("height") * 20 - 1), lambda p: (F.element_at("values", 3 * p + 2) < 0.5).cast("double"))
    found = imaging.masked_smoothing(whole.withColumn("mask", mask), "mask", 0.5)
    return found.select("sheet", F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.round("smoothed", 6).alias("smoothed"))


def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour sheets sharpened in luma and denoised in colour at a quarter of the size: mean and spread of the channels."""
    found = imaging.refined(colour_sheets(spark, sf_dir), 0.1, 1.0, 0.5).select("sheet", F.posexplode("values").alias("place", "v"))
    return found.groupBy("sheet", (F.col("place") % 3).alias("channel")).agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("spread"))


QUERIES = {"sharpness": sharpness, "motion_blur": motion_blur, "horizon_sweep": horizon_sweep, "horizon_votes": horizon_votes, "image_compose": image_compose, "image_flips": image_flips, "region_edits": region_edits, "masked_smoothing": masked_smoothing, "detail": detail}

_SPECTRUM_SQL = """
    across AS (SELECT sheet, y, u, sum(v * cos(2 * pi() * u * x / 64)) AS re, sum(-v * sin(2 * pi() * u * x / 64)) AS im FROM px, (SELECT unnest(range(0, 64)) AS u) GROUP BY sheet, y, u),
    spectrum AS (
        SELECT sheet, h, (t + h // 2) % h AS fy, (u + 32) % 64 AS fx,
               sqrt(pow(sum(re * cos(2 * pi() * t * y / h) + im * sin(2 * pi() * t * y / h)), 2) + pow(sum(im * cos(2 * pi() * t * y / h) - re * sin(2 * pi() * t * y / h)), 2)) AS mag
        FROM across JOIN sizes USING (sheet), (SELECT unnest(range(0, 64)) AS t) WHERE t < h GROUP BY sheet, h, t, u
    )
"""

ORACLES = {
    "sharpness": f"""
        WITH {SHEETS_SQL}, {_SPECTRUM_SQL},
        calm AS (
            SELECT a.sheet, a.y, a.x, median(b.v) AS v FROM px a JOIN sizes USING (sheet), (SELECT unnest(range(-2, 3)) AS dy) ys, (SELECT unnest(range(-2, 3)) AS dx) xs
            JOIN px b ON b.sheet = a.sheet AND b.y = greatest(0, least(h - 1, a.y + dy)) AND b.x = greatest(0, least(63, a.x + dx)) GROUP BY a.sheet, a.y, a.x
        ), both_ AS (SELECT 0 AS kind, * FROM px UNION ALL SELECT 1, * FROM calm
        ), lap AS (
            SELECT a.kind, a.sheet, a.y, a.x, sum(b.v * k) AS v
            FROM both_ a JOIN sizes USING (sheet), (VALUES (0, 0, -4.0), (0, 1, 1.0), (0, -1, 1.0), (1, 0, 1.0), (-1, 0, 1.0)) AS o(dy, dx, k)
            JOIN both_ b ON b.kind = a.kind AND b.sheet = a.sheet
                 AND b.y = CASE WHEN h = 1 THEN 0 WHEN a.y + dy < 0 THEN 1 WHEN a.y + dy >= h THEN h - 2 ELSE a.y + dy END
                 AND b.x = CASE WHEN a.x + dx < 0 THEN 1 WHEN a.x + dx > 63 THEN 62 ELSE a.x + dx END
            GROUP BY a.kind, a.sheet, a.y, a.x
        ), var AS (SELECT sheet, var_pop(v) FILTER (kind = 0) AS raw, var_pop(v) FILTER (kind = 1) AS calm FROM lap GROUP BY sheet
        ), high AS (SELECT sheet, sum(mag) FILTER (pow(fy - h // 2, 2) + pow(fx - 32, 2) > 400) / sum(mag) AS share FROM spectrum GROUP BY sheet)
        SELECT sheet, round(raw, 3) AS lap_raw, round(calm, 3) AS lap_denoised, round(greatest(0.0, least(1.0, (raw - calm) / greatest(raw, 1e-6))), 6) AS noise_ratio, round(coalesce(share, 0.0), 6) AS high_share
        FROM var JOIN high USING (sheet)
    """,
    "motion_blur": f"""
        WITH {SHEETS_SQL}, {_SPECTRUM_SQL},
        rays AS (
            SELECT sheet, h, a * 5 AS angle, CAST(trunc(round(h // 2 + s * r * sin(radians(a * 5)), 9)) AS BIGINT) AS fy, CAST(trunc(round(32 + s * r * cos(radians(a * 5)), 9)) AS BIGINT) AS fx
            FROM sizes, (SELECT unnest(range(0, 36)) AS a), (SELECT unnest(range(5, 64, 2)) AS r), (VALUES (1), (-1)) AS sides(s)
            WHERE r < least(32, h // 2) - 5 AND least(32, h // 2) - 5 > 5
        ), means AS (SELECT sheet, angle, avg(ln(1 + mag)) AS m FROM rays JOIN spectrum USING (sheet, fy, fx) GROUP BY sheet, angle
        ), found AS (SELECT sheet, arg_min(angle, (round(m, 9), angle)) AS angle, least(1.0, 10 * stddev_pop(m) / avg(m)) AS strength FROM means GROUP BY sheet)
        SELECT sheet, CAST(coalesce(angle, 0) AS DOUBLE) AS angle, round(coalesce(strength, 0.0), 6) AS strength, coalesce(strength, 0.0) > 0.35 AS blurred FROM sizes LEFT JOIN found USING (sheet)
    """,
    "image_flips": f"""
        WITH {SHEETS_SQL}
        SELECT sheet, CAST((CASE WHEN sheet % 3 = 0 THEN h - 1 - y ELSE y END) * 64 + CASE WHEN sheet % 2 = 0 THEN 63 - x ELSE x END AS BIGINT) AS place, round(v, 6) AS v
        FROM px JOIN sizes USING (sheet)
    """,
    "horizon_votes": """
        WITH px AS (SELECT vec_id, (pos - 1) // 8 AS y, (pos - 1) % 8 AS x, CAST(embedding[pos] AS DOUBLE) * 300 + 127.5 AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS pos)
        ), slopes AS (
            SELECT vec_id, lead(v) OVER row_ - lag(v) OVER row_ AS dx, lead(v) OVER col_ - lag(v) OVER col_ AS dy
            FROM px WINDOW row_ AS (PARTITION BY vec_id, y ORDER BY x), col_ AS (PARTITION BY vec_id, x ORDER BY y)
        ), lines AS (SELECT vec_id, dy AS lx, -dx AS ly FROM slopes WHERE sqrt(dx * dx + dy * dy) >= 30
        ), slants AS (SELECT vec_id, CASE WHEN abs(lx) >= 1e-6 THEN degrees(atan2(ly, lx)) END AS s FROM lines
        ), folded AS (SELECT vec_id, CASE WHEN abs(s) <= 15 THEN s WHEN abs(abs(s) - 180) <= 15 THEN s - 180 * sign(s) END AS a FROM slants
        ), bins AS (SELECT vec_id, least(floor((a + 15) / 3), 9) AS bin, count(a) AS n, avg(a) FILTER (a < 15) AS mean FROM folded GROUP BY vec_id, bin
        ), best AS (SELECT vec_id, CAST(sum(n) AS BIGINT) AS all_votes, arg_max(n, (n, -coalesce(bin, 99))) AS n, arg_max(mean, (n, -coalesce(bin, 99))) AS mean FROM bins GROUP BY vec_id)
        SELECT vec_id, CASE WHEN n >= 2 THEN round(mean, 6) ELSE 0.0 END AS angle,
               CASE WHEN n >= 2 THEN round(least(1.0, least(1.0, n / 6.0) + CASE WHEN vec_id % 2 = 0 THEN 0.2 ELSE 0.0 END), 6) ELSE 0.0 END AS confidence,
               CASE WHEN n >= 2 THEN n ELSE all_votes END AS votes, n >= 2 AS has_horizon
        FROM best
    """,
}
