"""Queries of colour temperatures, tints and camera gains, made of the colours of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import white_balance
from tessera.plans.measure import RGB_SQL, rgb_pixels

#: A camera under incandescent light and daylight.
CAMERA = white_balance.Profile((0.92, -0.34, -0.06, -0.43, 1.26, 0.18, -0.06, 0.15, 0.64), (0.80, -0.26, -0.07, -0.44, 1.25, 0.21, -0.09, 0.19, 0.67))


def _gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, n, r, g, b, red, green, blue): every colour with gains from 1 to 3 made of it."""
    return rgb_pixels(spark, sf_dir).select("*", (1 + 2 * F.col("r")).alias("red"), F.lit(1.0).alias("green"), (1 + 2 * F.col("b")).alias("blue"))


def kelvin_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlated temperature of the first colour of every embedding, taken as a chromaticity."""
    xy = rgb_pixels(spark, sf_dir).where("n = 0").select("vec_id", (0.25 + 0.3 * F.col("r")).alias("x"), (0.25 + 0.2 * F.col("g")).alias("y"))
    return white_balance.kelvins(xy, "x", "y").select("vec_id", F.round("kelvin", 2).alias("kelvin"))


def light_of_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The light that a camera's gains belong to, by the fixed point."""
    found = white_balance.light_of(_gains(spark, sf_dir), ["red", "green", "blue"], CAMERA)
    return found.select("vec_id", "n", *[F.round(f"light_{c}", 6).alias(f"light_{c}") for c in "xy"], F.round("light_kelvin", 2).alias("light_kelvin"))


def kelvin_tint_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of temperatures and tints made of the colours."""
    asked = rgb_pixels(spark, sf_dir).select("vec_id", "n", (2000 + 8000 * F.col("r")).alias("kelvin"), (300 * F.col("g") - 150).alias("tint"))
    found = white_balance.gains(asked, "kelvin", "tint", CAMERA)
    return found.select("vec_id", "n", F.round("gain_r", 6).alias("gain_r"), F.round("gain_b", 6).alias("gain_b"))


def kelvin_tint_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature and tint of every embedding's first gains, and how far their gains are off."""
    found = white_balance.kelvins_tints(_gains(spark, sf_dir).where("n = 0"), "red", "blue", CAMERA)
    return found.select("vec_id", F.round("kelvin", 1).alias("kelvin"), F.round("tint", 2).alias("tint"), F.round("gain_miss", 6).alias("gain_miss"))


def camera_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced camera colours as XYZ under D50, each with its own gains, and the camera's white."""
    found = white_balance.camera_to_xyz(_gains(spark, sf_dir), ["r", "g", "b"], ["red", "green", "blue"], CAMERA)
    found = white_balance.camera_white(found, ["red", "green", "blue"], CAMERA)
    return found.select("vec_id", "n", *[F.round(c, 5).alias(c) for c in ("x", "y", "z", "white_r", "white_g", "white_b")])


QUERIES = {f.__name__: f for f in (kelvin_nearest, light_of_gains, kelvin_tint_gains, kelvin_tint_solved, camera_colours)}


def _locus_sql(source: str) -> str:
    """x and y of the locus at t of a source."""
    x = "CASE WHEN t <= 4000 THEN -0.2661239e9 / (t * t * t) - 0.2343589e6 / (t * t) + 0.8776956e3 / t + 0.179910::DOUBLE ELSE -3.0258469e9 / (t * t * t) + 2.1070379e6 / (t * t) + 0.2226347e3 / t + 0.240390::DOUBLE END"
    cubics = [(2222, (-1.1063814, -1.34811020, 2.18555832, -0.20219683)), (4000, (-0.9549476, -1.37418593, 2.09137015, -0.16748867)), (None, (3.0817580, -5.87338670, 3.75112997, -0.37001483))]
    cases = " ".join(f"{'WHEN t <= ' + str(top) + ' THEN' if top else 'ELSE'} {a}::DOUBLE * x * x * x + {b}::DOUBLE * x * x + {c}::DOUBLE * x + {d}::DOUBLE" for top, (a, b, c, d) in cubics)
    return f"SELECT *, CASE {cases} END AS y FROM (SELECT *, {x} AS x FROM {source})"


def _blend_sql(row: int) -> str:
    first, second = CAMERA.first[3 * row : 3 * row + 3], CAMERA.second[3 * row : 3 * row + 3]
    return " + ".join(f"((1 - s) * ({a}::DOUBLE) + s * ({b}::DOUBLE)) * {v}" for a, b, v in zip(first, second, ("x2 / y2", "1", "(1 - x2 - y2) / y2"), strict=True))


ORACLES = {
    "kelvin_nearest": f"""
        WITH {RGB_SQL}, steps AS (SELECT k AS place, 1600.0::DOUBLE + 5 * k AS kelvin, greatest(1600.0::DOUBLE + 5 * k, 1667.0) AS t FROM (SELECT unnest(range(0, 4680)) AS k)),
        line AS (SELECT place, kelvin, 4 * x / (-2 * x + 12 * y + 3) AS u, 6 * y / (-2 * x + 12 * y + 3) AS v FROM ({_locus_sql("steps")})),
        asked AS (SELECT vec_id, 0.25::DOUBLE + 0.3::DOUBLE * r AS x, 0.25::DOUBLE + 0.2::DOUBLE * g AS y FROM rgb WHERE n = 0),
        uv AS (SELECT vec_id, 4 * x / (-2 * x + 12 * y + 3) AS u, 6 * y / (-2 * x + 12 * y + 3) AS v FROM asked),
        best AS (SELECT uv.*, arg_min(place, (pow(line.u - uv.u, 2) + pow(line.v - uv.v, 2), place)) AS place FROM uv, line GROUP BY ALL),
        three AS (SELECT vec_id, u, v, greatest(0, least(4677, place - 1)) AS low FROM best),
        d AS (SELECT vec_id, low, max(pow(line.u - three.u, 2) + pow(line.v - three.v, 2)) FILTER (place = low) AS d0, max(pow(line.u - three.u, 2) + pow(line.v - three.v, 2)) FILTER (place = low + 1) AS d1,
                     max(pow(line.u - three.u, 2) + pow(line.v - three.v, 2)) FILTER (place = low + 2) AS d2 FROM three JOIN line ON place BETWEEN low AND low + 2 GROUP BY ALL)
        SELECT vec_id, round(greatest(1600.0, least(25000.0, 1605.0::DOUBLE + 5 * low + CASE WHEN d0 - 2 * d1 + d2 <> 0 THEN 5 * (d0 - d2) / (2 * (d0 - 2 * d1 + d2)) ELSE 0 END)), 2) AS kelvin FROM d""",
    "kelvin_tint_gains": f"""
        WITH {RGB_SQL}, asked AS (SELECT vec_id, n, greatest(2000 + 8000 * r, 1667.0) AS t, 300 * g - 150 AS tint FROM rgb),
        uv AS (SELECT vec_id, n, 4 * x / (-2 * x + 12 * y + 3) AS u, 6 * y / (-2 * x + 12 * y + 3) + tint / 150 * 0.010::DOUBLE AS v FROM ({_locus_sql("asked")})),
        xy AS (SELECT vec_id, n, greatest(0.05::DOUBLE, least(0.75::DOUBLE, 3 * u / (2 * u - 8 * v + 4))) AS x2, greatest(0.05::DOUBLE, least(0.75::DOUBLE, 2 * v / (2 * u - 8 * v + 4))) AS y2 FROM uv),
        m AS (SELECT *, (x2 - 0.3320::DOUBLE) / (y2 - 0.1858::DOUBLE) AS k FROM xy), c AS (SELECT *, -449.0 * k * k * k + 3525.0 * k * k - 6823.3 * k + 5520.33 AS cct FROM m),
        s AS (SELECT *, CASE WHEN cct > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1 / cct - 1 / 2850.0::DOUBLE) / (1 / 6500.0::DOUBLE - 1 / 2850.0::DOUBLE))) ELSE 0 END AS s FROM c),
        w AS (SELECT vec_id, n, greatest(1e-6, {_blend_sql(0)}) AS a, greatest(1e-6, {_blend_sql(1)}) AS b, greatest(1e-6, {_blend_sql(2)}) AS c FROM s)
        SELECT vec_id, n, round(b / a, 6) AS gain_r, round(b / c, 6) AS gain_b FROM w""",
}
