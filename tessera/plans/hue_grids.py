"""Queries of colour deformations by scattered points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import color
from tessera.operators import hue_grid
from tessera.operators.corpus import interpolate
from tessera.plans.measure import _OK, rgb_pixels

#: A coarse grid, so that SQL can follow; its chroma reach.
GRID, REACH = (12, 6, 6), 0.37
ENVELOPE = ((0.0, 0.0), (0.45, 0.3), (0.7, 0.32), (1.0, 0.0))


def _lch(rows: DataFrame) -> DataFrame:
    ok_l, ok_a, ok_b = color.srgb_to_oklab(F.col("r"), F.col("g"), F.col("b"))
    chroma, hue = color.polar(F.col("ok_a"), F.col("ok_b"))
    return rows.select("*", ok_l.alias("ok_l"), ok_a.alias("ok_a"), ok_b.alias("ok_b")).select("*", chroma.alias("chroma"), hue.alias("hue"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control points: the first colour of every embedding, moved by what its values say."""
    first = _lch(rgb_pixels(spark, sf_dir).where("n = 0"))
    return first.select(F.col("hue").alias("h"), F.col("chroma").alias("c"), F.col("ok_l").alias("l"), ((F.col("r") - 0.5) * 20).alias("dh"), (1 + (F.col("g") - 0.5) * 0.4).alias("c_gain"), (1 + (F.col("b") - 0.5) * 0.2).alias("l_gain"))


def hue_grid_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of all control points."""
    found = hue_grid.rasterized(points(spark, sf_dir), GRID, REACH)
    return found.select("node", *[F.round(c, 6).alias(c) for c in hue_grid.POINT[3:]])


def hue_grid_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the grid says at every pixel: hue turn and gains, by trilinear lookup with hue as a ring."""
    table = hue_grid.table_of(hue_grid.rasterized(points(spark, sf_dir), GRID, REACH), GRID)
    places = _lch(rgb_pixels(spark, sf_dir)).select("vec_id", "n", "hue", (F.col("chroma") / REACH * 6 - 0.5).alias("at_c"), (F.col("ok_l") * 6 - 0.5).alias("at_l"))
    found = hue_grid.looked_up(places, table, "hue", "at_c", "at_l")
    return found.select("vec_id", "n", *[F.round(c, 5).alias(c) for c in hue_grid.POINT[3:]])


def _most(lightness: Column) -> Column:
    return interpolate(lightness, ENVELOPE)


def hue_grid_deform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel's colour after the deformation at four fifths of its strength."""
    table = hue_grid.table_of(hue_grid.rasterized(points(spark, sf_dir), GRID, REACH), GRID)
    found = hue_grid.deformed(rgb_pixels(spark, sf_dir), table, _most(F.col("ok_l")), 0.8)
    return found.select("vec_id", "n", *[F.round(c, 6).alias(c) for c in "rgb"])


QUERIES = {f.__name__: f for f in (hue_grid_nodes, hue_grid_lookup, hue_grid_deform)}

_NODES_SQL = f"""
    {_OK},
    points AS (SELECT hue AS h, chroma AS c, ok_l AS l, (r - 0.5) * 20 AS dh, 1 + (g - 0.5) * 0.4 AS c_gain, 1 + (b - 0.5) * 0.2 AS l_gain FROM lch WHERE n = 0),
    width AS (SELECT pow(2 * pi() / count(*), 1.0 / 3) AS s FROM points),
    grid AS (SELECT i, j, k, (i * 6 + j) * 6 + k AS node, (i + 0.5) / 12.0 * 2 * pi() AS gh, (j + 0.5) / 6.0 AS gc, (k + 0.5) / 6.0 AS gl FROM (SELECT unnest(range(0, 12)) AS i), (SELECT unnest(range(0, 6)) AS j), (SELECT unnest(range(0, 6)) AS k)),
    rings AS (SELECT g.*, p.*, s, abs((gh - radians(h) + 3 * pi()) - 2 * pi() * floor((gh - radians(h) + 3 * pi()) / (2 * pi())) - pi()) AS ring FROM grid g, points p, width),
    apart AS (SELECT *, ring * ring + pow(gc - c / {REACH}::DOUBLE, 2) + pow(gl - l, 2) AS d2 FROM rings),
    weights AS (SELECT *, exp(-d2 / (2 * s * s)) AS w FROM apart),
    nodes AS (
        SELECT node, i, j, k, {", ".join(f"CASE WHEN min(d2) < 1e-12 OR sum(w) = 0 THEN arg_min({c}, (d2, dh, c_gain, l_gain)) ELSE sum(w * {c}) / sum(w) END AS {c}" for c in hue_grid.POINT[3:])}
        FROM weights GROUP BY node, i, j, k
    )
"""

_MEANS = ", ".join(f"sum(wh * wc * wl * {c})" + " AS " + c for c in hue_grid.POINT[3:])

ORACLES = {
    "hue_grid_nodes": f"WITH {_NODES_SQL} SELECT node, round(dh, 6) AS dh, round(c_gain, 6) AS c_gain, round(l_gain, 6) AS l_gain FROM nodes",
    "hue_grid_lookup": f"""
        WITH {_NODES_SQL},
        places AS (SELECT vec_id, n, hue / 360 * 12 AS ph, greatest(0.0, least(5.0, chroma / {REACH}::DOUBLE * 6 - 0.5)) AS pc, greatest(0.0, least(5.0, ok_l * 6 - 0.5)) AS pl FROM lch),
        corners AS (
            SELECT vec_id, n, (CAST(floor(ph) AS BIGINT) + a) % 12 AS i, CASE WHEN a = 1 THEN ph - floor(ph) ELSE 1 - ph + floor(ph) END AS wh,
                   least(CAST(floor(pc) AS BIGINT) + b, 5) AS j, CASE WHEN b = 1 THEN pc - floor(pc) ELSE 1 - pc + floor(pc) END AS wc,
                   least(CAST(floor(pl) AS BIGINT) + c, 5) AS k, CASE WHEN c = 1 THEN pl - floor(pl) ELSE 1 - pl + floor(pl) END AS wl
            FROM places, (VALUES (0), (1)) AS xs(a), (VALUES (0), (1)) AS ys(b), (VALUES (0), (1)) AS zs(c)
        )
        SELECT vec_id, n, round(dh, 5) AS dh, round(c_gain, 5) AS c_gain, round(l_gain, 5) AS l_gain
        FROM (SELECT vec_id, n, {_MEANS} FROM corners JOIN nodes USING (i, j, k) GROUP BY vec_id, n)
    """,
}
