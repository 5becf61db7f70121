"""Queries of colour adaptation, tone and lookup kernels, crop rectangles and calibration statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import kernels
from tessera.plans.tables import table


def adapted_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromatic adaptation of a colour per line, from a white given by its line to a fixed one; sums per return flag."""
    lines = table(spark, sf_dir, "lineitem")
    x, y = 0.30 + F.col("l_discount"), 0.31 + F.col("l_tax")
    colour = [F.col("l_quantity") / 50, F.col("l_linenumber") / 7, F.col("l_tax") * 10]
    found = kernels.bradford(colour, kernels.xy_to_xyz(x, y), kernels.xy_to_xyz(F.lit(0.3127), F.lit(0.3290)))
    return lines.select("l_returnflag", *[c.alias(n) for c, n in zip(found, "xyz", strict=True)]).groupBy("l_returnflag").agg(*[F.round(F.avg(n), 6).alias(n) for n in "xyz"])


def light_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the temperature of a light source number, with the share of the second illuminant at that temperature."""
    kelvin = kernels.light_source_kelvin(F.col("o_orderkey") % 27)
    share = kernels.reciprocal_blend(kelvin, F.lit(2850.0), F.lit(6500.0))
    return table(spark, sf_dir, "orders").groupBy(kelvin.alias("kelvin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(share), 6).alias("share"))


# Two curves of seven points and a shorter one, by temperature.
CURVES = ((3000.0, (0, 1, 2, 3, 2, 1, 0)), (4500.0, (1, 1, 1, 1, 1, 1, 1)), (6500.0, (0, -1, -2, -3, -2)))


def bucket_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves between temperature buckets per order: their length, sum and middle value."""
    kelvin = 2000 + F.col("o_totalprice") / 50
    curve = kernels.bucket_curve(kelvin, CURVES)
    found = table(spark, sf_dir, "orders").select("o_orderkey", curve.alias("c"))
    return found.select("o_orderkey", F.size("c").alias("size"), F.round(F.aggregate("c", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(F.element_at("c", 4), 6).alias("middle"))


def kelvin_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White balance gains of temperatures given by lines, averaged per line number."""
    red, _, blue = kernels.kelvin_gains(1500 + F.col("l_quantity") * 150)
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.round(F.avg(red), 6).alias("red"), F.round(F.avg(blue), 6).alias("blue"))


def filmic_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines' quantities through a 64-entry tone table made for each line number, the nearest entry taken."""
    contrast, toe, shoulder = (F.col("l_linenumber") - 1) * 0.1, F.col("l_linenumber") % 3 * 0.3, F.when(F.col("l_linenumber") > 3, 0.7).otherwise(0.0)
    points = table(spark, sf_dir, "lineitem").select("l_linenumber").distinct()
    grid = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: kernels.filmic(k / F.lit(63.0), contrast, toe, shoulder))
    tables = points.select("l_linenumber", grid.alias("curve"))
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity").join(tables, "l_linenumber")
    return rows.groupBy("l_linenumber").agg(F.round(F.avg(kernels.nearest_entry(F.col("l_quantity") / 50, F.col("curve"))), 6).alias("mean"))


KNOTS = ((0.0, 0.0), (0.2, 0.1), (0.6, 0.7), (1.0, 1.0))


def curve_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse of a piecewise-linear curve at each order's share of the largest price band."""
    y = F.col("o_totalprice") / 300_000 - 0.1
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(kernels.inverse(y, KNOTS), 6).alias("x"))


def cube_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 5x5x5 table at a position per line by tetrahedral interpolation, and a hue table of 12 entries round the circle."""
    cube = F.transform(F.sequence(F.lit(0), F.lit(124)), lambda n: F.floor(n / 25) * F.floor(n / 25) / 16 + (F.floor(n / 5) % 5) * (n % 5) / 8.0)
    position = [F.col("l_quantity") / 50, F.col("l_discount") * 9, F.col("l_tax") * 11]
    hue = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda n: (n * n % 12).cast("double"))
    angle = F.col("l_extendedprice") - 500
    value, turned = kernels.tetrahedral(F.col("cube"), 5, position), kernels.wrapped_linear(F.col("hue"), 12, angle)
    rows = table(spark, sf_dir, "lineitem").withColumns({"cube": cube, "hue": hue})
    return rows.select("l_orderkey", "l_linenumber", F.round(value, 6).alias("value"), F.round(turned, 5).alias("turned"))


def crop_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free and fixed-ratio rectangles within an image size per line."""
    width, height = (F.col("l_quantity") * 40 + 100).cast("int"), F.lit(800)
    box = [F.col("l_discount") * 20_000 - 300.25, F.col("l_tax") * 9000 + 0.25, F.col("l_extendedprice") / 30, F.lit(500.0) - F.col("l_linenumber") * 90]
    aspect = F.when(F.col("l_linenumber") % 3 == 0, 1.5).when(F.col("l_linenumber") % 3 == 1, 0.8)
    free = kernels.free_crop(width, height, box)
    fixed = kernels.ratio_crop(width, height, aspect, [F.col("l_discount") * 10, F.col("l_tax") * 12])
    names = ("x", "y", "w", "h")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[c.alias(f"free_{n}") for c, n in zip(free, names, strict=True)], *[c.alias(f"ratio_{n}") for c, n in zip(fixed, names, strict=True)])


def window_trims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line the summed shifts of all windows that contain its two keys, ends included."""
    windows = spark.createDataFrame([(0.0, 0.05, 0.0, 0.04, 1.0, -1.0), (0.03, 0.08, 0.02, 0.06, 0.5, 0.25), (0.05, 0.10, 0.0, 0.08, -2.0, 3.0)], "low1 double, high1 double, low2 double, high2 double, da double, db double")
    inside = F.col("l_discount").between(F.col("low1"), F.col("high1")) & F.col("l_tax").between(F.col("low2"), F.col("high2"))
    keys = table(spark, sf_dir, "lineitem").groupBy("l_discount", "l_tax").agg(F.count(F.lit(1)).alias("lines"))
    found = keys.join(F.broadcast(windows), inside, "left").groupBy("l_discount", "l_tax", "lines").agg(F.coalesce(F.sum("da"), F.lit(0.0)).alias("da"), F.coalesce(F.sum("db"), F.lit(0.0)).alias("db"))
    return found.select(F.round("l_discount", 2).alias("l_discount"), F.round("l_tax", 2).alias("l_tax"), "lines", "da", "db")


def robust_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Huber loss of value deviations and a ratio with a guarded divisor, per event type."""
    loss = kernels.huber((F.col("value") - 50) / 10, 1.0)
    ratio = kernels.guarded_ratio(F.col("value"), F.col("value") - 50, 5.0)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(loss), 6).alias("loss"), F.round(F.avg(ratio), 6).alias("ratio"))


def population_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event type the share of values inside an ellipse of value and hour, and the moments that fit one."""
    hour = F.hour("ts") / F.lit(1.0)
    distance = F.sqrt(F.pow((F.col("value") - 50) / 40, 2) + F.pow((hour - 12) / 8, 2))
    rows = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("v"), hour.alias("h"), (distance <= 1).cast("double").alias("inside"))
    spread, both, mean = F.var_samp("v"), F.covar_samp("v", "h"), F.var_samp("h")
    middle, root = (spread + mean) / 2, F.sqrt(F.pow((spread - mean) / 2, 2) + both * both)
    return rows.groupBy("event_type").agg(F.round(F.avg("inside"), 6).alias("rate"), F.round(F.sqrt(middle + root), 4).alias("long_axis"), F.round(F.sqrt(middle - root), 4).alias("short_axis"), F.round(0.5 * F.atan2(2 * both, spread - mean), 6).alias("angle"))


def luma_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line number: luma of three channels, its mean logarithm, and the share of lines with a channel at one or above."""
    r, g, b = F.col("l_quantity") / 45, F.col("l_discount") * 10, F.col("l_tax") * 12
    y = 0.2126 * r + 0.7152 * g + 0.0722 * b
    found = table(spark, sf_dir, "lineitem").select("l_linenumber", y.alias("y"), (F.greatest(r, g, b) >= 1).cast("double").alias("hot"))
    return found.groupBy("l_linenumber").agg(F.round(F.avg("y"), 6).alias("mean"), F.round(F.avg(F.log2(F.greatest("y", F.lit(1e-6)))), 5).alias("log_mean"), F.round(F.avg("hot"), 6).alias("hot"), F.round(F.max("y"), 6).alias("most"))


QUERIES = {f.__name__: f for f in (adapted_colours, light_sources, bucket_curves, kelvin_gains, filmic_lookup, curve_inverse, cube_lookup, crop_rectangles, window_trims, robust_losses, population_rates, luma_stats)}


def _row(matrix, k: int, names) -> str:
    return " + ".join(f"({m}) * {n}" for m, n in zip(matrix[k], names, strict=True))


_B, _I = kernels.BRADFORD, kernels.BRADFORD_INVERSE
_CONES = ", ".join(f"{_row(_B, k, ('cx', 'cy', 'cz'))} AS p{k}, {_row(_B, k, ('sx', '1.0', 'sz'))} AS s{k}, {_row(_B, k, ('(0.3127 / 0.3290)', '1.0', '((1 - 0.3127 - 0.3290) / 0.3290)'))} AS t{k}" for k in range(3))
_SCALED = ", ".join(f"p{k} * CASE WHEN s{k} > 0 THEN greatest(t{k}, 0.0) / s{k} ELSE 1.0 END AS a{k}" for k in range(3))


def _curve_sql(k: str) -> str:
    """Entry k (0 to 63) of the tone table of a line number."""
    step = "CASE WHEN {x} < 0 THEN 0 WHEN {x} > 1 THEN 1 ELSE {x} * {x} * (3 - 2 * {x}) END"
    return f"""WITH g AS (SELECT {k} / 63.0::DOUBLE AS x, (n - 1) * 0.1::DOUBLE AS c, n % 3 * 0.3::DOUBLE AS toe, CASE WHEN n > 3 THEN 0.7::DOUBLE ELSE 0.0 END AS sh),
        a AS (SELECT *, power(x, 1 / 2.2::DOUBLE) * CASE WHEN sh > 0 THEN 1 - ({step.format(x="((x - sh) / 0.25)")}) * 0.15 ELSE 1 END AS y0, CASE WHEN sh > 0 THEN 1 - ({step.format(x="((1 - sh) / 0.25)")}) * 0.15 ELSE 1 END AS top0, 1 + 6 * c AS q FROM g),
        b AS (SELECT *, 1 / (1 + exp(-q * (x - 0.5) * 2)) AS s, 1 / (1 + exp(q)) AS s0, 1 / (1 + exp(-q)) AS s1 FROM a),
        d AS (SELECT *, CASE WHEN c > 0 THEN (y0 * (1 - c * 0.5) + (s - s0) / (s1 - s0) * c * 0.5) / (top0 * (1 - c * 0.5) + c * 0.5) ELSE y0 END AS y1 FROM b)
        SELECT CASE WHEN x <= 0 THEN 0.0 WHEN x >= 1 THEN 1.0 ELSE least(1.0, greatest(0.0, (y1 + toe * 0.08) / (1 + toe * 0.08))) END FROM d"""


def _corner(di: str, dj: str, dk: str) -> str:
    return f"((i + {di}) * (i + {di}) / 16.0 + (j + {dj}) * (k + {dk}) / 8.0)"


ORACLES = {
    "adapted_colours": f"""
        WITH l AS (SELECT l_returnflag, l_quantity / 50 AS cx, l_linenumber / 7.0::DOUBLE AS cy, l_tax * 10 AS cz, (0.30 + l_discount) / (0.31 + l_tax) AS sx, (1 - (0.30 + l_discount) - (0.31 + l_tax)) / (0.31 + l_tax) AS sz FROM lineitem),
        c AS (SELECT l_returnflag, {_CONES} FROM l), a AS (SELECT l_returnflag, {_SCALED} FROM c)
        SELECT l_returnflag, {", ".join(f"round(avg({_row(_I, k, ('a0', 'a1', 'a2'))}), 6) AS {n}" for k, n in enumerate("xyz"))} FROM a GROUP BY l_returnflag""",
    "light_sources": f"""
        WITH k(code, kelvin) AS (VALUES {", ".join(f"({c}, {t}.0::DOUBLE)" for c, t in kernels.LIGHT_SOURCES.items())}), o AS (SELECT coalesce(kelvin, 0.0) AS kelvin FROM orders LEFT JOIN k ON o_orderkey % 27 = code)
        SELECT kelvin, count(*) AS n, round(max(CASE WHEN kelvin > 0 THEN least(1.0, greatest(0.0, (1 / kelvin - 1 / 2850.0::DOUBLE) / (1 / 6500.0::DOUBLE - 1 / 2850.0::DOUBLE))) ELSE 0.0 END), 6) AS share FROM o GROUP BY kelvin""",
    "bucket_curves": """
        WITH o AS (SELECT o_orderkey, 2000 + o_totalprice / 50 AS k FROM orders),
        c AS (SELECT o_orderkey, CASE WHEN k < 4500 THEN [0, 1, 2, 3, 2, 1, 0] ELSE [1, 1, 1, 1, 1, 1, 1] END AS a, CASE WHEN k < 4500 THEN [1, 1, 1, 1, 1, 1, 1] ELSE [0, -1, -2, -3, -2] END AS b,
              CASE WHEN k <= 3000 THEN 0 WHEN k < 4500 THEN (k - 3000) / 1500 WHEN k < 6500 THEN (k - 4500) / 2000 ELSE 1 END AS t, CASE WHEN k <= 3000 THEN 7 WHEN k < 4500 THEN 7 ELSE 5 END AS n FROM o),
        v AS (SELECT o_orderkey, n, list_transform(range(1, n + 1), lambda i: a[i] * (1 - t) + b[i] * t) AS c FROM c)
        SELECT o_orderkey, n AS size, round(list_sum(c), 6) AS total, round(c[4], 6) AS middle FROM v""",
    "kelvin_gains": """
        WITH l AS (SELECT l_linenumber, (1500 + l_quantity * 150) / 100 AS t FROM lineitem),
        c AS (SELECT l_linenumber, CASE WHEN t <= 66 THEN 255.0::DOUBLE ELSE 329.698727446 * power(t - 60, -0.1332047592) END AS r, CASE WHEN t <= 66 THEN 99.4708025861 * ln(t) - 161.1195681661 ELSE 288.1221695283 * power(t - 60, -0.0755148492) END AS g,
              CASE WHEN t >= 66 THEN 255.0::DOUBLE WHEN t <= 19 THEN 0.0 ELSE 138.5177312231 * ln(t - 10) - 305.0447927307 END AS b FROM l),
        d AS (SELECT l_linenumber, least(255.0, greatest(0.0, r)) / 255 AS r, greatest(least(255.0, greatest(0.0, g)) / 255, 1e-6) AS g, least(255.0, greatest(0.0, b)) / 255 AS b FROM c)
        SELECT l_linenumber, round(avg(r / g), 6) AS red, round(avg(b / g), 6) AS blue FROM d GROUP BY l_linenumber""",
    "filmic_lookup": f"""
        WITH l AS (SELECT l_linenumber AS n, CAST(floor(least(1.0, greatest(0.0, l_quantity / 50)) * 63 + 0.5) AS INT) AS k, count(*) AS lines FROM lineitem GROUP BY ALL),
        v AS (SELECT n, lines, ({_curve_sql("k")}) AS y FROM l) SELECT n AS l_linenumber, round(sum(y * lines) / sum(lines), 6) AS mean FROM v GROUP BY n""",
    "curve_inverse": """
        WITH o AS (SELECT o_orderkey, o_totalprice / 300000 - 0.1::DOUBLE AS y FROM orders)
        SELECT o_orderkey, round(CASE WHEN y <= 0 THEN 0.0 WHEN y <= 0.1 THEN y * 2 WHEN y <= 0.7 THEN 0.2::DOUBLE + (y - 0.1::DOUBLE) * (0.4::DOUBLE / 0.6::DOUBLE) WHEN y <= 1 THEN 0.6::DOUBLE + (y - 0.7::DOUBLE) * (0.4::DOUBLE / 0.3::DOUBLE) ELSE 1.0 END, 6) AS x FROM o""",
    "cube_lookup": f"""
        WITH p AS (SELECT l_orderkey, l_linenumber, least(1.0, greatest(0.0, l_quantity / 50)) * 4 AS u, least(1.0, greatest(0.0, l_discount * 9)) * 4 AS v, least(1.0, greatest(0.0, l_tax * 11)) * 4 AS w, l_extendedprice - 500 AS angle FROM lineitem),
        b AS (SELECT *, least(floor(u), 3) AS i, least(floor(v), 3) AS j, least(floor(w), 3) AS k FROM p),
        f AS (SELECT *, u - i AS a, v - j AS b, w - k AS c, ((angle % 360 + 360) % 360) / 30 AS turn FROM b),
        t AS (SELECT *, CASE
            WHEN a >= b AND b >= c THEN {_corner("0", "0", "0")} * (1 - a) + {_corner("1", "0", "0")} * (a - b) + {_corner("1", "1", "0")} * (b - c) + {_corner("1", "1", "1")} * c
            WHEN a >= c AND c >= b THEN {_corner("0", "0", "0")} * (1 - a) + {_corner("1", "0", "0")} * (a - c) + {_corner("1", "0", "1")} * (c - b) + {_corner("1", "1", "1")} * b
            WHEN c >= a AND a >= b THEN {_corner("0", "0", "0")} * (1 - c) + {_corner("0", "0", "1")} * (c - a) + {_corner("1", "0", "1")} * (a - b) + {_corner("1", "1", "1")} * b
            WHEN b >= a AND a >= c THEN {_corner("0", "0", "0")} * (1 - b) + {_corner("0", "1", "0")} * (b - a) + {_corner("1", "1", "0")} * (a - c) + {_corner("1", "1", "1")} * c
            WHEN b >= c AND c >= a THEN {_corner("0", "0", "0")} * (1 - b) + {_corner("0", "1", "0")} * (b - c) + {_corner("0", "1", "1")} * (c - a) + {_corner("1", "1", "1")} * a
            ELSE {_corner("0", "0", "0")} * (1 - c) + {_corner("0", "0", "1")} * (c - b) + {_corner("0", "1", "1")} * (b - a) + {_corner("1", "1", "1")} * a END AS value, CAST(floor(turn) AS INT) % 12 AS low, turn - floor(turn) AS share FROM f)
        SELECT l_orderkey, l_linenumber, round(value, 6) AS value, round((low * low % 12) * (1 - share) + ((low + 1) % 12 * ((low + 1) % 12) % 12) * share, 5) AS turned FROM t""",
    "crop_rectangles": """
        WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 40 + 100 AS INT) AS w, 800 AS h, round_even(l_discount * 20000 - 300.25, 0) AS x, round_even(l_tax * 9000 + 0.25, 0) AS y, round_even(l_extendedprice / 30, 0) AS cw,
                   round_even(500.0::DOUBLE - l_linenumber * 90, 0) AS ch, l_extendedprice > 0 AND l_linenumber <= 5 AS ok, CASE l_linenumber % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 0.8::DOUBLE END AS r, l_discount * 10 AS px, l_tax * 12 AS py FROM lineitem),
        f AS (SELECT *, least(greatest(x, 0.0), w - 1) AS x0, least(greatest(y, 0.0), h - 1) AS y0,
              CASE WHEN w / h::DOUBLE >= r THEN least(greatest(1.0, round_even(h * r, 0)), w) ELSE w END AS rw, CASE WHEN w / h::DOUBLE >= r THEN h ELSE least(greatest(1.0, round_even(w / r, 0)), h) END AS rh FROM l)
        SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN x0 ELSE 0 END::INT AS free_x, CASE WHEN ok THEN y0 ELSE 0 END::INT AS free_y, CASE WHEN ok THEN least(greatest(cw, 1.0), greatest(w - x0, 1.0)) ELSE w END::INT AS free_w, CASE WHEN ok THEN least(greatest(ch, 1.0), greatest(h - y0, 1.0)) ELSE h END::INT AS free_h,
               CASE WHEN r IS NULL THEN 0 ELSE least(greatest(round_even(px * w - rw / 2, 0), 0.0), w - rw) END::INT AS ratio_x, CASE WHEN r IS NULL THEN 0 ELSE least(greatest(round_even(py * h - rh / 2, 0), 0.0), h - rh) END::INT AS ratio_y,
               CASE WHEN r IS NULL THEN w ELSE rw END::INT AS ratio_w, CASE WHEN r IS NULL THEN h ELSE rh END::INT AS ratio_h FROM f""",
    "window_trims": """
        WITH w(low1, high1, low2, high2, da, db) AS (VALUES (0.0::DOUBLE, 0.05::DOUBLE, 0.0::DOUBLE, 0.04::DOUBLE, 1.0::DOUBLE, -1.0::DOUBLE), (0.03, 0.08, 0.02, 0.06, 0.5, 0.25), (0.05, 0.10, 0.0, 0.08, -2.0, 3.0)),
        k AS (SELECT l_discount, l_tax, count(*) AS lines FROM lineitem GROUP BY ALL)
        SELECT round(l_discount, 2) AS l_discount, round(l_tax, 2) AS l_tax, lines, coalesce(sum(da), 0.0) AS da, coalesce(sum(db), 0.0) AS db FROM k LEFT JOIN w ON l_discount BETWEEN low1 AND high1 AND l_tax BETWEEN low2 AND high2 GROUP BY k.l_discount, k.l_tax, lines""",
    "robust_losses": """
        WITH e AS (SELECT event_type, value, abs((value - 50) / 10) AS a, value - 50 AS d FROM events)
        SELECT event_type, round(avg(CASE WHEN a <= 1 THEN 0.5 * a * a ELSE a - 0.5 END), 6) AS loss, round(avg(value / CASE WHEN abs(d) < 5 THEN CASE WHEN d < 0 THEN -5 ELSE 5 END ELSE d END), 6) AS ratio FROM e GROUP BY event_type""",
    "population_rates": """
        WITH e AS (SELECT event_type, value AS v, hour(ts)::DOUBLE AS h FROM events),
        s AS (SELECT event_type, avg(CASE WHEN sqrt(power((v - 50) / 40, 2) + power((h - 12) / 8, 2)) <= 1 THEN 1.0 ELSE 0.0 END) AS rate, var_samp(v) AS a, var_samp(h) AS b, covar_samp(v, h) AS c FROM e GROUP BY event_type)
        SELECT event_type, round(rate, 6) AS rate, round(sqrt((a + b) / 2 + sqrt(power((a - b) / 2, 2) + c * c)), 4) AS long_axis, round(sqrt((a + b) / 2 - sqrt(power((a - b) / 2, 2) + c * c)), 4) AS short_axis, round(0.5 * atan2(2 * c, a - b), 6) AS angle FROM s""",
    "luma_stats": """
        WITH l AS (SELECT l_linenumber, l_quantity / 45 AS r, l_discount * 10 AS g, l_tax * 12 AS b FROM lineitem), y AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS y FROM l)
        SELECT l_linenumber, round(avg(y), 6) AS mean, round(avg(log2(greatest(y, 1e-6))), 5) AS log_mean, round(avg(CASE WHEN greatest(r, g, b) >= 1 THEN 1.0 ELSE 0.0 END), 6) AS hot, round(max(y), 6) AS most FROM y GROUP BY l_linenumber""",
}
