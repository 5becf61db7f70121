"""Queries of boxes, crops, resampling, curves and robust fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import fits, geometry, measure, stretches
from tessera.plans.measure import PIXELS_SQL, RGB_SQL, pixel_rows, rgb_pixels
from tessera.plans.tables import table

RATIOS = (1.0, 1.5)


def mask_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding box of the bright pixels of every image."""
    found = geometry.extents(pixel_rows(spark, sf_dir), ["vec_id"], F.col("v") > 180, 8, 8)
    return found


def crop_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best crop per image and ratio that keeps 95 % of the bright box."""
    boxes = geometry.extents(pixel_rows(spark, sf_dir), ["vec_id"], F.col("v") > 200, 8, 8)
    return geometry.best_windows(boxes, ["vec_id"], RATIOS, 0.95)


def area_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images at half size by block means."""
    return geometry.downsample(pixel_rows(spark, sf_dir), "vec_id", 2).withColumn("v", F.round("v", 5))


def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image rows at a width of five by linear taps."""
    return geometry.resample_rows(pixel_rows(spark, sf_dir), "vec_id", 8, 5).withColumn("v", F.round("v", 5))


def merge_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' balances as knots per nation, those within 150 merged."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal", F.col("s_suppkey").cast("double").alias("v"))
    found = geometry.merge_near(rows, "s_nationkey", "s_acctbal", "v", 150.0)
    return found.select("s_nationkey", "knot", F.round("s_acctbal", 4).alias("s_acctbal"), F.round("v", 4).alias("v"), "n")


def roughness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variation and falls of each user's values."""
    found = geometry.roughness(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return found.select("user_id", F.round("variation", 3).alias("variation"), F.round("falls", 4).alias("falls"))


def match_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile curve from returned to accepted lines' prices per line number."""
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_returnflag", "l_extendedprice")
    found = geometry.match_quantiles(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), "l_linenumber", "l_extendedprice", 10)
    return found.select("l_linenumber", "q", F.round("source", 3).alias("source"), F.round("target", 3).alias("target"))


def robust_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price on quantity per status, fitted, trimmed at the 99th percentile of residuals, fitted again."""
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))

    def line(df: DataFrame) -> DataFrame:
        return df.groupBy("l_linestatus").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))

    residuals = rows.join(fits.written(line(rows), "line"), "l_linestatus").withColumn("d", F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept"))).select("l_linestatus", "x", "y", "d")
    limits = stretches.quantiles(residuals, ["l_linestatus"], "d", (0.99,)).select("l_linestatus", F.col("q")[0].alias("limit"))
    kept = residuals.join(fits.written(limits, "line-limits"), "l_linestatus").where("d <= limit")
    return line(kept).select("l_linestatus", F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"))


def delta_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of neighbouring images' pixels: mean, percentiles, share over ten."""
    rows = pixel_rows(spark, sf_dir)
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), "y", "x", F.col("v").alias("w"))
    pairs = rows.join(other, ["vec_id", "y", "x"]).select("vec_id", F.abs(F.col("v") - F.col("w")).alias("d"))
    found = pairs.groupBy("vec_id").agg(F.avg("d").alias("mean"), F.percentile("d", F.array(F.lit(0.5), F.lit(0.95))).alias("p"), F.avg((F.col("d") > 10).cast("double")).alias("over"))
    return found.select("vec_id", F.round("mean", 5).alias("mean"), F.round(F.col("p")[0], 5).alias("p50"), F.round(F.col("p")[1], 5).alias("p95"), F.round("over", 6).alias("over"))


def gain_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain and offset of a grid that bring each label's pixel mean and spread nearest to 120 and 50."""
    stats = pixel_rows(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").groupBy("label").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    grid = stats.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("o", F.explode(F.sequence(F.lit(-4), F.lit(4))))
    gain, offset = 0.5 + F.col("g") * 0.25, F.col("o") * 10.0
    error = F.round(F.pow(F.col("m") * gain + offset - 120, 2) + F.pow(F.col("s") * gain - 50, 2), 6)
    return grid.groupBy("label").agg(F.min_by(F.struct("g", "o"), F.struct(error, "g", "o")).alias("b")).select("label", F.col("b.g").alias("g"), F.col("b.o").alias("o"))


def route_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types routed to handlers, a fallback where there is none, with the licence of the handler: counts."""
    routes = spark.createDataFrame([("click", "a"), ("view", "b"), ("purchase", "a")], "event_type string, handler string")
    licences = spark.createDataFrame([("a", "open"), ("b", "restricted")], "handler string, licence string")
    rows = table(spark, sf_dir, "events").join(F.broadcast(routes), "event_type", "left").join(F.broadcast(licences), "handler", "left")
    return rows.groupBy("event_type", F.coalesce("handler", F.lit("fallback")).alias("handler"), F.coalesce("licence", F.lit("none")).alias("licence")).agg(F.count(F.lit(1)).alias("n"))


def event_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three log rows per line: filtered, scored, judged."""
    rows = table(spark, sf_dir, "lineitem")
    emitted = F.array_compact(F.array(
        F.when(F.col("l_discount") > 0.05, F.struct(F.lit("filter").alias("kind"), F.col("l_discount").alias("v"))), F.struct(F.lit("score").alias("kind"), (F.col("l_quantity") / 10).alias("v")),
        F.when(F.col("l_quantity") > 40, F.struct(F.lit("verdict").alias("kind"), F.col("l_tax").alias("v"))),
    ))
    return rows.select("l_returnflag", F.explode(emitted).alias("e")).groupBy("l_returnflag", "e.kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("e.v"), 3).alias("total"))


def white_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean colour of the brightest pixels of every image, by its own 90th percentile."""
    rows = rgb_pixels(spark, sf_dir).withColumn("top", F.greatest("r", "g", "b"))
    limit = F.percentile("top", 0.9).over(Window.partitionBy("vec_id"))
    return rows.withColumn("limit", limit).where("top >= limit").groupBy("vec_id").agg(*[F.round(F.avg(c), 6).alias(f"light_{c}") for c in "rgb"])


def dark_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haze by the dark channel: the least value in a 3 x 3 window, averaged."""
    across = Window.partitionBy("vec_id", "y").orderBy("x").rowsBetween(-1, 1)
    down = Window.partitionBy("vec_id", "x").orderBy("y").rowsBetween(-1, 1)
    rows = pixel_rows(spark, sf_dir).withColumn("m", F.min("v").over(across)).withColumn("m", F.min("m").over(down))
    pooled = measure.box_blur(rows.select("vec_id", "y", "x", F.col("m").alias("v")), "vec_id", 1)
    return pooled.groupBy("vec_id").agg(F.round(F.avg("v"), 5).alias("dark"), F.round(F.max("blurred"), 5).alias("most"))


QUERIES = {f.__name__: f for f in (mask_extents, crop_suggest, area_mean, resample, merge_near, roughness, match_quantiles, robust_fit, delta_report, gain_search, route_join, event_emission, white_patch, dark_channel)}

_BOX = "box AS (SELECT vec_id, min(x) / 8 AS x0, min(y) / 8 AS y0, (max(x) + 1) / 8 AS x1, (max(y) + 1) / 8 AS y1 FROM px WHERE v > {limit} GROUP BY vec_id)"
_TAPS = "(VALUES " + ", ".join(f"({t}, {lo + k}, {w}::DOUBLE)" for t in range(5) for lo, f in [(lambda at: (min(int(at), 6), at - min(int(at), 6)))(min(max((t + 0.5) * 8 / 5 - 0.5, 0.0), 7.0))] for k, w in ((0, 1 - f), (1, f))) + ") taps(tx, x, weight)"

ORACLES = {
    "mask_extents": f"WITH {PIXELS_SQL}, {_BOX.format(limit=180)} SELECT * FROM box",
    "crop_suggest": f"""
        WITH {PIXELS_SQL}, {_BOX.format(limit=200)},
        c AS (SELECT box.*, ratio, scale, i, j, scale * least(1.0, ratio) AS w, scale * least(1.0, 1 / ratio) AS h FROM box, (SELECT unnest([1.0::DOUBLE, 1.5]) AS ratio), (SELECT unnest([1.0::DOUBLE, 0.95, 0.90, 0.85]) AS scale), (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j)),
        k AS (SELECT *, (1 - w) * i / 4 AS wx0, (1 - h) * j / 4 AS wy0, (1 - w) * i / 4 + w AS wx1, (1 - h) * j / 4 + h AS wy1 FROM c),
        o AS (SELECT *, greatest(0.0, least(x1, wx1) - greatest(x0, wx0)) * greatest(0.0, least(y1, wy1) - greatest(y0, wy0)) / ((x1 - x0) * (y1 - y0)) AS kept, ((x0 + x1) / 2 - wx0) / (wx1 - wx0) AS cx, ((y0 + y1) / 2 - wy0) / (wy1 - wy0) AS cy FROM k),
        s AS (SELECT *, round(0.45 * (1 - least(1.0, sqrt(pow(cx - 0.5, 2) + pow(cy - 0.5, 2)) * 2)) + 0.35 * (1 - least(1.0, least(abs(cx - 1.0 / 3), abs(cx - 2.0 / 3)) * 3))
              + 0.12 * least(1.0, greatest(0.0, (y0 - wy0) / (wy1 - wy0) / 0.2)) + 0.08 * least(1.0, (x1 - x0) * (y1 - y0) / ((wx1 - wx0) * (wy1 - wy0))), 6) AS score FROM o WHERE kept >= 0.95)
        SELECT vec_id, ratio, scale, i, j, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id, ratio ORDER BY score DESC, scale DESC, i, j) = 1""",
    "area_mean": f"WITH {PIXELS_SQL} SELECT vec_id, y // 2 AS y, x // 2 AS x, round(avg(v), 5) AS v FROM px GROUP BY ALL",
    "resample": f"WITH {PIXELS_SQL} SELECT vec_id, y, tx AS x, round(sum(weight * v), 5) AS v FROM px JOIN {_TAPS} USING (x) GROUP BY ALL",
    "merge_near": """
        WITH s AS (SELECT s_nationkey, s_acctbal, CAST(s_suppkey AS DOUBLE) AS v, CASE WHEN s_acctbal - lag(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) < 150 THEN 0 ELSE 1 END AS b FROM supplier),
        k AS (SELECT *, sum(b) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS knot FROM s)
        SELECT s_nationkey, knot, round(avg(s_acctbal), 4) AS s_acctbal, round(avg(v), 4) AS v, count(*) AS n FROM k GROUP BY s_nationkey, knot""",
    "roughness": "WITH d AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) SELECT user_id, round(avg(d * d), 3) AS variation, round(sum(greatest(0.0, -d)), 4) AS falls FROM d GROUP BY user_id",
    "match_quantiles": """
        WITH q AS (SELECT unnest(range(0, 11)) AS q), a AS (SELECT l_linenumber, quantile_cont(l_extendedprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
        b AS (SELECT l_linenumber, quantile_cont(l_extendedprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS b FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
        SELECT l_linenumber, q, round(a[q + 1], 3) AS source, round(b[q + 1], 3) AS target FROM a JOIN b USING (l_linenumber), q""",
    "robust_fit": """
        WITH f AS (SELECT l_linestatus, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem GROUP BY 1),
        r AS (SELECT l_linestatus, l_quantity AS x, l_extendedprice AS y, abs(l_extendedprice - s * l_quantity - i) AS d FROM lineitem JOIN f USING (l_linestatus)), l AS (SELECT l_linestatus, quantile_cont(d, 0.99) AS m FROM r GROUP BY 1)
        SELECT l_linestatus, round(regr_slope(y, x), 3) AS slope, round(regr_intercept(y, x), 2) AS intercept FROM r JOIN l USING (l_linestatus) WHERE d <= m GROUP BY 1""",
    "delta_report": f"WITH {PIXELS_SQL}, d AS (SELECT a.vec_id, abs(a.v - b.v) AS d FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND a.y = b.y AND a.x = b.x) SELECT vec_id, round(avg(d), 5) AS mean, round(quantile_cont(d, 0.5), 5) AS p50, round(quantile_cont(d, 0.95), 5) AS p95, round(avg(CASE WHEN d > 10 THEN 1.0 ELSE 0.0 END), 6) AS over FROM d GROUP BY vec_id",
    "gain_search": f"""
        WITH {PIXELS_SQL}, s AS (SELECT label, avg(v) AS m, stddev_pop(v) AS s FROM px JOIN embeddings USING (vec_id) GROUP BY label),
        g AS (SELECT *, round(pow(m * (0.5 + g * 0.25) + o * 10.0 - 120, 2) + pow(s * (0.5 + g * 0.25) - 50, 2), 6) AS e FROM s, (SELECT unnest(range(0, 9)) AS g), (SELECT unnest(range(-4, 5)) AS o))
        SELECT label, g, o FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY e, g, o) = 1""",
    "route_join": """
        SELECT event_type, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' WHEN 'purchase' THEN 'a' ELSE 'fallback' END AS handler, CASE event_type WHEN 'click' THEN 'open' WHEN 'view' THEN 'restricted' WHEN 'purchase' THEN 'open' ELSE 'none' END AS licence, count(*) AS n FROM events GROUP BY ALL""",
    "event_emission": """
        WITH e AS (SELECT l_returnflag, 'filter' AS kind, l_discount AS v FROM lineitem WHERE l_discount > 0.05 UNION ALL SELECT l_returnflag, 'score', l_quantity / 10 FROM lineitem UNION ALL SELECT l_returnflag, 'verdict', l_tax FROM lineitem WHERE l_quantity > 40)
        SELECT l_returnflag, kind, count(*) AS n, round(sum(v), 3) AS total FROM e GROUP BY ALL""",
    "white_patch": f"""
        WITH {RGB_SQL}, t AS (SELECT *, greatest(r, g, b) AS top FROM rgb), l AS (SELECT vec_id, quantile_cont(top, 0.9) AS l FROM t GROUP BY vec_id)
        SELECT vec_id, round(avg(r), 6) AS light_r, round(avg(g), 6) AS light_g, round(avg(b), 6) AS light_b FROM t JOIN l USING (vec_id) WHERE top >= l GROUP BY vec_id""",
    "dark_channel": f"""
        WITH {PIXELS_SQL}, a AS (SELECT vec_id, y, x, min(v) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM px), d AS (SELECT vec_id, y, x, min(m) OVER (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM a),
        s AS (SELECT *, sum(v) OVER w AS s, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)), t AS (SELECT vec_id, v, sum(s) OVER w / sum(n) OVER w AS b FROM s WINDOW w AS (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
        SELECT vec_id, round(avg(v), 5) AS dark, round(max(b), 5) AS most FROM t GROUP BY vec_id""",
}
