"""Adapters from the test tables to the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER_METRICS = (
    "face_luminance", "preview_highlight_clip_estimate", "shadow_clip_ratio", "haze_proxy", "tonal_range", "colorfulness_proxy", "noise_ratio", "sky_luminance", "sky_area_ratio",
    "sky_reliable", "plant_luminance", "plant_area_ratio", "plant_reliable", "preview_overflow_ratio", "crop_suggestion_applicable",
)

ORDER_METRICS_SQL = """
    SELECT o_orderkey, round(avg(l_quantity) * 5, 6) AS face_luminance, round(avg(l_discount), 6) AS preview_highlight_clip_estimate,
           round(avg(CASE WHEN l_quantity <= 10 THEN 1.0 ELSE 0.0 END), 6) AS shadow_clip_ratio, round(avg(l_tax) * 5, 6) AS haze_proxy,
           round((max(l_quantity) - min(l_quantity)) / 50, 6) AS tonal_range, round(avg(l_extendedprice) / 8000, 6) AS colorfulness_proxy,
           round(avg(l_linenumber) / 5, 6) AS noise_ratio, round(max(l_quantity) * 5, 6) AS sky_luminance, round(avg(l_tax) * 10, 6) AS sky_area_ratio,
           CASE WHEN count(*) >= 3 THEN 1.0 ELSE 0.0 END AS sky_reliable, round(min(l_quantity) * 5, 6) AS plant_luminance,
           round(avg(l_discount) * 10, 6) AS plant_area_ratio, 1.0 AS plant_reliable, round(avg(l_discount) / 2, 6) AS preview_overflow_ratio,
           CASE WHEN max(o_orderpriority) LIKE '1-%' THEN 1.0 ELSE 0.0 END AS crop_suggestion_applicable
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of metrics per order, from its lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_linenumber")
    q = F.col("l_quantity")

    def mean(column, scale=1.0):
        return F.round(F.avg(column) * scale, 6)

    sums = lines.groupBy("l_orderkey").agg(
        mean(q, 5.0).alias("face_luminance"), mean("l_discount").alias("preview_highlight_clip_estimate"), mean(F.when(q <= 10, 1.0).otherwise(0.0)).alias("shadow_clip_ratio"),
        mean("l_tax", 5.0).alias("haze_proxy"), F.round((F.max(q) - F.min(q)) / 50, 6).alias("tonal_range"), F.round(F.avg("l_extendedprice") / 8000, 6).alias("colorfulness_proxy"),
        F.round(F.avg("l_linenumber") / 5, 6).alias("noise_ratio"), F.round(F.max(q) * 5, 6).alias("sky_luminance"), mean("l_tax", 10.0).alias("sky_area_ratio"),
        F.when(F.count(F.lit(1)) >= 3, 1.0).otherwise(0.0).alias("sky_reliable"), F.round(F.min(q) * 5, 6).alias("plant_luminance"), mean("l_discount", 10.0).alias("plant_area_ratio"),
        F.round(F.avg("l_discount") / 2, 6).alias("preview_overflow_ratio"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderpriority").like("1-%"), 1.0).otherwise(0.0).alias("crop_suggestion_applicable"))
    return orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("plant_reliable", F.lit(1.0)).select("o_orderkey", *ORDER_METRICS)
