"""Queries of the decision operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import rules
from tessera.plans.tables import ORDER_METRICS, ORDER_METRICS_SQL, order_metrics, table


def rules_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule pack over per-order metrics: winners per parameter, limiter applied."""
    found = rules.apply(order_metrics(spark, sf_dir), "o_orderkey", ORDER_METRICS)
    return found.select("o_orderkey", "param", "rule_id", F.round("new_value", 6).alias("new_value"))


def rules_conflict_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits, then one winner per parameter by a window, at the second iteration (deltas decay)."""
    rows = order_metrics(spark, sf_dir).withColumn("iteration", F.lit(2))
    hits = rules.evaluate(rows, "o_orderkey", ORDER_METRICS, iteration="iteration")
    return rules.resolve_conflicts(hits, "o_orderkey").select("o_orderkey", "param", "rule_id", "place", F.round("new_value", 6).alias("new_value"))


def rule_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, mean and range of the proposed value per rule."""
    hits = rules.evaluate(order_metrics(spark, sf_dir), "o_orderkey", ORDER_METRICS)
    return hits.groupBy("rule_id", "param").agg(F.count(F.lit(1)).alias("hits"), F.round(F.avg("new_value"), 4).alias("mean_value"), F.round(F.min("new_value"), 6).alias("low"), F.round(F.max("new_value"), 6).alias("high"))


_HITS = f"""
    m AS ({ORDER_METRICS_SQL}), hits AS (
        SELECT o_orderkey, 'exposure_rule_001' AS rule_id, 0 AS ord, 10.0 AS priority, 'exposure_ev' AS param,
               greatest(-0.5, least(0.5, 2.2 * log2(118.0 / face_luminance) * {{decay}})) AS new_value FROM m WHERE face_luminance < 110
        UNION ALL SELECT o_orderkey, 'crop_suggest_rule_003', 1, 15.0, 'compose.apply_suggestion', 1.0 FROM m WHERE crop_suggestion_applicable >= 1
        UNION ALL SELECT o_orderkey, 'highlight_protect_rule_002', 2, 20.0, 'exposure_ev', -0.15 FROM m WHERE preview_highlight_clip_estimate >= 0.025
        UNION ALL SELECT o_orderkey, 'region_sky_exposure_001', 3, 20.0, 'region.sky.exposure', greatest(-2.0, least(0.0, -0.5 * (sky_luminance / 150)))
                  FROM m WHERE sky_luminance > 150 AND sky_area_ratio < 0.70 AND sky_reliable = 1
        UNION ALL SELECT o_orderkey, 'region_plant_exposure_002', 4, 20.0, 'region.plant.exposure', greatest(0.0, least(2.0, 0.2 * ((70 - plant_luminance) / 70)))
                  FROM m WHERE plant_luminance < 70 AND plant_area_ratio < 0.70 AND preview_overflow_ratio < 0.01 AND plant_reliable = 1
        UNION ALL SELECT o_orderkey, 'vibrance_low_rule', 5, 30.0, 'vibrance.strength', 0.3 FROM m WHERE colorfulness_proxy <= 4.78
        UNION ALL SELECT o_orderkey, 'dehaze_rule_030', 6, 30.0, 'dehaze.strength', 0.15 FROM m WHERE haze_proxy >= 0.22
        UNION ALL SELECT o_orderkey, 'saturation_high_rule', 7, 31.0, 'saturation.adjust', -0.15 FROM m WHERE colorfulness_proxy >= 6.13
        UNION ALL SELECT o_orderkey, 'clarity_flat_rule_031', 8, 31.0, 'clarity.strength', 0.10 FROM m WHERE haze_proxy >= 0.12 AND haze_proxy < 0.22 AND tonal_range <= 0.46
        UNION ALL SELECT o_orderkey, 'shadow_open_rule_032', 9, 32.0, 'tone.shadows', 0.05 FROM m WHERE shadow_clip_ratio >= 0.18
        UNION ALL SELECT o_orderkey, 'highlight_recover_rule_033', 10, 33.0, 'tone.highlights', -0.08 FROM m WHERE preview_highlight_clip_estimate >= 0.025
    )"""


def rules_termination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven branches of the stop list over each user's event sequence: a gain is the step's relative change of value."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.row_number().over(w).alias("n"), F.lag("value").over(w).alias("b1"), F.lag("value", 2).over(w).alias("b2"))
    gain, gain_before = F.abs(F.col("value") - F.col("b1")) / 100, F.abs(F.col("b1") - F.col("b2")) / 100
    kind, missing = F.col("event_type"), F.lit(None).cast("double")
    met = F.when(kind != "view", rules.target_met(F.col("value"), F.lit(50.0), "eq", 2.0))
    pair = F.filter(F.array(gain_before, gain), lambda x: x.isNotNull())
    found = rules.termination(
        unreliable=(kind == "error") & (F.col("value") > 80), irreparable=(kind == "error") & (F.col("value") < 5), locked_target=(kind == "purchase") & (F.col("value") > 70), goal=(kind == "signup") & (F.col("value") > 200), met=met,
        overall=F.when(kind == "click", F.col("value")), accept=F.lit(150.0), aesthetic=pair, stagnation=F.when(kind == "click", F.lit(0.05)), history=F.when(kind == "view", pair).otherwise(F.array().cast("array<double>")),
        before=F.when(kind == "error", gain_before).otherwise(missing), now=F.when(kind == "error", gain).otherwise(missing), iteration=F.col("n") % 4,
    )
    return steps.select("user_id", "event_id", found.alias("t")).select("user_id", "event_id", "t.*")


def rules_qc_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality gate per line: overflow from the discount, rollbacks from the line's place in its order, locked by status."""
    lines = table(spark, sf_dir, "lineitem")
    gate = rules.qc_rollback(F.col("l_discount"), F.col("l_linenumber") - 1, F.col("l_linestatus") == "F")
    return lines.groupBy(gate.alias("decision"), "l_returnflag").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.when(gate == "rollback", rules.QC_STEP).otherwise(0.0)), 4).alias("correction"))


SOFT = (("noise_ratio", "noise_ratio >= 0.62"), ("detail_score", "tonal_range <= 0.12"), ("motion_blur", "shadow_clip_ratio > 0.5"), ("low_colorfulness", "colorfulness_proxy <= 4.78"), ("high_colorfulness", "colorfulness_proxy >= 6.13"))


def soft_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of warning names per order; missing values never warn."""
    rows = order_metrics(spark, sf_dir)
    found = F.array_compact(F.array(*[F.when(F.expr(condition), F.lit(name)) for name, condition in SOFT]))
    return rows.select("o_orderkey", F.array_join(found, ",").alias("warnings"), F.size(found).alias("n_warnings"))


def unreliable_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the map entries that fail a predicate, from a map built per order."""
    rows = order_metrics(spark, sf_dir)
    regions = F.create_map(F.lit("face"), F.col("face_luminance") > 60, F.lit("plant"), F.col("plant_luminance") > 30, F.lit("sky"), F.col("sky_reliable") == 1)
    failing = F.array_sort(F.map_keys(F.map_filter(regions, lambda k, v: ~v)))
    return rows.select("o_orderkey", F.array_join(failing, ",").alias("unreliable"))


QUERIES = {
    "rules_apply": rules_apply, "rules_conflict_winner": rules_conflict_winner, "rule_hit_counts": rule_hit_counts, "rules_termination": rules_termination, "rules_qc_rollback": rules_qc_rollback,
    "soft_warnings": soft_warnings, "unreliable_regions": unreliable_regions,
}

ORACLES = {
    "rules_apply": "WITH "
    + _HITS.format(decay="1")
    + """, best AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, param ORDER BY priority DESC, ord) AS n FROM hits)
        SELECT b.o_orderkey, param, rule_id,
               round(CASE WHEN contains(param, 'exposure') AND preview_overflow_ratio >= 0.025 AND new_value > 0 THEN 0.0 ELSE new_value END, 6) AS new_value
        FROM best b JOIN m USING (o_orderkey) WHERE n = 1""",
    "rules_conflict_winner": "WITH "
    + _HITS.format(decay="0.5")
    + """, best AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey, param ORDER BY priority DESC, ord) AS n, min(ord) OVER (PARTITION BY o_orderkey, param) AS place FROM hits)
        SELECT o_orderkey, param, rule_id, place, round(new_value, 6) AS new_value FROM best WHERE n = 1""",
    "rule_hit_counts": "WITH "
    + _HITS.format(decay="1")
    + """ SELECT rule_id, param, count(*) AS hits, round(avg(new_value), 4) AS mean_value, round(min(new_value), 6) AS low, round(max(new_value), 6) AS high
        FROM hits GROUP BY rule_id, param""",
    "rules_termination": """
        WITH s AS (SELECT user_id, event_id, event_type AS k, value AS v, row_number() OVER w AS n, abs(value - lag(value) OVER w) / 100 AS g, abs(lag(value) OVER w - lag(value, 2) OVER w) / 100 AS h
                   FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT user_id, event_id, CASE WHEN k = 'error' AND v > 80 THEN 'unreliable' WHEN k = 'error' AND v < 5 THEN 'irreparable' WHEN k = 'purchase' AND v > 70 THEN 'user_locked_unmet'
              WHEN k = 'signup' AND v > 200 THEN 'targets_met' WHEN k <> 'view' AND abs(v - 50) <= 2 THEN 'targets_met' WHEN k = 'click' AND v >= 150 THEN 'aesthetic_target_met'
              WHEN k = 'click' AND g < 0.05 AND h < 0.05 THEN 'aesthetic_stagnation' WHEN k IN ('view', 'error') AND g < 0.1 AND h < 0.1 THEN 'low_improvement' WHEN n % 4 >= 3 THEN 'max_iterations' END AS reason_code FROM s)
        SELECT user_id, event_id, reason_code, coalesce(reason_code <> 'max_iterations', false) AS should_stop,
               CASE WHEN reason_code IN ('unreliable', 'irreparable', 'user_locked_unmet') THEN 'manual_review' WHEN reason_code IS NULL OR reason_code = 'max_iterations' THEN 'adjust_and_continue' ELSE 'stopped' END AS decision FROM r""",
    "rules_qc_rollback": """
        WITH d AS (SELECT l_returnflag, CASE WHEN NOT l_discount > 0.03 THEN 'pass' WHEN l_linestatus = 'F' OR l_linenumber >= 2 THEN 'manual_review' ELSE 'rollback' END AS decision FROM lineitem)
        SELECT decision, l_returnflag, count(*) AS lines, round(sum(CASE WHEN decision = 'rollback' THEN -0.15 ELSE 0.0 END), 4) AS correction FROM d GROUP BY ALL""",
    "soft_warnings": f"""
        WITH m AS ({ORDER_METRICS_SQL}), a AS (SELECT o_orderkey, list_filter([CASE WHEN noise_ratio >= 0.62 THEN 'noise_ratio' END, CASE WHEN tonal_range <= 0.12 THEN 'detail_score' END,
            CASE WHEN shadow_clip_ratio > 0.5 THEN 'motion_blur' END, CASE WHEN colorfulness_proxy <= 4.78 THEN 'low_colorfulness' END,
            CASE WHEN colorfulness_proxy >= 6.13 THEN 'high_colorfulness' END], lambda x: x IS NOT NULL) AS w FROM m)
        SELECT o_orderkey, array_to_string(w, ',') AS warnings, len(w) AS n_warnings FROM a""",
    "unreliable_regions": f"""
        WITH m AS ({ORDER_METRICS_SQL}) SELECT o_orderkey, coalesce(array_to_string(list_filter([CASE WHEN NOT face_luminance > 60 THEN 'face' END,
            CASE WHEN NOT plant_luminance > 30 THEN 'plant' END, CASE WHEN sky_reliable <> 1 THEN 'sky' END], lambda x: x IS NOT NULL), ','), '') AS unreliable FROM m""",
}
