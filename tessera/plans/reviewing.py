"""Queries of judgements, the review queue, nested metrics and text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import reviewing
from tessera.plans.tables import ORDER_METRICS_SQL, order_metrics, table


def issue_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tiers of findings, issue codes and the exposure step of every order's metrics."""
    rows = order_metrics(spark, sf_dir)
    mean, face = F.col("sky_luminance"), F.when(F.col("sky_reliable") == 1, F.col("face_luminance"))
    hot, dark, contrast = F.col("preview_highlight_clip_estimate"), F.col("preview_overflow_ratio"), F.col("tonal_range")
    issues, notes = reviewing.judge(mean, face, hot, dark, contrast, F.col("shadow_clip_ratio"), F.col("sky_area_ratio"))
    found = rows.select("o_orderkey", issues.alias("i"), notes.alias("n"), reviewing.issue_codes(mean, face, hot, F.col("haze_proxy") / 4, contrast).alias("c"), mean.alias("mean"), face.alias("face"), hot.alias("hot"))
    step = reviewing.exposure_step(F.col("c"), F.col("mean"), F.col("face"), F.col("hot"))
    return found.select("o_orderkey", (F.size("i") == 0).alias("passes"), F.array_join("i", ",").alias("issues"), F.array_join("n", ",").alias("notes"), F.array_join("c", ",").alias("codes"), F.round(step, 6).alias("step"))


def review_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review queue over the event log: a user is an item, sign-ups enqueue, purchases accept, errors reject, clicks edit."""
    kind = F.col("event_type")
    action = F.when(kind == "signup", "enqueue").when(kind == "purchase", "accept").when(kind == "error", "reject").when(kind == "click", "edit").otherwise("look")
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", action.alias("action"))
    return reviewing.review_queue(log, "user_id", ["ts", "event_id"], "action").select("user_id", "event_id", "action", "status", "outcome")


def _groups(rows: DataFrame) -> dict:
    return {"": {"noise": F.col("noise_ratio")}, "sky": {"luminance": F.when(F.col("sky_reliable") == 1, F.col("sky_luminance")), "area": F.col("sky_area_ratio")}, "metrics": {"haze": F.col("haze_proxy")}}


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's nested metrics as rows of dotted names; missing ones have none."""
    rows = order_metrics(spark, sf_dir)
    return rows.select("o_orderkey", F.explode(reviewing.flatten(_groups(rows))).alias("name", "value"))


def metric_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by the names that rules may use."""
    rows = order_metrics(spark, sf_dir)
    found = rows.select("o_orderkey", reviewing.flatten(_groups(rows)).alias("m"))
    return found.select("o_orderkey", reviewing.metric(F.col("m"), "metrics.noise").alias("noise"), reviewing.metric(F.col("m"), "sky.luminance").alias("sky"), reviewing.metric(F.col("m"), "haze").alias("haze"), reviewing.metric(F.col("m"), "metrics.sky.none").alias("none"))


# Labels of three metering codes; others stay as they are.
LABELS = {1: "average", 2: "centre", 5: "pattern"}


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact numbers, changes, labels, reasons and promotion per line."""
    aperture = F.concat(F.lit("f/"), reviewing.compact(1.4 + F.col("l_discount") * 30, 1))
    change = reviewing.changed("tax", F.col("l_discount"), F.col("l_tax"))
    reason = F.format_string("discount %.4f over tax %.4f", "l_discount", "l_tax")
    keep = reviewing.promoted(F.col("l_discount"), F.col("l_quantity"), 0.02, 0.002)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", aperture.alias("aperture"), F.coalesce(change, F.lit("")).alias("change"), reviewing.labelled(F.col("l_linenumber"), LABELS).alias("label"), reason.alias("reason"), keep.alias("keep"))


def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with white space made normal: digest, length, and whether anything changed; equal ones of a conversation counted."""
    text = reviewing.normal_space(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("t"), (text != F.col("text")).alias("changed"))
    return rows.groupBy("conv_id", F.md5(F.lower("t")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"), F.max(F.length("t")).alias("longest"), F.bool_or("changed").alias("changed"))


def offset_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times with an offset in quarter hours, shown with it and as naive UTC; offset 0 counts as missing and falls back to +8."""
    quarters = F.col("user_id") % 9 * 3 - 8
    offset = F.when(quarters == 0, 32).otherwise(quarters)
    local = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + offset * 900_000_000)
    sign, size = F.when(offset < 0, "-").otherwise("+"), F.abs(offset)
    shown = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign, F.lpad(F.floor(size / 4).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 4 * 15).cast("string"), 2, "0"))
    return table(spark, sf_dir, "events").select("event_id", shown.alias("shown"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("utc"))


def stage_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median value per event type and hour as a report of stages: few values a group, so the exact median is taken."""
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.median("value"), 6).alias("median"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (issue_judgement, review_actions, metric_rows, metric_lookup, text_forms, normal_texts, offset_times, stage_medians)}


def _list(*cases: str) -> str:
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), ',')"


_LEVEL = "CASE WHEN face IS NOT NULL THEN CASE WHEN face < {low} THEN 'face_dark' WHEN face > 160 THEN 'face_bright' END WHEN mean < 75 THEN 'image_dark' WHEN mean > 170 THEN 'image_bright' END"
_COMPACT = "regexp_replace(regexp_replace(printf('%.{n}f', {x}), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"

ORACLES = {
    "issue_judgement": f"""
        WITH m AS ({ORDER_METRICS_SQL}), a AS (SELECT *, sky_luminance AS mean, CASE WHEN sky_reliable = 1 THEN face_luminance END AS face, preview_highlight_clip_estimate AS hot, preview_overflow_ratio AS dark FROM m),
        b AS (SELECT *, {_LEVEL.format(low=85)} AS lv, {_LEVEL.format(low=75)} AS lc FROM a),
        c AS (SELECT o_orderkey, mean, face, hot, {_list("CASE WHEN hot > 0.03 THEN 'highlight' END", "CASE WHEN dark > 0.03 THEN 'shadow' END", "lv", "CASE WHEN tonal_range < 0.2 THEN 'low_contrast' END")} AS issues,
            {_list("CASE WHEN hot <= 0.03 AND hot > 0.01 THEN 'highlight_near' END", "CASE WHEN dark <= 0.03 AND dark > 0.01 THEN 'shadow_near' END", "CASE WHEN lv IS NULL THEN CASE WHEN face IS NOT NULL THEN 'face_fine' WHEN mean IS NOT NULL THEN 'image_fine' END END",
                   "CASE WHEN shadow_clip_ratio > 0.8 THEN 'motion' END", "CASE WHEN sky_area_ratio > 0.45 THEN 'haze' END")} AS notes,
            {_list("CASE WHEN hot > 0.03 THEN 'highlight' END", "CASE WHEN haze_proxy / 4 > 0.08 THEN 'shadow' END", "lc", "CASE WHEN tonal_range < 0.2 THEN 'low_contrast' END")} AS codes FROM b)
        SELECT o_orderkey, coalesce(issues, '') = '' AS passes, coalesce(issues, '') AS issues, coalesce(notes, '') AS notes, coalesce(codes, '') AS codes,
               CAST(round(CASE WHEN contains(codes, 'highlight') THEN CASE WHEN hot > 0.08 THEN -0.35 WHEN hot > 0.05 THEN -0.3 ELSE -0.2 END WHEN contains(codes, 'face_bright') OR face > 160 THEN -0.25 WHEN contains(codes, 'face_dark') OR face < 85 THEN 0.25
                    WHEN contains(codes, 'image_bright') THEN -0.25 WHEN contains(codes, 'image_dark') THEN greatest(0.15, least(0.45, (78 - mean) / 22)) WHEN contains(codes, 'shadow') THEN 0.15 ELSE 0.0 END, 6) AS DOUBLE) AS step FROM c""",
    "review_actions": """
        WITH l AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'edit' ELSE 'look' END AS action FROM events),
        i AS (SELECT *, count_if(action = 'enqueue') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS item, CASE action WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'edit' THEN 'edited' END AS verdict FROM l),
        d AS (SELECT *, first_value(verdict IGNORE NULLS) OVER (PARTITION BY user_id, item ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS decided,
                     count(verdict) OVER (PARTITION BY user_id, item ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM i)
        SELECT user_id, event_id, action, CASE WHEN item > 0 THEN coalesce(decided, 'pending') END AS status,
               CASE WHEN action = 'enqueue' THEN CASE WHEN item > 1 THEN 'overwritten' ELSE 'ok' END WHEN verdict IS NOT NULL AND (item = 0 OR earlier > 0) THEN 'error' ELSE 'ok' END AS outcome FROM d""",
    "metric_rows": f"""
        WITH m AS ({ORDER_METRICS_SQL}) SELECT o_orderkey, 'noise' AS name, noise_ratio AS value FROM m UNION ALL SELECT o_orderkey, 'sky.luminance', sky_luminance FROM m WHERE sky_reliable = 1
        UNION ALL SELECT o_orderkey, 'sky.area', sky_area_ratio FROM m UNION ALL SELECT o_orderkey, 'metrics.haze', haze_proxy FROM m""",
    "metric_lookup": f"WITH m AS ({ORDER_METRICS_SQL}) SELECT o_orderkey, noise_ratio AS noise, CASE WHEN sky_reliable = 1 THEN sky_luminance END AS sky, haze_proxy AS haze, CAST(NULL AS DOUBLE) AS none FROM m",
    "text_forms": f"""
        SELECT l_orderkey, l_linenumber, 'f/' || {_COMPACT.format(n=1, x="1.4 + l_discount * 30")} AS aperture,
               CASE WHEN l_discount <> l_tax THEN 'tax: ' || {_COMPACT.format(n=4, x="l_discount")} || ' → ' || {_COMPACT.format(n=4, x="l_tax")} ELSE '' END AS change,
               CASE l_linenumber WHEN 1 THEN 'average' WHEN 2 THEN 'centre' WHEN 5 THEN 'pattern' ELSE CAST(l_linenumber AS VARCHAR) END AS label, printf('discount %.4f over tax %.4f', l_discount, l_tax) AS reason,
               l_discount >= greatest(0.02, 0.002::DOUBLE * l_quantity) AS keep FROM lineitem""",
    "normal_texts": r"""
        WITH t AS (SELECT conv_id, turn, text, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t FROM conversations)
        SELECT conv_id, md5(lower(t)) AS digest, count(*) AS n, min(turn) AS first_turn, max(length(t)) AS longest, bool_or(t <> text) AS changed FROM t GROUP BY ALL""",
    "offset_times": """
        WITH o AS (SELECT event_id, ts, CASE WHEN user_id % 9 * 3 - 8 = 0 THEN 32 ELSE user_id % 9 * 3 - 8 END AS q FROM events)
        SELECT event_id, strftime(ts + q * INTERVAL 15 MINUTE, '%Y-%m-%dT%H:%M:%S') || CASE WHEN q < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(q) // 4 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(q) % 4 * 15 AS VARCHAR), 2, '0') AS shown,
               strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS utc FROM o""",
    "stage_medians": "SELECT event_type, date_trunc('hour', ts) AS hour, round(median(value), 6) AS median, count(*) AS n FROM events GROUP BY ALL",
}
