"""Queries of bursts, selection, state, trace and review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import batch, sequences, states, stretches
from tessera.plans.tables import table


def burst_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts over all events with a gap of 600 s, stitched across days."""
    found = sequences.global_bursts(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", 600.0)
    return found.groupBy("island").agg(F.count(F.lit(1)).alias("frames"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")).withColumn("skip", F.col("frames") < 3)


def burst_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each user: a gap over a day, or another event type, opens one."""
    found = sequences.bursts(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 86400.0, {"event_type": None})
    return found.select("user_id", "event_id", "island")


def burst_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts that also break where the value jumps by 40 or more."""
    found = sequences.bursts(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 172800.0, {"value": 40.0})
    return found.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("value"), 4).alias("total"))


def burst_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of at most ten frames: larger ones are cut."""
    found = sequences.global_bursts(table(spark, sf_dir, "events").select("event_id", "ts"), "ts", "event_id", 600.0)
    cut = sequences.split_oversized(found, ["island"], ["ts", "event_id"], 10)
    return cut.groupBy("island", "chunk").agg(F.count(F.lit(1)).alias("frames"), F.min("event_id").alias("first_id"), F.max("size").alias("size")).withColumn("oversized", F.col("size") > 10)


def session_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user sessions with a gap of six hours, by the built-in session window."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    found = events.groupBy("user_id", F.session_window("ts", "6 hours").alias("s")).agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("value"), 4).alias("total"))
    return found.select("user_id", F.unix_seconds(F.col("s.start")).alias("started"), "frames", "total")


_LINE = "round(l_discount * 4, 4) AS motion, l_quantity / 3 AS detail, l_tax / 2 AS highlight, l_linenumber / 25.0 AS shadow, l_extendedprice"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 4, 4).alias("motion"), (F.col("l_quantity") / 3).alias("detail"), (F.col("l_tax") / 2).alias("highlight"), (F.col("l_linenumber") / 25.0).alias("shadow"), "l_extendedprice")


def hard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits broken per line, in order."""
    reasons = batch.reject_reasons(F.col("motion"), F.col("detail"), F.col("highlight"), F.col("shadow"))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passed"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    reasons = batch.reject_reasons(F.col("motion"), F.col("detail"), F.col("highlight"), F.col("shadow"))
    score = batch.composite_score(F.col("l_extendedprice") / 420, F.col("detail"), F.col("motion") * 2)
    return rows.select("l_orderkey", "l_linenumber", (F.size(reasons) == 0).alias("passed"), score.alias("score"))


def batch_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best passing lines per order with confidence by place."""
    return batch.select_top(_scored(spark, sf_dir).where("passed"), ["l_orderkey"], "score", "l_linenumber").select("l_orderkey", "l_linenumber", "score", "place", "confidence")


def burst_select_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As batch_select by whole scores, ties sharing the first's confidence."""
    rows = _scored(spark, sf_dir).withColumn("score", F.floor("score").cast("double"))
    return batch.select_top(rows, ["l_orderkey"], "score", "l_linenumber", ties_share=True).select("l_orderkey", "l_linenumber", "score", "place", "confidence")


def batch_status_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by status, per return flag and in all, in one pass."""
    rows = _scored(spark, sf_dir)
    best = batch.select_top(rows.where("passed"), ["l_orderkey"], "score", "l_linenumber").select("l_orderkey", "l_linenumber", "confidence")
    marked = rows.join(best, ["l_orderkey", "l_linenumber"], "left").select(batch.status(F.col("passed"), F.col("confidence")).alias("status"), (F.col("l_orderkey") % 8).alias("grp"), "score")
    return marked.groupingSets([["grp", "status"], ["status"], []], "grp", "status").agg(F.count(F.lit(1)).alias("lines"), F.round(F.avg("score"), 4).alias("mean_score"))


def score_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw values mapped by the anchors of every dimension."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("raw"))
    return rows.select("vec_id", *[F.round(batch.calibrate(F.col("raw"), d), 5).alias(d) for d in batch.ANCHORS])


#: An event's state for the audit, by its type and value.
_STATE = "CASE event_type WHEN 'view' THEN 'SCREENED' WHEN 'click' THEN 'BASE_RENDERED' WHEN 'purchase' THEN 'MANUAL_REVIEW' WHEN 'error' THEN 'FINAL_QC' ELSE 'COLOR_CORRECTING' END"


def state_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's transitions against the allowed pairs, the reason and rollback guards, and the event they emit."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.expr(_STATE).alias("state"), F.when(F.col("value") > 20, F.lit("because")).otherwise("").alias("reason"))
    rows = rows.withColumn("before", F.coalesce(F.lag("state").over(w), F.lit(states.INITIAL)))
    back = states.is_rollback(F.col("before"), F.col("state")).cast("int")
    rows = rows.withColumn("rollbacks", F.coalesce(F.sum(back).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    broken = states.violation(F.col("before"), F.col("state"), F.col("reason"), F.col("rollbacks"))
    return rows.select("user_id", "event_id", "before", "state", F.coalesce(broken, F.lit("ok")).alias("verdict"), states.event_type(F.col("before"), F.col("state")).alias("emitted"))


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event per user: the upsert view of the log."""
    return sequences.latest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type", "value")


def jnd_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive small values per user, converged from two on."""
    return sequences.run_lengths(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value") < 23, 2).select("user_id", "event_id", "streak", "converged")


def trace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjunctive equality filters that reach the scan."""
    return table(spark, sf_dir, "events").where((F.col("event_type") == "click") & (F.col("user_id") == 7)).select("event_id", "value")


def trace_group_by_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered event ids of each user and type, as a digest by blocks of the list and its size."""
    found = stretches.digests(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"], F.col("event_id").cast("string"))
    return found.withColumnRenamed("n", "events")


def trace_param_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between a conversation's turns: the last text of another role carried forward and the change in length."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"))
    rows = rows.withColumn("user_chars", F.when(F.col("role") == "user", F.col("chars")))
    before = sequences.carried("user_chars", ["conv_id"], ["turn", "role"])
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    return rows.select("conv_id", "turn", "role", before.alias("last_user_chars"), (F.col("chars") - F.lag("chars").over(w)).alias("delta"))


def improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each user's value came nearer to 50 since the event before, at least 0."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    distance = F.abs(F.col("value") - 50)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.greatest(F.lit(0.0), F.lag(distance).over(w) - distance), 6).alias("gain"))


def rule_ids_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct event types per user in order of first appearance."""
    firsts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return firsts.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"]), ",").alias("types"))


def first_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and day."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


def degradation_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: count, first and last time, and the last event's value."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type", (F.col("user_id") % 10).alias("path")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by decision, acceptance rate and throughput from first to last order, in all and per priority."""
    orders = table(spark, sf_dir, "orders")
    decided = F.count_if(F.col("o_orderstatus") == "F")
    return orders.groupingSets([["o_orderpriority"], []], "o_orderpriority").agg(
        F.count(F.lit(1)).alias("total"), decided.alias("accepted"), F.count_if(F.col("o_orderstatus") == "O").alias("pending"), F.count_if(F.col("o_orderstatus") == "P").alias("edited"),
        F.round(decided / F.count(F.lit(1)), 6).alias("rate"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"),
    )


def review_stats_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary as (stat, value) rows."""
    orders = table(spark, sf_dir, "orders")
    one = orders.agg(F.count(F.lit(1)).cast("double").alias("total"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("accepted"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))
    return one.unpivot([], ["total", "accepted", "mean_price"], "stat", "value")


def retention_ttl_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: events of the last 20 days of the log, at most the 25 newest."""
    events = table(spark, sf_dir, "events")
    end = events.agg(F.max("ts").alias("end"))
    fresh = events.join(F.broadcast(end)).where(F.col("ts") >= F.col("end") - F.expr("INTERVAL 20 DAYS"))
    return batch.keep_newest(fresh, ["user_id"], "ts", "event_id", 25).select("user_id", "event_id")


def lru_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: newest documents while their characters sum to at most 60 000."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return batch.within_bytes(docs, ["source"], [F.desc("doc_id")], "n_chars", 60_000).select("source", "doc_id", "used")


QUERIES = {f.__name__: f for f in (burst_groups, burst_per_user, burst_attributes, burst_split, session_bursts, hard_filter, batch_select, burst_select_ties, batch_status_lists, score_calibration, state_audit, latest_state, jnd_runs, trace_filter, trace_group_by_param, trace_param_delta, improvement, rule_ids_union, first_snapshot, degradation_ledger, review_summary, review_stats_rows, retention_ttl_cap, lru_bytes)}

_ISLANDS = """
    s AS (SELECT event_id, ts, epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts, event_id) AS d FROM events),
    i AS (SELECT event_id, ts, sum(CASE WHEN d <= 600 THEN 0 ELSE 1 END) OVER (ORDER BY ts, event_id) AS island FROM s)"""
_SCORED = f"""
    b AS (SELECT l_orderkey, l_linenumber, {_LINE} FROM lineitem),
    scored AS (SELECT l_orderkey, l_linenumber, NOT (motion > 0.35 OR detail < 3.0 OR highlight > 0.03 OR shadow > 0.20) AS passed,
        round(greatest(0.0, least(5.0, 0.35 * (5 - 4 * abs(l_extendedprice / 420 / 255 - 0.5)) + 0.30 * (greatest(0.0, least(1.0, detail / 15)) * 3 + 1.5)
              + 0.20 * (greatest(0.0, least(1.0, motion * 2 / 0.8)) * 2 + 1.8) + 0.15 * 3.2)), 3) AS score FROM b)"""
_TOP = """
    ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) - 1 AS place, rank() OVER (PARTITION BY l_orderkey ORDER BY score DESC) - 1 AS tied,
               least(count(*) OVER (PARTITION BY l_orderkey), 3) AS size FROM {source})"""

ORACLES = {
    "burst_groups": f"WITH {_ISLANDS} SELECT island, count(*) AS frames, min(event_id) AS first_id, max(event_id) AS last_id, count(*) < 3 AS skip FROM i GROUP BY island",
    "burst_per_user": """
        WITH s AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w <= 86400 AND event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, event_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM s""",
    "burst_attributes": """
        WITH s AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w <= 172800 AND abs(value - lag(value) OVER w) < 40 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM s)
        SELECT user_id, island, count(*) AS frames, round(sum(value), 4) AS total FROM i GROUP BY ALL""",
    "burst_split": f"""
        WITH {_ISLANDS}, p AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY ts, event_id) AS place, count(*) OVER (PARTITION BY island) AS size FROM i)
        SELECT island, (place - 1) // 10 AS chunk, count(*) AS frames, min(event_id) AS first_id, max(size) AS size, max(size) > 10 AS oversized FROM p GROUP BY ALL""",
    "session_bursts": """
        WITH s AS (SELECT *, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w <= 21600 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM s)
        SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(*) AS frames, round(sum(value), 4) AS total FROM i GROUP BY user_id, island""",
    "hard_filter": f"""
        WITH b AS (SELECT l_orderkey, l_linenumber, {_LINE} FROM lineitem)
        SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN motion > 0.35 THEN 'motion_blur' END, CASE WHEN detail < 3.0 THEN 'low_detail' END, CASE WHEN highlight > 0.03 THEN 'highlight_clip' END,
               CASE WHEN shadow > 0.20 THEN 'shadow_clip' END) AS reasons, NOT (motion > 0.35 OR detail < 3.0 OR highlight > 0.03 OR shadow > 0.20) AS passed FROM b""",
    "batch_select": f"WITH {_SCORED}, p AS (SELECT * FROM scored WHERE passed), {_TOP.format(source='p')} SELECT l_orderkey, l_linenumber, score, place, round(greatest(0.0, least(0.98, 0.50 + score / 10 + (size - place) * 0.02)), 3) AS confidence FROM ranked WHERE place < 3",
    "burst_select_ties": f"WITH {_SCORED}, p AS (SELECT l_orderkey, l_linenumber, floor(score) AS score FROM scored), {_TOP.format(source='p')} SELECT l_orderkey, l_linenumber, score, place, round(greatest(0.0, least(0.98, 0.50 + score / 10 + (size - tied) * 0.02)), 3) AS confidence FROM ranked WHERE place < 3",
    "batch_status_lists": f"""
        WITH {_SCORED}, p AS (SELECT * FROM scored WHERE passed), {_TOP.format(source='p')},
        c AS (SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(0.98, 0.50 + score / 10 + (size - place) * 0.02)), 3) AS confidence FROM ranked WHERE place < 3),
        m AS (SELECT l_orderkey % 8 AS grp, score, CASE WHEN NOT passed THEN 'rejected' WHEN confidence IS NULL THEN 'skipped' WHEN confidence < 0.5 THEN 'manual_review' WHEN confidence >= 0.6 THEN 'recommended' ELSE 'candidate' END AS status
              FROM scored LEFT JOIN c USING (l_orderkey, l_linenumber))
        SELECT grp, status, count(*) AS lines, round(avg(score), 4) AS mean_score FROM m GROUP BY GROUPING SETS ((grp, status), (status), ())""",
    "score_calibration": "SELECT vec_id, "
    + ", ".join(f"round(greatest(0.0, least(5.0, 2 + (CAST(embedding[1] AS DOUBLE) - ({lo})) * (2 / ({hi} - ({lo}))))), 5) AS {name}" for name, (lo, hi) in batch.ANCHORS.items())
    + " FROM embeddings",
    "state_audit": f"""
        WITH s AS (SELECT user_id, event_id, ts, {_STATE} AS state, CASE WHEN value > 20 THEN 'because' ELSE '' END AS reason FROM events),
        b AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'RAW_PENDING') AS before FROM s),
        r AS (SELECT *, coalesce(sum(CASE WHEN before = 'FINAL_QC' AND state IN ('COLOR_CORRECTING', 'EXPOSURE_ALIGNING') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rollbacks FROM b),
        allowed(f, t) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in states.ALLOWED)})
        SELECT user_id, event_id, before, state,
               CASE WHEN f IS NULL THEN 'illegal' WHEN state = 'MANUAL_REVIEW' AND trim(reason) = '' THEN 'reason'
                    WHEN before = 'FINAL_QC' AND state IN ('COLOR_CORRECTING', 'EXPOSURE_ALIGNING') AND rollbacks >= 1 THEN 'rollback_limit' ELSE 'ok' END AS verdict,
               CASE WHEN state = 'MANUAL_REVIEW' THEN 'AGENT_ESCALATED' WHEN before = 'FINAL_QC' AND state = 'ACCEPTED' THEN 'FINAL_QC_ACCEPT' WHEN before = 'FINAL_QC' AND state = 'REJECTED' THEN 'FINAL_QC_REJECT'
                    WHEN before = 'FINAL_QC' AND state IN ('COLOR_CORRECTING', 'EXPOSURE_ALIGNING') THEN 'QC_ROLLBACK' ELSE 'STATE_CHANGE' END AS emitted
        FROM r LEFT JOIN allowed ON f = before AND t = state""",
    "latest_state": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "jnd_runs": """
        WITH s AS (SELECT *, sum(CASE WHEN value < 23 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events),
        r AS (SELECT user_id, event_id, sum(CASE WHEN value < 23 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS streak FROM s)
        SELECT user_id, event_id, streak, streak >= 2 AS converged FROM r""",
    "trace_filter": "SELECT event_id, value FROM events WHERE event_type = 'click' AND user_id = 7",
    "trace_group_by_param": """
        WITH p AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS place FROM events),
        b AS (SELECT user_id, event_type, (place - 1) // 1000 AS block, count(*) AS n, md5(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY place)) AS d FROM p GROUP BY ALL)
        SELECT user_id, event_type, sum(n)::BIGINT AS events, md5(string_agg(d, ',' ORDER BY block)) AS digest FROM b GROUP BY ALL""",
    "trace_param_delta": """
        WITH s AS (SELECT conv_id, turn, role, length(text) AS chars, CASE WHEN role = 'user' THEN length(text) END AS u FROM conversations)
        SELECT conv_id, turn, role, last_value(u IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_user_chars,
               chars - lag(chars) OVER (PARTITION BY conv_id ORDER BY turn, role) AS delta FROM s""",
    "improvement": "SELECT user_id, event_id, CASE WHEN lag(value) OVER w IS NULL THEN 0.0 ELSE round(greatest(0.0, abs(lag(value) OVER w - 50) - abs(value - 50)), 6) END AS gain FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "rule_ids_union": """
        WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL)
        SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM f GROUP BY user_id""",
    "first_snapshot": "SELECT user_id, event_id, strftime(ts, '%Y-%m-%d') AS day FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1",
    "degradation_ledger": "SELECT event_type, user_id % 10 AS path, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY ALL",
    "review_summary": """
        SELECT o_orderpriority, count(*) AS total, count_if(o_orderstatus = 'F') AS accepted, count_if(o_orderstatus = 'O') AS pending, count_if(o_orderstatus = 'P') AS edited,
               round(count_if(o_orderstatus = 'F') / count(*), 6) AS rate, date_diff('day', min(o_orderdate), max(o_orderdate)) AS days FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""",
    "review_stats_rows": """
        SELECT 'total' AS stat, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'accepted', CAST(count_if(o_orderstatus = 'F') AS DOUBLE) FROM orders
        UNION ALL SELECT 'mean_price', round(avg(o_totalprice), 4) FROM orders""",
    "retention_ttl_cap": """
        SELECT user_id, event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAYS
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 25""",
    "lru_bytes": """
        WITH s AS (SELECT source, doc_id, sum(n_chars) OVER w AS used, count(*) OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING))
        SELECT source, doc_id, used FROM s WHERE used <= 60000 OR n = 1""",
}
