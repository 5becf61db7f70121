"""Queries of per-item loops and of their replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import loops, states
from tessera.operators.rules import QC_LIMIT, QC_STEP
from tessera.plans.sequences import _STATE
from tessera.plans.tables import table

TARGET, LIMIT, ROUNDS = 118.0, 1.5, 6


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, base, pull, stop): a brightness, how hard it is corrected (over 1: too hard), and a round before which to stop."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    items = table(spark, sf_dir, "embeddings").select("vec_id", (60 + 250 * e[0]).alias("base"), (1.2 + 4 * e[1]).alias("pull"), (F.col("vec_id") % 17 == 0).alias("early"))
    return items.select("vec_id", "base", "pull", F.when(F.col("early"), 3).alias("stop"))


def _measured(params: Column) -> Column:
    light = F.least(F.lit(255.0), F.greatest(F.col("base"), F.lit(4.0)) * F.pow(F.lit(2.0), params[0]))
    return F.struct((1 - F.abs(light - TARGET) / TARGET).alias("score"), light.alias("signal"), (light >= 8).alias("reliable"))


def _proposed(params: Column, now: Column) -> Column:
    step = F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.log2(TARGET / now["signal"]) * F.col("pull")))
    return F.array(F.round(params[0] + step, 6))


def exposure_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure brought to a target brightness in at most six rounds of bounded steps, best parameters kept."""
    found = loops.bounded_loop(_items(spark, sf_dir), F.array(F.lit(0.0)), _measured, _proposed, rounds=ROUNDS, accept=0.97, gain=0.001, patience=2, still=1.0, window=2, tolerance=0.01, stop_before=F.col("stop"))
    return found.select("vec_id", F.round(F.col("params")[0], 6).alias("exposure"), "exit", "iterations", F.round("score", 6).alias("score"), F.round("best_score", 6).alias("best_score"), "best_round", "rolled_back")


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop's items, with how much brighter than their mean their highlights are, taken through the whole life cycle."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    more = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("of"), (1.9 + 2 * e[2]).alias("peak"))
    items = _items(spark, sf_dir)
    items = items.join(more, items["vec_id"] == more["of"]).drop("of")
    ran = loops.bounded_loop(items, F.array(F.lit(0.0)), _measured, _proposed, rounds=ROUNDS, accept=0.97, gain=0.001, patience=2, still=1.0, window=2, tolerance=0.01, stop_before=F.col("stop"))

    def overflow(params: Column) -> Column:
        return F.greatest(F.lit(0.0), F.greatest(F.col("base"), F.lit(4.0)) * F.pow(F.lit(2.0), params[0]) * F.col("peak") / 255 - 1)

    lowered = lambda params: F.array(F.round(params[0] - QC_STEP, 6))
    return loops.life_cycle(ran, overflow, lowered, locked=F.col("vec_id") % 5 == 0, rejected=F.when(F.col("vec_id") % 23 == 0, "blurred"))


def life_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as an item: screened, exposed in a loop, checked, lowered once if it must be, accepted or sent to review."""
    found = _cycles(spark, sf_dir)
    return found.select("vec_id", "state", "reason", "rollbacks", F.size("path").alias("steps"), F.round(F.col("params")[0], 6).alias("exposure"), F.round("qc_ratio", 6).alias("qc_ratio"))


def life_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitions of all life cycles, counted by kind."""
    rows = loops.timeline(_cycles(spark, sf_dir), "vec_id")
    return rows.groupBy("old_state", "new_state", "event_type", "reason").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("latest"))


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A store of users' states (one in three has left the first) and their events as a run's records."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr(_STATE).alias("new_value"), F.when(F.col("value") > 20, "because").otherwise("").alias("reason"), "value")
    store = events.select("user_id").distinct().withColumn("state", F.when(F.col("user_id") % 3 == 0, "SCREENED").otherwise(states.INITIAL))
    # Early events are the straight way to the check, one state after the other; what follows is measured.
    place = F.dense_rank().over(_by_user())
    way = F.array(*map(F.lit, ("SCREENED", "BASE_RENDERED", "EXPOSURE_ALIGNING", "COLOR_CORRECTING", "STYLE_APPLIED", "FINAL_QC")))
    laid = events.withColumn("at", place)
    own = F.when(F.col("at") <= 6, F.try_element_at(way, F.col("at"))).otherwise(F.col("new_value"))
    kind = F.when((F.col("at") <= 6) | ((F.col("user_id") % 2 == 0) & (F.col("at") == 7)), "STATE_CHANGE").otherwise("measure")
    return store, laid.select("user_id", "ts", "event_id", kind.alias("event_type"), own.alias("new_value"), "reason")


def _by_user():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def replayed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after the replay of every user's run."""
    store, events = _events(spark, sf_dir)
    return loops.replay(store, events, "user_id", ["ts", "event_id"])[0]


def replayed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log that the replay leaves: transitions, other events with their source, and summaries."""
    store, events = _events(spark, sf_dir)
    return loops.replay(store, events, "user_id", ["ts", "event_id"])[1].select("user_id", "event_id", "event_type", "source", "old_value", "new_value")


def states_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states that every user's last one still has before it on the way to the final check."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr(_STATE).alias("state"))
    last = events.groupBy("user_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))
    return last.select("user_id", "state", F.array_join(loops.advanced(F.col("state")), ">").alias("ahead"))


QUERIES = {f.__name__: f for f in (exposure_loop, life_cycles, life_timeline, replayed_states, replayed_log, states_ahead)}

_WAY = ["SCREENED", "BASE_RENDERED", "EXPOSURE_ALIGNING", "COLOR_CORRECTING", "STYLE_APPLIED", "FINAL_QC"]
_LIGHT = "least(255.0::DOUBLE, greatest(base, 4.0) * pow(2.0::DOUBLE, {p}))"
_REPLAY_SQL = f"""
    s AS (SELECT user_id, ts, event_id, {_STATE} AS state, CASE WHEN value > 20 THEN 'because' ELSE '' END AS reason, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS at_ FROM events),
    own AS (SELECT user_id, ts, event_id, reason, user_id % 3 = 0 AS left_, CASE WHEN at_ <= 6 OR (user_id % 2 = 0 AND at_ = 7) THEN 'STATE_CHANGE' ELSE 'measure' END AS kind,
                   CASE WHEN at_ <= 6 THEN ({_WAY!r})[at_] ELSE state END AS new_value FROM s),
    moves AS (SELECT *, coalesce(lag(new_value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'RAW_PENDING') AS old_value FROM own WHERE kind = 'STATE_CHANGE' AND NOT left_),
    allowed(f, t) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in states.ALLOWED)}),
    judged AS (SELECT moves.*, CASE WHEN f IS NULL THEN 'illegal' WHEN new_value = 'MANUAL_REVIEW' AND trim(reason) = '' THEN 'reason' END AS broken FROM moves LEFT JOIN allowed ON f = old_value AND t = new_value),
    ends AS (SELECT user_id, arg_max(new_value, (ts, event_id)) AS last_, arg_min(broken, (ts, event_id)) FILTER (broken IS NOT NULL) AS violation FROM judged GROUP BY user_id),
    result AS (
        SELECT user_id, CASE WHEN left_ THEN 'SCREENED' WHEN violation IS NOT NULL THEN 'RAW_PENDING' ELSE coalesce(last_, 'RAW_PENDING') END AS state, CASE WHEN left_ THEN 'kept' WHEN violation IS NOT NULL THEN 'refused' ELSE 'replayed' END AS outcome, violation
        FROM (SELECT DISTINCT user_id, left_ FROM own) LEFT JOIN ends USING (user_id)
    )
"""

_LOOP_SQL = f"""
        WITH RECURSIVE items AS (
            SELECT vec_id, 60 + 250 * CAST(embedding[1] AS DOUBLE) AS base, 1.2::DOUBLE + 4 * CAST(embedding[2] AS DOUBLE) AS pull, CASE WHEN vec_id % 17 = 0 THEN 3 END AS stop FROM embeddings
        ), run(vec_id, base, pull, stop, n, p, ended, iterations, score, light, best, best_score, best_round, flat, calm) AS (
            SELECT vec_id, base, pull, stop, 0, 0.0::DOUBLE, NULL::VARCHAR, 0, NULL::DOUBLE, NULL::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE, 0, 0, 0 FROM items
            UNION ALL
            SELECT vec_id, base, pull, stop, n + 1, CASE WHEN halted OR (e IS NOT NULL AND e <> 'max_iterations') THEN p ELSE asked END, CASE WHEN halted THEN 'stopped' ELSE e END, CASE WHEN halted THEN iterations ELSE n + 1 END,
                   CASE WHEN halted THEN score ELSE s2 END, CASE WHEN halted THEN light ELSE l2 END, CASE WHEN NOT halted AND better THEN p ELSE best END, CASE WHEN NOT halted AND better THEN s2 ELSE best_score END,
                   CASE WHEN NOT halted AND better THEN n + 1 ELSE best_round END, f2, c2
            FROM (
                SELECT *, CASE WHEN NOT ok THEN 'manual_review' WHEN s2 >= 0.97 THEN 'accepted' WHEN f2 >= 2 THEN 'stagnated' WHEN c2 >= 2 THEN 'converged' WHEN asked = p THEN 'unchanged' WHEN n + 1 >= {ROUNDS} THEN 'max_iterations' END AS e
                FROM (
                    SELECT *, l2 >= 8 AS ok, l2 >= 8 AND (best_score IS NULL OR s2 > best_score) AS better, CASE WHEN score IS NOT NULL AND s2 - score <= 0.001 THEN flat + 1 ELSE 0 END AS f2,
                           CASE WHEN light IS NOT NULL AND abs(l2 - light) < 1.0 THEN calm + 1 ELSE 0 END AS c2, round(p + greatest(-1.5, least(1.5, log2({TARGET} / l2) * pull)), 6) AS asked
                    FROM (SELECT *, 1 - abs(l2 - {TARGET}) / {TARGET} AS s2 FROM (SELECT *, coalesce(stop <= n + 1, false) AS halted, {_LIGHT.format(p="p")} AS l2 FROM run WHERE ended IS NULL AND n < {ROUNDS}))
                )
            )
        ), done AS (SELECT *, CASE WHEN ended = 'max_iterations' THEN 1 - abs({_LIGHT.format(p="p")} - {TARGET}) / {TARGET} ELSE score END AS last_ FROM run WHERE ended IS NOT NULL
        ), judged AS (SELECT *, coalesce(ended NOT IN ('stopped', 'manual_review') AND coalesce(last_, -1e300) < best_score - 0.01, false) AS back, coalesce(ended = 'max_iterations' AND last_ > coalesce(best_score, -1e300), false) AS better FROM done)
"""

#: The loop's end, then the checks: ratios before and after the one lowering, the path and what decided it.
_CYCLE_SQL = f"""{_LOOP_SQL.rstrip()}
        , looped AS (SELECT vec_id, base, iterations, ended, CASE WHEN back THEN best ELSE p END AS p1 FROM judged
        ), peaks AS (SELECT l.*, 1.9::DOUBLE + 2 * CAST(embedding[3] AS DOUBLE) AS peak, round(p1 - {QC_STEP}, 6) AS low FROM looped l JOIN embeddings USING (vec_id)
        ), ratios AS (SELECT *, greatest(0.0, greatest(base, 4.0) * pow(2.0::DOUBLE, p1) * peak / 255 - 1) AS r1, greatest(0.0, greatest(base, 4.0) * pow(2.0::DOUBLE, low) * peak / 255 - 1) AS r2 FROM peaks
        ), kinds AS (SELECT *, CASE WHEN vec_id % 23 = 0 THEN 'blurred' WHEN ended = 'stopped' THEN 'stopped' WHEN ended = 'manual_review' THEN 'unreliable' WHEN r1 <= {QC_LIMIT} THEN 'passed' WHEN vec_id % 5 = 0 THEN 'locked'
                            WHEN r2 <= {QC_LIMIT} THEN 'passed_after_rollback' ELSE 'over_after_rollback' END AS reason FROM ratios
        ), paths AS (
            SELECT *, CASE WHEN reason = 'blurred' THEN {list(loops.WAY[:2])!r} || ['MANUAL_REVIEW'] WHEN reason = 'stopped' THEN {list(loops.WAY)!r}[1:least(iterations + 2, 5) + 1] WHEN reason = 'unreliable' THEN {list(loops.WAY)!r}[1:least(iterations + 2, 5) + 1] || ['MANUAL_REVIEW']
                           ELSE {list(loops.WAY)!r} || CASE WHEN reason LIKE '%rollback' THEN {list(loops.WAY[3:])!r} ELSE [] END || [CASE WHEN reason LIKE 'passed%' THEN 'ACCEPTED' ELSE 'MANUAL_REVIEW' END] END AS path FROM kinds
        ), cycles AS (
            SELECT vec_id, reason, path, path[len(path)] AS state, CASE WHEN reason LIKE '%rollback' THEN 1 ELSE 0 END AS rollbacks, CASE WHEN reason LIKE '%rollback' THEN low ELSE p1 END AS p2,
                   CASE WHEN reason LIKE '%rollback' THEN r2 WHEN reason IN ('passed', 'locked') THEN r1 END AS ratio FROM paths
        )
"""

ORACLES = {
    "exposure_loop": f"""{_LOOP_SQL}
        SELECT vec_id, round(CASE WHEN back THEN best ELSE p END, 6) AS exposure, ended AS exit, iterations, round(CASE WHEN back THEN best_score ELSE last_ END, 6) AS score,
               round(CASE WHEN better THEN last_ ELSE best_score END, 6) AS best_score, CASE WHEN better THEN iterations + 1 ELSE best_round END AS best_round, back AS rolled_back
        FROM judged""",
    "life_cycles": f"{_CYCLE_SQL} SELECT vec_id, state, reason, rollbacks, CAST(len(path) AS INTEGER) AS steps, round(p2, 6) AS exposure, round(ratio, 6) AS qc_ratio FROM cycles",
    "life_timeline": f"""
        {_CYCLE_SQL}, steps AS (SELECT path, reason, unnest(range(1, len(path))) AS seq FROM cycles), moves AS (SELECT path[seq] AS old_state, path[seq + 1] AS new_state, seq, CASE WHEN seq = len(path) - 1 THEN reason ELSE '' END AS reason FROM steps)
        SELECT old_state, new_state, CASE WHEN new_state = 'MANUAL_REVIEW' THEN 'AGENT_ESCALATED' WHEN new_state = 'ACCEPTED' THEN 'FINAL_QC_ACCEPT' WHEN old_state = 'FINAL_QC' THEN 'QC_ROLLBACK' ELSE 'STATE_CHANGE' END AS event_type, reason, count(*) AS n, CAST(max(seq) AS INTEGER) AS latest
        FROM moves GROUP BY ALL""",
    "replayed_states": f"WITH {_REPLAY_SQL} SELECT user_id, state, outcome, violation FROM result",
    "replayed_log": f"""
        WITH {_REPLAY_SQL}
        SELECT user_id, event_id, 'STATE_CHANGE' AS event_type, 'replay' AS source, old_value, new_value FROM judged JOIN result USING (user_id) WHERE outcome = 'replayed'
        UNION ALL SELECT user_id, event_id, kind, 'loop', NULL, new_value FROM own JOIN result USING (user_id) WHERE outcome = 'replayed' AND kind = 'measure'
        UNION ALL SELECT user_id, arg_max(event_id, (ts, event_id)), 'loop_summary', 'loop', 'SCREENED', arg_max(new_value, (ts, event_id)) FILTER (kind = 'STATE_CHANGE') FROM own WHERE left_ GROUP BY user_id""",
    "states_ahead": f"""
        WITH s AS (SELECT user_id, ts, event_id, {_STATE} AS state FROM events), l AS (SELECT user_id, arg_max(state, (ts, event_id)) AS state FROM s GROUP BY user_id)
        SELECT user_id, state, coalesce(array_to_string(({_WAY!r})[CASE state WHEN 'RAW_PENDING' THEN 1 ELSE list_position({_WAY!r}, state) + 1 END:], '>'), '') AS ahead FROM l""",
}
