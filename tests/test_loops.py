"""Bounded loops against a plain loop, and the replay of recorded transitions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import loops, states


def _measure(params):
    light = F.least(F.lit(255.0), F.col("base") * F.pow(F.lit(2.0), params[0]))
    return F.struct(F.when(F.col("base") < 500, 1 - F.abs(light - 118) / 118).alias("score"), light.alias("signal"), (light >= 8).alias("reliable"))


def _propose(params, now):
    step = F.greatest(F.lit(-1.5), F.least(F.lit(1.5), F.log2(118 / now["signal"]) * F.col("pull")))
    return F.when(F.col("pull") != 9, F.array(F.round(params[0] + step, 6)))


def _plain(base, pull, stop, rounds, accept, gain, patience, still, window, tolerance):
    params, best, flat, calm, score, light = 0.0, None, 0, 0, None, None

    def measure(p):
        value = min(255.0, base * 2**p)
        return (1 - abs(value - 118) / 118 if base < 500 else None), value, value >= 8

    end, number = None, 0
    for number in range(1, rounds + 1):
        if stop is not None and stop <= number:
            end, number = "stopped", number - 1
            break
        now, signal, reliable = measure(params)
        flat = flat + 1 if score is not None and now is not None and now - score <= gain else 0
        calm = calm + 1 if still is not None and light is not None and abs(signal - light) < still else 0
        score, light = now, signal
        if not reliable or now is None:
            end = "manual_review"
            break
        if best is None or now > best[0]:
            best = (now, params, number)
        asked = None if pull == 9 else round(params + max(-1.5, min(1.5, math.log2(118 / signal) * pull)), 6)
        if now >= accept:
            end = "accepted"
        elif flat >= patience:
            end = "stagnated"
        elif calm >= window:
            end = "converged"
        elif asked is None or asked == params:
            end = "unchanged"
        elif number == rounds:
            params, end = asked, "max_iterations"
            score = measure(params)[0]
        else:
            params = asked
        if end:
            break
    shown = best
    if end == "max_iterations" and score > best[0]:
        shown = (score, params, number + 1)
    if end not in ("stopped", "manual_review") and score < best[0] - tolerance:
        return best[1], end, number, best[0], best[0], best[2], True
    return params, end, number, score, shown and shown[0], shown[2] if shown else 0, False


CASES = [(30.0, 0.6, None), (110.0, 1.0, None), (30.0, 2.2, None), (100.0, 1.9, None), (118.0, 1.0, None), (5.0, 1.0, None), (60.0, 0.01, None), (60.0, 9.0, None), (60.0, 0.5, 3), (60.0, 0.5, 1), (900.0, 1.0, None), (40.0, 1.75, None), (90.0, 2.4, 0), (90.0, 2.4, None), (60.0, 0.001, None)]


@pytest.mark.parametrize("settings", [(6, 0.97, 0.001, 2, 1.0, 2, 0.01), (3, 0.9999, 0.0, 2, None, 2, 0.0), (1, 0.9, 0.0, 1, 5.0, 1, 0.5)])
def test_loop_equals_a_plain_loop(spark, settings):
    rounds, accept, gain, patience, still, window, tolerance = settings
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "id int, base double, pull double, stop int")
    found = loops.bounded_loop(frame, F.array(F.lit(0.0)), _measure, _propose, rounds=rounds, accept=accept, gain=gain, patience=patience, still=still, window=window, tolerance=tolerance, stop_before=F.col("stop"))
    for r in found.collect():
        params, end, number, score, best, at, back = _plain(*CASES[r.id], *settings)
        assert (r.exit, r.iterations, r.best_round, r.rolled_back) == (end, number, at, back), (CASES[r.id], r)
        assert math.isclose(r.params[0], params, abs_tol=1e-9)
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-9)) for a, b in ((r.score, score), (r.best_score, best)))


def test_every_exit_is_reached(spark):
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "id int, base double, pull double, stop int")
    seen = set()
    for accept, still in ((0.97, 1.0), (0.99999, None), (2.0, 3.0)):
        found = loops.bounded_loop(frame, F.array(F.lit(0.0)), _measure, _propose, rounds=3, accept=accept, gain=-9.0 if still is None else 0.001, still=still, stop_before=F.col("stop"))
        seen |= {r.exit for r in found.collect()}
    assert seen == set(loops.EXITS)


def test_the_loop_is_one_projection(spark):
    frame = spark.createDataFrame([(1, 30.0, 0.6, None)], "id int, base double, pull double, stop int")
    plan = loops.bounded_loop(frame, F.array(F.lit(0.0)), _measure, _propose, rounds=4, accept=0.9)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


WAY = ["SCREENED", "BASE_RENDERED", "EXPOSURE_ALIGNING", "COLOR_CORRECTING", "STYLE_APPLIED", "FINAL_QC"]


def test_replay(spark):
    def run(key, moves, kind="STATE_CHANGE", reason="r", start=0):
        return [(key, start + i, kind, m, reason) for i, m in enumerate(moves)]

    events = run("whole", WAY) + run("whole", ["ACCEPTED"], "FINAL_QC_ACCEPT", start=10) + [("whole", 4, "measure", "m", None), ("whole", 99, None, None, None)]
    events += run("broken", ["SCREENED", "FINAL_QC", "ACCEPTED"]) + run("left", WAY[:3]) + [("left", 50, "measure", "m", None)]
    events += run("back", [*WAY, "COLOR_CORRECTING"]) + run("back", ["STYLE_APPLIED", "FINAL_QC", "EXPOSURE_ALIGNING"], "QC_ROLLBACK", start=20)
    events += run("unexplained", ["SCREENED", "MANUAL_REVIEW"], reason=" ") + run("unknown", WAY) + run(None, WAY) + [("talk", 1, "measure", "m", None)]
    store = spark.createDataFrame([(k, states.INITIAL) for k in ("whole", "broken", "back", "unexplained", "idle", "talk")] + [("left", "SCREENED"), (None, "SCREENED")], "key string, state string")
    frame = spark.createDataFrame(events, "key string, seq int, event_type string, new_value string, reason string").repartition(5)
    after, log = loops.replay(store, frame, "key", ["seq"])
    found = {r.key: (r.state, r.outcome, r.violation) for r in after.collect()}
    assert found == {
        "whole": ("ACCEPTED", "replayed", None), "broken": (states.INITIAL, "refused", "illegal"), "back": (states.INITIAL, "refused", "rollback_limit"), "unexplained": (states.INITIAL, "refused", "reason"),
        "idle": (states.INITIAL, "idle", None), "talk": (states.INITIAL, "replayed", None), "left": ("SCREENED", "kept", None),
    }
    rows = sorted((r.key, r.seq, str(r.event_type), r.source, str(r.old_value), str(r.new_value)) for r in log.collect())
    whole = [("whole", i, "STATE_CHANGE", "replay", [states.INITIAL, *WAY][i], m) for i, m in enumerate(WAY)] + [("whole", 10, "FINAL_QC_ACCEPT", "replay", "FINAL_QC", "ACCEPTED"), ("whole", 4, "measure", "loop", "None", "m"), ("whole", 99, "None", "loop", "None", "None")]
    assert rows == sorted([*whole, ("left", 50, "loop_summary", "loop", "SCREENED", WAY[2]), ("talk", 1, "measure", "loop", "None", "m")])


def test_the_way_ahead(spark):
    frame = spark.createDataFrame([("RAW_PENDING",), ("STYLE_APPLIED",), ("FINAL_QC",), ("ACCEPTED",), (None,)], "state string")
    assert [r[0] for r in frame.select(loops.advanced(F.col("state"))).collect()] == [WAY, ["FINAL_QC"], [], [], []]
    assert frame.select(loops.advanced(F.col("state"), "SCREENED")).first()[0] == ["SCREENED"]


def test_life_cycle(spark):
    cases = [  # exit, iterations, overflow before, overflow after, locked, rejected: state, reason, rollbacks, path's length
        ("accepted", 3, 0.0, 0.0, False, None, "ACCEPTED", "passed", 0, 8), ("accepted", 3, 0.5, 0.0, False, None, "ACCEPTED", "passed_after_rollback", 1, 12), ("max_iterations", 6, 0.5, 0.4, False, None, "MANUAL_REVIEW", "over_after_rollback", 1, 12),
        ("stagnated", 3, 0.5, 0.0, True, None, "MANUAL_REVIEW", "locked", 0, 8), ("stopped", 0, 0.5, 0.0, False, None, "BASE_RENDERED", "stopped", 0, 3), ("stopped", 9, 0.5, 0.0, False, None, "STYLE_APPLIED", "stopped", 0, 6),
        ("manual_review", 1, 0.0, 0.0, False, None, "MANUAL_REVIEW", "unreliable", 0, 5), ("accepted", 1, 0.0, 0.0, False, "blurred", "MANUAL_REVIEW", "blurred", 0, 3), ("converged", 2, None, None, None, None, "ACCEPTED", "passed", 0, 8),
    ]
    rows = [(i, c[0], c[1], [1.0], c[2], c[3], c[4], c[5]) for i, c in enumerate(cases)]
    ran = spark.createDataFrame(rows, "id int, exit string, iterations int, params array<double>, first double, second double, kept boolean, bad string")
    cycles = loops.life_cycle(ran, lambda params: F.when(params[0] == 1, F.col("first")).otherwise(F.col("second")), lambda params: F.array(params[0] - 0.15), locked=F.col("kept"), rejected=F.col("bad"))
    found = {r.id: r for r in cycles.collect()}
    allowed = set(states.ALLOWED)
    for i, case in enumerate(cases):
        r = found[i]
        assert (r.state, r.reason, r.rollbacks, len(r.path)) == case[6:], case
        assert r.path[0] == states.INITIAL and all(pair in allowed for pair in zip(r.path, r.path[1:], strict=False))
        assert r.params == ([0.85] if r.rollbacks else [1.0])
    assert found[1].qc_ratio == 0.0 and found[2].qc_ratio == 0.4 and found[3].qc_ratio == 0.5 and found[4].qc_ratio is None and found[8].qc_ratio == 0.0
    rows = sorted((r.id, r.seq, r.old_state, r.new_state, r.event_type, r.reason) for r in loops.timeline(cycles, "id").collect())
    assert [r[1:] for r in rows if r[0] == 7] == [(1, "RAW_PENDING", "SCREENED", "STATE_CHANGE", ""), (2, "SCREENED", "MANUAL_REVIEW", "AGENT_ESCALATED", "blurred")]
    assert [r[3] for r in rows if r[0] == 1] == found[1].path[1:] and ("QC_ROLLBACK" in {r[4] for r in rows if r[0] == 1})
    assert sum(len(r.path) - 1 for r in found.values()) == len(rows)
