"""Per-item loops and their replay: a bounded measure-decide-apply loop inside the row, and recorded transitions replayed into a store."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import states, stretches
from tessera.operators.rules import QC_LIMIT
from tessera.operators.toning import bound

#: How a loop ends, in the order in which the exits of a round are asked for.
EXITS = ("stopped", "manual_review", "accepted", "stagnated", "converged", "unchanged", "max_iterations")


def bounded_loop(
    items: DataFrame, start: Column, measure: Callable[[Column], Column], propose: Callable[[Column, Column], Column], *, rounds: int, accept: float,
    gain: float = 0.0, patience: int = 2, still: float | None = None, window: int = 2, tolerance: float = 0.0, stop_before: Column | None = None,
) -> DataFrame:
    """Add params, exit, iterations, score, best_score, best_round and rolled_back to items: at most `rounds` rounds for each.

    A round measures the parameters it has, measure(params) -> struct(score, signal, reliable), and may then end the loop:

    * stopped: the round is the one before which a stop was asked for (stop_before; nothing is measured);
    * manual_review: the measurement isn't reliable;
    * accepted: the score reaches `accept`;
    * stagnated: the score has risen by no more than `gain` in `patience` rounds on end;
    * converged: the signal has moved by less than `still` in `window` rounds on end (never, if still is None);
    * unchanged: propose(params, measurement) gives the same parameters, or null;
    * max_iterations: the proposal of the last round is taken, and measured once more.

    Otherwise the proposal is taken. Where the loop ends with a score more than `tolerance` below the best one seen, and it wasn't
    stopped or sent to review, the best parameters are restored (rolled_back) and score is theirs. A null score counts as
    unreliable. All rounds are one expression over the row: no join, no shuffle, no driver loop.
    """
    null_double = F.lit(None).cast("double")
    first = F.struct(start.alias("params"), F.lit(None).cast("string").alias("exit"), F.lit(0).alias("iterations"), null_double.alias("score"), null_double.alias("signal"), start.alias("best"), null_double.alias("best_score"), F.lit(0).alias("best_round"), F.lit(0).alias("flat"), F.lit(0).alias("calm"))

    def measured(state: Column, now: Column, number: Column) -> Column:
        flat = F.when(state["score"].isNotNull() & (now["score"] - state["score"] <= gain), state["flat"] + 1).otherwise(0)
        calm = F.lit(0) if still is None else F.when(state["signal"].isNotNull() & (F.abs(now["signal"] - state["signal"]) < still), state["calm"] + 1).otherwise(0)
        sound = F.coalesce(now["reliable"], F.lit(False)) & now["score"].isNotNull()
        better = sound & (state["best_score"].isNull() | (now["score"] > state["best_score"]))
        best = [F.when(better, a).otherwise(state[n]).alias(n) for n, a in (("best", state["params"]), ("best_score", now["score"]), ("best_round", number))]
        reached = F.when(~sound, "manual_review").when(now["score"] >= accept, "accepted").when(flat >= patience, "stagnated").when(calm >= window, "converged")

        def after(asked: Column) -> Column:
            same = asked.isNull() | (asked == state["params"])
            ended = F.coalesce(reached, F.when(same, "unchanged").when(number >= rounds, "max_iterations"))
            taken = F.when(ended.isNull() | (ended == "max_iterations"), asked).otherwise(state["params"])
            return F.struct(taken.alias("params"), ended.alias("exit"), number.alias("iterations"), now["score"].cast("double").alias("score"), now["signal"].cast("double").alias("signal"), *best, flat.alias("flat"), calm.alias("calm"))

        return bound(propose(state["params"], now), after)

    def step(state: Column, number: Column) -> Column:
        halted = F.lit(False) if stop_before is None else F.coalesce(stop_before <= number, F.lit(False))
        names = ("params", "exit", "iterations", "score", "signal", "best", "best_score", "best_round", "flat", "calm")
        stopped = F.struct(*[F.lit("stopped").alias("exit") if n == "exit" else state[n].alias(n) for n in names])
        return F.when(state["exit"].isNotNull(), state).when(halted, stopped).otherwise(bound(measure(state["params"]), lambda now: measured(state, now, number)))

    ran = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step)
    done = items.select(*items.columns, ran.alias("__s"))
    # The last round's proposal hasn't been measured yet.
    last = F.when(F.col("__s.exit") == "max_iterations", measure(F.col("__s.params"))["score"].cast("double")).otherwise(F.col("__s.score"))
    done = done.withColumn("__last", last)
    better = (F.col("__s.exit") == "max_iterations") & (F.col("__last") > F.coalesce(F.col("__s.best_score"), F.lit(float("-inf"))))
    back = F.coalesce(~F.col("__s.exit").isin("stopped", "manual_review") & (F.coalesce(F.col("__last"), F.lit(float("-inf"))) < F.col("__s.best_score") - tolerance), F.lit(False))
    return done.select(
        *items.columns, F.when(back, F.col("__s.best")).otherwise(F.col("__s.params")).alias("params"), F.col("__s.exit").alias("exit"), F.col("__s.iterations").alias("iterations"),
        F.when(back, F.col("__s.best_score")).otherwise(F.col("__last")).alias("score"), F.when(better, F.col("__last")).otherwise(F.col("__s.best_score")).alias("best_score"),
        F.when(better, F.col("__s.iterations") + 1).otherwise(F.col("__s.best_round")).alias("best_round"), back.alias("rolled_back"),
    )


def replay(store: DataFrame, events: DataFrame, key: str, order: Sequence[str], source: str = "loop") -> tuple[DataFrame, DataFrame]:
    """(store after, log): the recorded events of runs replayed into a store of states.

    store is (key, state), events (key, order..., event_type, new_value, reason), where the types STATE_CHANGE, AGENT_ESCALATED,
    QC_ROLLBACK, FINAL_QC_ACCEPT and FINAL_QC_REJECT are transitions. A key whose stored state is the first one gets all its
    transitions, if every one is allowed after the one before it, and its other events with `source`; outcome `replayed`. If one
    isn't, nothing is taken: outcome `refused` and the first violation. A key that has left the first state isn't replayed
    but gets one summary row in the log (`kept`), a key without events none (`idle`). Events of unknown keys are left out.

    store after is (key, state, outcome, violation), log (key, order..., event_type, source, old_value, new_value). Order goes by
    stretches, so one key may hold most events; null keys are no keys.
    """
    types = ("STATE_CHANGE", "AGENT_ESCALATED", "QC_ROLLBACK", "FINAL_QC_ACCEPT", "FINAL_QC_REJECT")
    known = store.where(F.col(key).isNotNull()).select(key, F.col("state").alias("__stored"))
    own = events.select(key, *order, "event_type", "new_value", "reason").join(known, key)
    moves = own.where(F.col("event_type").isin(*types) & (F.col("__stored") == states.INITIAL))
    chained = stretches.previous(stretches.cut(moves, [key], order), [key], order, "new_value", "__prior").drop("__stretch")
    chained = chained.withColumn("__old", F.coalesce(F.col("__prior.v"), F.lit(states.INITIAL))).drop("__prior")
    chained = chained.withColumn("__back", states.is_rollback(F.col("__old"), F.col("new_value")).cast("long"))
    counted = stretches.placed(chained, [key], order, "__back").drop("__place", "__size", "__total")
    broken = states.violation(F.col("__old"), F.col("new_value"), F.col("reason"), F.col("__used") - F.coalesce("__back", F.lit(0)))
    judged = counted.withColumn("__broken", broken)
    place = F.struct(*order)
    ends = judged.groupBy(key).agg(F.max_by("new_value", place).alias("__last"), F.min_by("__broken", F.when(F.col("__broken").isNotNull(), place)).alias("violation"))
    some = own.select(key).distinct().withColumn("__any", F.lit(True))
    after = known.join(ends, key, "left").join(some, key, "left")
    outcome = F.when(F.col("__any").isNull(), "idle").when(F.col("__stored") != states.INITIAL, "kept").when(F.col("violation").isNotNull(), "refused").otherwise("replayed")
    after = after.withColumn("outcome", outcome)
    state = F.when(F.col("outcome") == "replayed", F.coalesce("__last", "__stored")).otherwise(F.col("__stored"))
    result = after.select(key, state.alias("state"), "outcome", "violation")

    taken = result.where(F.col("outcome") == "replayed").select(key)
    transitions = judged.join(taken, key).select(key, *order, "event_type", F.lit("replay").alias("source"), F.col("__old").alias("old_value"), "new_value")
    others = own.where(~F.coalesce(F.col("event_type").isin(*types), F.lit(False))).join(taken, key).select(key, *order, "event_type", F.lit(source).alias("source"), F.lit(None).cast("string").alias("old_value"), "new_value")
    kept = own.join(result.where(F.col("outcome") == "kept").select(key), key).groupBy(key).agg(F.max(place).alias("__at"), F.max_by("new_value", F.when(F.col("event_type").isin(*types), place)).alias("new_value"), F.first("__stored").alias("__stored"))
    summary = kept.select(key, *[F.col(f"__at.{o}").alias(o) for o in order], F.lit("loop_summary").alias("event_type"), F.lit(source).alias("source"), F.col("__stored").alias("old_value"), "new_value")
    return result, transitions.unionByName(others).unionByName(summary)


WAY = ("RAW_PENDING", "SCREENED", "BASE_RENDERED", "EXPOSURE_ALIGNING", "COLOR_CORRECTING", "STYLE_APPLIED", "FINAL_QC")


def life_cycle(ran: DataFrame, overflow: Callable[[Column], Column], lowered: Callable[[Column], Column], limit: float = QC_LIMIT, locked: Column | None = None, rejected: Column | None = None) -> DataFrame:
    """Add state, path, reason, qc_ratio and rollbacks to what bounded_loop() gave; params are those that the item ends with.

    An item with a rejection (a text) goes to review after screening and keeps its parameters. Each round of the loop takes the
    item one state on, to STYLE_APPLIED at most; a stopped item stays where it is, one sent to review goes there from there. The
    others go on to the final check: overflow(params) up to the limit is accepted; above it, lowered(params) is tried, once,
    through EXPOSURE_ALIGNING and the states after it, unless `locked`; what is still above goes to review. A null overflow
    counts as 0. path has all states from the first to the last, reason says what decided. All of it is one projection.
    """
    way = [F.lit(s) for s in WAY]
    rounds = F.least(F.col("iterations") + 2, F.lit(5))
    so_far = F.slice(F.array(*way), F.lit(1), rounds + 1)
    review, accepted = F.array(F.lit("MANUAL_REVIEW")), F.array(F.lit("ACCEPTED"))
    whole, again = F.array(*way), F.array(*way[3:])
    kept = F.lit(False) if locked is None else F.coalesce(locked, F.lit(False))
    turned_down = F.lit(None).cast("string") if rejected is None else rejected

    def judged(first: Column) -> Column:
        def twice(params: Column) -> Column:
            def ended(second: Column) -> Column:
                over, over_again = first > limit, second > limit

                def row(path: Column, reason: str | Column, params_: Column, ratio: Column | None = None, rollbacks: int | Column = 0) -> Column:
                    return F.struct(
                        path.alias("path"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), params_.alias("params"),
                        (F.lit(None).cast("double") if ratio is None else ratio).alias("qc_ratio"), F.lit(rollbacks).alias("rollbacks"),
                    )

                own = F.col("params")
                out = F.when(turned_down.isNotNull(), row(F.concat(F.slice(whole, F.lit(1), F.lit(2)), review), turned_down, own))
                out = out.when(F.col("exit") == "stopped", row(so_far, "stopped", own)).when(F.col("exit") == "manual_review", row(F.concat(so_far, review), "unreliable", own))
                out = out.when(~over, row(F.concat(whole, accepted), "passed", own, first)).when(kept, row(F.concat(whole, review), "locked", own, first))
                out = out.when(~over_again, row(F.concat(whole, again, accepted), "passed_after_rollback", params, second, 1))
                return out.otherwise(row(F.concat(whole, again, review), "over_after_rollback", params, second, 1))

            return bound(F.coalesce(overflow(params).cast("double"), F.lit(0.0)), ended)

        return bound(lowered(F.col("params")), twice)

    done = ran.withColumn("__c", bound(F.coalesce(overflow(F.col("params")).cast("double"), F.lit(0.0)), judged))
    kept_names = [c for c in ran.columns if c != "params"]
    return done.select(*kept_names, F.col("__c.params").alias("params"), F.element_at("__c.path", -1).alias("state"), F.col("__c.path").alias("path"), F.col("__c.reason").alias("reason"), F.col("__c.qc_ratio").alias("qc_ratio"), F.col("__c.rollbacks").alias("rollbacks"))


def timeline(cycles: DataFrame, key: str) -> DataFrame:
    """(key, seq from 1, old_state, new_state, event_type, reason): one row per transition of each item's path."""

    def moves(path: Column) -> Column:
        each = F.transform(path, lambda state, i: F.struct((i + 1).alias("seq"), state.alias("old_state"), F.try_element_at(path, i + 2).alias("new_state")))
        return F.slice(each, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))

    # An outer explode leaves the path's expression where it is; a plain one would have it computed once more for a filter.
    steps = cycles.select(key, "reason", F.size("path").alias("__size"), F.explode_outer(bound(F.col("path"), moves)).alias("m")).where(F.col("m").isNotNull())
    old, new = F.col("m.old_state"), F.col("m.new_state")
    return steps.select(key, F.col("m.seq").alias("seq"), old.alias("old_state"), new.alias("new_state"), states.event_type(old, new).alias("event_type"), F.when(F.col("m.seq") == F.col("__size") - 1, F.col("reason")).otherwise("").alias("reason"))


def advanced(state: Column, target: str = "FINAL_QC") -> Column:
    """The states that an item still passes through on the straight way from its state to the target, in order; empty if it's there
    or not on that way."""
    end = WAY.index(target)
    ahead = F.lit(None).cast("array<string>")
    for i, name in enumerate(WAY[: end + 1]):
        ahead = F.when(state == name, F.array(*map(F.lit, WAY[i + 1 : end + 1])).cast("array<string>")).otherwise(ahead)
    return F.coalesce(ahead, F.array().cast("array<string>"))


