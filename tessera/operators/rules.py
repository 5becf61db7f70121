"""The rule engine: conditions, actions, conflicts, limiter, termination and the quality gate, all as column expressions.

A rule pack is small and known when the plan is made, so every rule becomes an expression over one row of metrics. Conflicts
are settled in the row too (the first rule in priority order whose condition holds), so applying a pack needs no join and no
shuffle, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.formula import compile_formula, names, unknown_names

# Named priorities, parameters that count as exposure, the gates.
PRIORITIES = {"user_locked": 10000, "user_lock": 10000, "user_preference": 9000, "high": 9000, "style_card": 6000, "medium": 6000, "system_default": 3000, "default": 3000, "low": 3000}
OVERFLOW_ALIASES = ("preview_overflow_ratio", "preview_clip_ratio", "clip_ratio", "overflow_ratio")
# Operators by the names that packs may use.
OPERATORS = {name: op for op, names_ in (("lt", "lt <"), ("le", "le lte <="), ("gt", "gt >"), ("ge", "ge gte >="), ("eq", "eq == ="), ("ne", "ne != neq <>"), ("between", "between"), ("in", "in")) for name in names_.split()}
OVERFLOW_LIMIT = 0.025
LOW_IMPROVEMENT = 0.1
MAX_ITERATIONS = 3
QC_LIMIT = 0.03
QC_STEP = -0.15


@dataclass(frozen=True)
class Condition:
    """metric op value; op is lt, le, gt, ge, eq, ne, between (inclusive) or in."""

    metric: str
    op: str
    value: object


@dataclass(frozen=True)
class Rule:
    rule_id: str
    priority: float | str | None
    conditions: tuple[Condition, ...]
    param: str
    formula: str | None = None
    value: float | None = None
    mode: str | None = None
    clamp: tuple[float | None, float | None] = (None, None)
    step_decay: float | None = None
    target: float | None = None
    enabled: bool = True
    level: str | None = None


# The shipped rule pack.
PACK = (
    Rule("exposure_rule_001", 10, (Condition("face_luminance", "lt", 110),), "exposure_ev", formula="2.2*log2(target/current)", mode="delta", clamp=(-0.5, 0.5), step_decay=0.5, target=118),
    Rule("crop_suggest_rule_003", 15, (Condition("crop_suggestion_applicable", "ge", 1),), "compose.apply_suggestion", formula="1", mode="set"),
    Rule("highlight_protect_rule_002", 20, (Condition("preview_highlight_clip_estimate", "ge", 0.025),), "exposure_ev", formula="-0.15", mode="set", clamp=(-0.5, 0)),
    Rule("region_sky_exposure_001", 20, (Condition("sky_luminance", "gt", 150), Condition("sky_area_ratio", "lt", 0.70), Condition("sky_reliable", "eq", True)), "region.sky.exposure", formula="-0.5*(sky_luminance/150)", mode="set", clamp=(-2, 0)),
    Rule("region_plant_exposure_002", 20, (Condition("plant_luminance", "lt", 70), Condition("plant_area_ratio", "lt", 0.70), Condition("preview_overflow_ratio", "lt", 0.01), Condition("plant_reliable", "eq", True)), "region.plant.exposure", formula="0.2*((70-plant_luminance)/70)", mode="set", clamp=(0, 2)),
    Rule("vibrance_low_rule", 30, (Condition("colorfulness_proxy", "le", 4.78),), "vibrance.strength", value=0.3, mode="set", clamp=(0.15, 0.4)),
    Rule("dehaze_rule_030", 30, (Condition("haze_proxy", "ge", 0.22),), "dehaze.strength", formula="0.06", mode="delta", clamp=(0.15, 0.45), step_decay=0.5),
    Rule("saturation_high_rule", 31, (Condition("colorfulness_proxy", "ge", 6.13),), "saturation.adjust", value=-0.15, mode="set", clamp=(-0.25, -0.1)),
    Rule("clarity_flat_rule_031", 31, (Condition("haze_proxy", "ge", 0.12), Condition("haze_proxy", "lt", 0.22), Condition("tonal_range", "le", 0.46)), "clarity.strength", formula="0.04", mode="delta", clamp=(0.10, 0.30)),
    Rule("shadow_open_rule_032", 32, (Condition("shadow_clip_ratio", "ge", 0.18),), "tone.shadows", formula="0.05", mode="delta", clamp=(-1, 1)),
    Rule("highlight_recover_rule_033", 33, (Condition("preview_highlight_clip_estimate", "ge", 0.025),), "tone.highlights", formula="-0.08", mode="set", clamp=(-0.15, 0)),
    Rule("noise_luminance_rule_040", 40, (Condition("noise_ratio", "ge", 0.62),), "denoise.luminance_strength", formula="0.5*(noise_ratio/0.62-1)", mode="set", clamp=(0, 0.6), enabled=False),
)


def priority(rule: Rule) -> float:
    """A number (also as text) or a named level in any case, unknown ones 0; without priority the rule's level, else the default's."""
    given = rule.priority if rule.priority is not None else rule.level or "default"
    if isinstance(given, (int, float)):
        return float(given)
    if given.lower() in PRIORITIES:
        return float(PRIORITIES[given.lower()])
    try:
        return float(given) if rule.priority is not None else 0.0
    except ValueError:
        return 0.0


def predicate(condition: Condition, metrics: Mapping[str, Column]) -> Column:
    """The condition on a row; a missing metric makes it false, never null."""
    column = metrics.get(condition.metric)
    if column is None:
        return F.lit(False)
    value, op = condition.value, OPERATORS.get(condition.op.lower())
    if op is None:
        raise ValueError(f"unknown operator {condition.op!r} on {condition.metric}")
    if op == "between":
        held = column.between(value[0], value[1])
    elif op == "in":
        held = column.isin(list(value))
    else:
        other = F.lit(float(value) if isinstance(value, (bool, int, float)) else value)
        held = {"lt": column < other, "le": column <= other, "gt": column > other, "ge": column >= other, "eq": column == other, "ne": column != other}[op]
    return F.coalesce(held, F.lit(False))


def holds(rule: Rule, metrics: Mapping[str, Column]) -> Column:
    """All conditions of a rule; a rule without any always holds."""
    out = F.lit(True)
    for condition in rule.conditions:
        out = out & predicate(condition, metrics)
    return out


def clamp(value: Column, low: float | None, high: float | None) -> Column:
    """Bounds that are None are open; a null value stays null."""
    if high is not None:
        value = F.when(value.isNotNull(), F.least(value, F.lit(float(high))))
    if low is not None:
        value = F.when(value.isNotNull(), F.greatest(value, F.lit(float(low))))
    return value


def action(rule: Rule, metrics: Mapping[str, Column], param: Column, iteration: Column) -> Column:
    """The new value of the rule's parameter. `current` is the first condition's metric, else the parameter; deltas shrink by step_decay per round."""
    current = metrics.get(rule.conditions[0].metric, param) if rule.conditions else param
    if rule.formula is not None:
        variables = dict(metrics) | {"current": current, "metric": current, "metric_value": current, "param": param, "param_current": param, "value": F.lit(rule.value).cast("double")}
        variables["target"] = F.lit(float(rule.target)) if rule.target is not None else current
        variables = dict.fromkeys(names(rule.formula), F.lit(None).cast("double")) | variables
        raw = compile_formula(rule.formula, variables)
    else:
        raw = F.lit(float(rule.value))
    if rule.step_decay is not None:
        raw = raw * F.pow(F.lit(float(rule.step_decay)), F.greatest(iteration - 1, F.lit(0)))
    mode = rule.mode or ("delta" if rule.formula is not None else "set")
    return clamp(param + raw if mode == "delta" else raw, *rule.clamp)


def is_exposure(param: str) -> bool:
    return "exposure" in param.lower()


def limiter_active(metrics: Mapping[str, Column]) -> Column:
    """Whether the first overflow alias with a value reaches the limit."""
    found = [metrics[a].cast("double") for a in OVERFLOW_ALIASES if a in metrics]
    return F.coalesce(F.coalesce(*found) >= OVERFLOW_LIMIT, F.lit(False)) if found else F.lit(False)


def lint(rules: Sequence[Rule], metric_names: set[str]) -> dict[str, list[str]]:
    """Formula names of each rule that no metric and no built-in variable has."""
    allowed = metric_names | {"current", "metric", "metric_value", "param", "param_current", "value", "target"}
    return {r.rule_id: bad for r in rules if r.formula and (bad := unknown_names(r.formula, allowed))}


def evaluate(rows: DataFrame, key: str, metrics: Sequence[str], rules: Sequence[Rule] = PACK, iteration: str | None = None, params: str | None = None, locked: Sequence[str] = ()) -> DataFrame:
    """One row (key, rule_id, ord, priority, param, old_value, new_value) per row and rule that holds and has a value."""
    given = {m: F.col(m) for m in metrics}
    at = F.col(iteration) if iteration else F.lit(1)
    hits = []
    for order, rule in enumerate(rules):
        if rule.enabled and rule.param not in locked:
            old = F.coalesce(F.try_element_at(F.col(params), F.lit(rule.param)), F.lit(0.0)) if params else F.lit(0.0)
            new = action(rule, given, old, at)
            fields = F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(order).alias("ord"), F.lit(priority(rule)).alias("priority"), F.lit(rule.param).alias("param"), old.alias("old_value"), new.alias("new_value"))
            hits.append(F.when(holds(rule, given) & new.isNotNull(), fields))
    return rows.select(key, F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(key, "hit.*")


def resolve_conflicts(results: DataFrame, key: str) -> DataFrame:
    """Of several results for a parameter the highest priority, then the earliest rule, wins; place is the parameter's first appearance."""
    best = Window.partitionBy(key, "param").orderBy(F.desc("priority"), "ord")
    first = F.min("ord").over(Window.partitionBy(key, "param"))
    return results.withColumn("place", first).withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def apply(rows: DataFrame, key: str, metrics: Sequence[str], rules: Sequence[Rule] = PACK, iteration: str | None = None, locked: Sequence[str] = ()) -> DataFrame:
    """(key, param, rule_id, old_value, new_value) of each parameter that changes: conflicts settled and the exposure limiter applied, in the row."""
    given = {m: F.col(m) for m in metrics}
    at = F.col(iteration) if iteration else F.lit(1)
    active = limiter_active(given)
    by_param: dict[str, list[tuple[float, int, Column]]] = {}
    for order, rule in enumerate(rules):
        if rule.enabled and rule.param not in locked:
            old = F.lit(0.0)
            new = action(rule, given, old, at)
            limited = F.when(active & (new > old), old).otherwise(new) if is_exposure(rule.param) else new
            fields = F.struct(F.lit(rule.param).alias("param"), F.lit(rule.rule_id).alias("rule_id"), old.alias("old_value"), limited.alias("new_value"))
            by_param.setdefault(rule.param, []).append((-priority(rule), order, F.when(holds(rule, given) & new.isNotNull(), fields)))
    winners = [F.coalesce(*[c for _, _, c in sorted(found, key=lambda x: x[:2])]) for found in by_param.values()]
    return rows.select(key, F.explode(F.array_compact(F.array(*winners))).alias("hit")).select(key, "hit.*")


def first_of(*branches: tuple[Column, object], default: object) -> Column:
    """An ordered decision list: the value of the first branch whose condition holds."""
    out = None
    for condition, value in branches:
        out = F.when(condition, F.lit(value)) if out is None else out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def target_met(metric: Column, target: Column, op: str, tolerance: float = 0.0) -> Column:
    """le/max, ge/min, or within the tolerance; false where either side is missing."""
    held = metric <= target + tolerance if op in ("le", "max") else metric >= target - tolerance if op in ("ge", "min") else F.abs(metric - target) <= tolerance
    return F.coalesce(held, F.lit(False))


def termination(
    unreliable: Column, irreparable: Column, locked_target: Column, goal: Column, met: Column, overall: Column, accept: Column, aesthetic: Column, stagnation: Column, history: Column, before: Column, now: Column, iteration: Column,
    threshold: float = LOW_IMPROVEMENT, max_iterations: int = MAX_ITERATIONS,
) -> Column:
    """The ordered stop list as struct<should_stop, decision, reason_code>.

    met is null without targets; overall, accept and stagnation switch their branches off where null; aesthetic and history are
    arrays of the rounds' gains, oldest first. The last round goes on: its corrections are still applied.
    """

    def last_two_below(values: Column, limit: Column) -> Column:
        return (F.size(values) >= 2) & (F.try_element_at(values, F.lit(-1)) < limit) & (F.try_element_at(values, F.lit(-2)) < limit)

    branches = (
        (unreliable, True, "manual_review", "unreliable"),
        (irreparable, True, "manual_review", "irreparable"),
        (locked_target & ~met, True, "manual_review", "user_locked_unmet"),
        (goal, True, "stopped", "targets_met"),
        (met, True, "stopped", "targets_met"),
        (overall >= accept, True, "stopped", "aesthetic_target_met"),
        (last_two_below(aesthetic, stagnation), True, "stopped", "aesthetic_stagnation"),
        (last_two_below(history, F.lit(threshold)), True, "stopped", "low_improvement"),
        ((before < threshold) & (now < threshold), True, "stopped", "low_improvement"),
        (iteration >= max_iterations, False, "adjust_and_continue", "max_iterations"),
    )
    out = None
    for condition, stop, decision, reason in branches:
        found = F.struct(F.lit(stop).alias("should_stop"), F.lit(decision).alias("decision"), F.lit(reason).alias("reason_code"))
        held = F.coalesce(condition, F.lit(False))
        out = F.when(held, found) if out is None else out.when(held, found)
    return out.otherwise(F.struct(F.lit(False).alias("should_stop"), F.lit("adjust_and_continue").alias("decision"), F.lit(None).cast("string").alias("reason_code")))


def qc_rollback(ratio: Column, rollbacks: Column, locked: Column) -> Column:
    """pass, manual_review (locked, or a second time) or rollback, by the overflow ratio."""
    return first_of((~F.coalesce(ratio > QC_LIMIT, F.lit(False)), "pass"), (locked | (rollbacks >= 1), "manual_review"), default="rollback")
