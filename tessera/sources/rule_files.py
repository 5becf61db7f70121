"""Rule packs from JSON or YAML files, checked when they are loaded."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from tessera.operators.rules import OPERATORS, Condition, Rule, lint

# Fixed value: the conflict policies that a pack may ask for.
POLICIES = ("high_priority_wins",)


def to_rule(data: Mapping) -> Rule:
    """A rule of its record: rule_id, priority, condition (one, `all` of several, or none), action, enabled, level."""
    condition, action = data.get("condition") or {}, data.get("action") or {}
    parts = condition.get("all", [condition] if condition else [])
    low, high = action.get("clamp") or (None, None)
    return Rule(
        str(data.get("rule_id", "unknown")), data.get("priority"), tuple(Condition(str(p["metric"]), str(p["op"]), p["value"]) for p in parts), str(action["param"]), action.get("formula"), action.get("value"), action.get("mode"),
        (low, high), action.get("step_decay"), action.get("target", next((p["target"] for p in parts if "target" in p), None)), data.get("enabled", True), data.get("level"),
    )


def to_record(rule: Rule) -> dict:
    """The record that to_rule reads back as the same rule."""
    parts = [{"metric": c.metric, "op": c.op, "value": c.value} for c in rule.conditions]
    action = {"param": rule.param, "formula": rule.formula, "value": rule.value, "mode": rule.mode, "clamp": list(rule.clamp), "step_decay": rule.step_decay, "target": rule.target}
    return {"rule_id": rule.rule_id, "priority": rule.priority, "condition": {"all": parts} if len(parts) > 1 else parts[0] if parts else None, "action": action, "enabled": rule.enabled, "level": rule.level}


def problems(records: Sequence[Mapping], metrics: set[str] | None = None) -> list[str]:
    """What is wrong with the records: policies, operators, missing parameters, values or metrics, values that are no numbers, and
    with metrics given, names in formulas and in conditions that nothing has."""
    out = []
    for record in records:
        name, action, condition = record.get("rule_id", "unknown"), record.get("action") or {}, record.get("condition") or {}
        policy = action.get("conflict_policy")
        if policy is not None and policy not in POLICIES:
            out.append(f"{name}: conflict policy {policy!r} is not one of {POLICIES}")
        if not action.get("param"):
            out.append(f"{name}: no parameter")
        if action.get("formula") is None and not _is_number(action.get("value")):
            out.append(f"{name}: neither a formula nor a number as value")
        parts = condition.get("all", [condition] if condition else [])
        out += [f"{name}: operator {p.get('op')!r}" for p in parts if str(p.get("op", "")).lower() not in OPERATORS]
        out += [f"{name}: a condition without metric or value" for p in parts if not p.get("metric") or p.get("value") is None]
        if metrics is not None:
            out += [f"{name}: unknown metric {p['metric']!r} in a condition" for p in parts if p.get("metric") and p["metric"] not in metrics]
    if not out and metrics is not None:
        out = [f"{name}: unknown names {bad}" for name, bad in lint([to_rule(r) for r in records], metrics).items()]
    return out


def _is_number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def load_rules(spark: SparkSession, source: Mapping | Sequence | str, metrics: set[str] | None = None) -> tuple[Rule, ...]:
    """The rules of a record, a list of records, or a JSON or YAML file at any path that Spark reads; entries that are no records are left out.

    A pack is small (it becomes one expression), so its text is read on the driver. A faulty pack raises ValueError.
    """
    if isinstance(source, str):
        text = "\n".join(r.value for r in spark.read.text(source, wholetext=True).collect())
        if source.lower().endswith((".yaml", ".yml")):
            import yaml

            source = yaml.safe_load(text)
        else:
            source = json.loads(text)
    if not isinstance(source, (Mapping, list, tuple)):
        raise ValueError("a rule pack is a record or a list of records")
    records = [r for r in ([source] if isinstance(source, Mapping) else source) if isinstance(r, Mapping)]
    found = problems(records, metrics)
    if found:
        raise ValueError("; ".join(found))
    return tuple(to_rule(r) for r in records)
