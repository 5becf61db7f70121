"""Plans as ordered, gated stages of DataFrame transforms with declared domains, that can be written to and read from JSON."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

Transform = Callable[[DataFrame, Mapping[str, Any]], DataFrame]


@dataclass(frozen=True)
class Stage:
    """A named transform with its place, the domain it needs and the domain it leaves."""

    name: str
    order: int
    domain_in: str
    domain_out: str
    transform: Transform
    wants: Callable[[Mapping[str, Any]], bool] = lambda params: bool(params)


REGISTRY: dict[str, Stage] = {}


def register(name: str, order: int, domain_in: str, domain_out: str, wants: Callable[[Mapping[str, Any]], bool] | None = None) -> Callable[[Transform], Transform]:
    """Register a transform under a name."""

    def add(transform: Transform) -> Transform:
        if name in REGISTRY:
            raise ValueError(f"stage {name!r} is registered twice")
        REGISTRY[name] = Stage(name, order, domain_in, domain_out, transform, wants or (lambda params: bool(params)))
        return transform

    return add


def available() -> list[str]:
    """Registered names by their place."""
    return [s.name for s in sorted(REGISTRY.values(), key=lambda s: (s.order, s.name))]


@dataclass
class Plan:
    """Stages with parameters. Stages that don't want their parameters are passed over; domains are checked on the way."""

    params: dict[str, dict[str, Any]] = field(default_factory=dict)
    start: str = "linear_cam"

    def stages(self) -> list[Stage]:
        return [s for name in available() if (s := REGISTRY[name]).wants(self.params.get(name, {}))]

    def run(self, rows: DataFrame, observe: dict[str, Observation] | None = None) -> DataFrame:
        domain = self.start
        for stage in self.stages():
            if stage.domain_in not in (domain, "any"):
                raise ValueError(f"{stage.name} needs {stage.domain_in}, not {domain}")
            rows = stage.transform(rows, self.params.get(stage.name, {}))
            if observe is not None:
                observe[stage.name] = Observation(stage.name)
                rows = rows.observe(observe[stage.name], F.count(F.lit(1)).alias("rows"))
            domain = stage.domain_out if stage.domain_out != "any" else domain
        return rows

    def to_config(self) -> str:
        return json.dumps({"start": self.start, "stages": self.params}, sort_keys=True)

    @staticmethod
    def from_config(text: str) -> Plan:
        config = json.loads(text)
        unknown = set(config["stages"]) - set(REGISTRY)
        if unknown:
            raise ValueError(f"unknown stages {sorted(unknown)}")
        return Plan(config["stages"], config["start"])


def channels(rows: DataFrame, change: Mapping[str, Any]) -> DataFrame:
    """Replace the columns r, g, b."""
    return rows.withColumns(dict(change))


@register("exposure", 10, "linear_cam", "linear_cam")
def exposure(rows: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Gain by stops, then a soft shoulder above the knee."""
    from tessera.functions.color import highlight_rolloff

    gain = 2.0 ** params.get("ev", 0.0)
    return channels(rows, {c: highlight_rolloff(F.col(c) * gain, params.get("knee", 0.9)) for c in "rgb"})


@register("white_balance", 20, "linear_cam", "linear_rgb", wants=lambda params: True)
def white_balance(rows: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Gains per channel; saturated pixels that are nearly neutral become white."""
    r, g, b = (F.col(c) for c in "rgb")
    white = (F.greatest(r, g, b) >= 1.0) & (F.least(r, g, b) / F.greatest(r, g, b) >= 0.75)
    gains = params.get("gains", (1.0, 1.0, 1.0))
    return channels(rows, {c: F.when(white, 1.0).otherwise(F.col(c) * float(k)) for c, k in zip("rgb", gains, strict=True)})


@register("tone", 30, "linear_rgb", "gamma_rgb", wants=lambda params: True)
def tone(rows: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Brightness in stops, clipped and encoded."""
    from tessera.functions.color import srgb_encode

    gain = 2.0 ** params.get("brightness", 0.0)
    return channels(rows, {c: srgb_encode(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) * gain))) for c in "rgb"})


@register("saturation", 50, "gamma_rgb", "gamma_rgb")
def saturation(rows: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Distance from luma scaled."""
    from tessera.functions.color import luma

    gray = luma(*(F.col(c) for c in "rgb"))
    return channels(rows, {c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), gray + (F.col(c) - gray) * (1 + params["amount"]))) for c in "rgb"})


@register("quantise", 90, "gamma_rgb", "gamma_rgb")
def quantise(rows: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Whole numbers of the given bits."""
    top = float((1 << params["bits"]) - 1)
    return channels(rows, {c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) * top + 0.5).cast("int") for c in "rgb"})


def config_of(names: Sequence[str]) -> dict[str, tuple[str, str]]:
    """The domains of registered stages."""
    return {n: (REGISTRY[n].domain_in, REGISTRY[n].domain_out) for n in names}
