"""The schema fence, implied flags, routing and projections of parameters."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.operators import routing
from tessera.operators.routing import Field

SCHEMAS = {
    "tone": {"brightness": Field("float", -2, 2), "curve": Field("float_or_str", 0, 1), "steps": Field("int", 0, None)},
    "dehaze": {"enabled": Field("bool"), "strength": Field("float", 0, 1)},
    "hsl": {"enabled": Field("bool"), "domain": Field("str", choices=("hsv", "oklch")), "bands": Field("dict"), "free": Field("any")},
    "whitebalance": {"mode": Field("float_or_str"), "temp": Field("float", 1500, 50_000), "tint": Field("float", -150, 150)},
}


def _nested(spark, *patches):
    rows = [(i, None if p is None else {s: None if k is None else {n: v if isinstance(v, str) and v.startswith("raw:") else json.dumps(v) for n, v in k.items()} for s, k in p.items()}) for i, p in enumerate(patches)]
    rows = [(i, None if p is None else {s: None if k is None else {n: v.removeprefix("raw:") for n, v in k.items()} for s, k in p.items()}) for i, p in rows]
    return spark.createDataFrame(rows, f"id int, patch {routing.NESTED}")


def test_the_fence(spark):
    cases = [
        (None, []), ({}, []), ({"tone": None}, []), ({"tone": {}}, []),
        ({"tone": {"brightness": 1.5, "steps": 3}}, []), ({"tone": {"brightness": 2.5, "steps": -1}}, [("tone", "brightness", "range"), ("tone", "steps", "range")]),
        ({"tone": {"brightness": "1"}}, [("tone", "brightness", "type")]), ({"tone": {"brightness": True}}, [("tone", "brightness", "type")]), ({"tone": {"brightness": None}}, []),
        ({"tone": {"brightness": "raw:NaN"}}, [("tone", "brightness", "type")]), ({"tone": {"brightness": "raw:1e999"}}, [("tone", "brightness", "type")]),
        ({"nothing": {"a": 1}, "__style": {"x": 1}}, [("__style", "", "unknown_stage"), ("nothing", "", "unknown_stage")]), ({"tone": {"contrast": 1}}, [("tone", "contrast", "unknown_key")]),
        ({"hsl": {"domain": "oklch", "enabled": False, "bands": {"a": 1}, "free": [1]}}, []), ({"hsl": {"domain": "lab", "enabled": 1, "bands": [1]}}, [("hsl", "bands", "type"), ("hsl", "domain", "choice"), ("hsl", "enabled", "type")]),
        ({"tone": {"lut_path": "x", "curve": "C:x"}}, [("tone", "curve", "path"), ("tone", "lut_path", "path")]), ({"hsl": {"free": "../up", "domain": "a/b"}}, [("hsl", "domain", "path"), ("hsl", "free", "path")]),
        ({"tone": {"curve": {"rgb": [[0, 0], [1, 1]]}}}, []), ({"tone": {"curve": {}}}, []), ({"tone": {"curve": {"rgb": 3}}}, [("tone", "curve", "curve")]), ({"tone": {"curve": {"x": [[0, 0]]}}}, [("tone", "curve", "curve")]),
        ({"tone": {"curve": [1, 2]}}, []), ({"tone": {"curve": "16:9"}}, []), ({"tone": {"curve": 0.5}}, []), ({"tone": {"curve": 1.5}}, [("tone", "curve", "range")]), ({"tone": {"curve": True}}, [("tone", "curve", "type")]),
    ]
    frame = _nested(spark, *[c for c, _ in cases])
    found = {r.id: [tuple(v) for v in r.v] for r in frame.select("id", routing.violations(F.col("patch"), SCHEMAS).alias("v")).collect()}
    for i, (case, expected) in enumerate(cases):
        # A number beyond doubles may be read as not finite or not at all; either way it is refused.
        assert [v if v[2] != "finite" else (*v[:2], "type") for v in found[i]] == expected, case


def test_implied_flags(spark):
    cases = [
        ({"dehaze": {"strength": 0.5}}, {"dehaze": {"strength": "0.5", "enabled": "true"}}), ({"dehaze": {"strength": 0.5, "enabled": False}}, {"dehaze": {"strength": "0.5", "enabled": "false"}}), ({"dehaze": {"enabled": True}}, {"dehaze": {"enabled": "true"}}),
        ({"dehaze": {}}, {"dehaze": {}}), ({"tone": {"brightness": 1}}, {"tone": {"brightness": "1"}}), ({"unknown": {"a": 1}}, {"unknown": {"a": "1"}}), ({"dehaze": None}, {"dehaze": None}),
        ({"whitebalance": {"tint": 5}}, {"whitebalance": {"tint": "5", "mode": '"manual"'}}), ({"whitebalance": {"temp": None}}, {"whitebalance": {"temp": "null"}}), ({"whitebalance": {"temp": 5000, "mode": "as_shot"}}, {"whitebalance": {"temp": "5000", "mode": '"as_shot"'}}),
    ]
    frame = _nested(spark, *[c for c, _ in cases])
    found = {r.id: r.p for r in frame.select("id", routing.implied(F.col("patch"), SCHEMAS).alias("p")).collect()}
    assert [found[i] for i in range(len(cases))] == [e for _, e in cases]


ROUTES = routing.Routes(slots={"color.vibrance": ("vibrance", "strength"), "dehaze.strength": ("dehaze", "strength"), "haze": ("dehaze", "strength")}, switched=[("dehaze", "strength")], region_limits={"exposure": 2.0, "warmth": 1.0})


def test_routing(spark):
    rows = [
        (1, {"tone": {"brightness": "0.5"}, "exposure": {"mode": "1.5", "x": "2"}}, {"Exposure_EV": 0.25, "color.vibrance": 0.5}),
        (2, None, {"dehaze.strength": 0.5, "region.face.exposure": 9.0, "REGION.face.warmth": -0.5, "region.sky.exposure": -3.0, "region.face.hue": 1.0, "region..warmth": 1.0, "unknown.key": 2.0, "plain": 3.0, "nothing": None}),
        (3, {"tone": {"brightness": "1"}}, None), (4, None, None), (5, None, {"ev": 1.0, "exposure_ev": 2.0}),
    ]
    frame = spark.createDataFrame(rows, f"id int, params {routing.NESTED}, decided map<string,double>")
    found = {r.id: r.r for r in frame.select("id", routing.routed(F.col("params"), F.col("decided"), ROUTES).alias("r")).collect()}
    assert found[1].params == {"tone": {"brightness": "0.5"}, "exposure": {"mode": '"auto"', "target_offset": "0.25", "x": "2"}, "vibrance": {"strength": "0.5"}} and found[1].other == {}
    assert found[2].params == {"dehaze": {"strength": "0.5", "enabled": "true"}, "region_adjust": {"enabled": "true"}}
    assert found[2].regions == {"face": {"exposure": 2.0, "warmth": -0.5}, "sky": {"exposure": -2.0}}
    assert found[2].other == {"region.face.hue": 1.0, "region..warmth": 1.0, "unknown.key": 2.0, "plain": 3.0}
    assert found[3].params == {"tone": {"brightness": "1"}} and found[4].params == {} and found[4].regions == {}
    assert found[5].params == {"exposure": {"mode": '"auto"', "target_offset": "2.0"}}


def test_projections(spark):
    rows = [(1, {"exposure": {"mode": "1.5", "target_offset": "2"}, "tone": {"a": "1"}, "compose": {"x": "1"}}), (2, {"exposure": {"mode": '"auto"', "target_offset": "2"}}), (3, {"exposure": {"mode": '"auto"'}}), (4, {})]
    frame = spark.createDataFrame(rows, f"id int, params {routing.NESTED}")
    found = {r.id: r.f for r in frame.select("id", routing.flattened(F.col("params")).alias("f")).collect()}
    assert [(found[k].exposure_ev, found[k].rest) for k in (1, 2, 3, 4)] == [(1.5, {"tone": {"a": "1"}}), (2.0, {}), (None, {}), (None, {})]
    targets = spark.createDataFrame([({"a": "115", "b": '{"value": 3, "target": 4}', "c": '{"target": 5}', "d": '"x"'},)], "t map<string,string>")
    assert [r for r in targets.select(*[routing.target_value(F.col("t"), k, F.lit(-1.0)) for k in "abcde"]).first()] == [115.0, 3.0, 5.0, -1.0, -1.0]
