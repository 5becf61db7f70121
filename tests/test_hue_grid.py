"""Colour deformations: grid, lookup and sources against plain versions."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import hue_grid
from tessera.sources import files

NAMES = "h double, c double, l double, dh double, c_gain double, l_gain double"


def _points(count, seed=5):
    pick = random.Random(seed)
    return [(pick.uniform(0, 360), pick.uniform(0, 0.37), pick.random(), pick.uniform(-9, 9), pick.uniform(0.5, 1.5), pick.uniform(0.8, 1.2)) for _ in range(count)]


def _plain(points, grid, reach, width):
    out = []
    for i in range(grid[0]):
        for j in range(grid[1]):
            for k in range(grid[2]):
                apart = []
                for h, c, l, *values in points:
                    ring = abs((i + 0.5) / grid[0] * 360 - h) % 360
                    ring = math.radians(min(ring, 360 - ring))
                    apart.append((ring**2 + ((j + 0.5) / grid[1] - c / reach) ** 2 + ((k + 0.5) / grid[2] - l) ** 2, *values))
                weights = [math.exp(-d / (2 * width * width)) for d, *_ in apart]
                nearest = min(apart)
                if nearest[0] < 1e-12 or sum(weights) == 0:
                    out.append(nearest[1:])
                else:
                    out.append(tuple(sum(w * a[n] for w, a in zip(weights, apart, strict=True)) / sum(weights) for n in (1, 2, 3)))
    return out


@pytest.mark.parametrize("sigma", [None, 0.01])
def test_grid_against_all_pairs(spark, monkeypatch, sigma):
    monkeypatch.setattr(hue_grid, "BLOCK", 2000)
    grid = (6, 4, 3)
    points = _points(150)
    # On a node exactly, twice; of the two the smaller values hold.
    points += [(30.0, 0.37 / 8, 0.5, 5.0, 1.1, 1.0), (30.0, 0.37 / 8, 0.5, -5.0, 1.2, 1.0)]
    bad = [(None, 0.1, 0.1, 1.0, 1.0, 1.0), (1.0, float("nan"), 0.1, 1.0, 1.0, 1.0), (1.0, 0.1, float("inf"), 1.0, 1.0, 1.0)]
    frame = spark.createDataFrame(points + bad, NAMES).repartition(5)
    found = {r.node: (r.dh, r.c_gain, r.l_gain) for r in hue_grid.rasterized(frame, grid, 0.37, sigma).collect()}
    expected = _plain(points, grid, 0.37, sigma or (2 * math.pi / len(points)) ** (1 / 3))
    assert sorted(found) == list(range(72))
    assert all(np.allclose(found[n], expected[n], rtol=1e-9) for n in found)
    assert found[1] == (-5.0, 1.2, 1.0)
    assert hue_grid.rasterized(frame.where("false"), grid).count() == 0


def test_lookup_wraps_and_holds(spark):
    table = np.random.default_rng(1).uniform(size=(8, 5, 4, 3))
    rows = [(h, c, l) for h in (0.0, 44.0, 45.0, 337.5, 359.999, -20.0, 725.0) for c in (-3.0, 0.0, 1.25, 4.0, 9.0) for l in (0.0, 2.5, 3.0, 7.0)]
    frame = spark.createDataFrame([*rows, (None, 1.0, 1.0), (1.0, float("nan"), 1.0)], "hue double, at double, level double")
    found = hue_grid.looked_up(frame, table, "hue", "at", "level").collect()
    for r in found[:-2]:
        place, c, l = (r.hue % 360) / 45, min(max(r["at"], 0), 4), min(max(r.level, 0), 3)
        expected = np.zeros(3)
        for i in (0, 1):
            for j in (0, 1):
                for k in (0, 1):
                    part = [abs(1 - i - (place - math.floor(place))), abs(1 - j - (c - math.floor(c))), abs(1 - k - (l - math.floor(l)))]
                    expected += np.prod(part) * table[(math.floor(place) + i) % 8, min(math.floor(c) + j, 4), min(math.floor(l) + k, 3)]
        assert np.allclose([r.dh, r.c_gain, r.l_gain], expected)
    assert [r.dh for r in found[-2:]] == [None, None]


def test_deformation_leaves_alone_what_it_does_not_move(spark):
    rows = spark.createDataFrame([(1, 0.8, 0.2, 0.3), (2, 0.5, 0.5, 0.5), (3, 0.1, 0.7, 0.2)], "vec_id int, r double, g double, b double")
    nothing = hue_grid.table_of(spark.createDataFrame([], "node int, dh double, c_gain double, l_gain double"), (4, 3, 3))
    assert hue_grid.deformed(rows, nothing, F.lit(0.4)) is rows
    table = nothing.copy()
    table[..., 0] = 30.0
    assert hue_grid.deformed(rows, table, F.lit(0.4), 0.0) is rows
    turned = {r.vec_id: (r.r, r.g, r.b) for r in hue_grid.deformed(rows, table, F.lit(0.4)).collect()}
    assert np.allclose(turned[2], 0.5, atol=1e-4) and not np.allclose(turned[1], (0.8, 0.2, 0.3), atol=0.05)
    table[..., 0] = 0.0
    table[..., 1] = 3.0
    raised = {r.vec_id: r for r in hue_grid.deformed(rows, table, F.lit(0.12)).collect()}
    assert max(raised[3].r, raised[3].g, raised[3].b) <= 1.0


def test_point_clouds(spark, tmp_path):
    def write(name, content):
        (tmp_path / name).write_text(content if isinstance(content, str) else json.dumps(content))
        return str(tmp_path / name)

    point = dict(zip(hue_grid.POINT, (10.0, 0.1, 0.5, 2.0, 1.1, 0.9), strict=True))
    good = write("a.json", {"schema": files.POINT_CLOUD, "strength": 0.5, "points": [point, point | {"h": 20.0}]})
    write("ab.json", {"schema": files.POINT_CLOUD, "points": [point]})
    found = files.point_clouds(spark, str(tmp_path / "a*.json")).orderBy("cloud", "h").collect()
    assert [(r.cloud, r.strength, r.h, r.l_gain) for r in found] == [("a.json", 0.5, 10.0, 0.9), ("a.json", 0.5, 20.0, 0.9), ("ab.json", 1.0, 10.0, 0.9)]
    assert hue_grid.rasterized(files.point_clouds(spark, good), (4, 2, 2)).count() == 16
    for name, content, message in (("x.json", {"schema": "other", "points": [point]}, "unknown schema of a point cloud: x.json"), ("y.json", {"schema": files.POINT_CLOUD, "points": []}, "without points: y.json"), ("z.json", "{nothing", "malformed point cloud: z.json")):
        with pytest.raises(Exception, match=message):
            files.point_clouds(spark, write(name, content)).collect()
