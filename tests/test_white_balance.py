"""Colour temperature and camera gains against plain loops and round trips."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tessera.operators import white_balance as wb
from tessera.plans.white_balances import CAMERA


def _plain_locus(t):
    t = max(t, 1667.0)
    x = -0.2661239e9 / t**3 - 0.2343589e6 / t**2 + 0.8776956e3 / t + 0.179910 if t <= 4000 else -3.0258469e9 / t**3 + 2.1070379e6 / t**2 + 0.2226347e3 / t + 0.240390
    a, b, c, d = (-1.1063814, -1.34811020, 2.18555832, -0.20219683) if t <= 2222 else (-0.9549476, -1.37418593, 2.09137015, -0.16748867) if t <= 4000 else (3.0817580, -5.87338670, 3.75112997, -0.37001483)
    return x, a * x**3 + b * x**2 + c * x + d


@pytest.mark.parametrize("kelvin", [1700.0, 2222.0, 2850.0, 3999.0, 4003.0, 5003.3, 6504.0, 12_345.0, 24_000.0])
def test_temperature_of_the_locus_is_itself(kelvin):
    x, y = _plain_locus(kelvin)
    assert np.allclose(wb.locus(np.array([kelvin])), [[x], [y]])
    assert abs(wb.nearest_kelvin(np.array([x]), np.array([y]))[0] - kelvin) < (1.0 if kelvin < 10_000 else 5.0)


def test_nearest_point_of_all():
    pick = np.random.default_rng(2)
    x, y = pick.uniform(0.25, 0.55, 400), pick.uniform(0.25, 0.45, 400)
    steps = np.arange(1600, 25000, 5.0)
    u, v = wb.to_uv(*np.array([_plain_locus(t) for t in steps]).T)
    pu, pv = wb.to_uv(x, y)
    plain = steps[((u - pu[:, None]) ** 2 + (v - pv[:, None]) ** 2).argmin(axis=1)]
    found = wb.nearest_kelvin(x, y)
    inner = (plain > 1605) & (plain < 24_990)
    assert inner.sum() > 100 and np.abs(found - plain)[inner].max() <= 5.0
    assert found.min() >= 1600 and found.max() <= 25_000


def _plain_fixed_point(neutral, rounds=30):
    last = np.array(wb.D50)
    for _ in range(rounds):
        n = (last[0] - 0.3320) / (last[1] - 0.1858)
        kelvin = -449 * n**3 + 3525 * n**2 - 6823.3 * n + 5520.33
        share = min(1.0, max(0.0, (1 / kelvin - 1 / 2850) / (1 / 6500 - 1 / 2850))) if kelvin > 0 else 0.0
        matrix = (1 - share) * np.reshape(CAMERA.first, (3, 3)) + share * np.reshape(CAMERA.second, (3, 3))
        xyz = np.linalg.inv(matrix) @ neutral
        after = xyz[:2] / xyz.sum() if xyz.sum() > 0 else np.array([0.3333, 0.3333])
        if abs(after - last).sum() < 1e-7:
            return after
        before, last = last, after
    return (before + last) / 2


def test_fixed_point_row_by_row():
    pick = np.random.default_rng(3)
    neutral = np.stack([pick.uniform(0.2, 1.2, 200), np.ones(200), pick.uniform(0.2, 1.2, 200)], axis=1)
    found = wb.neutral_xy(neutral, CAMERA)
    plain = np.array([_plain_fixed_point(n) for n in neutral])
    assert np.allclose(found, plain, atol=1e-9)


def test_gains_there_and_back(spark):
    asked = [(k, t) for k in (2200.0, 3400.0, 5000.0, 6504.0, 9000.0) for t in (-100.0, -30.0, 0.0, 60.0)]
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "id int, asked double, shade double").repartition(3)
    made = wb.gains(rows, "asked", "shade", CAMERA)
    back = wb.kelvins_tints(made, "gain_r", "gain_b", CAMERA).collect()
    assert len(back) == len(asked) and max(r.gain_miss for r in back) < 1e-7
    close = [abs(r.kelvin - r.asked) < 0.01 * r.asked and abs(r.tint - r["shade"]) < 2.0 for r in back]
    assert sum(close) >= len(asked) - 1


def test_gains_out_of_reach_stay_within_limits():
    kelvin, tint, miss = wb.kelvin_tint(np.array([9.0, 0.2, 1.5]), np.array([0.1, 8.0, 1.5]), CAMERA)
    assert (kelvin >= 1500).all() and (kelvin <= 50_000).all() and (np.abs(tint) <= 150).all() and miss[0] > 1 and miss[1] > 0.1
    # No place of a fine grid is nearer.
    grid = np.array([(k, t) for k in np.geomspace(1500, 50_000, 120) for t in np.linspace(-150, 150, 61)])
    made = wb.gains_of(grid[:, 0], grid[:, 1], CAMERA)[:, [0, 2]]
    for k, target in enumerate(([9.0, 0.1], [0.2, 8.0], [1.5, 1.5])):
        assert miss[k] <= np.sqrt(((made - target) ** 2).sum(axis=1)).min() + 1e-3


def test_white_becomes_the_connection_white(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0, 1.0, 1.8, 1.0, 1.4), (2, 1.0, 1.0, 1.0, 1.2, 1.0, 2.2), (3, None, 1.0, 1.0, 1.2, 1.0, 2.2), (4, 0.5, 0.5, 0.5, 0.0, 1.0, float("nan"))], "id int, r double, g double, b double, a double, c double, d double")
    found = {r.id: r for r in wb.camera_to_xyz(rows, ["r", "g", "b"], ["a", "c", "d"], CAMERA).collect()}
    white = np.array([wb.D50[0] / wb.D50[1], 1.0, (1 - sum(wb.D50)) / wb.D50[1]])
    for k in (1, 2):
        xyz = np.array([found[k].x, found[k].y, found[k].z])
        assert np.allclose(xyz / xyz[1], white, atol=2e-3)
    assert [found[k].x for k in (3, 4)] == [None, None]
    whites = {r.id: r for r in wb.camera_white(rows, ["a", "c", "d"], CAMERA).collect()}
    assert whites[4].white_r is None and max(whites[1].white_r, whites[1].white_g, whites[1].white_b) == 1.0
    # The camera's own white is the inverse of the gains, over its largest value.
    assert math.isclose(whites[1].white_r / whites[1].white_g, 1 / 1.8, rel_tol=1e-3)


def test_one_matrix_holds_everywhere():
    alone = wb.Profile(CAMERA.first)
    assert (alone.matrices(np.array([2000.0, 9000.0, -1.0])) == np.reshape(CAMERA.first, (3, 3))).all()
    assert wb.neutral_of(np.array([[2.0, 0.0, 1.0], [2.0, 2.0, 4.0]])).tolist() == [[1.0, 1.0, 1.0], [1.0, 1.0, 0.5]]
