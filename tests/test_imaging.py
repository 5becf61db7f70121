"""Operators on whole images against plain versions and known cases."""

from __future__ import annotations

import cmath
import math
import random

import numpy as np
import pytest

from tessera.operators import imaging


def _frame(spark, images, **more):
    rows = [(i, *image.shape[:2], [float(v) for v in image.ravel()], *(m[i] for m in more.values())) for i, image in enumerate(images)]
    return spark.createDataFrame(rows, ["key", "height", "width", "values", *more])


def _noise(*shape, seed=3):
    return np.random.default_rng(seed).uniform(0, 255, shape)


def test_spectrum_equals_a_direct_transform():
    image = _noise(8, 8)
    found = imaging.magnitudes(image)
    for u in range(8):
        for v in range(8):
            direct = sum(image[y, x] * cmath.exp(-2j * math.pi * (u * y + v * x) / 8) for y in range(8) for x in range(8))
            assert math.isclose(found[(u + 4) % 8, (v + 4) % 8], abs(direct), rel_tol=1e-9)
    outside = sum(found[y, x] for y in range(8) for x in range(8) if (y - 4) ** 2 + (x - 4) ** 2 > 9)
    assert math.isclose(imaging.high_share(image, 3), outside / found.sum())


def test_sharpness(spark):
    flat, noise = np.full((20, 30), 90.0), _noise(40, 50)
    calm = imaging.gaussian(noise, 2.0)
    edge = np.repeat(np.repeat((np.arange(6) % 2)[None] * 200.0, 10, axis=1), 60, axis=0)
    rows = {r.key: r for r in imaging.sharpness(_frame(spark, [flat, noise, calm, edge]), 8.0).collect()}
    assert [rows[0][c] for c in ("lap_raw", "lap_denoised", "noise_ratio", "high_share")] == [0.0, 0.0, 0.0, 0.0]
    assert rows[1].noise_ratio > 0.8 and rows[3].noise_ratio < 0.2
    assert rows[1].high_share > 3 * rows[2].high_share
    plain = [4 * -noise[y, x] + sum(noise[abs(y + dy) if y + dy < 40 else 38, abs(x + dx) if x + dx < 50 else 48] for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))) for y in range(40) for x in range(50)]
    assert math.isclose(rows[1].lap_raw, np.var(plain))


def test_motion_blur_finds_the_direction(spark):
    noise = _noise(96, 96)
    along_x = imaging.filtered(noise, np.full((1, 15), 1 / 15))
    along_y = imaging.filtered(noise, np.full((15, 1), 1 / 15))
    rows = imaging.motion_blur(_frame(spark, [noise, along_x, along_y, np.full((64, 64), 9.0), _noise(8, 8)])).orderBy("key").collect()
    assert not rows[0].blurred and rows[1].blurred and rows[2].blurred
    assert min(rows[1].angle, 180 - rows[1].angle) <= 15 and abs(rows[2].angle - 90) <= 15
    assert [(r.angle, r.strength, r.blurred) for r in rows[4:]] == [(0.0, 0.0, False)]


def test_images_that_are_not_whole_give_null(spark):
    rows = [(1, 2, 2, [1.0, 2.0, 3.0]), (2, None, 2, [1.0]), (3, 2, 2, None), (4, 2, 2, [1.0, None, 1.0, 1.0]), (5, 1, 1, [float("nan")]), (6, 0, 2, []), (7, 1, 1, [5.0])]
    frame = spark.createDataFrame(rows, "key int, height int, width int, values array<double>")
    found = {r.key: r for r in imaging.sharpness(frame).collect()}
    assert all(found[k].lap_raw is None and found[k].high_share is None for k in range(1, 7)) and found[7].lap_raw == 0.0
    assert imaging.sharpness(frame.where("false")).count() == 0
    assert [r["values"] for r in imaging.refined(frame, 1.0, 1.0, 1.0).collect()] == [None] * 7


@pytest.mark.parametrize("slope", [-6.0, -2.5, 0.5, 3.0, 7.25])
def test_a_slanted_edge_is_levelled(slope):
    y, x = np.mgrid[:200, :260].astype(float)
    below = (x - 130) * math.cos(math.radians(slope)) - (y - 100) * math.sin(math.radians(slope))
    image = 255 / (1 + np.exp(-below))
    angle, confidence = imaging.horizon(image)
    # An upright edge: row sums vary most where it has turned level or upright again.
    upright = np.rot90(image).copy()
    level, sure = imaging.horizon(upright)
    assert abs(abs(angle) - abs(slope)) <= 12 and 0 <= confidence <= 1
    assert abs(abs(level) - abs(slope)) <= 0.5 and sure > imaging.HORIZON_CONFIDENCE
    turned, used = imaging.composed(upright, None, False, False, True)
    assert used == level and abs(imaging.horizon(turned)[0]) <= 0.5


def test_no_horizon_leaves_the_image_alone():
    image = _noise(64, 64)
    out, turn = imaging.composed(image, 5.0, False, False, True, least=1.1)
    assert turn == 0.0 and (out == image).all()
    steep = np.rot90(255 / (1 + np.exp(-np.add.outer(np.arange(80.0) * -0.2, np.arange(80.0))))).copy()
    assert imaging.composed(steep, None, False, False, True)[1] == 0.0


def _mirrored(index, size):
    if size == 1:
        return 0
    while index < 0 or index >= size:
        index = -index if index < 0 else 2 * size - 2 - index
    return index


def _plain_rotation(image, angle):
    """One target pixel after the other, weights from their formula."""
    height, width = image.shape
    turn = math.radians(angle)

    def weight(d):
        if abs(d) >= 4:
            return 0.0
        return 1.0 if d == 0 else 4 * math.sin(math.pi * d) * math.sin(math.pi * d / 4) / (math.pi * d) ** 2

    out = np.zeros(image.shape)
    for y in range(height):
        for x in range(width):
            dx, dy = x - width / 2, y - height / 2
            sx = round(math.cos(turn) * dx - math.sin(turn) * dy + width / 2, 9)
            sy = round(math.sin(turn) * dx + math.cos(turn) * dy + height / 2, 9)
            total = part = 0.0
            for j in range(math.floor(sy) - 3, math.floor(sy) + 5):
                for i in range(math.floor(sx) - 3, math.floor(sx) + 5):
                    w = weight(sy - j) * weight(sx - i)
                    part += w
                    total += w * image[_mirrored(j, height), _mirrored(i, width)]
            out[y, x] = total / part
    return out


@pytest.mark.parametrize("shape", [(12, 17), (16, 16), (1, 5), (2, 2)])
def test_rotation(shape):
    image = _noise(*shape)
    assert (imaging.rotated(image, 0.0) == image).all()
    assert np.allclose(imaging.rotated(image, 10.0), _plain_rotation(image, 10.0), atol=1e-6)
    assert np.allclose(imaging.rotated(image, -37.5), _plain_rotation(image, -37.5), atol=1e-6)


def test_quarter_and_half_turns_copy_pixels():
    image = _noise(16, 16)
    quarter = imaging.rotated(image, 90.0)
    assert np.allclose(quarter[:, 1:], np.array([[image[_mirrored(x, 16), 16 - y if y else 14] for x in range(1, 16)] for y in range(16)]), atol=1e-9)
    half = imaging.rotated(image, 180.0)
    assert np.allclose(half[1:, 1:], image[::-1, ::-1][:-1, :-1], atol=1e-9)
    colours = _noise(9, 9, 3)
    assert np.allclose(imaging.rotated(colours, 20.0)[..., 1], imaging.rotated(colours[..., 1], 20.0))


def test_compose_reads_its_columns(spark):
    image = _noise(6, 5)
    frame = _frame(spark, [image] * 4, rotation=[None, 30.0, 0.0, 0.0], across=[True, False, None, False], down=[False, False, True, None], level=[False, None, False, False])
    rows = imaging.compose(frame, "rotation", "across", "down", "level").orderBy("key").collect()
    expected = [image[:, ::-1], imaging.rotated(image, 30.0), image[::-1], image]
    assert all(np.allclose(np.reshape(r["values"], image.shape), e) for r, e in zip(rows, expected, strict=True))
    assert [r.turn for r in rows] == [0.0, 30.0, 0.0, 0.0]


def test_line_votes(spark):
    slants = {1: [4.0, 5.0, 4.5, 184.2, -8.0, 60.0], 2: [1.0, 2.0], 3: [-14.0, -2.0, 4.0, 10.0], 4: [15.0, 15.0, 15.0], 5: [90.0]}
    rows = [(k, 0.0, 0.0, 10 * math.cos(math.radians(a)), 10 * math.sin(math.radians(a)), 0.5 if k == 1 else 0.0) for k, angles in slants.items() for a in angles] + [(5, 1.0, 1.0, 1.0, 1.0, 0.9)]
    frame = spark.createDataFrame(rows, "key int, x1 double, y1 double, x2 double, y2 double, sky double")
    from pyspark.sql import functions as F

    found = {r.key: r for r in imaging.line_votes(frame, "key", 3, F.col("sky")).collect()}
    assert found[1].has_horizon and found[1].votes == 4 and math.isclose(found[1].angle, (4 + 5 + 4.5 + 4.2) / 4) and math.isclose(found[1].confidence, 4 / 9 + 0.2)
    assert [(found[k].votes, found[k].angle, found[k].has_horizon) for k in (2, 3, 5)] == [(2, 0.0, False), (4, 0.0, False), (0, 0.0, False)]
    assert found[4].has_horizon and found[4].votes == 3


def _region(mask, name="a", **changes):
    return {"name": name, "exposure": 0.0, "saturation": 0.0, "warmth": 0.0, "height": None if mask is None else mask.shape[0], "width": None if mask is None else mask.shape[1], "mask": None if mask is None else mask.ravel().tolist()} | changes


def test_regions_blend_in_order():
    image = _noise(20, 24, 3) / 255 * 0.6
    whole, half = np.ones((20, 24)), np.zeros((20, 24))
    half[:, 12:] = 1
    out, names, cover = imaging.regions_applied(image, [_region(whole, exposure=1.0), _region(half, "b", warmth=0.5)])
    brighter = np.clip(image * 2 ** (1 / 2.2), 0, 1)
    assert names == ["a", "b"] and cover[0] == pytest.approx(1.0) and cover[1] == pytest.approx(0.5, abs=0.01)
    assert np.allclose(out[:, :8], brighter[:, :8], atol=1e-9)
    assert np.allclose(out[:, 17:], np.clip(brighter[:, 17:] * [1, 1.05, 0.87], 0, 1), atol=1e-3)
    # No hard edge: the share grows over several columns.
    assert len(np.unique(np.round(out[0, 8:17, 2] / brighter[0, 8:17, 2], 3))) >= 4
    other, _, _ = imaging.regions_applied(image, [_region(half, "b", warmth=0.5), _region(whole, exposure=1.0)])
    assert not np.allclose(other, np.clip(brighter, 0, 1))
    same, names, _ = imaging.regions_applied(image, [_region(None, exposure=1.0), _region(np.full((3, 3), np.nan), exposure=1.0), _region(whole), _region(np.zeros((2, 2)), exposure=1.0)])
    assert names == [] and np.allclose(same, image)
    grown, names, cover = imaging.regions_applied(image, [_region(np.array([[0.0, 1.0]]), exposure=1.0)])
    assert names == ["a"] and 0.4 < cover[0] < 0.6 and np.allclose(grown[:, 0], image[:, 0], atol=1e-3)


def test_saturation_keeps_hue_value_and_neutrals():
    import colorsys

    image = np.random.default_rng(1).uniform(0, 1, (5, 5, 3))
    image[0, 0] = 0.4
    image[0, 1] = 0.0
    for amount in (0.5, -1.0, -0.3):
        out = imaging.saturated(image, amount)
        for y in range(5):
            for x in range(5):
                h, s, v = colorsys.rgb_to_hsv(*image[y, x])
                assert np.allclose(out[y, x], colorsys.hsv_to_rgb(h, min(1.0, max(0.0, s * (1 + amount))), v), atol=1e-9)


def test_region_limits_fail_the_job(spark):
    frame = _frame(spark, [_noise(4, 4, 3) / 255])
    asked = "array(named_struct('name', 'sky', 'exposure', 2.5D, 'saturation', 0D, 'warmth', 0D, 'height', 1, 'width', 1, 'mask', array(1D)))"
    with pytest.raises(Exception, match="region sky: exposure 2.5 is beyond 2.0"):
        imaging.apply_regions(frame.selectExpr("*", f"{asked} AS regions"), "regions").collect()


def _plain_guided(guide, image, radius, eps):
    height, width = image.shape

    def mean(values):
        return np.array([[np.mean([values[j][i] for j in range(max(0, y - radius), min(height, y + radius + 1)) for i in range(max(0, x - radius), min(width, x + radius + 1))]) for x in range(width)] for y in range(height)])

    g, i = mean(guide), mean(image)
    slope = (mean(guide * image) - g * i) / (mean(guide * guide) - g * g + eps)
    return mean(slope) * guide + mean(i - slope * g)


def test_masked_smoothing(spark):
    image = _noise(9, 11, 3) / 255
    mask = np.zeros((9, 11))
    mask[:, :5] = 1
    frame = _frame(spark, [image] * 3, mask=[mask.ravel().tolist(), None, [1.0]])
    rows = imaging.masked_smoothing(frame, "mask", 0.5, radius=2).orderBy("key").collect()
    out = np.reshape(rows[0]["values"], image.shape)
    assert (out[:, 5:] == image[:, 5:]).all() and rows[0].smoothed == pytest.approx(0.5 * 5 / 11)
    luma = image @ [0.2126, 0.7152, 0.0722]
    for c in range(3):
        assert np.allclose(out[:, :5, c], (image[..., c] + _plain_guided(luma, image[..., c], 2, 0.01))[:, :5] / 2)
    assert all(np.allclose(np.reshape(r["values"], image.shape), image) and r.smoothed == 0.0 for r in rows[1:])


def test_resizing():
    image = _noise(8, 12)
    assert np.allclose(imaging.area_resized(image, 2, 3), image.reshape(2, 4, 3, 4).mean(axis=(1, 3)))
    assert np.allclose(imaging.area_resized(image, 3, 5).mean(), image.mean())
    ramp = np.tile(np.arange(8.0), (8, 1))
    assert np.allclose(imaging.linear_resized(ramp, 16, 16)[:, 1:-1], np.tile((np.arange(16) + 0.5) / 2 - 0.5, (16, 1))[:, 1:-1])


def test_colour_noise_goes_and_luma_stays():
    generator = random.Random(2)
    base = np.full((64, 64, 3), 0.5)
    noisy = base + np.array([[[generator.gauss(0, 0.01) for _ in range(3)] for _ in range(64)] for _ in range(64)])
    out = imaging.chroma_denoised(noisy, 1.5)
    luma = imaging.gray(noisy)[..., None]
    assert np.allclose(imaging.gray(out), luma[..., 0], atol=1e-9)
    assert (out - luma).std() < 0.3 * (noisy - luma).std()
    spot = base.copy()
    spot[30:33, 30:33] = [0.9, 0.4, 0.05]
    assert np.allclose(imaging.chroma_denoised(spot, 1.5)[31, 31], spot[31, 31], atol=1e-6)


def test_sharpening_keeps_colour_inside_the_gamut():
    image = np.full((40, 40, 3), [0.52, 0.5, 0.49])
    image[:, 20:] = [0.62, 0.6, 0.59]
    out = imaging.luma_sharpened(image, 0.1)
    assert out[20, 20, 1] > image[20, 20, 1] and out[20, 19, 1] < image[20, 19, 1]
    assert np.allclose(out - imaging.gray(out)[..., None], image - imaging.gray(image)[..., None], atol=1e-9)
    strong = imaging.luma_sharpened(np.clip(image + 0.3, 0, 1), 3.0)
    assert strong.min() >= 0 and strong.max() <= 1
    lively = np.full((20, 20, 3), [0.9, 0.3, 0.1])
    lively[:, 10:] *= 0.8
    assert np.allclose(imaging.luma_sharpened(lively, 1.0), lively)
    assert np.allclose(imaging.highlights_calmed(np.full((2, 2, 3), [0.9, 0.88, 0.9]), 1.0), imaging.gray(np.array([[[0.9, 0.88, 0.9]]]))[0, 0])
