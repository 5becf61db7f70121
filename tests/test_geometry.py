"""The best crop of a box against a plain search over all windows."""

from __future__ import annotations

import math
import random

from tessera.operators import geometry
from tessera.plans import catalogue

RATIOS, SCALES = (1.0, 1.5, 0.5), (0.85, 1.0, 0.90, 0.95)


def _plain(x0, y0, x1, y1, ratio):
    """(score to six digits, -scale, i, j) of the best window, or None."""
    best = None
    for scale in SCALES:
        w, h = scale * min(1.0, ratio), scale * min(1.0, 1 / ratio)
        for i in range(5):
            for j in range(5):
                a, b = (1 - w) * i / 4, (1 - h) * j / 4
                c, d = a + w, b + h
                if max(0.0, min(x1, c) - max(x0, a)) * max(0.0, min(y1, d) - max(y0, b)) / ((x1 - x0) * (y1 - y0)) < 0.95:
                    continue
                cx, cy = ((x0 + x1) / 2 - a) / (c - a), ((y0 + y1) / 2 - b) / (d - b)
                score = 0.35 * (1 - min(1.0, min(abs(cx - 1 / 3), abs(cx - 2 / 3)) * 3)) + 0.12 * min(1.0, max(0.0, (y0 - b) / (d - b) / 0.2))
                score += 0.08 * min(1.0, (x1 - x0) * (y1 - y0) / ((c - a) * (d - b))) + 0.45 * (1 - min(1.0, math.hypot(cx - 0.5, cy - 0.5) * 2))
                found = (-round(score, 6), -scale, i, j)
                best = found if best is None else min(best, found)
    return best


def test_best_windows(spark):
    """Symmetric boxes have many equal scores; narrow ratios leave wide boxes without a window."""
    pick = random.Random(2)
    boxes = [(None, 0.25, 0.25, 0.75, 0.75), (1, 0.0, 0.0, 1.0, 1.0), (2, 0.375, 0.0, 0.625, 1.0), (3, 0.5, 0.5, 0.625, 0.625)]
    for k in range(4, 60):
        (x0, x1), (y0, y1) = sorted(pick.sample(range(9), 2)), sorted(pick.sample(range(9), 2))
        boxes.append((k, x0 / 8, y0 / 8, x1 / 8, y1 / 8))
    frame = spark.createDataFrame(boxes, "k long, x0 double, y0 double, x1 double, y1 double").repartition(3)
    found = {(r.k, r.ratio): (-r.score, -r.scale, r.i, r.j) for r in geometry.best_windows(frame, ["k"], RATIOS, 0.95, SCALES).collect()}
    expected = {(k, ratio): _plain(*box, ratio) for k, *box in boxes for ratio in RATIOS}
    assert found == {k: v for k, v in expected.items() if v}
    assert len(found) < len(expected)


def test_windows_are_never_held(spark, tmp_path):
    """Two hundred windows a box pass through a plain maximum: nothing sorts or holds them."""
    rows = [(k, [float((k * 7 + i * 5) % 11) / 20 for i in range(64)], 0) for k in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    crops = catalogue.QUERIES["crop_suggest"](spark, str(tmp_path))
    assert crops.count() > 0
    plan = crops._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan
