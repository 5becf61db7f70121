"""Fits by group against numpy on the same points."""

from __future__ import annotations

import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import fits
from tessera.plans import catalogue


def _rows(spark, **columns):
    names = list(columns)
    return spark.createDataFrame(list(zip(*(np.asarray(c, object).tolist() for c in columns.values()), strict=True)), names)


def test_least_squares(spark):
    pick = np.random.default_rng(4)
    key = np.repeat(["a", "b", None, "small"], [300, 200, 100, 2]).astype(object)
    x = pick.normal(size=(602, 3)) * [1.0, 1e-6, 50.0]
    weight = pick.uniform(0.1, 2, 602)
    y = np.stack([x @ [1.0, 2e6, 0.1] + 3 + pick.normal(size=602) * 0.1, x @ [0.0, 1e6, -1.0]], axis=1)
    data = [(k, *map(float, a), *map(float, b), float(w)) for k, a, b, w in zip(key, x, y, weight, strict=True)]
    bad = [("a", None, 1.0, 1.0, 1.0, 1.0, 1.0), ("a", float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0), ("a", 9e9, 1.0, 1.0, 1.0, 1.0, 0.0), ("a", 9e9, 1.0, 1.0, 1.0, 1.0, -1.0)]
    frame = spark.createDataFrame(data + bad, "k string, x0 double, x1 double, x2 double, y0 double, y1 double, w double").repartition(4)
    inputs = [F.lit(1.0), "x0", "x1", "x2"]
    found = {r.k: r for r in fits.least_squares(frame, ["k"], inputs, ["y0", "y1"], "w", least=3).collect()}
    assert set(found) == {"a", "b", None}
    for k in found:
        own = np.array([v == k for v in key])
        design = np.column_stack([np.ones(own.sum()), x[own]]) * np.sqrt(weight[own])[:, None]
        expected = np.linalg.lstsq(design, y[own] * np.sqrt(weight[own])[:, None], rcond=None)[0].T
        assert np.allclose(found[k].coefficients, expected, rtol=1e-6, atol=1e-6 * np.abs(expected).max(axis=1, keepdims=True)) and found[k]["rank"] == 4 and found[k].n == own.sum()
    ridge = {r.k: r for r in fits.least_squares(frame, ["k"], ["x0", "x2"], ["y0"], ridge=5.0).collect()}
    own = np.array([v == "b" for v in key])
    design = x[own][:, [0, 2]]
    assert np.allclose(ridge["b"].coefficients[0], np.linalg.solve(design.T @ design + 5 * np.eye(2), design.T @ y[own][:, 0]))
    assert fits.least_squares(frame.where("false"), ["k"], inputs, ["y0"]).count() == 0


def test_dependent_inputs_give_the_least_norm(spark):
    frame = spark.range(20).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("x"), (3.0 * F.col("id")).alias("y"))
    row = fits.least_squares(frame, ["k"], ["x", "x", F.lit(0.0)], ["y"]).first()
    assert row["rank"] == 1 and np.allclose(row.coefficients, [[1.5, 1.5, 0.0]])


def test_predictions_are_held(spark):
    frame = spark.createDataFrame([(1, [[2.0, 1.0]], 3.0), (2, None, 3.0)], "k int, c array<array<double>>, x double")
    found = frame.select(fits.predicted(F.col("c"), 0, [F.col("x"), F.lit(1.0)]).alias("free"), fits.predicted(F.col("c"), 0, [F.col("x"), F.lit(1.0)], 0.0, 5.0).alias("held")).collect()
    assert [tuple(r) for r in found] == [(7.0, 5.0), (None, None)]


def test_trimmed_fit_forgets_outliers(spark):
    pick = np.random.default_rng(9)
    x = pick.uniform(0, 10, 1000)
    y = 2 * x + 1 + pick.normal(size=1000) * 0.01
    y[:8] += 500
    frame = _rows(spark, k=np.repeat([1, 2], 500), x=x, y=y)
    found = {r.k: r for r in fits.trimmed_fit(frame, ["k"], [F.lit(1.0), F.col("x")], [F.col("y")]).collect()}
    for k, own in ((1, slice(0, 500)), (2, slice(500, 1000))):
        design = np.column_stack([np.ones(500), x[own]])
        first = np.linalg.lstsq(design, y[own], rcond=None)[0]
        missed = np.abs(y[own] - design @ first)
        kept = missed <= np.quantile(missed, 0.99)
        again = np.linalg.lstsq(design[kept], y[own][kept], rcond=None)[0]
        left = np.abs(y[own][kept] - design[kept] @ again)
        assert found[k].n == kept.sum() and np.allclose(found[k].coefficients[0], again)
        assert np.allclose([found[k].p50, found[k].p95], np.quantile(left, [0.5, 0.95]))


def _plain_enclosing(points, coverage):
    spread, axes = np.linalg.eigh(np.cov(points, rowvar=False))
    turn = math.atan2(axes[1, 1], axes[0, 1])
    turn = turn - math.pi if turn > math.pi / 2 else turn + math.pi if turn < -math.pi / 2 else turn
    u = points @ [math.cos(turn), math.sin(turn)]
    v = points @ [-math.sin(turn), math.cos(turn)]
    share = 1 - (1 - coverage) / 2
    mu, mv = np.median(u), np.median(v)
    ru, rv = np.quantile(np.abs(u - mu), share), np.quantile(np.abs(v - mv), share)
    centre = mu * math.cos(turn) - mv * math.sin(turn), mu * math.sin(turn) + mv * math.cos(turn)
    return centre, max(ru, rv), min(ru, rv), turn if ru >= rv else turn + math.pi / 2


def _distance(points, centre, major, minor, turn):
    apart = points - centre
    along, across = apart @ [math.cos(turn), math.sin(turn)], apart @ [-math.sin(turn), math.cos(turn)]
    return np.hypot(along / major, across / minor)


@pytest.mark.parametrize("least", [1000, 5000])
def test_enclosing_ellipse(spark, least):
    pick = np.random.default_rng(12)
    turn = math.radians(35)
    points = pick.normal(size=(1500, 2)) * [4.0, 1.0] @ np.array([[math.cos(turn), math.sin(turn)], [-math.sin(turn), math.cos(turn)]]) + [10, -3]
    points[:5] += [200, 50]
    frame = spark.createDataFrame([("g", float(a), float(b)) for a, b in points] + [("g", None, 1.0), ("g", float("nan"), 1.0)], "k string, a double, b double").repartition(3)
    row = fits.enclosing_ellipse(frame, ["k"], "a", "b", 0.95, least=least).first()
    ellipse = _plain_enclosing(points, 0.95)
    place = _distance(points, *ellipse)
    within = place <= np.quantile(place, 0.995)
    cut = (~within).any() and within.sum() >= least
    kept = points[within] if cut else points
    centre, major, minor, angle = _plain_enclosing(kept, 0.95)
    scale = np.quantile(_distance(kept, centre, major, minor, angle), 0.95)
    assert row.n == len(kept) and row.trimmed == (len(points) - len(kept))
    assert np.allclose([row.center_a, row.center_b, row.major, row.minor], [*centre, major * scale, minor * scale])
    assert math.isclose(math.sin(math.radians(row.angle_deg) - angle), 0.0, abs_tol=1e-9)
    inside = _distance(kept, (row.center_a, row.center_b), row.major, row.minor, math.radians(row.angle_deg)) <= 1
    assert abs(inside.mean() - 0.95) < 0.002


def test_neutral_axis(spark):
    pick = np.random.default_rng(6)
    l = np.concatenate([np.full(100, 10.0), np.full(50, 220.0), np.full(31, 100.0), np.full(80, 255.9)])
    a, b = 128 + pick.normal(2, 1, 261), 128 + pick.normal(-3, 1, 261)
    a[200:] = 180
    frame = _rows(spark, k=np.full(261, 7), l=l, a=a, b=b)
    found = {r.band: r for r in fits.neutral_axis(frame, "k", 0.5).collect()}
    assert sorted(found) == list(range(7))
    near = np.hypot(a - 128, b - 128) <= 14
    for band, low, high in ((0, 0, 16), (5, 208, 240)):
        own = near & (l >= low) & (l < high)
        assert found[band].n == own.sum() and math.isclose(found[band].da, -0.5 * np.median(a[own] - 128)) and math.isclose(found[band].db, -0.5 * np.median(b[own] - 128))
    assert found[3].n == 31 and found[3].da == 0.0 and found[6].n == 19 and found[6].da == 0.0 and found[1].db == 0.0


def test_minimum_norm(spark):
    pick = np.random.default_rng(8)
    rows = [(i, pick.normal(size=(k, 2)).tolist(), pick.normal(size=2).tolist()) for i, k in enumerate((1, 2, 3, 5))]
    rows += [(10, [[0.0, 0.0]], [1.0, 1.0]), (11, None, [1.0]), (12, [[1.0]], [1.0, 2.0]), (13, [[float("nan"), 1.0]], [1.0, 1.0]), (14, [], [1.0])]
    frame = spark.createDataFrame(rows, "id int, effects array<array<double>>, errors array<double>")
    found = {r.id: r.delta for r in fits.minimum_norm(frame, "effects", "errors").collect()}
    for i, effects, errors in rows[:4]:
        assert np.allclose(found[i], np.linalg.lstsq(np.array(effects).T, -np.array(errors), rcond=None)[0])
    assert found[10] == [0.0] and [found[k] for k in (11, 12, 13, 14)] == [None] * 4


def _dealt_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("query", ["robust_fit", "trimmed_fit", "enclosing_ellipse", "nearest_median", "customer_value_ranks"])
def test_rows_are_not_dealt_by_group(spark, query):
    """A group may hold half of all rows: rows are joined with what their group holds where they lie; only counts are dealt."""
    n, folder = 20_000, tempfile.mkdtemp(prefix="spark-fits-")
    x, y = (F.pmod(F.hash(F.col("id"), F.lit(k)), F.lit(k)).cast("double") for k in (7, 11))
    group = F.when(F.col("id") % 2 == 0, "O").otherwise("F")
    ids = spark.range(n, numPartitions=2)
    ids.select(group.alias("l_linestatus"), x.alias("l_quantity"), y.alias("l_extendedprice")).write.parquet(f"{folder}/lineitem.parquet")
    ids.select(group.alias("p_brand"), F.col("id").alias("p_partkey"), y.alias("p_retailprice")).write.parquet(f"{folder}/part.parquet")
    ids.select(group.alias("c_mktsegment"), F.col("id").alias("c_custkey"), y.alias("c_acctbal")).write.parquet(f"{folder}/customer.parquet")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").toDF("k", "x", "y")
    before = _dealt_rows(spark)
    # Rows count as a large table, so that only a table known to be small goes to them.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12000")
    try:
        if query == "trimmed_fit":
            assert all(9800 <= r.n <= 10_000 for r in fits.trimmed_fit(lines, ["k"], [F.lit(1.0), F.col("x")], [F.col("y")]).collect())
        elif query == "enclosing_ellipse":
            assert {r.k for r in fits.enclosing_ellipse(lines, ["k"], "x", "y", 0.95).collect()} == {"F", "O"}
        else:
            assert catalogue.QUERIES[query](spark, folder).count() == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert _dealt_rows(spark) - before < n / 2
