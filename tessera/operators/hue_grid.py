"""Colour deformations given by scattered points: smoothed onto a grid of hue, chroma and lightness, and looked up in it.

A point is (h in degrees, c, l, dh, c_gain, l_gain). The grid is small and fixed, the points may be many: each task sums the
points it has into all nodes, and one row per node and task is added up. Nothing is cut off by distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.functions import color
from tessera.operators.toning import limited_chroma

POINT = ("h", "c", "l", "dh", "c_gain", "l_gain")
# Nodes by hue, chroma and lightness, the chroma that the grid reaches to, and the distance that counts as a hit.
GRID, CHROMA, HIT = (72, 24, 24), 0.37, 1e-12
#: Products of nodes and points at a time.
BLOCK = 4_000_000


def centres(grid: Sequence[int]) -> np.ndarray:
    """(hue in radians, chroma as a share of the reach, lightness) of every node, lightness running fastest."""
    axes = [(np.arange(n) + 0.5) / n * span for n, span in zip(grid, (2 * math.pi, 1.0, 1.0), strict=True)]
    return np.stack([a.ravel() for a in np.meshgrid(*axes, indexing="ij")], axis=1)


def rasterized(points: DataFrame, grid: Sequence[int] = GRID, chroma: float = CHROMA, sigma: float | None = None) -> DataFrame:
    """(node, dh, c_gain, l_gain): for every node the mean of all points, weighted by a Gaussian of their distance.

    Hue is a ring, in radians; chroma counts as a share of the reach. sigma is by default the cube root of the volume a point has
    for itself. A point that lies on a node decides there alone, and where all weights vanish the nearest does (of equally near
    ones the smallest values). Points with a null or non-finite value take no part; without points there are no nodes.
    """
    whole = points.select(*[F.col(c).cast("double").alias(c) for c in POINT])
    whole = whole.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('Infinity')" for c in POINT))
    count = whole.count() if sigma is None else 1
    width = sigma or (2 * math.pi / max(count, 1)) ** (1 / 3)
    nodes = centres(grid)
    step = max(1, BLOCK // len(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, near, best = np.zeros((len(nodes), 4)), np.full(len(nodes), np.inf), np.zeros((len(nodes), 3))
        seen = False
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in range(6)], axis=1)
            rows = rows[np.lexsort(rows[:, 5:2:-1].T)]
            for start in range(0, len(rows), step):
                part = rows[start : start + step]
                seen = True
                ring = np.abs((nodes[:, :1] - np.radians(part[:, 0])[None] + math.pi) % (2 * math.pi) - math.pi)
                apart = ring**2 + (nodes[:, 1:2] - part[:, 1][None] / max(chroma, 1e-9)) ** 2 + (nodes[:, 2:] - part[:, 2][None]) ** 2
                weight = np.exp(-apart / (2 * width * width))
                sums += weight @ np.concatenate([part[:, 3:], np.ones((len(part), 1))], axis=1)
                first = apart.argmin(axis=1)
                least, values = apart[np.arange(len(nodes)), first], part[first, 3:]
                closer = (least < near) | ((least == near) & np.array([tuple(a) < tuple(b) for a, b in zip(values, best, strict=True)]))
                near[closer], best[closer] = least[closer], values[closer]
        if seen:
            columns = [np.arange(len(nodes), dtype=np.int32), *sums.T, near, *best.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["node", "s0", "s1", "s2", "w", "near", "b0", "b1", "b2"])

    parts = whole.mapInArrow(run, "node int, s0 double, s1 double, s2 double, w double, near double, b0 double, b1 double, b2 double")
    best = F.min(F.struct("near", "b0", "b1", "b2")).alias("best")
    added = parts.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("s0", "s1", "s2", "w")], best)
    alone = (F.col("best.near") < HIT) | (F.col("w") == 0)
    return added.select("node", *[F.when(alone, F.col(f"best.b{i}")).otherwise(F.col(f"s{i}") / F.col("w")).alias(n) for i, n in enumerate(POINT[3:])])


def table_of(nodes: DataFrame, grid: Sequence[int] = GRID) -> np.ndarray:
    """The grid's values (hue, chroma, lightness, 3) on the driver: as many as the grid has nodes, whatever the number of points."""
    found = nodes.where((F.col("node") >= 0) & (F.col("node") < math.prod(grid))).dropDuplicates(["node"]).toPandas()
    out = np.tile([0.0, 1.0, 1.0], (math.prod(grid), 1))
    out[found["node"]] = found[list(POINT[3:])]
    return out.reshape(*grid, 3)


def _between(position: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    position = np.clip(position, 0.0, size - 1.0)
    low = np.clip(np.floor(position).astype(int), 0, max(size - 2, 0))
    return low, np.minimum(low + 1, size - 1), position - low


def trilinear(table: np.ndarray, h: np.ndarray, c: np.ndarray, l: np.ndarray) -> np.ndarray:
    """(rows, 3): values between nodes; hue wraps around its axis, chroma and lightness are node numbers, held to their axes."""
    size = table.shape[0]
    place = (h % 360.0) / 360.0 * size
    h0 = np.floor(place).astype(int) % size
    h1, fh = (h0 + 1) % size, (place - np.floor(place))[:, None]
    c0, c1, fc = _between(c, table.shape[1])
    l0, l1, fl = _between(l, table.shape[2])
    fc, fl = fc[:, None], fl[:, None]

    def plane(hue: np.ndarray) -> np.ndarray:
        return (table[hue, c0, l0] * (1 - fl) + table[hue, c0, l1] * fl) * (1 - fc) + (table[hue, c1, l0] * (1 - fl) + table[hue, c1, l1] * fl) * fc

    return plane(h0) * (1 - fh) + plane(h1) * fh


def looked_up(pixels: DataFrame, table: np.ndarray, h: str, c: str, l: str) -> DataFrame:
    """Add dh, c_gain and l_gain of every row by trilinear lookup at the columns h (degrees), c and l (node numbers); null or
    non-finite places give null."""
    schema = StructType(pixels.schema.fields + [StructField(name, DoubleType()) for name in POINT[3:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [batch.column(batch.schema.get_field_index(n)).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in (h, c, l)]
            sound = np.isfinite(np.stack(places)).all(axis=0)
            found = trilinear(table, *(np.where(sound, p, 0.0) for p in places))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, k], mask=~sound) for k in range(3))], [*batch.schema.names, *POINT[3:]])

    return pixels.mapInArrow(run, schema)


def deformed(pixels: DataFrame, table: np.ndarray, most: Column, strength: float = 1.0, eps_hue: float = 0.01, eps_gain: float = 0.01) -> DataFrame:
    """pixels (r, g, b on 0..1, and others) with their colours moved by the table; most(ok_l) is the chroma that a lightness has room for.

    Hue turns by dh, chroma and lightness are multiplied, each by strength; raised chroma bends towards the most. Pixels that the
    table doesn't move keep their values exactly, as do all at a strength of 0 or with a table that moves nothing.
    """
    moves = (np.abs(table[..., 0]) >= eps_hue) | (np.abs(table[..., 1:] - 1) >= eps_gain).any(axis=-1)
    if strength <= 0 or not moves.any():
        return pixels
    names = pixels.columns
    ok = color.srgb_to_oklab(F.col("r"), F.col("g"), F.col("b"))
    lab = pixels.select("*", *[x.alias(n) for n, x in zip(("ok_l", "ok_a", "ok_b"), ok, strict=True)])
    chroma, hue = color.polar(F.col("ok_a"), F.col("ok_b"))
    found = looked_up(lab.withColumn("chroma", chroma).withColumn("hue", hue), table, "hue", "chroma", "ok_l")
    light = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("ok_l") * (1 + strength * (F.col("l_gain") - 1))))
    turned = found.withColumn("new_l", light).withColumn("new_h", F.radians(F.col("hue") + strength * F.col("dh")))
    turned = turned.withColumn("new_c", limited_chroma(F.col("chroma") * (1 + strength * (F.col("c_gain") - 1)), F.col("chroma"), most))
    back = color.oklab_to_srgb(F.col("new_l"), F.col("new_c") * F.cos("new_h"), F.col("new_c") * F.sin("new_h"))
    moved = (F.abs("dh") >= eps_hue) | (F.abs(F.col("c_gain") - 1) >= eps_gain) | (F.abs(F.col("l_gain") - 1) >= eps_gain)
    colours = dict(zip("rgb", back, strict=True))
    return turned.select(*[F.when(moved, colours[n]).otherwise(F.col(n)).alias(n) if n in colours else F.col(n) for n in names])
