"""Colour temperature, tint and camera gains: nearest point of a locus, fixed points and inversions, row by row in numpy.

A camera is a Profile: matrices from XYZ to camera values under two light sources, blended by reciprocal temperature. It is one
small record given with the call. All steps work on the rows of an Arrow batch at a time; nothing is shuffled. Rows with a null
or non-finite value give null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

# The locus is sampled at these temperatures; the white that profiles connect to; limits of temperature and tint;
# what full tint adds to v.
LOCUS_FROM, LOCUS_TO, LOCUS_STEP = 1600.0, 25000.0, 5.0
D50 = (0.3457, 0.3585)
KELVIN_LIMITS, TINT_LIMIT, TINT_V = (1500.0, 50000.0), 150.0, 0.010
#: Fixed points: rounds at most, and the change that ends them.
ROUNDS, SETTLED = 30, 1e-7
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])


@dataclass(frozen=True)
class Profile:
    """Matrices from XYZ to a camera (3 x 3, row by row) at two temperatures; without a second one the first holds everywhere."""

    first: Sequence[float]
    second: Sequence[float] | None = None
    first_kelvin: float = 2850.0
    second_kelvin: float = 6500.0
    calibration: Sequence[float] | None = None

    def share(self, kelvin: np.ndarray) -> np.ndarray:
        """The second matrix's share by reciprocal temperature, 0 where a temperature isn't positive or both agree."""
        if self.second is None or min(self.first_kelvin, self.second_kelvin) <= 0 or self.first_kelvin == self.second_kelvin:
            return np.zeros(len(kelvin))
        safe = np.where(kelvin > 0, kelvin, 1.0)
        share = (1 / safe - 1 / self.first_kelvin) / (1 / self.second_kelvin - 1 / self.first_kelvin)
        return np.where(kelvin > 0, np.clip(share, 0.0, 1.0), 0.0)

    def matrices(self, kelvin: np.ndarray) -> np.ndarray:
        """(rows, 3, 3) from XYZ to the camera at each temperature."""
        one = np.reshape(self.first, (3, 3)).astype(float)
        two = one if self.second is None else np.reshape(self.second, (3, 3)).astype(float)
        share = self.share(kelvin)[:, None, None]
        return (1 - share) * one + share * two


def over_rows(rows: DataFrame, inputs: Sequence[str], function: Callable[..., Sequence[np.ndarray]], outputs: Sequence[str]) -> DataFrame:
    """Add outputs (doubles): function(*inputs as arrays) gives them; rows with a null or non-finite input or output get null."""
    schema = StructType([f for f in rows.schema.fields if f.name not in outputs] + [StructField(n, DoubleType()) for n in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(batch.schema.get_field_index(n)).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in inputs]
            sound = np.isfinite(np.stack(values)).all(axis=0)
            found = np.full((len(outputs), batch.num_rows), np.nan)
            if sound.any():
                found[:, sound] = np.stack(list(function(*(v[sound] for v in values))))
            kept = [n for n in batch.schema.names if n not in outputs]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in kept] + [pa.array(c, mask=~np.isfinite(c)) for c in found]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *outputs])

    return rows.mapInArrow(run, schema)


def locus(kelvin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chromaticity of a black body by piecewise cubics (Kim and others, 2002), from 1667 kelvin."""
    t = np.maximum(kelvin, 1667.0)
    x = np.where(t <= 4000, np.polyval([-0.2661239e9, -0.2343589e6, 0.8776956e3, 0.179910], 1 / t), np.polyval([-3.0258469e9, 2.1070379e6, 0.2226347e3, 0.240390], 1 / t))
    low = np.polyval([-1.1063814, -1.34811020, 2.18555832, -0.20219683], x)
    middle = np.polyval([-0.9549476, -1.37418593, 2.09137015, -0.16748867], x)
    high = np.polyval([3.0817580, -5.87338670, 3.75112997, -0.37001483], x)
    return x, np.where(t <= 2222, low, np.where(t <= 4000, middle, high))


def to_uv(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = -2 * x + 12 * y + 3
    return 4 * x / scale, 6 * y / scale


def from_uv(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = 2 * u - 8 * v + 4
    return 3 * u / scale, 2 * v / scale


def cubic_kelvin(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Temperature by McCamy's cubic."""
    n = (x - 0.3320) / (y - 0.1858)
    return np.polyval([-449.0, 3525.0, -6823.3, 5520.33], n)


def nearest_kelvin(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Temperature of the nearest of the locus's sampled points in uv, refined by the parabola through its distance and its
    neighbours'; held to the sampled range."""
    kelvin = np.arange(LOCUS_FROM, LOCUS_TO, LOCUS_STEP)
    at_u, at_v = to_uv(*locus(kelvin))
    u, v = to_uv(x, y)
    out = np.empty(len(u))
    for start in range(0, len(u), 256):
        part = slice(start, start + 256)
        apart = (at_u - u[part, None]) ** 2 + (at_v - v[part, None]) ** 2
        low = np.clip(apart.argmin(axis=1) - 1, 0, len(kelvin) - 3)
        d0, d1, d2 = (apart[np.arange(len(low)), low + k] for k in range(3))
        bend = d0 - 2 * d1 + d2
        shift = np.where(bend != 0, (d0 - d2) / np.where(bend != 0, 2 * bend, 1.0), 0.0)
        out[part] = kelvin[low + 1] + LOCUS_STEP * shift
    return np.clip(out, LOCUS_FROM, LOCUS_TO)


def kelvins(rows: DataFrame, x: str, y: str, name: str = "kelvin") -> DataFrame:
    """Add the correlated colour temperature of chromaticities."""
    return over_rows(rows, [x, y], lambda a, b: [nearest_kelvin(a, b)], [name])


def to_xy(xyz: np.ndarray) -> np.ndarray:
    """(rows, 2): chromaticities of XYZ, a third each where their sum isn't positive."""
    total = xyz.sum(axis=1, keepdims=True)
    return np.where(total > 0, xyz[:, :2] / np.where(total > 0, total, 1.0), 0.3333)


def neutral_xy(neutral: np.ndarray, profile: Profile) -> np.ndarray:
    """(rows, 2): the chromaticity of the light under which a camera sees `neutral` as white.

    From D50 on, the matrix at the present chromaticity's temperature gives the next one, until a row moves by less than SETTLED;
    rows that haven't settled after ROUNDS rounds get the mean of their last two.
    """
    last = np.tile(D50, (len(neutral), 1))
    out, open_ = last.copy(), np.arange(len(neutral))
    for _ in range(ROUNDS):
        if not len(open_):
            break
        matrices = profile.matrices(cubic_kelvin(*last[open_].T))
        after = to_xy(np.linalg.solve(matrices, neutral[open_, :, None])[..., 0])
        moved = np.abs(after - last[open_]).sum(axis=1)
        out[open_] = np.where((moved < SETTLED)[:, None], after, (after + last[open_]) / 2)
        last[open_] = after
        open_ = open_[moved >= SETTLED]
    return out


def neutral_of(gains: np.ndarray) -> np.ndarray:
    """Camera values of white from gains (red, green, blue), green 1; gains with no positive green are taken as ones."""
    sound = gains[:, 1:2] > 0
    scaled = np.where(sound, gains / np.where(sound, gains[:, 1:2], 1.0), 1.0)
    neutral = 1 / np.maximum(scaled, 1e-9)
    return neutral / neutral[:, 1:2]


def light_of(rows: DataFrame, gains: Sequence[str], profile: Profile) -> DataFrame:
    """Add light_x, light_y and light_kelvin (held to 1000..50 000) of camera gains, by the fixed point."""

    def found(*values: np.ndarray) -> list[np.ndarray]:
        xy = neutral_xy(neutral_of(np.stack(values, axis=1)), profile)
        return [xy[:, 0], xy[:, 1], np.clip(cubic_kelvin(*xy.T), 1000.0, 50_000.0)]

    return over_rows(rows, gains, found, ["light_x", "light_y", "light_kelvin"])


def gains_of(kelvin: np.ndarray, tint: np.ndarray, profile: Profile) -> np.ndarray:
    """(rows, 3): gains (red, 1, blue) of a temperature and a tint, which moves along the isotherm in v."""
    u, v = to_uv(*locus(kelvin))
    x, y = (np.clip(c, 0.05, 0.75) for c in from_uv(u, v + tint / TINT_LIMIT * TINT_V))
    white = np.stack([x / y, np.ones(len(x)), (1 - x - y) / y], axis=1)
    response = np.maximum((profile.matrices(cubic_kelvin(x, y)) @ white[..., None])[..., 0], 1e-6)
    return response[:, 1:2] / response


def gains(rows: DataFrame, kelvin: str, tint: str, profile: Profile) -> DataFrame:
    """Add gain_r and gain_b (green 1) of temperatures and tints."""
    return over_rows(rows, [kelvin, tint], lambda k, t: list(gains_of(k, t, profile)[:, [0, 2]].T), ["gain_r", "gain_b"])


def kelvin_tint(red: np.ndarray, blue: np.ndarray, profile: Profile, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kelvin, tint, miss): the temperature and tint whose gains are nearest to (red, 1, blue).

    Damped Newton steps on reciprocal temperature and tint from six starts, within the limits, and the best end of each row; one
    start is the nearest place of a coarse grid. A step that doesn't come nearer is halved, and a value that stands at a limit and
    pulls beyond it stays there. miss is the distance of the gains that is left.
    """
    target = np.stack([red, blue], axis=1)
    guess = np.clip(cubic_kelvin(*neutral_xy(neutral_of(np.stack([red, np.ones(len(red)), blue], axis=1)), profile).T), *KELVIN_LIMITS)
    low, high = np.array([1e6 / KELVIN_LIMITS[1], -TINT_LIMIT]), np.array([1e6 / KELVIN_LIMITS[0], TINT_LIMIT])

    def miss(place: np.ndarray) -> np.ndarray:
        return gains_of(1e6 / place[:, 0], place[:, 1], profile)[:, [0, 2]] - target

    grid = np.array([(m, t) for m in np.linspace(low[0], high[0], 25) for t in np.linspace(low[1], high[1], 9)])
    made = gains_of(1e6 / grid[:, 0], grid[:, 1], profile)[:, [0, 2]]
    coarse = grid[((made - target[:, None]) ** 2).sum(axis=2).argmin(axis=1)]
    best, least = None, None
    for kelvin, tint in ((1e6 / coarse[:, 0], coarse[:, 1]), (guess, 0.0), (3000.0, 0.0), (5000.0, 0.0), (guess, 25.0), (guess, -25.0)):
        place = np.stack([np.broadcast_to(1e6 / np.asarray(kelvin, float), len(red)), np.broadcast_to(np.asarray(tint, float), len(red))], axis=1)
        place = np.clip(place, low, high)
        error = miss(place)
        for _ in range(rounds):
            sides = []
            for axis, step in ((0, 0.01), (1, 0.1)):
                moved = np.clip(place + np.eye(2)[axis] * step, low, high)
                back = np.clip(place - np.eye(2)[axis] * step, low, high)
                sides.append((miss(moved) - miss(back)) / (moved - back)[:, axis : axis + 1])
            slope = np.stack(sides, axis=2)
            pull = (np.swapaxes(slope, 1, 2) @ error[..., None])[..., 0]
            held = ((place <= low) & (pull > 0)) | ((place >= high) & (pull < 0))
            slope = np.where(held[:, None, :], 0.0, slope)
            normal = np.swapaxes(slope, 1, 2) @ slope + (held[:, None, :] + 1e-15) * np.eye(2)
            step = -np.linalg.solve(normal, np.swapaxes(slope, 1, 2) @ error[..., None])[..., 0]
            for _ in range(8):
                tried = np.clip(place + step, low, high)
                after = miss(tried)
                nearer = (after**2).sum(axis=1) < (error**2).sum(axis=1)
                place, error = np.where(nearer[:, None], tried, place), np.where(nearer[:, None], after, error)
                step = np.where(nearer[:, None], 0.0, step / 2)
        cost = np.sqrt((error**2).sum(axis=1))
        if best is None:
            best, least = place, cost
        else:
            better = cost < least - 1e-12
            best, least = np.where(better[:, None], place, best), np.where(better, cost, least)
    return 1e6 / best[:, 0], best[:, 1], least


def kelvins_tints(rows: DataFrame, gain_r: str, gain_b: str, profile: Profile) -> DataFrame:
    """Add kelvin, tint and gain_miss of camera gains with green 1; gains that aren't positive give null."""

    def found(red: np.ndarray, blue: np.ndarray) -> list[np.ndarray]:
        sound = (red > 0) & (blue > 0)
        results = kelvin_tint(np.where(sound, red, 1.0), np.where(sound, blue, 1.0), profile)
        return [np.where(sound, r, np.nan) for r in results]

    return over_rows(rows, [gain_r, gain_b], found, ["kelvin", "tint", "gain_miss"])


def adapted(source: np.ndarray, target: Sequence[float]) -> np.ndarray:
    """(rows, 3, 3): Bradford adaptation from chromaticities to one white; a white without cone response scales by one."""

    def cones(xy: np.ndarray) -> np.ndarray:
        return np.stack([xy[:, 0] / xy[:, 1], np.ones(len(xy)), (1 - xy.sum(axis=1)) / xy[:, 1]], axis=1) @ BRADFORD.T

    own, other = cones(source), cones(np.asarray([target], float))
    scale = np.where(own > 0, np.maximum(other, 0.0) / np.where(own > 0, own, 1.0), 1.0)
    return np.linalg.inv(BRADFORD) @ (scale[:, :, None] * BRADFORD)


def camera_matrices(gains_: np.ndarray, profile: Profile) -> np.ndarray:
    """(rows, 3, 3) from balanced camera values (values times gains) to XYZ under D50: gains undone, the camera's matrix inverted at
    the light's temperature, then adapted."""
    light = neutral_xy(neutral_of(gains_), profile)
    inner = profile.matrices(cubic_kelvin(*light.T))
    if profile.calibration is not None:
        inner = np.reshape(profile.calibration, (3, 3)) @ inner
    undone = np.eye(3)[None] * (1 / np.maximum(gains_, 1e-9))[:, None, :]
    return adapted(light, D50) @ np.linalg.inv(inner) @ undone


def camera_to_xyz(rows: DataFrame, values: Sequence[str], gains_: Sequence[str], profile: Profile) -> DataFrame:
    """Add x, y and z under D50 of balanced camera values, each row with its own gains; white is (gain-balanced) 1, 1, 1."""

    def found(*columns: np.ndarray) -> list[np.ndarray]:
        matrices = camera_matrices(np.stack(columns[3:], axis=1), profile)
        return list((matrices @ np.stack(columns[:3], axis=1)[..., None])[..., 0].T)

    return over_rows(rows, [*values, *gains_], found, ["x", "y", "z"])


def camera_white(rows: DataFrame, gains_: Sequence[str], profile: Profile) -> DataFrame:
    """Add white_r, white_g and white_b: the camera's own values of the light's white over the largest of them, held to 0.001..1
    (1 each if none is positive)."""

    def found(*columns: np.ndarray) -> list[np.ndarray]:
        light = neutral_xy(neutral_of(np.stack(columns, axis=1)), profile)
        inner = profile.matrices(cubic_kelvin(*light.T))
        if profile.calibration is not None:
            inner = np.reshape(profile.calibration, (3, 3)) @ inner
        white = np.stack([light[:, 0] / light[:, 1], np.ones(len(light)), (1 - light.sum(axis=1)) / light[:, 1]], axis=1)
        seen = (inner @ white[..., None])[..., 0]
        most = seen.max(axis=1, keepdims=True)
        return list(np.where(most > 0, np.clip(seen / np.where(most > 0, most, 1.0), 0.001, 1.0), 1.0).T)

    return over_rows(rows, gains_, found, ["white_r", "white_g", "white_b"])
