"""Operators on whole images: one image is one row, and numpy works on it inside the tasks.

An image is (height, width, values): values row by row, the channels of a pixel side by side. Rows stay where they are, so
nothing is shuffled and a task holds a batch of images at a time. An image without height, width or values, without pixels or
with values that don't fill its pixels evenly gives null in every result, as do images with null or non-finite values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Images of an Arrow batch that are worked on at a time.
SLICE = 64


def image_of(height: int | None, width: int | None, values: np.ndarray | None) -> np.ndarray | None:
    """The image as (height, width) or (height, width, channels), null if it isn't whole."""
    if not height or not width or height < 0 or width < 0 or values is None or not len(values) or len(values) % (height * width) or not np.isfinite(values).all():
        return None
    channels = len(values) // (height * width)
    return values.reshape((height, width) if channels == 1 else (height, width, channels))


def over_images(images: DataFrame, function: Callable[..., dict | None], outputs: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Add outputs (a schema) to images: function(image, *extra columns' values) gives them by name, or null for all."""
    fields = StructType.fromDDL(outputs).fields
    added = [f.name for f in fields]
    kept = [c for c in images.columns if c not in added]
    schema = StructType(images.select(*kept).schema.fields + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        whole = to_arrow_schema(schema)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                found = []
                for i in range(part.num_rows):
                    value = part.column("values")[i]
                    flat = value.values.to_numpy(zero_copy_only=False).astype(np.float64) if value.is_valid else None
                    image = image_of(part.column("height")[i].as_py(), part.column("width")[i].as_py(), flat)
                    result = None if image is None else function(image, *(part.column(c)[i].as_py() for c in extra))
                    found.append(result or {})
                columns = [part.column(c) for c in kept]
                columns += [pa.array([f.get(name) for f in found], whole.field(name).type) for name in added]
                yield pa.RecordBatch.from_arrays(columns, schema=whole)

    return images.mapInArrow(run, schema)


# Weights of video luma (measures) and of linear luma (everything else).
VIDEO, LINEAR = (0.299, 0.587, 0.114), (0.2126, 0.7152, 0.0722)


def gray(image: np.ndarray, weights: tuple[float, ...] = LINEAR) -> np.ndarray:
    """Luma of an image with three channels; others as they are, or their first channel."""
    if image.ndim == 2:
        return image
    return image @ np.array(weights) if image.shape[2] == 3 else image[..., 0]


def filtered(image: np.ndarray, kernel: np.ndarray, border: str = "reflect") -> np.ndarray:
    """Correlation with a small kernel; borders reflect without repeating the edge, or repeat it."""
    sides = [(k // 2, k // 2) for k in kernel.shape]
    padded = np.pad(image, sides, mode=border)
    out = np.zeros(image.shape)
    for (dy, dx), weight in np.ndenumerate(kernel):
        if weight:
            out += weight * padded[dy : dy + image.shape[0], dx : dx + image.shape[1]]
    return out


LAPLACE = np.array([[0.0, 1.0, 0.0], [1.0, -4.0, 1.0], [0.0, 1.0, 0.0]])
SOBEL_X = np.array([[-1.0, 0.0, 1.0], [-2.0, 0.0, 2.0], [-1.0, 0.0, 1.0]])


def median_filtered(image: np.ndarray, size: int = 5) -> np.ndarray:
    padded = np.pad(image, size // 2, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, (size, size)), axis=(2, 3))


def magnitudes(image: np.ndarray) -> np.ndarray:
    """Magnitudes of the two-dimensional Fourier transform, frequency zero at (height // 2, width // 2)."""
    return np.abs(np.fft.fftshift(np.fft.fft2(image)))


def high_share(image: np.ndarray, radius: float) -> float:
    """Share of the magnitudes farther than radius from frequency zero; 0 for an image that is zero."""
    found = magnitudes(image)
    y, x = np.ogrid[: image.shape[0], : image.shape[1]]
    outside = (y - image.shape[0] // 2) ** 2 + (x - image.shape[1] // 2) ** 2 > radius**2
    total = found.sum()
    return float(np.clip(found[outside].sum() / total, 0.0, 1.0)) if total > 0 else 0.0


def sharpness(images: DataFrame, radius: float = 40.0) -> DataFrame:
    """Add lap_raw and lap_denoised (variance of the Laplacian before and after a 5 x 5 median), noise_ratio (the share that the
    median takes away, 0..1) and high_share (of magnitudes beyond radius). A flat image has 0 in all but high_share's zero frequency."""

    def measured(image: np.ndarray) -> dict:
        luma = gray(image, VIDEO)
        raw, calm = (float(filtered(x, LAPLACE).var()) for x in (luma, median_filtered(luma)))
        return {"lap_raw": raw, "lap_denoised": calm, "noise_ratio": min(1.0, max(0.0, (raw - calm) / max(raw, 1e-6))), "high_share": high_share(luma, radius)}

    return over_images(images, measured, "lap_raw double, lap_denoised double, noise_ratio double, high_share double")


def directional(luma: np.ndarray, first: int = 5, step: int = 2, directions: int = 36) -> np.ndarray | None:
    """Mean of log(1 + magnitude) along each of the directions over half a turn, on both sides of frequency zero; None if too small."""
    found = np.log1p(magnitudes(luma))
    cy, cx = luma.shape[0] // 2, luma.shape[1] // 2
    reach = min(cx, cy) - first
    if reach <= 1 or reach <= first:
        return None
    radii = np.arange(first, reach, step)
    angles = np.radians(np.arange(directions) * 180.0 / directions)[:, None]
    sides = [(np.trunc(np.round(cy + s * radii * np.sin(angles), 9)).astype(int), np.trunc(np.round(cx + s * radii * np.cos(angles), 9)).astype(int)) for s in (1, -1)]
    return np.concatenate([found[y, x] for y, x in sides], axis=1).mean(axis=1)


def motion_blur(images: DataFrame, limit: float = 0.35, first: int = 5, step: int = 2) -> DataFrame:
    """Add angle (degrees, the direction of the weakest spectrum), strength (ten times the spectrum's spread over directions, to 1) and
    blurred (strength over limit). Images too small for a spectrum of directions, and dark ones, have angle and strength 0."""

    def measured(image: np.ndarray) -> dict:
        means = directional(gray(image, VIDEO), first, step)
        if means is None or means.mean() < 1e-6:
            return {"angle": 0.0, "strength": 0.0, "blurred": False}
        strength = min(1.0, 10.0 * float(means.std() / means.mean()))
        return {"angle": float(np.argmin(np.round(means, 9))) * 180.0 / len(means), "strength": strength, "blurred": strength > limit}

    return over_images(images, measured, "angle double, strength double, blurred boolean")


def turned_about(shape: tuple[int, ...], angle: float) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) in the source of every target pixel of an image turned by angle degrees, counter-clockwise, about (width/2, height/2)."""
    height, width = shape[:2]
    y, x = np.mgrid[:height, :width].astype(np.float64)
    turn = np.radians(angle)
    cos, sin = np.round([np.cos(turn), np.sin(turn)], 12)
    dx, dy = x - width / 2, y - height / 2
    return np.round(sin * dx + cos * dy + height / 2, 9), np.round(cos * dx - sin * dy + width / 2, 9)


def reflected(index: np.ndarray, size: int) -> np.ndarray:
    """Indices beyond the borders mirrored at the edge pixels, which aren't repeated."""
    if size == 1:
        return np.zeros_like(index)
    index = np.abs(index) % (2 * size - 2)
    return np.where(index >= size, 2 * size - 2 - index, index)


def _lanczos(distance: np.ndarray, taps: int = 4) -> np.ndarray:
    return np.where(np.abs(distance) < taps, np.sinc(distance) * np.sinc(distance / taps), 0.0)


def rotated(image: np.ndarray, angle: float) -> np.ndarray:
    """The image turned within its own frame: each target pixel gathers the 8 x 8 source pixels about its place, with Lanczos
    weights that sum to 1 and reflected borders. Multiples of a quarter turn, where places are whole, copy pixels."""
    if abs(angle) < 1e-9:
        return image
    at_y, at_x = turned_about(image.shape, angle)
    base_y, base_x = np.floor(at_y).astype(int), np.floor(at_x).astype(int)
    offsets = np.arange(-3, 5)
    weight_y, weight_x = (_lanczos(at[..., None] - (base[..., None] + offsets)) for at, base in ((at_y, base_y), (at_x, base_x)))
    weight_y /= weight_y.sum(axis=-1, keepdims=True)
    weight_x /= weight_x.sum(axis=-1, keepdims=True)
    rows = [reflected(base_y + o, image.shape[0]) for o in offsets]
    columns = [reflected(base_x + o, image.shape[1]) for o in offsets]
    out = np.zeros(image.shape)
    for i, y in enumerate(rows):
        for j, x in enumerate(columns):
            weight = weight_y[..., i] * weight_x[..., j]
            out += image[y, x] * (weight[..., None] if image.ndim == 3 else weight)
    return out


def flipped(image: np.ndarray, across: bool, down: bool) -> np.ndarray:
    return image[:: -1 if down else 1, :: -1 if across else 1]


def bilinear(image: np.ndarray, at_y: np.ndarray, at_x: np.ndarray) -> np.ndarray:
    """Values between pixels; beyond the borders the edge pixel's."""
    base_y, base_x = np.floor(at_y).astype(int), np.floor(at_x).astype(int)
    part_y, part_x = at_y - base_y, at_x - base_x

    def take(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return image[np.clip(y, 0, image.shape[0] - 1), np.clip(x, 0, image.shape[1] - 1)]

    if image.ndim == 3:
        part_y, part_x = part_y[..., None], part_x[..., None]
    top = take(base_y, base_x) * (1 - part_x) + take(base_y, base_x + 1) * part_x
    low = take(base_y + 1, base_x) * (1 - part_x) + take(base_y + 1, base_x + 1) * part_x
    return top * (1 - part_y) + low * part_y


def area_resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the source areas of the target pixels, parts of pixels counted by their share."""

    def along(values: np.ndarray, size: int) -> np.ndarray:
        edges = np.linspace(0, len(values), size + 1)
        sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
        low = np.minimum(edges.astype(int), len(values) - 1)
        part = (edges - low).reshape(-1, *[1] * (values.ndim - 1))
        return np.diff(sums[low] + part * values[low], axis=0) / (len(values) / size)

    return np.swapaxes(along(np.swapaxes(along(image, height), 0, 1), width), 0, 1)


def linear_resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear values at the target pixels' centres."""
    at_y = (np.arange(height) + 0.5) * image.shape[0] / height - 0.5
    at_x = (np.arange(width) + 0.5) * image.shape[1] / width - 0.5
    return bilinear(image, *np.meshgrid(np.clip(at_y, 0, image.shape[0] - 1), np.clip(at_x, 0, image.shape[1] - 1), indexing="ij"))


#: The horizon sweep: largest angle that is corrected, how far the sweep goes beyond it, its step, the longest side that is looked at,
#: and the least confidence. A slant beyond the limit then peaks outside it and is left alone, not half corrected.
HORIZON_LIMIT, HORIZON_MARGIN, HORIZON_STEP, HORIZON_SIDE, HORIZON_CONFIDENCE = 8.0, 4.0, 0.25, 256, 0.35


def horizon(image: np.ndarray, limit: float = HORIZON_LIMIT, step: float = HORIZON_STEP) -> tuple[float, float]:
    """(angle, confidence): the turn that makes the image's main edges level or upright, by a sweep of projections.

    The magnitudes of the gradient across are turned by every candidate angle and summed by rows; the angle whose row sums vary
    most wins. Confidence is how far its score stands above the median, as a share of the scores' range.
    """
    luma = np.maximum(gray(image), 0.0)
    scale = HORIZON_SIDE / max(luma.shape)
    if scale < 1:
        luma = area_resized(luma, *(max(1, round(side * scale)) for side in luma.shape))
    edges = np.abs(filtered(luma, SOBEL_X))
    span = limit + HORIZON_MARGIN
    angles = np.arange(-span, span + 1e-9, step)
    scores = np.array([bilinear(edges, *turned_about(edges.shape, angle)).sum(axis=1).var() for angle in angles])
    best = int(np.argmax(scores))
    spread = scores.max() - scores.min()
    return float(angles[best]), float(np.clip((scores[best] - np.median(scores)) / max(spread, 1e-9), 0.0, 1.0))


def composed(image: np.ndarray, rotation: float | None, across: bool | None, down: bool | None, level: bool | None, least: float = HORIZON_CONFIDENCE) -> tuple[np.ndarray, float]:
    """(image, turn): flipped, then turned by rotation or, where level is asked for, by the horizon's angle if that is reliable."""
    turn = rotation or 0.0
    if level:
        found, confidence = horizon(image)
        turn = found if abs(found) <= HORIZON_LIMIT and confidence >= least else 0.0
    return rotated(flipped(image, bool(across), bool(down)), turn), turn


def compose(images: DataFrame, rotation: str, across: str, down: str, level: str) -> DataFrame:
    """values flipped and turned as the named columns say (null: not), and turn, the angle in degrees that was used."""

    def done(image: np.ndarray, *asked) -> dict:
        out, turn = composed(image, *asked)
        return {"values": out.ravel(), "turn": turn}

    return over_images(images, done, "values array<double>, turn double", (rotation, across, down, level))


def horizons(images: DataFrame) -> DataFrame:
    """Add horizon_angle and horizon_confidence by the sweep of projections."""
    return over_images(images, lambda image: dict(zip(("horizon_angle", "horizon_confidence"), horizon(image), strict=True)), "horizon_angle double, horizon_confidence double")


#: Votes of line angles: bins over -VOTE_LIMIT..VOTE_LIMIT degrees.
VOTE_BINS, VOTE_LIMIT = 10, 15.0


def line_votes(lines: DataFrame, key: str, least: int = 3, sky: Column | None = None) -> DataFrame:
    """(key, angle, confidence, votes, has_horizon) by a vote of lines (key, x1, y1, x2, y2): the fullest of ten bins decides.

    Lines within 15 degrees of level vote, in either direction; upright ones and points don't. With fewer votes than `least`,
    in all or in the fullest bin (the lowest of equals), there is no horizon: votes are then all votes. angle is the mean in the
    bin, confidence its votes over three times `least`, to 1; where sky, a share by key, is above 0.4 it gains 0.2.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    slant = F.degrees(F.atan2(dy, dx))
    folded = F.when(F.abs(slant) <= VOTE_LIMIT, slant).when(F.abs(F.abs(slant) - 180) <= VOTE_LIMIT, slant - 180 * F.signum(slant))
    voted = lines.withColumn("__a", F.when(F.abs(dx) >= 1e-6, folded))
    place = F.least(F.floor((F.col("__a") + VOTE_LIMIT) / (2 * VOTE_LIMIT / VOTE_BINS)), F.lit(VOTE_BINS - 1)).cast("int")
    closed = F.col("__a") < VOTE_LIMIT
    bins = voted.withColumn("__bin", place).groupBy(key, "__bin").agg(F.count("__a").alias("__n"), F.avg(F.when(closed, F.col("__a"))).alias("__mean"), F.max(F.lit(0.0) if sky is None else sky).alias("__sky"))
    fullest = F.max_by(F.struct("__n", "__mean"), F.struct(F.col("__n"), (-F.col("__bin")).alias("b")))
    best = bins.groupBy(key).agg(F.sum("__n").alias("__all"), fullest.alias("__best"), F.max("__sky").alias("__sky"))
    found = (F.col("__all") >= least) & (F.col("__best.__n") >= least)
    confidence = F.least(F.lit(1.0), F.col("__best.__n") / F.lit(3.0 * least))
    confidence = F.least(F.lit(1.0), confidence + F.when(F.col("__sky") > 0.4, 0.2).otherwise(0.0))
    return best.select(key, F.when(found, F.coalesce(F.col("__best.__mean"), F.lit(0.0))).otherwise(0.0).alias("angle"), F.when(found, confidence).otherwise(0.0).alias("confidence"), F.when(found, F.col("__best.__n")).otherwise(F.col("__all")).alias("votes"), found.alias("has_horizon"))


def edge_lines(pixels: DataFrame, key: str, least: float) -> DataFrame:
    """(key, x1, y1, x2, y2): a unit line along the edge at every pixel of (key, y, x, v) whose gradient is `least` or more."""
    row, column = Window.partitionBy(key, "y").orderBy("x"), Window.partitionBy(key, "x").orderBy("y")
    dx, dy = F.lead("v").over(row) - F.lag("v").over(row), F.lead("v").over(column) - F.lag("v").over(column)
    sloped = pixels.withColumn("__dx", dx).withColumn("__dy", dy).where(F.sqrt(F.col("__dx") ** 2 + F.col("__dy") ** 2) >= least)
    return sloped.select(key, F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), (F.col("x") + F.col("__dy")).alias("x2"), (F.col("y") - F.col("__dx")).alias("y2"))


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Smoothing by a normalised Gaussian of four sigmas each way, borders reflected."""
    reach = max(1, round(4 * sigma))
    weights = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    weights /= weights.sum()
    for axis in (0, 1):
        index = np.arange(image.shape[axis])
        image = sum(w * np.take(image, reflected(index + o, image.shape[axis]), axis) for o, w in zip(range(-reach, reach + 1), weights, strict=True))
    return image


# Limits of a region's exposure, saturation and warmth, what full warmth adds to green and takes from blue, the
# display curve's power that stops are divided by; the feather's sigma is the longer side over 512, from 1 to 8.
REGION_LIMITS = {"exposure": 2.0, "saturation": 1.0, "warmth": 1.0}
WARM_GREEN, WARM_BLUE, DISPLAY_POWER = 0.10, 0.26, 2.2
FEATHER_SIDE, FEATHER_LEAST, FEATHER_MOST = 512.0, 1.0, 8.0


def feathered(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """A mask brought to the image's size (means over areas when shrinking, bilinear when growing), held to 0..1 and smoothed."""
    if mask.shape != (height, width):
        mask = (area_resized if mask.shape[0] > height else linear_resized)(mask, height, width)
    return gaussian(np.clip(mask, 0.0, 1.0), float(np.clip(max(height, width) / FEATHER_SIDE, FEATHER_LEAST, FEATHER_MOST)))


def saturated(image: np.ndarray, amount: float) -> np.ndarray:
    """HSV saturation times 1 + amount, to 1 at most; hue and value stay, so neutral pixels do."""
    value = image.max(axis=-1, keepdims=True)
    spread = value - image.min(axis=-1, keepdims=True)
    before = np.where(value > 0, spread / np.where(value > 0, value, 1.0), 0.0)
    after = np.clip(before * (1.0 + amount), 0.0, 1.0)
    return value - (value - image) * np.where(before > 0, after / np.where(before > 0, before, 1.0), 0.0)


def regions_applied(image: np.ndarray, regions: list[dict]) -> tuple[np.ndarray, list[str], list[float]]:
    """(image, names, coverage): the regions one after the other, each blended over the result so far by its feathered mask.

    A region is {name, exposure, saturation, warmth, height, width, mask}. Exposure is in stops of light on display values;
    then come warmth and saturation. Regions that change nothing, have no mask or a mask that is empty or not finite are skipped.
    """
    out = np.clip(image, 0.0, 1.0)
    names, coverage = [], []
    for region in regions:
        exposure, saturation, warmth = (region[k] or 0.0 for k in REGION_LIMITS)
        flat = None if region["mask"] is None else np.array([np.nan if v is None else v for v in region["mask"]], float)
        mask = image_of(region["height"], region["width"], flat)
        if not (exposure or saturation or warmth) or mask is None or mask.ndim != 2:
            continue
        share = feathered(mask, *image.shape[:2])
        if share.max() <= 0:
            continue
        changed = out * 2.0 ** (exposure / DISPLAY_POWER) * np.array([1.0, 1 + WARM_GREEN * warmth, 1 - WARM_BLUE * warmth])
        changed = np.clip(saturated(changed, saturation) if saturation else changed, 0.0, 1.0)
        out = out * (1 - share[..., None]) + changed * share[..., None]
        names.append(region["name"])
        coverage.append(float(share.mean()))
    return out, names, coverage


def apply_regions(images: DataFrame, regions: str) -> DataFrame:
    """values (three channels on 0..1) with the edits of the column `regions`, an array of structs, in its order; also
    regions_applied and mask_coverage. Edits beyond REGION_LIMITS fail the job (raise) and name the region."""

    def done(image: np.ndarray, asked: list[dict] | None) -> dict:
        for region in asked or []:
            for name, limit in REGION_LIMITS.items():
                if region[name] is not None and not -limit <= region[name] <= limit:
                    raise ValueError(f"region {region['name']}: {name} {region[name]} is beyond {limit}")
        if image.ndim != 3 or image.shape[2] != 3:
            return {}
        out, names, coverage = regions_applied(image, asked or [])
        return {"values": out.ravel(), "regions_applied": names, "mask_coverage": coverage}

    return over_images(images, done, "values array<double>, regions_applied array<string>, mask_coverage array<double>", (regions,))


def box_mean(image: np.ndarray, radius: int) -> np.ndarray:
    """Means of the windows of 2 * radius + 1, cut at the borders, by sums of sums."""

    def along(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
        index = np.arange(len(values))
        low, high = np.maximum(index - radius, 0), np.minimum(index + radius + 1, len(values))
        return (sums[high] - sums[low]) / (high - low).reshape(-1, *[1] * (values.ndim - 1))

    return np.swapaxes(along(np.swapaxes(along(image), 0, 1)), 0, 1)


def guided(guide: np.ndarray, image: np.ndarray, radius: int, eps: float) -> np.ndarray:
    """Edge-preserving smoothing of an image by a guide: local linear fits, averaged."""
    mean_g, mean_i = box_mean(guide, radius), box_mean(image, radius)
    slope = (box_mean(guide * image, radius) - mean_g * mean_i) / (box_mean(guide * guide, radius) - mean_g**2 + eps)
    return box_mean(slope, radius) * guide + box_mean(mean_i - slope * mean_g, radius)


def masked_smoothing(images: DataFrame, mask: str, strength: float, radius: int = 4, eps: float = 0.01) -> DataFrame:
    """values smoothed by guided filtering of each channel by the luma, blended in by strength times the mask (an array on the
    image's grid, 0..1); a missing mask, or one of another size, changes nothing. smoothed is the mean share that was blended in."""

    def done(image: np.ndarray, share: list | None) -> dict:
        cover = None if share is None else image_of(*image.shape[:2], np.array([np.nan if v is None else v for v in share], float))
        if cover is None or cover.ndim != 2:
            return {"values": image.ravel(), "smoothed": 0.0}
        share_ = np.clip(cover, 0.0, 1.0) * strength
        planes = image[..., None] if image.ndim == 2 else image
        luma = gray(image)
        calm = np.stack([guided(luma, planes[..., c], radius, eps) for c in range(planes.shape[2])], axis=-1)
        out = planes + (calm - planes) * share_[..., None]
        return {"values": out.ravel(), "smoothed": float(share_.mean())}

    return over_images(images, done, "values array<double>, smoothed double", (mask,))


# Saturation from which a pixel is protected a little and in full; sharpening's sigma and gain.
PROTECT_FROM, PROTECT_FULL, SHARPEN_SIGMA, SHARPEN_GAIN = 0.08, 0.32, 1.2, 12.0


def protection(image: np.ndarray) -> np.ndarray:
    """From 0 for near-neutral pixels to 1 for saturated ones, smoothly, by HSV saturation."""
    most = image.max(axis=-1)
    saturation = np.where(most > 0, (most - image.min(axis=-1)) / np.where(most > 0, most, 1.0), 0.0)
    x = np.clip((saturation - PROTECT_FROM) / (PROTECT_FULL - PROTECT_FROM), 0.0, 1.0)
    return x * x * (3 - 2 * x)


def chroma_denoised(image: np.ndarray, sigma: float) -> np.ndarray:
    """Two levels: shrunk to a quarter, smoothed and enlarged, the colour distances of the small image replace those of near-neutral
    pixels; the full-size luma stays."""
    height, width = image.shape[:2]
    small = gaussian(area_resized(image, max(height // 4, 4), max(width // 4, 4)), sigma)
    calm = linear_resized(small, height, width) - linear_resized(gray(small)[..., None], height, width)
    luma, keep = gray(image)[..., None], protection(image)[..., None]
    return np.clip(luma + calm + keep * (image - luma - calm), 0.0, 1.0)


def luma_sharpened(image: np.ndarray, amount: float) -> np.ndarray:
    """Unsharp masking of the luma; colour distances stay, but shrink as a whole where a channel would leave 0..1."""
    before = gray(image)
    chroma = image - before[..., None]
    luma = np.clip(before + amount * SHARPEN_GAIN * (before - gaussian(before, SHARPEN_SIGMA)) * (1 - protection(image)), 0.0, 1.0)[..., None]
    out = luma + chroma
    for room, sign in ((1 - luma, 1.0), (luma, -1.0)):
        if ((out > 1) if sign > 0 else (out < 0)).any():
            reach = np.maximum(sign * chroma, 0.0).sum(axis=-1, keepdims=True)
            out = luma + chroma * np.where(reach > 1e-6, np.minimum(1.0, room / np.maximum(reach, 1e-6)), 1.0)
    return np.clip(out, 0.0, 1.0)


def highlights_calmed(image: np.ndarray, strength: float) -> np.ndarray:
    """Near-neutral highlights (luma from 0.55, in full from 0.85) drawn to their luma."""
    luma = gray(image)
    x = np.clip((luma - 0.55) / 0.30, 0.0, 1.0)
    share = (x * x * (3 - 2 * x) * (1 - protection(image)) * strength)[..., None]
    return image * (1 - share) + luma[..., None] * share


def refined(images: DataFrame, sharpen: float, denoise: float, highlights: float) -> DataFrame:
    """values (three channels on 0..1) sharpened in luma, denoised in colour at a quarter of the size, and calmed in highlights, in
    this order; a strength of 0 leaves its step out. Images of other channels have null values."""

    def done(image: np.ndarray) -> dict:
        if image.ndim != 3 or image.shape[2] != 3:
            return {}
        image = np.clip(image, 0.0, 1.0)
        image = luma_sharpened(image, sharpen) if sharpen > 0 else image
        image = chroma_denoised(image, denoise) if denoise > 0 else image
        image = highlights_calmed(image, highlights) if highlights > 0 else image
        return {"values": np.clip(image, 0.0, 1.0).ravel()}

    return over_images(images, done, "values array<double>")
