"""Kernels on flat arrays and small images."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

FRACTIONS = (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


def winsorised_minmax(volume: np.ndarray, mask: np.ndarray, low: float = 1.0, high: float = 99.0, eps: float = 1e-6) -> np.ndarray:
    """Values inside the mask clipped to two percentiles and scaled to 0..1; 0 outside.

    A degenerate percentile range falls back to minimum and maximum, a constant one gives 0.
    An empty mask leaves the volume as it is.
    """
    inside = mask.astype(bool)
    out = np.zeros(volume.shape, np.float32)
    if not inside.any():
        return volume.astype(np.float32)
    x = np.nan_to_num(volume[inside].astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    a, b = np.percentile(x, [low, high])
    if b - a <= eps:
        a, b = x.min(), x.max()
    out[inside] = 0 if b - a <= eps else np.clip((x - a) / (b - a), 0, 1)
    return out


def _bound(value: Column, f) -> Column:
    """f(value) with value evaluated once per row: lambdas would evaluate it for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rounded(value: Column | str, digits: int) -> Column:
    """A double rounded half away from zero as C and SQL engines do: what rounds to 0 keeps its sign,
    which Spark's round, by way of a decimal, loses."""
    value = F.col(value) if isinstance(value, str) else value
    scaled = F.abs(value) * F.lit(10.0**digits)
    return F.when(scaled < F.lit(2.0**52), F.signum(value) * F.floor(scaled + 0.5).cast("double") / F.lit(10.0**digits)).otherwise(value)


def winsorised(values: str) -> Column:
    """winsorised_minmax of an array column (mask: its non-null entries), in the JVM."""
    ordered = F.array_sort(F.transform(F.filter(F.col(values), lambda x: x.isNotNull()), lambda x: x.cast("double")))

    def quantile(v: Column, q: float) -> Column:
        at = (F.size(v) - 1) * F.lit(q)
        lo = F.floor(at).cast("int")
        a, b = F.get(v, lo), F.get(v, F.least(lo + 1, F.size(v) - 1))
        return a + (b - a) * (at - lo)

    def limits(v: Column) -> Column:
        lo, hi = quantile(v, 0.01), quantile(v, 0.99)
        good = hi - lo > 1e-6
        return F.struct(F.when(good, lo).otherwise(F.get(v, F.lit(0))).alias("lo"), F.when(good, hi).otherwise(F.get(v, F.size(v) - 1)).alias("hi"))

    def scaled(r: Column) -> Column:
        width = r["hi"] - r["lo"]
        one = lambda x: F.when(x.isNull() | (F.coalesce(width, F.lit(0.0)) <= 1e-6), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - r["lo"]) / width)))
        return F.transform(F.col(values), one)

    return _bound(_bound(ordered, limits), scaled)


def finite(values: str) -> Column:
    """An array of numbers with 0 for null, NaN and infinite entries."""
    return F.transform(F.col(values), lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double")))


def centre_index(values: str) -> Column:
    """Median position (rounded down) of the non-zero entries of an array; its middle without any."""
    at = F.filter(F.transform(F.col(values), lambda x, i: F.when(x != 0, i)), lambda x: x.isNotNull())
    n = F.size(at)
    middle = (F.get(at, F.floor((n - 1) / 2).cast("int")) + F.get(at, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, F.floor(middle)).otherwise(F.floor(F.size(values) / 2)).cast("int")


def slice_positions(length: Column, centre: Column, k: int, stride: int = 1) -> Column:
    """k positions around a centre, stride apart, clipped to 0..length-1; an even k has one less to the
    left. There are never more positions than the length; without any there are none."""
    n = F.least(F.lit(k), length)
    left = F.when(n % 2 == 0, F.floor(n / 2) - 1).otherwise(F.floor(n / 2))
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.greatest(F.lit(0), F.least(length - 1, centre + (j - left) * stride)).cast("int"))
    return F.when(length > 0, at).otherwise(F.expr("cast(array() as array<int>)"))


def slice_stack(volume: np.ndarray, k: int, axis: int = 2, stride: int = 1, centre: int | None = None) -> np.ndarray:
    """k slices (at most all) of a volume around a centre (by default the median non-zero slice), first axis first."""
    n = volume.shape[axis]
    k = min(k, n)
    if centre is None:
        used = np.nonzero(volume)[axis]
        centre = int(np.median(used)) if len(used) else n // 2
    left = k // 2 - 1 if k % 2 == 0 else k // 2
    at = np.clip(centre + (np.arange(k) - left) * stride, 0, n - 1)
    return np.moveaxis(np.take(volume, at, axis), axis, 0)


def crop_or_pad(volume: np.ndarray, target: tuple[int, ...]) -> np.ndarray:
    """The centre of a volume in a target shape; what is missing is 0."""
    out = np.zeros(target, volume.dtype)
    source, into = [], []
    for have, want in zip(volume.shape, target, strict=True):
        n = min(have, want)
        source.append(slice((have - n) // 2, (have - n) // 2 + n))
        into.append(slice((want - n) // 2, (want - n) // 2 + n))
    out[tuple(into)] = volume[tuple(source)]
    return out


def to_uint8(image: np.ndarray) -> np.ndarray:
    """An image as RGB bytes: values within 0..1 times 255, others scaled from minimum and maximum.

    Bytes stay as they are; grey becomes three channels, a fourth channel goes.
    """
    x = np.asarray(image)
    if x.dtype != np.uint8:
        x = np.nan_to_num(x.astype(np.float32))
        lo, hi = (float(x.min()), float(x.max())) if x.size else (0.0, 1.0)
        x = x * 255 if lo >= 0 and hi <= 1 else (x - lo) / (hi - lo + 1e-6) * 255
        x = np.clip(x, 0, 255).astype(np.uint8)
    if x.ndim == 2 or x.shape[-1] == 1:
        return np.repeat(x.reshape(*x.shape[:2], 1), 3, axis=-1)
    return x[..., :3]


def _overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two images as RGB bytes, both cut to what they have in common from the top left corner."""
    x, y = to_uint8(a), to_uint8(b)
    rows, columns = np.minimum(x.shape[:2], y.shape[:2])
    return x[:rows, :columns], y[:rows, :columns]


def difference_tile(a: np.ndarray, b: np.ndarray, limit: float = 64.0) -> np.ndarray:
    """Signed difference of the first channels as RGB on white: red where a is brighter, blue where b is."""
    x, y = _overlap(a, b)
    d = np.clip((x[..., 0].astype(np.float32) - y[..., 0]) / np.float32(limit), -1, 1)
    fade, full = (255 * (1 - np.abs(d))).astype(np.uint8), np.full(d.shape, 255, np.uint8)
    return np.stack([np.where(d >= 0, full, fade), fade, np.where(d < 0, full, fade)], axis=-1)


def checkerboard_tile(a: np.ndarray, b: np.ndarray, tile: int = 16) -> np.ndarray:
    """Squares of two images in turn."""
    x, y = _overlap(a, b)
    rows, columns = np.indices(x.shape[:2]) // tile
    return np.where(((rows + columns) % 2 == 0)[..., None], x, y)


def fraction_index(fraction, length) -> Column:
    """round(fraction * (length - 1)), halves to even, within the slices."""
    return F.greatest(F.lit(0), F.least(length - 1, F.bround(fraction * (length - 1)))).cast("int")


def mosaic_tiles(image: np.ndarray, parts: int = 3) -> list[np.ndarray]:
    """A mosaic divided into equal tiles along its longer side (what remains goes), as RGB bytes."""
    x = to_uint8(image)
    axis = 1 if x.shape[1] >= x.shape[0] else 0
    size = x.shape[axis] // parts
    return [np.take(x, range(i * size, (i + 1) * size), axis) for i in range(parts)]


def mosaic_column(image: np.ndarray) -> np.ndarray:
    """The tiles of a mosaic below each other."""
    return np.concatenate(mosaic_tiles(image), axis=0)


def side_by_side(images: list[np.ndarray], fill: int = 0) -> np.ndarray:
    """Images in a row, padded at the bottom to the tallest."""
    tall = max(i.shape[0] for i in images)
    return np.concatenate([np.pad(i, [(0, tall - i.shape[0])] + [(0, 0)] * (i.ndim - 1), constant_values=fill) for i in images], axis=1)


def resampled(values: np.ndarray, affine: np.ndarray, to_affine: np.ndarray, to_shape: tuple[int, int, int], nearest: bool = False, fill: float = 0.0) -> np.ndarray:
    """A volume on another grid, by the world coordinates that affines of 4 x 4 give to voxel indices.

    Values between voxels are blended from the eight around them, of which those outside count
    as fill; nearest: the voxel that is nearest (the higher one of two) is taken as it is, so
    labels stay labels. Planes of the target are computed one after the other.
    """
    back = np.linalg.inv(affine) @ to_affine
    out = np.full(to_shape, fill, values.dtype if nearest else np.float64)
    j, k = np.meshgrid(np.arange(to_shape[1]), np.arange(to_shape[2]), indexing="ij")
    limits = np.array(values.shape[:3]).reshape(3, 1, 1)
    for i in range(to_shape[0]):
        at = np.tensordot(back[:3, :3], np.stack([np.full(j.shape, i), j, k]), 1) + back[:3, 3].reshape(3, 1, 1)
        at = np.round(at, 9)  # so that a voxel's own place is met exactly
        if nearest:
            near = np.floor(at + 0.5).astype(np.int64)
            inside = ((near >= 0) & (near < limits)).all(0)
            out[i][inside] = values[tuple(near[:, inside])]
            continue
        low = np.floor(at).astype(np.int64)
        part = at - low
        plane = np.zeros(j.shape)
        for corner in np.ndindex(2, 2, 2):
            step = np.array(corner).reshape(3, 1, 1)
            place, weight = low + step, np.where(step == 1, part, 1 - part).prod(0)
            inside = ((place >= 0) & (place < limits)).all(0)
            plane += weight * fill
            plane[inside] += weight[inside] * (values[tuple(place[:, inside])] - fill)
        out[i] = plane
    return out
