"""Scale-space keypoints of packed planes and their matches between frames (K3, V1).

A frame is a task's unit: its pyramid of Gaussian differences, the extrema of it
that pass the contrast and edge tests, their orientations and descriptors come
out of one Arrow pass without a shuffle. Ordering, spreading and selection of
keypoints, and which frames meet which, are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.providers import mirrored

#: Fixed values of the published method: base blur, intervals an octave, contrast, edge ratio, blur of a camera's plane.
SIGMA, INTERVALS, CONTRAST, EDGE, CAMERA = 1.6, 3, 0.04, 10.0, 0.5
#: Octaves end below this side; decimals at which differences are compared; rounds of refinement; least ratio of match distances.
LEAST, DECIMALS, ROUNDS, RATIO = 16, 6, 5, 0.8
FLOOR = 0.5 * CONTRAST / INTERVALS * 255
COLUMNS = "kp_id long, x double, y double, size double, angle double, response double, octave int, descriptor array<float>"


def taps(sigma: float) -> np.ndarray:
    """Gaussian weights out to four sigma, adding up to 1."""
    reach = int(np.ceil(4 * sigma))
    w = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma)) if sigma > 0 else np.ones(1)
    return w / w.sum()


def smooth(plane: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur; beyond an edge the plane is mirrored without repeating the edge."""
    w = taps(sigma)
    reach = len(w) // 2
    for axis in (0, 1):
        n = plane.shape[axis]
        framed = plane.take(mirrored(n, reach), axis)
        plane = sum(t * (framed[k : k + n] if axis == 0 else framed[:, k : k + n]) for k, t in enumerate(w))
    return plane


def layers(base: np.ndarray, held: float) -> np.ndarray:
    """An octave's Gaussian layers from its base, which already holds a blur of ``held``."""
    return np.stack([smooth(base, max(0.0, (SIGMA * 2 ** (i / INTERVALS)) ** 2 - held * held) ** 0.5) for i in range(INTERVALS + 3)])


def around(values: np.ndarray, best: np.ufunc) -> np.ndarray:
    """Largest or least of the 27 values around each inner cell."""
    for axis in range(3):
        n = values.shape[axis]
        values = best.reduce([np.take(values, range(k, n - 2 + k), axis) for k in range(3)])
    return values


def extrema(dogs: np.ndarray) -> np.ndarray:
    """(layer, y, x) of cells beyond the floor that no neighbour in place or scale exceeds; cells that tie all count."""
    d = dogs.round(DECIMALS)
    inner = d[1:-1, 1:-1, 1:-1]
    high = (inner > FLOOR) & (inner >= around(d, np.maximum))
    low = (inner < -FLOOR) & (inner <= around(d, np.minimum))
    return np.argwhere(high | low) + 1


def slopes(dogs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivatives of the differences at (layer, y, x), by central differences."""
    step = np.eye(3, dtype=int)
    pick = lambda p: dogs[tuple(p.T)]
    g = np.stack([(pick(at + s) - pick(at - s)) / 2 for s in step], 1)
    h = np.empty((len(at), 3, 3))
    for i, a in enumerate(step):
        h[:, i, i] = pick(at + a) + pick(at - a) - 2 * pick(at)
        for j, b in enumerate(step[:i]):
            h[:, i, j] = h[:, j, i] = (pick(at + a + b) + pick(at - a - b) - pick(at + a - b) - pick(at - a + b)) / 4
    return g, h


def refined(dogs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells where the fitted quadric settles, their offsets and values; low contrast, edges and strays are gone."""
    settled, offsets, values = [np.empty((0, 3), int)], [np.empty((0, 3))], [np.empty(0)]
    last = np.array(dogs.shape) - 2
    for _ in range(ROUNDS):
        if not len(at):
            break
        g, h = slopes(dogs, at)
        firm = np.abs(np.linalg.det(h)) > 1e-9
        at, g, h = at[firm], g[firm], h[firm]
        off = -np.linalg.solve(h, g[..., None])[..., 0]
        still = (np.abs(off) < 0.5).all(1)
        value = dogs[tuple(at.T)] + 0.5 * (g * off).sum(1)
        trace, det = h[:, 1, 1] + h[:, 2, 2], h[:, 1, 1] * h[:, 2, 2] - h[:, 1, 2] ** 2
        good = still & (np.abs(value) * INTERVALS >= CONTRAST * 255) & (det > 0) & (trace * trace * EDGE < (EDGE + 1) ** 2 * det)
        settled.append(at[good]), offsets.append(off[good]), values.append(value[good])
        moved = at[~still] + np.clip(np.rint(off[~still]), -99, 99).astype(int)
        at = np.unique(moved[((moved >= 1) & (moved <= last)).all(1)], axis=0)
    cells, first = np.unique(np.concatenate(settled), axis=0, return_index=True)
    return cells, np.concatenate(offsets)[first], np.concatenate(values)[first]


def window(y: float, x: float, reach: int, shape: tuple[int, int]) -> tuple[slice, slice]:
    """Rows and columns of a plane's inner pixels within ``reach`` of the pixel nearest to a point."""
    cy, cx = round(y), round(x)
    return slice(max(1, cy - reach), max(1, min(shape[0] - 1, cy + reach + 1))), slice(max(1, cx - reach), max(1, min(shape[1] - 1, cx + reach + 1)))


def gradients(layer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and direction in degrees of each inner pixel's gradient; made once a layer, as its keypoints' windows overlap."""
    size, turn = np.zeros(layer.shape), np.zeros(layer.shape)
    dy, dx = layer[2:, 1:-1] - layer[:-2, 1:-1], layer[1:-1, 2:] - layer[1:-1, :-2]
    size[1:-1, 1:-1], turn[1:-1, 1:-1] = np.hypot(dy, dx), np.degrees(np.arctan2(dy, dx))
    return size, turn


def directions(slopes: tuple[np.ndarray, np.ndarray], y: float, x: float, scale: float) -> list[float]:
    """Angles in degrees at which the weighted histogram of gradients peaks, at least 0.8 of the highest."""
    size, turn = slopes
    ys, xs = window(y, x, round(4.5 * scale), size.shape)
    dy, dx = np.arange(ys.start, ys.stop)[:, None] - y, np.arange(xs.start, xs.stop) - x
    near = np.exp(-(dy**2 + dx**2) / (2 * (1.5 * scale) ** 2))
    bins = np.rint(turn[ys, xs] / 10).astype(int) % 36
    h = np.bincount(bins.ravel(), (size[ys, xs] * near).ravel(), 36)
    h = (6 * h + 4 * (np.roll(h, 1) + np.roll(h, -1)) + np.roll(h, 2) + np.roll(h, -2)) / 16
    left, right = np.roll(h, 1), np.roll(h, -1)
    peaks = np.flatnonzero((h > left) & (h > right) & (h >= 0.8 * h.max()))
    return [float((k + 0.5 * (left[k] - right[k]) / (left[k] - 2 * h[k] + right[k])) * 10 % 360) for k in peaks]


def described(slopes: tuple[np.ndarray, np.ndarray], y: float, x: float, scale: float, angle: float) -> np.ndarray:
    """128 values: 4 x 4 cells of 8 directions relative to the keypoint's own, shared out linearly, of length 1."""
    size, turn = slopes
    cell = 3 * scale
    ys, xs = window(y, x, round(cell * 2.5 * 2**0.5), size.shape)
    dy, dx = np.arange(ys.start, ys.stop)[:, None] - y, np.arange(xs.start, xs.stop) - x
    c, s = np.cos(np.radians(angle)) / cell, np.sin(np.radians(angle)) / cell
    across, down = dx * c + dy * s, dy * c - dx * s
    # only pixels less than a cell from the 4 x 4 have a share
    held = (np.abs(across) < 2.5) & (np.abs(down) < 2.5)
    across, down = across[held], down[held]
    weight = size[ys, xs][held] * np.exp(-(across**2 + down**2) / 8)
    spot = np.stack([down + 1.5, across + 1.5, (turn[ys, xs][held] - angle) / 45])
    low = np.floor(spot)
    part = spot - low
    r, k, o = low.astype(int)
    share, at = (1 - part, part), []
    # a frame of cells around the 4 x 4 takes what falls outside
    for i, j, t in np.ndindex(2, 2, 2):
        at.append((((r + (i + 1)) * 6 + (k + (j + 1))) * 8 + (o + t) % 8, weight * (share[i][0] * share[j][1] * share[t][2])))
    out = np.bincount(np.concatenate([a for a, _ in at]), np.concatenate([w for _, w in at]), 288).reshape(6, 6, 8)[1:5, 1:5]
    flat = out.ravel() / max(np.linalg.norm(out), 1e-12)
    flat = np.minimum(flat, 0.2)
    return flat / max(np.linalg.norm(flat), 1e-12)


def found_in(plane: np.ndarray, describe: bool = True) -> list[tuple]:
    """Every keypoint of a plane: x, y, size, angle, response, octave, descriptor; octaves, then layers, rows and columns ascend.

    A descriptor takes longer than all the rest of a keypoint: without ``describe`` it is None.
    """
    out, held, octave = [], CAMERA, 0
    while min(plane.shape) >= LEAST:
        gauss = layers(plane, held)
        dogs = np.diff(gauss, axis=0)
        cells, offsets, values = refined(dogs, extrema(dogs))
        seen = {layer: gradients(gauss[layer]) for layer in set(cells[:, 0].tolist())}
        for (layer, y, x), (ds, dy, dx), value in zip(cells.tolist(), offsets.tolist(), values.tolist(), strict=True):
            scale = SIGMA * 2 ** ((layer + ds) / INTERVALS)
            for angle in directions(seen[layer], y + dy, x + dx, scale):
                d = described(seen[layer], y + dy, x + dx, scale, angle).astype(np.float32) if describe else None
                out.append(((x + dx) * 2**octave, (y + dy) * 2**octave, 2 * scale * 2**octave, angle, abs(value), octave, d))
        plane, held, octave = gauss[INTERVALS][::2, ::2], SIGMA, octave + 1
    return out


def _planes(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for i in range(batch.num_rows):
        h, w = batch.column("height")[i].as_py(), batch.column("width")[i].as_py()
        yield i, np.frombuffer(batch.column("y")[i].as_buffer(), np.uint8).reshape(h, w).astype(np.float64)


def _keyed(planes: DataFrame, keys: list[str], rest: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in planes.select(*keys).schema) + ", " + rest


def keypoints(planes: DataFrame, keys: list[str], describe: bool = True) -> DataFrame:
    """K3: a row for each keypoint of each plane (keys..., height, width, y: one byte a pixel).

    kp_id numbers a plane's keypoints from 0 by octave, layer, row, column and direction.
    ``size`` is a diameter in the plane's pixels, ``angle`` in degrees from the x axis towards larger y, ``response`` the
    refined difference. Without ``describe`` there is no descriptor column. A flat, null or tiny plane (a side under 16) has none. Equal planes have equal keypoints.
    """
    columns = COLUMNS if describe else COLUMNS.rsplit(", ", 1)[0]
    names = [*keys, *(c.split()[0] for c in columns.split(", "))]
    types = [pa.int64(), *[pa.float64()] * 5, pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, plane in _planes(batch):
                rows = [(n, *r) for n, r in enumerate(found_in(plane, describe))]
                own = [pa.repeat(batch.column(k)[i], len(rows)) for k in keys]
                plain = [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
                vectors = [pa.array([r[-1] for r in rows], pa.list_(pa.float32()))] if describe else []
                yield pa.RecordBatch.from_arrays([*own, *plain, *vectors], names=names)

    return planes.where("y is not null").select(*keys, "height", "width", "y").mapInArrow(run, _keyed(planes, keys, columns))


def scale_extrema(planes: DataFrame, keys: list[str]) -> DataFrame:
    """Extrema of the first octave before any refinement: (keys..., layer, y, x, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, plane in _planes(batch):
                dogs = np.diff(layers(plane, CAMERA), axis=0)
                at = extrema(dogs)
                own = [pa.repeat(batch.column(k)[i], len(at)) for k in keys]
                cells = [pa.array(at[:, c], pa.int32()) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*own, *cells, pa.array(dogs[tuple(at.T)])], names=[*keys, "layer", "y", "x", "value"])

    rows = planes.where("y is not null").select(*keys, "height", "width", F.col("y"))
    return rows.mapInArrow(run, _keyed(planes, keys, "layer int, y int, x int, value double"))


def mutual(a: np.ndarray, b: np.ndarray, ratio: float) -> np.ndarray:
    """Rows (i, j) that are each other's nearest, with i's nearest under ``ratio`` of its second nearest distance."""
    if not len(a) or not len(b):
        return np.empty((0, 2), int)
    gaps = np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))
    best = gaps.argmin(1)
    i = np.arange(len(a))
    first = gaps[i, best]
    gaps_but = gaps.copy()
    gaps_but[i, best] = np.inf
    clear = first < ratio * gaps_but.min(1)
    kept = clear & (gaps.argmin(0)[best] == i)
    return np.stack([i[kept], best[kept]], 1)


def matches(pairs: DataFrame, left: DataFrame, right: DataFrame, ratio: float = RATIO) -> DataFrame:
    """V1: matched points of frame pairs: (pair_id, x0, y0, x1, y1, n_kpts0, n_kpts1), one row a match.

    ``pairs`` has (pair_id, frame0, frame1), a shortlist; ``left`` and ``right`` are keypoints with frame_no, x, y, kp_id and
    descriptor. Each frame's keypoints become one row of arrays, bounded by its plane, which two equi-joins bring to
    the pairs; a pair is one matrix product. A frame without keypoints has no match and gives no row.
    """

    def packed(side: DataFrame, n: int) -> DataFrame:
        point = F.array_sort(F.collect_list(F.struct("kp_id", "x", "y", "descriptor")))
        return side.groupBy(F.col("frame_no").alias(f"frame{n}")).agg(point.alias("_k")).select(f"frame{n}", *[F.col(f"_k.{c}").alias(f"{c}{n}") for c in ("x", "y", "descriptor")])

    both = pairs.select("pair_id", "frame0", "frame1").join(packed(left, 0).hint("merge"), "frame0").join(packed(right, 1).hint("merge"), "frame1").drop("frame0", "frame1")
    names = ["pair_id", "x0", "y0", "x1", "y1", "n_kpts0", "n_kpts1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda c: batch.column(c)[i].values  # noqa: B023, E731
                a, b = (value(f"descriptor{n}").flatten().to_numpy().reshape(-1, 128).astype(np.float64) for n in (0, 1))
                hit = mutual(a, b, ratio)
                at = [value(c).take(pa.array(hit[:, n])) for c, n in (("x0", 0), ("y0", 0), ("x1", 1), ("y1", 1))]
                sizes = [pa.array(np.full(len(hit), len(d), np.int32)) for d in (a, b)]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column("pair_id")[i], len(hit)), *at, *sizes], names=names)

    return both.mapInArrow(run, _keyed(pairs, ["pair_id"], "x0 double, y0 double, x1 double, y1 double, n_kpts0 int, n_kpts1 int"))
