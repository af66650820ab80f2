"""The pixelation detector over packed planes: all five statistics in one pass.

A plane is one byte a pixel, row by row. Profiles are means along an axis,
spectra are real FFTs; the result equals ``pixels.detect`` on the same
planes in long form, without a shuffle or a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.frames import stacks
from .pixels import EPS, FLAT, RAMPS, WEIGHTS

NAMES = ["gradient", "variance", "laplacian", "fft", "neighbor"]
RAW = ["gradient_ratio", "variance_ratio", "laplacian_ratio", "fft_peak", "neighbor_excess"]


def ramp(values: np.ndarray, low: float, high: float) -> np.ndarray:
    return 0.0 * values if high == low else np.clip((values - low) / (high - low), 0.0, 1.0)


def boundary(profiles: np.ndarray, n: int) -> np.ndarray:
    """P5-P6 of (plane, offset): the fold's last phase over the mean of the others."""
    periods = profiles.shape[1] // n
    if n < 2 or periods < 1:
        return np.ones(len(profiles))
    phases = profiles[:, : periods * n].reshape(-1, periods, n).mean(1)
    return phases[:, -1] / (phases[:, :-1].mean(1) + EPS)


def spread(planes: np.ndarray, n: int) -> np.ndarray | None:
    """Mean population variance of whole n x n blocks; none if there is no block."""
    h, w = (k // n for k in planes.shape[1:])
    return planes[:, : h * n, : w * n].reshape(-1, h, n, w, n).var((2, 4)).mean((1, 2)) if h and w else None


def prominence(profiles: np.ndarray, n: int) -> np.ndarray | None:
    """The grid's bin over the median of the bins near it."""
    size = profiles.shape[1]
    if size < 2 * n:
        return None
    m = np.abs(np.fft.rfft(profiles - profiles.mean(1, keepdims=True)))
    at = min(round(size / n), size // 2)
    width = max(8, at // 8)
    near = np.concatenate([m[:, max(1, at - width) : max(1, at - 1)], m[:, at + 2 : at + width + 1]], 1)
    return m[:, at] / (np.median(near, 1) + EPS) if near.shape[1] else None


def mean_of(values: list) -> np.ndarray | None:
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def measures(planes: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """The five raw statistics and their scores of planes of one size (plane, y, x)."""
    same = np.ones(len(planes))
    dx, dy = np.abs(np.diff(planes, axis=2)), np.abs(np.diff(planes, axis=1))
    profiles = [dx.mean(1), dy.mean(2)]
    fine, coarse = spread(planes, n), spread(planes, 2 * n)
    framed = np.pad(planes, ((0, 0), (1, 1), (1, 1)), mode="reflect")
    around = framed[:, :-2, :-2] + framed[:, :-2, 2:] + framed[:, 2:, :-2] + framed[:, 2:, 2:]
    lap = np.abs(2 * around - 8 * planes)
    inside, edge = [], []
    for d, axis in ((dx, 1), (dy, 2)):
        flat = (d < FLAT).mean(axis)
        last = np.arange(flat.shape[1]) % n == n - 1
        edge.append(flat[:, last].mean(1) if last.any() else None)
        inside.append(flat[:, ~last].mean(1) if (~last).any() else None)
    held, gone = mean_of(inside), mean_of(edge)
    peak = mean_of([prominence(p, n) for p in profiles])
    both = fine is not None and coarse is not None and n >= 2
    raw = {
        "gradient_ratio": 0.5 * sum(boundary(p, n) for p in profiles),
        "variance_ratio": fine / (coarse + EPS) if both else same,
        "laplacian_ratio": 0.5 * (boundary(lap.mean(1), n) + boundary(lap.mean(2), n)),
        "fft_peak": np.where(peak == 0, 1.0, peak) if peak is not None else same,
        "neighbor_excess": held - gone if held is not None and gone is not None else 0.0 * same,
    }
    scores = {name: ramp(raw[r], *RAMPS[name]) for name, r in zip(NAMES, RAW, strict=True)}
    if not both:
        scores["variance"] = 0.0 * same
    return {**raw, **scores}


def profiles_packed(planes: DataFrame, keys: list[str]) -> DataFrame:
    """P4 of packed planes (height, width, y): (keys..., axis, profile), the mean gradient at each offset of an axis as one array.

    An axis without neighbours, and a null plane, give no row.
    """
    schema = planes.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for planes in stacks(batch):
                held = batch.slice(first, len(planes))
                first += len(planes)
                planes = planes.astype(np.int16)
                for axis, along, over in (("col", 2, 1), ("row", 1, 2)):
                    if planes.shape[along] < 2 or not planes.shape[over]:
                        continue
                    found = np.abs(np.diff(planes, axis=along)).mean(over)
                    ends = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([*(held.column(k) for k in keys), pa.array([axis] * len(found)), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], names=[*keys, "axis", "profile"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", axis string, profile array<double>"
    return planes.where("y is not null").select(*keys, "height", "width", "y").mapInArrow(run, out)


def detect_packed(planes: DataFrame, keys: list[str], n: int, weights: dict[str, float] | None = None) -> DataFrame:
    """(keys..., five scores, confidence, five raw statistics) of each plane (height, width, y) at period n.

    A plane of one row or column is too small to tell: every statistic is
    neutral and the confidence 0. A null plane gives no row.
    """
    weights = WEIGHTS if weights is None else weights
    total = sum(weights.get(k, 0.0) for k in NAMES)
    schema = planes.select(*keys).schema
    columns = [*NAMES, "confidence", *RAW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for planes in stacks(batch):
                planes = planes.astype(np.float64)
                m = measures(planes, n) if min(planes.shape[1:]) > 1 else {**dict.fromkeys(NAMES, 0.0), "gradient_ratio": 1.0, "variance_ratio": 1.0, "laplacian_ratio": 1.0, "fft_peak": 1.0, "neighbor_excess": 0.0}
                mean = sum(m[k] * weights.get(k, 0.0) for k in NAMES) / total if total else 0.0
                parts.append(np.stack([np.broadcast_to(v, len(planes)) for v in (*(m[k] for k in NAMES), np.clip(mean, 0.0, 1.0), *(m[k] for k in RAW))]))
            found = np.concatenate(parts, 1) if parts else np.empty((len(columns), 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(f, pa.float64()) for f in found)], names=[*keys, *columns])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", " + ", ".join(f"{c} double" for c in columns)
    return planes.where("y is not null").select(*keys, "height", "width", "y").mapInArrow(run, out)
