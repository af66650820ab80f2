"""Fitting a plane projection to matched points by random sample consensus (V1, V4, V5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points that fix a projection, matches that a model needs, pixels within which a match agrees.
LEAST, ENOUGH, REACH = 4, 10, 5.0
ROUNDS, SURE = 2000, 0.995
#: Fixed values of V6: inliers that a valid model has at least, and their greatest mean error in pixels.
MIN_INLIERS, MAX_ERROR = 20, 5.0


def _scaled(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved to mean 0 and mean distance sqrt(2), and the matrix that does it."""
    centre = points.mean(axis=0)
    size = np.sqrt(2) / max(np.linalg.norm(points - centre, axis=1).mean(), 1e-12)
    return (points - centre) * size, np.array([[size, 0, -size * centre[0]], [0, size, -size * centre[1]], [0, 0, 1]])


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The least-squares projection of points ``a`` to ``b`` (direct linear transform), or None.

    It is the least eigenvector of a 9 x 9 matrix, however many points there are.
    """
    (p, s), (q, t) = _scaled(a), _scaled(b)
    one, zero = np.ones(len(p)), np.zeros((len(p), 3))
    near = np.column_stack([p, one])
    rows = np.concatenate([np.hstack([near, zero, -q[:, :1] * near]), np.hstack([zero, near, -q[:, 1:] * near])])
    h = np.linalg.inv(t) @ np.linalg.eigh(rows.T @ rows)[1][:, 0].reshape(3, 3) @ s
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 and np.isfinite(h).all() else None


def errors(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each projected point from its partner; infinite behind the plane."""
    at = np.column_stack([a, np.ones(len(a))]) @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        found = np.linalg.norm(at[:, :2] / at[:, 2:] - b, axis=1)
    return np.where(np.isfinite(found), found, np.inf)


def fit(a: np.ndarray, b: np.ndarray, reach: float = REACH, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """(projection or None, inliers). Samples of four points until a better model is unlikely; refitted on its inliers."""
    n, none = len(a), np.zeros(len(a), bool)
    if n < LEAST:
        return None, none
    draw = np.random.default_rng(seed)
    best, held = None, none
    needed, k = ROUNDS, 0
    while k < needed:
        k += 1
        four = draw.choice(n, LEAST, replace=False)
        h = solve(a[four], b[four])
        inside = errors(h, a, b) <= reach if h is not None else none
        if inside.sum() > max(held.sum(), LEAST - 1):
            best, held = h, inside
            share = min(held.mean() ** LEAST, 1 - 1e-12)
            needed = min(ROUNDS, int(np.ceil(np.log(1 - SURE) / np.log(1 - share))))
    for _ in range(3):
        again = solve(a[held], b[held]) if held.sum() >= LEAST else None
        inside = errors(again, a, b) <= reach if again is not None else none
        if inside.sum() < held.sum():
            break
        best, held = again, inside
    return best, held


def validated(found: DataFrame, min_inliers: int = MIN_INLIERS, max_error: float = MAX_ERROR) -> DataFrame:
    """V5 as a whole: ``fitted`` with ``valid`` (V6), and no projection where it is not.

    A model stands with enough inliers whose mean error is under the limit.
    """
    mean = F.aggregate("inlier_errs", F.lit(0.0), lambda s, x: s + x) / F.size("inlier_errs")
    valid = F.coalesce(F.col("homography_ok") & (F.col("num_inliers") >= min_inliers) & (mean < max_error), F.lit(False))
    return found.withColumn("valid", valid).withColumn("homography", F.when(F.col("valid"), F.col("homography")))


def fitted(matches: DataFrame, keys: list[str], enough: int = ENOUGH) -> DataFrame:
    """V5: ``keys``, num_matches, num_inliers, inlier_errs, homography_ok and homography (row by row) of each group of
    matched points (x0, y0, x1, y1).

    Fewer than ``enough`` matches, or no model, give no inliers. A group is the matches of one pair of frames.
    """
    fields = [f for f in matches.select(*keys).schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("x0", "y0", "x1", "y1")])
        x0, y0, x1, y1 = (table[c].to_numpy().astype(float) for c in ("x0", "y0", "x1", "y1"))
        a, b = np.column_stack([x0, y0]), np.column_stack([x1, y1])
        h, inside = fit(a, b) if len(a) >= enough else (None, np.zeros(len(a), bool))
        errs = errors(h, a, b)[inside].tolist() if h is not None else []
        out = {k: [table[k][0].as_py()] for k in keys}
        out |= {"num_matches": [len(a)], "num_inliers": [len(errs)], "inlier_errs": [errs], "homography_ok": [h is not None], "homography": [h.ravel().tolist() if h is not None else None]}
        kinds = [table.schema.field(k).type for k in keys] + [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.bool_(), pa.list_(pa.float64())]
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return matches.select(*keys, "x0", "y0", "x1", "y1").groupBy(*keys).applyInArrow(run, f"{schema}, num_matches int, num_inliers int, inlier_errs array<double>, homography_ok boolean, homography array<double>")
