"""The blur read-out of planes that a fitted projection brings back to their source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.frames import stacks
from .imaging import warp_patches
from .transforms import basis

IDENTITY = np.eye(3)


#: Cells of a plane that are read at once.
CELLS = 256


def cliff_of(patches: np.ndarray, radius: float, band: float) -> np.ndarray:
    """C17 of square patches: mean energy of the ring inside the radius over that of the ring outside."""
    side = patches.shape[-1]
    turn = basis(side)
    energy = (turn @ patches @ turn.T) ** 2
    far = np.hypot(*np.mgrid[0:side, 0:side])
    inner, outer = energy[..., (far >= radius - band) & (far < radius)], energy[..., (far >= radius) & (far < radius + band)]
    return inner.mean(-1) / (outer.mean(-1) + 1e-9)


def aligned_cells(frames: DataFrame, keys: list[str], side: int, radius: float, band: float) -> DataFrame:
    """Scores of the source's grid cells, read through each frame's projection: (keys..., y0, y1, x0, x1, aligned, score).

    ``frames`` has (keys..., src_height, src_width, height, width, y, homography): an impaired plane, its source's size
    and the projection from source to impaired (nine values row by row), as ``homography.validated`` leaves it. Where it is null (the fit
    was rejected) the identity is used and ``aligned`` is false. A cell that the projection takes out of the impaired plane gives no row; a null plane none.
    """
    names = [*keys, "y0", "y1", "x0", "x1", "aligned", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 32) for k in range(0, whole.num_rows, 32)):
                frame, aligned, places, scores = [], [], [np.zeros((0, 2))], [np.zeros(0)]
                for i, r in enumerate(batch.to_pylist()):
                    through = IDENTITY if r["homography"] is None else np.array(r["homography"]).reshape(3, 3)
                    plane = np.frombuffer(r["y"], np.uint8).reshape(r["height"], r["width"])
                    spots = np.array([(x, y) for y in range(0, r["src_height"] - side + 1, side) for x in range(0, r["src_width"] - side + 1, side)], float).reshape(-1, 2)
                    for some in (spots[k : k + CELLS] for k in range(0, len(spots), CELLS)):
                        stays, read = warp_patches(plane, some, through, side)
                        places.append(some[stays])
                        scores.append(cliff_of(read.astype(np.float64), radius, band))
                        frame += [i] * len(read)
                        aligned += [r["homography"] is not None] * len(read)
                x, y = np.concatenate(places).astype(np.int32).T
                rest = [pa.array(v, pa.int32()) for v in (y, y + side, x, x + side)] + [pa.array(aligned, pa.bool_()), pa.array(np.concatenate(scores))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(frame, pa.int32())) for k in keys), *rest], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.select(*keys).schema)
    rows = frames.where("y is not null").select(*keys, "src_height", "src_width", "height", "width", "y", "homography")
    return rows.mapInArrow(run, f"{fields}, y0 int, y1 int, x0 int, x1 int, aligned boolean, score double")


def softened_cells(frames: DataFrame, side: int, radius: float, band: float) -> DataFrame:
    """C15 and C17 from packed planes: (frame_no, by_, bx, score) of every grid cell, no row a pixel or a coefficient.

    ``frames`` has (frame_no, height, width, y, soft_by, soft_bx); the cell (soft_by, soft_bx) is scored without its coefficients beyond
    the radius. Coefficients are rounded to six places, halves away from zero; what a cell lacks at the edges is 0.
    """
    turn = basis(side)
    u, w = np.mgrid[0:side, 0:side]
    far = np.sqrt(u * u + w * w)
    kept, inner, outer = far <= radius, (far >= radius - band) & (far < radius), (far >= radius) & (far < radius + band)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for planes in stacks(batch):
                count, (height, width) = len(planes), planes.shape[1:]
                whole = np.pad(planes, ((0, 0), (0, -height % side), (0, -width % side))).astype(np.float64)
                h, w = whole.shape[1] // side, whole.shape[2] // side
                spectra = turn @ whole.reshape(count, h, side, w, side).swapaxes(2, 3) @ turn.T
                at, row, col = (k.ravel() for k in np.mgrid[first : first + count, 0:h, 0:w])
                soft = [batch.column(c).take(pa.array(at)).to_numpy(zero_copy_only=False) for c in ("soft_by", "soft_bx")]
                spectra = spectra.reshape(-1, side, side)
                spectra[(soft[0] == row) & (soft[1] == col)] *= kept
                energy = (np.sign(spectra) * np.floor(np.abs(spectra) * 1e6 + 0.5) / 1e6) ** 2
                score = energy[:, inner].mean(1) / (energy[:, outer].mean(1) + 1e-9)
                first += count
                yield pa.RecordBatch.from_arrays([batch.column("frame_no").take(pa.array(at)), pa.array(row, pa.int64()), pa.array(col, pa.int64()), pa.array(score)], names=["frame_no", "by_", "bx", "score"])

    kind = frames.schema["frame_no"].dataType.simpleString()
    rows = frames.where("y is not null").select("frame_no", "height", "width", "y", "soft_by", "soft_bx")
    return rows.mapInArrow(run, f"frame_no {kind}, by_ long, bx long, score double")
