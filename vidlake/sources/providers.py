"""Pluggable encoders, matchers and impairments: what needs models or codecs stays behind these.

A provider turns frames into a table; the rest of the engine reads only tables.
Without its package or weights a provider raises ``ProviderUnavailable`` and
never invents output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalised
from .frames import stacks


class ProviderUnavailable(RuntimeError):
    pass


def blur_kernel(sigma: float) -> np.ndarray:
    """Normalised Gaussian taps for real-valued planes: 8 sigma wide, an odd count."""
    n = int(round(sigma * 8 + 1)) | 1
    taps = np.exp(-((np.arange(n) - n // 2) ** 2) / (2 * sigma * sigma))
    return taps / taps.sum()


def mirrored(n: int, radius: int) -> np.ndarray:
    """Indices -radius..n-1+radius, mirrored at the edges without repeating them."""
    at = np.abs(np.arange(-radius, n + radius)) % max(1, 2 * (n - 1))
    return np.minimum(at, 2 * (n - 1) - at) if n > 1 else np.zeros_like(at)


def high_pass_vector(plane: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """E7 on one plane: minus its Gaussian blur, mean removed, unit length."""
    taps = blur_kernel(sigma)
    r = len(taps) // 2
    soft = plane.astype(np.float64)
    for axis in (0, 1):
        padded = np.take(soft, mirrored(soft.shape[axis], r), axis=axis)
        soft = sum(t * np.take(padded, np.arange(k, k + soft.shape[axis]), axis=axis) for k, t in enumerate(taps))
    v = (plane - soft).ravel()
    v = v - v.mean()
    return v / max(np.linalg.norm(v), 1e-8)


def area_resize(plane: np.ndarray, size: int) -> np.ndarray:
    """Area averaging to size x size; fractional cell edges weigh by their overlap."""

    def weights(n: int) -> np.ndarray:
        edges = np.arange(size + 1) * n / size
        lo, hi = edges[:-1, None], edges[1:, None]
        cover = np.minimum(hi, np.arange(1, n + 1)) - np.maximum(lo, np.arange(n))
        return np.clip(cover, 0, None) / (hi - lo)

    return weights(plane.shape[0]) @ plane @ weights(plane.shape[1]).T


class Encoder:
    """Frames in bounded batches -> unit vectors. Subclasses give ``vectors`` of a (n, h, w) batch."""

    batch = 32
    name = "encoder"

    def vectors(self, planes: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def encode(self, frames: DataFrame) -> DataFrame:
        """(video_id, frame_no, embedding) of a frame table, in Arrow batches."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for part in (whole.slice(k, self.batch) for k in range(0, whole.num_rows, self.batch)):
                    rows = part.to_pylist()
                    out = [self.vectors(np.frombuffer(r["y"], np.uint8).reshape(1, r["height"], r["width"]))[0].astype(np.float32) for r in rows]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.list_(pa.float32()))], names=["video_id", "frame_no", "embedding"])

        return frames.select("video_id", "frame_no", "height", "width", "y").mapInArrow(run, "video_id string, frame_no int, embedding array<float>")


class PixelEncoder(Encoder):
    """High-pass luma; the one encoder that needs no weights."""

    def __init__(self, size: int = 64, sigma: float = 2.0):
        self.size, self.sigma, self.name = size, sigma, f"pixel_hp{size}"

    def vectors(self, planes: np.ndarray) -> np.ndarray:
        return np.stack([high_pass_vector(area_resize(p.astype(np.float64), self.size), self.sigma) for p in planes])


class _Remote(Encoder):
    def __init__(self, name: str):
        self.name = name

    def vectors(self, planes: np.ndarray) -> np.ndarray:
        raise ProviderUnavailable(f"{self.name} needs model weights, which are fetched over a network")


#: Encoders by name.
ENCODERS: dict[str, Callable[[], Encoder]] = {"pixel": PixelEncoder} | {n: (lambda n=n: _Remote(n)) for n in ("sscd", "sscd_large", "sscd_mixup", "dinov2", "dinov3", "clip", "siglip")}


def build_encoder(name: str) -> Encoder:
    if name not in ENCODERS:
        raise KeyError(f"unknown encoder {name!r}; have {sorted(ENCODERS)}")
    return ENCODERS[name]()


def tiled(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Region vectors (keys..., tile, embedding), each normalised, joined in tile order and normalised again."""
    unit = regions.select(*keys, F.struct("tile", l2_normalised(F.col("embedding")).alias("e")).alias("r"))
    joined = unit.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list("r")), lambda r: r.e)).alias("e"))
    return joined.select(*keys, l2_normalised(F.col("e")).alias("embedding"))


def area_mean(pixels: DataFrame, keys: list[str], factor: int) -> DataFrame:
    """Area resize by a whole factor: the mean of each factor x factor block."""
    at = [F.floor(F.col(k) / factor).cast("int").alias(k) for k in ("y", "x")]
    return pixels.groupBy(*keys, *at).agg(F.avg("v").alias("v"))


def channel_normalised(v: Column, mean: float, std: float) -> Column:
    """0..255 to a normalised channel."""
    return (v / 255.0 - mean) / std


def pooled(tokens: DataFrame, keys: list[str], how: str) -> DataFrame:
    """E5: token vectors (keys..., token, embedding), token 0 being the class token.

    cls: token 0; avg: mean of the others; cls_avg: both, each normalised, side by side.
    """
    if how not in ("cls", "avg", "cls_avg"):
        raise ValueError(f"unknown pooling {how!r}")
    cells = tokens.select(*keys, "token", F.posexplode("embedding").alias("i", "e"))
    per = cells.groupBy(*keys, "i").agg(F.max(F.when(F.col("token") == 0, F.col("e"))).cast("double").alias("c"), F.avg(F.when(F.col("token") > 0, F.col("e").cast("double"))).alias("a"))
    listed = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "c", "a"))).alias("s"))
    cls, avg = l2_normalised(F.transform("s", lambda s: s.c)), l2_normalised(F.transform("s", lambda s: s.a))
    out = {"cls": cls, "avg": avg, "cls_avg": l2_normalised(F.concat(cls, avg))}[how]
    return listed.select(*keys, out.alias("embedding"))


def high_pass(pixels: DataFrame, keys: list[str], side: int, sigma: float = 2.0) -> DataFrame:
    """E7 on long-form planes: (keys..., y, x, v) -> the same with v of a unit vector.

    The taps are a table of at most side * (8 sigma + 1) rows, joined by broadcast along each axis.
    """
    taps = blur_kernel(sigma)
    r = len(taps) // 2
    near = mirrored(side, r)
    table = [(i, int(near[i + k]), float(t)) for i in range(side) for k, t in enumerate(taps)]
    kernel = pixels.sparkSession.createDataFrame(table, "to int, at int, t double").groupBy("to", "at").agg(F.sum("t").alias("t"))
    across = pixels.join(F.broadcast(kernel), F.col("x") == F.col("at")).groupBy(*keys, "y", F.col("to").alias("x")).agg(F.sum(F.col("v") * F.col("t")).alias("v"))
    soft = across.join(F.broadcast(kernel), F.col("y") == F.col("at")).groupBy(*keys, F.col("to").alias("y"), "x").agg(F.sum(F.col("v") * F.col("t")).alias("soft"))
    high = pixels.join(soft, [*keys, "y", "x"]).select(*keys, "y", "x", (F.col("v") - F.col("soft")).alias("h"))
    plane = Window.partitionBy(*keys)
    centred = high.withColumn("h", F.col("h") - F.avg("h").over(plane))
    return centred.select(*keys, "y", "x", (F.col("h") / F.greatest(F.sqrt(F.sum(F.col("h") * F.col("h")).over(plane)), F.lit(1e-8))).alias("v"))


def high_pass_packed(frames: DataFrame, sigma: float = 2.0) -> DataFrame:
    """E7 from packed planes (frame_no, height, width, y): the rows of ``high_pass``, made from whole planes, none of them shuffled."""

    def blur(n: int) -> np.ndarray:
        taps = blur_kernel(sigma)
        near, turn = mirrored(n, len(taps) // 2), np.zeros((n, n))
        for k, t in enumerate(taps):
            np.add.at(turn, (np.arange(n), near[k : k + n]), t)
        return turn

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for planes in stacks(batch):
                count, (height, width) = len(planes), planes.shape[1:]
                plane = planes.astype(np.float64)
                high = (plane - blur(height) @ plane @ blur(width).T).reshape(count, -1)
                high -= high.mean(1, keepdims=True)
                high /= np.maximum(np.linalg.norm(high, axis=1, keepdims=True), 1e-8)
                at = np.tile(np.arange(height * width, dtype=np.int32), count)
                number = batch.column("frame_no").take(pa.array(np.repeat(np.arange(first, first + count), height * width)))
                first += count
                yield pa.RecordBatch.from_arrays([number, pa.array(at // max(1, width)), pa.array(at % max(1, width)), pa.array(high.ravel())], names=["frame_no", "y", "x", "v"])

    kind = frames.schema["frame_no"].dataType.simpleString()
    return frames.where("y is not null").select("frame_no", "height", "width", "y").mapInArrow(run, f"frame_no {kind}, y int, x int, v double")


def quantised(pixels: DataFrame, step: int = 4) -> DataFrame:
    """A deterministic stand-in impairment: luma rounded down to steps. Real codecs are external tools."""
    return pixels.withColumn("v", F.floor(F.col("v") / step) * float(step))
