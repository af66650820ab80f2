"""Frame tables: strided scans, metadata, colour transform, paired scans, long-form planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pixels of the planes that are worked on at once.
PIXELS = 1 << 18

FRAMES = T.StructType([T.StructField(n, k) for n, k in (("video_id", T.StringType()), ("frame_no", T.IntegerType()), ("height", T.IntegerType()), ("width", T.IntegerType()), ("y", T.BinaryType()), ("u", T.BinaryType()), ("v", T.BinaryType()))])


def load_frames(frames: DataFrame, stride: int = 1, max_frames: int | None = None) -> DataFrame:
    """Every ``stride``-th frame under its original number, at most ``max_frames`` (a documented limit)."""
    if stride < 1:
        raise ValueError("stride must be at least 1")
    kept = frames.where(F.pmod("frame_no", F.lit(stride)) == 0)
    return kept if max_frames is None else kept.orderBy("frame_no").limit(max_frames)


def videos(frames: DataFrame) -> DataFrame:
    """Frame count and size of every video."""
    return frames.groupBy("video_id").agg(F.count("*").alias("frame_count"), F.max("width").alias("width"), F.max("height").alias("height"))


def open_videos(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of video files as binary rows; decoding is a provider's business."""
    return spark.read.format("binaryFile").load(path)


def to_yuv(b: Column, g: Column, r: Column) -> list[Column]:
    """S3: 8-bit BGR to YUV by the BT.601 difference form, rounded and clipped (Y, U, V)."""
    y = 0.299 * r + 0.587 * g + 0.114 * b
    byte = lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.bround(v, 0))).cast("int")
    return [byte(y), byte(0.492 * (b - y) + 128), byte(0.877 * (r - y) + 128)]


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two captures in step; the shorter one ends the scan. Both have (frame_no, y, x, v)."""
    left = a.select("frame_no", "y", "x", F.col("v").alias("src"))
    return left.join(b.select("frame_no", "y", "x", F.col("v").alias("imp")).hint("merge"), ["frame_no", "y", "x"])


def planes(spark: SparkSession, frames: int, height: int, width: int) -> DataFrame:
    """Generated planes: v = (7x + 13y + 31 frame + xy) mod 256; the row count is the plane volume."""
    cells = spark.range(frames * height * width)
    at = {"frame_no": F.floor(F.col("id") / (height * width)), "y": F.pmod(F.floor(F.col("id") / width), F.lit(height)), "x": F.pmod("id", F.lit(width))}
    rows = cells.select(*[v.cast("int").alias(k) for k, v in at.items()])
    return rows.withColumn("v", F.pmod(F.col("x") * 7 + F.col("y") * 13 + F.col("frame_no") * 31 + F.col("x") * F.col("y"), F.lit(256)).cast("double"))


def stacks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Packed planes (height, width, y) in their order, as bytes (plane, y, x): neighbours of one size together, up to ``PIXELS``."""
    heights, widths, planes = (batch.column(c) for c in ("height", "width", "y"))
    sizes = list(zip(heights.to_pylist(), widths.to_pylist(), strict=True))
    first = 0
    while first < len(sizes):
        height, width = sizes[first]
        last, most = first + 1, first + max(1, PIXELS // max(1, height * width))
        while last < min(len(sizes), most) and sizes[last] == sizes[first]:
            last += 1
        yield np.frombuffer(b"".join(planes.slice(first, last - first).to_pylist()), np.uint8).reshape(last - first, height, width)
        first = last


def pixels_of(frames: DataFrame) -> DataFrame:
    """Explode stored luma planes (y: one byte a pixel) to long form, in Arrow batches of several planes."""

    def run(batches):
        for batch in batches:
            first = 0
            for planes in stacks(batch):
                count, height, width = planes.shape
                n, rows = height * width, pa.array(np.repeat(np.arange(first, first + count), height * width))
                at = np.tile(np.arange(n, dtype=np.int32), count)
                yield pa.RecordBatch.from_arrays([batch.column("video_id").take(rows), batch.column("frame_no").take(rows), pa.array(at // max(1, width)), pa.array(at % max(1, width)), pa.array(planes.reshape(-1).astype(np.float64))], names=["video_id", "frame_no", "y", "x", "v"])
                first += count

    return frames.select("video_id", "frame_no", "height", "width", "y").mapInArrow(run, "video_id string, frame_no int, y int, x int, v double")


def embedding_planes(embeddings: DataFrame) -> DataFrame:
    """Each embedding as an 8 x 8 plane: v = 128 + 400 e, truncated and clipped."""
    cells = embeddings.select(F.col("vec_id").alias("frame_no"), F.posexplode("embedding").alias("i", "e"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), (128 + 400 * F.col("e").cast("double")).cast("int")))
    return cells.select("frame_no", F.floor(F.col("i") / 8).cast("int").alias("y"), F.pmod("i", F.lit(8)).alias("x"), v.cast("double").alias("v"))
