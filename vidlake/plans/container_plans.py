"""Queries through the frame container: frames are packed from the rows of ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import container
from ..sources import scratch
from . import fixtures as fx
from .registry import query

VIDEOS = 7


def packed(spark, sf_dir):
    """Each embedding as an 8 x 8 frame: luma 128 + 400 e, U its rows from below, V its inverse."""
    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), (128 + 400 * x.cast("double")).cast("int")))).alias("v"))
    plane = lambda c: F.unhex(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    return e.select(
        F.concat(F.lit("clip "), F.col("vec_id") % VIDEOS).alias("video_id"), F.floor(F.col("vec_id") / VIDEOS).cast("int").alias("frame_no"), F.lit(8).alias("height"), F.lit(8).alias("width"),
        plane(F.col("v")).alias("y"), plane(F.reverse("v")).alias("u"), plane(F.transform("v", lambda x: 255 - x)).alias("v"),
    )


_BYTES = "SELECT vec_id, list_transform(embedding, lambda x: least(255, greatest(0, CAST(trunc(128 + 400 * CAST(x AS DOUBLE)) AS INT)))) AS v FROM embeddings"
_HEX = "array_to_string(list_transform({}, lambda x: printf('%02X', x)), '')"
_PACKED = f"""WITH bytes AS ({_BYTES}), packed AS (SELECT 'clip ' || vec_id % {VIDEOS} AS video_id, vec_id // {VIDEOS} AS frame_no, 8 AS height, 8 AS width,
  md5({_HEX.format('v')} || '/' || {_HEX.format('list_reverse(v)')} || '/' || {_HEX.format('list_transform(v, lambda x: 255 - x)')}) AS digest FROM bytes)"""
_COLUMNS = "video_id:s frame_no:i height:i width:i digest:s"


def _digests(frames):
    return frames.select("video_id", "frame_no", "height", "width", F.md5(F.concat_ws("/", F.hex("y"), F.hex("u"), F.hex("v")).cast("binary")).alias("digest"))


def _written(spark, sf_dir):
    path = scratch.folder(spark, "container")
    container.write(packed(spark, sf_dir), path)
    return path


@query(_COLUMNS, f"{_PACKED} SELECT * FROM packed")
def s4_container_frames(spark, sf_dir):
    """Frames written to the container and read back by format name."""
    path = _written(spark, sf_dir)
    return _digests(spark.read.format("frames").load(path))


@query("video_id:s frame_count:i width:i height:i", f"{_PACKED} SELECT video_id, count(*) AS frame_count, 8 AS width, 8 AS height FROM packed GROUP BY video_id")
def s2_container_metadata(spark, sf_dir):
    """Counts and sizes from the segments' headers alone."""
    return container.metadata(spark, _written(spark, sf_dir))


@query(_COLUMNS, f"{_PACKED} SELECT * FROM packed")
def s3_container_stream(spark, sf_dir):
    """Frames appended in two commits, followed by a stream that is stopped and begun again in between."""
    path, sink, state = (scratch.folder(spark, n) for n in ("container", "followed", "state"))
    frames = packed(spark, sf_dir)
    for odd in (0, 1):
        container.write(frames.where(F.floor(F.col("frame_no") / 64) % 2 == odd), path)
        rows = _digests(spark.readStream.format("frames").load(path))
        rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("video_id string, frame_no int, height int, width int, digest string").parquet(sink)


@query("video_id:s frame_no:i height:i width:i digest:s", f"{_PACKED} SELECT p.* FROM packed p, (SELECT max(frame_no) AS n FROM packed) m WHERE video_id = 'clip 3' AND frame_no BETWEEN n // 4 AND n // 2")
def s3_container_seek(spark, sf_dir):
    """A range of one video's frames, reached by seeking: the range is the reader's own parameter."""
    path = _written(spark, sf_dir)
    n = container.metadata(spark, path).agg(F.max("frame_count")).first()[0] - 1
    found = spark.read.format("frames").option("video", "clip 3").option("first", n // 4).option("last", n // 2).load(path)
    return _digests(found)
