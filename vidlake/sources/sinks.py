"""Sinks: numbered image names, JSON lines and JSON results, frame tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def image_name(index: Column) -> Column:
    """frame_00000.png and on."""
    return F.format_string("frame_%05d.png", index)


def json_lines(records: DataFrame) -> DataFrame:
    """One JSON object a row, timing columns (leading underscore) left out."""
    return records.select(F.to_json(F.struct(*[c for c in records.columns if not c.startswith("_")])).alias("line"))


def write_json_lines(records: DataFrame, path: str, expected: int | None = None) -> int:
    """Write the lines and count them on the way; a count other than ``expected`` is an error."""
    seen = Observation("lines")
    json_lines(records).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").text(path)
    n = seen.get["n"]
    if expected is not None and n != expected:
        raise ValueError(f"{n} records for {expected} frames")
    return n


def nested_results(results: DataFrame, key: str) -> DataFrame:
    """One JSON document a key with its metrics nested under it."""
    metrics = F.struct(*[c for c in results.columns if c != key])
    return results.select(F.to_json(F.create_map(F.col(key).cast("string"), metrics)).alias("doc"))


def report(results: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Fixed-width report lines; ``columns`` gives (name, printf format)."""
    return results.select(F.format_string(" ".join(f for _, f in columns), *[F.col(c) for c, _ in columns]).alias("line"))


def write_frames(frames: DataFrame, path: str) -> None:
    """A frame table in frame order within each video; every frame is written."""
    frames.repartitionByRange("video_id", "frame_no").sortWithinPartitions("video_id", "frame_no").write.mode("errorifexists").parquet(path)
