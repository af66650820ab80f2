"""An uncompressed frame container (YUV4MPEG2) as a Spark data source.

``spark.read.format("frames")`` gives one row a frame; ``df.write.format
("frames")`` writes rows, ``spark.readStream.format("frames")`` follows a
folder that others append to. A folder holds *segments*: files of consecutive
frames of one video, one size and one colour layout. All frames of a segment
take the same number of bytes, so a range of frames is read by seeking and
is an input partition of its own.

A task writes its segments under ``_temporary``. Commit moves them beside the
others and then puts their names in the next numbered entry of ``_log``, in
one step that fails if another writer was first; abort removes them. What is
not in the log is not there for readers, so neither a failed task nor a failed
job leaves a frame. A folder without a log is read by its ``*.y4m`` files.

Options: ``path``; ``frames`` (at most so many frames an input partition);
``bytes`` (at most so many bytes, 32 MB if not given); ``first`` and ``last``
(only frames numbered so, both included) and ``video`` (only this one), which
skip segments and seek inside them. The folder must be mounted on every node (a local path
or ``file:``); files in a store that only Spark reads go through ``decoded``.
"""

from __future__ import annotations

import io
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from .frames import FRAMES

MAGIC, FRAME = b"YUV4MPEG2", b"FRAME\n"
PARTITION_BYTES = 32 << 20
#: Bytes of a batch handed to Spark.
BATCH_BYTES = 8 << 20
LOG, TEMPORARY = "_log", "_temporary"


def folder_of(path: str) -> str:
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the frame container needs a mounted folder, not {path!r}; read such files by binaryFile and `decoded`")
    return unquote(url.path) if url.scheme else path


@dataclass(frozen=True)
class Segment:
    """A file's header: what its frames are, where they begin and how many bytes each takes."""

    video: str
    first: int
    width: int
    height: int
    layout: str
    start: int = 0
    frames: int = 0
    name: str = ""

    @property
    def planes(self) -> list[int]:
        """Bytes of each plane."""
        full = self.width * self.height
        if self.layout == "mono":
            return [full]
        return [full, *[full if self.layout == "444" else -(-self.width // 2) * (-(-self.height // 2))] * 2]

    @property
    def step(self) -> int:
        return len(FRAME) + sum(self.planes)

    def header(self) -> bytes:
        video = quote(self.video, safe="")
        return f"YUV4MPEG2 W{self.width} H{self.height} F25:1 Ip A1:1 C{self.layout} XVIDEO={video} XFIRST={self.first}\n".encode()


def read_header(file: BinaryIO, size: int, name: str) -> Segment:
    """The segment that an open file holds; ValueError if it is none or its last frame is cut off."""
    line = file.readline(4096)
    fields = line.split()
    if not line.endswith(b"\n") or not fields or fields[0] != MAGIC:
        raise ValueError(f"{name} is no frame container")
    tags = {chr(f[0]): f[1:].decode() for f in fields[1:] if not f.startswith(b"X")}
    own = dict(f[1:].decode().split("=", 1) for f in fields[1:] if f.startswith(b"X") and b"=" in f)
    layout = tags.get("C", "420jpeg")
    if layout != "mono" and layout != "444" and not layout.startswith("420"):
        raise ValueError(f"{name}: unknown colour layout {layout!r}")
    stem = os.path.basename(name).removesuffix(".y4m")
    s = Segment(unquote(own.get("VIDEO", stem)), int(own.get("FIRST", 0)), int(tags["W"]), int(tags["H"]), layout)
    if (size - len(line)) % s.step:
        raise ValueError(f"{name}: its size is no whole number of frames of {s.step} bytes")
    return Segment(s.video, s.first, s.width, s.height, s.layout, len(line), (size - len(line)) // s.step, name)


def segment_of(path: str) -> Segment:
    with open(path, "rb") as f:
        return read_header(f, os.path.getsize(path), path)


def batches_of(file: BinaryIO, s: Segment, skip: int, count: int) -> Iterator[pa.RecordBatch]:
    """``count`` frames from the ``skip``-th on, in batches of bounded bytes; ``file`` can seek."""
    file.seek(s.start + skip * s.step)
    each = max(1, BATCH_BYTES // s.step)
    for at in range(skip, skip + count, each):
        n = min(each, skip + count - at)
        raw = file.read(n * s.step)
        if len(raw) != n * s.step or any(raw[k * s.step : k * s.step + len(FRAME)] != FRAME for k in range(n)):
            raise ValueError(f"{s.name}: frame {s.first + at} or one of the next {n} is damaged")
        columns: list[list] = [[], [], []]
        for k in range(n):
            a = k * s.step + len(FRAME)
            for p in range(3):
                size = s.planes[p] if p < len(s.planes) else 0
                columns[p].append(raw[a : a + size] if p < len(s.planes) else None)
                a += size
        numbers = range(s.first + at, s.first + at + n)
        yield pa.RecordBatch.from_arrays([pa.array([s.video] * n), pa.array(numbers, pa.int32()), pa.array([s.height] * n, pa.int32()), pa.array([s.width] * n, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=FRAMES.names)


def _entries(folder: str) -> list[list[dict]]:
    """The log's entries in order, each the segments that one commit added."""
    log = os.path.join(folder, LOG)
    names = sorted(n for n in os.listdir(log) if n.endswith(".json")) if os.path.isdir(log) else []
    out = []
    for n in names:
        with open(os.path.join(log, n)) as f:
            out.append(json.load(f))
    return out


def _listed(folder: str) -> list[tuple[str, int]]:
    """(path, frames) of all segments, in the order of their commits; -1 frames where no log tells."""
    if not os.path.isdir(folder):
        raise ValueError(f"no such folder: {folder}")
    found = _entries(folder)
    if found or os.path.isdir(os.path.join(folder, LOG)):
        return [(os.path.join(folder, s["name"]), s["frames"]) for entry in found for s in entry]
    return [(os.path.join(folder, n), -1) for n in sorted(os.listdir(folder)) if n.endswith(".y4m")]


@dataclass
class Frames(InputPartition):
    """A range of a segment's frames."""

    segment: Segment | None
    skip: int
    count: int


def _cut(s: Segment, skip: int, count: int, options: dict) -> list[Frames]:
    each = max(1, min(int(options.get("frames", count or 1)), int(options.get("bytes", PARTITION_BYTES)) // s.step))
    return [Frames(s, k, min(each, skip + count - k)) for k in range(skip, skip + count, each)]


def _read(part: Frames) -> Iterator[pa.RecordBatch]:
    with open(part.segment.name, "rb") as f:
        yield from batches_of(f, part.segment, part.skip, part.count)


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.folder = options, folder_of(options["path"])

    def partitions(self) -> list[Frames]:
        first, last = int(self.options.get("first", 0)), int(self.options.get("last", 2**31 - 1))
        out: list[Frames] = []
        for path, _ in _listed(self.folder):
            s = segment_of(path)
            if self.options.get("video", s.video) != s.video:
                continue
            skip, end = max(0, first - s.first), min(s.frames, last - s.first + 1)
            if skip < end:
                out += _cut(s, skip, end - skip, self.options)
        return out or [Frames(None, 0, 0)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        if partition.count:
            yield from _read(partition)


class FrameStreamReader(DataSourceStreamReader):
    """Frames in the order of the log; the offset is how many frames have gone before."""

    def __init__(self, options: dict):
        self.options, self.folder = options, folder_of(options["path"])

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frames": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"frames": sum(n for _, n in _listed(self.folder) if n > 0)}

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        out, at = [], 0
        for path, n in _listed(self.folder):
            lo, hi = max(start["frames"] - at, 0), min(end["frames"] - at, n)
            if lo < hi:
                out += _cut(segment_of(path), lo, hi - lo, self.options)
            at += max(n, 0)
        return out

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        yield from _read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to let go of: segments stay."""


@dataclass
class Written(WriterCommitMessage):
    segments: list[dict]


class FrameWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = folder_of(options["path"]), overwrite
        self.work = os.path.join(self.folder, TEMPORARY, uuid.uuid4().hex)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Write this task's frames; a new segment begins where a frame does not follow the one before."""
        os.makedirs(self.work, exist_ok=True)
        done: list[dict] = []
        file, now, following = None, None, None
        try:
            for batch in iterator:
                for r in batch.to_pylist():
                    s = _segment_for(r)
                    if file is None or s != following:
                        if file is not None:
                            file.close()
                        now = {"name": f"{quote(s.video, safe='')}-{s.first:010d}-{uuid.uuid4().hex}.y4m", "frames": 0}
                        done.append(now)
                        file = open(os.path.join(self.work, now["name"]), "wb")  # noqa: SIM115
                        file.write(s.header())
                    file.write(FRAME)
                    for p in ("y", "u", "v")[: len(s.planes)]:
                        file.write(r[p])
                    now["frames"] += 1
                    following = Segment(s.video, s.first + 1, s.width, s.height, s.layout)
        finally:
            if file is not None:
                file.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        segments = [s for m in messages if m is not None for s in m.segments]
        old = [p for p, _ in _listed(self.folder)] if self.overwrite and os.path.isdir(self.folder) else []
        log = os.path.join(self.folder, LOG)
        os.makedirs(log, exist_ok=True)
        for s in segments:
            os.replace(os.path.join(self.work, s["name"]), os.path.join(self.folder, s["name"]))
        if self.overwrite:
            for n in os.listdir(log):
                os.remove(os.path.join(log, n))
        ready = os.path.join(log, f".{uuid.uuid4().hex}")
        with open(ready, "w") as f:
            json.dump(segments, f)
        number = len([n for n in os.listdir(log) if n.endswith(".json")])
        while True:  # a link to a name that is taken fails: two writers never share a number
            try:
                os.link(ready, os.path.join(log, f"{number:010d}.json"))
                break
            except FileExistsError:
                number += 1
        os.remove(ready)
        for p in old:
            os.remove(p)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(self.work, ignore_errors=True)
        try:
            os.rmdir(os.path.dirname(self.work))
        except OSError:  # another writer is at work there
            pass


def _segment_for(r: dict) -> Segment:
    """The segment that a frame could begin; ValueError if its planes do not fit its size."""
    if r["video_id"] is None or r["frame_no"] is None or r["y"] is None:
        raise ValueError("a frame needs video_id, frame_no and a luma plane")
    sizes = [None if r[p] is None else len(r[p]) for p in ("y", "u", "v")]
    for layout in ("mono", "444", "420jpeg"):
        s = Segment(r["video_id"], r["frame_no"], r["width"], r["height"], layout)
        if sizes == [*s.planes, None, None][:3]:
            return s
    raise ValueError(f"planes of {sizes} bytes do not fit {r['width']} x {r['height']}")


class FrameContainer(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self):
        return FRAMES

    def reader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))

    def streamReader(self, schema) -> FrameStreamReader:  # noqa: N802
        return FrameStreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        if [f.name for f in schema] != FRAMES.names:
            raise ValueError(f"frames have the columns {FRAMES.names}")
        return FrameWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameContainer)


def write(frames: DataFrame, path: str, mode: str = "append") -> None:
    """Frames of each video together and in order, so that a task's segments are long."""
    register(frames.sparkSession)
    dealt = frames.select(*FRAMES.names).repartitionByRange("video_id", "frame_no").sortWithinPartitions("video_id", "frame_no")
    dealt.write.format("frames").mode(mode).save(path)


def decoded(files: DataFrame) -> DataFrame:
    """The frames of container files read by Spark's binaryFile source (path, content): for stores that Python cannot open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_py()
                file = io.BytesIO(raw)
                s = read_header(file, len(raw), path)
                yield from batches_of(file, s, 0, s.frames)

    return files.select("path", "content").mapInArrow(run, FRAMES)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row a video from the segments' headers alone: frame_count, width, height."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(p,) for p, _ in _listed(folder_of(path))], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [segment_of(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_pydict({"video_id": pa.array([s.video for s in found], pa.string()), "frames": pa.array([s.frames for s in found], pa.int64()), "width": pa.array([s.width for s in found], pa.int32()), "height": pa.array([s.height for s in found], pa.int32())})

    each = rows.mapInArrow(run, "video_id string, frames long, width int, height int")
    return each.groupBy("video_id").agg(F.sum("frames").alias("frame_count"), F.max("width").alias("width"), F.max("height").alias("height"))
