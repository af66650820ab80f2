"""The frame container as a data source: round trips, ranges, commits, failures, streams."""

import os

import pytest
from pyspark.errors import PySparkException

from vidlake.sources import container
from vidlake.sources.frames import FRAMES


def frames(video, numbers, layout="444", side=(4, 6)):
    h, w = side
    small = -(-h // 2) * (-(-w // 2))
    size = {"mono": None, "444": h * w, "420": small}[layout]
    return [(video, n, h, w, bytes([n % 256]) * (h * w), None if size is None else bytes([1]) * size, None if size is None else bytes([n % 7]) * size) for n in numbers]


@pytest.fixture()
def folder(tmp_path, spark):
    container.register(spark)
    return str(tmp_path / "held")


def rows_of(spark, folder, **options):
    return sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in spark.read.format("frames").options(**options).load(folder).collect())


def test_round_trip_of_layouts_gaps_and_odd_names(spark, folder):
    rows = frames("a/b ü", [0, 1, 2, 9, 10]) + frames("m", range(5), "mono") + frames("q", [3], "420", (5, 7)) + frames("q", [4], "420", (3, 3))
    container.write(spark.createDataFrame(rows, FRAMES), folder)
    assert rows_of(spark, folder) == sorted(rows)
    found = {r.video_id: (r.frame_count, r.width) for r in container.metadata(spark, folder).collect()}
    assert found == {"a/b ü": (5, 6), "m": (5, 6), "q": (2, 7)}
    files = spark.read.format("binaryFile").load(os.path.join(folder, "*.y4m"))
    assert sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in container.decoded(files).collect()) == sorted(rows)


def test_ranges_seek_and_are_partitions(spark, folder):
    container.write(spark.createDataFrame(frames("v", range(40)), FRAMES).coalesce(1), folder)
    read = spark.read.format("frames").option("frames", 4).load(folder)
    assert read.rdd.getNumPartitions() >= 10
    assert [r[1] for r in rows_of(spark, folder, first=7, last=12)] == list(range(7, 13))
    assert rows_of(spark, folder, video="other") == []
    assert [r[1] for r in rows_of(spark, folder, bytes=100)] == list(range(40))


def test_append_overwrite_and_empty(spark, folder):
    some = lambda a, b: spark.createDataFrame(frames("v", range(a, b)), FRAMES)
    container.write(some(0, 3), folder)
    container.write(some(3, 5), folder)
    assert [r[1] for r in rows_of(spark, folder)] == [0, 1, 2, 3, 4]
    container.write(some(7, 8), folder, "overwrite")
    assert [r[1] for r in rows_of(spark, folder)] == [7]
    container.write(some(0, 1).limit(0), folder, "overwrite")
    assert rows_of(spark, folder) == []
    assert not os.path.exists(os.path.join(folder, container.TEMPORARY))


def test_a_failed_task_leaves_no_frame(spark, folder):
    container.write(spark.createDataFrame(frames("v", range(3)), FRAMES), folder)
    bad = frames("v", range(10, 40)) + [("v", 40, 4, 6, b"short", None, None)]
    with pytest.raises(PySparkException, match="do not fit"):
        container.write(spark.createDataFrame(bad, FRAMES), folder)
    assert [r[1] for r in rows_of(spark, folder)] == [0, 1, 2]
    assert sorted(n for n in os.listdir(folder) if n.endswith(".y4m")) == sorted(os.path.basename(p) for p, _ in container._listed(folder))
    assert not os.path.exists(os.path.join(folder, container.TEMPORARY))


def test_two_writers_never_share_a_log_entry(folder):
    writers = [container.FrameWriter({"path": folder}, False) for _ in range(3)]
    import pyarrow as pa

    for k, w in enumerate(writers):
        batch = pa.RecordBatch.from_pylist([dict(zip(FRAMES.names, r, strict=True)) for r in frames(f"v{k}", range(2))])
        w.message = w.write(iter([batch]))
    for w in writers:
        w.commit([w.message, None])
    assert len(container._entries(folder)) == 3 and len(container._listed(folder)) == 3


def test_foreign_and_damaged_files(spark, folder):
    os.makedirs(folder)
    path = os.path.join(folder, "clip.y4m")
    with open(path, "wb") as f:
        f.write(b"YUV4MPEG2 W2 H2 F30:1 Cmono\n" + b"FRAME\nabcd" * 3)
    assert rows_of(spark, folder) == [("clip", k, 2, 2, b"abcd", None, None) for k in range(3)]
    with open(path, "ab") as f:
        f.write(b"FRAME\nab")
    with pytest.raises(PySparkException, match="whole number of frames"):
        rows_of(spark, folder)
    with open(path, "wb") as f:
        f.write(b"YUV4MPEG2 W2 H2 Cmono\nFRAME\nabcdFRANE\nabcd")
    with pytest.raises(PySparkException, match="damaged"):
        rows_of(spark, folder)
    with pytest.raises(ValueError, match="mounted"):
        container.folder_of("hdfs://host/x")


def test_a_stream_goes_on_where_it_stopped(spark, folder, tmp_path):
    sink, state = str(tmp_path / "sink"), str(tmp_path / "state")
    total = 0
    for k in range(3):
        container.write(spark.createDataFrame(frames("v", range(total, total + 5 + k)), FRAMES), folder)
        total += 5 + k
        stream = spark.readStream.format("frames").option("frames", 2).load(folder).select("video_id", "frame_no")
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.frame_no for r in spark.read.parquet(sink).collect()) == list(range(total))
