"""The feature cache: nothing is extracted twice, two writers and compaction do no harm."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidlake.sources.cache import FeatureCache

FRAMES = "video_id string, frame_no int, height int, width int, y binary"
COLUMNS = T.StructType([T.StructField("total", T.LongType())])


def extract(frames):
    return frames.select("video_id", F.length("y").cast("long").alias("total"))


def frames(spark, planes):
    return spark.createDataFrame([(f"v{k % 2}", k, h, w, y) for k, (h, w, y) in enumerate(planes)], FRAMES)


@pytest.fixture()
def cache(spark, tmp_path):
    return lambda: FeatureCache(spark, f"file://{tmp_path}/cache", extract, COLUMNS)


def test_only_new_content_is_extracted(spark, cache):
    some = [(2, 3, bytes([k]) * 6) for k in range(5)] + [(2, 3, bytes([0]) * 6), (3, 2, bytes([0]) * 6), (2, 3, None)]
    held = cache()
    assert held.refresh(frames(spark, some)) == 6 and held.refresh(frames(spark, some)) == 0
    assert held.refresh(frames(spark, [(2, 3, bytes([9]) * 6), *some])) == 1
    served = held.features(frames(spark, some))
    assert served.count() == 7 and served.columns == ["video_id", "frame_no", "height", "width", "total"]


def test_two_writers_and_compaction(spark, cache):
    one, two = cache(), cache()
    planes = frames(spark, [(1, 4, bytes([k]) * 4) for k in range(4)])
    one.refresh(planes)
    two._add(two.stored())  # a writer that extracted the same at the same time
    assert one.features(planes).count() == 4
    one.refresh(frames(spark, [(1, 4, bytes([k]) * 4) for k in range(3, 7)]))
    one.compact()
    assert len(one._batches()) == 1 and two.stored().count() == 7 and two.refresh(planes) == 0


def test_an_unfinished_batch_is_not_read(spark, cache, tmp_path):
    held = cache()
    held.refresh(frames(spark, [(1, 1, b"a")]))
    (batch,) = (tmp_path / "cache").glob("batch-*")
    (batch / "_SUCCESS").unlink()
    assert held.stored().count() == 0 and held.refresh(frames(spark, [(1, 1, b"a")])) == 1


def test_empty_frames(spark, cache):
    held = cache()
    assert held.refresh(spark.createDataFrame([], FRAMES)) == 0
    assert held.features(spark.createDataFrame([], FRAMES)).count() == 0
