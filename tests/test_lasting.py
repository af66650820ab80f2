"""The filter on typed state: restarts, seeds, late frames, closing; and the meters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vidlake.operators import alignment as al
from vidlake.streaming import aligner, lasting
from vidlake.streaming import meter as mt

IN = "leak_id long, leak_frame long, candidates array<struct<rank: int, ref_pos: int, combined: double>>, reset boolean, seen_at timestamp"


@pytest.fixture
def store(spark):
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    lasting.with_store(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)


def frame(leak, n, at=None, reset=False):
    spot = 100 * leak + 2 * n + (300 if n % 5 == 4 else 0)
    listed = [(1, spot, 4.0 + n % 3), (2, 100 * leak + 2 * n, 3.0), (3, 900, 1.0)]
    return (leak, n, listed, reset, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n if at is None else at))


class Feed:
    """A stream that is fed and restarted from its checkpoint by every call."""

    def __init__(self, spark, folder, **options):
        self.spark, self.folder, self.options = spark, folder, options

    def __call__(self, rows):
        self.spark.createDataFrame(rows, IN).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(IN).parquet(f"{self.folder}/in")
        run = lasting.align_lasting(stream, **self.options).writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        return self.spark.read.schema(lasting.OUTPUT).parquet(f"{self.folder}/out")


def batch(spark, rows):
    long = spark.createDataFrame(rows, IN).select("leak_id", "leak_frame", F.explode("candidates").alias("c")).select("leak_id", "leak_frame", "c.*")
    return {(r.leak_id, r.leak_frame): (r.estimated_original_frame, round(r.pos, 9), round(r.sigma, 9), r.streak) for r in al.align(long).collect()}


def answers(found):
    return {(r.leak_id, r.leak_frame): (r.estimated_original_frame, round(r.pos, 9), round(r.sigma, 9), r.streak) for r in found.where("not closed").collect()}


def test_restarts_late_frames_and_closing(spark, tmp_path, store):
    feed = Feed(spark, str(tmp_path), idle=100, delay="0 seconds")
    early = [frame(k, n) for k in (1, 2) for n in range(4)]
    feed(early)
    # frame 3 comes again: late, though in time; the others go on from the kept state
    later = [frame(1, n) for n in range(4, 9)] + [frame(1, 3, at=4)] + [frame(2, 4)]
    found = feed(later)
    assert answers(found) == batch(spark, early + later[:5] + later[6:])
    assert found.where("closed").count() == 0
    found = feed([frame(3, 0, at=5000)])
    ended = {r.leak_id: r for r in found.where("closed").collect()}
    assert sorted(ended) == [1, 2]
    assert (ended[1].leak_frame, ended[1].n_processed, ended[1].n_late) == (8, 9, 1) and (ended[2].leak_frame, ended[2].n_processed, ended[2].n_late) == (4, 5, 0)
    # a closed stream starts afresh, even at a frame that it had passed
    again = feed([frame(1, 2, at=5001)]).where("leak_id = 1 and leak_frame = 2 and sigma = 100.0").orderBy("n_processed").collect()
    assert again and again[0].n_processed == 1 and again[0].vel == 0.0


def test_goes_on_from_a_batch_run(spark, tmp_path, store):
    rows = [frame(k, n) for k in (1, 2, 4) for n in range(10)]
    long = spark.createDataFrame([r for r in rows if r[1] < 6 and r[0] < 4], IN).select("leak_id", "leak_frame", F.explode("candidates").alias("c")).select("leak_id", "leak_frame", "c.*")
    seeds = lasting.states_of(al.align(long))
    seeds.write.parquet(f"{tmp_path}/seeds")
    feed = Feed(spark, str(tmp_path), initial=spark.read.parquet(f"{tmp_path}/seeds"))
    found = feed([r for r in rows if r[1] >= 6 or r[0] == 4])
    want = batch(spark, rows)
    assert answers(found) == {k: v for k, v in want.items() if k[1] >= 6 or k[0] == 4}
    assert {r.n_processed for r in found.where("leak_frame = 9").collect()} == {10}


def test_reset_and_bad_limits(spark, tmp_path, store):
    found = Feed(spark, str(tmp_path))([frame(1, n, reset=n == 3) for n in range(5)])
    assert found.where("leak_frame = 3 and sigma = 100.0 and vel = 0.0").count() == 1
    stream = spark.readStream.schema(IN).parquet(f"{tmp_path}/in")
    for bad in ({"radius": 0}, {"idle": 0}):
        with pytest.raises(ValueError):
            lasting.align_lasting(stream, **bad)


def test_stages(spark):
    stages = mt.Stages(spark)
    kept = stages.run("first", spark.range(70))
    assert stages.run("second", kept.where("id < 7")).count() == 7 and stages.run("none", kept.where("id < 0")).count() == 0
    rows = {r.stage: r for r in stages.means(10).collect()}
    assert [rows[k].n_rows for k in ("first", "second", "none")] == [70, 7, 0]
    assert all(r.ms_per_query == pytest.approx(100 * r.seconds) and r.seconds > 0 for r in rows.values())
    assert stages.means(0).where("ms_per_query is null").count() == 3


def test_meter_of_an_unknown_run(spark):
    class Run:
        id = runId = "none"

    with pytest.raises(TimeoutError):
        mt.Meter().of(Run, wait=0.01)
    assert aligner.STATE == lasting.STATE
