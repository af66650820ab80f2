"""The matcher's stream against batch search and filter: blocks, ties, restarts, constructions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidlake.operators import alignment as al
from vidlake.operators import evaluation as ev
from vidlake.operators import search as se
from vidlake.plans import fixtures as fx
from vidlake.streaming import aligner as sa
from vidlake.streaming import matcher as sm


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    refs = [(k, rng.integers(-2, 3, 6).astype(float).tolist()) for k in range(70)]  # whole numbers: many scores tie
    frames = [(leak, n, leak * 100 + n, refs[(leak * 7 + n) % 70][1]) for leak in range(4) for n in range(20)]
    return spark.createDataFrame(refs, "ref_id long, vec array<double>"), spark.createDataFrame(frames, "leak_id long, leak_frame long, q long, vec array<double>")


def drained(rows, sink, state, spark, schema):
    rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.schema(schema).parquet(sink).collect()))


def test_search_in_blocks_equals_batch(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(sm, "PACK", 7)
    refs, frames = tables
    reference = sm.stage_reference(refs, str(tmp_path / "blocks"), 9)
    assert reference.blocks == 8
    frames.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "in"))
    got = drained(sm.match_stream(stream, reference, 6), str(tmp_path / "out"), str(tmp_path / "state"), spark, sm.RANKED)
    want = se.topk_inner_product(frames.select("q", "vec"), refs, 6).join(frames.select("leak_id", "leak_frame", "q"), "q")
    assert got == sorted(map(tuple, want.select("leak_id", "leak_frame", "q", "rank", "ref_id", "score").collect()))


def test_own_matcher_resumes_in_mid_stream(spark, tables, tmp_path):
    refs, frames = tables
    reference = sm.stage_reference(refs, str(tmp_path / "blocks"), 30)
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for lo, hi in ((0, 6), (6, 7), (7, 20)):
        frames.where(F.col("leak_frame").between(lo, hi - 1)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frames.schema).parquet(source)
        got = drained(sm.aligner(frames=stream, reference=reference, evidence=fx.evidence, k=5), sink, state, spark, sa.OUTPUT)
    top = se.topk_inner_product(frames.select("q", "vec"), refs, 5)
    scored = ev.evidence_scores(fx.evidence(top)).join(frames.select("leak_id", "leak_frame", "q"), "q")
    want = al.align(scored.select("leak_id", "leak_frame", "rank", F.col("ref_id").alias("ref_pos"), "combined"))
    columns = ["leak_id", "leak_frame", "estimated_original_frame", "confidence", "raw_visual_prediction", "pos", "vel", "sigma", "streak"]
    assert got == sorted(map(tuple, want.select(*columns).collect()))


def test_constructions(spark, tables):
    refs, frames = tables
    with pytest.raises(ValueError, match="either"):
        sm.aligner()
    with pytest.raises(ValueError, match="either"):
        sm.aligner(candidates=frames, frames=frames)
    with pytest.raises(ValueError, match="reference"):
        sm.aligner(frames=frames)


def test_walk_skips_late_frames_and_counts_them():
    class Held:
        exists, get = False, None

        def update(self, value):
            self.get, self.exists = value, True

    state, rng = Held(), random.Random(1)
    first = sa._walk((1,), [(n, [(100 + n, 1.0), (rng.randrange(50), 0.5)], False) for n in (0, 1, 2)], state, 5)
    again = sa._walk((1,), [(2, [(7, 1.0)], False), (3, [(103, 1.0)], False)], state, 5)
    assert list(first["leak_frame"]) == [0, 1, 2] and list(again["leak_frame"]) == [3]
    assert state.get[-2:] == (4, 1)
    reset = sa._walk((1,), [(0, [(5, 1.0)], True)], state, 5)
    assert list(reset["pos"]) == [5.0]
