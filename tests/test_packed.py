"""Queries that take planes packed: no pixel becomes a row on the way, nothing of their size goes through the driver."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidlake.operators import imaging as im
from vidlake.operators import pixels as px
from vidlake.operators import readout as ro
from vidlake.operators import transforms as tr
from vidlake.plans import fixtures as fx
from vidlake.plans.catalog import QUERIES
from vidlake.sources import providers as pr

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def packed(spark, planes):
    rows = [(n, *p.shape, bytearray(p.astype(np.uint8).tobytes())) for n, p in enumerate(planes)]
    return spark.createDataFrame(rows, "frame_no int, height int, width int, y binary")


def noise(*shape, seed=5):
    return np.random.default_rng(seed).integers(0, 256, shape)


@pytest.mark.parametrize("name", ["c17_cliff_score", "c18_blur_readout", "w7_cell_ranking"])
def test_cells_are_scored_from_packed_planes(spark, name):
    made = plan(QUERIES[name](spark, SF))
    assert "Broadcast" not in made and "Generate" not in made


def test_softened_cells_are_those_of_the_long_form(spark):
    planes = noise(3, 24, 20)  # the last row and column of cells are cut off
    frames = packed(spark, planes).withColumns({"soft_by": F.lit(1), "soft_bx": F.col("frame_no") % 2})
    cells = [(n, y // 16, x // 16, y % 16, x % 16, float(p[y, x])) for n, p in enumerate(planes) for y in range(24) for x in range(20)]
    keys = ["frame_no", "by_", "bx"]
    blocks = spark.createDataFrame(cells, "frame_no int, by_ long, bx long, y int, x int, v double")
    chosen = (F.col("by_") == 1) & (F.col("bx") == F.col("frame_no") % 2)
    soft = tr.dct2(tr.blurred(blocks.where(chosen), keys, 16, 6), keys, 16)
    spectra = soft.unionByName(tr.dct2(blocks.where(~chosen), keys, 16)).withColumn("c", F.round("c", 6))
    want = {tuple(r)[:3]: r.score for r in tr.cliff(spectra, keys, 6, 4).collect()}
    found = {tuple(r)[:3]: r.score for r in ro.softened_cells(frames, 16, 6, 4).collect()}
    assert found.keys() == want.keys() and len(found) == 12
    assert all(found[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_high_pass_from_packed_planes(spark):
    made = plan(QUERIES["e7_pixel_encoder"](spark, SF))
    assert "Broadcast" not in made and "Generate" not in made
    planes = [*noise(2, 12, 20), np.full((6, 5), 9)]
    rows = pr.high_pass_packed(packed(spark, planes)).collect()
    for n, p in enumerate(planes):
        own = sorted((r.y, r.x, r.v) for r in rows if r.frame_no == n)
        assert [r[:2] for r in own] == list(np.ndindex(p.shape))
        assert np.allclose([r[2] for r in own], pr.high_pass_vector(p), atol=1e-6)


def test_codec_moves_are_those_of_chained_passes(spark):
    made = plan(QUERIES["s14_chained_passes"](spark, SF))
    assert "Join" not in made
    planes = noise(2, 12, 20)
    found = {tuple(r)[:3]: r.moved for r in im.codec_moves(packed(spark, planes), (60, 10, 100), (1, 3)).collect()}
    for (quality, passes, n), moved in found.items():
        seen = planes[n][None].astype(float)
        for _ in range(passes):
            seen = im.apply_codec(seen, quality)
        assert moved == pytest.approx(np.abs(planes[n] - seen[0]).mean())
    assert len(found) == 12


def test_ssim_from_packed_planes(spark):
    made = plan(QUERIES["t9_scene_change"](spark, SF))
    assert "Broadcast" not in made and "Generate" not in made
    a, b = noise(2, 9, 11), np.clip(noise(2, 9, 11) + noise(2, 9, 11, seed=6) % 20, 0, 255)
    small = noise(1, 6, 11)[0]  # no full window: no row
    left, right = (packed(spark, [*p, small]) for p in (a, b))
    pairs = left.withColumnRenamed("y", "a").join(right.select("frame_no", F.col("y").alias("b")), "frame_no")
    cells = [(n, y, x, float(a[n, y, x]), float(b[n, y, x])) for n, y, x in np.ndindex(a.shape)]
    want = {r.frame_no: r.ssim for r in px.ssim(spark.createDataFrame(cells, "frame_no int, y int, x int, a double, b double"), ["frame_no"]).collect()}
    found = {r.frame_no: r.ssim for r in px.ssim_packed(pairs).collect()}
    assert found.keys() == want.keys() == {0, 1}
    assert all(found[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_descriptors_are_not_broadcast(spark):
    """Spark takes them for small, as they come from a small file."""
    assert "Broadcast" not in plan(QUERIES["v1_own_matches"](spark, SF))
