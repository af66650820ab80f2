"""Ordered suppression by rounds on cells against the greedy walk."""

import random

import pytest
from pyspark.sql import functions as F

from vidlake.operators import patches as pa


def greedy(rows, side):
    out = []
    for frame in sorted({r[0] for r in rows}):
        kept = []
        for _, o, x, y in sorted((r for r in rows if r[0] == frame), key=lambda r: r[1]):
            if all(abs(x - a) >= side or abs(y - b) >= side for a, b in kept):
                kept.append((x, y))
                out.append((frame, o, x, y))
    return sorted(out)


def cases():
    rng = random.Random(4)
    spread = [(f, k, rng.randrange(-300, 900), rng.randrange(700)) for f in range(3) for k in range(150)]
    hot = [(0, k, rng.randrange(20), rng.randrange(20)) for k in range(300)] + [(0, 1000 + k, 40 * k, 0) for k in range(12)]
    chain = [(0, k, 30 * k, 0) for k in range(40)]
    edges = [(0, 0, 0, 0), (0, 1, 49, 49), (0, 2, 50, 0), (0, 3, -49, 0), (0, 4, -50, 0), (0, 5, 0, 50), (0, 5, 0, 50)]
    return {"spread": spread, "hot": hot, "chain": chain, "edges": edges}


@pytest.mark.parametrize("name", list(cases()))
def test_equals_the_greedy_walk(spark, name):
    rows = cases()[name]
    points = spark.createDataFrame(rows, "frame_no long, k long, x int, y int").select("frame_no", F.struct("k").alias("o"), "x", "y")
    got = pa.spread_in_cells(points, ["frame_no"], 50).select("frame_no", "o.k", "x", "y").collect()
    assert sorted(map(tuple, got)) == greedy(rows, 50)


def test_no_points(spark):
    none = spark.createDataFrame([], "frame_no long, o struct<k: long>, x int, y int")
    assert pa.spread_in_cells(none, ["frame_no"]).count() == 0


def test_patches_of_both_forms_agree(spark):
    rng = random.Random(7)
    rows = [(f, k, rng.uniform(0, 640), rng.uniform(0, 480), float(rng.randrange(3)), float(rng.randrange(2))) for f in range(2) for k in range(80)]
    keypoints = spark.createDataFrame(rows, "frame_no long, kp_id long, x double, y double, size double, response double")
    frames = spark.createDataFrame([(0, 640, 480), (1, 640, 480)], "frame_no long, width int, height int")
    one, two = (sorted(map(tuple, pa.keypoint_patches(keypoints, frames, 64, in_cells=c).collect()), key=repr) for c in (False, True))
    assert one == two and len(one) > 10
