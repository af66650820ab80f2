"""Keypoints against plain loops and known figures; matches, fits and read-outs of moved planes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidlake.operators import homography as hg
from vidlake.operators import keypoints as kp
from vidlake.operators import readout as ro


def blobs(side=65, n=14, seed=1):
    """Round light and dark spots on grey."""
    rng = np.random.default_rng(seed)
    yy, xx = np.mgrid[0:side, 0:side]
    plane = np.full((side, side), 120.0)
    for k in range(n):
        y, x, s = rng.uniform(6, side - 6, 2).tolist() + [rng.uniform(1.5, 4)]
        plane += (90 if k % 2 else -90) * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * s * s))
    return np.clip(np.rint(plane + rng.normal(0, 2, plane.shape)), 0, 255).astype(np.uint8)


def table(spark, planes):
    rows = [(k, *p.shape, p.tobytes()) if p is not None else (k, 20, 20, None) for k, p in planes.items()]
    return spark.createDataFrame(rows, "frame_no int, height int, width int, y binary")


def plain_extrema(plane):
    """The same extrema by loops: mirrored index, direct sums, 26 comparisons."""
    h, w = plane.shape

    def mirror(i, n):
        while not 0 <= i < n:
            i = -i if i < 0 else 2 * (n - 1) - i
        return i

    def blurred(sigma):
        reach = math.ceil(4 * sigma)
        g = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
        t = [v / sum(g) for v in g]
        down = [[sum(t[k + reach] * float(plane[mirror(y + k, h), x]) for k in range(-reach, reach + 1)) for x in range(w)] for y in range(h)]
        return [[sum(t[k + reach] * down[y][mirror(x + k, w)] for k in range(-reach, reach + 1)) for x in range(w)] for y in range(h)]

    g = [blurred(math.sqrt((1.6 * 2 ** (i / 3)) ** 2 - 0.25)) for i in range(6)]
    d = [[[round(g[i + 1][y][x] - g[i][y][x], 6) for x in range(w)] for y in range(h)] for i in range(5)]
    out = []
    for i in range(1, 4):
        for y in range(1, h - 1):
            for x in range(1, w - 1):
                near = [d[i + a][y + b][x + c] for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
                v = d[i][y][x]
                if (v > 1.7 and v == max(near)) or (v < -1.7 and v == min(near)):
                    out.append((i, y, x))
    return out


def test_extrema_equal_plain_loops(spark):
    planes = {1: blobs(40, 16), 2: blobs(36, 12, 2)[:21], 3: np.full((16, 16), 7, np.uint8)}
    found = {(r.frame_no, r.layer, r.y, r.x) for r in kp.scale_extrema(table(spark, planes), ["frame_no"]).collect()}
    want = {(k, *cell) for k, p in planes.items() for cell in plain_extrema(p)}
    assert found == want and len(want) > 3


def test_a_blob_is_found_where_and_as_large_as_it_is():
    yy, xx = np.mgrid[0:80, 0:80]
    for s in (2.5, 4.0, 7.0):
        plane = np.clip(40 + 200 * np.exp(-((yy - 37.3) ** 2 + (xx - 42.6) ** 2) / (2 * s * s)), 0, 255)
        x, y, size = max(kp.found_in(plane), key=lambda r: r[4])[:3]
        assert abs(x - 42.6) < 0.3 and abs(y - 37.3) < 0.3
        # the difference of layers a and ka peaks at a blob of s where a * a * k = s * s + CAMERA ** 2
        assert size == pytest.approx(2 * math.sqrt((s * s + 0.25) / 2 ** (1 / 3)), rel=0.08)


def test_edges_flat_planes_and_tiny_planes_have_none():
    edge = np.full((64, 64), 20.0)
    edge[:, 32:] = 220
    assert kp.found_in(edge) == [] and kp.found_in(np.full((50, 50), 9.0)) == [] and kp.found_in(np.zeros((15, 400))) == []


def test_turned_plane_has_turned_keypoints():
    plane = blobs().astype(float)
    there = kp.found_in(plane)
    back = kp.found_in(np.rot90(plane))
    assert len(there) == len(back) > 10
    for x, y, size, angle, response, octave, d in there:
        # a quarter turn takes (x, y) to (y, 64 - x) and an angle to itself less 90
        near = [r for r in back if abs(r[0] - y) < 1e-6 and abs(r[1] - (64 - x)) < 1e-6 and abs((r[3] - angle + 90 + 180) % 360 - 180) < 1e-4]
        assert len(near) == 1 and near[0][5] == octave
        assert near[0][2] == pytest.approx(size) and near[0][4] == pytest.approx(response)
        assert np.abs(near[0][6] - d).max() < 0.02 and np.linalg.norm(d) == pytest.approx(1, abs=1e-5)


def test_rows_of_planes(spark):
    planes = {5: blobs(), 6: blobs(), 7: None, 8: np.full((20, 20), 3, np.uint8)}
    rows = kp.keypoints(table(spark, planes).repartition(3), ["frame_no"]).collect()
    assert {r.frame_no for r in rows} == {5, 6}
    by = {f: sorted([r for r in rows if r.frame_no == f], key=lambda r: r.kp_id) for f in (5, 6)}
    assert [r.kp_id for r in by[5]] == list(range(len(by[5]))) and [r[1:] for r in by[5]] == [r[1:] for r in by[6]]
    plan = kp.keypoints(table(spark, planes), ["frame_no"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert kp.keypoints(table(spark, planes).limit(0), ["frame_no"]).count() == 0


def turned(plane, degrees, dx, dy):
    """The plane turned about its middle and moved, and the matrix that takes its points there."""
    from vidlake.operators.imaging import projected, sampled

    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    m = (len(plane) - 1) / 2
    h = np.array([[c, -s, m - c * m + s * m + dx], [s, c, m - s * m - c * m + dy], [0, 0, 1]])
    yy, xx = np.mgrid[0 : len(plane), 0 : len(plane)]
    at = projected(np.linalg.inv(h), np.c_[xx.ravel(), yy.ravel()])
    return np.rint(sampled(plane, at[:, 0], at[:, 1], 120)).astype(np.uint8).reshape(plane.shape), h


def test_matches_give_the_projection_back(spark):
    source = {k: blobs(129, 60, 10 + k) for k in range(3)}
    seen, h = turned(source[0], 20, 5, -3)
    a = kp.keypoints(table(spark, source), ["frame_no"])
    b = kp.keypoints(table(spark, {0: seen, 1: source[2]}), ["frame_no"])
    pairs = spark.createDataFrame([(10, 0, 0), (11, 1, 0), (12, 1, 1), (13, 2, 1), (14, 9, 1)], "pair_id long, frame0 int, frame1 int")
    points = kp.matches(pairs, a, b)
    found = {r.pair_id: r for r in hg.validated(hg.fitted(points, ["pair_id"])).collect()}
    assert found[10].valid and found[13].valid and 14 not in found
    assert all(k not in found or not found[k].valid for k in (11, 12))
    assert np.abs(np.array(found[10].homography).reshape(3, 3) - h).max() < 0.5
    assert np.abs(np.array(found[13].homography).reshape(3, 3) - np.eye(3)).max() < 1e-6


def test_mutual_matches_equal_loops():
    rng = np.random.default_rng(3)
    a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (rng.random((30, 128)), rng.random((25, 128))))
    b[:10] = a[5:15]
    b[3] = b[4]
    gap = lambda u, v: math.sqrt(max(0, 2 - 2 * float(u @ v)))
    want = []
    for i, u in enumerate(a):
        order = sorted(range(len(b)), key=lambda j: (gap(u, b[j]), j))
        j = order[0]
        if gap(u, b[j]) < 0.8 * gap(u, b[order[1]]) and min(range(len(a)), key=lambda k: (gap(a[k], b[j]), k)) == i:
            want.append((i, j))
    assert [tuple(m) for m in kp.mutual(a, b, 0.8).tolist()] == want and len(want) == 8
    assert len(kp.mutual(a[:0], b, 0.8)) == 0 and len(kp.mutual(a, b[:0], 0.8)) == 0


def test_read_out_through_a_projection(spark):
    rng = np.random.default_rng(8)
    plane = rng.integers(0, 256, (48, 64)).astype(np.uint8)
    moved = np.zeros((48, 64), np.uint8)
    moved[2:, 3:] = plane[:-2, :-3]
    shift = [1.0, 0.0, 3.0, 0.0, 1.0, 2.0, 0.0, 0.0, 1.0]
    rows = [(1, 48, 64, 48, 64, plane.tobytes(), None), (2, 48, 64, 48, 64, moved.tobytes(), shift), (3, 48, 64, 48, 64, None, shift), (4, 10, 10, 48, 64, moved.tobytes(), None)]
    frames = spark.createDataFrame(rows, "f int, src_height int, src_width int, height int, width int, y binary, homography array<double>")
    got = {(r.f, r.y0, r.x0): r for r in ro.aligned_cells(frames, ["f"], 16, 6, 4).collect()}
    assert {k[1:] for k in got if k[0] == 1} == {(y, x) for y in (0, 16, 32) for x in (0, 16, 32, 48)}
    assert {k[1:] for k in got if k[0] == 2} == {(y, x) for y in (0, 16) for x in (0, 16, 32)} and {k[0] for k in got} == {1, 2}
    for (f, y, x), r in got.items():
        assert r.aligned == (f == 2) and r.score == pytest.approx(got[1, y, x].score, rel=1e-9)
    assert ro.aligned_cells(frames.where(F.lit(False)), ["f"], 16, 6, 4).count() == 0


def test_carrier_on_keypoints_is_read_back(spark):
    from vidlake.plans import keypoint_plans as kq

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/supplier.parquet").count()
    r = kq.c8_keypoint_detect(spark, sf).first()
    assert r.carried == min(8, n // 2) and r.decoded == kq.BITS[: r.carried] and r.weakest > 0


def test_moved_clip_is_matched_to_its_own_frames(spark):
    from vidlake.plans import keypoint_plans as kq

    rows = kq.v1_own_matches(spark, "/root/testdata/sf0.001").collect()
    same = [r for r in rows if r.pair_id // 100_000 == r.pair_id % 100_000]
    assert not any(r.valid for r in rows if r not in same)
    for r in same:
        moved = r.pair_id % 100_000 % 3 > 0
        assert not r.valid or (abs(r.dx - 3 * moved) < 0.7 and abs(r.dy - 2 * moved) < 0.7)
    assert sum(r.valid for r in same) >= len(same) // 3
