"""The packed detector against the long-form statistics, and block transforms against plain sums."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vidlake.operators import detector as de
from vidlake.operators import homography as hg
from vidlake.operators import pixels as px
from vidlake.operators import transforms as tr
from vidlake.plans.catalog import QUERIES


@pytest.mark.parametrize("shape, n", [((40, 56), 4), ((33, 47), 8), ((16, 16), 2), ((9, 30), 4), ((64, 64), 16)])
def test_packed_equals_long_form(spark, shape, n):
    rng = np.random.default_rng(n)
    planes = [rng.integers(0, 256, shape), np.kron(rng.integers(0, 256, (8, 16)), np.ones((9, 5)))[: shape[0], : shape[1]].astype(int)]
    planes = [p for p in planes if p.shape == shape]
    packed = spark.createDataFrame([(k, *shape, p.astype(np.uint8).tobytes()) for k, p in enumerate(planes)], "f int, height int, width int, y binary")
    cells = spark.createDataFrame([(k, y, x, float(p[y, x])) for k, p in enumerate(planes) for y in range(shape[0]) for x in range(shape[1])], "f int, y int, x int, v double")
    want = {r.f: r for r in px.detect(cells, ["f"], n).collect()}
    found = de.detect_packed(packed, ["f"], n).collect()
    assert len(found) == len(planes)
    for r in found:
        for c in (*de.NAMES, "confidence"):
            assert r[c] == pytest.approx(want[r.f][c], abs=1e-9), c


def test_packed_profiles_equal_long_form(spark):
    """Planes of several sizes in one batch, of one row, of one column and of one pixel; nothing is sorted or shuffled, no pixel becomes a row."""
    rng = np.random.default_rng(3)
    planes = {k: rng.integers(0, 256, s) for k, s in enumerate([(8, 12), (8, 12), (5, 3), (1, 9), (7, 1), (1, 1), (33, 47)])}
    packed = spark.createDataFrame([(k, *p.shape, p.astype(np.uint8).tobytes()) for k, p in planes.items()] + [(90, 4, 4, None), (91, 0, 5, b"")], "f int, height int, width int, y binary").coalesce(1)
    cells = spark.createDataFrame([(k, y, x, float(v)) for k, p in planes.items() for (y, x), v in np.ndenumerate(p)], "f int, y int, x int, v double")
    held = lambda df: {(r.f, r.axis): r.profile for r in df.collect()}
    found = de.profiles_packed(packed, ["f"])
    assert held(found) == held(px.as_arrays(px.gradient_profiles(cells, ["f"]), ["f"]))
    sizes = lambda df: {r.f: (r.block_size, r.ratio) for r in df.collect()}
    assert sizes(px.block_size_of_arrays(found.where("f < 3 or f = 6"), ["f"])) == sizes(px.block_size(cells.where("f < 3 or f = 6"), ["f"]))


@pytest.mark.parametrize("name", ["p4_gradient_profiles", "p5_fold", "p6_boundary_ratio", "p7_block_size"])
def test_profiles_sort_no_pixels(spark, name):
    """Each sorted the clip's pixels three times."""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no driver tables here")
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "sequence(0, 63" not in plan and plan.count("- Sort [") <= (name == "p7_block_size")


def test_packed_odd_planes_and_one_scan(spark):
    rows = [(1, 1, 8, b"\x05" * 8), (2, 3, 3, bytes(range(9))), (3, 8, 8, None), (4, 8, 8, b"\x07" * 64)]
    planes = spark.createDataFrame(rows, "f int, height int, width int, y binary")
    found = {r.f: r for r in de.detect_packed(planes, ["f"], 4).collect()}
    assert sorted(found) == [1, 2, 4] and found[1].confidence == 0.0
    assert all(0 <= r.confidence <= 1 for r in found.values())
    plan = de.detect_packed(planes, ["f"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_transforms_equal_sums_and_missing_cells_are_zero(spark):
    rng = np.random.default_rng(2)
    blocks = {k: rng.normal(size=(5, 5)) for k in range(3)}
    blocks[2][1:4] = 0
    rows = [(k, y, x, float(b[y, x])) for k, b in blocks.items() for y in range(5) for x in range(5) if b[y, x] != 0]
    cells = spark.createDataFrame(rows, "k int, y int, x int, v double")
    base = tr.basis(5)
    assert np.allclose(base @ base.T, np.eye(5))
    spectra = tr.dct2(cells, ["k"], 5)
    for r in spectra.collect():
        want = sum(blocks[r.k][y, x] * base[r.u, y] * base[r.w, x] for y in range(5) for x in range(5))
        assert r.c == pytest.approx(want, abs=1e-12)
    for r in tr.idct2(spectra, ["k"], 5).collect():
        assert r.v == pytest.approx(blocks[r.k][r.y, r.x], abs=1e-12)
    soft = {(r.k, r.y, r.x): r.v for r in tr.blurred(cells, ["k"], 5, 2).collect()}
    again = tr.idct2(spectra.where(tr.low_pass(F.col("u"), F.col("w"), 2) == 1.0), ["k"], 5).collect()
    assert len(again) == 75 and all(soft[r.k, r.y, r.x] == pytest.approx(r.v, abs=1e-12) for r in again)


def test_many_matches_and_validation(spark):
    rng = np.random.default_rng(5)
    a = rng.uniform(0, 900, (12_000, 2))
    h = np.array([[1.02, 0.03, 4], [-0.02, 0.97, 6], [1e-5, 2e-5, 1]])
    at = np.c_[a, np.ones(len(a))] @ h.T
    assert np.allclose(hg.solve(a, at[:, :2] / at[:, 2:]), h, atol=1e-6)
    rows = [(1, 30, 30, [1.0] * 30, True, [1.0] * 9), (2, 30, 19, [1.0] * 19, True, [1.0] * 9), (3, 30, 25, [5.0] * 25, True, [1.0] * 9), (4, 9, 0, [], False, None)]
    found = hg.validated(spark.createDataFrame(rows, "p int, num_matches int, num_inliers int, inlier_errs array<double>, homography_ok boolean, homography array<double>"))
    assert [(r.p, r.valid, r.homography is not None) for r in found.orderBy("p").collect()] == [(1, True, True), (2, False, False), (3, False, False), (4, False, False)]


def test_planes_of_one_size_are_measured_together(spark, monkeypatch):
    """Each half was measured by a call of its own. Sizes that alternate, a stack's border and a null plane; numbers stay with their planes."""
    from vidlake.plans import fixtures as fx
    from vidlake.sources import frames as src

    monkeypatch.setattr(src, "PIXELS", 3 * 24 * 32)
    rng = np.random.default_rng(8)
    shapes = [(24, 32)] * 7 + [(16, 40), (24, 32), (24, 33), (24, 33), (1, 8)]
    planes = [rng.integers(0, 256, s).astype(np.uint8) for s in shapes]
    batch = pa.RecordBatch.from_pydict({"height": [s[0] for s in shapes], "width": [s[1] for s in shapes], "y": [p.tobytes() for p in planes]})
    stacked = list(src.stacks(batch))
    assert [s.shape for s in stacked] == [(3, 24, 32), (3, 24, 32), (1, 24, 32), (1, 16, 40), (1, 24, 32), (2, 24, 33), (1, 1, 8)]
    assert all(np.array_equal(a, b) for a, b in zip((p for s in stacked for p in s), planes, strict=True))
    frames = spark.createDataFrame([("c", k, *p.shape, p.tobytes()) for k, p in enumerate(planes)], "video_id string, frame_no int, height int, width int, y binary").coalesce(1)
    found = {(r.frame_no, r.half): r for r in fx.packed_halves(frames, 4).collect()}
    assert len(found) == 2 * len(planes)
    for k, p in enumerate(planes):
        right = found[k, 1]
        assert bytes(right.y) == p[:, p.shape[1] // 2 :].tobytes() and (right.height, right.width) == (p.shape[0], p.shape[1] - p.shape[1] // 2)
        left = px.pixelated(spark.createDataFrame([(k, y, x, float(v)) for (y, x), v in np.ndenumerate(p)], "f int, y int, x int, v double"), ["f"], 4) if k in (3, 9) else None
        for r in left.where(f"x < {p.shape[1] // 2}").collect() if left else []:
            assert found[k, 0].y[r.y * (p.shape[1] // 2) + r.x] == r.v
    assert sorted((r.frame_no, r.y, r.x, r.v) for r in src.pixels_of(frames).collect()) == sorted((k, y, x, float(v)) for k, p in enumerate(planes) for (y, x), v in np.ndenumerate(p))
    whole = np.stack(planes[:7]).astype(float)
    together, each = de.measures(whole, 4), [de.measures(p[None], 4) for p in whole]
    assert all(np.allclose(v, [e[k][0] for e in each], atol=1e-12) for k, v in together.items())
