"""Steps whose rows grow with the tables: nothing of their size goes through the driver or one task."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidlake.operators import carriers as ca
from vidlake.operators import imaging as im
from vidlake.operators import keypoints as kp
from vidlake.operators import patches as pt
from vidlake.operators import pixels as px
from vidlake.operators import search as se
from vidlake.operators import transforms as tr
from vidlake.plans import fixtures as fx
from vidlake.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")

#: Queries on the long-form clip; each broadcast its pixels, or what one task made of the whole clip, before.
PIXELS = """c2_pixelation_residual c3_pixelate_embed c6_dc_response c8_dc_detect c12_coefficient_scores c13_coefficient_verdict c20_replay_difference
p4_gradient_profiles p5_fold p6_boundary_ratio p7_block_size p8_intra_block_variance p10_variance_map p11_gradient_score p12_laplacian_score
p13_fft_score p15_neighbor_score p16_detect_long_form p18_check_block_size""".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PIXELS)
def test_pixels_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["c10_haar_ll", "e3_preprocess", "s3_unpack_planes", "p16_detect_pixelation", "k12_aligned_cells"])
def test_frames_are_dealt_before_they_are_planes(spark, name):
    """The table is one file, so without a deal one task makes every plane."""
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, SF))


def test_pairs_of_high_frame_numbers(spark, tmp_path):
    """A pair's number passed the int range from frame 21,475 on."""
    rows = [(30_000 + k, 3, 100.0 * k) for k in range(4)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    found = {r.pair_id: r for r in QUERIES["v1_own_matches"](spark, str(tmp_path)).collect()}
    own = [found.get(n * 100_000 + n) for n, *_ in rows]
    assert any(r is not None and r.num_matches for r in own)


def test_grid_extent_is_the_grids(spark):
    frames = spark.createDataFrame([(0, 24, 17), (1, 7, 90), (2, 8, 8), (3, 100, 5), (4, 65, 40)], "frame_no int, width int, height int")
    cells = pt.grid(frames, 8).groupBy("frame_no").agg(F.count("*").alias("n_blocks"), F.max("y0").alias("last_y"), F.max("x0").alias("last_x"))
    found = pt.grid_extent(frames, 8).select("frame_no", "n_blocks", "last_y", "last_x")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, cells.collect()))
    assert "Generate" not in plan(QUERIES["g3_small_blocks_whole"](spark, SF))


def test_keypoints_without_descriptors_are_the_same():
    """Queries that drop descriptors do not make them; the other fields are equal."""
    y, x = np.mgrid[0:48, 0:48]
    plane = 120 + 90.0 * (np.hypot(y - 20, x - 26) < 6) - 70.0 * (np.hypot(y - 34, x - 12) < 4)
    full, plain = kp.found_in(plane), kp.found_in(plane, describe=False)
    assert full and [r[:6] for r in full] == [r[:6] for r in plain] and {r[6] for r in plain} == {None}


def test_many_pairs_are_scored_in_blocks(spark, monkeypatch):
    side = spark.range(300).selectExpr("id AS q", "id AS ref_id", "transform(sequence(1, 8), k -> sin(id * 7.3 + k * k)) AS vec")
    q, r = side.select("q", "vec"), side.select("ref_id", "vec")
    few = se.topk_by_expression(q, r, 3)
    monkeypatch.setattr(se, "PAIRS", 1000)
    many = se.topk_by_expression(q, r, 3)
    assert "NestedLoop" not in plan(many) and "Cartesian" not in plan(many)
    held = lambda df: sorted((x.q, x.rank, x.ref_id, round(x.score, 9)) for x in df.collect())
    assert held(few) == held(many)
    assert "NestedLoop" not in plan(QUERIES["j3_full_scores"](spark, SF)) and "Cartesian" not in plan(QUERIES["j3_full_scores"](spark, SF))


def test_offsets_are_added_up_in_blocks(spark, monkeypatch):
    """Gaps, several vectors at a position, a block's border and negative positions; vectors are not sent once an offset."""
    monkeypatch.setattr(se, "SPAN", 7)
    ids = [-9, -8, -3, 0, 1, 2, 4, 4, 6, 7, 8, 13, 14, 15, 20, 21, 29]
    vectors = [[float((i * 7 + k) % 11), float(i % 5), 1.5] for k, i in enumerate(ids)]
    refs = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "ref_id long, vec array<double>")
    want = {}
    for d in range(1, 6):
        found = [sum(p * q for p, q in zip(v, w, strict=True)) for i, v in zip(ids, vectors, strict=True) for j, w in zip(ids, vectors, strict=True) if j == i + d]
        if found:
            want[d] = sum(found) / len(found)
    assert {r.d: r.s_self for r in se.offset_similarity(refs, 5).collect()} == pytest.approx(want)
    assert "Join" not in plan(se.offset_similarity(refs, 5))


def test_smooth_reference_in_blocks(spark, tmp_path, monkeypatch):
    """Blocks that meet at the ends, with gaps in the ids; a vector is not taken apart into cells."""
    monkeypatch.setattr(fx, "SPAN", 20)
    ids = [i for i in range(70) if i % 9 != 4]
    vectors = {i: np.float32(np.sin([i * 1.7, i * i + 1.0, 3.0 + i])) for i in ids}
    spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    n, want = len(ids), {}
    for i, v in vectors.items():
        for j in range(16):
            want[(i - j) % n] = want.get((i - j) % n, 0.0) + v.astype(float)
    smooth = fx.smooth_reference(spark, str(tmp_path))
    found = {r.ref_id: np.array(r.vec) for r in smooth.collect()}
    assert found.keys() == want.keys()
    assert all(np.allclose(found[k], v / max(np.linalg.norm(v), 1e-8)) for k, v in want.items())
    assert "posexplode" not in plan(smooth)


@pytest.mark.parametrize(("name", "most"), [("p16_detect_long_form", 7), ("p18_check_block_size", 7)])
def test_statistics_share_sorts(spark, name, most):
    """Each statistic (22 sorts) and each block size (16) sorted the pixels anew."""
    assert plan(QUERIES[name](spark, SF)).count("- Sort [") <= most


def test_halves_of_several_sizes_are_those_of_each(spark):
    clip = fx.clip(spark, SF)
    several = fx.half_pixelated_sizes(clip, (2, 4, 16))
    for n in (2, 4, 16):
        one = fx.half_pixelated(clip, n).select("frame_no", "half", "y", "x", "v")
        assert one.exceptAll(several.select("frame_no", "half", "y", "x", f"w{n}")).isEmpty()


def test_long_form_scores_are_those_of_each_statistic(spark):
    """Also of planes of one row, of one column, and smaller than a block."""
    shapes = {0: (16, 24), 1: (9, 13), 2: (1, 12), 3: (12, 1), 4: (3, 3), 5: (1, 1), 6: (8, 8)}
    cells = [(f, y, x, float((x * x * 3 + y * 5 + f) % 11)) for f, (h, w) in shapes.items() for y in range(h) for x in range(w)]
    p = spark.createDataFrame(cells, "f int, y int, x int, v double")
    parts = {"gradient": px.gradient_score, "variance": px.variance_score, "laplacian": px.laplacian_score, "fft": px.fft_score, "neighbor": px.neighbor_score}
    want = [{r.f: r[k] for r in score(p, ["f"], 4).collect()} for k, score in parts.items()]
    found = {r.f: r for r in px.detect(p, ["f"], 4).collect()}
    assert found.keys() == set.intersection(*(set(w) for w in want)) and {0, 1, 6} <= found.keys()
    for f, r in found.items():
        assert [r[k] for k in parts] == [pytest.approx(w[f]) for w in want]


def test_coefficient_planes_meet_by_frame(spark):
    """Both clips were shuffled and sorted by pixel. Only pixels of both planes count; a frame of one clip gives no row."""
    rng = np.random.default_rng(5)
    planes = {f: rng.uniform(50, 200, (64, 64)) for f in range(3)}
    marked = {f: p + rng.uniform(0, 9, p.shape) for f, p in planes.items() if f < 2}
    marked[1] = marked[1][:41, :50]
    rows = lambda held: spark.createDataFrame([(f, y, x, float(v)) for f, p in held.items() for (y, x), v in np.ndenumerate(p)], "frame_no int, y int, x int, v double")
    found = {r.frame_no: r for r in ca.coefficient_scores(rows(planes), rows(marked), ["frame_no"]).collect()}
    assert found.keys() == {0, 1}
    image = np.outer(tr.basis(8)[4], tr.basis(8)[5])
    for f, r in found.items():
        change = np.zeros((64, 64))
        h, w = marked[f].shape
        change[:h, :w] = marked[f] - planes[f][:h, :w]
        cells = change.reshape(16, 4, 16, 4).sum((1, 3)) / 4
        c = [(cells[y : y + 8, x : x + 8] * image).sum() for y in (0, 8) for x in (0, 8)]
        assert (r.blocks, r.hits) == (4, sum(v > 10 for v in c)) and r.score == pytest.approx(np.mean(c))
    assert plan(QUERIES["c13_coefficient_verdict"](spark, SF)).count("Exchange ") == 2


def test_cells_of_a_plane_are_read_at_once():
    """Each cell was warped by a call of its own; the patches and those that leave the frame are the same."""
    plane = np.arange(48 * 40, dtype=np.uint32).reshape(48, 40).astype(np.uint8)
    h = np.array([[1.01, 0.02, 3.0], [-0.01, 0.98, 2.0], [1e-4, 0.0, 1.0]])
    spots = np.array([(x, y) for y in range(0, 48, 16) for x in range(0, 48, 16)], float)
    stays, read = im.warp_patches(plane, spots, h, 16)
    each = [im.warp_patch(plane, x, y, h, 16) for x, y in spots]
    assert stays.tolist() == [p is not None for p in each] and 0 < stays.sum() < len(spots)
    assert all(np.array_equal(a, b) for a, b in zip(read, [p for p in each if p is not None], strict=True))
    assert im.warp_patches(plane, spots[:0], h, 16)[1].shape == (0, 16, 16)


def test_resized_difference_makes_planes_once(spark):
    """Both clips were made and paired once for each figure, and every pixel became a row; a plane without pixels gives no row."""
    assert plan(QUERIES["g12_resized_difference"](spark, SF)).count("Join ") == 1
    planes = [("c", 0, bytearray([3, 40, 7]), bytearray([0, 255, 0])), ("c", 1, bytearray(), bytearray()), ("c", 2, bytearray([0, 0]), bytearray([0, 0]))]
    found = im.difference_extent(spark.createDataFrame(planes, "video_id string, frame_no int, diff binary, panel binary")).collect()
    assert sorted((r.frame_no, r.changed, r.largest) for r in found) == [(0, 1, 40.0), (2, 0, 0.0)]


def test_residuals_of_packed_planes(spark):
    """C2 sorted all pixels by block; planes of two sizes in a batch, with cells and blocks cut at the edges."""
    assert "Window" not in plan(QUERIES["c2_pixelation_residual"](spark, SF))
    rng = np.random.default_rng(8)
    planes = {f: rng.integers(0, 256, s) for f, s in enumerate([(24, 37), (24, 37), (17, 16), (7, 40)])}
    packed = spark.createDataFrame([(f, *p.shape, p.astype(np.uint8).tobytes()) for f, p in planes.items()] + [(9, 8, 8, None)], "frame_no int, height int, width int, y binary").coalesce(1)
    rows = spark.createDataFrame([(f, y, x, float(v)) for f, p in planes.items() for (y, x), v in np.ndenumerate(p)], "frame_no int, y int, x int, v double")
    candidates = ca.cell_candidates(packed, 8)
    held = lambda df: {(r.frame_no, r.y0, r.x0): (r.half, r.ord, r.residual) for r in df.collect()}
    for n in (2, 4):
        found, want = held(ca.residuals_packed(packed, candidates, 8, n)), held(ca.residuals(rows, candidates, 8, n))
        assert len(found) == 12 + 12 + 4 and found.keys() == want.keys()
        assert all(found[k] == pytest.approx(want[k]) for k in want)
    with pytest.raises(ValueError):
        ca.residuals_packed(packed, candidates, 8, 3)


@pytest.mark.parametrize("n", [2, 3, 4])
def test_only_touched_blocks_are_flattened(spark, n):
    """C3 sorted all pixels; patches that begin and end inside a block or leave the plane, and a frame without one."""
    rng = np.random.default_rng(n)
    planes = {f: rng.integers(0, 256, (19, 22)).astype(float) for f in range(4)}
    rows = spark.createDataFrame([(f, y, x, float(v)) for f, p in planes.items() for (y, x), v in np.ndenumerate(p)], "frame_no int, y int, x int, v double")
    spots = {0: (5, 3), 1: (0, 0), 2: (14, 17)}
    chosen = spark.createDataFrame([(f, *s) for f, s in spots.items()], "frame_no int, y0 int, x0 int")
    flat = {(r.frame_no, r.y, r.x): r.v for r in px.pixelated(rows, ["frame_no"], n).collect()}
    want = {}
    for f, p in planes.items():
        for (y, x), v in np.ndenumerate(p):
            inside = f in spots and spots[f][0] <= y < spots[f][0] + 7 and spots[f][1] <= x < spots[f][1] + 7
            want[f, y, x] = (flat[f, y, x] if inside else v, v)
    found = ca.pixelate_embed(rows, chosen, 7, n, source="src").collect()
    assert len(found) == len(want) and {(r.frame_no, r.y, r.x): (r.v, r.src) for r in found} == want
    assert plan(QUERIES["c3_pixelate_embed"](spark, SF)).count("Window [avg") == 1


@pytest.mark.parametrize("name", ["c20_replay_difference", "c6_dc_response", "c8_dc_detect"])
def test_marked_pixels_bring_their_source(spark, name):
    """Both clips were made and shuffled by pixel to be paired."""
    text = plan(QUERIES[name](spark, SF))
    assert not re.search(r"Join \[frame_no#\d+, half#\d+, y#", text)


def test_responses_of_paired_pixels(spark):
    rng = np.random.default_rng(4)
    cells = [(f, y, x, float(rng.integers(0, 256))) for f in range(3) for y in range(16) for x in range(32)]
    original = spark.createDataFrame(cells, "frame_no int, y int, x int, v double")
    picks = spark.createDataFrame([(f, h, 4, 16 * h + 3) for f in range(3) for h in (0, 1) if (f, h) != (2, 1)], "frame_no int, half int, y0 int, x0 int")
    chosen = picks.where("half = frame_no % 2")
    leak = ca.dc_embed(original, chosen, 8)
    pairs = ca.dc_embed(original, chosen, 8, source="org").withColumnRenamed("v", "imp")
    held = lambda df: {r.frame_no: (r.left, r.right, r.response) for r in df.collect()}
    found, want = held(ca.paired_dc_responses(pairs, picks, 8)), held(ca.dc_responses(original, leak, picks, 8))
    assert found.keys() == want.keys() == {0, 1} and all(found[f] == pytest.approx(want[f]) for f in want)
