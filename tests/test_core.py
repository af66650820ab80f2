"""Operators on hand-made inputs, and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vidlake.functions import scalars as sc
from vidlake.functions.vectors import dot, l2_normalised, median
from vidlake.operators import alignment as al
from vidlake.operators import carriers as ca
from vidlake.operators import degrade as dg
from vidlake.operators import evaluation as ev
from vidlake.operators import imaging as im
from vidlake.operators import patches as pa
from vidlake.operators import pixels as px
from vidlake.operators import search as se
from vidlake.operators import transforms as tr
from vidlake.operators import votes as vo
from vidlake.plans import fixtures as fx
from vidlake.plans.stream_plans import run_stream
from vidlake.sources import frames as src
from vidlake.sources import providers as pr
from vidlake.sources import sinks
from vidlake.streaming import aligner


def one(df):
    return df.collect()[0]


def test_vectors(spark):
    r = one(spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [4.0, 1.0, 9.0, 2.0], [])], "a array<double>, z array<double>, m array<double>, e array<double>").select(dot("a", "a"), l2_normalised(F.col("a")), l2_normalised(F.col("z")), median("m"), median("e")))
    assert list(r) == [25.0, [0.6, 0.8], [0.0, 0.0], 3.0, None]


@given(st.lists(st.lists(st.integers(0, 3), min_size=6, max_size=6), min_size=1, max_size=5), st.integers(1, 8))
def test_best_of_a_row_takes_low_columns_on_ties(rows, k):
    row, col, score = se.best_of(np.array(rows, dtype=float), k)
    found = sorted((int(r), -float(s), int(c)) for r, c, s in zip(row, col, score, strict=True))
    assert found == [x for i, r in enumerate(rows) for x in sorted((i, -float(s), j) for j, s in enumerate(r))[:k]]


def test_tile_side_grows_with_both_sides_within_bounds():
    assert se.tile_side(0, 0, 8) == se.tile_side(6000, 2000, 8) == se.BLOCK
    assert se.BLOCK < se.tile_side(50_000, 50_000, 8) < se.LARGEST_BLOCK == se.tile_side(10**9, 10**9, 1000)


def test_search_of_equal_vectors_keeps_k(spark):
    refs = spark.range(40).selectExpr("id as ref_id", "array(1D, 0D) as vec")
    queries = spark.range(1100).selectExpr("id as q", "array(cast(id as double), 1D) as vec")
    found = se.topk_inner_product(queries, refs, 3).collect()
    assert sorted((r.q, r["rank"], r.ref_id, r.score) for r in found) == [(q, k + 1, k, float(q)) for q in range(1100) for k in range(3)]


def test_blocked_search_equals_expression(spark):
    rng = np.random.default_rng(0)
    v = [(k, rng.integers(-3, 4, 8).astype(float).tolist()) for k in range(60)] + [(60 + k, [1.0] * 8) for k in range(5)]
    refs = spark.createDataFrame(v, "ref_id long, vec array<double>")
    queries = refs.select(F.col("ref_id").alias("q"), "vec")
    rank = lambda df: sorted((r["q"], r["rank"], r["ref_id"], round(r["score"], 9)) for r in df.collect())
    assert rank(se.topk_inner_product(queries, refs, 7, block=16)) == rank(se.topk_by_expression(queries, refs, 7))
    assert len(se.topk_inner_product(queries, refs, 500, block=16).collect()) == 65 * 65
    with pytest.raises(ValueError):
        se.build_index("other")


def test_metrics_with_missing_truth(spark):
    refs = spark.createDataFrame([(k, 10 * k, [0.0]) for k in range(5)], "ref_id long, frame_no long, vec array<double>")
    top = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (1, 1, 3), (1, 2, 4), (2, 1, 4), (2, 2, 2)], "q long, rank int, ref_id long")
    truth = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "q long, truth long")
    r = one(ev.retrieval_metrics(top, truth, refs))
    assert (r["n_query"], r["median_true_rank"], r["median_abs_err"]) == (3, 2.0, 20.0)
    assert r["top1"] == pytest.approx(1 / 3) and r["top5"] == pytest.approx(2 / 3)
    all_lost = ev.retrieval_metrics(top.where("q = 1"), truth, refs)
    assert one(all_lost)["median_true_rank"] == float("inf")


def test_pick_takes_first_of_equals(spark):
    rows = [(0, 1, 7, False, 3, 3), (0, 2, 8, False, 3, 3), (1, 1, 5, True, 20, 10), (1, 2, 6, True, 20, 10)]
    pairs = spark.createDataFrame([(q, k, r, ok, m, i, 100, 100, [1.0] * i) for q, k, r, ok, m, i in rows], "q long, rank int, ref_id long, homography_ok boolean, num_matches int, num_inliers int, n_kpts0 int, n_kpts1 int, inlier_errs array<double>")
    scored = ev.evidence_scores(pairs)
    best = ev.pick(ev.long_scores(scored, ["q", "rank", "ref_id"]), ["q", "method"])
    assert {(r["q"], r["ref_id"]) for r in best.collect()} == {(0, 7), (1, 5)}
    gated = scored.where("q = 0").collect()[0]
    assert gated["failed"] and gated["geometric_residual"] == float("inf") and gated["combined"] == 0.0


def simulate(frames):
    state, out = al.State(), []
    for candidates in frames:
        state = al.step(state, candidates)
        out.append(state)
    return out


SCRIPT = [
    [(100, 9.0), (50, 1.0)],
    [(101, 9.0)],
    [(102, 9.0), (102, 3.0)],
    [(160, 9.0), (103, 8.0)],
    [(104, 0.0), (9, 0.0)],
    [(400, 5.0)],
    [(401, 5.0)],
    [(402, 5.0)],
    [(5000, 5.0)],
    [(4999, 5.0)],
    [(4998, 5.0)],
    [(4997, 5.0)],
]


def long_form(streams):
    return [(key, f, k, p, s) for key, frames in streams.items() for f, c in enumerate(frames) for k, (p, s) in enumerate(c, 1)]


LEAK = "leak_id long, leak_frame long, rank int, ref_pos int, combined double"


def test_filter_fold_equals_plain_steps(spark):
    rng = np.random.default_rng(1)
    streams = {1: SCRIPT, 2: [[(int(p), float(s)) for p, s in zip(rng.integers(0, 300, 4), rng.integers(0, 9, 4), strict=True)] for _ in range(40)]}
    found = al.align(spark.createDataFrame(long_form(streams), LEAK)).collect()
    for key, frames in streams.items():
        rows = sorted((r for r in found if r["leak_id"] == key), key=lambda r: r["leak_frame"])
        want = simulate(frames)
        assert [(r["pos"], r["vel"], r["sigma"], r["streak"]) for r in rows] == [pytest.approx((s.pos, s.vel, s.sigma, s.streak)) for s in want]
        assert all(r["sigma"] > 0 and 0 < r["confidence"] <= 1 for r in rows)
    with pytest.raises(ValueError):
        al.align(spark.createDataFrame([], LEAK), radius=0)


def test_stream_equals_fold_and_ignores_late_frames(spark):
    c = spark.createDataFrame(long_form({1: SCRIPT, 2: SCRIPT[::-1]}), LEAK)
    batch = {(r["leak_id"], r["leak_frame"]): (r["estimated_original_frame"], round(r["sigma"], 9)) for r in al.align(c).collect()}
    stream = {(r["leak_id"], r["leak_frame"]): (r["estimated_original_frame"], round(r["sigma"], 9)) for r in run_stream(spark, aligner.frames_of(c)).collect()}
    assert stream == batch


def test_region_order(spark):
    df = spark.createDataFrame([(10, 1.0, 50), (10, -1.0, 50), (1, 0.0, 50), (49, 1.0, 50), (60, 1.0, 50)], "c int, v double, n int")
    got = [r["r"] for r in df.select(al.region(F.col("c"), F.col("v"), 2, F.col("n")).alias("r")).collect()]
    assert got == [[10, 11, 9, 12, 8], [10, 9, 11, 8, 12], [1, 2, 0, 3], [49, 48, 47], []]


def test_bits(spark):
    df = spark.createDataFrame([(8710,), (0,), (2**32 - 1,), (2**40,)], "n long")
    got = [tuple(r) for r in df.select(sc.bit_string(F.col("n")), sc.integer_to_hex(F.col("n")), sc.hex_to_bits(F.hex("n"))).collect()]
    assert got == [(f"{n:032b}", f"{n:08X}", f"{n & 0xFFFFFFFF:032b}") for n in (8710, 0, 2**32 - 1, 2**40)]


@pytest.mark.parametrize("width,split", [(1920, 1024), (640, 256), (1280, 512), (300, 256)])
def test_middle_split_rounds_half_to_even(spark, width, split):
    assert one(spark.range(1).select(sc.middle_split(F.lit(width), 256)))[0] == split == int(round(width / 2 / 256)) * 256


def plain_rotation(frames, side, documented):
    pool, out = [], []
    near = lambda c: any(abs(c[0] - p[0]) < side and abs(c[1] - p[1]) < side for p in pool)
    for c in frames:
        chosen = None
        for _ in range(2):
            for spot in c:
                if not near(spot):
                    chosen = spot
                    break
                if not documented:
                    pool.clear()
            if chosen:
                break
            pool.clear()
        pool.append(chosen)
        out.append(chosen)
    return out


@pytest.mark.parametrize("mode", ["as_written", "documented"])
def test_rotation_equals_plain_walk(spark, mode):
    rng = np.random.default_rng(2)
    runs = [[[(int(x), int(y)) for x, y in rng.integers(0, 60, (rng.integers(1, 6), 2))] for _ in range(6)] for _ in range(8)]
    rows = [(1, 6 * r + f, k, x, y, x, y) for r, frames in enumerate(runs) for f, c in enumerate(frames) for k, (x, y) in enumerate(c)]
    df = spark.createDataFrame(rows, "half int, frame_no int, ord int, x0 int, y0 int, cx int, cy int")
    found = {r["frame_no"]: (r["cx"], r["cy"]) for r in pa.select_rotating(df, ["half"], 6, 16, mode).collect()}
    want = {6 * r + f: spot for r, frames in enumerate(runs) for f, spot in enumerate(plain_rotation(frames, 16, mode == "documented"))}
    assert found == want
    with pytest.raises(ValueError):
        pa.select_rotating(df, ["half"], 6, 16, "other")


def test_middle_patches_outside_are_null(spark):
    sizes = spark.createDataFrame([(1920, 1080), (640, 480), (200, 900)], "width int, height int")
    left, right = pa.middle_patches(F.col("width"), F.col("height"))
    rows = [tuple(r) for r in sizes.select(left["x0"], left["y0"], right["x0"]).collect()]
    assert rows == [(768, 512, 1024), (None, None, None), (None, None, None)]


def plane_rows(spark, plane, frame=0):
    return spark.createDataFrame([(frame, int(y), int(x), float(v)) for (y, x), v in np.ndenumerate(plane)], "frame_no int, y int, x int, v double")


def test_detector_against_arrays(spark):
    rng = np.random.default_rng(3)
    small = rng.integers(0, 256, (8, 12)).astype(float)
    plane = np.kron(small, np.ones((4, 4)))
    p = plane_rows(spark, plane)
    r = one(px.detect(p, ["frame_no"], 4))
    assert r["confidence"] > 0.8
    assert one(px.block_size(p, ["frame_no"], (2, 4, 8)))["block_size"] == 4
    noise = plane_rows(spark, rng.integers(0, 256, (32, 48)).astype(float))
    assert one(px.detect(noise, ["frame_no"], 4))["confidence"] < 0.3
    col = np.abs(np.diff(plane, axis=1)).mean(axis=0)
    folded = col[: len(col) // 4 * 4].reshape(-1, 4).mean(axis=0)
    want = folded[3] / (np.delete(folded, 3).mean() + 1e-6)
    assert one(px.gradient_score(p, ["frame_no"], 4))["ratio_cols"] == pytest.approx(want)
    spectrum = np.abs(np.fft.rfft(col - col.mean()))
    arrays = px.as_arrays(px.gradient_profiles(p, ["frame_no"]), ["frame_no"]).where("axis = 'col'")
    assert one(arrays.select(px.spectrum(F.col("profile"))))[0] == pytest.approx(spectrum.tolist(), abs=1e-9)


def test_too_small_planes_have_neutral_scores(spark):
    tiny = plane_rows(spark, np.zeros((5, 5)))
    assert one(px.variance_score(tiny, ["frame_no"], 4))["variance_ratio"] == 1.0
    assert one(px.gradient_score(tiny, ["frame_no"], 8))["gradient_ratio"] == 1.0


def test_ssim_of_equal_planes_is_one(spark):
    p = plane_rows(spark, np.random.default_rng(4).integers(0, 256, (12, 12)).astype(float))
    pairs = p.select("frame_no", "y", "x", F.col("v").alias("a"), F.col("v").alias("b"))
    assert one(px.ssim(pairs, ["frame_no"]))["ssim"] == pytest.approx(1.0)


def test_transform_round_trip_and_energy(spark):
    plane = np.random.default_rng(5).normal(size=(8, 8))
    p = plane_rows(spark, plane)
    spectra = tr.dct2(p, ["frame_no"], 8)
    assert one(spectra.agg(F.sum(F.col("c") * F.col("c"))))[0] == pytest.approx((plane**2).sum())
    back = {(r["y"], r["x"]): r["v"] for r in tr.idct2(spectra, ["frame_no"], 8).collect()}
    assert all(back[k] == pytest.approx(v) for k, v in np.ndenumerate(plane))


def test_changed_approximation_moves_pixels_by_a_quarter(spark):
    p = plane_rows(spark, np.zeros((8, 8)))
    change = spark.createDataFrame([(0, 1, 1, 8.0)], "frame_no int, y int, x int, d double")
    moved = tr.with_ll(p, change, ["frame_no"])
    assert sorted({(r["y"] // 4, r["x"] // 4, r["v"]) for r in moved.collect()}) == [(0, 0, 0.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 2.0)]
    assert {(r["y"], r["x"]): r["v"] for r in tr.haar_ll(moved, ["frame_no"]).collect()}[1, 1] == 8.0


@pytest.mark.parametrize("impair", [1, 4])
def test_dc_payload_survives(spark, impair):
    picks = ca.selections(ca.cell_candidates(fx.frame_list(spark, 16), 16), 2, 16)
    chosen = ca.chosen_for_bits(picks, fx.frame_list(spark, 16), "10110010", 2)
    original = fx.planes(spark, 16).withColumn("v", F.col("v") / 2 + 40)
    marked = pr.quantised(ca.dc_embed(original, chosen, 16), impair)
    clean = pr.quantised(original, impair)
    r = ca.dc_responses(clean, marked, picks, 16).withColumns({"clip": F.lit(1), "bit_index": sc.slot_of(F.col("frame_no"), 2, 8)})
    got = one(vo.decode(vo.soft_slots(r, ["clip"], 8), ["clip"], F.lit(16), F.lit(2), 8))
    assert (got["decoded"], got["watermark"]) == ("10110010", 0b10110010)


def test_undecided_slots_give_no_number(spark):
    r = spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0)], "clip int, bit_index int, response double")
    got = one(vo.decode(vo.soft_slots(r, ["clip"], 4), ["clip"], F.lit(10), F.lit(5), 4))
    assert (got["votes"], got["decoded"], got["watermark"]) == ("1???", "1?", None)
    none = one(vo.decode(vo.soft_slots(r, ["clip"], 4), ["clip"], F.lit(3), F.lit(5), 4))
    assert (none["decoded"], none["watermark"], none["weakest"]) == ("", None, 0.0)


def test_coefficient_mark_is_found(spark):
    p = fx.planes(spark, 1).withColumn("v", F.col("v") / 2 + 60)
    r = one(ca.coefficient_scores(p, ca.coefficient_embed(p, ["frame_no"]), ["frame_no"]))
    assert r["score"] == pytest.approx(20.0, abs=0.5) and r["hits"] == r["blocks"]


def test_conditions():
    assert len(dg.CONDITIONS) == 11 and dg.condition("clean") == dg.DEFAULTS
    assert dg.condition("mild", gamma=2.0)["gamma"] == 2.0
    with pytest.raises(KeyError):
        dg.condition("none such")


def test_photometric_clean_is_identity(spark):
    rows = spark.createDataFrame([(b, 255 - b, b // 2) for b in range(256)], "b int, g int, r int")
    out = dg.photometric(F.col("b"), F.col("g"), F.col("r"), F.lit(3), F.lit(5), 32, 32, dg.condition("clean"))
    same = rows.select("*", *[c.alias(f"o{k}") for k, c in enumerate(out)])
    assert same.where("abs(b - o0) > 1 or abs(g - o1) > 1 or abs(r - o2) > 1").count() == 0


def test_image_operations():
    rng = np.random.default_rng(6)
    plane = rng.integers(0, 256, (40, 50)).astype(np.uint8)
    assert np.array_equal(im.warp_patch(plane, 5, 7, np.eye(3), 16), plane[7:23, 5:21])
    assert im.warp_patch(plane, 45, 7, np.eye(3), 16) is None
    quad = np.array([[0, 0], [49, 3], [45, 39], [2, 36]], float)
    h = im.homography_between(np.array([[0, 0], [50, 0], [50, 40], [0, 40]], float), quad)
    assert im.projected(h, np.array([[50.0, 40.0]]))[0] == pytest.approx([45, 39])
    clean = dg.condition("clean")
    assert np.array_equal(im.apply_optics(plane, clean, im.generator("s", 0, 1)), plane)
    a, b = (im.apply_optics(plane, dg.condition("severe"), im.generator("s", 3, 1)) for _ in range(2))
    assert np.array_equal(a, b) and not np.array_equal(a, im.apply_optics(plane, dg.condition("severe"), im.generator("s", 4, 1)))
    assert im.apply_geometry(plane, np.eye(3), clean, im.generator("s", 0, 1)).tolist() == plane.tolist()
    assert im.spectrum2d(plane.astype(float))[20, 25] == pytest.approx(0.0, abs=1e-6)


def test_encoders():
    plane = np.random.default_rng(7).integers(0, 256, (64, 64)).astype(np.uint8)
    v = pr.build_encoder("pixel").vectors(plane[None])[0]
    assert len(v) == 4096 and np.linalg.norm(v) == pytest.approx(1.0)
    assert np.linalg.norm(pr.high_pass_vector(np.full((8, 8), 9.0))) == 0.0
    assert pr.area_resize(np.arange(16.0).reshape(4, 4), 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]
    with pytest.raises(KeyError):
        pr.build_encoder("none such")
    with pytest.raises(pr.ProviderUnavailable):
        pr.build_encoder("sscd").vectors(plane[None])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.25)], "leak_frame int, kind string, _timing_s double")
    assert sinks.write_json_lines(df, f"file://{tmp_path}/lines", expected=2) == 2
    assert sorted(r["value"] for r in spark.read.text(f"file://{tmp_path}/lines").collect()) == ['{"leak_frame":1,"kind":"a"}', '{"leak_frame":2,"kind":"b"}']
    with pytest.raises(ValueError):
        sinks.write_json_lines(df, f"file://{tmp_path}/more", expected=3)
    with pytest.raises(ValueError):
        src.load_frames(df, 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 500), st.floats(0, 50)), min_size=1, max_size=5), min_size=1, max_size=20))
def test_filter_stays_sane(frames):
    for state in simulate(frames):
        assert 0 < state.sigma <= al.SIGMA0 + al.PROCESS and state.streak < al.STREAK


def test_a_long_stream_is_one_pass(spark):
    n = 20_000
    c = spark.range(n).selectExpr("1L AS leak_id", "id AS leak_frame", "1 AS rank", "id + 7 AS ref_pos", "1.0D AS combined")
    found = al.align(c.unionByName(c.selectExpr("leak_id", "leak_frame", "2 AS rank", "ref_pos + 900 AS ref_pos", "0.5D AS combined")))
    rows = found.orderBy("leak_frame").collect()
    assert len(rows) == n and all(abs(r["pos"] - r["leak_frame"] - 7) < 1 for r in rows) and rows[5]["max_pos"] == 912


def test_homography_is_found_among_wild_matches():
    import numpy as np

    from vidlake.operators import homography

    rng = np.random.default_rng(3)
    true = np.array([[1.02, 0.03, 4.0], [-0.02, 0.97, 6.0], [1e-4, 5e-5, 1.0]])
    a = rng.uniform(0, 500, (120, 2))
    at = np.column_stack([a, np.ones(120)]) @ true.T
    b = at[:, :2] / at[:, 2:] + rng.normal(0, 0.3, (120, 2))
    b[80:] += rng.uniform(40, 200, (40, 2))
    h, inside = homography.fit(a, b)
    assert inside[:80].all() and not inside[80:].any() and np.abs(h - true).max() < 0.5
    assert np.median(homography.errors(h, a, b)[inside]) < 1
    assert homography.fit(a[:3], b[:3])[0] is None
    flat = np.zeros((12, 2))
    assert homography.fit(flat, flat)[1].sum() in (0, 12)


@pytest.mark.parametrize("n", [2, 3, 4, 8])
def test_pixelation_samples_the_middle_of_a_block(spark, n):
    import numpy as np

    from vidlake.operators import pixels

    plane = np.random.default_rng(n).integers(0, 256, (2 * n, 3 * n)).astype(float)
    rows = [(0, y, x, float(plane[y, x])) for y in range(2 * n) for x in range(3 * n)]
    found = {(r["y"], r["x"]): r["v"] for r in pixels.pixelated(spark.createDataFrame(rows, "frame_no int, y int, x int, v double"), ["frame_no"], n).collect()}
    low, high = (n - 1) // 2, n // 2
    for (y, x), v in found.items():
        top, left = y // n * n, x // n * n
        middle = plane[top + low : top + high + 1, left + low : left + high + 1]
        assert v == np.floor(middle.mean() + 0.5)
