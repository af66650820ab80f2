"""Whole-table queries against plain Python, on more rows than the subsets of their SQL hold."""

import math
from collections import defaultdict

import numpy as np
import pytest

from vidlake.operators import search as se
from vidlake.plans.catalog import QUERIES

N = 4300


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    events = [(i, clip_of(i), float(i * i * 17 % 101)) for i in range(N)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").write.parquet(f"{at}/events.parquet")
    vectors = np.random.default_rng(3).normal(size=(70, 8)).astype(np.float32)
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").write.parquet(f"{at}/embeddings.parquet")
    return at


def clip_of(i):
    """The last clip has a few events only, so most of its slots get no vote."""
    return 99 if i % 1000 == 7 else i * 31 % 23


def rows(spark, sf, name):
    return sorted((tuple(r) for r in QUERIES[name](spark, sf).collect()), key=repr)


def test_every_frame_is_cut(spark, sf):
    sizes = [(i, 300 + i % 1700, 200 + i % 900) for i in range(N)]
    cells = [(i, r * (w // 256) + c, r * 256, c * 256, w) for i, w, h in sizes for r in range(h // 256) for c in range(w // 256)]
    assert rows(spark, sf, "g2_grid_whole") == sorted((c[:4] for c in cells), key=repr)
    assert rows(spark, sf, "g3_small_blocks_whole") == sorted(((i, (w // 8) * (h // 8), (h // 8 - 1) * 8, (w // 8 - 1) * 8) for i, w, h in sizes), key=repr)
    assert rows(spark, sf, "g7_grid_halves_whole") == sorted(((i, o, int(x0 + 256 >= w // 2)) for i, o, _, x0, w in cells), key=repr)
    assert rows(spark, sf, "g9_middle_split_whole") == sorted(((i, round(w / 512) * 256) for i, w, _ in sizes), key=repr)

    def middle(w, h):
        col, row = round(w / 512) * 256, round(h / 512) * 256
        right = col + 256 <= w and row + 256 <= h
        return col - 256 if col >= 256 and row + 256 <= h else None, col if right else None, row if right else None

    assert rows(spark, sf, "g10_middle_patches_whole") == sorted(((i, *middle(w, h)) for i, w, h in sizes), key=repr)


def test_every_keypoint_is_walked(spark, sf):
    frames = defaultdict(list)
    for i in range(N):
        frames[i % 97].append((-(i * 13 % 9), -(i * 7 % 100), i, i * 131 % 1920, i * 71 % 1080))
    spread = []
    for f, points in frames.items():
        kept = []
        for *_, x, y in sorted(points):
            if not any(abs(x - a) < 256 and abs(y - b) < 256 for a, b in kept):
                kept.append((x, y))
        spread += [(f, k, x, y) for k, (x, y) in enumerate(kept)]
    cut = [(f, k, y - 128, x - 128) for f, k, x, y in spread if 128 <= x <= 1792 and 128 <= y <= 952]
    assert rows(spark, sf, "g4_spread_points_whole") == sorted(spread, key=repr)
    assert rows(spark, sf, "g5_keypoint_patches_whole") == sorted(cut, key=repr)
    assert rows(spark, sf, "g6_keypoint_halves_whole") == sorted(((f, k, int(x0 > 960)) for f, k, _, x0 in cut if x0 + 256 <= 960 or x0 > 960), key=repr)


def test_every_vote_counts(spark, sf):
    given, clips = defaultdict(list), sorted({*map(clip_of, range(N))})
    for i in range(N):
        given[clip_of(i), i % 32].append(i * i * 17 % 101 - 50.0)

    def z(clip, slot):
        v = given[clip, slot]
        if not v:
            return None
        m = sum(v) / len(v)
        return m * math.sqrt(len(v)) / (math.sqrt(sum((x - m) ** 2 for x in v) / len(v)) + 1e-12)

    scores = {(c, b): z(c, b) for c in clips for b in range(32)}
    bit = {k: "?" if s is None else str(int(s > 0)) for k, s in scores.items()}
    assert rows(spark, sf, "a13_soft_votes_whole") == sorted(((*k, (s or 0) and (1 if s > 0 else -1), bit[k]) for k, s in scores.items()), key=repr)
    carried = {c: min(32, (40 + c % 200) // 5) for c in clips}
    decoded = {c: "".join(bit[c, b] for b in range(carried[c])) for c in clips}
    assert rows(spark, sf, "a14_decode_whole") == sorted(((c, carried[c], d, None if "?" in d else int(d, 2)) for c, d in decoded.items()), key=repr)
    weakest = dict(rows(spark, sf, "a15_weakest_slot_whole"))
    assert weakest == pytest.approx({c: min(abs(scores[c, b] or 0.0) for b in range(carried[c])) for c in clips}, abs=2e-6)


def test_every_query_is_scored(spark, sf):
    v = np.random.default_rng(3).normal(size=(70, 8)).astype(np.float32).astype(float)
    q = v + (np.arange(70) % 5 * 0.3)[:, None] * np.roll(v, -1, axis=0)
    scores = q / np.linalg.norm(q, axis=1, keepdims=True) @ v.T
    order = np.argsort(-scores, axis=1, kind="stable")

    def checked(name, want):
        found = {r[:-1]: r[-1] for r in rows(spark, sf, name)}
        assert found == pytest.approx(want, abs=2e-6)

    checked("j3_full_scores_whole", {(i, j): scores[i, j] for i in range(70) for j in range(70)})
    checked("j3_ranked_scores_whole", {(i, k + 1, int(j)): scores[i, j] for i in range(70) for k, j in enumerate(order[i])})
    checked("j2_topk_expression_whole", {(i, k + 1, int(j)): scores[i, j] for i in range(70) for k, j in enumerate(order[i][:3])})


def test_blocks_give_all_pairs(spark):
    side = spark.range(50).selectExpr("id AS q", "id AS ref_id", "array(double(id), 1D) AS vec")
    found = {(r["q"], r["ref_id"]): r["score"] for r in se.full_scores_in_blocks(side, side, 8).collect()}
    assert found == {(a, b): a * b + 1.0 for a in range(50) for b in range(50)}
