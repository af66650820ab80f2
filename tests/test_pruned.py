"""The pruned search against the plain one."""

import numpy as np
import pytest

from vidlake.operators import pruned
from vidlake.operators import search as se

SCHEMA = "q long, vec array<double>"


def tables(spark, kind, rng):
    if kind == "clusters":
        centres = rng.normal(size=(12, 8)) * 5
        points = np.concatenate([c + rng.normal(size=(60, 8)) * 0.1 for c in centres])
    elif kind == "ties":
        points = rng.integers(-1, 2, (400, 4)).astype(float)
    else:
        points = rng.normal(size=(300, 8))
    asked = points[rng.permutation(len(points))[:90]] + (0 if kind == "ties" else 0.01)
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(asked)], SCHEMA), spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(points)], "ref_id long, vec array<double>")


@pytest.mark.parametrize("kind", ["clusters", "ties", "spread"])
@pytest.mark.parametrize("k", [1, 7])
def test_rows_equal_and_clusters_are_skipped(spark, monkeypatch, kind, k):
    monkeypatch.setattr(pruned, "MAP", 5)
    queries, refs = tables(spark, kind, np.random.default_rng(k))
    rows, counts = pruned.topk_pruned(queries, refs, k, size=30)
    want = {(r.q, r["rank"]): (r.ref_id, r.score) for r in se.topk_inner_product(queries, refs, k).collect()}
    got = {(r.q, r["rank"]): (r.ref_id, r.score) for r in rows.collect()}
    assert got.keys() == want.keys()
    assert all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], rel=1e-12) for x in want)
    n = counts.first()
    assert n.scored <= n.pairs
    if kind == "clusters":
        assert n.scored < 0.5 * n.pairs


def test_more_asked_than_there_are_and_empty_sides(spark):
    queries, refs = tables(spark, "spread", np.random.default_rng(0))
    few = refs.where("ref_id < 3")
    assert pruned.topk_pruned(queries, few, 5, size=2)[0].count() == 270
    assert pruned.topk_pruned(queries.limit(0), few, 5)[0].count() == 0
    assert pruned.topk_pruned(queries, refs.limit(0), 5)[0].count() == 0
