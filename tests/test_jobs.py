"""Jobs and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidlake.__main__ import main, parser
from vidlake.operators import views
from vidlake.plans import fixtures as fx
from vidlake.plans import jobs
from vidlake.sources import providers as pr


def test_evaluate_with_stride(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    refs = spark.createDataFrame([(k, v[k].tolist()) for k in range(40)], "frame_no int, embedding array<double>")
    queries = spark.createDataFrame([("clean", k, k, v[k].tolist()) for k in range(40)], "condition string, q long, truth int, embedding array<double>")
    r = jobs.evaluate(refs, queries, topk=5, stride=2).collect()[0]
    assert (r["n_query"], r["top1"], r["median_true_rank"]) == (20, 1.0, 1.0)


def test_align_job_writes_every_frame(spark, tmp_path):
    rows = [(1, f, k, 100 + f + k, float(9 - k)) for f in range(5) for k in range(3)]
    candidates = spark.createDataFrame(rows, "leak_id long, leak_frame long, rank int, ref_pos int, combined double")
    candidates.write.parquet(f"{tmp_path}/c")
    assert main(["align", "--candidates", f"{tmp_path}/c", "--out", f"{tmp_path}/out"]) == 0
    records = [json.loads(r["value"]) for r in spark.read.text(f"{tmp_path}/out").collect()]
    assert len(records) == 5
    first = next(r for r in records if r["leak_frame"] == 0)
    assert first["estimated_original_frame"] == 100 and first["confidence"] == pytest.approx(0.2)
    assert first["candidate_frames"][:3] == [100, 101, 99] and first["candidate_temporal_scores"][:3] == [9.0, 8.0, 0.0]


def test_pixelation_accuracy_job(spark):
    halves = fx.half_pixelated(fx.planes(spark), 4)
    r = jobs.pixelation_accuracy(halves, "111", 2, 4).collect()[0]
    assert (r["counted"], r["correct"]) == (6, 6)


def test_views(spark):
    p = fx.planes(spark, 3, 16)
    same = views.frame_views(p, p.where("frame_no < 2")).collect()
    assert {(r["image"], r["share"]) for r in same} == {("frame_00000.png", 0.0), ("frame_00001.png", 0.0)}
    moved = views.frame_views(p, pr.quantised(p, 64), "approximation").collect()
    assert len(moved) == 3 and all(r["largest"] > 0 for r in moved)
    with pytest.raises(ValueError):
        views.frame_views(p, p, "none such")
    assert views.frame_views(p, p, lambda pairs: pairs.groupBy("frame_no").agg(F.count("*").alias("n"))).count() == 3


def test_command_line(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "j1_topk_ip" in capsys.readouterr().out
    assert main(["run", "none such", "--sf-dir", "/x"]) == 2
    assert parser().parse_args(["shortlist", "--top", "a", "--evidence", "b", "--truth", "c"]).ks == [1, 5, 10, 20, 50]
