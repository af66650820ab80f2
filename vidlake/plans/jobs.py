"""Whole jobs behind the command line: retrieval evaluation, shortlist scoring, alignment, pixelation accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from ..operators import alignment as al
from ..operators import evaluation as ev
from ..operators import pixels as px
from ..operators import search as se
from ..operators import votes as vo
from ..sources import frames as src
from ..sources import sinks


def evaluate(refs: DataFrame, queries: DataFrame, topk: int = 10, stride: int = 1, max_frames: int | None = None) -> DataFrame:
    """Metrics and confusion radius by condition.

    ``refs``: (frame_no, embedding); ``queries``: (condition, q, truth,
    embedding), truth being a frame number. With a stride the reference keeps
    every such frame, and errors stay in original frame numbers.
    """
    kept = src.load_frames(refs, stride, max_frames)
    r = kept.select(F.col("frame_no").cast("long").alias("ref_id"), "frame_no", doubles("embedding").alias("vec"))
    q = queries.select("condition", "q", F.col("truth").cast("long").alias("truth"), doubles("embedding").alias("vec")).join(r.select(F.col("ref_id").alias("truth")), "truth", "left_semi")
    top = se.topk_inner_product(q, r, topk, ["condition"])
    metrics = ev.retrieval_metrics(top, q, r, ["condition"])
    return metrics.join(ev.confusion_radius(q, r, ["condition"]), "condition")


def evaluate_shortlist(top: DataFrame, evidence: DataFrame, truth: DataFrame, ks: list[int], min_matches: int = ev.MIN_MATCHES) -> DataFrame:
    """Five scores at every K by condition; ``top`` (condition, q, rank, ref_id), ``evidence`` one row a verified pair."""
    scored = ev.evidence_scores(se.shortlist_evidence(top, evidence, ["condition"]).withColumn("inlier_errs", F.coalesce("inlier_errs", F.array().cast("array<double>"))), min_matches)
    return ev.shortlist_rates(scored, truth, ks, ["condition"])


def align_to_json(candidates: DataFrame, path: str, radius: int = al.RADIUS, n_ref: int | None = None) -> int:
    """Alignment records as JSON lines; their count must equal the leaked frames'."""
    records = al.with_regions(al.align(candidates, radius=radius), candidates, radius=radius, n_ref=n_ref)
    public = records.select(
        "leak_id", "leak_frame", "estimated_original_frame", "candidate_frames", "candidate_temporal_scores", "confidence", "raw_visual_prediction", "raw_visual_score", F.col("estimated_original_frame").alias("temporal_adjusted_prediction")
    )
    expected = candidates.select("leak_id", "leak_frame").distinct().count()
    return sinks.write_json_lines(public, path, expected)


def pixelation_accuracy(halves: DataFrame, bits: str, redundancy: int, block: int) -> DataFrame:
    """Frame accuracy of a marked clip; ``halves``: long-form pixels (frame_no, half, y, x, v)."""
    found = px.detect(halves, ["frame_no", "half"], block)
    wide = found.groupBy("frame_no").agg(F.max(F.when(F.col("half") == 0, F.col("confidence"))).alias("left"), F.max(F.when(F.col("half") == 1, F.col("confidence"))).alias("right"))
    return vo.frame_accuracy(wide, bits, redundancy)
