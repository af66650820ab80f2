"""Retrieval metrics and geometric-evidence scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import median, project
from .search import offset_similarity, prefixes, true_similarity

#: Fixed table: score, direction, worst value.
SCORE_METHODS = [("raw_inliers", "max", 0.0), ("inlier_ratio", "max", 0.0), ("match_density", "max", 0.0), ("geometric_residual", "min", float("inf")), ("combined", "max", 0.0)]
MIN_MATCHES = 10


def retrieval_metrics(top: DataFrame, truth: DataFrame, refs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A1-A4: hit rates, frame errors of the best match, median rank of the truth.

    ``top`` is ranked (q, rank, ref_id); ``truth`` (q, truth); ``refs`` gives
    frame_no by ref_id, so errors are in original frames. A truth that was not
    retrieved has an infinite rank.
    """
    by = by or []
    keys = [*by, "q"]
    joined = top.join(truth.select(*keys, "truth"), keys)
    per = joined.groupBy(*keys, "truth").agg(F.min(F.when(F.col("ref_id") == F.col("truth"), F.col("rank"))).alias("true_rank"), F.max(F.when(F.col("rank") == 1, F.col("ref_id"))).alias("best"))
    at = refs.select("ref_id", "frame_no")
    per = per.join(at.select(F.col("ref_id").alias("best"), F.col("frame_no").alias("_f")), "best").join(at.select(F.col("ref_id").alias("truth"), F.col("frame_no").alias("_t")), "truth")
    per = per.withColumn("err", F.abs(F.col("_f") - F.col("_t")).cast("double"))
    within = lambda k: F.avg(F.coalesce(F.col("true_rank") <= k, F.lit(False)).cast("double"))
    rank = F.coalesce(F.col("true_rank").cast("double"), F.lit(float("inf")))
    tolerances = [F.avg((F.col("err") <= t).cast("double")).alias(f"recall_pm{t}") for t in (1, 2, 5, 10)]
    return per.groupBy(*by).agg(
        F.count("*").alias("n_query"),
        *[within(k).alias(f"top{k}") for k in (1, 5, 10)],
        F.avg("err").alias("mean_abs_err"),
        F.percentile("err", F.lit(0.5)).alias("median_abs_err"),
        F.percentile("err", F.lit(0.9)).alias("p90_abs_err"),
        F.percentile(rank, F.lit(0.5)).alias("median_true_rank"),
        *tolerances,
    )


def confusion_radius(queries: DataFrame, refs: DataFrame, by: list[str] | None = None, max_offset: int = 60) -> DataFrame:
    """A5: s_true, s_self at fixed offsets, and the least d with s_self(d) <= s_true (-1 if none).

    The decay is one row an offset (at most ``max_offset``), so it is joined by broadcast.
    """
    by = by or []
    decay = offset_similarity(refs, max_offset)
    level = true_similarity(queries, refs, by)
    both = level.crossJoin(F.broadcast(decay))
    shown = [F.max(F.when(F.col("d") == d, F.col("s_self"))).alias(f"s_self_{d}") for d in (1, 2, 5, 10, 20, 40)]
    return both.groupBy(*by, "s_true").agg(*shown, F.coalesce(F.min(F.when(F.col("s_self") <= F.col("s_true"), F.col("d"))), F.lit(-1)).alias("d_star"))


def pair_score(pairs: DataFrame, min_matches: int = MIN_MATCHES) -> DataFrame:
    """V2-V3: (inliers, mean_error, ok) of a pair; the gate needs a model and ``min_matches``."""
    gate = F.col("homography_ok") & (F.col("num_matches") >= min_matches)
    mean = F.aggregate("inlier_errs", F.lit(0.0), lambda s, x: s + x) / F.size("inlier_errs")
    inliers = F.when(gate, F.col("num_inliers")).otherwise(0)
    return pairs.withColumns({"inliers": inliers.cast("float"), "mean_error": F.when(gate & (F.size("inlier_errs") > 0), mean).otherwise(F.lit(float("inf"))), "ok": gate & (F.col("num_inliers") >= min_matches)})


def evidence_scores(pairs: DataFrame, min_matches: int = MIN_MATCHES) -> DataFrame:
    """V4: the five scores of every pair from one evidence row; gated pairs get each method's worst."""
    gate = F.coalesce(F.col("homography_ok") & (F.col("num_matches") >= min_matches), F.lit(False))
    inliers, matches, middle = F.col("num_inliers").cast("double"), F.col("num_matches").cast("double"), median("inlier_errs")
    scores = {
        "raw_inliers": inliers,
        "inlier_ratio": F.when(matches > 0, inliers / matches).otherwise(0.0),
        "match_density": inliers / F.sqrt(F.greatest((F.col("n_kpts0") * F.col("n_kpts1")).cast("double"), F.lit(1.0))),
        "geometric_residual": F.coalesce(middle, F.lit(float("inf"))),
        "combined": F.coalesce(inliers / (1.0 + middle), F.lit(0.0)),
    }
    return pairs.withColumns({name: F.when(gate, scores[name]).otherwise(F.lit(worst)) for name, _, worst in SCORE_METHODS} | {"failed": ~gate})


def long_scores(scored: DataFrame, keep: list[str]) -> DataFrame:
    """One row a pair and method; ``value`` is larger-is-better for every method."""
    columns = [F.struct(F.lit(name).alias("method"), F.col(name).alias("score"), (F.col(name) if way == "max" else -F.col(name)).alias("value")) for name, way, _ in SCORE_METHODS]
    return scored.select(*keep, F.explode(F.array(*columns)).alias("_m")).select(*keep, "_m.*")


def pick(scores: DataFrame, keys: list[str]) -> DataFrame:
    """The best candidate by method; the first of equals, that is the lowest rank."""
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "rank"))
    return scores.withColumn("_place", order).where("_place = 1").drop("_place")


def shortlist_rates(scored: DataFrame, truth: DataFrame, ks: list[int], by: list[str]) -> DataFrame:
    """Per (by, k, method) recall, accuracy and the two kinds of failure, against the inlier count."""
    keys = [*by, "q"]
    long = long_scores(prefixes(scored, ks), [*keys, "k", "rank", "ref_id"])
    best = pick(long, [*keys, "k", "method"]).select(*keys, "k", "method", F.col("ref_id").alias("predicted"))
    target = truth.select(*keys, "truth")
    hits = prefixes(scored.select(*keys, "rank", "ref_id"), ks).join(target, keys).groupBy(*keys, "k", "truth").agg(F.max((F.col("ref_id") == F.col("truth")).cast("int")).alias("hit"))
    both = best.join(hits, [*keys, "k"]).withColumn("right", (F.col("predicted") == F.col("truth")).cast("int"))
    rates = both.groupBy(*by, "k", "method").agg(
        F.avg("hit").alias("stage1_recall"),
        F.avg("right").alias("stage2_top1"),
        F.avg(1 - F.col("hit")).alias("retrieval_failure"),
        F.avg(F.col("hit") * (1 - F.col("right"))).alias("verification_failure"),
    )
    base = F.max(F.when(F.col("method") == "raw_inliers", F.col("stage2_top1"))).over(Window.partitionBy(*by, "k"))
    return rates.withColumn("improvement", F.col("stage2_top1") - base)


def failed_share(scored: DataFrame, by: list[str]) -> DataFrame:
    """Pairs behind the gate, of all pairs."""
    return scored.groupBy(*by).agg(F.count_if("failed").alias("failed_pairs"), F.count("*").alias("pairs"), F.avg(F.col("failed").cast("double")).alias("fraction"))


def reprojection_error(points: DataFrame) -> DataFrame:
    """V1: distance of a matched point from its partner's projection through ``homography``."""
    px, py = project(F.col("homography"), F.col("x0"), F.col("y0"))
    return points.withColumn("error", F.sqrt(F.pow(px - F.col("x1"), 2) + F.pow(py - F.col("y1"), 2)))


def valid_homography(points: DataFrame, key: str, max_error: float = 5.0, min_inliers: int = 20) -> DataFrame:
    """V6: a model stands with enough inliers and a mean inlier error under the limit."""
    inlier = F.col("inlier")
    found = reprojection_error(points).groupBy(key).agg(F.count_if(inlier).alias("n_inliers"), F.avg(F.when(inlier, F.col("error"))).alias("mean_error"))
    return found.withColumn("valid", F.coalesce((F.col("n_inliers") >= min_inliers) & (F.col("mean_error") < max_error), F.lit(False)))


def inside_frame(h: Column, x: Column, y: Column, side: int, width: Column, height: Column, tolerance: float = 1.0) -> Column:
    """Whether a square's projected corners stay within the frame, give or take the tolerance."""
    corners = [project(h, x + dx, y + dy) for dx in (0, side) for dy in (0, side)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return (F.least(*xs) >= -tolerance) & (F.least(*ys) >= -tolerance) & (F.greatest(*xs) <= width - 1 + tolerance) & (F.greatest(*ys) <= height - 1 + tolerance)
