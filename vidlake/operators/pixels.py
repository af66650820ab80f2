"""Phase-referenced pixel statistics on long-form planes.

A plane is rows (keys..., y, x, v); all steps are grouped or windowed by the
keys, so frames spread over tasks and a frame's working set is its own pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ramp
from ..sources.frames import stacks

#: Candidate periods, weights, and (lo, hi) of each ramp.
CANDIDATES = (2, 4, 8, 16, 32)
WEIGHTS = {"gradient": 0.35, "variance": 0.35, "laplacian": 0.10, "fft": 0.08, "neighbor": 0.12}
RAMPS = {"gradient": (2.0, 6.0), "variance": (0.35, 0.05), "laplacian": (1.30, 2.20), "fft": (10.0, 30.0), "neighbor": (0.10, 0.35)}
FLAT = 1.5
EPS = 1e-6


def luma(b: Column, g: Column, r: Column) -> Column:
    """BT.601 luma of a BGR pixel."""
    return 0.114 * b + 0.587 * g + 0.299 * r


def by_axis(pixels: DataFrame, keys: list[str], measures: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Each pixel once for each axis, with the measures of that axis (across, down): (keys..., axis, idx, measures...)."""
    sides = [F.struct(F.lit(axis).alias("axis"), F.col(idx).alias("idx"), *(m[k].alias(name) for name, m in measures.items())) for k, (axis, idx) in enumerate((("col", "x"), ("row", "y")))]
    return pixels.select(*keys, F.explode(F.array(*sides)).alias("s")).select(*keys, "s.*")


def stencils(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """First differences (dx, dy) and the Laplacian (lap) of each pixel, all absolute, from one sort down and one across.

    The Laplacian is (2 0 2; 0 -8 0; 2 0 2) with edges mirrored without repeating the edge. What a caller does not select is not computed.
    """
    down, across = Window.partitionBy(*keys, "x").orderBy("y"), Window.partitionBy(*keys, "y").orderBy("x")
    above, below = F.lag("v").over(down), F.lead("v").over(down)
    rows = pixels.select(*keys, "y", "x", "v", F.abs(below - F.col("v")).alias("dy"), (F.coalesce(above, below) + F.coalesce(below, above)).alias("s"))
    left, right = F.lag("s").over(across), F.lead("s").over(across)
    lap = F.abs(2 * (F.coalesce(left, right) + F.coalesce(right, left)) - 8 * F.col("v"))
    return rows.select(*keys, "y", "x", F.abs(F.lead("v").over(across) - F.col("v")).alias("dx"), "dy", lap.alias("lap"))


def gradients(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Absolute first differences along both axes: (keys..., axis, idx, d)."""
    return by_axis(stencils(pixels, keys), keys, {"d": (F.col("dx"), F.col("dy"))}).where("d is not null")


def gradient_profiles(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean gradient at each offset of each axis: (keys..., axis, idx, p)."""
    return gradients(pixels, keys).groupBy(*keys, "axis", "idx").agg(F.avg("d").alias("p"))


def profiles_of(pixels: DataFrame, keys: list[str], versions: dict[int, str], name: str) -> DataFrame:
    """P4 of several versions of the same planes, one column each, from one sort an axis: (keys..., ``name``, axis, idx, p)."""
    across, down = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    steps = {f"_{axis}{n}": F.abs(F.lead(v).over(w) - F.col(v)) for n, v in versions.items() for axis, w in (("x", across), ("y", down))}
    both = pixels.select(*keys, "y", "x", *(d.alias(k) for k, d in steps.items()))
    rows = by_axis(both, keys, {f"d{n}": (F.col(f"_x{n}"), F.col(f"_y{n}")) for n in versions})
    means = rows.groupBy(*keys, "axis", "idx").agg(*(F.avg(f"d{n}").alias(f"p{n}") for n in versions))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias(name), F.col(f"p{n}").alias("p")) for n in versions)))
    return means.select(*keys, "axis", "idx", each.alias("s")).select(*keys, "axis", "idx", "s.*").where("p is not null")


def as_arrays(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """A profile as one array an axis, by offset."""
    return profiles.groupBy(*keys, "axis").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "p"))), lambda s: s.p).alias("profile"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once: what a lambda names twice is otherwise worked out twice."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold(profile: Column, n: Column) -> Column:
    """P5: mean of each phase over whole periods; null if there is none."""
    periods = F.floor(F.size(profile) / n).cast("int")
    phase = lambda k: F.aggregate(F.sequence(F.lit(0), periods - 1), F.lit(0.0), lambda s, j: s + F.element_at(profile, (j * n + k + 1).cast("int"))) / periods
    return F.when(periods >= 1, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), phase))


def boundary_ratio(profile: Column, n: Column) -> Column:
    """Energy at the block boundary over the mean inside; 1 where there is no inside or no whole period."""
    ratio = _bound(fold(profile, n), lambda f: F.element_at(f, n.cast("int")) / (_mean(F.slice(f, F.lit(1), (n - 1).cast("int"))) + EPS))
    return F.when((n >= 2) & (F.size(profile) >= n), ratio).otherwise(1.0)


def _axes(arrays: DataFrame, keys: list[str], measure: Column) -> DataFrame:
    col, row = (F.max(F.when(F.col("axis") == a, measure)) for a in ("col", "row"))
    return arrays.groupBy(*keys).agg(col.alias("ratio_cols"), row.alias("ratio_rows"))


def block_size(pixels: DataFrame, keys: list[str], candidates=CANDIDATES) -> DataFrame:
    """The least period within a tenth of the strongest contrast: (keys..., block_size, ratio)."""
    return block_size_of(gradient_profiles(pixels, keys), keys, candidates)


def block_size_of(profiles: DataFrame, keys: list[str], candidates=CANDIDATES) -> DataFrame:
    """P7 from gradient profiles."""
    return block_size_of_arrays(as_arrays(profiles, keys), keys, candidates)


def block_size_of_arrays(arrays: DataFrame, keys: list[str], candidates=CANDIDATES) -> DataFrame:
    """P7 from gradient profiles that are one array an axis."""
    arrays = arrays.withColumn("n", F.explode(F.array(*map(F.lit, candidates))))
    each = _axes(arrays.withColumn("r", boundary_ratio(F.col("profile"), F.col("n"))), [*keys, "n"], F.col("r"))
    each = each.withColumn("ratio", 0.5 * (F.col("ratio_cols") + F.col("ratio_rows")))
    best = F.max("ratio").over(Window.partitionBy(*keys)) if keys else F.max("ratio").over(Window.partitionBy(F.lit(0)))
    near = each.withColumn("best", best).where("ratio >= 0.9 * best")
    return near.groupBy(*keys).agg(F.min("n").alias("block_size"), F.min_by("ratio", "n").alias("ratio"))


def gradient_score(pixels: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Gradient concentration at period n."""
    arrays = as_arrays(gradient_profiles(pixels, keys), keys)
    both = _axes(arrays.withColumn("r", boundary_ratio(F.col("profile"), F.lit(n))), keys, F.col("r"))
    ratio = 0.5 * (F.col("ratio_cols") + F.col("ratio_rows"))
    return both.withColumns({"gradient_ratio": ratio, "gradient": ramp(ratio, *RAMPS["gradient"])})


def block_variances(pixels: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Population variance of every whole n x n block: (keys..., by, bx, variance)."""
    return variances_of_sizes(pixels, keys, (n,)).select(*keys, "by", "bx", "variance")


def variances_of_sizes(pixels: DataFrame, keys: list[str], sizes: tuple[int, ...]) -> DataFrame:
    """Variances of the whole blocks of several sizes in one pass: (keys..., _n, by, bx, variance).

    A plane's size is the largest place of its blocks, so that only blocks are gathered by plane, not pixels.
    """
    rows = pixels.withColumn("_n", F.explode(F.array(*map(F.lit, sizes))))
    at = {f"b{k}": F.floor(F.col(k) / F.col("_n")) for k in ("y", "x")}
    blocks = rows.groupBy(*keys, "_n", *(v.alias(k) for k, v in at.items())).agg(F.var_pop("v").alias("variance"), *(F.max(k).alias(f"_{k}") for k in ("y", "x")))
    size = Window.partitionBy(*keys)
    whole = blocks.withColumns({f"_{k}": F.max(f"_{k}").over(size) + 1 for k in ("y", "x")}).where("(by + 1) * _n <= _y and (bx + 1) * _n <= _x")
    return whole.drop("_y", "_x")


def variance_score(pixels: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Variance inside n blocks over that inside 2n blocks; 1 and score 0 where either is missing."""
    of = lambda side: F.avg(F.when(F.col("_n") == side, F.col("variance")))
    both = variances_of_sizes(pixels, keys, (n, 2 * n)).groupBy(*keys).agg(of(n).alias("intra"), of(2 * n).alias("coarse"))
    ratio = F.col("intra") / (F.col("coarse") + EPS)
    ok = F.col("coarse").isNotNull() & F.lit(n >= 2)
    return both.withColumns({"variance_ratio": F.when(ok, ratio).otherwise(1.0), "variance": F.when(ok, ramp(ratio, *RAMPS["variance"])).otherwise(0.0)})


def laplacian(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Absolute 3x3 Laplacian: (keys..., y, x, v)."""
    return stencils(pixels, keys).select(*keys, "y", "x", F.col("lap").alias("v"))


def laplacian_score(pixels: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The boundary ratio of mean |Laplacian| profiles over full width and height."""
    lap = laplacian(pixels, keys)
    profiles = by_axis(lap, keys, {"v": (F.col("v"), F.col("v"))}).groupBy(*keys, "axis", "idx").agg(F.avg("v").alias("p"))
    both = _axes(as_arrays(profiles, keys).withColumn("r", boundary_ratio(F.col("profile"), F.lit(n))), keys, F.col("r"))
    ratio = 0.5 * (F.col("ratio_cols") + F.col("ratio_rows"))
    return both.withColumns({"laplacian_ratio": ratio, "laplacian": ramp(ratio, *RAMPS["laplacian"])})


def spectrum(profile: Column) -> Column:
    """Magnitudes of the half spectrum of a demeaned profile, as sums of sines and cosines."""
    n = F.size(profile)
    centred = F.zip_with(profile, F.array_repeat(_mean(profile), n), lambda p, m: p - m)

    def sizes(centred: Column) -> Column:
        def size_at(k: Column) -> Column:
            angle = lambda j: F.lit(2.0) * F.pi() * k * j / n
            re = F.aggregate(F.transform(centred, lambda p, j: p * F.cos(angle(j))), F.lit(0.0), lambda s, x: s + x)
            im = F.aggregate(F.transform(centred, lambda p, j: p * F.sin(angle(j))), F.lit(0.0), lambda s, x: s + x)
            return F.sqrt(re * re + im * im)

        return F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int")), size_at)

    return _bound(centred, sizes)


def peaks(arrays: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys..., axis, peak): the grid's bin over the median of its neighbours (itself and the next ones aside).

    The spectrum is exploded once to rows; a profile too short, or a bin without neighbours, has a null peak.
    """
    size = F.col("size")
    rows = arrays.select(*keys, "axis", F.size("profile").alias("size"), F.posexplode_outer(spectrum(F.col("profile"))).alias("k", "m"))
    at = F.least(F.bround(size / F.lit(float(n)), 0).cast("int"), F.floor(size / 2).cast("int"))
    rows = rows.withColumn("at", at).withColumn("width", F.greatest(F.lit(8), F.floor(F.col("at") / 8).cast("int")))
    k, at, width = F.col("k"), F.col("at"), F.col("width")
    near = ((k >= F.greatest(F.lit(1), at - width)) & (k < at - 1)) | ((k >= at + 2) & (k < at + width + 1))
    found = rows.groupBy(*keys, "axis", "size").agg(F.max(F.when(k == at, F.col("m"))).alias("top"), F.percentile(F.when(near, F.col("m")), F.lit(0.5)).alias("floor"))
    return found.select(*keys, "axis", F.when(size >= 2 * n, F.col("top") / (F.col("floor") + EPS)).alias("peak"))


def fft_score(pixels: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Prominence of the grid's frequency, averaged over the axes; 1 where neither can tell."""
    arrays = as_arrays(gradient_profiles(pixels, keys), keys)
    found = peaks(arrays, keys, n).groupBy(*keys).agg(F.coalesce(F.avg("peak"), F.lit(1.0)).alias("fft_peak"))
    return found.withColumn("fft", ramp(F.col("fft_peak"), *RAMPS["fft"]))


def neighbor_score(pixels: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Share of flat neighbours inside blocks, less that across their boundaries."""
    flat = gradients(pixels, keys).select(*keys, "axis", (F.pmod("idx", F.lit(n)) == n - 1).alias("edge"), (F.col("d") < FLAT).cast("double").alias("flat"))
    axes = flat.groupBy(*keys, "axis").agg(F.avg(F.when(F.col("edge"), F.col("flat"))).alias("b"), F.avg(F.when(~F.col("edge"), F.col("flat"))).alias("i"))
    both = axes.groupBy(*keys).agg(F.avg("i").alias("interior_flatness"), F.avg("b").alias("boundary_flatness"))
    excess = F.col("interior_flatness") - F.col("boundary_flatness")
    return both.withColumns({"neighbor_excess": excess, "neighbor": ramp(excess, *RAMPS["neighbor"])})


def axis_measures(pixels: DataFrame, keys: list[str], n: int) -> DataFrame:
    """P11-P15 of each axis, from one pass: (keys..., axis, profile, gradient, laplacian, inside, edge).

    ``profile`` is the gradient profile and ``gradient`` its boundary ratio (null if the axis has no neighbours), ``laplacian`` the ratio
    of the mean |Laplacian|; ``inside`` and ``edge`` are shares of flat neighbours inside blocks and across their boundaries.
    """
    measures = {"d": (F.col("dx"), F.col("dy")), "lap": (F.col("lap"), F.col("lap"))}
    offsets = by_axis(stencils(pixels, keys), keys, measures).groupBy(*keys, "axis", "idx").agg(F.avg("d").alias("p"), F.avg("lap").alias("l"), F.count_if(F.col("d") < FLAT).alias("flat"), F.count("d").alias("all"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s.p)
    last = F.pmod("idx", F.lit(n)) == n - 1
    share = lambda here: F.try_divide(F.sum(F.when(here, F.col("flat"))), F.sum(F.when(here, F.col("all"))))
    arrays = offsets.groupBy(*keys, "axis").agg(listed(F.when(F.col("p").isNotNull(), F.struct("idx", "p"))).alias("profile"), listed(F.struct("idx", F.col("l").alias("p"))).alias("lap"), share(~last).alias("inside"), share(last).alias("edge"))
    arrays = arrays.withColumn("profile", F.when(F.size("profile") > 0, F.col("profile")))
    gradient = F.when(F.col("profile").isNotNull(), boundary_ratio(F.col("profile"), F.lit(n)))
    return arrays.select(*keys, "axis", "profile", gradient.alias("gradient"), boundary_ratio(F.col("lap"), F.lit(n)).alias("laplacian"), "inside", "edge")


def detect(pixels: DataFrame, keys: list[str], n: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Five scores at period n and their weighted mean, by key."""
    weights = WEIGHTS if weights is None else weights
    names = ["gradient", "variance", "laplacian", "fft", "neighbor"]
    lines = axis_measures(pixels, keys, n)
    # profiles and flat neighbours of an axis go along as keys of its spectrum
    kept = ["gradient", "laplacian", "inside", "edge"]
    axes = peaks(lines, [*keys, *kept], n)
    mean = {k: 0.5 * (F.max(F.when(F.col("axis") == "col", F.col(k))) + F.max(F.when(F.col("axis") == "row", F.col(k)))) for k in kept[:2]}
    raw = {**mean, "fft": F.coalesce(F.avg("peak"), F.lit(1.0)), "neighbor": F.avg("inside") - F.avg("edge")}
    found = axes.groupBy(*keys).agg(*(v.alias(k) for k, v in raw.items()), F.max("gradient").alias("_any")).where("_any is not null")
    found = found.select(*keys, *(ramp(F.col(k), *RAMPS[k]).alias(k) for k in raw))
    out = found.join(variance_score(pixels, keys, n).select(*keys, "variance").hint("merge"), keys).select(*keys, *names)
    total = sum(weights.get(k, 0.0) for k in names)
    mean = sum((F.col(k) * weights.get(k, 0.0) for k in names), F.lit(0.0)) / total if total else F.lit(0.0)
    return out.withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)))


def block_value(keys: list[str], n: int) -> Column:
    """C1 beside a pixel: the value that linear resampling takes at the centre of its n x n block.

    That is the rounded mean of the four middle pixels, or for odd n the middle one.
    """
    middle = [F.pmod(F.floor(F.col(c)), F.lit(n)).isin((n - 1) // 2, n // 2) for c in ("y", "x")]
    mean = F.avg(F.when(middle[0] & middle[1], F.col("v"))).over(Window.partitionBy(*keys, F.floor(F.col("y") / n), F.floor(F.col("x") / n)))
    return F.floor(mean + 0.5).cast("double")


def pixelated(pixels: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Every n x n block becomes the value at its centre."""
    return pixels.withColumn("v", block_value(keys, n))


def difference(pairs: DataFrame, threshold: float = 30) -> DataFrame:
    """Absolute difference of paired pixels and its threshold panel."""
    d = F.abs(F.col("src") - F.col("imp"))
    return pairs.withColumns({"diff": d, "panel": F.when(d > threshold, 255).otherwise(0)})


def ssim(pairs: DataFrame, keys: list[str], side: int = 7, span: float = 255.0) -> DataFrame:
    """Mean structural similarity of paired planes (a, b) over uniform side x side windows.

    Sums run along rows, then columns; covariance is the unbiased one of the
    published index, and only full windows count.
    """
    r = side // 2
    across = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(-r, r)
    down = Window.partitionBy(*keys, "x").orderBy("y").rowsBetween(-r, r)
    terms = {"sa": F.col("a"), "sb": F.col("b"), "saa": F.col("a") * F.col("a"), "sbb": F.col("b") * F.col("b"), "sab": F.col("a") * F.col("b")}
    rows = pairs.select(*keys, "y", "x", *[F.sum(v).over(across).alias(k) for k, v in terms.items()], F.count("*").over(across).alias("n"))
    sums = rows.select(*keys, *[F.sum(k).over(down).alias(k) for k in terms], F.sum("n").over(down).alias("n")).where(F.col("n") == side * side)
    n = float(side * side)
    ma, mb = F.col("sa") / n, F.col("sb") / n
    scale = n / (n - 1)
    va, vb, cov = scale * (F.col("saa") / n - ma * ma), scale * (F.col("sbb") / n - mb * mb), scale * (F.col("sab") / n - ma * mb)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    value = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return sums.groupBy(*keys).agg(F.avg(value).alias("ssim"))


def ssim_packed(pairs: DataFrame, side: int = 7, span: float = 255.0) -> DataFrame:
    """T9 from packed planes (frame_no, height, width, a, b), both of one size: (frame_no, ssim) as by ``ssim``; a plane without a full window gives no row."""
    n, c1, c2 = float(side * side), (0.01 * span) ** 2, (0.03 * span) ** 2

    def windows(v: np.ndarray) -> np.ndarray:
        total = np.pad(v, ((0, 0), (1, 0), (1, 0))).cumsum(1).cumsum(2)
        return total[:, side:, side:] - total[:, :-side, side:] - total[:, side:, :-side] + total[:, :-side, :-side]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            both = [stacks(batch.select(["height", "width", c]).rename_columns(["height", "width", "y"])) for c in ("a", "b")]
            for planes in zip(*both, strict=True):
                a, b = (p.astype(np.float64) for p in planes)
                at, first = np.arange(first, first + len(a)), first + len(a)
                if min(a.shape[1:]) < side:
                    continue
                ma, mb = windows(a) / n, windows(b) / n
                va, vb, cov = (n / (n - 1) * (windows(p) / n - q) for p, q in ((a * a, ma * ma), (b * b, mb * mb), (a * b, ma * mb)))
                value = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
                yield pa.RecordBatch.from_arrays([batch.column("frame_no").take(pa.array(at)), pa.array(value.mean((1, 2)))], names=["frame_no", "ssim"])

    kind = pairs.schema["frame_no"].dataType.simpleString()
    return pairs.where("a is not null and b is not null").select("frame_no", "height", "width", "a", "b").mapInArrow(run, f"frame_no {kind}, ssim double")
