"""Pixel statistics, encoders, degradation and scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import ramp
from ..operators import degrade as dg
from ..operators import detector as de
from ..operators import imaging as im
from ..operators import pixels as px
from ..operators import views
from ..sources import frames as src
from ..sources import providers as pr
from ..sources import sinks
from . import fixtures as fx
from .registry import query

N = 4
KEYS = ["frame_no", "half"]
HALVES = f"WITH {fx.clip_sql()}, {fx.half_pixelated_sql(N)}"


def _halves(spark, sf_dir, n=N):
    return fx.half_pixelated(fx.clip(spark, sf_dir), n)


def _profiles(spark, sf_dir, n=N):
    """Gradient profiles of the same halves, an array an axis, from packed planes: no row a pixel."""
    return de.profiles_packed(fx.packed_halves(fx.stored_clip(spark, sf_dir), n), KEYS)


def grads(table: str, keys: str = "frame_no, half") -> str:
    return f"""
g AS (SELECT {keys}, 'col' AS axis, x AS idx, abs(lead(v) OVER (PARTITION BY {keys}, y ORDER BY x) - v) AS d FROM {table}
  UNION ALL SELECT {keys}, 'row' AS axis, y AS idx, abs(lead(v) OVER (PARTITION BY {keys}, x ORDER BY y) - v) AS d FROM {table}),
prof AS (SELECT {keys}, axis, idx, avg(d) AS p FROM g WHERE d IS NOT NULL GROUP BY ALL),
lens AS (SELECT {keys}, axis, max(idx) + 1 AS len FROM prof GROUP BY ALL)"""


def ratios(profile: str, lens: str, n: str, keys: str = "frame_no, half", extra: str = "", more: str = "") -> str:
    """CTEs folded, by_axis (r) and ratio for period ``n`` over a profile table."""
    k = keys + more
    return f"""
folded AS (SELECT {k}, axis, idx % {n} AS phase, avg(p) AS p FROM {profile} JOIN {lens} USING ({keys}, axis) {extra} WHERE idx < (len // {n}) * {n} GROUP BY ALL),
by_axis AS (SELECT {k}, axis, max(CASE WHEN phase = {n} - 1 THEN p END) / (avg(CASE WHEN phase <> {n} - 1 THEN p END) + 1e-6) AS r FROM folded GROUP BY ALL),
ratio AS (SELECT {k}, max(CASE WHEN axis = 'col' THEN r END) AS ratio_cols, max(CASE WHEN axis = 'row' THEN r END) AS ratio_rows FROM by_axis GROUP BY ALL)"""


def ramp_sql(value: str, lo: float, hi: float) -> str:
    return f"least(1.0, greatest(0.0, ({value} - {lo}) / ({hi} - {lo})))"


@query("frame_no:i n:i", "SELECT vec_id AS frame_no, 1 AS n FROM embeddings WHERE vec_id % 3 = 0 ORDER BY vec_id LIMIT 50")
def s1_load_frames(spark, sf_dir):
    """Strided scan with a frame limit, which is the operator's own parameter."""
    frames = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_no"))
    return src.load_frames(frames, 3, 50).withColumn("n", F.lit(1))


@query("video_id:s frame_count:i width:i height:i", "SELECT CAST(user_id AS VARCHAR) AS video_id, count(*) AS frame_count, 1920 AS width, 1080 AS height FROM events GROUP BY user_id")
def s2_video_metadata(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return src.videos(e.select(F.col("user_id").cast("string").alias("video_id"), F.lit(1920).alias("width"), F.lit(1080).alias("height")))


_BGR = f"WITH {fx.clip_sql(32)}, bgr AS (SELECT frame_no, y, x, v AS b, (CAST(v AS INT) * 3 + x) % 256 AS g, (CAST(v AS INT) * 5 + y) % 256 AS r FROM pixels)"


def _bgr(spark, sf_dir):
    v = F.col("v").cast("int")
    return fx.clip(spark, sf_dir, 32).select("frame_no", "y", "x", F.col("v").alias("b"), ((v * 3 + F.col("x")) % 256).alias("g"), ((v * 5 + F.col("y")) % 256).alias("r"))


_YUV = "least(255, greatest(0, round_even({}, 0)))"


@query("frame_no:i y:i x:i yy:i uu:i vv:i", f"{_BGR}, l AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM bgr) SELECT frame_no, y, x, {_YUV.format('l')} AS yy, {_YUV.format('0.492::DOUBLE * (b - l) + 128')} AS uu, {_YUV.format('0.877::DOUBLE * (r - l) + 128')} AS vv FROM l")
def s3_colour_planes(spark, sf_dir):
    yuv = src.to_yuv(F.col("b"), F.col("g"), F.col("r"))
    return _bgr(spark, sf_dir).select("frame_no", "y", "x", *[c.alias(n) for c, n in zip(yuv, ("yy", "uu", "vv"), strict=True)])


_PAIR = f"WITH {fx.clip_sql(32)}, pairs AS (SELECT frame_no, y, x, v AS src, floor(v / 48) * 48 AS imp FROM pixels WHERE frame_no < (SELECT max(s_suppkey) FROM supplier))"


def _shorter(spark, sf_dir, pixels):
    """The clip without its last frame: a capture that ends first."""
    last = fx.table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0]
    return pixels.where(F.col("frame_no") < last)


def _pairs(spark, sf_dir):
    p = fx.clip(spark, sf_dir, 32)
    return src.paired(p, pr.quantised(_shorter(spark, sf_dir, p), 48))


@query("frame_no:i y:i x:i src:d imp:d", f"{_PAIR} SELECT * FROM pairs")
def s6_paired_scan(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("frame_no:i y:i x:i luma:d", f"{_BGR} SELECT frame_no, y, x, 0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r AS luma FROM bgr")
def s7_p1_grey(spark, sf_dir):
    return _bgr(spark, sf_dir).select("frame_no", "y", "x", px.luma(F.col("b"), F.col("g"), F.col("r")).alias("luma"))


@query("id:i name:s", "SELECT vec_id AS id, printf('frame_%05d.png', vec_id) AS name FROM embeddings")
def s8_image_names(spark, sf_dir):
    return fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sinks.image_name(F.col("vec_id")).alias("name"))


@query("line:s", "SELECT to_json({'leak_id': user_id, 'event_id': event_id, 'kind': event_type}) AS line FROM events")
def s9_json_lines(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return sinks.json_lines(e.select(F.col("user_id").alias("leak_id"), "event_id", F.col("event_type").alias("kind"), F.lit(0.1).alias("_timing_s")))


@query("doc:s", "SELECT to_json(json_object(event_type, {'n': count(*), 'users': count(DISTINCT user_id)})) AS doc FROM events GROUP BY event_type")
def s10_json_results(spark, sf_dir):
    m = fx.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return sinks.nested_results(m, "event_type")


@query("line:s", "SELECT printf('%-12s %7d', event_type, count(*)) AS line FROM events GROUP BY event_type")
def s11_report(spark, sf_dir):
    m = fx.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return sinks.report(m, [("event_type", "%-12s"), ("n", "%7d")])


@query("clip:i max_crf:i", "SELECT user_id AS clip, max(crf) FILTER (WHERE (user_id * 7 + crf) % 50 > 12) AS max_crf FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (VALUES (23), (28), (32), (36)) c(crf) GROUP BY user_id")
def s15_crf_sweep(spark, sf_dir):
    clips = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("clip")).distinct()
    runs = clips.withColumn("crf", F.explode(F.array(*map(F.lit, (23, 28, 32, 36)))))
    return runs.groupBy("clip").agg(F.max(F.when((F.col("clip") * 7 + F.col("crf")) % 50 > 12, F.col("crf"))).alias("max_crf"))


@query("frame_no:i y:i x:i diff:d panel:i", f"{_PAIR} SELECT frame_no, y, x, abs(src - imp) AS diff, CASE WHEN abs(src - imp) > 30 THEN 255 ELSE 0 END AS panel FROM pairs")
def g12_frame_difference(spark, sf_dir):
    return px.difference(_pairs(spark, sf_dir))


@query("frame_no:i image:s share:d largest:d", f"{_PAIR} SELECT frame_no, printf('frame_%05d.png', frame_no) AS image, avg(CASE WHEN abs(src - imp) > 30 THEN 1.0 ELSE 0.0 END) AS share, max(abs(src - imp)) AS largest FROM pairs GROUP BY frame_no")
def g13_frame_views(spark, sf_dir):
    p = fx.clip(spark, sf_dir, 32)
    return views.frame_views(p, pr.quantised(_shorter(spark, sf_dir, p), 48))


@query("id:i up:d down:d flat:d", f"SELECT event_id AS id, {ramp_sql('value', 20.0, 80.0)} AS up, {ramp_sql('value', 80.0, 20.0)} AS down, 0.0 AS flat FROM events")
def p2_ramp(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    v = F.col("value")
    return e.select(F.col("event_id").alias("id"), ramp(v, 20.0, 80.0).alias("up"), ramp(v, 80.0, 20.0).alias("down"), ramp(v, 5.0, 5.0).alias("flat"))


_PARTIAL = f"WITH {fx.clip_sql(50)}"


@query("frame_no:i n_blocks:i", f"{_PARTIAL} SELECT frame_no, count(DISTINCT (y // 8) * 100 + x // 8) AS n_blocks FROM pixels WHERE y < 48 AND x < 48 GROUP BY frame_no")
def p3_crop_to_blocks(spark, sf_dir):
    return px.block_variances(fx.clip(spark, sf_dir, 50), ["frame_no"], 8).groupBy("frame_no").agg(F.count("*").alias("n_blocks"))


@query("frame_no:i half:i axis:s idx:i p:d", f"{HALVES}, {grads('halves')} SELECT * FROM prof")
def p4_gradient_profiles(spark, sf_dir):
    return _profiles(spark, sf_dir).select(*KEYS, "axis", F.posexplode("profile").alias("idx", "p"))


@query("frame_no:i half:i axis:s phase:i p:d", f"{HALVES}, {grads('halves')}, {ratios('prof', 'lens', '4')} SELECT * FROM folded")
def p5_fold(spark, sf_dir):
    return _profiles(spark, sf_dir).select(*KEYS, "axis", F.posexplode(px.fold(F.col("profile"), F.lit(4))).alias("phase", "p"))


@query("frame_no:i half:i axis:s r:d", f"{HALVES}, {grads('halves')}, {ratios('prof', 'lens', '4')} SELECT * FROM by_axis")
def p6_boundary_ratio(spark, sf_dir):
    return _profiles(spark, sf_dir).select(*KEYS, "axis", px.boundary_ratio(F.col("profile"), F.lit(4)).alias("r"))


_SIZES = f"""{{ctes}}, {grads('halves')}, {ratios('prof', 'lens', 'c.n', extra='CROSS JOIN (VALUES (2), (4), (8), (16)) c(n)', more=', c.n')}"""
_SIZES = _SIZES.replace("phase = c.n", "phase = n").replace("phase <> c.n", "phase <> n").replace("SELECT frame_no, half, c.n, axis, max(", "SELECT frame_no, half, n, axis, max(").replace("SELECT frame_no, half, c.n, max(", "SELECT frame_no, half, n, max(")


def _estimate_sql(ctes: str) -> str:
    return f"""{_SIZES.format(ctes=ctes)}, r AS (SELECT frame_no, half, n, 0.5 * (ratio_cols + ratio_rows) AS ratio FROM ratio), m AS (SELECT *, max(ratio) OVER (PARTITION BY frame_no, half) AS best FROM r)
SELECT frame_no, half, min(n) AS block_size, min_by(ratio, n) AS ratio FROM m WHERE ratio >= 0.9 * best GROUP BY frame_no, half"""


@query("frame_no:i half:i block_size:i ratio:d", _estimate_sql(HALVES))
def p7_block_size(spark, sf_dir):
    return px.block_size_of_arrays(_profiles(spark, sf_dir), KEYS, (2, 4, 8, 16))


@query("n_true:i frame_no:i half:i block_size:i", "\nUNION ALL ".join(f"SELECT {n} AS n_true, frame_no, half, block_size FROM ({_estimate_sql(f'WITH {fx.clip_sql()}, {fx.half_pixelated_sql(n)}')}) e{n}" for n in (2, 4, 8, 16)))
def p18_check_block_size(spark, sf_dir):
    sizes = (2, 4, 8, 16)
    profiles = px.profiles_of(fx.half_pixelated_sizes(fx.clip(spark, sf_dir), sizes), KEYS, {n: f"w{n}" for n in sizes}, "n_true")
    return px.block_size_of(profiles, ["n_true", *KEYS], sizes)


def _var_sql(n: int, name: str) -> str:
    return f"{name} AS (SELECT frame_no, half, y // {n} AS by_, x // {n} AS bx, var_pop(v) AS variance FROM halves GROUP BY ALL)"


@query("frame_no:i half:i intra:d", f"{HALVES}, {_var_sql(8, 'b')} SELECT frame_no, half, avg(variance) AS intra FROM b GROUP BY ALL")
def p8_intra_block_variance(spark, sf_dir):
    return px.block_variances(_halves(spark, sf_dir), KEYS, 8).groupBy(*KEYS).agg(F.avg("variance").alias("intra"))


_VARIANCE = f"{_var_sql(N, 'fine')}, {_var_sql(2 * N, 'coarse_b')}, f AS (SELECT frame_no, half, avg(variance) AS intra FROM fine GROUP BY ALL), c AS (SELECT frame_no, half, avg(variance) AS coarse FROM coarse_b GROUP BY ALL), var_score AS (SELECT frame_no, half, intra / (coarse + 1e-6) AS variance_ratio, {ramp_sql('intra / (coarse + 1e-6)', 0.35, 0.05)} AS variance FROM f JOIN c USING (frame_no, half))"


@query("frame_no:i half:i variance_ratio:d variance:d", f"{HALVES}, {_VARIANCE} SELECT * FROM var_score")
def p9_variance_score(spark, sf_dir):
    return px.variance_score(_halves(spark, sf_dir), KEYS, N)


@query("frame_no:i half:i by:i bx:i variance:d", f'{HALVES}, {_var_sql(8, "b")} SELECT frame_no, half, by_ AS "by", bx, variance FROM b')
def p10_variance_map(spark, sf_dir):
    return px.block_variances(_halves(spark, sf_dir), KEYS, 8)


_GRADIENT = f"{grads('halves')}, {ratios('prof', 'lens', '4')}, grad_score AS (SELECT frame_no, half, 0.5 * (ratio_cols + ratio_rows) AS gradient_ratio, {ramp_sql('0.5 * (ratio_cols + ratio_rows)', 2.0, 6.0)} AS gradient FROM ratio)"


@query("frame_no:i half:i gradient_ratio:d gradient:d", f"{HALVES}, {_GRADIENT} SELECT * FROM grad_score")
def p11_gradient_score(spark, sf_dir):
    return px.gradient_score(_halves(spark, sf_dir), KEYS, N)


_LAPLACE = f"""
up AS (SELECT frame_no, half, y, x, v, coalesce(lag(v) OVER d, lead(v) OVER d) + coalesce(lead(v) OVER d, lag(v) OVER d) AS s FROM halves WINDOW d AS (PARTITION BY frame_no, half, x ORDER BY y)),
lap AS (SELECT frame_no, half, y, x, abs(2 * (coalesce(lag(s) OVER a, lead(s) OVER a) + coalesce(lead(s) OVER a, lag(s) OVER a)) - 8 * v) AS v FROM up WINDOW a AS (PARTITION BY frame_no, half, y ORDER BY x)),
lprof AS (SELECT frame_no, half, 'col' AS axis, x AS idx, avg(v) AS p FROM lap GROUP BY ALL UNION ALL SELECT frame_no, half, 'row' AS axis, y AS idx, avg(v) AS p FROM lap GROUP BY ALL),
llens AS (SELECT frame_no, half, axis, max(idx) + 1 AS len FROM lprof GROUP BY ALL),
{ratios('lprof', 'llens', '4').replace('folded', 'lfolded').replace('by_axis', 'lby_axis').replace('ratio AS', 'lratio AS')},
lap_score AS (SELECT frame_no, half, 0.5 * (ratio_cols + ratio_rows) AS laplacian_ratio, {ramp_sql('0.5 * (ratio_cols + ratio_rows)', 1.3, 2.2)} AS laplacian FROM lratio)"""


@query("frame_no:i half:i laplacian_ratio:d laplacian:d", f"{HALVES}, {_LAPLACE} SELECT * FROM lap_score")
def p12_laplacian_score(spark, sf_dir):
    return px.laplacian_score(_halves(spark, sf_dir), KEYS, N)


_FFT = f"""
centred AS (SELECT frame_no, half, axis, idx, p - avg(p) OVER w AS p, count(*) OVER w AS len FROM prof WINDOW w AS (PARTITION BY frame_no, half, axis)),
spec AS (SELECT frame_no, half, axis, len, k, sqrt(pow(sum(p * cos(2 * pi() * k * idx / len)), 2) + pow(sum(p * sin(2 * pi() * k * idx / len)), 2)) AS m FROM centred CROSS JOIN range(64) k(k) WHERE k <= len // 2 GROUP BY ALL),
bins AS (SELECT *, least(CAST(round_even(len / CAST({N} AS DOUBLE), 0) AS INT), len // 2) AS spot FROM spec),
around AS (SELECT frame_no, half, axis, len, median(m) FILTER (WHERE (k >= greatest(1, spot - greatest(8, spot // 8)) AND k < spot - 1) OR (k >= spot + 2 AND k < spot + greatest(8, spot // 8) + 1)) AS mid, max(m) FILTER (WHERE k = spot) AS peak FROM bins GROUP BY ALL),
fft_score AS (SELECT frame_no, half, coalesce(avg(CASE WHEN len >= 2 * {N} THEN peak / (mid + 1e-6) END), 1.0) AS fft_peak FROM around GROUP BY ALL)"""


@query("frame_no:i half:i fft_peak:d fft:d", f"{HALVES}, {grads('halves')}, {_FFT} SELECT *, {ramp_sql('fft_peak', 10.0, 30.0)} AS fft FROM fft_score")
def p13_fft_score(spark, sf_dir):
    return px.fft_score(_halves(spark, sf_dir), KEYS, N)


_NEIGHBOR = f"""
nax AS (SELECT frame_no, half, axis, avg(CASE WHEN idx % {N} = {N} - 1 THEN CAST(d < 1.5 AS INT) END) AS b, avg(CASE WHEN idx % {N} <> {N} - 1 THEN CAST(d < 1.5 AS INT) END) AS i FROM g WHERE d IS NOT NULL GROUP BY ALL),
nei_score AS (SELECT frame_no, half, avg(i) - avg(b) AS neighbor_excess, {ramp_sql('(avg(i) - avg(b))', 0.10, 0.35)} AS neighbor FROM nax GROUP BY ALL)"""


@query("frame_no:i half:i neighbor_excess:d neighbor:d", f"{HALVES}, {grads('halves')}, {_NEIGHBOR} SELECT * FROM nei_score")
def p15_neighbor_score(spark, sf_dir):
    return px.neighbor_score(_halves(spark, sf_dir), KEYS, N)


DETECT = f"""{HALVES}, {_GRADIENT}, {_VARIANCE}, {_LAPLACE}, {_FFT}, {_NEIGHBOR},
scored AS (SELECT frame_no, half, gradient, variance, laplacian, {ramp_sql('fft_peak', 10.0, 30.0)} AS fft, neighbor FROM grad_score JOIN var_score USING (frame_no, half) JOIN lap_score USING (frame_no, half) JOIN fft_score USING (frame_no, half) JOIN nei_score USING (frame_no, half)),
detected AS (SELECT *, least(1.0, greatest(0.0, gradient * 0.35 + variance * 0.35 + laplacian * 0.10 + fft * 0.08 + neighbor * 0.12)) AS confidence FROM scored)"""


@query("frame_no:i half:i gradient:d variance:d laplacian:d fft:d neighbor:d confidence:d", f"{DETECT} SELECT * FROM detected")
def p16_detect_pixelation(spark, sf_dir):
    """All five statistics in one pass over packed halves."""
    return de.detect_packed(fx.packed_halves(fx.stored_clip(spark, sf_dir), N), KEYS, N)


@query("frame_no:i half:i gradient:d variance:d laplacian:d fft:d neighbor:d confidence:d", f"{DETECT} SELECT * FROM detected")
def p16_detect_long_form(spark, sf_dir):
    """The same from long-form pixels, by sorts and aggregates."""
    return px.detect(_halves(spark, sf_dir), KEYS, N)


@query("frame_no:i left_conf:d right_conf:d", f"{DETECT} SELECT frame_no, max(CASE WHEN half = 0 THEN confidence END) AS left_conf, max(CASE WHEN half = 1 THEN confidence END) AS right_conf FROM detected GROUP BY frame_no")
def p17_half_confidences(spark, sf_dir):
    d = de.detect_packed(fx.packed_halves(fx.stored_clip(spark, sf_dir), N), KEYS, N)
    return d.groupBy("frame_no").agg(F.max(F.when(F.col("half") == 0, F.col("confidence"))).alias("left_conf"), F.max(F.when(F.col("half") == 1, F.col("confidence"))).alias("right_conf"))


_EPLANES = "eplanes AS (SELECT vec_id AS frame_no, (k - 1) // 8 AS y, (k - 1) % 8 AS x, CAST(least(255, greatest(0, CAST(trunc(128 + 400 * CAST(embedding[k] AS DOUBLE)) AS INT))) AS DOUBLE) AS v FROM embeddings CROSS JOIN range(1, 65) r(k))"


@query("frame_no:i intra:i", f"WITH {_EPLANES} SELECT frame_no, round(avg(variance) * 1024) AS intra FROM (SELECT frame_no, var_pop(v) AS variance FROM eplanes GROUP BY frame_no, y // 4, x // 4) GROUP BY frame_no")
def p8_variance_of_embedding_planes(spark, sf_dir):
    planes = src.embedding_planes(fx.table(spark, sf_dir, "embeddings"))
    return px.block_variances(planes, ["frame_no"], 4).groupBy("frame_no").agg(F.round(F.avg("variance") * 1024).alias("intra"))


_SSIM = f"""WITH {fx.clip_sql(32)},
pairs AS (SELECT a.frame_no, a.y, a.x, a.v AS a, CASE WHEN a.frame_no = 2 THEN 255 - b.v ELSE b.v END AS b FROM pixels a JOIN pixels b ON b.frame_no = a.frame_no + CASE WHEN a.frame_no = 1 THEN 0 ELSE 1 END AND b.y = a.y AND b.x = a.x),
r AS (SELECT frame_no, y, x, sum(a) OVER w AS sa, sum(b) OVER w AS sb, sum(a * a) OVER w AS saa, sum(b * b) OVER w AS sbb, sum(a * b) OVER w AS sab, count(*) OVER w AS n FROM pairs WINDOW w AS (PARTITION BY frame_no, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
s AS (SELECT frame_no, sum(sa) OVER w AS sa, sum(sb) OVER w AS sb, sum(saa) OVER w AS saa, sum(sbb) OVER w AS sbb, sum(sab) OVER w AS sab, sum(n) OVER w AS n FROM r WINDOW w AS (PARTITION BY frame_no, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
m AS (SELECT frame_no, sa / 49 AS ma, sb / 49 AS mb, 49.0 / 48 * (saa / 49 - pow(sa / 49, 2)) AS va, 49.0 / 48 * (sbb / 49 - pow(sb / 49, 2)) AS vb, 49.0 / 48 * (sab / 49 - sa / 49 * (sb / 49)) AS c FROM s WHERE n = 49)
SELECT frame_no, avg((2 * ma * mb + 6.5025) * (2 * c + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))) AS ssim, avg((2 * ma * mb + 6.5025) * (2 * c + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))) < 0.6 AS changed FROM m GROUP BY frame_no"""


@query("frame_no:i ssim:d changed:b", _SSIM)
def t9_scene_change(spark, sf_dir):
    clip = fx.stored_clip(spark, sf_dir, 32)
    # frame 3 is compared with frame 2 alone, and as its negative
    later = im.on_planes(clip, lambda video, frame, planes: 255 - planes if frame == 3 else planes).select(F.col("frame_no").alias("_f"), F.col("y").alias("b"))
    now = clip.select("frame_no", "height", "width", F.col("y").alias("a"), (F.col("frame_no") + F.when(F.col("frame_no") == 1, 0).otherwise(1)).alias("_f"))
    return px.ssim_packed(now.join(later.hint("merge"), "_f")).withColumn("changed", F.col("ssim") < 0.6)


@query("name:s perspective:d gamma:d exposure:d wb_b:d wb_r:d contrast:d vignette:d moire:d resample:d jpeg_quality:i", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([f"'{n}'"] + [f"{dg.condition(n)[k]}::DOUBLE" for k in ("perspective", "gamma", "exposure", "wb_b", "wb_r", "contrast", "vignette", "moire", "resample")] + [str(dg.condition(n)["jpeg_quality"])]) + ")" for n in dg.CONDITIONS) + ") t(name, perspective, gamma, exposure, wb_b, wb_r, contrast, vignette, moire, resample, jpeg_quality)")
def d_cfg_conditions(spark, sf_dir):
    return dg.conditions(spark)


_CFG = dg.condition("severe")
_SHADE = f"(1.0 - {_CFG['vignette']} * pow(least(1.0, sqrt(pow((x - 16.0) / 16.0, 2) + pow((y - 16.0) / 16.0, 2)) / sqrt(2.0)), 2))"


def _photo_sql(c: str, gain: float) -> str:
    return f"floor(least(255.0, greatest(0.0, ((pow({c} / 255.0, {_CFG['gamma']}) * {_CFG['exposure']} * {gain} - 0.5) * {_CFG['contrast']} + 0.5) * {_SHADE} * 255.0)))"


@query("frame_no:i y:i x:i b:i g:i r:i", f"{_BGR} SELECT frame_no, y, x, {_photo_sql('b', _CFG['wb_b'])} AS b, {_photo_sql('g', _CFG['wb_g'])} AS g, {_photo_sql('r', _CFG['wb_r'])} AS r FROM (SELECT frame_no, y, x, CAST(b AS DOUBLE) AS b, CAST(g AS DOUBLE) AS g, CAST(r AS DOUBLE) AS r FROM bgr)")
def d_photo(spark, sf_dir):
    rows = _bgr(spark, sf_dir)
    out = dg.photometric(F.col("b"), F.col("g"), F.col("r"), F.col("y"), F.col("x"), 32, 32, _CFG)
    return rows.select("frame_no", "y", "x", *[c.alias(n) for c, n in zip(out, "bgr", strict=True)])


@query(
    "frame_no:i y:i x:i v:i",
    f"WITH {fx.clip_sql(32)}, t AS (SELECT *, 0.3::DOUBLE + frame_no * 0.4::DOUBLE AS th, 0.2::DOUBLE + frame_no * 0.05::DOUBLE AS f FROM pixels), u AS (SELECT *, x * cos(th) + y * sin(th) AS u, y * cos(th) - x * sin(th) AS w FROM t) SELECT frame_no, y, x, floor(least(255.0, greatest(0.0, v * (1.0 + 0.14::DOUBLE * (sin(2 * pi() * f * u) * sin(2 * pi() * f * 0.97::DOUBLE * w)))))) AS v FROM u",
)
def d_moire(spark, sf_dir):
    p = fx.clip(spark, sf_dir, 32)
    return p.withColumn("v", dg.moire(F.col("v"), F.col("y"), F.col("x"), 0.14, 0.3 + F.col("frame_no") * 0.4, 0.2 + F.col("frame_no") * 0.05))


@query("frame_no:i y:i x:i v:d", f"WITH {fx.clip_sql(64)} SELECT frame_no, y // 4 AS y, x // 4 AS x, (avg(v) / 255.0 - 0.485) / 0.229 AS v FROM pixels GROUP BY ALL")
def e3_preprocess(spark, sf_dir):
    small = pr.area_mean(fx.clip(spark, sf_dir, 64), ["frame_no"], 4)
    return small.withColumn("v", pr.channel_normalised(F.col("v"), 0.485, 0.229))


_TILES = "WITH t AS (SELECT vec_id // 4 AS frame_no, vec_id % 4 AS tile, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2) AS e FROM embeddings), u AS (SELECT frame_no, tile, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-8)) AS e FROM t), j AS (SELECT frame_no, flatten(list(e ORDER BY tile)) AS e FROM u GROUP BY frame_no)"


@query("frame_no:i k:i x:d", f"{_TILES} SELECT frame_no, k - 1 AS k, e[k] / greatest(sqrt(list_dot_product(e, e)), 1e-8) AS x FROM j, LATERAL (SELECT unnest(range(1, len(e) + 1)) AS k)")
def e2_tiled_embedding(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    regions = e.select(F.floor(F.col("vec_id") / 4).alias("frame_no"), (F.col("vec_id") % 4).alias("tile"), F.transform("embedding", lambda x: x.cast("double") * 2).alias("embedding"))
    return pr.tiled(regions, ["frame_no"]).select("frame_no", F.posexplode("embedding").alias("k", "x"))


_TOKENS = f"""WITH c AS (SELECT vec_id // 5 AS frame_no, k, max(CASE WHEN vec_id % 5 = 0 THEN CAST(embedding[k] AS DOUBLE) END) AS c, avg(CASE WHEN vec_id % 5 > 0 THEN CAST(embedding[k] AS DOUBLE) END) AS a FROM embeddings CROSS JOIN range(1, 65) r(k) GROUP BY ALL),
l AS (SELECT frame_no, list(c ORDER BY k) AS c, list(a ORDER BY k) AS a FROM c GROUP BY frame_no),
u AS (SELECT frame_no, list_concat({fx.UNIT.format(v='c')}, {fx.UNIT.format(v='a')}) AS e FROM l)"""


@query("frame_no:i k:i x:d", f"{_TOKENS} SELECT frame_no, k - 1 AS k, e[k] / greatest(sqrt(list_dot_product(e, e)), 1e-8) AS x FROM u, LATERAL (SELECT unnest(range(1, len(e) + 1)) AS k)")
def e5_pooling(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    tokens = e.select(F.floor(F.col("vec_id") / 5).alias("frame_no"), (F.col("vec_id") % 5).alias("token"), "embedding")
    return pr.pooled(tokens, ["frame_no"], "cls_avg").select("frame_no", F.posexplode("embedding").alias("k", "x"))


_SIDE = 32
_HIGH = f"""WITH {fx.clip_sql(_SIDE)},
taps AS (SELECT k - 8 AS o, exp(-pow(k - 8, 2) / 8.0) AS t FROM range(17) r(k)),
kern AS (SELECT i.i AS to_, CASE WHEN abs(i.i + o) % {2 * _SIDE - 2} >= {_SIDE} THEN {2 * _SIDE - 2} - abs(i.i + o) % {2 * _SIDE - 2} ELSE abs(i.i + o) % {2 * _SIDE - 2} END AS spot, t / (SELECT sum(t) FROM taps) AS t FROM range({_SIDE}) i(i) CROSS JOIN taps),
across AS (SELECT frame_no, y, to_ AS x, sum(v * t) AS v FROM pixels JOIN kern ON x = spot GROUP BY ALL),
soft AS (SELECT frame_no, to_ AS y, x, sum(v * t) AS s FROM across JOIN kern ON y = spot GROUP BY ALL),
high AS (SELECT p.frame_no, p.y, p.x, p.v - s.s AS h FROM pixels p JOIN soft s USING (frame_no, y, x)),
mid AS (SELECT *, h - avg(h) OVER (PARTITION BY frame_no) AS c FROM high)
SELECT frame_no, y, x, c / greatest(sqrt(sum(c * c) OVER (PARTITION BY frame_no)), 1e-8) AS v FROM mid"""


@query("frame_no:i y:i x:i v:d", _HIGH)
def e7_pixel_encoder(spark, sf_dir):
    return pr.high_pass_packed(fx.stored_clip(spark, sf_dir, _SIDE))
