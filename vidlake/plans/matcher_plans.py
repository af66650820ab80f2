"""The matcher's own stream over leaks made of ``events`` (which frame, when) and ``embeddings`` (how it looks)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalised, plus
from ..sources import scratch
from ..streaming import aligner as sa
from ..streaming import matcher as sm
from . import fixtures as fx
from .registry import query
from .retrieval import _ALIGNED

K = 5


def leaked_frames(spark, sf_dir):
    """leak_id, leak_frame, q, vec: a user's n-th event shows the frame n + user % 50 + 100, at times 60 further, blended with the next."""
    refs = fx.reference(spark, sf_dir).select("ref_id", "vec")
    n = F.lit(refs.count())
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("leak_id"), order.cast("long").alias("leak_frame"), F.col("event_id").alias("q"))
    jump = F.when(F.col("q") % 29 < 4, 60).otherwise(0)
    shown = e.withColumn("ref_id", F.pmod(F.col("leak_frame") + F.col("leak_id") % 50 + 100 + jump, n))
    # a frame and its blend make few vectors, which are made once; events bring only their numbers to them
    share = F.pmod("q", F.lit(5))
    both = refs.join(refs.select(F.col("ref_id").alias("_next"), F.col("vec").alias("_b")), F.pmod(F.col("ref_id") + 1, n) == F.col("_next"))
    blends = both.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(4)))).select("ref_id", F.col("_share").cast("long").alias("_share"), plus("vec", "_b", F.col("_share") * 0.3).alias("v"))
    views = blends.select("ref_id", "_share", l2_normalised(F.col("v")).alias("vec"))
    return shown.withColumn("_share", share.cast("long")).join(views, ["ref_id", "_share"]).select("leak_id", "leak_frame", "q", "vec")


_LEAKS = f"""{fx.REFERENCE},
shown AS (SELECT leak_id, leak_frame, q, (leak_frame + leak_id % 50 + 100 + CASE WHEN q % 29 < 4 THEN 60 ELSE 0 END) % n.n AS ref_id
  FROM (SELECT user_id AS leak_id, event_id AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS leak_frame FROM events), n),
mixed AS (SELECT s.q, list_transform(list_zip(a.vec, b.vec), lambda p: p[1] + ((s.q % 5) * 0.3::DOUBLE) * p[2]) AS v FROM shown s CROSS JOIN n JOIN refs a ON a.ref_id = s.ref_id JOIN refs b ON b.ref_id = (s.ref_id + 1) % n.n),
queries AS (SELECT q, {fx.UNIT.format(v='v')} AS vec FROM mixed),
{fx.topk_sql('refs', K)}, {fx.evidence_sql()}, {fx.SCORES_SQL},
leaks AS (SELECT f.leak_id, f.leak_frame, s.rank, s.ref_id AS ref_pos, s.combined, s.q FROM scores s JOIN shown f ON f.q = s.q)"""


def _streamed(spark, sf_dir, build, columns: str):
    """Feed the leaks in two halves, each to a query of its own on one checkpoint: the second goes on in mid-stream."""
    source, sink, state, staged = (scratch.folder(spark, n) for n in ("leaks", "matched", "state", "blocks"))
    reference = sm.stage_reference(fx.reference(spark, sf_dir), staged)
    frames = leaked_frames(spark, sf_dir)
    late = F.col("leak_frame") >= 40
    for half in (~late, late):
        frames.where(half).write.mode("append").parquet(source)
        stream = spark.readStream.schema("leak_id long, leak_frame long, q long, vec array<double>").parquet(source)
        build(stream, reference).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(columns).parquet(sink)


@query("leak_id:i leak_frame:i q:i rank:i ref_id:i score:d", f"WITH {_LEAKS} SELECT l.leak_id, l.leak_frame, l.q, l.rank, l.ref_pos AS ref_id, t.score FROM leaks l JOIN top t ON t.q = l.q AND t.ref_id = l.ref_pos")
def t1_matcher_stream(spark, sf_dir):
    """Search of streamed frames against staged reference blocks."""
    return _streamed(spark, sf_dir, lambda s, r: sm.match_stream(s, r, K), sm.RANKED)


@query("leak_id:i leak_frame:i estimated_original_frame:i confidence:d raw_visual_prediction:i vel:d sigma:d streak:i", f"{_ALIGNED.replace(fx.LEAKS, _LEAKS)} SELECT * FROM aligned")
def t4_own_matcher_stream(spark, sf_dir):
    """Frames to aligned positions in one stream, resumed in the middle of every leak; equal to batch search, evidence and filter."""
    return _streamed(spark, sf_dir, lambda s, r: sm.aligner(frames=s, reference=r, evidence=fx.evidence, k=K), sa.OUTPUT)
