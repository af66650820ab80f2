"""Counts of stages and streams, and the filter on typed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as al
from ..operators import evaluation as ev
from ..operators import search as se
from ..sources import scratch
from ..streaming import aligner, lasting
from ..streaming import meter as mt
from . import fixtures as fx
from .registry import query
from .retrieval import _ALIGNED


@query(
    "stage:s n_rows:i n_queries:i timed:b",
    "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT stage, CASE WHEN stage = 'encode' THEN n ELSE n * least(n, 10) END AS n_rows, n AS n_queries, true AS timed FROM n, (VALUES ('encode'), ('search'), ('verify')) s(stage)",
)
def a9_stage_means(spark, sf_dir):
    """Encode, search and verify all frames: each stage's rows; that its mean time by query is known."""
    stages = mt.Stages(spark)
    asked = stages.run("encode", fx.degraded(spark, sf_dir))
    top = stages.run("search", se.topk_inner_product(asked, fx.reference(spark, sf_dir), 10))
    stages.run("verify", ev.evidence_scores(fx.evidence(top)))
    return stages.means(stages.seen[0][1]).withColumn("timed", F.col("ms_per_query") > 0)


_FRAMES = "(SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f FROM events)"


@query("n_asked:i n_answered:i n_late:i timed:b", f"SELECT count(*) + count(*) FILTER (WHERE f % 10 = 3) AS n_asked, count(*) AS n_answered, count(*) FILTER (WHERE f % 10 = 3) AS n_late, true AS timed FROM {_FRAMES}")
def t5_stream_counts(spark, sf_dir):
    """A stream that stops and starts again, with every tenth frame sent twice: what entered, was answered and came late."""
    source, sink, state = (scratch.folder(spark, n) for n in ("metered-in", "metered-out", "metered-state"))
    frames = aligner.frames_of(fx.leak_candidates(spark, sf_dir))
    meter = mt.Meter()
    spark.streams.addListener(meter)
    try:
        for part in (frames, frames.where(F.col("leak_frame") % 10 == 3)):
            part.write.mode("append").parquet(source)
            stream = mt.asked(spark.readStream.schema(frames.schema).parquet(source))
            run = mt.metered(aligner.align_stream(stream)).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
            run.awaitTermination()
            total = meter.of(run)
    finally:
        spark.streams.removeListener(meter)
    counted = (total["asked.n"], total["answered.n"], total["asked.n"] - total["answered.n"], total["ms"] > 0)
    return spark.createDataFrame([counted], "n_asked long, n_answered long, n_late long, timed boolean")


CUT = 8


@query("leak_id:i leak_frame:i estimated_original_frame:i confidence:d raw_visual_prediction:i vel:d sigma:d streak:i", f"{_ALIGNED} SELECT * FROM aligned")
def t2_lasting_stream(spark, sf_dir):
    """The first frames of each leaked stream by the batch filter, the rest by a stream that goes on from its states."""
    source, sink, state, seeds = (scratch.folder(spark, n) for n in ("lasting-in", "lasting-out", "lasting-state", "lasting-seeds"))
    leaks = fx.leak_candidates(spark, sf_dir)
    first = al.align(leaks.where(F.col("leak_frame") < CUT))
    lasting.states_of(first).write.parquet(seeds)
    rest = aligner.frames_of(leaks.where(F.col("leak_frame") >= CUT)).withColumn("seen_at", F.timestamp_seconds("leak_frame"))
    rest.write.parquet(source)
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    lasting.with_store(spark)
    try:
        stream = spark.readStream.schema(rest.schema).parquet(source)
        done = lasting.align_lasting(stream, spark.read.parquet(seeds), idle=86_400).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        done.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    columns = ["leak_id", "leak_frame", "estimated_original_frame", "confidence", "raw_visual_prediction", "vel", "sigma", "streak"]
    return first.select(*columns).unionByName(spark.read.schema(lasting.OUTPUT).parquet(sink).where(~F.col("closed")).select(*columns))
