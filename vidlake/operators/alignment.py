"""The position / velocity / uncertainty filter that maps a leaked stream to its original."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the filter.
GATE, PROCESS, MEASURE, SIGMA0, STREAK, JUMP = 3.0, 1.0, 4.0, 100.0, 3, 50.0
RADIUS = 5


@dataclass(frozen=True)
class State:
    pos: float | None = None
    vel: float = 0.0
    sigma: float = SIGMA0
    streak: int = 0


def step(state: State, candidates: list[tuple[int, float]]) -> State:
    """One frame, for batch and streaming form; ``candidates`` in rank order."""
    raw = float(max(candidates, key=lambda c: c[1])[0])
    top = max(c[1] for c in candidates)
    scale = top if top > 0 else 1.0
    if state.pos is None:
        return State(raw)
    pred, sp = state.pos + state.vel, state.sigma + PROCESS
    gate, off = GATE * sp**0.5, abs(raw - (state.pos + state.vel))
    streak = 0 if off <= gate else state.streak + 1
    if off > JUMP * gate or streak >= STREAK:
        return State(raw)
    inside = [c for c in candidates if abs(c[0] - pred) <= gate]
    best = max(inside, key=lambda c: c[1]) if inside else max(candidates, key=lambda c: c[1])
    r = MEASURE / max(best[1] / scale, 1e-3)
    gain = sp / (sp + r)
    gap = float(best[0]) - pred
    return replace(state, pos=pred + gain * gap, vel=state.vel + gain * gap, sigma=(1 - gain) * sp, streak=streak)


_MOVED = [("pos", T.DoubleType()), ("vel", T.DoubleType()), ("sigma", T.DoubleType()), ("streak", T.IntegerType()), ("raw_pos", T.LongType()), ("raw_score", T.DoubleType()), ("max_pos", T.LongType())]


def align(candidates: DataFrame, key: str = "leak_id", radius: int = RADIUS) -> DataFrame:
    """The filter over every stream, in frame order: one row a leaked frame.

    ``candidates`` has (key, leak_frame, rank, ref_pos, combined). Streams are
    dealt to tasks and sorted there; a task steps through its rows and holds
    one frame's candidates and one state, so time is linear in a stream and
    memory does not grow with it. A new key is a reset.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    order = [key, "leak_frame", "rank", "ref_pos", "combined"]
    rows = candidates.select(key, "leak_frame", "rank", F.col("ref_pos").cast("long").alias("ref_pos"), F.col("combined").cast("double").alias("combined"))
    ordered = rows.repartition(key).sortWithinPartitions(*order)
    schema = T.StructType(ordered.schema.fields[:2] + [T.StructField(n, t) for n, t in _MOVED])
    kinds = {T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, frame, out = None, State(), [], []

        def done() -> None:
            nonlocal state
            state = step(state, frame)
            raw = max(frame, key=lambda c: c[1])
            out.append((*at, state.pos, state.vel, state.sigma, state.streak, *raw, max(c[0] for c in frame)))
            frame.clear()

        def batch_of(types: list) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in schema.names]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        types: list = []
        for batch in batches:
            types = [batch.schema.field(0).type, batch.schema.field(1).type, *(kinds[t] for _, t in _MOVED)]
            for stream, number, ref_pos, combined in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if frame and at != (stream, number):
                    done()
                if at is None or at[0] != stream:
                    state = State()
                at = (stream, number)
                frame.append((ref_pos, combined))
            yield batch_of(types)
        if frame:
            done()
            yield batch_of(types)

    moved = ordered.mapInArrow(run, schema)
    return moved.select(
        key,
        "leak_frame",
        F.bround("pos", 0).cast("int").alias("estimated_original_frame"),
        (1.0 / (1.0 + F.col("sigma") / float(radius * radius))).alias("confidence"),
        F.col("raw_pos").alias("raw_visual_prediction"),
        F.col("raw_score").alias("raw_visual_score"),
        "pos",
        "vel",
        "sigma",
        "streak",
        "max_pos",
    )


def region(centre: Column, velocity: Column, radius: int, limit: Column) -> Column:
    """Positions within the radius, clipped to [0, limit), nearest first, the direction of travel first on ties.

    An empty range (the centre beyond all positions) is an empty array.
    """
    lo, hi = F.greatest(F.lit(0), centre - radius), F.least(limit - 1, centre + radius)
    ahead = velocity >= 0

    def key(p: Column) -> Column:
        d = p - centre
        return F.struct(F.abs(d).alias("a"), F.when((d >= 0) == ahead, 0).otherwise(1).alias("b"), p.alias("p"))

    spread = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array_sort(F.transform(spread, key)), lambda k: k.p)


def with_regions(aligned: DataFrame, candidates: DataFrame, key: str = "leak_id", radius: int = RADIUS, n_ref: int | None = None) -> DataFrame:
    """Ranked region and the visual score of each position in it; a repeated candidate counts by its last rank."""
    listed = candidates.groupBy(key, "leak_frame").agg(F.array_sort(F.collect_list(F.struct("rank", "ref_pos", "combined"))).alias("_c"))
    limit = F.lit(n_ref) if n_ref is not None else F.col("max_pos") + 1
    both = aligned.join(listed, [key, "leak_frame"]).withColumn("candidate_frames", region(F.col("estimated_original_frame"), F.col("vel"), radius, limit.cast("int")))
    score = lambda p: F.coalesce(F.aggregate("_c", F.lit(None).cast("double"), lambda s, c: F.when(c.ref_pos == p, c.combined.cast("double")).otherwise(s)), F.lit(0.0))
    return both.withColumn("candidate_temporal_scores", F.transform("candidate_frames", score)).drop("_c")
