"""The alignment filter over a stream: state by leaked stream, kept between micro-batches.

Each micro-batch may hold any frames of a stream in any order. Frames are
sorted within the batch; one that has already been passed is late and goes
unanswered (``n_late`` counts them in the state). A row whose ``reset`` is true
puts its stream back to the start before it is processed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.alignment import RADIUS, State, step

OUTPUT = "leak_id long, leak_frame long, estimated_original_frame int, confidence double, raw_visual_prediction int, pos double, vel double, sigma double, streak int"
STATE = "pos double, vel double, sigma double, streak int, last long, n_processed long, n_late long"


def _walk(key: tuple, frames: Iterable[tuple[int, list[tuple[int, float]], bool]], state: GroupState, radius: int) -> pd.DataFrame:
    """Step through one stream's frames (number, candidates in rank order, reset), in order, and keep the state."""
    pos, vel, sigma, streak, last, done, late = state.get if state.exists else (None, 0.0, 100.0, 0, -1, 0, 0)
    now = State(pos, vel, sigma, streak)
    out = []
    for frame, ranked, reset in frames:
        if reset:
            now, last = State(), -1
        if frame <= last:
            late += 1
            continue
        if ranked:
            now = step(now, ranked)
            raw = max(ranked, key=lambda c: c[1])[0]
            out.append((key[0], frame, round(now.pos), 1.0 / (1.0 + now.sigma / (radius * radius)), raw, now.pos, now.vel, now.sigma, now.streak))
            done += 1
        last = frame
    state.update((now.pos, now.vel, now.sigma, now.streak, int(last), done, late))
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def _stateful(rows: DataFrame, frames_in: Callable[[pd.DataFrame], Iterable], radius: int) -> DataFrame:
    if radius <= 0:
        raise ValueError("radius must be positive")

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield _walk(key, frames_in(pd.concat(list(parts))), state, radius)

    return rows.groupBy("leak_id").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def align_stream(candidates: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``candidates``: streaming (leak_id, leak_frame, candidates array<struct<rank, ref_pos, combined>>, reset)."""

    def frames_in(rows: pd.DataFrame):
        rows = rows.sort_values("leak_frame", kind="stable")
        for frame, listed, reset in zip(rows["leak_frame"], rows["candidates"], rows["reset"], strict=True):
            yield frame, [(p, s) for _, p, s in sorted((c["rank"], c["ref_pos"], float(c["combined"])) for c in listed)], reset

    return _stateful(candidates, frames_in, radius)


def align_ranked(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``rows``: streaming (leak_id, leak_frame, q, rank, ref_pos, combined), all of a frame's rows in one micro-batch."""

    def frames_in(rows: pd.DataFrame):
        rows = rows.sort_values(["leak_frame", "q", "rank"], kind="stable")
        for (frame, _), own in rows.groupby(["leak_frame", "q"], sort=True):
            yield frame, list(zip(own["ref_pos"], own["combined"], strict=True)), False

    return _stateful(rows, frames_in, radius)


def frames_of(candidates: DataFrame) -> DataFrame:
    """Long candidates (leak_id, leak_frame, rank, ref_pos, combined) as one row a frame, ready to be streamed."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "ref_pos", F.col("combined").cast("double").alias("combined"))))
    return candidates.groupBy("leak_id", "leak_frame").agg(listed.alias("candidates")).withColumn("reset", F.lit(False))
