"""The alignment filter on typed state: seeded from a batch run, closed by event-time timers.

Beside ``aligner.align_stream`` it can go on from where the batch filter
stopped, and a leaked stream that stays silent is closed: its state is removed
and a last row carries its counters. Needs the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``); ``with_store`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.alignment import RADIUS, State, step

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "pos double, vel double, sigma double, streak int, last long, n_processed long, n_late long"
OUTPUT = "leak_id long, leak_frame long, estimated_original_frame int, confidence double, raw_visual_prediction int, pos double, vel double, sigma double, streak int, closed boolean, n_processed long, n_late long"
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


def with_store(spark: SparkSession) -> None:
    """Set the state store that typed state needs, for queries that this session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Aligner(StatefulProcessor):
    """One leaked stream: its filter's state, its counters and the timer that closes it after ``idle_ms`` without a frame."""

    def __init__(self, radius: int, idle_ms: int) -> None:
        self.radius, self.idle_ms = radius, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.filter = handle.getValueState("filter", STATE)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        r = initialState.iloc[0]
        self.filter.update((float(r["pos"]), float(r["vel"]), float(r["sigma"]), int(r["streak"]), int(r["last"]), int(r["n_processed"]), 0))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pos, vel, sigma, streak, last, done, late = self.filter.get() if self.filter.exists() else (None, 0.0, 100.0, 0, -1, 0, 0)
        now, out = State(pos, vel, sigma, streak), []
        frames = pd.concat(list(rows)).sort_values("leak_frame", kind="stable")
        for frame, listed, reset in zip(frames["leak_frame"], frames["candidates"], frames["reset"], strict=True):
            if reset:
                now, last = State(), -1
            if frame <= last:
                late += 1
                continue
            ranked = [(p, s) for _, p, s in sorted((c["rank"], c["ref_pos"], float(c["combined"])) for c in listed)]
            if ranked:
                now = step(now, ranked)
                done += 1
                raw = max(ranked, key=lambda c: c[1])[0]
                out.append((key[0], frame, round(now.pos), 1.0 / (1.0 + now.sigma / (self.radius * self.radius)), raw, now.pos, now.vel, now.sigma, now.streak, False, done, late))
            last = frame
        self.filter.update((now.pos, now.vel, now.sigma, now.streak, int(last), int(done), int(late)))
        due = int(frames["seen_at"].max().timestamp() * 1000) + self.idle_ms
        earlier = list(self.handle.listTimers())
        for at in earlier:
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max([due, *earlier]))
        yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.filter.exists():
            return
        pos, vel, sigma, streak, last, done, late = self.filter.get()
        self.filter.clear()
        at = None if pos is None else round(pos)
        yield pd.DataFrame([(key[0], last, at, 1.0 / (1.0 + sigma / (self.radius * self.radius)), None, pos, vel, sigma, streak, True, done, late)], columns=NAMES).astype({"estimated_original_frame": "Int32", "raw_visual_prediction": "Int32"})

    def close(self) -> None:
        pass


def states_of(aligned: DataFrame) -> DataFrame:
    """What a stream needs to go on after ``alignment.align``: the last state of each leaked stream."""
    last = F.max_by(F.struct("pos", "vel", "sigma", "streak"), "leak_frame")
    ended = aligned.groupBy(F.col("leak_id").cast("long").alias("leak_id")).agg(last.alias("s"), F.max("leak_frame").cast("long").alias("last"), F.count("*").alias("n_processed"))
    return ended.select("leak_id", "s.*", "last", "n_processed")


def align_lasting(candidates: DataFrame, initial: DataFrame | None = None, radius: int = RADIUS, idle: str | int = 3600, delay: str = "10 minutes") -> DataFrame:
    """``candidates``, streaming (leak_id, leak_frame, candidates array<struct<rank, ref_pos, combined>>, reset, seen_at timestamp).

    ``initial`` is ``states_of`` a batch run; a stream that it does not name starts afresh, and it counts only in a new
    checkpoint. A frame not after the last one is late and goes unanswered, as does one that comes ``delay`` behind the
    watermark. A stream without a frame for ``idle`` seconds of event time is closed by a row with ``closed``; a later frame of it starts
    afresh. n_processed and n_late count up to the row.
    """
    if radius <= 0 or int(idle) <= 0:
        raise ValueError("radius and idle must be positive")
    rows = candidates.withWatermark("seen_at", delay).groupBy("leak_id")
    seeds = None if initial is None else initial.groupBy("leak_id")
    return rows.transformWithStateInPandas(Aligner(radius, int(idle) * 1000), OUTPUT, "Append", "EventTime", initialState=seeds)
