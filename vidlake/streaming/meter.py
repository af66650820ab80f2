"""Counts and times of stages, carried out of the jobs that do the work."""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import scratch


class Stages:
    """A batch job's stages, each written once, with its rows (an Observation, no second pass) and its seconds."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.seen: list[tuple[str, int, float]] = []

    def run(self, name: str, rows: DataFrame) -> DataFrame:
        """Write ``rows`` to the shared folder under the clock and read them back."""
        noted, path = Observation(name), scratch.folder(self.spark, name)
        began = time.perf_counter()
        rows.observe(noted, F.count(F.lit(1)).alias("n_rows")).write.parquet(path)
        self.seen.append((name, noted.get["n_rows"], time.perf_counter() - began))
        return self.spark.read.schema(rows.schema).parquet(path)

    def means(self, n_queries: int) -> DataFrame:
        """stage, n_rows, n_queries, seconds, ms_per_query (null without queries)."""
        rows = [(n, r, n_queries, s, 1000 * s / n_queries if n_queries else None) for n, r, s in self.seen]
        return self.spark.createDataFrame(rows, "stage string, n_rows long, n_queries long, seconds double, ms_per_query double")


class Meter(StreamingQueryListener):
    """T5: totals by streaming query, over restarts from one checkpoint: batches, input rows, milliseconds and observed counts."""

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = {}
        self._ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        total = self.totals.setdefault(str(p.id), {"n_batches": 0, "n_input": 0, "ms": 0})
        total["n_batches"] += 1
        total["n_input"] += max(0, p.numInputRows)
        total["ms"] += p.batchDuration
        for name, row in p.observedMetrics.items():
            for field, value in row.asDict().items():
                total[f"{name}.{field}"] = total.get(f"{name}.{field}", 0) + (value or 0)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._ended.setdefault(str(event.runId), threading.Event()).set()

    def of(self, query, wait: float = 60.0) -> dict[str, int]:
        """Totals of a query that has ended, once its last event has come; a TimeoutError if it does not."""
        if not self._ended.setdefault(str(query.runId), threading.Event()).wait(wait):
            raise TimeoutError(f"no end of query {query.id} within {wait} seconds")
        return dict(self.totals.get(str(query.id), {}))


def metered(aligned: DataFrame) -> DataFrame:
    """The answered frames of an alignment stream, counted as ``answered.n``."""
    return aligned.observe("answered", F.count(F.lit(1)).alias("n"))


def asked(frames: DataFrame) -> DataFrame:
    """The frames with candidates that enter an alignment stream, counted as ``asked.n``; those not answered were late."""
    return frames.observe("asked", F.count_if(F.size("candidates") > 0).alias("n"))
