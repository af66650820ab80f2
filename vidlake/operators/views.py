"""Difference views of a source and an impaired capture: one template, a strategy for each carrier.

A strategy takes paired pixels (frame_no, y, x, src, imp) and returns rows by
frame; ``frame_views`` numbers the output images and stops at the shorter capture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.frames import paired
from ..sources.sinks import image_name
from . import pixels as px
from . import transforms as tr

Strategy = Callable[[DataFrame], DataFrame]


def threshold_view(pairs: DataFrame) -> DataFrame:
    """Share of pixels that moved beyond the threshold, and the largest move."""
    d = px.difference(pairs)
    return d.groupBy("frame_no").agg(F.avg((F.col("panel") > 0).cast("double")).alias("share"), F.max("diff").alias("largest"))


def approximation_view(pairs: DataFrame) -> DataFrame:
    """Mean and largest absolute change of the level-2 approximation."""
    change = tr.haar_ll(pairs.select("frame_no", "y", "x", (F.col("imp") - F.col("src")).alias("v")), ["frame_no"])
    return change.groupBy("frame_no").agg(F.avg(F.abs("v")).alias("share"), F.max(F.abs("v")).alias("largest"))


STRATEGIES: dict[str, Strategy] = {"threshold": threshold_view, "approximation": approximation_view}


def frame_views(source: DataFrame, impaired: DataFrame, strategy: str | Strategy = "threshold") -> DataFrame:
    """One row a frame that both captures have: its image name and the strategy's figures."""
    if isinstance(strategy, str):
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown view {strategy!r}; have {sorted(STRATEGIES)}")
        strategy = STRATEGIES[strategy]
    return strategy(paired(source, impaired)).withColumn("image", image_name(F.col("frame_no")))
