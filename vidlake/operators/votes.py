"""Bit slots, votes and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import BIT_LENGTH, bits_to_integer, slot_of


def half_votes(scores: DataFrame) -> DataFrame:
    """A10: 1 when the left half scores higher; ties are 0. ``scores`` has frame_no, left, right."""
    return scores.withColumns({"vote": F.when(F.col("left") > F.col("right"), 1).otherwise(0), "gap": F.abs(F.col("left") - F.col("right"))})


def expected_bits(bits: Column, frames: Column, redundancy: int, length: int = BIT_LENGTH) -> Column:
    """The part of the payload that a clip of ``frames`` can have carried."""
    return F.substr(bits, F.lit(1), F.least(F.lit(length), F.floor(frames / redundancy).cast("int")))


def frame_accuracy(scores: DataFrame, bits: str, redundancy: int, length: int = BIT_LENGTH) -> DataFrame:
    """Share of frames that vote for their slot's bit, and the mean and least gap; one row.

    Frames of slots beyond the carried bits do not count.
    """
    voted = half_votes(scores).withColumn("slot", slot_of(F.col("frame_no"), redundancy, length))
    truth = F.substr(F.lit(bits), F.col("slot") + 1, F.lit(1)).cast("int")
    counted = voted.where(F.col("slot") < len(bits)).withColumn("right", (F.col("vote") == truth).cast("int"))
    return counted.agg(F.count("*").alias("counted"), F.sum("right").alias("correct"), F.avg("right").alias("accuracy"), F.avg("gap").alias("mean_gap"), F.min("gap").alias("min_gap"))


def clean_control(scores: DataFrame) -> DataFrame:
    """An unmarked clip stays under 0.5 on both sides."""
    left, right = F.col("left"), F.col("right")
    return scores.agg(
        F.avg(left).alias("left_mean"), F.max(left).alias("left_max"), F.avg(right).alias("right_mean"), F.max(right).alias("right_max"), F.avg((left > right).cast("double")).alias("left_win_rate"), (F.greatest(F.max(left), F.max(right)) < 0.5).alias("passed")
    )


def soft_slots(responses: DataFrame, keys: list[str], length: int = BIT_LENGTH) -> DataFrame:
    """Z of each slot's mean response, and its bit; empty slots are '?' with margin 0.

    ``responses`` has (keys..., bit_index, response); every key gets all slots.
    """
    found = responses.groupBy(*keys, "bit_index").agg(F.avg("response").alias("m"), F.count("response").alias("n"), F.stddev_pop("response").alias("s"))
    z = F.col("m") * F.sqrt("n") / (F.col("s") + 1e-12)
    slots = responses.select(*keys).distinct().withColumn("bit_index", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    both = slots.join(found, [*keys, "bit_index"], "left")
    return both.select(*keys, "bit_index", F.coalesce(z, F.lit(0.0)).alias("z"), F.when(F.col("m").isNull(), "?").when(z > 0, "1").otherwise("0").alias("bit"))


def decode(slots: DataFrame, keys: list[str], frames: Column, redundancy: Column, length: int = BIT_LENGTH) -> DataFrame:
    """Bits a clip can carry, its number (null if a slot is undecided or none is carried), and the weakest |z|.

    ``frames`` and ``redundancy`` are columns of ``slots``, constant by key.
    """
    carried = F.when(frames < redundancy * length, F.floor(frames / redundancy)).otherwise(F.lit(length)).cast("int")
    listed = slots.withColumn("carried", carried).groupBy(*keys, "carried").agg(F.array_sort(F.collect_list(F.struct("bit_index", "bit", "z"))).alias("s"))
    votes = F.array_join(F.transform("s", lambda s: s.bit), "")
    mine = F.slice("s", F.lit(1), F.col("carried"))
    out = listed.select(*keys, "carried", votes.alias("votes"), F.substr(votes, F.lit(1), F.col("carried")).alias("decoded"), F.coalesce(F.array_min(F.transform(mine, lambda s: F.abs(s.z))), F.lit(0.0)).alias("weakest"))
    sure = (F.col("carried") > 0) & ~F.contains(F.col("decoded"), F.lit("?"))
    return out.withColumn("watermark", F.when(sure, bits_to_integer(F.col("decoded"), F.col("carried"))))


def hard_slots(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Majority of the frame votes of each slot; ties are 0."""
    return votes.groupBy(*keys, "bit_index").agg(F.sum("vote").alias("ones"), F.count("*").alias("n")).withColumn("bit", F.when(F.col("ones") * 2 > F.col("n"), 1).otherwise(0))


def scaled_redundancy(marked_frames: Column, original_frames: Column, base: int = 5) -> Column:
    """Frames a slot in a re-timed clip; never under ``base``."""
    scaled = base * F.floor(marked_frames / original_frames)
    return F.when(scaled == 0, base).otherwise(scaled).cast("int")


def bit_correct_ratio(bits: DataFrame, keys: list[str]) -> DataFrame:
    """Per cent of compared bits that agree. The published routine neither accumulates nor divides by the compared length; this one does both."""
    return bits.groupBy(*keys).agg((F.avg((F.col("original") == F.col("recovered")).cast("double")) * 100).alias("bcr"))


def coefficient_verdict(left: Column, right: Column, expected: Column, weak: float = 5.0) -> dict[str, Column]:
    """Bit 1 when the left patch moved more; flagged where the two are close."""
    bit, margin = F.when(left > right, 1).otherwise(0), F.abs(left - right)
    return {"decoded": bit, "margin": margin, "low_confidence": margin < weak, "matches": bit == expected}


def cliff_readout(cells: DataFrame, keys: list[str], split: Column, min_margin: float = 4.0) -> DataFrame:
    """The best cell against the runner-up decides; fewer than two cells decide nothing.

    ``cells`` has (keys..., x0, x1, y0, score); equal scores go row by row.
    """
    order = F.struct((-F.col("score")).alias("s"), "y0", "x0", "x1")
    top = cells.withColumn("split", split).groupBy(*keys, "split").agg(F.slice(F.array_sort(F.collect_list(order)), 1, 2).alias("t"))
    best, runner = F.element_at("t", 1), F.try_element_at("t", F.lit(2))
    margin = -best.s / (-runner.s + 1e-9)
    bit = F.when(F.floor((best.x0 + best.x1) / 2) < F.col("split"), 1).otherwise(0)
    return top.where(F.size("t") >= 2).select(*keys, (-best.s).alias("best"), (-runner.s).alias("runner"), margin.alias("margin"), (margin >= min_margin).alias("decided"), bit.alias("bit"))
