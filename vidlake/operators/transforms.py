"""Frequency transforms and masks on long-form blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATHER = 32


def basis(n: int) -> np.ndarray:
    """The orthonormal DCT-II basis of n points, one frequency a row."""
    k, i = np.mgrid[0:n, 0:n]
    b = np.cos(np.pi * (2 * i + 1) * k / (2.0 * n)) * math.sqrt(2.0 / n)
    b[0] = math.sqrt(1.0 / n)
    return b


def _turned(cells: DataFrame, keys: list[str], n: int, turn: Callable[[np.ndarray], np.ndarray], names: tuple[str, str, str], out: tuple[str, str, str]) -> DataFrame:
    """Gather each block's cells into one array, turn whole batches of n x n blocks by matrix products, and spread them again.

    What is shuffled is a block's own cells; a cell that is not there is 0.
    """
    row, col, value = names
    at = (F.col(row) * n + F.col(col)).cast("int")
    packed = cells.groupBy(*keys).agg(F.collect_list(F.struct(at.alias("i"), F.col(value).cast("double").alias("v"))).alias("cells"))
    kinds = packed.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = max(1, (1 << 22) // (n * n))
        for batch in batches:
            for first in range(0, batch.num_rows, each):
                part = batch.slice(first, each)
                lists = part.column("cells")
                held = lists.flatten()
                block = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                blocks = np.zeros(part.num_rows * n * n)
                blocks[block * n * n + held.field("i").to_numpy()] = held.field("v").to_numpy(zero_copy_only=False)
                flat = turn(blocks.reshape(-1, n, n)).reshape(-1)
                ends = pa.array(np.arange(part.num_rows + 1) * n * n, pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.ListArray.from_arrays(ends, pa.array(flat))], names=[*keys, "turned"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "turned array<double>"])
    spread = packed.mapInArrow(run, schema).select(*keys, F.posexplode("turned").alias("i", out[2]))
    return spread.select(*keys, F.floor(F.col("i") / n).cast("int").alias(out[0]), F.pmod("i", F.lit(n)).alias(out[1]), out[2])


PIXEL, FREQUENCY = ("y", "x", "v"), ("u", "w", "c")


def dct2(blocks: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys..., y, x, v) -> (keys..., u, w, c): row frequency u, column frequency w."""
    b = basis(n)
    return _turned(blocks, keys, n, lambda x: b @ x @ b.T, PIXEL, FREQUENCY)


def idct2(spectra: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The inverse: (keys..., u, w, c) -> (keys..., y, x, v)."""
    b = basis(n)
    return _turned(spectra, keys, n, lambda c: b.T @ c @ b, FREQUENCY, PIXEL)


def low_pass(u: Column, w: Column, radius: float, lower: bool = True) -> Column:
    """C14: 1 for coefficients within the radius of the constant one, or beyond it."""
    inside = F.sqrt((u * u + w * w).cast("double")) <= radius
    return F.when(inside if lower else ~inside, 1.0).otherwise(0.0)


def blurred(blocks: DataFrame, keys: list[str], n: int, radius: float) -> DataFrame:
    """The block without its coefficients beyond the radius; there and back in one step."""
    b = basis(n)
    u, w = np.mgrid[0:n, 0:n]
    kept = np.sqrt(u * u + w * w) <= radius
    return _turned(blocks, keys, n, lambda x: b.T @ (kept * (b @ x @ b.T)) @ b, PIXEL, PIXEL)


def cliff(spectra: DataFrame, keys: list[str], radius: float, band: float) -> DataFrame:
    """C17: mean energy just inside the cutoff over that just outside."""
    dist, energy = F.sqrt((F.col("u") * F.col("u") + F.col("w") * F.col("w")).cast("double")), F.col("c") * F.col("c")
    below = F.avg(F.when((dist >= radius - band) & (dist < radius), energy))
    above = F.avg(F.when((dist >= radius) & (dist < radius + band), energy))
    return spectra.groupBy(*keys).agg((below / (above + 1e-9)).alias("score"))


def haar_ll(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The level-2 Haar approximation, a quarter of each 4 x 4 sum: (keys..., y, x, v)."""
    at = {k: F.floor(F.col(k) / 4).cast("int") for k in ("y", "x")}
    return pixels.groupBy(*keys, at["y"].alias("y"), at["x"].alias("x")).agg((F.sum("v") / 4.0).alias("v"))


def with_ll(pixels: DataFrame, change: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse for a changed approximation: each pixel moves by a quarter of its block's change (d)."""
    block = change.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), "d")
    at = pixels.withColumns({"_y": F.floor(F.col("y") / 4).cast("int"), "_x": F.floor(F.col("x") / 4).cast("int")})
    return at.join(block.hint("merge"), [*keys, "_y", "_x"], "left").withColumn("v", F.col("v") + F.coalesce("d", F.lit(0.0)) / 4.0).drop("_y", "_x", "d")


def feather(i: Column, n: int, width: int = FEATHER) -> Column:
    """C4, one axis: 1 inside, a raised cosine towards both ends."""
    k = min(width, n // 2)
    if k <= 0:
        return F.lit(1.0)
    edge = F.least(i, F.lit(n - 1) - i)
    return F.when(edge < k, 0.5 * (1.0 - F.cos(F.pi() * (edge + 0.5) / float(k)))).otherwise(1.0)


def feather_mask(y: Column, x: Column, side: int, width: int = FEATHER) -> Column:
    return feather(y, side, width) * feather(x, side, width)
