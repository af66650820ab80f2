"""Scalar rules shared by the detectors and carriers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIT_LENGTH = 32


def ramp(value: Column, lo: float, hi: float) -> Column:
    """0 at lo, 1 at hi, clipped; hi < lo falls instead of rising; a flat ramp is 0."""
    if lo == hi:
        return F.lit(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - lo) / (hi - lo)))


def clip(value: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), value))


def bit_string(value: Column, length: int = BIT_LENGTH) -> Column:
    """Binary text padded to ``length``; longer numbers keep all their digits."""
    digits = F.bin(value)
    return F.when(F.length(digits) >= length, digits).otherwise(F.lpad(digits, length, "0"))


def bits_to_integer(bits: Column, length: Column) -> Column:
    return F.conv(F.substr(bits, F.lit(1), length.cast("int")), 2, 10).cast("bigint")


def hex_to_bits(text: Column) -> Column:
    """The lowest 32 bits of a hexadecimal number, as bits."""
    return bit_string(F.conv(text, 16, 10).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def integer_to_hex(value: Column) -> Column:
    digits = F.hex(value)
    return F.when(F.length(digits) >= 8, digits).otherwise(F.lpad(digits, 8, "0"))


def slot_of(frame: Column, redundancy: int, length: int = BIT_LENGTH) -> Column:
    """Tumbling runs of ``redundancy`` frames, cycled over ``length`` bit slots."""
    return F.pmod(F.floor(frame / redundancy), F.lit(length)).cast("int")


def run_of(frame: Column, redundancy: int) -> Column:
    return F.floor(frame / redundancy).cast("bigint")


def middle_split(width: Column, side: int) -> Column:
    """The grid line nearest to the centre, halves to even."""
    return (F.bround(width / F.lit(2.0) / F.lit(float(side)), 0) * side).cast("int")


def preferred_size(*values: Column, default: int = 224) -> Column:
    """The first usable input size among (height, shortest_edge, width, longest_edge)."""
    return F.coalesce(*[F.when(v != 0, v.cast("int")) for v in values], F.lit(default))
