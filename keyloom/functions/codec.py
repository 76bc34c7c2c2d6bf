"""Byte encodings whose unsigned order is the order of the values, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_integer(c: Column, size: int = 8) -> Column:
    """An integer of `size` bytes, big-endian, with its sign bit flipped."""
    flipped = c.cast("decimal(20,0)") + F.lit(str(1 << (8 * size - 1))).cast("decimal(20,0)")
    low = F.pmod(flipped, F.lit(1 << 32).cast("decimal(20,0)"))
    high = (flipped - low) / F.lit(1 << 32).cast("decimal(20,0)")
    digits = F.concat(F.lpad(F.hex(high.cast("long")), 8, "0"), F.lpad(F.hex(low.cast("long")), 8, "0"))
    return F.unhex(F.substring(digits, 17 - 2 * size, 2 * size))


def read_sorted_integer(c: Column, size: int = 8) -> Column:
    digits = F.lpad(F.hex(c), 16, "0")
    high, low = (F.conv(F.substring(digits, at, 8), 16, 10).cast("decimal(20,0)") for at in (1, 9))
    return (high * (1 << 32) + low - F.lit(str(1 << (8 * size - 1))).cast("decimal(20,0)")).cast("long")


def sorted_string(c: Column) -> Column:
    """UTF-8 with a NUL after it, NUL itself as C0 80; null is FF, after all others."""
    body = F.encode(F.replace(c, F.lit("\0"), F.lit("￿\0")), "utf-8")
    digits = F.concat(F.regexp_replace(F.hex(body), "EFBFBF00", "C080"), F.lit("00"))
    return F.unhex(F.when(c.isNull(), F.lit("FF")).otherwise(digits))


def sorted_boolean(c: Column) -> Column:
    return F.unhex(F.when(c, "01").otherwise("00"))


def composite(*parts: Column) -> Column:
    """A key of several encoded fields, in their order."""
    return F.concat(*parts)


def enum_order(c: Column, names: list[str]) -> Column:
    """An enumeration's place in its declaration, by which it sorts; null for other values."""
    place = F.array_position(F.array(*map(F.lit, names)), c)
    return F.when(place > 0, place - 1)


def double_order(c: Column) -> list[Column]:
    """Sort columns for the IEEE order: -0.0 before 0.0, NaN last."""
    return [c.asc(), F.when(c.cast("string") == "-0.0", 0).otherwise(1).asc()]


def byte_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by unsigned bytes; a prefix comes first."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)
