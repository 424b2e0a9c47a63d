"""Packed bits in a binary column, and sets of small numbers as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zeros(n: int) -> Column:
    """n bits that are 0, in whole bytes."""
    return F.unhex(F.repeat(F.lit("00"), F.lit(-(-n // 8))))


def _byte(bits: Column, k: Column) -> Column:
    return F.conv(F.hex(F.substring(bits, F.floor(k / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")


def get(bits: Column, k: Column) -> Column:
    """Bit k, 0 or 1; null beyond the end."""
    there = (k >= 0) & (k < 8 * F.octet_length(bits))
    return F.when(there, F.call_function("shiftright", _byte(bits, k), (k % 8).cast("int")).bitwiseAND(F.lit(1)))


def put(bits: Column, k: Column, on: Column) -> Column:
    """The bits with bit k set or cleared; unchanged where k is beyond the end."""
    at, mask = F.floor(k / 8).cast("int"), F.call_function("shiftleft", F.lit(1), (k % 8).cast("int"))
    new = F.when(on, _byte(bits, k).bitwiseOR(mask)).otherwise(_byte(bits, k).bitwiseAND(F.bitwise_not(mask)))
    changed = F.concat(F.substring(bits, F.lit(1), at), F.unhex(F.lpad(F.hex(new), 2, "0")), F.substring(bits, at + 2, F.octet_length(bits)))
    return F.when((k >= 0) & (k < 8 * F.octet_length(bits)), changed).otherwise(bits)


def number_set(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """(by, bits): numbers from 0 to 32,767 of each group as Spark's bitmap, counted by bitmap_count."""
    return df.groupBy(*by).agg(F.bitmap_construct_agg(F.col(number).cast("long")).alias("bits"))
