"""Addresses as raw 64 bits: compare them on a mapping that sorts them unsigned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIGN = -(1 << 63)


def ordered(address: Column) -> Column:
    """Turns the sign bit, so that signed order is the addresses' order."""
    return address.bitwiseXOR(F.lit(_SIGN))


def from_unsigned(address: Column) -> Column:
    """Raw bits of an unsigned 64-bit import, which Spark reads as DECIMAL(20,0)."""
    wide = address.cast("decimal(20,0)")
    return F.when(wide >= F.lit("9223372036854775808").cast("decimal(20,0)"), wide - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide).cast("bigint")


def hexadecimal(address: Column) -> Column:
    """Lowercase, as an unresolved frame is shown."""
    return F.concat(F.lit("0x"), F.lower(F.hex(address)))
