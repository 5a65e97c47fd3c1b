"""Little-endian integers out of binary columns, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(data: Column, offset: Column | int, size: int) -> Column:
    """Bytes from a 0-based offset."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    return data.substr((at + 1).cast("int"), F.lit(size))


def _number(data: Column, offset: Column | int, size: int) -> Column:
    """Through the hex digits of the reversed bytes; decimal, as 64 bits unsigned don't fit a long."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    digits = F.concat(*[F.lpad(F.hex(data.substr((at + 1 + i).cast("int"), F.lit(1))), 2, "0") for i in reversed(range(size))])
    return F.conv(digits, 16, 10)


def u32(data: Column, offset: Column | int) -> Column:
    return _number(data, offset, 4).cast("long")


def u64(data: Column, offset: Column | int) -> Column:
    """As decimal(20, 0); check the range before casting to a long."""
    return _number(data, offset, 8).cast("decimal(20,0)")


def ascii4(data: Column, offset: Column | int) -> Column:
    return F.decode(part(data, offset, 4), "ISO-8859-1")
