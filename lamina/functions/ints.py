"""Exact integer expressions: zigzag, varint lengths, half-up blends, bit fields. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(d: Column) -> Column:
    return F.when(d >= 0, d * 2).otherwise(d * -2 - 1)


def unzigzag(u: Column) -> Column:
    return F.when(u % 2 == 0, F.shiftright(u, 1)).otherwise(-F.shiftright(u + 1, 1))


def varint_length(x: Column) -> Column:
    """Bytes of an unsigned varint below 2**63."""
    out = F.lit(1)
    for bits in range(7, 63, 7):
        out = out + F.when(x >= (1 << bits), 1).otherwise(0)
    return out.cast("long")


def int_div(a: Column, b: Column | int) -> Column:
    """Floor of a / b for a >= 0 and b > 0; null where b is 0. Keeps decimals exact."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def blend(bottom: Column, normal: Column, k: Column, n: Column) -> Column:
    """The k-th of n steps from bottom to normal, rounded half up. Wide: the products don't fit 64 bits for extreme values."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (wide(bottom) * wide(n - k) + wide(normal) * wide(k)) * 2 + wide(n)
    return int_div(top, wide(n) * 2).cast("long")


def bits(x: Column, low: int, width: int) -> Column:
    return F.shiftright(x.cast("long"), low).bitwiseAND((1 << width) - 1)


def aligned(size: Column, to: int = 8) -> Column:
    return F.call_function("div", size + (to - 1), F.lit(to)) * to
