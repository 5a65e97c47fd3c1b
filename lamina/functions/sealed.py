"""Authenticated encryption of units with the engine's AES-GCM; layout: nonce (12 bytes), ciphertext, tag (16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u32_le(x: Column) -> Column:
    """Four little-endian bytes of an unsigned integer."""
    big = F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")
    return F.unhex(F.concat(*[F.substring(big, i, 2) for i in (7, 5, 3, 1)]))


def unit_name(kind: str, index: Column) -> Column:
    """What a unit is bound to: its chunk's type, a zero byte, its index."""
    return F.concat(F.lit(kind).cast("binary"), F.unhex(F.lit("00")), u32_le(index))


def seal_unit(plain: Column, key: Column, nonce: Column, kind: str, index: Column) -> Column:
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), nonce, unit_name(kind, index))


def open_unit(sealed: Column, key: Column, kind: str, index: Column) -> Column:
    """Null where the tag doesn't verify."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), unit_name(kind, index))
