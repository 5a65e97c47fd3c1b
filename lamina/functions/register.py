"""SQL functions of the format, registered with a session: register(spark)."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from ..session import ship
from ..sources import format as X
from ..sources.codec import Cursor, Fault, decode, varint


@pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C of binary values."""
    return pd.Series([None if x is None else X.crc32c(bytes(x)) for x in data], dtype="Int64")


@pandas_udf(T.BinaryType())
def zstd_compress(data: pd.Series, level: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else X.zstd(bytes(x), int(n)) for x, n in zip(data, level)])


@pandas_udf(T.BinaryType())
def zstd_decompress(data: pd.Series, most: pd.Series) -> pd.Series:
    """Null where the frame is damaged, or declares no size or more than `most`."""

    def one(x, n):
        try:
            return None if x is None else X.unzstd(bytes(x), int(n))
        except Fault:
            return None

    return pd.Series([one(x, n) for x, n in zip(data, most)])


@pandas_udf(T.BinaryType())
def shake256(data: pd.Series, size: pd.Series) -> pd.Series:
    """The first `size` bytes of SHAKE-256; null for a null value or a negative size."""
    return pd.Series([None if x is None or pd.isna(n) or n < 0 else hashlib.shake_256(bytes(x)).digest(int(n)) for x, n in zip(data, size)])


@pandas_udf(T.BinaryType())
def varint_encode(values: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or x < 0 else varint(int(x)) for x in values])


@pandas_udf(T.LongType())
def varint_decode(data: pd.Series) -> pd.Series:
    """The value of a whole, shortest varint below 2**63; null for anything else."""

    def one(x):
        try:
            c = Cursor(bytes(x))
            value = c.varint()
            return value if c.at == len(x) and value < 1 << 63 else None
        except (Fault, TypeError):
            return None

    return pd.Series([one(x) for x in data], dtype="Int64")


@pandas_udf(T.BinaryType())
def merkle_root(leaves: pd.Series) -> bytes:
    """Aggregate: the root over leaves in the order of their index, given as index (4 bytes, big-endian) and hash."""
    return X.merkle_root([x[4:] for x in sorted(bytes(x) for x in leaves)])


@udtf(returnType=T.StructType([T.StructField("run_idx", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.IntegerType())]))
class ReeDecode:
    """Table function: the runs of a slice; no row where it is malformed."""

    def eval(self, data: bytes, pixels: int):
        try:
            starts, values = decode(bytes(data), pixels)
        except Fault:
            return
        ends = [*starts[1:].tolist(), pixels]
        for i, (a, b, v) in enumerate(zip(starts.tolist(), ends, values.tolist())):
            yield i, a, b, v


def register(spark: SparkSession) -> None:
    """crc32c, shake256, zstd_compress, zstd_decompress, varint_encode, varint_decode, merkle_root, ree_decode."""
    ship(spark)
    for f in (crc32c, shake256, zstd_compress, zstd_decompress, varint_encode, varint_decode, merkle_root):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("ree_decode", ReeDecode)
