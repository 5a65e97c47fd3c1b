"""Counting keys over all texts without bringing all rows of a key together.

Texts are dealt to tiles of a few MB by a hash of the whole row, so copies of one text spread over all tiles; rows that
are equal in every column, and that are too many for a tile, are dealt by their place in a written table.  A tile offers
each of its distinct keys once, with its own count, to the bucket that the key's hash names; a bucket adds up what the
tiles offer and answers each tile, in the order of its offer.  A key that a third of all rows hold costs one entry for
each tile, not one for each row.  A tile derives the same offer again when it reads the answer.

A tile sends one row to each bucket.  So that rows grow in proportion to the input, and not with its square, tiles and
buckets grow with the square root of the input from 64 GB on, up to 16 times (32 MB of text in a tile, 256 MB in a
bucket, which takes a worker of 2 GB; beyond 16 TB rows get shorter instead, to some 14 keys at 100 TB).
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import materialise
from ._words import U64

TILE_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20
OFFERS = "tile int, bucket int, keys binary, counts binary"
ANSWERS = "tile int, bucket int, answer binary"


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def trimmed(f):
    """f of one or two tables, with the memory that it has freed given back to the system after each call; so a worker stays small."""

    def one(table):
        try:
            return f(table)
        finally:
            _trim()

    def two(left, right):
        try:
            return f(left, right)
        finally:
            _trim()

    return one if f.__code__.co_argcount == 1 else two


def growth(total: int) -> float:
    """How much larger than usual tiles and buckets are for so many bytes of rows."""
    return min(16.0, max(1.0, (total / (64 << 30)) ** 0.5))


def tiles_for(total: int, tile_bytes: int = TILE_BYTES) -> int:
    return max(1, -(-total // int(tile_bytes * growth(total))))


def buckets_for(total: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(1, -(-total // int(bucket_bytes * growth(total))))


def tiled(df: DataFrame, name: str, tile_bytes: int = TILE_BYTES) -> tuple[DataFrame, int]:
    """df with a column of tile numbers, and the bytes of its rows (strings and 8 for each row).

    Rows that are equal in every integer and string column get one tile together, unless they are more than it holds.
    """
    kinds = [(f"`{c}`", kind) for c, kind in df.dtypes if kind in ("bigint", "int", "string")]
    key = F.xxhash64(*[F.col(c) for c, _ in kinds])
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c, kind in kinds if kind == "string"), F.lit(8)).cast("long")
    equal = df.select(key.alias("k"), size.alias("b")).groupBy("k").agg(F.sum("b").alias("b"))
    total, most = (x or 0 for x in equal.agg(F.sum("b"), F.max("b")).first())
    tiles = F.lit(tiles_for(total, tile_bytes))
    if most <= tile_bytes * growth(total):
        return df.withColumn(name, F.pmod(key, tiles).cast("int")), total
    often = materialise(equal.filter(F.col("b") > int(tile_bytes * growth(total))).select("k"), "often")
    rows = df.withColumn(name, key)
    copies = materialise(rows.join(often, F.col(name) == F.col("k"), "left_semi"), "copies")
    copies = copies.withColumn(name, F.pmod(F.xxhash64(F.col(name), F.monotonically_increasing_id()), tiles).cast("int"))
    others = rows.join(often, F.col(name) == F.col("k"), "left_anti").withColumn(name, F.pmod(F.col(name), tiles).cast("int"))
    return others.unionByName(copies), total


class Offer:
    """The distinct keys of a tile. narrow: 32 bits within a bucket (a filter); else 64 bits.

    keys are ascending, and so are their buckets. inverse: for each given key its place among them.
    """

    def __init__(self, given: np.ndarray, buckets: int, narrow: bool, weights: np.ndarray | None = None):
        self.buckets, self.narrow = buckets, narrow
        part = ((given >> U64(32)) * U64(buckets)) >> U64(32)
        full = (part << U64(32)) | (given & U64(0xFFFFFFFF)) if narrow else given
        self.keys, self.inverse, self.counts = np.unique(full, return_inverse=True, return_counts=True)
        if weights is not None:
            self.counts = np.bincount(self.inverse, weights=weights, minlength=len(self.keys)).astype(np.int64)
        high = self.keys >> U64(32)
        self.bounds = np.searchsorted(high if narrow else (high * U64(buckets)) >> U64(32), np.arange(buckets + 1, dtype=np.uint64))

    def rows(self, tile: int, counts=np.uint8, some: np.ndarray | None = None) -> pa.Table:
        """The rows to send; some: flags of the keys to send at all."""
        most = np.iinfo(counts).max
        out: tuple[list, list, list] = ([], [], [])
        for b in np.flatnonzero(np.diff(self.bounds)):
            a, z = self.bounds[b], self.bounds[b + 1]
            keys, n = self.keys[a:z], np.minimum(self.counts[a:z], most)
            if some is not None:
                keys, n = keys[some[a:z]], n[some[a:z]]
            if len(keys):
                out[0].append(int(b))
                out[1].append((keys.astype(np.uint32) if self.narrow else keys).tobytes())
                out[2].append(n.astype(counts).tobytes())
        return pa.table({"tile": pa.array([tile] * len(out[0]), pa.int32()), "bucket": pa.array(out[0], pa.int32()), "keys": pa.array(out[1], pa.binary()), "counts": pa.array(out[2], pa.binary())})

    def read(self, table: pa.Table, counts=np.uint8) -> np.ndarray:
        """The answers for the distinct keys, from rows of bucket and answer; 64 bits wide if one of them is."""
        found = dict(zip(table.column("bucket").to_pylist(), table.column("answer").to_pylist()))
        parts = []
        for b in np.flatnonzero(np.diff(self.bounds)):
            raw, n = found.get(int(b), b""), int(self.bounds[b + 1] - self.bounds[b])
            part = np.frombuffer(raw, np.uint64 if len(raw) == 8 * n else counts)
            if len(part) != n:
                raise ValueError(f"a tile offered {n} keys to a bucket and has {len(part)} answers")
            parts.append(part)
        return np.concatenate(parts) if parts else np.zeros(0, counts)


def gathered(table: pa.Table, narrow: bool, counts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket: distinct keys, their totals, each offered key's place among them, and the bounds of the offers."""
    kind = np.uint32 if narrow else np.uint64
    offers = table.column("keys").to_pylist()
    keys = np.frombuffer(b"".join(offers), kind)
    n = np.frombuffer(b"".join(table.column("counts").to_pylist()), counts)
    distinct, inverse = np.unique(keys, return_inverse=True)
    totals = np.bincount(inverse, weights=n, minlength=len(distinct)).astype(np.int64)
    return distinct, totals, inverse, np.cumsum([0] + [len(x) // kind().nbytes for x in offers])


def as_byte(totals: np.ndarray) -> np.ndarray:
    """Totals in a byte, in the same order: exact up to 192, then four steps for each doubling, up to ten million."""
    large = 192 + np.floor(4 * np.log2(np.maximum(totals, 192) / 192))
    return np.where(totals <= 192, totals, np.minimum(np.maximum(large, 193), 255)).astype(np.uint8)


def answered(table: pa.Table, narrow: bool, counts=np.uint8, wide: bool = False) -> pa.Table:
    """Of a bucket, for each offer, the totals of its keys: as bytes (as_byte) or, if wide, in full, 64 bits each where one is above 32."""
    _, totals, inverse, at = gathered(table, narrow, counts)
    flat = totals[inverse] if wide else as_byte(totals)[inverse]
    raw = [flat[a:b] for a, b in zip(at[:-1], at[1:])]
    if wide:
        raw = [x.astype(np.uint64 if x.max(initial=0) >> 32 else np.uint32) for x in raw]
    return pa.table({"tile": table.column("tile"), "bucket": table.column("bucket"), "answer": pa.array([x.tobytes() for x in raw], pa.binary())})


def answers(offers: DataFrame, narrow: bool, counts=np.uint8) -> DataFrame:
    """For each offer the totals of its keys over all tiles, as bytes (as_byte)."""

    @trimmed
    def answer(table: pa.Table) -> pa.Table:
        return answered(table, narrow, counts)

    return offers.groupBy("bucket").applyInArrow(answer, ANSWERS)
