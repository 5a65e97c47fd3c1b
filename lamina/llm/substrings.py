"""Removal of repeated passages by difference-cover anchors.

A passage of `window` words repeats if its word sequence also starts elsewhere, in any text.  Only windows that start
at positions of a difference cover modulo a period are hashed and counted: for any two places of a passage some
offset below the period brings both onto the cover, so both have an anchor of `window - period + 1` words there,
with one hash.  An anchor whose hash is met once cannot belong to a repeat.  From each anchor met twice or more the
match is then extended, to every window of full length around it, and those windows are counted in the same way.
Anchors are told apart by 32 bits within a bucket, which can only add work; windows by 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._exchange import BUCKET_BYTES, OFFERS, TILE_BYTES, Offer, answers, buckets_for, tiled, trimmed
from ._spark import fresh
from ._words import ROLL_A, ROLL_B, Words, rolling

#: Perfect difference sets: each difference modulo the period occurs. Fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}


def cover_for(window: int) -> tuple[int, np.ndarray]:
    """The period, at most 3/5 of the window, and which residues are covered."""
    period = max(v for v in COVERS if v == 1 or 5 * v <= 3 * window)
    flags = np.zeros(period, bool)
    flags[list(COVERS[period])] = True
    return period, flags


class Tile:
    def __init__(self, table: pa.Table, text: str, window: int, buckets: int):
        self.words, self.window, self.buckets = Words(table.column(text)), window, buckets
        self.hashes = self.words.hashes()
        counts = self.words.counts
        self.head = np.repeat(self.words.first[:-1].astype(np.int32), counts)
        self.pos = np.arange(len(self.head), dtype=np.int32) - self.head
        self.left = np.repeat(counts.astype(np.int32), counts) - self.pos  # words from here to the end of the text
        self.period, cover = cover_for(window)
        size = window - self.period + 1
        self.anchors = np.flatnonzero((self.left >= size) & cover[self.pos % self.period])
        self.anchor_offer = Offer(rolling(self.hashes, size, ROLL_B)[self.anchors] if len(self.anchors) else np.zeros(0, np.uint64), buckets, True)

    def extend(self, answer: np.ndarray) -> None:
        """Windows of full length that hold an anchor met twice or more within a period of their start."""
        hit = self.anchors[answer[self.anchor_offer.inverse] > 1]
        step = np.zeros(len(self.head) + 1, np.int32)
        np.add.at(step, np.maximum(hit - self.period + 1, self.head[hit]), 1)
        np.add.at(step, hit + 1, -1)
        self.starts = np.flatnonzero((np.cumsum(step[:-1]) > 0) & (self.left >= self.window))
        self.offer = Offer(rolling(self.hashes, self.window, ROLL_A)[self.starts] if len(self.starts) else np.zeros(0, np.uint64), self.buckets, False)

    def removed(self, answer: np.ndarray) -> np.ndarray:
        hit = self.starts[answer[self.offer.inverse] > 1]
        step = np.zeros(len(self.head) + 1, np.int32)
        step[hit] += 1
        np.subtract.at(step, hit + self.window, 1)
        return np.cumsum(step[:-1]) > 0


def dedup_substrings(df: DataFrame, text: str = "text", window: int = 35, keep_untouched: bool = False, bucket_bytes: int = BUCKET_BYTES, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """df with `text` replaced by its kept words, joined by one space, and n_words, n_removed added.

    A word goes if a window over it has a word sequence that also starts anywhere else, in the same row or another;
    all are judged on the input.  A null text has no words and becomes empty, as does one whose words all go.  Equal
    rows are places of their own, so all but short ones lose all words.  Rows are never lost; an empty table stays
    empty.  A text longer than a tile is a tile of its own, so it has to fit a worker (some 20 times its bytes).  Added names get underscores in front where they clash.  keep_untouched: a text that loses nothing stays as it
    is, with its own spaces and lines.
    """
    tile, n_words, n_removed, side, kind = fresh(df, "tile", "n_words", "n_removed", "answer", "kind")
    d, total = tiled(df, tile, tile_bytes)
    buckets = buckets_for(total, bucket_bytes)
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in df.schema.fields] + [T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType())])

    columns_in, columns_out = df.columns, [f.name for f in schema.fields]

    def number(table: pa.Table) -> int:
        return table.column(tile)[0].as_py()

    @trimmed
    def anchors(table: pa.Table) -> pa.Table:
        return Tile(table, text, window, buckets).anchor_offer.rows(number(table))

    @trimmed
    def windows(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("tile", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()))})
        t = Tile(table, text, window, buckets)
        t.extend(t.anchor_offer.read(found))
        return t.offer.rows(number(table))

    @trimmed
    def cut(table: pa.Table, found: pa.Table) -> pa.Table:
        first = found.column("kind").to_numpy() == 1
        t = Tile(table, text, window, buckets)
        t.extend(t.anchor_offer.read(found.filter(pa.array(first))))
        gone = t.removed(t.offer.read(found.filter(pa.array(~first))))
        n = np.diff(np.concatenate([[0], np.cumsum(gone)])[t.words.first])
        kept = t.words.joined(~gone)
        if keep_untouched:
            kept = pc.if_else(pa.array(n == 0), pc.fill_null(table.column(text).cast(kept.type), ""), kept)
        columns = [kept if c == text else table.column(c) for c in columns_in]
        return pa.table(columns + [pa.array(t.words.counts.astype(np.int64)), pa.array(n.astype(np.int64))], names=columns_out)

    got = answers(d.groupBy(tile).applyInArrow(anchors, OFFERS), narrow=True)
    more = answers(d.groupBy(tile).cogroup(got.groupBy("tile")).applyInArrow(windows, OFFERS), narrow=False)
    both = got.withColumn("kind", F.lit(1)).union(more.withColumn("kind", F.lit(2)))
    return d.groupBy(tile).cogroup(both.groupBy("tile")).applyInArrow(cut, schema)
