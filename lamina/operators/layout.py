"""Layout of tables and chunks: entries of layers and sectors, offsets, order rules, overlaps, shared payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ints import aligned, int_div
from .ranking import with_position, with_running
from .runs import before


def entries(slices: DataFrame, file: Sequence[str], per_chunk: int = 64) -> DataFrame:
    """slices (file, layer, sector, data_size) with layer_group, data_offset, additional, chunk_has_data, home_sector.

    A chunk is a layer group of one sector.  data_offset: bytes of the chunk's slices of lower layers.  additional: the
    layer's further entries, on its first one.  home_sector: where an entry without bytes is placed: its own sector if
    that chunk has data, else the layer's first sector that has.
    """
    s = slices.withColumn("layer_group", int_div(F.col("layer"), per_chunk))
    chunk = Window.partitionBy(*file, "layer_group", "sector").orderBy("layer")
    layer = Window.partitionBy(*file, "layer")
    s = s.withColumn("data_offset", F.coalesce(F.sum("data_size").over(before(chunk)), F.lit(0)))
    s = s.withColumn("chunk_has_data", F.sum("data_size").over(Window.partitionBy(*file, "layer_group", "sector")) > 0)
    first = F.row_number().over(layer.orderBy("sector")) == 1
    s = s.withColumn("additional", F.when(first, F.count("*").over(layer) - 1).otherwise(0))
    return s.withColumn("home_sector", F.when(F.col("chunk_has_data"), F.col("sector")).otherwise(F.min(F.when(F.col("chunk_has_data"), F.col("sector"))).over(layer)))


def with_layer_index(table: DataFrame, file: Sequence[str], order: Sequence[str], sector: str = "sector", name: str = "layer_index") -> DataFrame:
    """The layer of each entry of a valid table, whose layers begin with sector 0; a file may have any number of entries."""
    begins = (F.col(sector) == 0).cast("long")
    return with_running(table, file, order, begins, name).withColumn(name, F.col(name) + begins - 1)


def sector_order(table: DataFrame, layer: Sequence[str], order: Sequence[str], sector: str = "sector") -> DataFrame:
    """Entries with the rule of sector order that they break."""
    w = Window.partitionBy(*layer).orderBy(*order)
    last = F.lag(sector).over(w)
    broken = F.when(last.isNull() & (F.col(sector) != 0), "ltbl.first_entry_is_sector_zero").when(last == F.col(sector), "ltbl.sector_id_unique").when(last > F.col(sector), "ltbl.sector_ids_ascending")
    return table.withColumn("check", broken).filter("check is not null")


def overlapping(extents: DataFrame, within: Sequence[str], tie: str, large: bool = False) -> DataFrame:
    """Extents (start, end) that begin before the furthest end of those before them; empty ones take no part.

    large: groups may be too many rows for a task, so the furthest end is carried from partition to partition.
    """
    if large:
        return with_running(extents.filter("end > start"), within, ["start", "end", tie], F.col("end"), "until", "max").filter("until > start")
    w = before(Window.partitionBy(*within).orderBy("start", "end", tie))
    return extents.filter("end > start").withColumn("until", F.max("end").over(w)).filter("until > start")


def with_payload_offsets(chunks: DataFrame, file: Sequence[str], order: Sequence[str], size: str, name: str = "offset", header: int = 32) -> DataFrame:
    """Byte offsets of payloads, each padded to eight bytes, after the header; a file may have any number of rows."""
    return with_running(chunks, file, order, aligned(F.col(size)), name).withColumn(name, (F.col(name) + header).cast("long"))


def allocation_bound(slices: Column, pixels: Column | int) -> Column:
    """Decompressed bytes that a frame of so many slices may hold at most."""
    px = F.lit(pixels) if isinstance(pixels, int) else pixels
    return F.greatest(slices, F.lit(1)) * (px * 5 + 64)


def shared_index(rows: DataFrame, payload: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with shared_index: equal payloads share the number of their first occurrence, counted from 0."""
    first = rows.groupBy(*payload).agg(F.min(F.struct(*order)).alias("first"))
    numbered = with_position(first, [F.col("first")], "shared_index").drop("first")
    on = [rows[c].eqNullSafe(numbered[c]) for c in payload]
    return rows.join(numbered, on).select(*[rows[c] for c in rows.columns], "shared_index")


def sample_strided(rows: DataFrame, order: Sequence[str], most: int = 256) -> DataFrame:
    """At most `most` rows at equal steps of the order: the feature is the sample."""
    n = rows.count()
    step = max(1, -(-n // most))
    return with_position(rows, [F.col(c) for c in order]).filter(F.col("position") % step == 0)
