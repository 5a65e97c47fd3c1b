"""Header and directory of container files by expressions alone; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binary import ascii4, u32, u64
from ..functions.ints import bits

LONG_MOST = (1 << 63) - 1


def headers(files: DataFrame, *more: str) -> DataFrame:
    """file_id, magic, version, dir_offset, chunk_count, flags, total, size of each file (path, content), and more of its columns."""
    c = F.col("content")
    return files.select(F.col("path").alias("file_id"), ascii4(c, 0).alias("magic"), u32(c, 4).alias("version"), u64(c, 8).alias("dir_offset"), u32(c, 16).alias("chunk_count"), u32(c, 20).alias("flags"), u64(c, 24).alias("total"), F.octet_length("content").cast("long").alias("size"), *more)


def descriptors(files: DataFrame) -> DataFrame:
    """A row for each descriptor of the files whose directory lies within them."""
    h = headers(files, "content").filter("dir_offset >= 32 and dir_offset + 32 * chunk_count <= size - 8")
    rows = h.filter("chunk_count > 0").select("file_id", "content", F.col("dir_offset").cast("long").alias("at"), F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("chunk_count") - 1)).alias("dir_index", "i"))
    c, at = F.col("content"), F.col("at") + F.col("i") * 32
    return rows.select("file_id", "dir_index", ascii4(c, at).alias("chunk_type"), u64(c, at + 4).alias("offset"), u64(c, at + 12).alias("size_uncompressed"), u64(c, at + 20).alias("size_compressed"), u32(c, at + 28).alias("flags"))


def framing_report(files: DataFrame) -> DataFrame:
    """Rule failures of headers and directories, as rules.report gives them: row, window and aggregate rules."""
    from pyspark.sql import Window

    from ..operators import rules as RU

    h = headers(files)
    good_dir = (F.col("dir_offset") >= 32) & (F.col("dir_offset") + 32 * F.col("chunk_count") <= F.col("size") - 8)
    first = RU.report(h, ["file_id"], {"header.magic": F.col("magic") != "LUMN", "header.version": F.col("version") != 1, "header.dir_offset": ~good_dir, "header.flags_reserved": F.col("flags").bitwiseAND(0b10101) != 0})
    d = descriptors(files).withColumn("stored", F.when(F.col("size_compressed") != 0, F.col("size_compressed")).otherwise(F.col("size_uncompressed"))).withColumn("end", F.col("offset") + F.col("stored"))
    sums = d.groupBy("file_id").agg(
        F.sum("size_uncompressed").alias("sum"),
        *[F.count_if((F.col("chunk_type") == k) & (F.col("offset") != 0)).alias(k.lower()) for k in ("HEAD", "META", "LTBL", "LAYR", "AUTH")],
        F.min_by("chunk_type", F.when(F.col("offset") != 0, F.col("dir_index"))).alias("leader"),
    )
    files_ = h.join(sums, "file_id")
    whole = RU.report(
        files_,
        ["file_id"],
        {
            "header.total_uncompressed_size": (F.col("total") != 0) & (F.col("total") != F.col("sum")),
            "presence.head": F.col("head") == 0,
            "dir.head_first": F.col("leader") != "HEAD",
            "presence.meta": F.col("meta") == 0,
            "presence.ltbl": F.col("ltbl") != 1,
            "presence.layr": F.col("layr") == 0,
            "presence.auth": (bits(F.col("flags"), 3, 1) == 1) & (F.col("auth") == 0),
        },
    )
    w = Window.partitionBy("file_id").orderBy("offset", "stored", "dir_index").rowsBetween(Window.unboundedPreceding, -1)
    real = d.filter("offset <> 0").join(h.select("file_id", "dir_offset", F.col("flags").alias("file_flags")), "file_id").withColumn("before", F.max("end").over(w))
    sealed, encrypted = bits(F.col("flags"), 4, 1) == 1, bits(F.col("file_flags"), 3, 1) == 1
    kind = F.col("chunk_type")
    wrong = (sealed & (~encrypted | kind.isin("HEAD", "AUTH", "LTBL", "LHAS"))) | (encrypted & kind.isin("LAYR", "META", "PROF", "LROV", "VOXL", "ZDIC") & ~sealed)
    each = RU.report(real, ["file_id"], {"dir.chunk_extent": (F.col("offset") < 32) | (F.col("end") > F.col("dir_offset")), "dir.overlap": F.col("before") > F.col("offset"), "crypt.chunk_flags": wrong}, F.col("dir_index"))
    return first.union(whole).union(each)
