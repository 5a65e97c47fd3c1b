"""Rules between the parts of a print, by joins, aggregates and windows over its views.

An entry names a layer chunk, and an override; a frame names a dictionary; a sector names a material.  All files are
checked in one pass of each view, and what a rule needs of two parts meets by their numbers, never by file alone.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layout as L
from . import rules as RU

if TYPE_CHECKING:
    from ..sources.prints import PrintFiles

#: The rules that reference_report checks.
REFERENCES = (
    *("ltbl.layer_index_range", "ltbl.layer_count", "head.multi_sector_flag", "presence.zdic"),
    *("ltbl.sector_id_unique", "ltbl.sector_ids_ascending", "ltbl.first_entry_is_sector_zero"),
    *("layr.content_size_present", "frame.allocation_bound", "layr.dict_id_absent", "layr.dict_id_match"),
    *("ltbl.first_layr_in_range", "ltbl.first_lrov_in_range", "ltbl.offset_within_chunk", "ltbl.slices_disjoint"),
    *("ltbl.first_lrov_null", "lrov.orphan", "meta.sector_material_index"),
)


def reference_report(files: PrintFiles) -> DataFrame:
    """Failures as rules.report gives them, of plain files whose chunks can be parsed."""
    entries, chunks, tables, frames = files.entries(), files.chunk_kinds(), files.tables(), files.frame_headers()
    parts = [_files(tables, entries, frames, chunks), _order(entries), _frames(frames, entries, tables, files.dictionaries()), _entries(entries, chunks, frames), _disjoint(entries), _overrides(entries, chunks, files.objects()), _materials(files.objects())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _files(tables: DataFrame, entries: DataFrame, frames: DataFrame, chunks: DataFrame) -> DataFrame:
    by_layer = entries.groupBy("file_id", "layer").agg(F.count("*").alias("n"))
    walked = by_layer.groupBy("file_id").agg(F.count("*").alias("walked"), F.bool_or(F.col("n") > 1).alias("multi"))
    used = frames.groupBy("file_id").agg(F.bool_or(F.col("dict_id") != 0).alias("used"))
    has = chunks.groupBy("file_id").agg(F.bool_or(F.col("chunk_type") == "ZDIC").alias("dictionary"), F.bool_or((F.col("chunk_type") == "LAYR") & F.col("sealed")).alias("sealed"))
    t = tables.join(walked, "file_id", "left").join(used, "file_id", "left").join(has, "file_id", "left")
    no = F.lit(False)
    return RU.report(
        t,
        ["file_id"],
        {
            "ltbl.layer_index_range": F.coalesce("walked", F.lit(0)) != F.col("declared"),
            "ltbl.layer_count": F.col("declared") != F.col("total_layers"),
            "head.multi_sector_flag": F.coalesce("multi", no) != F.col("multi_sector"),
            "presence.zdic": F.coalesce("dictionary", no) & ~F.coalesce("used", no) & ~F.coalesce("sealed", no),
        },
    )


def _order(entries: DataFrame) -> DataFrame:
    broken = L.sector_order(entries, ["file_id", "layer"], ["entry_idx"], "sector_id")
    names = ("ltbl.sector_id_unique", "ltbl.sector_ids_ascending", "ltbl.first_entry_is_sector_zero")
    return RU.report(broken, ["file_id"], {c: F.col("check") == c for c in names}, F.col("layer"))


def _frames(frames: DataFrame, entries: DataFrame, tables: DataFrame, dictionaries: DataFrame) -> DataFrame:
    slices = entries.groupBy("file_id", F.col("first_layr").alias("dir_index")).agg(F.count_if(F.col("data_size") > 0).alias("slices"))
    first = dictionaries.groupBy("file_id").agg(F.min("dict_id").alias("number"))
    f = frames.join(slices, ["file_id", "dir_index"], "left").join(tables.select("file_id", "pixels"), "file_id").join(first, "file_id", "left")
    named = F.col("dict_id") != 0
    bad = {
        "layr.content_size_present": F.col("content_size").isNull(),
        "frame.allocation_bound": F.col("content_size") > L.allocation_bound(F.coalesce("slices", F.lit(0)), F.col("pixels")),
        "layr.dict_id_absent": named & F.col("number").isNull(),
        "layr.dict_id_match": named & (F.col("number") != F.col("dict_id")),
    }
    return RU.report(f, ["file_id"], bad, F.col("dir_index"))


def _entries(entries: DataFrame, chunks: DataFrame, frames: DataFrame) -> DataFrame:
    kind = lambda name, at: chunks.select("file_id", F.col("dir_index").alias(at), F.col("chunk_type").alias(name))
    sizes = frames.select("file_id", F.col("dir_index").alias("first_layr"), "content_size")
    e = entries.join(kind("layer_kind", "first_layr"), ["file_id", "first_layr"], "left").join(kind("override_kind", "first_lrov"), ["file_id", "first_lrov"], "left").join(sizes, ["file_id", "first_layr"], "left")
    bad = {
        "ltbl.first_layr_in_range": ~F.col("layer_kind").eqNullSafe("LAYR"),
        "ltbl.offset_within_chunk": F.col("data_offset") + F.col("data_size") > F.col("content_size"),
        "ltbl.first_lrov_in_range": (F.col("first_lrov") != 0) & ~F.col("override_kind").eqNullSafe("LROV"),
    }
    return RU.report(e, ["file_id"], bad, F.col("entry_idx"))


def _disjoint(entries: DataFrame) -> DataFrame:
    extents = entries.select("file_id", "first_layr", "entry_idx", F.col("data_offset").alias("start"), (F.col("data_offset") + F.col("data_size")).alias("end"))
    return RU.report(L.overlapping(extents, ["file_id", "first_layr"], "entry_idx"), ["file_id"], {"ltbl.slices_disjoint": F.lit(True)}, F.col("first_layr"))


def _overrides(entries: DataFrame, chunks: DataFrame, objects: DataFrame) -> DataFrame:
    """References of each override are counted; an unnamed one is an orphan, and where no named one says the same, its entry's number is missing."""
    named = entries.groupBy("file_id", F.col("first_lrov").alias("dir_index")).agg(F.count("*").alias("references"))
    texts = objects.filter("chunk_type = 'LROV'").select("file_id", "dir_index", F.sha2("json", 256).alias("digest"))
    o = chunks.filter("chunk_type = 'LROV'").select("file_id", "dir_index").join(texts, ["file_id", "dir_index"], "left").join(named, ["file_id", "dir_index"], "left")
    known = o.filter("references is not null").select("file_id", "digest", F.lit(True).alias("told")).distinct()
    bad = {"ltbl.first_lrov_null": F.col("references").isNull() & F.col("digest").isNotNull() & F.col("told").isNull(), "lrov.orphan": F.col("references").isNull()}
    return RU.report(o.join(known, ["file_id", "digest"], "left"), ["file_id"], bad, F.col("dir_index"))


def _materials(objects: DataFrame) -> DataFrame:
    first = objects.filter("chunk_type = 'META'").groupBy("file_id").agg(F.min_by("json", "dir_index").alias("json"))
    listed = first.select("file_id", F.coalesce(F.json_array_length(F.get_json_object("json", "$.materials")), F.lit(0)).alias("materials"), F.from_json(F.get_json_object("json", "$.sectors"), "array<string>").alias("sectors"))
    each = listed.select("file_id", "materials", F.posexplode("sectors").alias("k", "sector")).withColumn("at", F.get_json_object("sector", "$.material_index"))
    whole = F.col("at").rlike("^-?[0-9]+$")
    bad = F.col("at").isNotNull() & (~whole | ~F.coalesce(F.expr("try_cast(at AS bigint)").between(0, F.col("materials") - 1), F.lit(False)))
    return RU.report(each, ["file_id"], {"meta.sector_material_index": bad}, F.col("k"))


def unknown_keys(objects: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """(file_id, dir_index, chunk_type, unknown): a map from each top-level key that isn't known to its JSON text."""
    values = F.from_json("json", "map<string, string>")
    return objects.select("file_id", "dir_index", "chunk_type", F.map_filter(values, lambda k, _: ~k.isin(*known)).alias("unknown")).filter(F.size("unknown") > 0)
