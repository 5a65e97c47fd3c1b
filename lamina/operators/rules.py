"""The named rules, their order and level, and set-based reports: all failures, the first one, loose or strict.

A report has a row for each failure: keys, rank, ordinal, check, strict_only, detail.  Rules over columns are one
array of structs for each row, so any number of them is one pass without a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: the rules in the order in which they are checked. An asterisk marks strict ones.
CHECKS = """
trailer.magic trailer.crc32c header.magic header.version header.dir_offset dir.descriptor header.flags_reserved
dir.chunk_extent dir.overlap header.total_uncompressed_size presence.head dir.head_first presence.meta presence.ltbl
presence.layr presence.auth crypt.chunk_flags
head.frame head.version head.total_layers head.layer_height head.build_dims head.display_pixels
auth.frame auth.version auth.cipher_known crypt.mode_empty crypt.password_section_len crypt.argon2_budget
crypt.machine_section_len crypt.recipient_entry crypt.no_key crypt.key_unwrap crypt.low_order_point
meta.json meta.required_fields meta.time_integer meta.version meta.exposure meta.layer_height meta.materials_shape
meta.sectors_shape meta.sector_material_index meta.cure_curve meta.temperature_range pwm.range
prof.settings_time_integer prof.profile_type prof.profile_identity prof.settings_exposure prof.settings_layer_height
prof.cure_curve prof.profile_uuid prof.materials_shape
lrov.json lrov.time_integer
prev.flags prev.png_signature* extd.frame extd.ext_type extd.flags extd.critical voxl.signature*
ltbl.version ltbl.entry_size ltbl.entry_count ltbl.layer_index_range ltbl.sector_id_unique ltbl.sector_ids_ascending
ltbl.first_entry_is_sector_zero zdic.single zdic.version zdic.dict_size
ltbl.layer_count head.multi_sector_flag layr.version layr.content_size_present frame.allocation_bound
layr.dict_id_absent layr.dict_id_match zdic.dict_id_match presence.zdic layr.frame_decompressed_size
ltbl.first_layr_in_range ltbl.offset_within_chunk ltbl.first_lrov_in_range ltbl.slices_disjoint ltbl.first_lrov_null
lrov.orphan
ree.tag ree.varint ree.planes* ree.first_value ree.no_run_count_zero* ree.run_lengths* ree.grayscale_runs*
ree.grayscale_all_binary* ree.split_all_binary* ree.split_threshold* ree.split_positions ree.attach_positions
ree.attach_count ree.attach_bits* ree.attach_threshold* ree.end_positions ree.no_trailing_bytes ree.data_size
sector.partition*
lhas.frame lhas.hash_algorithm lhas.layer_count lhas.root_recompute lhas.leaf_match*
crypt.unit_index_binding crypt.tag_verify
""".split()
STRICT = frozenset(c[:-1] for c in CHECKS if c.endswith("*"))
RANK = {c.rstrip("*"): i for i, c in enumerate(CHECKS)}

UUID_PATTERN = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def is_uuid(text: Column) -> Column:
    return text.rlike(f"^{UUID_PATTERN}$")


def report(df: DataFrame, keys: Sequence[str], failing: Mapping[str, Column], ordinal: Column | None = None) -> DataFrame:
    """A row for each rule whose condition is true for a row of df; null is no failure. ordinal: the place within a file."""
    found = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(RANK[name]).alias("rank"), F.lit(name).alias("check"), F.lit(name in STRICT).alias("strict_only"))) for name, bad in failing.items()]
    at = F.lit(0).cast("long") if ordinal is None else ordinal.cast("long")
    rows = df.select(*keys, at.alias("ordinal"), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    return rows.select(*keys, "f.rank", "ordinal", "f.check", "f.strict_only")


def at_level(failures: DataFrame, strict: bool) -> DataFrame:
    return failures if strict else failures.filter(~F.col("strict_only"))


def first_failure(failures: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """keys, check of the failure with the least rank, then ordinal; files without one are absent. One aggregate."""
    return at_level(failures, strict).groupBy(*keys).agg(F.min_by("check", F.struct("rank", "ordinal")).alias("check"))
