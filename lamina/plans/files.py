"""Queries over rules, and over container files that the queries write themselves."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ints import int_div
from ..operators import rules as RU
from ..operators.previews import png
from ..operators.references import REFERENCES, reference_report, unknown_keys
from ..operators.validate import validate
from ..session import materialise
from ..sources.prints import PrintFiles, write_prints
from .base import PIXELS, Catalogue, pixels, table
from .defects import DEFECTS, FRAMED, FRAMING, LABEL, META, STREAMS, key_cases, planted

files = Catalogue()

WIDTH = 64


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HEAD and META values of a file for each part, some of them wrong."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("file"), (k % 11).alias("total_layers"), (F.col("p_size") - 2).alias("layer_height"), (k % 7 * 100).alias("build_w"), (F.col("p_size") * 6).alias("light_pwm"), F.round(F.col("p_retailprice") / 12, 2).alias("chamber"), (k % 5 == 0).alias("unsigned_png"))


_BAD = {
    "head.total_layers": "total_layers = 0",
    "head.layer_height": "layer_height <= 0",
    "head.build_dims": "build_w = 0",
    "pwm.range": "light_pwm > 255",
    "meta.temperature_range": "chamber > 120",
    "prev.png_signature": "unsigned_png",
}
_FACTS_SQL = "f AS (SELECT p_partkey AS file, p_partkey % 11 AS total_layers, p_size - 2 AS layer_height, p_partkey % 7 * 100 AS build_w, p_size * 6 AS light_pwm, round(p_retailprice / 12, 2) AS chamber, p_partkey % 5 = 0 AS unsigned_png FROM part)"
_REPORT_SQL = f"WITH {_FACTS_SQL}, r AS (" + " UNION ALL ".join(f"SELECT file, {RU.RANK[c]} AS rank, '{c}' AS \"check\", {str(c in RU.STRICT).lower()} AS strict_only FROM f WHERE {w}" for c, w in _BAD.items()) + ")"


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RU.report(facts(spark, sf_dir), ["file"], {c: F.expr(w) for c, w in _BAD.items()})


@files.add(f"{_REPORT_SQL} SELECT file, rank, 0::BIGINT AS ordinal, \"check\", strict_only FROM r")
def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir)


@files.add(f"{_REPORT_SQL} SELECT file, arg_min(\"check\", rank) AS \"check\" FROM r WHERE NOT strict_only GROUP BY file")
def rule_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RU.first_failure(report(spark, sf_dir), ["file"])


@files.add(f"{_REPORT_SQL} SELECT strict_only, count(*) AS failures, count(DISTINCT file) AS n_files FROM r GROUP BY strict_only")
def rule_loose_vs_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).groupBy("strict_only").agg(F.count("*").alias("failures"), F.count_distinct("file").alias("n_files"))


def spans(spark: SparkSession, sf_dir: str, n_files: int = 4) -> DataFrame:
    """The print of the events as files of every fourth layer: exposed spans of each sector."""
    p = pixels(spark, sf_dir).filter("value <> 0")
    lit = p.select((F.col("layer") % n_files).cast("string").alias("file_id"), int_div(F.col("layer"), n_files).cast("int").alias("layer"), F.col("sector").cast("long").alias("sector_id"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value")
    return lit


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files, as bytes; written once, as every view reads them."""
    s = spans(spark, sf_dir)
    heads = s.groupBy("file_id").agg(F.lit(WIDTH).alias("width"), (F.max("end") / WIDTH + 1).cast("int").alias("height"), (F.max("layer") + 1).alias("total_layers"), F.lit(json.dumps(META)).alias("meta"))
    return materialise(write_prints(s, heads, per_chunk=8), "prints")


_EXPOSED = f"""WITH {PIXELS}, a AS (SELECT *, CASE WHEN value = lag(value) OVER w AND sector = lag(sector) OVER w THEN 0 ELSE 1 END AS n FROM px WINDOW w AS (PARTITION BY layer ORDER BY pos)),
b AS (SELECT *, sum(n) OVER (PARTITION BY layer ORDER BY pos) AS r FROM a)
SELECT (layer % 4)::VARCHAR AS file_id, (layer // 4)::INT AS layer, any_value(sector)::BIGINT AS sector_id, min(pos) AS start, max(pos) + 1 AS "end", any_value(value)::INT AS value FROM b GROUP BY layer, r HAVING any_value(value) <> 0"""


@files.add(_EXPOSED)
def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded into files and decoded again: the exposed runs of every layer and sector."""
    return PrintFiles(written(spark, sf_dir)).runs(strict=True, exposed=True).drop("run_idx")


@files.add("SELECT (l % 4)::VARCHAR AS file_id, 64::BIGINT AS width, count(*) AS n_layers, 0::BIGINT AS n_failures FROM (SELECT DISTINCT user_id AS l FROM events) GROUP BY 1")
def container_is_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that the sink writes break no rule, strict ones included."""
    f = written(spark, sf_dir)
    bad = validate(f).groupBy("file_id").agg(F.count("*").alias("n"))
    heads = PrintFiles(f).heads().join(bad, "file_id", "left")
    layers = PrintFiles(f).entries().filter("data_size > 0").groupBy("file_id").agg(F.count_distinct("layer").alias("n_layers"))
    return heads.join(layers, "file_id").select("file_id", "width", "n_layers", F.coalesce("n", F.lit(0)).cast("long").alias("n_failures"))


@files.add("SELECT (user_id % 4)::VARCHAR AS file_id, max(user_id // 4)::BIGINT + 1 AS n_layers, true AS matches FROM events GROUP BY 1")
def container_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of the decoded files, folded to a root that must equal the stored one."""
    from ..operators import merkle as M

    leaves = PrintFiles(written(spark, sf_dir)).leaves()
    root = M.root(leaves.select("file_id", F.col("layer").cast("long").alias("idx"), F.col("leaf").alias("hash")), ["file_id"])
    stored = leaves.groupBy("file_id").agg(F.max("root").alias("root"), F.count("*").alias("n_layers"))
    return stored.join(root, "file_id").select("file_id", "n_layers", (F.col("hash") == F.col("root")).alias("matches"))


@files.add("SELECT f || '#' || k AS file_id, true AS named FROM (SELECT DISTINCT (user_id % 4)::VARCHAR AS f FROM events), (SELECT unnest(generate_series(0, 39)) AS k)")
def container_damage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with one byte changed at each of 40 places: the trailer's rules come first and name them all."""
    f = written(spark, sf_dir)
    place = F.explode(F.sequence(F.lit(0), F.lit(39)))
    n = F.octet_length("content")
    at = (F.col("k") * 7919 % n + 1).cast("int")
    cut = lambda a, b: F.substring(F.col("content"), a, b)
    flipped = F.unhex(F.lpad(F.hex((F.conv(F.hex(cut(at, 1)), 16, 10).cast("int").bitwiseXOR(F.lit(85)))), 2, "0"))
    damaged = f.withColumn("k", place).select(F.concat_ws("#", "path", F.col("k").cast("string")).alias("path"), F.concat(cut(1, at - 1), flipped, cut(at + 1, n)).alias("content"))
    return RU.first_failure(validate(damaged), ["file_id"]).select("file_id", F.col("check").isin("trailer.crc32c", "trailer.magic").alias("named"))


@files.add(f"""WITH {PIXELS}, s AS (SELECT DISTINCT (layer % 4)::VARCHAR AS f, layer // 4 AS k, sector FROM px WHERE value <> 0),
n AS (SELECT (layer % 4)::VARCHAR AS f, max(layer // 4) FILTER (value <> 0) + 1 AS layers FROM px GROUP BY 1),
e AS (SELECT f, layers + coalesce((SELECT count(*) FROM s WHERE s.f = n.f AND sector > 0), 0) AS entries, layers, (SELECT count(DISTINCT (k // 8, sector)) FROM s WHERE s.f = n.f) AS chunks FROM n)
SELECT f AS file_id, t.kind AS chunk_type, CASE WHEN t.kind = 'LAYR' THEN chunks ELSE 1 END AS n,
  CASE t.kind WHEN 'HEAD' THEN 50 WHEN 'LTBL' THEN 16 + 28 * entries WHEN 'LHAS' THEN 38 + 32 * layers END::BIGINT AS bytes FROM e, (VALUES ('HEAD'), ('META'), ('LTBL'), ('LHAS'), ('LAYR')) AS t(kind)""")
def inspector_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory as an inspector sums it up: chunks of each kind, and the bytes of those whose size the print fixes."""
    c = PrintFiles(written(spark, sf_dir)).chunks()
    fixed = F.when(F.col("chunk_type").isin("HEAD", "LTBL", "LHAS"), F.col("size_uncompressed"))
    return c.groupBy("file_id", "chunk_type").agg(F.count("*").alias("n"), F.sum(fixed).alias("bytes"))


def furnished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files with all that a print may carry: a profile, overrides, a preview, an extension, a scene, a dictionary."""
    s = spans(spark, sf_dir)
    k = F.col("file_id").cast("int")
    extension = F.struct(k.alias("vendor"), F.lit(False).alias("critical"), F.lit("NOTE").alias("ext_type"), F.encode(F.concat(F.lit("file "), "file_id"), "UTF-8").alias("data"))
    heads = s.groupBy("file_id").agg(F.lit(WIDTH).alias("width"), (F.max("end") / WIDTH + 1).cast("int").alias("height"), (F.max("layer") + 1).alias("total_layers"), F.lit(json.dumps(META)).alias("meta"))
    heads = heads.select(
        "*",
        F.concat(F.lit("writer "), "file_id").alias("encoder"),
        (k + 1_700_000_000).cast("long").alias("created"),
        (k * 10 + 500).alias("build_w"),
        F.lit(json.dumps(PROFILE)).alias("profile"),
        F.array(F.struct(F.lit(1).alias("role"), F.lit(png(np.zeros((4, 5), np.uint8))).alias("image"))).alias("previews"),
        F.array(extension).alias("extensions"),
        F.encode(F.concat(F.lit("VOXL scene "), "file_id"), "UTF-8").alias("scene"),
    )
    settings = F.to_json(F.struct((F.col("layer") % 4 + 2500).alias("normal_exposure_ms")))
    overrides = s.filter("layer % 3 = 0").select("file_id", "layer", F.lit(0).cast("long").alias("sector_id")).distinct().withColumn("settings", settings)
    return materialise(write_prints(s, heads, per_chunk=8, overrides=overrides, dictionary=True), "furnished")


PROFILE = {"profile_type": "material", "profile_name": "plain", "profile_version": "1", "profile_uuid": "12345678-1234-1234-1234-1234567890ab", "settings": META}
_FILES = "(SELECT DISTINCT (user_id % 4)::VARCHAR AS f FROM events)"


@files.add(f"""SELECT f AS file_id, 'writer ' || f AS encoder, 1700000000 + f::BIGINT AS created, 500 + 10 * f::BIGINT AS build_w, 'plain' AS profile_name,
  1 AS role, f::BIGINT AS vendor, 'NOTE' AS ext_type, 'file ' || f AS note, 'VOXL scene ' || f AS scene, false AS encrypted, true AS multi_sector, 0::BIGINT AS failures FROM {_FILES}""")
def container_furnished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sink is told beside the layers, read back by the views; the files break no rule."""
    f = furnished(spark, sf_dir)
    p = PrintFiles(f)
    bad = validate(f).groupBy("file_id").agg(F.count("*").alias("n"))
    profile = p.objects().filter("chunk_type = 'PROF'").select("file_id", F.get_json_object("json", "$.profile_name").alias("profile_name"))
    notes = p.extensions().select("file_id", F.col("vendor").cast("long").alias("vendor"), "ext_type", F.decode("data", "UTF-8").alias("note"))
    scenes = p.scenes().select("file_id", F.decode("scene", "UTF-8").alias("scene"))
    out = p.heads().select("file_id", "encoder", "created", "build_w")
    for more in (profile, p.previews().select("file_id", "role"), notes, scenes, p.flags().select("file_id", "encrypted", "multi_sector")):
        out = out.join(more, "file_id")
    return out.join(bad, "file_id", "left").withColumn("failures", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


@files.add(f"""WITH {PIXELS} SELECT DISTINCT (layer % 4)::VARCHAR AS file_id, (layer // 4)::INT AS layer, 0::BIGINT AS sector_id, (2500 + (layer // 4) % 4)::BIGINT AS exposure FROM px WHERE value <> 0 AND (layer // 4) % 3 = 0""")
def container_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides of layers, found from the table's entries; equal ones share a chunk."""
    p = PrintFiles(furnished(spark, sf_dir))
    held = p.objects().filter("chunk_type = 'LROV'").select("file_id", F.col("dir_index").cast("long").alias("first_lrov"), F.get_json_object("json", "$.normal_exposure_ms").cast("long").alias("exposure"))
    return p.entries().filter("first_lrov > 0").join(held, ["file_id", "first_lrov"]).select("file_id", "layer", "sector_id", "exposure")


@files.add(f"""WITH {PIXELS} SELECT (layer % 4)::VARCHAR AS file_id, (layer // 4)::INT AS layer, sector::BIGINT AS sector_id, count(*) AS exposed, min(pos)::BIGINT AS "first", max(pos)::BIGINT AS "last"
FROM px WHERE value <> 0 GROUP BY ALL""")
def inspector_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inspector's rows: the exposed pixels of each layer and sector, and the first and last of them."""
    return PrintFiles(furnished(spark, sf_dir)).inspect_layers().select("file_id", "layer", "sector_id", "exposed", "first", "last")


@files.add(f"""WITH {PIXELS}, s AS (SELECT DISTINCT (layer % 4)::VARCHAR AS f, layer // 4 AS k, sector FROM px WHERE value <> 0)
SELECT f AS file_id, max(k)::BIGINT + 1 AS layers, max(k)::BIGINT + 1 + count(*) FILTER (sector > 0) AS entries, count(DISTINCT (k // 8, sector)) AS frames,
  count(DISTINCT k) FILTER (k % 3 = 0) AS overridden FROM s GROUP BY f""")
def inspector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PrintFiles(furnished(spark, sf_dir)).inspect().select("file_id", "layers", "entries", "frames", "overridden")


#: Rules of that group that need a checksum or frames; a file without a header has no row here.
PYTHON_ONLY = ("trailer.magic", "trailer.crc32c", "header.magic", "presence.zdic")


def _values(rows) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in rows) + ")"


def _planted(spark: SparkSession, group: str) -> DataFrame:
    """The first rule that each file of the group breaks."""
    cases = spark.createDataFrame([(case, data) for case, _, data in planted(group)], "path string, content binary")
    return RU.first_failure(validate(cases), ["file_id"], True).select(F.col("file_id").alias("case"), "check")


@files.add(_values((f"framing {i}", c) for i, c in enumerate([c for c, _ in FRAMING] + [c for c, _, _ in DEFECTS if c.startswith(FRAMED)])) + ' AS t("case", "check")')
def rules_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, directories and presence: a file for each planted defect."""
    return _planted(spark, "framing")


@files.add(_values((f"chunks {i}", c) for i, c in enumerate(c for c, _, _ in DEFECTS if not c.startswith(FRAMED))) + ' AS t("case", "check")')
def rules_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads, JSON, tables, dictionaries, hashes and keys: a file for each planted defect."""
    return _planted(spark, "chunks")


@files.add(_values((f"streams {i}", c) for i, c in enumerate([c for c, _ in STREAMS] + ["sector.partition", "lhas.leaf_match"])) + ' AS t("case", "check")')
def rules_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-end streams, sectors and leaves: a file for each planted defect."""
    return _planted(spark, "streams")


@files.add(_values((f"{i}", c) for i, c in enumerate((None, None, "crypt.key_unwrap", "crypt.no_key", "crypt.no_key", "crypt.low_order_point", "crypt.unit_index_binding", "crypt.tag_verify"))) + ' AS t("case", "check")')
def rules_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted files with right and wrong keys: what the report says first."""
    found = None
    for i, (_, data, password, secret) in enumerate(key_cases()):
        case = spark.createDataFrame([(str(i), data)], "path string, content binary")
        check = RU.first_failure(validate(case, label=LABEL, password=password, secret=secret), ["file_id"], True)
        one = case.join(check, F.col("path") == F.col("file_id"), "left").select(F.col("path").alias("case"), "check")
        found = one if found is None else found.union(one)
    return found


@files.add(_values((f"framing {i}", c) for i, c in enumerate([c for c, _ in FRAMING] + [c for c, _, _ in DEFECTS if c.startswith(FRAMED)]) if c not in PYTHON_ONLY) + ' AS t("case", "check")')
def rules_framing_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by expressions alone: of the rules that a file breaks, the planted one."""
    from ..sources.directory import framing_report

    wanted = [(case, check, data) for case, check, data in planted("framing") if check not in PYTHON_ONLY]
    cases = spark.createDataFrame([(case, data) for case, _, data in wanted], "path string, content binary")
    expected = spark.createDataFrame([(case, check) for case, check, _ in wanted], "file_id string, check string")
    return framing_report(cases).select("file_id", "check").distinct().join(expected, ["file_id", "check"]).withColumnRenamed("file_id", "case")


def _reference_cases() -> list[tuple[str, str, bytes]]:
    return [(case, check, data) for group in ("framing", "chunks") for case, check, data in planted(group) if check in REFERENCES]


@files.add(_values((case, c) for case, c, _ in _reference_cases()) + ' AS t("case", "check")')
def rules_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules between entries, chunks, dictionaries, overrides and materials, by joins: the first that each planted file breaks."""
    cases = spark.createDataFrame([(case, data) for case, _, data in _reference_cases()], "path string, content binary")
    return RU.first_failure(reference_report(PrintFiles(cases)), ["file_id"], True).select(F.col("file_id").alias("case"), "check")


@files.add("SELECT p_partkey::VARCHAR AS file_id, p_brand AS brand, p_size::VARCHAR AS size, 2 AS n FROM part")
def unknown_keys_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of settings that the format doesn't name, as a map."""
    p = table(spark, sf_dir, "part")
    text = F.to_json(F.struct(F.lit(1).alias("meta_version"), F.lit(2500).alias("normal_exposure_ms"), F.col("p_brand").alias("vendor_brand"), F.col("p_size").alias("vendor_size")))
    objects = p.select(F.col("p_partkey").cast("string").alias("file_id"), F.lit(1).alias("dir_index"), F.lit("META").alias("chunk_type"), text.alias("json"))
    found = unknown_keys(objects, tuple(META))
    return found.select("file_id", F.col("unknown")["vendor_brand"].alias("brand"), F.col("unknown")["vendor_size"].alias("size"), F.size("unknown").alias("n"))


@files.add("SELECT (l % 4)::VARCHAR AS file_id, 0::BIGINT AS failures, true AS head_first FROM (SELECT DISTINCT user_id AS l FROM events) GROUP BY 1")
def container_directory_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers and directories by expressions alone, and their framing rules."""
    from ..sources.directory import descriptors, framing_report

    f = written(spark, sf_dir)
    bad = framing_report(f).groupBy("file_id").agg(F.count("*").alias("n"))
    first = descriptors(f).groupBy("file_id").agg((F.min_by("chunk_type", "dir_index") == "HEAD").alias("head_first"))
    return first.join(bad, "file_id", "left").select("file_id", F.coalesce("n", F.lit(0)).cast("long").alias("failures"), "head_first")


@files.add("""SELECT p_partkey, field, expected, found FROM (
 SELECT p_partkey, 'p_size' AS field, p_size::VARCHAR AS expected, (p_size + 1)::VARCHAR AS found FROM part WHERE p_partkey % 9 = 0 AND p_partkey % 10 <> 0
 UNION ALL SELECT p_partkey, 'missing', NULL, NULL FROM part WHERE p_partkey % 10 = 0)""")
def manifest_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An expected table against a found one, with planted differences."""
    from ..operators.compare import differences

    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    found = p.filter("p_partkey % 10 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 9 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return differences(p, found, ["p_partkey"])
