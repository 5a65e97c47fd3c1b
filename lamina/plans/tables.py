"""Queries over tables of entries, chunks, hashes and overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ints import bits
from ..operators import layout as L
from ..operators import merkle as M
from ..operators import previews as P
from ..operators import rules as RU
from ..operators.ranking import with_running
from .base import Catalogue, table

tables = Catalogue()
CHATS = "SELECT conv_id, turn, role, text FROM conversations"


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice for each turn of a conversation: the layer, and the sector."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("layer"), F.col("turn").alias("sector"), F.when(F.col("turn") % 3 == 2, 0).otherwise(F.octet_length("text")).cast("long").alias("data_size"))


_SLICES = "WITH s AS (SELECT conv_id AS layer, turn AS sector, CASE WHEN turn % 3 = 2 THEN 0 ELSE strlen(text) END AS data_size, conv_id // 64 AS g FROM conversations)"


@tables.add("""WITH f AS (SELECT role, text, min((conv_id, turn)) AS first FROM conversations GROUP BY ALL),
n AS (SELECT role, text, row_number() OVER (ORDER BY first) - 1 AS shared_index FROM f)
SELECT conv_id, turn, shared_index FROM conversations JOIN n USING (role, text)""")
def override_dedup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return L.shared_index(c, ["role", "text"], ["conv_id", "turn"]).select("conv_id", "turn", "shared_index")


@tables.add("SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def override_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@tables.add("""WITH d AS (SELECT doc_id, md5(text) AS p, doc_id IN (SELECT doc_id FROM labels) AS named FROM documents)
SELECT doc_id FROM d WHERE NOT named AND p NOT IN (SELECT p FROM d WHERE named)""")
def override_unapplied_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("payload"))
    ids = table(spark, sf_dir, "labels").select("doc_id")
    named = d.join(ids, "doc_id", "left_semi").select("payload")
    return d.join(ids, "doc_id", "left_anti").join(named, "payload", "left_anti").select("doc_id")


@tables.add(f"""{_SLICES}, a AS (SELECT *, coalesce(sum(data_size) OVER (PARTITION BY g, sector ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS data_offset,
  CASE WHEN row_number() OVER (PARTITION BY layer ORDER BY sector) = 1 THEN count(*) OVER (PARTITION BY layer) - 1 ELSE 0 END AS additional,
  sum(data_size) OVER (PARTITION BY g, sector) > 0 AS has FROM s)
SELECT layer, sector, data_size, g AS layer_group, data_offset, additional, has AS chunk_has_data,
  CASE WHEN has THEN sector ELSE min(CASE WHEN has THEN sector END) OVER (PARTITION BY layer) END AS home_sector FROM a""")
def ltbl_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.entries(slices(spark, sf_dir), [])


@tables.add("""SELECT conv_id, turn, sum((turn = 0)::INT) OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS layer_index FROM conversations""")
def ltbl_layer_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 4).alias("file"), F.col("turn").alias("sector"))
    return L.with_layer_index(t, ["file"], ["conv_id", "turn"]).select("conv_id", "turn", "layer_index")


@tables.add("""WITH t AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 5 = 0 THEN turn - 1 WHEN conv_id % 7 = 0 THEN 9 - turn ELSE turn END AS sector FROM conversations),
l AS (SELECT *, lag(sector) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
SELECT conv_id, turn, sector, CASE WHEN b IS NULL THEN 'ltbl.first_entry_is_sector_zero' WHEN b = sector THEN 'ltbl.sector_id_unique' ELSE 'ltbl.sector_ids_ascending' END AS "check" FROM l WHERE b IS NULL AND sector <> 0 OR b >= sector""")
def ltbl_sector_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.col("turn") - 1).when(F.col("conv_id") % 7 == 0, 9 - F.col("turn")).otherwise(F.col("turn"))
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", wrong.alias("sector"))
    return L.sector_order(t, ["conv_id"], ["turn"])


@tables.add("""WITH a AS (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM documents),
b AS (SELECT doc_id, source, e - n_chars - CASE WHEN doc_id % 13 = 0 THEN 5 ELSE 0 END AS s, e FROM a)
SELECT y.doc_id, y.source, max(x.e) AS until FROM b x JOIN b y ON x.source = y.source AND (x.s, x.e, x.doc_id) < (y.s, y.e, y.doc_id) AND x.e > y.s AND x.e > x.s AND y.e > y.s GROUP BY ALL""")
def slice_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted overlaps; the oracle is the interval self-join."""
    d = with_running(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], F.col("n_chars"), "end").withColumn("end", F.col("end") + F.col("n_chars"))
    d = d.withColumn("start", F.col("end") - F.col("n_chars") - F.when(F.col("doc_id") % 13 == 0, 5).otherwise(0))
    return L.overlapping(d, ["source"], "doc_id", large=True).select("doc_id", "source", "until")


@tables.add(f"""{_SLICES}, c AS (SELECT layer // 8 AS chunk, count(*) FILTER (data_size > 0) AS slices, sum(data_size)::BIGINT AS declared FROM s GROUP BY 1)
SELECT chunk, slices, declared, greatest(slices, 1) * (5 * 90 + 64) AS bound, declared <= greatest(slices, 1) * (5 * 90 + 64) AS fits FROM c""")
def chunk_alloc_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = slices(spark, sf_dir).groupBy(F.floor(F.col("layer") / 8).alias("chunk")).agg(F.count_if(F.col("data_size") > 0).alias("slices"), F.sum("data_size").alias("declared"))
    bound = L.allocation_bound(F.col("slices"), 90)
    return c.select("chunk", "slices", "declared", bound.alias("bound"), (F.col("declared") <= bound).alias("fits"))


@tables.add("""SELECT doc_id, source, (32 + coalesce(sum((strlen(text) + 7) // 8 * 8) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM documents""")
def directory_layout_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("size"))
    return L.with_payload_offsets(d, ["source"], ["doc_id"], "size").drop("size")


_LEAF = "sha256('\\x00'::BLOB || encode(text))"


@tables.add(f"SELECT doc_id, {_LEAF} AS leaf FROM documents")
def leaf_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(F.hex(M.leaf(F.col("text")))).alias("leaf"))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each source, a layer for each document."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", M.leaf(F.col("text")).alias("hash"))
    return with_running(d, ["source"], ["doc_id"], F.lit(1).cast("long"), "idx").select("source", "idx", "hash")


_TREE = f"""WITH RECURSIVE l AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, unhex({_LEAF}) AS h FROM documents),
t AS (SELECT 0 AS level, source, i, h FROM l UNION ALL
  SELECT level + 1, source, i // 2, CASE WHEN r IS NULL THEN h ELSE unhex(sha256('\\x01'::BLOB || h || r)) END
  FROM (SELECT *, lead(h) OVER (PARTITION BY source ORDER BY i) AS r, count(*) OVER (PARTITION BY source) AS n FROM t) WHERE i % 2 = 0 AND n > 1)"""


@tables.add(f"{_TREE} SELECT source, lower(hex(h)) AS root FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY level DESC) = 1")
def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.root(leaves(spark, sf_dir), ["source"]).select("source", F.lower(F.hex("hash")).alias("root"))


@tables.add(f"""{_TREE}, w AS (SELECT source, count(*) // 3 AS i FROM l GROUP BY source),
p AS (SELECT w.source, w.i AS idx, t.level, CASE WHEN (w.i >> t.level) % 2 = 0 THEN 'right' ELSE 'left' END AS side, lower(hex(t.h)) AS sibling
  FROM w JOIN t ON t.source = w.source AND t.i = xor(w.i >> t.level, 1))
SELECT source, idx, level, side, sibling FROM p""")
def merkle_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_leaves = leaves(spark, sf_dir)
    wanted = all_leaves.groupBy("source").agg(F.floor(F.count("*") / 3).alias("idx"))
    return M.paths(all_leaves, ["source"], wanted).withColumn("sibling", F.lower(F.hex("sibling")))


@tables.add("SELECT source, true AS verified FROM documents GROUP BY source")
def merkle_path_verifies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root from a leaf and its path is the root of the tree."""
    all_leaves = leaves(spark, sf_dir)
    wanted = all_leaves.groupBy("source").agg(F.floor(F.count("*") / 3).alias("idx"))
    steps = M.paths(all_leaves, ["source"], wanted).groupBy("source", "idx").agg(F.sort_array(F.collect_list(F.struct("level", "side", "sibling"))).alias("steps"))
    d = wanted.join(all_leaves, ["source", "idx"]).join(steps, ["source", "idx"], "left").join(M.root(all_leaves, ["source"]).withColumnRenamed("hash", "root"), "source")
    path = F.coalesce("steps", F.array().cast("array<struct<level:int,side:string,sibling:binary>>"))
    return d.select("source", (M.root_of_path(F.col("hash"), path) == F.col("root")).alias("verified"))


@tables.add("SELECT doc_id FROM documents WHERE doc_id % 50 = 0 AND length(text) > 0")
def leaf_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored leaves, of which some are planted wrong, against the leaves of the data."""
    d = table(spark, sf_dir, "documents")
    damaged = F.when(F.col("doc_id") % 50 == 0, F.expr("substr(text, 2)")).otherwise(F.col("text"))
    stored = d.select("doc_id", M.leaf(damaged).alias("stored"))
    return d.select("doc_id", M.leaf(F.col("text")).alias("leaf")).join(stored, "doc_id").filter("leaf <> stored").select("doc_id")


@tables.add("""SELECT page_id, regexp_matches(u, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') AS uuid_ok, regexp_matches(c, '^[\\x20-\\x7E]{4}$') AS fourcc_ok
FROM (SELECT page_id, left(m, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || CASE WHEN page_id % 5 = 0 THEN '' ELSE '-' END || substr(m, 21) AS u, substr(url, 8, 3 + (page_id % 3)::INT) AS c FROM (SELECT *, md5(url) AS m FROM pages))""")
def uuid_and_fourcc_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.md5("url")
    part = lambda a, n: F.substring(m, a, n)
    uuid = F.concat(F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4)), F.when(F.col("page_id") % 5 == 0, "").otherwise("-"), part(21, 12))
    code = F.expr("substr(url, 8, cast(3 + page_id % 3 as int))")
    return table(spark, sf_dir, "pages").select("page_id", RU.is_uuid(uuid).alias("uuid_ok"), code.rlike("^[\\x20-\\x7E]{4}$").alias("fourcc_ok"))


@tables.add("""SELECT page_id // 8 AS file, page_id, (page_id % 4)::INT AS role FROM pages WHERE page_id % 8 <> 1
QUALIFY row_number() OVER (PARTITION BY page_id // 8 ORDER BY CASE page_id % 4 WHEN 1 THEN 1 WHEN 0 THEN 2 WHEN 2 THEN 3 ELSE 4 END, page_id) = 1""")
def preview_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thumbnail that a file shows: the first of the most wanted role."""
    p = table(spark, sf_dir, "pages").filter("page_id % 8 <> 1").select(F.floor(F.col("page_id") / 8).alias("file"), "page_id", (F.col("page_id") % 4).cast("int").alias("role"))
    best = F.min_by(F.struct("page_id", "role"), F.struct(P.role_rank(F.col("role")), "page_id"))
    return p.groupBy("file").agg(best.alias("best")).select("file", "best.page_id", "best.role")


@tables.add("""SELECT doc_id, (f >> 8) & 65535 AS vendor, (f >> 24) & 1 = 1 AS critical, (f >> 4) & 1 = 1 AS sealed, (f >> 25) <> 0 OR f & 239 <> 0 AS reserved_set
FROM (SELECT doc_id, (doc_id * 2654435761) % 4294967296 AS f FROM documents)""")
def extension_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("f")
    d = table(spark, sf_dir, "documents").select("doc_id", ((F.col("doc_id") * F.lit(2654435761)) % F.lit(4294967296)).alias("f"))
    return d.select("doc_id", bits(f, 8, 16).alias("vendor"), (bits(f, 24, 1) == 1).alias("critical"), (bits(f, 4, 1) == 1).alias("sealed"), ((F.shiftright(f, 25) != 0) | (f.bitwiseAND(239) != 0)).alias("reserved_set"))


@tables.add("""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n, left(text, 1024) AS part FROM documents)
SELECT doc_id, position, md5(part) AS "window" FROM n WHERE position % greatest((n + 255) // 256, 1) = 0""")
def dictionary_sample_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.substring("text", 1, 1024)).alias("window"))
    return L.sample_strided(d, ["doc_id"]).select("doc_id", "position", "window")


@tables.add(f"{_SLICES} SELECT DISTINCT layer FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE b.layer = a.layer AND b.sector > 0 AND b.data_size > 0)")
def single_material_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = slices(spark, sf_dir)
    return s.select("layer").distinct().join(s.filter("sector > 0 and data_size > 0").select("layer"), "layer", "left_semi")


@tables.add("SELECT sector, layer // 64 AS layer_group, count(*) FILTER (data_size > 0) AS n_slices, sum(data_size)::BIGINT AS bytes FROM (SELECT * EXCLUDE (g) FROM (" + _SLICES + " SELECT * FROM s)) GROUP BY ALL HAVING sum(data_size) > 0")
def chunk_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of layers of one sector that get a chunk; those without bytes get none."""
    g = slices(spark, sf_dir).groupBy("sector", F.floor(F.col("layer") / 64).alias("layer_group")).agg(F.count_if(F.col("data_size") > 0).alias("n_slices"), F.sum("data_size").alias("bytes"))
    return g.filter("bytes > 0")


@tables.add("SELECT DISTINCT layer, sector FROM (SELECT conv_id AS layer, turn AS sector FROM conversations UNION ALL SELECT conv_id, 0 FROM conversations UNION ALL SELECT doc_id, 1 FROM labels WHERE toxic = 1)")
def sector_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors of a layer: those with data, the primary one, and those with overrides."""
    c, x = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "labels")
    data = c.select(F.col("conv_id").alias("layer"), F.col("turn").cast("long").alias("sector"))
    return data.union(c.select("conv_id", F.lit(0).cast("long"))).union(x.filter("toxic = 1").select("doc_id", F.lit(1).cast("long"))).distinct()


@tables.add("SELECT doc_id, strlen(text) + 28 AS sealed_bytes, true AS opened, true AS refused FROM documents")
def aes_unit_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units sealed under their own index open under it, and under no other."""
    from ..functions.sealed import open_unit, seal_unit

    key = F.unhex(F.lit("00112233445566778899aabbccddeeff" * 2))
    nonce = F.unhex(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 24))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("plain"), nonce.alias("nonce"))
    d = d.withColumn("sealed", seal_unit(F.col("plain"), key, F.col("nonce"), "LAYR", F.col("doc_id")))
    good, bad = (open_unit(F.col("sealed"), key, "LAYR", F.col("doc_id") + i) for i in (0, 1))
    return d.select("doc_id", F.octet_length("sealed").cast("long").alias("sealed_bytes"), (good == F.col("plain")).alias("opened"), bad.isNull().alias("refused"))
