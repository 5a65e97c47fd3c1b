"""Queries over the pixels and runs of layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs as R
from .base import CORE_RUNS, PIXELS, RUNS, Catalogue, pixels, plane_counts_sql, planes_sql, runs_sql, varint_sql

layers = Catalogue()
KEYS = ["layer"]


@layers.add(f"{RUNS} SELECT layer, run_idx::BIGINT AS run_idx, s AS start, e AS \"end\", value::INT AS value FROM runs")
def runs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.maximal_runs(pixels(spark, sf_dir), KEYS)


@layers.add(f"{CORE_RUNS} SELECT layer, run_idx::BIGINT AS run_idx, s AS start, e AS \"end\", value::INT AS value FROM core")
def runs_threshold_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return R.maximal_runs(p.withColumn("value", R.threshold(F.col("value"))), KEYS)


@layers.add(f"WITH {PIXELS} SELECT layer, pos, value::INT AS value, pos - coalesce(lag(pos) OVER (PARTITION BY layer ORDER BY pos), 0) AS delta FROM px WHERE value NOT IN (0, 255)")
def aa_overlay_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.overlay(pixels(spark, sf_dir), KEYS)


@layers.add(f"""{CORE_RUNS} SELECT p.layer, p.pos, p.value::INT AS value, c.run_idx::BIGINT AS run_idx,
CASE WHEN p.pos = c.s THEN 'first' WHEN p.pos = c.e - 1 THEN 'last' ELSE 'escape' END AS kind
FROM px p ASOF JOIN core c ON p.layer = c.layer AND p.pos >= c.s WHERE p.value NOT IN (0, 255)""")
def aa_attach_or_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.attachment(pixels(spark, sf_dir), KEYS)


_STORED = f"""{CORE_RUNS}, st AS (SELECT layer, run_idx::BIGINT AS j, len AS length, is_last,
  CASE WHEN run_idx < 2 THEN len WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS stored
  FROM (SELECT *, len - lag(len, 2) OVER (PARTITION BY layer ORDER BY run_idx) AS d FROM core))"""


@layers.add(f"{_STORED} SELECT layer, j, length, stored FROM st WHERE NOT is_last")
def parity_delta_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    return R.stored_lengths(R.maximal_runs(p.withColumn("value", R.threshold(F.col("value"))), KEYS), KEYS)


@layers.add(f"{CORE_RUNS} SELECT layer, run_idx::BIGINT AS j, len AS length FROM core WHERE NOT is_last")
def unzigzag_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.restored_lengths(parity_delta_lengths(spark, sf_dir).drop("length"), KEYS)


@layers.add(f"{CORE_RUNS} SELECT layer, {plane_counts_sql('len', 'c', 'NOT is_last')} FROM core GROUP BY layer")
def varint_plane_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(spark, sf_dir)
    core = R.maximal_runs(p.withColumn("value", R.threshold(F.col("value"))), KEYS)
    inner = core.withColumn("inner", F.lead("run_idx").over(R.over(KEYS, "run_idx")).isNotNull())
    return inner.groupBy("layer").agg(*R.plane_counts(F.col("end") - F.col("start"), F.col("inner"), "c"))


_SIZES = f"""{_STORED},
{runs_sql('value', 'runs')},
f AS (SELECT layer, count(*) AS k_runs, bool_and(value IN (0, 255)) AS binary_only, {plane_counts_sql('len', 'r', 'NOT is_last')} FROM runs GROUP BY layer),
c AS (SELECT layer, count(*) AS k_core, {plane_counts_sql('len', 'c', 'NOT is_last')} FROM core GROUP BY layer),
p AS (SELECT layer, {plane_counts_sql('stored', 'e', 'NOT is_last AND j % 2 = 0')}, {plane_counts_sql('stored', 'o', 'NOT is_last AND j % 2 = 1')} FROM st GROUP BY layer),
aa AS (SELECT p.layer, p.pos, p.value, p.pos > c.s AND p.pos < c.e - 1 AS inside FROM px p ASOF JOIN core c ON p.layer = c.layer AND p.pos >= c.s WHERE p.value NOT IN (0, 255)),
ab AS (SELECT *, pos - coalesce(lag(pos) OVER w, 0) AS step, value - lag(value) OVER w AS d FROM aa WINDOW w AS (PARTITION BY layer ORDER BY pos)),
ac AS (SELECT *, CASE WHEN d IS NULL THEN value WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z FROM ab),
m AS (SELECT layer, count(*) AS n_edge, {plane_counts_sql('step', 's')}, {plane_counts_sql('z', 'v')} FROM ac GROUP BY layer),
h AS (SELECT layer, count(*) AS n_escape, {plane_counts_sql('hop', 'h')} FROM (SELECT layer, pos - coalesce(lag(pos) OVER (PARTITION BY layer ORDER BY pos), 0) AS hop FROM aa WHERE inside) GROUP BY layer),
sizes AS (SELECT layer, k_runs, k_core, coalesce(n_edge, 0) AS n_edge, coalesce(n_escape, 0) AS n_escape, binary_only,
  2 + {varint_sql('k_core')} + {planes_sql('c')} AS t0,
  1 + {varint_sql('k_runs')} + k_runs + {planes_sql('r')} AS tag1,
  2 + {varint_sql('k_core')} + {planes_sql('e')} + {planes_sql('o')} + {varint_sql('coalesce(n_edge, 0)')} + (k_core + 3) // 4 + {varint_sql('coalesce(n_escape, 0)')} + {planes_sql('h')} + {planes_sql('v')} AS tag3,
  {varint_sql('coalesce(n_edge, 0)')} + {planes_sql('s')} + coalesce(n_edge, 0) AS more
  FROM f JOIN c USING (layer) LEFT JOIN p USING (layer) LEFT JOIN m USING (layer) LEFT JOIN h USING (layer))"""


@layers.add(f"{_SIZES} SELECT layer, k_runs, k_core, n_edge, n_escape, binary_only, CASE WHEN binary_only THEN t0 END AS tag0, tag1, t0 + more AS tag2, tag3 FROM sizes")
def stream_length_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.stream_lengths(pixels(spark, sf_dir), KEYS)


@layers.add(f"{_SIZES} SELECT layer, CASE WHEN binary_only THEN 0 WHEN t0 + more < tag1 THEN 2 ELSE 1 END AS tag, CASE WHEN binary_only THEN t0 ELSE least(tag1, t0 + more) END AS bytes FROM sizes")
def auto_tag_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = R.stream_lengths(pixels(spark, sf_dir), KEYS).withColumn("tag", R.auto_tag())
    return sizes.select("layer", "tag", F.when(F.col("tag") == 0, F.col("tag0")).when(F.col("tag") == 2, F.col("tag2")).otherwise(F.col("tag1")).alias("bytes"))


@layers.add(f"{_SIZES} SELECT layer, CASE WHEN tag3 < CASE WHEN binary_only THEN t0 ELSE least(tag1, t0 + more) END THEN 3 WHEN binary_only THEN 0 WHEN t0 + more < tag1 THEN 2 ELSE 1 END AS tag FROM sizes")
def probed_tag_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attached form where it is strictly shorter; ties keep the primary choice."""
    sizes = R.stream_lengths(pixels(spark, sf_dir), KEYS).withColumn("tag", R.auto_tag())
    least = F.when(F.col("tag") == 0, F.col("tag0")).when(F.col("tag") == 2, F.col("tag2")).otherwise(F.col("tag1"))
    return sizes.select("layer", F.when(F.col("tag3") < least, 3).otherwise(F.col("tag")).alias("tag"))


@layers.add(f"WITH {PIXELS} SELECT layer, pos, value::INT AS value FROM px")
def mask_decode_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = R.maximal_runs(pixels(spark, sf_dir), KEYS)
    return runs.select("layer", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), "value")


@layers.add(f"WITH {PIXELS} SELECT layer, bool_and(value = 0) AS all_black, bool_and(value IN (0, 255)) AS binary_only, count(*) AS n_pixels, count(*) FILTER (value <> 0) AS n_exposed FROM px GROUP BY layer")
def layer_binary_black_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return pixels(spark, sf_dir).groupBy("layer").agg(F.bool_and(v == 0).alias("all_black"), F.bool_and(~R.is_edge(v)).alias("binary_only"), F.count("*").alias("n_pixels"), F.count_if(v != 0).alias("n_exposed"))


@layers.add(f"{RUNS} SELECT layer, s AS start, e AS \"end\" FROM runs WHERE value <> 0")
def exposed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.maximal_runs(pixels(spark, sf_dir), KEYS).filter("value <> 0").select("layer", "start", "end")


@layers.add(f"{RUNS}, w AS (SELECT *, lag(value) OVER (PARTITION BY layer ORDER BY run_idx) AS b FROM runs) SELECT layer, count(*) AS n_runs, sum(len)::BIGINT AS n_pixels, count(*) FILTER (len < 1 OR b = value) AS n_bad FROM w GROUP BY layer")
def canonical_run_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = R.maximal_runs(pixels(spark, sf_dir), KEYS).withColumns({"len": F.col("end") - F.col("start"), "b": F.lag("value").over(R.over(KEYS, "run_idx"))})
    return runs.groupBy("layer").agg(F.count("*").alias("n_runs"), F.sum("len").alias("n_pixels"), F.count_if((F.col("len") < 1) | F.coalesce(F.col("b") == F.col("value"), F.lit(False))).alias("n_bad"))


_SPANS = f"""WITH {PIXELS}, raw AS (SELECT layer, sector, 3 * pos AS s, 3 * pos + 1 + value % 5 AS e FROM px WHERE value <> 0),
a AS (SELECT *, s > max(e) OVER (PARTITION BY layer, sector ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM raw),
b AS (SELECT *, sum(coalesce(n, false)::INT) OVER (PARTITION BY layer, sector ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM a),
sp AS (SELECT layer, sector, min(s) AS s, max(e) AS e FROM b GROUP BY layer, sector, i)"""


@layers.add(f"""{_SPANS} SELECT y.layer, y.sector::INT AS sector, y.s AS start, y.e AS "end", max(x.e) AS until FROM sp x JOIN sp y
ON x.layer = y.layer AND x.sector <> y.sector AND (x.s < y.s OR x.s = y.s AND x.sector < y.sector) AND x.e > y.s GROUP BY ALL""")
def sector_partition_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a layer's sectors that meet another sector's; the oracle is the interval self-join."""
    raw = pixels(spark, sf_dir).filter("value <> 0").select("layer", "sector", (F.col("pos") * 3).alias("start"), (F.col("pos") * 3 + 1 + F.col("value") % 5).alias("end"))
    return R.sector_overlaps(R.merged_spans(raw, ["layer", "sector"]), KEYS)


