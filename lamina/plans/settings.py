"""Queries over print settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators import rules as RU
from ..operators import settings as S
from .base import Catalogue, table

settings = Catalogue()

#: A base and two sectors, in both languages: bottom, transition, exposures.
BASE = {"bottom_layer_count": 4, "transition_layer_count": 8, "normal_exposure_ms": 2500, "bottom_exposure_ms": 30000, "light_pwm": 200, "bottom_light_pwm": 255, "lift_slow_distance_um": 5000, "layer_height_um": 50}
SECTORS = {1: {"bottom_layer_count": 6, "normal_exposure_ms": 2800}, 2: {"transition_layer_count": 2, "bottom_exposure_ms": 9000, "bottom_lift_slow_distance_um": 8000}}
_SECTOR_KEYS = sorted({k for s in SECTORS.values() for k in s})
_SECTOR_SQL = "sec AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(str(s.get(k, 'NULL')) for k in _SECTOR_KEYS)})" for i, s in SECTORS.items()) + f") AS s(sector_id, {', '.join(_SECTOR_KEYS)}))"


def base_struct(**more: int):
    keys = {**{k: None for k in (*S.KEYS, *S.COUNTS)}, **BASE, **more}
    return F.struct(*[F.lit(v).cast("long").alias(k) for k, v in keys.items()], *[F.lit(None).cast("double").alias(k) for k in S.PASSED])


def sectors(spark: SparkSession) -> DataFrame:
    full = [(i, *[s.get(k) for k in (*S.KEYS, *S.COUNTS)]) for i, s in SECTORS.items()]
    d = spark.createDataFrame(full, "sector_id int, " + ", ".join(f"{k} long" for k in (*S.KEYS, *S.COUNTS)))
    return d.select(F.col("sector_id").alias("sid"), F.struct(*S.KEYS, *S.COUNTS, *[F.lit(None).cast("double").alias(k) for k in S.PASSED]).alias("sector"))


_MERGE = """SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(floor(c_acctbal) AS BIGINT) END, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 100 END, r_regionkey * 10, 255)::BIGINT AS light,
  r_name AS zone FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""


@settings.add(_MERGE)
def settings_base_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three levels that has a value; the two small tables are broadcast by their size."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    d = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    own = F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal"))
    nation = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") * 100)
    return d.select("c_custkey", F.coalesce(own, nation, F.col("r_regionkey") * 10, F.lit(255)).cast("long").alias("light"), F.col("r_name").alias("zone"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each event: layer and sector, with the base and the sector's definition."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 17).alias("layer"), F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", 2).otherwise(0).alias("sector_id"))
    return e.join(F.broadcast(sectors(spark)), F.col("sector_id") == F.col("sid"), "left").drop("sid").withColumn("base", base_struct())  # two literal rows


_POINTS = f"""WITH {_SECTOR_SQL}, ev AS (SELECT event_id, event_id % 17 AS layer, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS sector_id FROM events),
pt AS (SELECT event_id, layer, ev.sector_id, coalesce(sec.bottom_layer_count, 4) AS b, coalesce(sec.transition_layer_count, 8) AS t,
  coalesce(sec.normal_exposure_ms, 2500) AS n, coalesce(sec.bottom_exposure_ms, 30000) AS x, coalesce(sec.bottom_lift_slow_distance_um, 5000) AS bl FROM ev LEFT JOIN sec USING (sector_id))"""


def _blend_sql(b: str, n: str) -> str:
    return f"CASE WHEN layer < b THEN {b} WHEN layer < b + t THEN (2 * ({b} * (t + 1 - (layer - b + 1)) + {n} * (layer - b + 1)) + t + 1) // (2 * (t + 1)) ELSE {n} END"


@settings.add(f"{_POINTS} SELECT event_id, layer, sector_id::INT AS sector_id, CASE WHEN layer < b THEN 'bottom' WHEN layer < b + t THEN 'transition' ELSE 'normal' END AS stage FROM pt")
def settings_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda k: F.coalesce(F.col("sector")[k], F.col("base")[k])
    return points(spark, sf_dir).select("event_id", "layer", "sector_id", S.stage(F.col("layer"), *map(count, S.COUNTS)).alias("stage"))


@settings.add(f"{_POINTS} SELECT event_id, ({_blend_sql('x', 'n')})::BIGINT AS exposure_ms, ({_blend_sql('bl', '5000')})::BIGINT AS lift_slow_distance_um, (CASE WHEN layer < b THEN 255 ELSE 200 END)::BIGINT AS light_pwm, layer < b AS is_bottom, layer >= b AND layer < b + t AS is_transition, 50::BIGINT AS layer_height_um, 0::BIGINT AS lift_fast_speed_um_min FROM pt")
def settings_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumn("override", F.when(F.lit(False), F.col("base")))
    return S.resolve(p).select("event_id", "exposure_ms", "lift_slow_distance_um", "light_pwm", "is_bottom", "is_transition", "layer_height_um", "lift_fast_speed_um_min")


@settings.add("""SELECT o_orderkey, (CASE WHEN l < 4 THEN b WHEN l < 12 THEN (2 * (b * (9 - (l - 3)) + n * (l - 3)) + 9) // 18 ELSE n END)::BIGINT AS value
FROM (SELECT o_orderkey, o_orderkey % 40 AS l, CAST(floor(o_totalprice) AS BIGINT) AS b, 2500 + o_custkey % 7 AS n FROM orders)""")
def settings_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    value = S.ranged((F.col("o_orderkey") % 40).cast("long"), F.lit(4), F.lit(8), F.floor("o_totalprice").cast("long"), (2500 + F.col("o_custkey") % 7).cast("long"))
    return o.select("o_orderkey", value.alias("value"))


@settings.add("""SELECT o_orderkey, coalesce(CASE WHEN quality = 1 THEN 100 + doc_id END, CASE WHEN toxic = 0 THEN 900 + doc_id END, 2500)::BIGINT AS exposure_ms, doc_id IS NOT NULL AS overridden
FROM orders LEFT JOIN labels ON o_orderkey = doc_id""")
def settings_override_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides by layer: the normal key, else the bottom key, else the resolved value."""
    o, x = table(spark, sf_dir, "orders"), table(spark, sf_dir, "labels")
    values = {"normal_exposure_ms": F.when(F.col("quality") == 1, 100 + F.col("doc_id")), "bottom_exposure_ms": F.when(F.col("toxic") == 0, 900 + F.col("doc_id"))}
    override = F.struct(*[values.get(k, F.lit(None)).cast("long").alias(k) for k in (*S.KEYS, *S.COUNTS)], *[F.lit(None).cast("double").alias(k) for k in S.PASSED])
    points = o.join(x, F.col("o_orderkey") == F.col("doc_id"), "left").select("o_orderkey", F.lit(20).alias("layer"), F.lit(0).alias("sector_id"), F.col("doc_id").isNotNull().alias("overridden"), F.when(F.col("doc_id").isNotNull(), override).alias("override"))
    points = points.withColumns({"base": base_struct(), "sector": F.when(F.lit(False), base_struct())})
    return S.resolve(points).select("o_orderkey", "exposure_ms", "overridden")


@settings.add("""WITH s AS (SELECT r_regionkey AS sector_id, r_regionkey * 3 AS b, r_regionkey + 2 AS t FROM region),
o AS (SELECT DISTINCT user_id % 5 AS sector_id, event_id % 40 AS layer FROM events WHERE event_id % 97 = 0),
e AS (SELECT sector_id, unnest([0, 1, b - 1, b, b + t, 29]) AS l FROM s)
SELECT sector_id::INT AS sector_id, greatest(least(l, 29), 0)::BIGINT AS layer FROM e UNION
SELECT sector_id::INT, l::BIGINT FROM (SELECT sector_id, unnest([layer - 1, layer, layer + 1]) AS l FROM o) WHERE l BETWEEN 0 AND 29""")
def settings_sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, e = table(spark, sf_dir, "region"), table(spark, sf_dir, "events")
    sectors_ = r.select(F.col("r_regionkey").cast("int").alias("sector_id"), (F.col("r_regionkey") * 3).alias("bottom_layer_count"), (F.col("r_regionkey") + 2).alias("transition_layer_count"))
    overrides = e.filter("event_id % 97 = 0").select((F.col("user_id") % 5).cast("int").alias("sector_id"), (F.col("event_id") % 40).alias("layer")).distinct()
    return S.sample_points(sectors_, overrides, F.lit(30))


@settings.add("""SELECT p_partkey, p_size * 8 - 40 AS light_pwm, round(p_retailprice / 10 - 60, 2) AS chamber,
 CASE WHEN round(p_retailprice / 10 - 60, 2) NOT BETWEEN 0 AND 120 THEN 'meta.temperature_range' WHEN p_size * 8 - 40 NOT BETWEEN 0 AND 255 THEN 'pwm.range' END AS failed FROM part""")
def pwm_temperature_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the two rules that a file with these values breaks."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 8 - 40).alias("light_pwm"), F.round(F.col("p_retailprice") / 10 - 60, 2).alias("chamber"))
    broken = RU.report(p, ["p_partkey"], {"pwm.range": ~S.is_duty(F.col("light_pwm")), "meta.temperature_range": ~S.is_temperature(F.col("chamber"))})
    return p.join(RU.first_failure(broken, ["p_partkey"]).withColumnRenamed("check", "failed"), "p_partkey", "left")


@settings.add("""SELECT event_id, raw, regexp_matches(raw, '^(0|[1-9][0-9]*)$') AND CAST(raw AS DOUBLE) <= 4294967295 AS is_u32
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN k WHEN 1 THEN k || '.0' WHEN 2 THEN '42949672' || k ELSE '-1' || k END AS raw FROM (SELECT event_id, regexp_extract(props, '"k": *([0-9]+)', 1) AS k FROM events))""")
def integer_json_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a duration is written as a whole number of 32 bits; tested on the JSON text, as 2500.0 is not."""
    e = table(spark, sf_dir, "events")
    k, m = F.get_json_object("props", "$.k"), F.col("event_id") % 4
    raw = F.when(m == 0, k).when(m == 1, F.concat(k, F.lit(".0"))).when(m == 2, F.concat(F.lit("42949672"), k)).otherwise(F.concat(F.lit("-1"), k))
    d = e.select("event_id", F.concat(F.lit('{"ms":'), raw, F.lit("}")).alias("json")).select("event_id", F.get_json_object("json", "$.ms").alias("raw"))
    return d.withColumn("is_u32", J.is_u32(F.col("raw")))


_PLACES = J.containers("own", "other")


@settings.add("""SELECT event_id, (CASE WHEN event_id % 10 = 9 THEN 0 ELSE k * 25 END)::BIGINT AS lift_slow_distance_um,
 (CASE WHEN event_id % 10 = 9 THEN 0 WHEN k % 2 = 0 THEN k * 25 ELSE k * 1000 END)::BIGINT AS retract_fast_distance_um,
 CASE WHEN event_id % 10 <> 9 AND k > 0 THEN least(floor(k * 2.55::DOUBLE + 0.5), 255)::BIGINT END AS light_pwm,
 CASE WHEN event_id % 10 = 9 OR k % 3 = 0 THEN NULL ELSE (k * 100)::BIGINT END AS bottom_wait_time_after_cure_ms
FROM (SELECT event_id, regexp_extract(props, '"k": *([0-9]+)', 1)::INT AS k FROM events)""")
def job_value_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a job whose values stand in any of nine containers, or in none."""
    k, m = F.get_json_object("props", "$.k"), (F.col("event_id") % 10).cast("int")
    n = k.cast("int")
    inner = F.concat(F.lit('{"liftDistanceMm":"'), (n * 25 / 1000).cast("string"), F.lit('","retractDistanceMm":'), F.when(n % 2 == 0, "0").otherwise(k), F.lit(',"projectorPwmPercent":'), k, F.lit(',"bottomWaitTimeAfterCureSec":0,"bottomLightOffDelaySec":'), F.when(n % 3 == 0, "0").otherwise((n / 10).cast("string")), F.lit("}"))
    place = F.element_at(F.array(*map(F.lit, [*_PLACES, "elsewhere"])), m + 1)
    parts = F.split(place, r"\.")
    nested = F.aggregate(F.reverse(parts), inner, lambda acc, p: F.concat(F.lit('{"'), p, F.lit('":'), acc, F.lit("}")))
    found = J.settings_of_job(F.col("nodes"))
    names = ("lift_slow_distance_um", "retract_fast_distance_um", "light_pwm", "bottom_wait_time_after_cure_ms")
    jobs = table(spark, sf_dir, "events").select("event_id", J.parsed(nested).alias("job")).select("event_id", J.nodes(F.col("job"), _PLACES).alias("nodes"))
    return jobs.select("event_id", *[found[x].alias(x) for x in names])


@settings.add("SELECT p_partkey, (CASE WHEN p_size > 0 THEN CAST(floor(p_retailprice) AS BIGINT) * 1000 // p_size END)::BIGINT AS pixel_um FROM part")
def pixel_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", J.pixel_pitch(F.floor("p_retailprice").cast("long") * 1000, F.col("p_size").cast("long")).cast("long").alias("pixel_um"))


@settings.add("SELECT s_suppkey, round(160 * ln((abs(s_acctbal) + 20) / 10), 6) AS depth, round(10 * exp((s_suppkey % 300) / 160.0), 6) AS energy FROM supplier")
def cure_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    dp, ec = F.lit(160.0), F.lit(10.0)
    return s.select("s_suppkey", F.round(S.cure_depth(F.abs("s_acctbal") + 20, dp, ec), 6).alias("depth"), F.round(S.cure_energy(F.col("s_suppkey") % 300, dp, ec), 6).alias("energy"))


@settings.add("""SELECT p_partkey, CASE WHEN w <= 400 AND h <= 300 THEN w WHEN 400 * h // w <= 300 THEN 400 ELSE greatest(300 * w // h, 1) END::BIGINT AS fit_w,
 CASE WHEN w <= 400 AND h <= 300 THEN h WHEN 400 * h // w <= 300 THEN greatest(400 * h // w, 1) ELSE 300 END::BIGINT AS fit_h FROM (SELECT p_partkey, p_size * 23 AS w, 50 + p_partkey % 900 AS h FROM part)""")
def preview_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.previews import fit

    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 23).cast("long").alias("w"), (50 + F.col("p_partkey") % 900).cast("long").alias("h"))
    w, h = fit(F.col("w"), F.col("h"))
    return p.select("p_partkey", w.alias("fit_w"), h.alias("fit_h"))
