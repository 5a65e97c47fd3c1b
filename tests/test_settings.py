import json

from pyspark.sql import functions as F

from lamina.functions.ints import blend, unzigzag, varint_length, zigzag
from lamina.operators import jobs as J
from lamina.operators import settings as S

KEYS = (*S.KEYS, *S.COUNTS)


def struct(values):
    return F.struct(*[F.lit(values.get(k)).cast("long").alias(k) for k in KEYS], *[F.lit(values.get(k)).cast("double").alias(k) for k in S.PASSED])


def resolved(spark, base, layers, sector=None, override=None, sector_id=0):
    none = F.when(F.lit(False), struct({}))
    d = spark.createDataFrame([(i, sector_id) for i in layers], "layer int, sector_id int")
    d = d.withColumns({"base": struct(base), "sector": none if sector is None else struct(sector), "override": none if override is None else struct(override)})
    return {r["layer"]: r for r in S.resolve(d).collect()}


BASE = {"bottom_layer_count": 4, "transition_layer_count": 8, "normal_exposure_ms": 2500, "bottom_exposure_ms": 30000, "wait_time_after_cure_ms": 1000, "layer_height_um": 50}


def test_golden_blend(spark):
    got = resolved(spark, BASE, [3, 4, 11, 12])
    assert [got[i]["exposure_ms"] for i in (3, 4, 11, 12)] == [30000, 26944, 5556, 2500]
    assert [got[i]["is_bottom"] for i in (3, 4, 11, 12)] == [True, False, False, False]
    assert [got[i]["is_transition"] for i in (3, 4, 11, 12)] == [False, True, True, False]


def test_wait_blend(spark):
    got = resolved(spark, {**BASE, "bottom_wait_time_after_cure_ms": 10000}, [4])
    assert got[4]["wait_time_after_cure_ms"] == 9000


def test_example_print(spark):
    base = {"bottom_layer_count": 2, "transition_layer_count": 3, "normal_exposure_ms": 2500, "bottom_exposure_ms": 30000}
    got = resolved(spark, base, range(6))
    assert [got[i]["exposure_ms"] for i in range(6)] == [30000, 30000, 23125, 16250, 9375, 2500]


def test_absent_values_sectors_and_overrides(spark):
    got = resolved(spark, {**BASE, "lift_slow_distance_um": 5000}, [0])[0]
    assert got["lift_slow_distance_um"] == 5000 and got["light_pwm"] == 255 and got["lift_fast_speed_um_min"] == 0 and got["vat_temperature_c"] is None
    sector = {"normal_exposure_ms": 9, "bottom_layer_count": 0, "transition_layer_count": 0, "vat_temperature_c": 30}
    assert resolved(spark, BASE, [0], sector, sector_id=2)[0]["exposure_ms"] == 9
    assert resolved(spark, BASE, [0], sector, sector_id=0)[0]["exposure_ms"] == 30000
    over = {"bottom_exposure_ms": 7, "bottom_layer_count": 99, "light_pwm": 3, "bottom_light_pwm": 4}
    got = resolved(spark, BASE, [0, 20], None, over)
    assert (got[20]["exposure_ms"], got[20]["light_pwm"], got[20]["is_bottom"]) == (7, 3, False)
    assert resolved(spark, BASE, [0], None, {**over, "normal_exposure_ms": 8})[0]["exposure_ms"] == 8


def test_extreme_blend_is_exact(spark):
    top = 4294967295
    got = spark.range(1).select(blend(F.lit(top).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(top).cast("long")).alias("x")).first()["x"]
    assert got == (2 * top * (top - 1) + top) // (2 * top)


def test_zigzag_and_varints(spark):
    values = [0, 1, -1, 2, -2, 127, -128, 2**40, -(2**40)]
    d = spark.createDataFrame([(v,) for v in values], "d long")
    got = d.select("d", zigzag(F.col("d")).alias("u")).select("d", "u", unzigzag(F.col("u")).alias("back")).collect()
    assert all(r["u"] == (2 * r["d"] if r["d"] >= 0 else -2 * r["d"] - 1) and r["back"] == r["d"] for r in got)
    sizes = spark.createDataFrame([(0,), (127,), (128,), (16383,), (16384,), (2**28 - 1,), (2**62,)], "x long").select(varint_length(F.col("x")).alias("n"))
    assert [r["n"] for r in sizes.collect()] == [1, 1, 2, 2, 3, 4, 9]


def test_missing_required(spark):
    got = spark.range(1).select(S.missing(struct(BASE)).alias("m")).first()["m"]
    assert got == ["lift_slow_distance_um", "lift_slow_speed_um_min", "retract_fast_distance_um", "retract_fast_speed_um_min"]


def test_jobs(spark):
    job = {"own": {"liftDistanceMm": 2.0005, "bottomLiftDistanceMm": 0, "projectorPwmPercent": "50", "bottomWaitTimeBeforeCureSec": 0}, "export": {"other": {"timing": {"normalExposureSec": 2.5}}}, "material": {"liftDistanceMm": 9, "waitTimeAfterCureSec": "x", "lightOffDelaySec": 1.5, "zstdLevel": 40}}
    d = spark.createDataFrame([(json.dumps(job),), ("not json",)], "job string").select(J.parsed(F.col("job")).alias("job")).select(J.nodes(F.col("job"), J.containers("own", "other")).alias("nodes"))
    found = d.select(*[c.alias(n) for n, c in J.settings_of_job(F.col("nodes")).items()]).collect()
    a, b = found
    assert (a["lift_slow_distance_um"], a["normal_exposure_ms"], a["retract_fast_distance_um"], a["bottom_lift_slow_distance_um"]) == (2001, 2500, 2001, 0)
    assert (a["light_pwm"], a["bottom_wait_time_before_cure_ms"], a["wait_time_after_cure_ms"], a["zstd_level"]) == (127, None, 1500, 22)
    assert (b["lift_slow_distance_um"], b["light_pwm"], b["zstd_level"], b["layers_per_chunk"], b["bottom_lift_slow_distance_um"]) == (0, None, 6, 64, None)
    whole = spark.createDataFrame([(-1.0,), (0.4,), (0.5,), (1e12,), (None,)], "x double").select(J.whole(F.col("x")).alias("y"))
    assert [r["y"] for r in whole.collect()] == [0, 0, 1, 4294967295, None]
