"""Slicer jobs (JSON) to settings: lookups through containers, unit conversion, absent and zero values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.ints import int_div

MAX_U32 = 4294967295


def containers(own: str, other: str, last: str = "material") -> list[str]:
    """The places where a job may hold a setting, first wins; own and other name the formats' nodes."""
    return [p for name in (own, other) for p in (name, f"{name}.timing", f"export.{name}", f"export.{name}.timing")] + [last]


def parsed(job: Column) -> Column:
    """The job as a variant, null where it is no JSON.  Make it a column of its own, so that it is parsed once."""
    return F.try_parse_json(job)


def nodes(job: Column, places: Sequence[str]) -> Column:
    """What a parsed job has at the places, in their order.  Make it a column of its own: few places exist in a job, and settings look only there."""
    return F.filter(F.array(*[F.try_variant_get(job, f"$.{p}", "variant") for p in places]), lambda x: x.isNotNull())


def number(nodes: Column, *keys: str) -> Column:
    """The first finite number, or string spelling one, under the first of keys in the first of nodes; null if none."""

    def first(key: str) -> Column:
        found = F.transform(nodes, lambda x: F.trim(F.try_variant_get(x, f"$.{key}", "string")).try_cast("double"))
        return F.get(F.filter(found, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), 0)

    return F.coalesce(*[first(key) for key in keys])


def is_u32(text: Column) -> Column:
    """Whether JSON text is a whole number of 32 bits, without a sign, a fraction or an exponent."""
    return text.rlike("^(0|[1-9][0-9]*)$") & (text.try_cast("double") <= MAX_U32)


def whole(value: Column) -> Column:
    """Rounded half up to an unsigned 32-bit integer; 0 for what is negative."""
    return F.when(value <= 0, 0).when(value.isNotNull(), F.least(F.floor(value + 0.5), F.lit(MAX_U32))).cast("long")


def micrometers(mm: Column) -> Column:
    return whole(mm * 1000)


def milliseconds(seconds: Column) -> Column:
    return whole(seconds * 1000)


def pwm(percent: Column) -> Column:
    return F.when(percent <= 0, 0).when(percent.isNotNull(), F.least(F.floor(percent * 2.55 + 0.5), F.lit(255))).cast("long")


def pixel_pitch(build_um: Column, pixels: Column) -> Column:
    """Null unless both are positive."""
    return F.when((pixels > 0) & (build_um > 0), int_div(build_um, pixels))


def unless_zero(value: Column) -> Column:
    """Zero says nothing: absent."""
    return F.when(value > 0, value)


# Fixed values of the format: settings by the job's keys. (converter, keys)
MOTION = {
    "lift_slow_distance_um": "liftDistanceMm",
    "lift_slow_speed_um_min": "liftSpeedMmMin",
    "lift_fast_distance_um": "liftDistance2Mm",
    "lift_fast_speed_um_min": "liftSpeed2MmMin",
    "retract_fast_speed_um_min": "retractSpeedMmMin",
    "retract_slow_distance_um": "retractDistance2Mm",
    "retract_slow_speed_um_min": "retractSpeed2MmMin",
}
BOTTOM_MOTION = {
    "bottom_lift_slow_distance_um": "bottomLiftDistanceMm",
    "bottom_lift_slow_speed_um_min": "bottomLiftSpeedMmMin",
    "bottom_lift_fast_distance_um": "bottomLiftDistance2Mm",
    "bottom_lift_fast_speed_um_min": "bottomLiftSpeed2MmMin",
    "bottom_retract_fast_distance_um": "bottomRetractDistanceMm",
    "bottom_retract_fast_speed_um_min": "bottomRetractSpeedMmMin",
    "bottom_retract_slow_distance_um": "bottomRetractHeight2Mm",
    "bottom_retract_slow_speed_um_min": "bottomRetractSpeed2MmMin",
}
WAITS = {
    "wait_time_before_cure_ms": ("waitTimeBeforeCureSec",),
    "wait_time_after_cure_ms": ("waitTimeAfterCureSec", "lightOffDelaySec"),
    "wait_time_after_lift_ms": ("waitTimeAfterLiftSec",),
}
BOTTOM_WAITS = {
    "bottom_wait_time_before_cure_ms": ("bottomWaitTimeBeforeCureSec",),
    "bottom_wait_time_after_cure_ms": ("bottomWaitTimeAfterCureSec", "bottomLightOffDelaySec"),
    "bottom_wait_time_after_lift_ms": ("bottomWaitTimeAfterLiftSec",),
}


def settings_of_job(nodes: Column) -> dict[str, Column]:
    """Columns of settings for the nodes of a job; null is absent."""
    get = lambda *keys: number(nodes, *keys)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = {
        "normal_exposure_ms": milliseconds(zero(get("normalExposureSec"))),
        "bottom_exposure_ms": milliseconds(zero(get("bottomExposureSec"))),
        "bottom_layer_count": F.greatest(F.floor(zero(get("bottomLayerCount"))), F.lit(0)).cast("long"),
        "transition_layer_count": F.greatest(F.floor(zero(get("transitionLayerCount"))), F.lit(0)).cast("long"),
    }
    out |= {name: micrometers(zero(get(key))) for name, key in MOTION.items()}
    retract, lift = get("retractDistanceMm"), zero(get("liftDistanceMm"))
    out["retract_fast_distance_um"] = micrometers(F.coalesce(F.when(retract > 0, retract), lift))
    out |= {name: micrometers(get(key)) for name, key in BOTTOM_MOTION.items()}
    out |= {name: milliseconds(zero(get(*keys))) for name, keys in WAITS.items()}
    out |= {name: F.coalesce(*[unless_zero(milliseconds(get(k))) for k in keys]) for name, keys in BOTTOM_WAITS.items()}
    out |= {"light_pwm": unless_zero(pwm(get("projectorPwmPercent"))), "bottom_light_pwm": unless_zero(pwm(get("bottomProjectorPwmPercent")))}
    out |= {"chamber_temperature_c": get("chamberTemperatureC"), "vat_temperature_c": get("vatTemperatureC")}
    level = get("zstdLevel")
    out |= {"layers_per_chunk": F.coalesce(unless_zero(whole(get("layersPerChunk"))), F.lit(64)), "zstd_level": F.when(level.isNotNull(), F.greatest(F.least(F.floor(level + 0.5), F.lit(22)), F.lit(1))).otherwise(6).cast("int")}
    return out


def required_scene(job: Column, flag: str, payload: str) -> Column:
    """The embedded scene's bytes where the flag is true (null where the payload is missing: an error), else null."""
    return F.when(F.try_variant_get(job, f"$.{flag}", "string") == "true", F.try_to_binary(F.try_variant_get(job, f"$.{payload}", "string"), F.lit("base64")))
