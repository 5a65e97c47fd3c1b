"""Per-(layer, sector) print settings: sector over base, bottom and transition ranges, blends, overrides.  Column expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ints import blend


@dataclass(frozen=True)
class Field:
    """A resolved setting: its base key, its bottom key (None: the same key), whether it blends, its absent value."""

    name: str
    key: str
    bottom: str | None = None
    blends: bool = True
    absent: int = 0


def _motion(stem: str) -> list[Field]:
    return [Field(f"{stem}_{part}", f"{stem}_{part}", f"bottom_{stem}_{part}") for part in ("distance_um", "speed_um_min")]


# Fixed values of the format: the fourteen resolved fields.
FIELDS = (
    Field("layer_height_um", "layer_height_um", None, False),
    Field("exposure_ms", "normal_exposure_ms", "bottom_exposure_ms"),
    Field("light_pwm", "light_pwm", "bottom_light_pwm", False, 255),
    *_motion("lift_slow"),
    *_motion("lift_fast"),
    *_motion("retract_fast"),
    *_motion("retract_slow"),
    Field("wait_time_before_cure_ms", "wait_time_before_cure_ms", "bottom_wait_time_before_cure_ms"),
    Field("wait_time_after_cure_ms", "wait_time_after_cure_ms", "bottom_wait_time_after_cure_ms"),
    Field("wait_time_after_lift_ms", "wait_time_after_lift_ms", "bottom_wait_time_after_lift_ms"),
)
PASSED = ("chamber_temperature_c", "vat_temperature_c")
REQUIRED = ("normal_exposure_ms", "bottom_exposure_ms", "bottom_layer_count", "transition_layer_count", "layer_height_um", "lift_slow_distance_um", "lift_slow_speed_um_min", "retract_fast_distance_um", "retract_fast_speed_um_min")
KEYS = tuple(dict.fromkeys(k for f in FIELDS for k in (f.key, f.bottom) if k))
COUNTS = ("bottom_layer_count", "transition_layer_count")


def stage(layer: Column, bottom: Column, transition: Column) -> Column:
    return F.when(layer < bottom, "bottom").when(layer < bottom + transition, "transition").otherwise("normal")


def ranged(layer: Column, bottom: Column, transition: Column, at_bottom: Column, normal: Column) -> Column:
    """A blended value: bottom layers, then steps of 1 .. transition out of transition + 1, then the normal value."""
    steps = blend(at_bottom, normal, layer - bottom + 1, transition + 1)
    return F.when(layer < bottom, at_bottom).when(layer < bottom + transition, steps).otherwise(normal)


def switched(layer: Column, bottom: Column, at_bottom: Column, normal: Column) -> Column:
    """A categorical value: no blend."""
    return F.when(layer < bottom, at_bottom).otherwise(normal)


def merged(base: Column, sector: Column, key: str) -> Column:
    """The sector's value over the base's; base and sector are structs of settings, null where absent."""
    return F.coalesce(sector[key], base[key])


def resolve(points: DataFrame, base: str = "base", sector: str = "sector", override: str = "override", layer: str = "layer", sector_id: str = "sector_id") -> DataFrame:
    """points with a column for each of FIELDS and PASSED, is_bottom and is_transition.

    base, sector, override: columns of structs with the settings keys as longs (temperatures as doubles); sector and
    override may be null.  Sector 0 has no definition of its own.  An absent bottom value is the resolved normal one.
    An override replaces a field's resolved value, its normal key before its bottom key; its layer counts do nothing.
    """
    own = F.when(F.col(sector_id) != 0, F.col(sector))
    b, i = F.col(base), F.col(layer).cast("long")
    bottom, transition = (F.coalesce(merged(b, own, k), F.lit(0)).cast("long") for k in COUNTS)
    over = F.col(override)
    out: dict[str, Column] = {}
    for f in FIELDS:
        normal = F.coalesce(merged(b, own, f.key), F.lit(f.absent)).cast("long")
        if f.bottom is None:
            value, replaced = normal, over[f.key]
        else:
            at_bottom = F.coalesce(merged(b, own, f.bottom), normal).cast("long")
            value = ranged(i, bottom, transition, at_bottom, normal) if f.blends else switched(i, bottom, at_bottom, normal)
            replaced = F.coalesce(over[f.key], over[f.bottom])
        out[f.name] = F.coalesce(replaced, value).cast("long")
    for key in PASSED:
        out[key] = F.coalesce(over[key], merged(b, own, key))
    out["is_bottom"] = i < bottom
    out["is_transition"] = (i >= bottom) & (i < bottom + transition)
    return points.withColumns(out)


def is_duty(value: Column) -> Column:
    """A light's duty: a byte."""
    return value.between(0, 255)


def is_temperature(celsius: Column) -> Column:
    return celsius.between(0, 120)


def missing(base: Column) -> Column:
    """Names of the required settings that a base lacks."""
    return F.filter(F.array(*[F.when(base[k].isNull(), k) for k in REQUIRED]), lambda x: x.isNotNull())


def sample_points(sectors: DataFrame, overrides: DataFrame, total: Column) -> DataFrame:
    """(sector_id, layer): ends of a sector's ranges, first two and last layers, and each override with its neighbours.

    sectors: sector_id, bottom_layer_count, transition_layer_count.  overrides: sector_id, layer.
    """
    last = total - 1
    clamp = lambda c: F.greatest(F.least(c.cast("long"), last.cast("long")), F.lit(0))
    b, t = F.col("bottom_layer_count"), F.col("transition_layer_count")
    ends = sectors.select("sector_id", F.explode(F.array(*[clamp(c) for c in (F.lit(0), F.lit(1), b - 1, b, b + t, last)])).alias("layer"))
    near = overrides.select("sector_id", F.explode(F.array(F.col("layer") - 1, F.col("layer"), F.col("layer") + 1)).alias("layer")).filter((F.col("layer") >= 0) & (F.col("layer") <= last))
    return ends.union(near).distinct()


def cure_depth(energy: Column, dp: Column, ec: Column) -> Column:
    return dp * F.ln(energy / ec)


def cure_energy(depth: Column, dp: Column, ec: Column) -> Column:
    return ec * F.exp(depth / dp)
