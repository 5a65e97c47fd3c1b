"""What differs between two tables: an expected one and a found one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, field, expected, found (as text): fields that differ, and `missing` or `extra` rows. Null equals null."""
    fields = [c for c in expected.columns if c not in keys]
    e, f = expected.withColumn("__e", F.lit(True)).alias("e"), found.withColumn("__f", F.lit(True)).alias("f")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}"))
    row = lambda name, a, b: F.struct(F.lit(name).alias("field"), a.cast("string").alias("expected"), b.cast("string").alias("found"))
    none = F.lit(None).cast("string")
    both = F.array(*[F.when(~F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}")), row(c, F.col(f"e.{c}"), F.col(f"f.{c}"))) for c in fields])
    rows = F.when(F.col("__f").isNull(), F.array(row("missing", none, none))).when(F.col("__e").isNull(), F.array(row("extra", none, none))).otherwise(F.filter(both, lambda x: x.isNotNull()))
    joined = e.join(f, on, "full")
    return joined.select(*[F.coalesce(f"e.{k}", f"f.{k}").alias(k) for k in keys], F.explode(rows).alias("d")).select(*keys, "d.field", "d.expected", "d.found")
