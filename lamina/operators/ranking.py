"""Positions and running totals in an order without bringing all rows, or all rows of a key, to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with the 0-based place of each row in the order, which should be total.

    Rows are range-partitioned and sorted, written once, and numbered within their partition; the sizes of the
    partitions (a row for each) give the offsets.
    """
    part, mark = "__part", "__mark"
    d = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({part: F.spark_partition_id(), mark: F.monotonically_increasing_id()}), "ranked")
    sizes = d.groupBy(part).agg(F.count("*").alias("n")).collect()
    offsets, at = [], 0
    for p, n in sorted((r[part], r["n"]) for r in sizes):
        offsets.append((p, at))
        at += n
    table = df.sparkSession.createDataFrame(offsets, f"{part} int, __at long")
    w = Window.partitionBy(part).orderBy(mark)
    return d.join(F.broadcast(table), part).withColumn(name, F.row_number().over(w) - 1 + F.col("__at")).drop(part, mark, "__at")  # a row for each partition


def with_running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, how: str = "sum") -> DataFrame:
    """df with the sum (0 at first) or the max (null at first) of value over the rows before, by keys in an order that should be total.

    A key may hold any share of the rows: rows are range-partitioned by keys and order and written once, and a window
    covers one key of one partition.  What comes before a partition is added to its first key alone, as every other
    key begins within; so those rows, at most one for each partition, are broadcast.
    """
    part, mark, own, ahead = "__part", "__mark", "__own", "__ahead"
    total = {"sum": F.sum, "max": F.max}[how]
    by = [F.col(c) for c in (*keys, *order)]
    d = materialise(df.withColumn(own, value).repartitionByRange(*by).sortWithinPartitions(*by).withColumns({part: F.spark_partition_id(), mark: F.monotonically_increasing_id()}), "running")
    sums = d.groupBy(part, *keys).agg(total(own).alias(ahead))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn(ahead, total(ahead).over(earlier)).filter(F.col(ahead).isNotNull())
    within = total(own).over(Window.partitionBy(part, *keys).orderBy(mark).rowsBetween(Window.unboundedPreceding, -1))
    joined = d.withColumn(name, within).alias("a").join(F.broadcast(carried).alias("b"), (F.col(f"a.{part}") == F.col(f"b.{part}")) & _same("a", "b", keys), "left")
    found = F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(ahead), F.lit(0)) if how == "sum" else F.greatest(F.col(name), F.col(ahead))
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], found.alias(name))


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out
