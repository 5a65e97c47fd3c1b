"""Run algebra over pixels: gaps and islands, overlays, deltas, significance-plane sizes.

pixels: layer keys, pos, value.  runs: layer keys, run_idx, start, end, value, with equal neighbours merged.  All
windows partition by the layer keys and share one exchange; everything else is computed from the aggregated runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ints import unzigzag, varint_length, zigzag


def over(keys: Sequence[str], *order: str):
    return Window.partitionBy(*keys).orderBy(*order)


def before(w, rows: int = -1):
    """All rows of the window up to the current one; up to the one before it with rows=-1."""
    return w.rowsBetween(Window.unboundedPreceding, rows)


def maximal_runs(pixels: DataFrame, keys: Sequence[str], pos: str = "pos", value: str = "value") -> DataFrame:
    """keys, run_idx, start, end, value. Pixels are taken in the order of pos, without gaps."""
    w = over(keys, "p")
    steps = pixels.select(*keys, F.col(pos).alias("p"), F.col(value).alias("v")).withColumn("new", F.coalesce((F.lag("v").over(w) != F.col("v")).cast("int"), F.lit(0)))
    islands = steps.withColumn("run_idx", F.sum("new").over(before(w, 0)))
    return islands.groupBy(*keys, "run_idx").agg(F.min("p").cast("long").alias("start"), (F.max("p") + 1).cast("long").alias("end"), F.max("v").alias("value"))


def threshold(value: Column) -> Column:
    return F.when(value >= 128, 255).otherwise(0)


def is_edge(value: Column) -> Column:
    """Anti-aliased: neither black nor white."""
    return ~value.isin(0, 255)


def overlay(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pos, value, delta of the anti-aliased pixels; the first delta is the position itself."""
    edge = pixels.filter(is_edge(F.col("value"))).select(*keys, "pos", "value")
    return edge.withColumn("delta", (F.col("pos") - F.coalesce(F.lag("pos").over(over(keys, "pos")), F.lit(0))).cast("long"))


def attachment(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pos, value, run_idx, kind of each anti-aliased pixel: first or last pixel of its core run, or an escape inside.

    The run of a pixel is found by the same window that finds the runs, so there is no range join.
    """
    w = over(keys, "pos")
    core = pixels.select(*keys, "pos", "value").withColumn("core", threshold(F.col("value")))
    core = core.withColumn("new", F.coalesce((F.lag("core").over(w) != F.col("core")).cast("int"), F.lit(0))).withColumn("run_idx", F.sum("new").over(before(w, 0)))
    whole = Window.partitionBy(*keys, "run_idx")
    core = core.withColumns({"low": F.min("pos").over(whole), "high": F.max("pos").over(whole)})
    kind = F.when(F.col("pos") == F.col("low"), "first").when(F.col("pos") == F.col("high"), "last").otherwise("escape")
    return core.filter(is_edge(F.col("value"))).select(*keys, "pos", "value", F.col("run_idx").cast("long").alias("run_idx"), kind.alias("kind"))


def stored_lengths(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, j, length, stored: run lengths but the last, as they are for j < 2, else zigzagged against two runs back."""
    w = over(keys, "run_idx")
    lengths = runs.withColumns({"length": F.col("end") - F.col("start"), "two": F.lag(F.col("end") - F.col("start"), 2).over(w), "is_last": F.lead("run_idx").over(w).isNull()})
    stored = F.when(F.col("run_idx") < 2, F.col("length")).otherwise(zigzag(F.col("length") - F.col("two")))
    return lengths.filter(~F.col("is_last")).select(*keys, F.col("run_idx").cast("long").alias("j"), F.col("length").cast("long").alias("length"), stored.cast("long").alias("stored"))


def restored_lengths(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Undoes stored_lengths: keys, j, length, by a running sum within each parity."""
    w = Window.partitionBy(*keys, F.col("j") % 2).orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("j") < 2, F.col("stored")).otherwise(unzigzag(F.col("stored")))
    return stored.select(*keys, "j", F.sum(step).over(w).cast("long").alias("length"))


def plane_counts(value: Column, present: Column, prefix: str) -> list[Column]:
    """Aggregates: values of an array that reach plane 0 .. 3."""
    return [F.count_if(present & (value >= ((1 << (7 * j)) if j else 0))).alias(f"{prefix}{j}") for j in range(4)]


def planes_length(prefix: str) -> Column:
    """Bytes of the array whose plane counts have that prefix: the four lengths and the planes."""
    out = F.lit(0).cast("long")
    for j in range(4):
        n = F.coalesce(F.col(f"{prefix}{j}"), F.lit(0))
        out = out + varint_length(n) + n
    return out


def stream_lengths(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, k_runs, k_core, n_edge, n_escape, binary_only, tag0 .. tag3: exact stream bytes of each form.

    tag0 is null where a pixel is anti-aliased.  One sort of the pixels of a layer serves all windows and the one
    aggregate: the pixel that begins a run knows where the runs before it began, and so the lengths of those that ended.
    """
    w, value, pos = over(keys, "pos"), F.col("value"), F.col("pos")
    earlier = lambda flag, what="pos": F.max(F.when(F.col(flag), F.col(what))).over(before(w))  # noqa: E731  places grow, so the last is the largest
    p = pixels.select(*keys, "pos", "value", threshold(value).alias("core"), is_edge(value).alias("edge"))
    p = p.withColumns({"opens": F.coalesce(F.lag("value").over(w) != value, F.lit(True)), "core_opens": F.coalesce(F.lag("core").over(w) != F.col("core"), F.lit(True)), "core_ends": F.coalesce(F.lead("core").over(w) != F.col("core"), F.lit(True))})
    p = p.withColumn("escape", F.col("edge") & ~F.col("core_opens") & ~F.col("core_ends"))
    p = p.withColumns({"run_at": earlier("opens"), "at1": earlier("core_opens"), "edge_at": earlier("edge"), "edge_value": F.last(F.when(F.col("edge"), value), True).over(before(w)), "escape_at": earlier("escape"), "ended": F.count_if(F.col("core_opens")).over(before(w)) - 1})
    p = p.withColumn("at2", earlier("core_opens", "at1"))
    p = p.withColumn("at3", earlier("core_opens", "at2"))
    run, core = F.col("opens") & F.col("run_at").isNotNull(), F.col("core_opens") & F.col("at1").isNotNull()
    length, odd = pos - F.col("at1"), F.col("ended") % 2 == 1
    stored = F.when(F.col("ended") < 2, length).otherwise(zigzag(length - (F.col("at2") - F.col("at3"))))
    step, hop = pos - F.coalesce("edge_at", F.lit(0)), pos - F.coalesce("escape_at", F.lit(0))
    drop = F.coalesce(zigzag(value - F.col("edge_value")), value)
    t = p.groupBy(*keys).agg(
        F.count_if("opens").alias("k_runs"),
        F.count_if("core_opens").alias("k_core"),
        F.count_if("edge").alias("n_edge"),
        F.count_if("escape").alias("n_escape"),
        F.bool_and(~F.col("edge")).alias("binary_only"),
        *plane_counts(pos - F.col("run_at"), run, "r"),
        *plane_counts(length, core, "c"),
        *plane_counts(stored, core & ~odd, "e"),
        *plane_counts(stored, core & odd, "o"),
        *plane_counts(step, F.col("edge"), "s"),
        *plane_counts(drop, F.col("edge"), "v"),
        *plane_counts(hop, F.col("escape"), "h"),
    )
    tag0 = 2 + varint_length(F.col("k_core")) + planes_length("c")
    tag3 = 2 + varint_length(F.col("k_core")) + planes_length("e") + planes_length("o") + varint_length(F.col("n_edge")) + F.call_function("div", F.col("k_core") + 3, F.lit(4)) + varint_length(F.col("n_escape")) + planes_length("h") + planes_length("v")
    return t.select(
        *keys,
        "k_runs",
        "k_core",
        "n_edge",
        "n_escape",
        "binary_only",
        F.when(F.col("binary_only"), tag0).alias("tag0"),
        (1 + varint_length(F.col("k_runs")) + F.col("k_runs") + planes_length("r")).alias("tag1"),
        (tag0 + varint_length(F.col("n_edge")) + planes_length("s") + F.col("n_edge")).alias("tag2"),
        tag3.alias("tag3"),
    )


def auto_tag() -> Column:
    """0 for binary layers; else split only where it is strictly shorter than grayscale."""
    return F.when(F.col("binary_only"), 0).when(F.col("tag2") < F.col("tag1"), 2).otherwise(1)


def merged_spans(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, end: the union of possibly overlapping or touching half-open spans, as disjoint ones."""
    w = over(keys, "start", "end")
    new = (F.col("start") > F.max("end").over(before(w))).cast("int")
    islands = spans.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("island", F.sum("new").over(before(w, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def sector_overlaps(spans: DataFrame, keys: Sequence[str], sector: str = "sector") -> DataFrame:
    """keys, sector, start, end, until of spans that begin before `until`, the furthest end of an earlier span.

    Spans of one sector are disjoint, so an earlier span that reaches past a start is another sector's.  A sweep over
    one sort for each layer replaces the interval join, and gives a row for each span in conflict, not for each pair.
    """
    w = over(keys, "start", sector)
    return spans.withColumn("until", F.max("end").over(before(w))).filter("until > start")
