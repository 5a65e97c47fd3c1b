"""Hash leaves and trees.  leaves: file keys, idx (from 0, without gaps), hash (binary)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ints import int_div


def leaf(data: Column) -> Column:
    """SHA-256 of a zero byte and the data."""
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("00")), data.cast("binary")), 256))


def node(left: Column, right: Column) -> Column:
    """SHA-256 of a one byte and both children; the left one alone is promoted."""
    return F.when(right.isNull(), left).otherwise(F.unhex(F.sha2(F.concat(F.unhex(F.lit("01")), left, right), 256)))


def levels_above(leaves: DataFrame, keys: Sequence[str]) -> int:
    most = leaves.agg(F.max("idx")).first()[0] or 0
    return int(most).bit_length()


def level_up(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The next level: pairs fold in one aggregate, half as many rows each time."""
    pairs = nodes.groupBy(*keys, int_div(F.col("idx"), 2).alias("up")).agg(F.max(F.when(F.col("idx") % 2 == 0, F.struct("hash"))).alias("l"), F.max(F.when(F.col("idx") % 2 == 1, F.struct("hash"))).alias("r"))
    return pairs.select(*keys, F.col("up").alias("idx"), node(F.col("l.hash"), F.col("r.hash")).alias("hash"))


def block_up(nodes: DataFrame, keys: Sequence[str], height: int = 6) -> DataFrame:
    """`height` levels at once: blocks of 2**height nodes fold as sorted arrays; no pair ever crosses such a block."""
    size = 1 << height
    blocks = nodes.groupBy(*keys, int_div(F.col("idx"), size).alias("up")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("a"))
    blocks = blocks.withColumn("a", F.transform("a", lambda x: x["hash"]))
    for _ in range(height):
        n = F.size("a")
        folded = F.transform(F.sequence(F.lit(0), int_div(n + 1, 2).cast("int") - 1), lambda i: node(F.get("a", i * 2), F.get("a", i * 2 + 1)))
        blocks = blocks.withColumn("a", folded)
    return blocks.select(*keys, F.col("up").alias("idx"), F.get("a", 0).alias("hash"))


def root(leaves: DataFrame, keys: Sequence[str], height: int = 6) -> DataFrame:
    """keys, hash: each file's root. A file without leaves has no row; its root is SHA-256 of a one byte."""
    nodes = leaves
    for _ in range(-(-levels_above(leaves, keys) // height)):
        nodes = block_up(nodes, keys, height)
    return nodes.select(*keys, "hash")


def paths(leaves: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """keys, idx, level, side, sibling for each wanted (keys, idx): what verifies the leaf against the root."""
    at = wanted.select(*keys, "idx", F.col("idx").alias("now"))
    out, nodes = None, leaves
    for level in range(levels_above(leaves, keys)):
        twin = F.col("now").bitwiseXOR(F.lit(1).cast("long"))
        step = at.withColumn("twin", twin).join(nodes.select(*keys, F.col("idx").alias("twin"), F.col("hash").alias("sibling")), [*keys, "twin"])
        step = step.select(*keys, "idx", F.lit(level).alias("level"), F.when(F.col("now") % 2 == 0, "right").otherwise("left").alias("side"), "sibling")
        out = step if out is None else out.union(step)
        at = at.withColumn("now", int_div(F.col("now"), 2))
        nodes = level_up(nodes, keys)
    return out if out is not None else wanted.select(*keys, "idx", F.lit(0).alias("level"), F.lit("left").alias("side"), F.lit(None).cast("binary").alias("sibling")).limit(0)


def root_of_path(leaf_hash: Column, steps: Column) -> Column:
    """Folds an array of (level, side, sibling), sorted by level, into the root."""
    return F.aggregate(steps, leaf_hash, lambda h, s: F.when(s["side"] == "right", node(h, s["sibling"])).otherwise(node(s["sibling"], h)))
