"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import discard, materialise


def connected_components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """links (a, b: long) -> (node, label): the least node that a node is joined with. Nodes without a link are absent.

    Each round takes the least label among neighbours and then that label's own label, so chains halve; a round's
    result is a written table. Raises if most_rounds don't suffice.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("next")).union(links.select(F.col("b"), F.col("a")))
    edges = materialise(both.filter("node <> next").distinct(), "edges")
    labels = materialise(edges.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("label")), "labels")
    for _ in range(most_rounds):
        now = labels.select("node", "label")
        near = edges.join(now.select(F.col("node").alias("next"), "label"), "next").groupBy("node").agg(F.min("label").alias("near"))
        new = now.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = now.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = materialise(new.join(up, "label", "left").select("node", F.least("label", F.coalesce("top", "label")).alias("label"), "old"), "labels")
        discard(labels)
        if not new.filter("label <> old").head(1):
            discard(edges)
            return new.select("node", "label")
        labels = new
    raise RuntimeError("the components did not settle")
