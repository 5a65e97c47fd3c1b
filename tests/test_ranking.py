"""Running totals over keys that span partitions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lamina.operators.ranking import with_position, with_running


def rows(n=600):
    rng = random.Random(4)
    keys = ["hot"] * (n * 2 // 3) + [f"k{i % 9}" for i in range(n // 4)] + [None] * (n - n * 2 // 3 - n // 4)
    return [(k, i, rng.choice([None, rng.randrange(-50, 50)])) for i, k in enumerate(keys)]


@pytest.mark.parametrize("how", ["sum", "max"])
@pytest.mark.parametrize("parts", [1, 7])
def test_running(spark, how, parts):
    data = rows()
    want = {}
    for _, group in itertools.groupby(sorted(data, key=lambda r: (r[0] or "", r[1])), key=lambda r: r[0]):
        seen = []
        for _, i, v in group:
            want[i] = sum(seen) if how == "sum" else max(seen, default=None)
            seen += [v] if v is not None else []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = spark.createDataFrame(data, "k string, i long, v long")
        found = with_running(d, ["k"], ["i"], F.col("v"), "before", how).collect()
        assert {r["i"]: r["before"] for r in found} == want and len(found) == len(data)
        assert len({r["position"] for r in with_position(d, [F.col("i")]).collect()}) == len(data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty(spark):
    d = spark.createDataFrame([], "k string, i long, v long")
    assert with_running(d, ["k"], ["i"], F.col("v"), "before").collect() == []
