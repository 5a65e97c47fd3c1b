"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

The words of a source, in a seeded order of its documents, are dealt to shards, whose number follows from its words.
Blocks are apportioned to sources by their targets, and the blocks of a source to its shards by their words, each time
by highest quotients v / (2 q + 1); what a source's target has beyond its blocks is a part of one more.  A shard takes
its quota as whole rounds of its words and one run of blocks, in the seeded order of documents, from a seeded start.

Only keys and sizes are shuffled.  A run of blocks is an interval of the hash that orders documents, and a part of the
documents at its two ends, so one row for each shard tells every document what is taken of it.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import fresh, materialise

#: Sources, of a few numbers each, that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float = 3) -> list[float]:
    """Shares of the total by weight; none is above cap times its size, and what is above goes to the others by weight."""
    rest, base, out = float(sum(sizes)), float(sum(w for s, w in zip(sizes, weights) if s > 0)), [0.0] * len(sizes)
    for i in sorted((i for i, s in enumerate(sizes) if s > 0), key=lambda i: sizes[i] / weights[i]):  # those that the cap binds come first
        out[i] = min(rest * weights[i] / base, float(cap * sizes[i]))
        rest, base = rest - out[i], base - weights[i]
    return out


def apportion(votes: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Sainte-Lague seats for votes, none above `most`; ties go to the first. Starts from the rounded shares, then moves seat by seat."""
    total = sum(votes)
    if not total:
        return [0] * len(votes)
    out = [min(m, int(v * seats / total + 0.5)) for v, m in zip(votes, most)]
    spare = seats - sum(out)
    if spare > 0:
        heap = [(-v / (2 * q + 1), i) for i, (v, q, m) in enumerate(zip(votes, out, most)) if q < m]
        heapq.heapify(heap)
        while spare and heap:
            _, i = heapq.heappop(heap)
            out[i] += 1
            spare -= 1
            if out[i] < most[i]:
                heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    elif spare < 0:
        heap = [(v / (2 * q - 1), -i) for i, (v, q) in enumerate(zip(votes, out)) if q]
        heapq.heapify(heap)
        while spare:
            _, i = heapq.heappop(heap)
            out[-i] -= 1
            spare += 1
            if out[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * out[-i] - 1), i))
    return out


def shards_for(words: int, total: int, shard_words: int = 1 << 20, most: int = 1 << 16) -> int:
    """Shards of a source with so many words of the total: of shard_words words each, or more, so that all sources together have `most` and one each."""
    return max(1, -(-words // max(shard_words, -(-total // most))))


def plan(totals: dict, weights: Sequence[float], cap: int, block: int) -> tuple[dict, dict]:
    """totals: words by (source, shard). Gives (source's size, target) by source, and words to take by (source, shard)."""
    shards: dict = {}
    for (s, h), n in totals.items():
        shards.setdefault(s, []).append((h, n))
    names = sorted(shards, key=lambda s: (s is None, "" if s is None else s))
    sizes = [sum(n for _, n in shards[s]) for s in names]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(names))], cap)
    words = [min(round(t), cap * n) for t, n in zip(goal, sizes)]
    quota = apportion(goal, sum(words) // block, [w // block for w in words])
    take = {}
    for s, blocks, rest in zip(names, quota, words):
        mine = sorted(shards[s])
        most = [cap * n // block for _, n in mine]
        got = [block * q for q in apportion([n for _, n in mine], min(blocks, sum(most)), most)]
        rest -= sum(got)
        for i, (h, n) in enumerate(mine):  # less than a block, but for what the caps leave over
            more = min(rest, cap * n - got[i])
            take[s, h] = got[i] + more
            rest -= more
    return {s: (n, t) for s, n, t in zip(names, sizes, goal)}, take


def mix_sources(df: DataFrame, source: str, size: str, key: str, weights: Sequence[float] = (1, 2, 3), cap: int = 3, block: int = 16, shard_words: int = 1 << 20, seed: int = 17, keys: DataFrame | None = None) -> DataFrame:
    """df with source_size, target, taken, copies, cut_start, cut_length (names get underscores in front where they clash).

    A row is taken `copies` times whole, and once more its words cut_start .. cut_start + cut_length; taken counts
    both.  size: the row's words (null: 0); a row of any size may be cut anywhere.  key: a hash of the row, which orders
    and shards it.  Rows with equal key and size get equal parts, to a word.  A null source is a source, after all
    others.  Weights repeat along the sources by code point.  No row is taken more than cap times.  A source's taken words
    are its target, rounded, but for half a word for each of equal rows at an end of a run.  A row without words is kept,
    with nothing taken.  No row is lost; an empty table stays empty.  The number of sources must fit the driver.
    keys: the columns source, size and key of df, if these are at hand in a table of their own.
    """
    spark = df.sparkSession
    added = fresh(df, "source_size", "target", "taken", "copies", "cut_start", "cut_length")
    source_size, target, taken, copies, cut_start, cut_length = added
    own = ("mix_source", "mix_shard", "mix_order", "mix_words", "mix_shards")
    name, shard, order, words, shards = fresh(df, *own)
    size_of, from_source = F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long"), F.col(f"`{source}`")
    keys = df.select(f"`{source}`", f"`{size}`", f"`{key}`") if keys is None else keys

    sums = keys.groupBy(from_source.alias(name)).agg(F.sum(size_of)).collect()  # a row for each source
    total = sum(n for _, n in sums)
    small = F.broadcast if len(sums) <= MOST_BROADCAST else lambda d: d
    counts = small(spark.createDataFrame([(s, shards_for(n, total, shard_words)) for s, n in sums], f"`{name}` string, `{shards}` int"))
    dealt = F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{key}`")), F.col(shards)).cast("int")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(counts, from_source.eqNullSafe(F.col(name))).withColumns({shard: dealt, order: F.xxhash64(F.col(f"`{key}`"), size_of, F.lit(seed)), words: size_of})

    units = materialise(placed(keys).filter(F.col(words) > 0).groupBy(F.col(name).alias("s"), F.col(shard).alias("h"), F.col(order).alias("o")).agg(F.sum(words).alias("n")), "units")
    got = units.groupBy("s", "h").agg(F.sum("n")).collect()  # at most 65536 rows and one for each source
    by_source, take = plan({**{(s, 0): 0 for s, n in sums if not n}, **{(r[0], r[1]): r[2] for r in got}}, weights, cap, block)
    rows = [(s, h, n, take[s, h] // n, take[s, h] % n) for s, h, n in got]
    quotas = spark.createDataFrame(rows, "s string, h int, total long, whole long, rest long")
    begin = F.pmod(F.xxhash64(F.lit(seed), "h", "s"), F.floor((F.col("total") - F.col("rest")) / block) + 1) * block
    upto = F.sum("n").over(Window.partitionBy("s", "h").orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
    u = units.withColumn("upto", upto).alias("u").join(quotas.withColumn("begin", begin).alias("q"), F.col("u.s").eqNullSafe(F.col("q.s")) & (F.col("u.h") == F.col("q.h")))
    u = u.select("u.s", "u.h", "o", "n", "whole", (F.col("upto") - F.col("n")).alias("low"), "upto", "begin", (F.col("begin") + F.col("rest")).alias("end"))
    part = F.struct("o", ((F.greatest("low", "begin") - F.col("low")) / F.col("n")).alias("skip"), ((F.least("upto", "end") - F.greatest("low", "begin")) / F.col("n")).alias("part"))
    runs = u.groupBy("s", "h").agg(F.max("whole").alias("whole"), F.min(F.when((F.col("upto") > F.col("begin")) & (F.col("low") < F.col("end")), part)).alias("first"), F.max(F.when((F.col("upto") > F.col("begin")) & (F.col("low") < F.col("end")), part)).alias("last"))
    runs = materialise(runs, "runs").alias("r")  # as many rows; so small a table is broadcast, and texts stay where they are

    d = placed(df).alias("d").join(runs, F.col(f"d.{name}").eqNullSafe(F.col("r.s")) & (F.col(f"d.{shard}") == F.col("r.h")), "left")
    here, some = F.col(f"d.{order}"), F.col(f"d.{words}")
    inside = (here >= F.col("r.first.o")) & (here <= F.col("r.last.o")) & (some > 0)
    at = F.when(here == F.col("r.first.o"), F.col("r.first")).when(here == F.col("r.last.o"), F.col("r.last"))
    skip = F.when(inside, F.coalesce(F.round(at["skip"] * some), F.lit(0)).cast("long")).otherwise(F.lit(0))
    length = F.when(inside, F.coalesce(F.round(at["part"] * some), some).cast("long")).otherwise(F.lit(0))
    sizes = small(spark.createDataFrame([(s, n, t) for s, (n, t) in by_source.items()], "s string, n long, t double")).alias("z")
    d = d.join(sizes, F.col(f"d.{name}").eqNullSafe(F.col("z.s")))
    rounds = F.when(some > 0, F.coalesce(F.col("r.whole"), F.lit(0))).otherwise(F.lit(0)).cast("long")
    return d.select(*[F.col(f"d.`{c}`") for c in df.columns], F.col("z.n").alias(source_size), F.col("z.t").alias(target), (rounds * some + F.least(length, some - skip)).alias(taken), rounds.alias(copies), skip.alias(cut_start), F.least(length, some - skip).alias(cut_length))
