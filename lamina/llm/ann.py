"""Nearest neighbours by cosine with multi-index hashing.

Vectors of unit length are centred, rotated by learned rotations (principal axes, then iterative quantisation, each
from its own start) and cut to sign bits.  A code has `substrings` substrings, each a few bits longer than the log of
the number of rows, and each the key of an index of its own.  By the pigeonhole principle, two codes within radius
r = substrings * a + b agree in one of the first b + 1 substrings up to a bits, or in one of the others up to a - 1;
so probing every value that near retrieves every code within the radius.  All rows that are probed are ranked by their
cosine.  The radius is the least that finds `share` percent of the exact neighbours within a sample.

The indexes are keyed in a shuffle: a row goes to one cell for each substring, named by the substring and the upper
bits of its value, and a query only to the cells that hold values it probes.  Cells with many rows are split by a hash
of the row.  A cell ranks in single precision and keeps, with the error bound, all that may be among the nearest; those
few are ranked again by the cosine of the original vectors in double precision.  Equal vectors (and multiples by powers of
two) are one class, indexed once with its least ids.  Queries that meet too few rows search again within a larger radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import materialise

SUBSTRINGS = 8


@dataclass
class Hasher:
    mean: np.ndarray
    axes: np.ndarray  # dimensions by code bits
    bits: int  # of a substring
    radius: int = 0

    @property
    def substrings(self) -> int:
        return self.axes.shape[1] // self.bits

    def reach(self) -> np.ndarray:
        """Bits in which a probed value may differ, by substring; below 0 where a substring needs no probe."""
        return (self.radius - np.arange(self.substrings)) // self.substrings

    def values(self, x: np.ndarray) -> np.ndarray:
        """Substrings of the codes of rows of unit length: rows by substrings."""
        flags = ((x - self.mean) @ self.axes > 0).reshape(len(x), self.substrings, self.bits)
        return flags @ (np.int64(1) << np.arange(self.bits, dtype=np.int64))

    def probed(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Which rows of values() one query's values probe."""
        return (np.bitwise_count(rows ^ query) <= self.reach()).any(axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def substring_bits(rows: int) -> int:
    """Five bits more than it takes to number the rows, so that few rows share a value."""
    return min(31, max(8, math.ceil(math.log2(max(rows, 1))) + 5))


def learn(x: np.ndarray, k: int, bits: int, substrings: int = SUBSTRINGS, rounds: int = 10, share: float = 94.0, seed: int = 11) -> Hasher:
    """From a sample of rows; bits: of a substring."""
    x = unit(x)
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
    v = (x - mean) @ axes.T
    parts = []
    while sum(p.shape[1] for p in parts) < bits * substrings:
        r, _ = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (left @ right).T
        parts.append(axes.T @ r)
    mixed = rng.permutation(bits * substrings)  # bits of one rotation go to all substrings
    out = Hasher(mean, np.concatenate(parts, axis=1)[:, : bits * substrings][:, mixed], bits, bits * substrings)
    some = rng.permutation(len(x))[:512]
    near = np.argsort(-(x[some] @ x.T), axis=1, kind="stable")[:, 1 : k + 1]
    if near.size:
        codes = out.values(x)
        apart = np.bitwise_count(codes[some][:, None, :] ^ codes[near]).astype(np.int64)
        out.radius = int(np.ceil(np.percentile((apart * substrings + np.arange(substrings)).min(axis=2), share)))
    return out


def masks(bits: int, most: int) -> np.ndarray:
    """All numbers of so many bits with at most `most` ones."""
    return np.array([sum(1 << b for b in c) for n in range(min(bits, most) + 1) for c in combinations(range(bits), n)], np.int64)


def _bytes(x: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x))])


def prepared(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, size, v: doubles) of rows with an id and a vector that is not empty and not zero, with finite components.

    Each vector is multiplied by a power of two that brings its largest component near 1: this is exact, and then no
    square overflows or vanishes.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids, lists = batch.column(0), batch.column(1).fill_null([])
            size = pc.list_value_length(lists).to_numpy().astype(np.int64)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            first = np.cumsum(size) - size
            some = np.flatnonzero(size > 0)
            if len(some):
                most = np.maximum.reduceat(np.abs(x), first[some])
                some, most = some[np.isfinite(most) & (most > 0)], most[np.isfinite(most) & (most > 0)]
                some, most = some[ids.is_valid().to_numpy(False)[some]], most[ids.is_valid().to_numpy(False)[some]]
            n = size[some]
            at = np.repeat(first[some], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            v = np.ldexp(x[at], -np.repeat(np.frexp(most)[1], n)) + 0.0 if len(some) else x[:0]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(n.astype(np.int32)), _bytes(v, 8 * np.concatenate([[0], np.cumsum(n)])).cast(pa.binary())], names=["id", "size", "v"])

    return df.select(F.col(f"`{id}`").cast("long"), F.col(f"`{vector}`").cast("array<double>")).mapInArrow(run, "id long, size int, v binary")


def _matrix(column: pa.Array | pa.ChunkedArray, kind=np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _cosines(df: DataFrame) -> DataFrame:
    """df (query, ids, x, v) -> (query, score, ids)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                x, v = _matrix(batch.column("x"), np.float64), _matrix(batch.column("v"), np.float64)
                score = (x * v).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))
                yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(score), batch.column("ids")], names=["query", "score", "ids"])

    return df.select("query", "ids", "x", "v").mapInArrow(run, "query long, score double, ids array<long>")


CELLS = "j int, cell long, value long, cid long, x binary"


def _coded(df: DataFrame, hasher, bits: int, cell_bits: int, probing: bool) -> DataFrame:
    """df (cid, v) -> a row for each substring (and each cell it may probe, if probing)."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hasher.value
        near = [masks(cell_bits, a) if probing else np.zeros(1, np.int64) for a in h.reach()]
        for batch in stream:
            if batch.num_rows:
                cid, x = batch.column(0).to_numpy(), unit(_matrix(batch.column(1), np.float64))
                values, x = h.values(x), x.astype(np.float32)
                for j, a in enumerate(h.reach()):
                    if a >= 0:
                        cells = (values[:, j] >> (bits - cell_bits))[:, None] ^ near[j]
                        n = cells.shape[1]
                        raw = pa.array([r.tobytes() for r in x], pa.binary())
                        at = pa.array(np.repeat(np.arange(len(cid)), n))
                        columns = [pa.array(np.full(len(cid) * n, j, np.int32)), pa.array(cells.ravel()), pa.array(np.repeat(values[:, j], n)), pa.array(np.repeat(cid, n)), raw.take(at)]
                        yield pa.RecordBatch.from_arrays(columns, names=["j", "cell", "value", "cid", "x"])

    return df.select("cid", "v").mapInArrow(run, CELLS)


def _met(entries: DataFrame, probes: DataFrame, hasher, k: int, slack: float) -> DataFrame:
    """(query, cid, near) of all that may be among the k nearest that a query meets in a cell."""

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        queries, found, scores = [], [], []
        if rows.num_rows and asked.num_rows:
            reach = int(hasher.value.reach()[rows.column("j")[0].as_py()])
            order = np.argsort(rows.column("value").to_numpy(), kind="stable")
            cid, x = rows.column("cid").to_numpy()[order], _matrix(rows.column("x"))[order]
            values, starts = np.unique(rows.column("value").to_numpy()[order], return_index=True)
            sizes = np.diff(np.append(starts, len(order)))
            mine, q, ids = asked.column("value").to_numpy(), _matrix(asked.column("x")), asked.column("cid").to_numpy()
            for i in range(len(q)):
                hit = np.bitwise_count(values ^ mine[i]) <= reach
                at = np.flatnonzero(np.repeat(hit, sizes))
                if len(at):
                    score = x[at] @ q[i]
                    if len(at) > k:
                        keep = score >= np.partition(score, len(score) - k)[len(score) - k] - slack
                        at, score = at[keep], score[keep]
                    queries.append(np.full(len(at), ids[i]))
                    found.append(cid[at])
                    scores.append(score)
        flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
        return pa.table({"query": flat(queries, pa.int64()), "cid": flat(found, pa.int64()), "near": flat(scores, pa.float32())})

    key = ["j", "cell", "part"]
    return entries.groupBy(*key).cogroup(probes.groupBy(*key)).applyInArrow(search, "query long, cid long, near float")


def nearest(df: DataFrame, query: Column, id: str = "vec_id", vector: str = "embedding", k: int = 5, sample: int = 20000, cell_rows: int = 8192, substrings: int = SUBSTRINGS) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found for each query row, nearest first, ties to the smaller id.

    query: which rows ask, a condition on the column "id" (the row's id).  Rows with a null id or a vector that is
    null, empty, zero or not finite take no part, nor do vectors of another length than the commonest (of equally
    common ones the shortest).  Components may be as large or small as a double can be.  Equal rows count once; rows
    that share an id are never each other's candidates, and with different vectors they are queries of their own.
    A query gets k rows, or all candidates if they are fewer.  An empty table gives an empty result; other columns
    are not read, whatever their names.  sample: at most so many vectors (those with the least hash) are learned from;
    all are indexed.
    """
    spark = df.sparkSession
    v = prepared(df, id, vector)
    lengths = sorted((-r["n"], r["size"]) for r in v.groupBy("size").agg(F.count("*").alias("n")).collect())
    if not lengths:
        return spark.createDataFrame([], f"query_id long, rank int, `{id}` long, score double")
    v = v.filter(F.col("size") == lengths[0][1]).select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))

    # a class has the k + 1 least ids of its rows: those after them are never among the k nearest
    first = v.dropDuplicates(["id", "h", "g"]).withColumn("n", F.row_number().over(Window.partitionBy("h", "g").orderBy("id"))).filter(F.col("n") <= k + 1)
    asked = v.filter(query).select("id", "h", "g").distinct()
    asking = asked.select("h", "g").distinct().withColumn("asks", F.lit(True))
    classes = first.groupBy("h", "g").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")).join(asking, ["h", "g"], "left")
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    rows = classes.orderBy("h", "g").limit(sample).select("v").toArrow()  # h is a hash; at most `sample` vectors
    bits = substring_bits(total)
    learned = learn(_matrix(rows.column("v"), np.float64), k, bits, substrings)
    cell_bits = min(bits, max(0, math.ceil(math.log2(max(1, total / cell_rows)))))
    slack = 2 * (lengths[0][1] + 8) * 2.0**-23  # twice what a cosine in single precision may be off

    wanted, results = classes.filter("asks").select("cid", "v"), []
    while True:
        hasher = spark.sparkContext.broadcast(learned)  # a number for each dimension and bit
        entries, probes = _coded(classes, hasher, bits, cell_bits, False), _coded(wanted, hasher, bits, cell_bits, True)
        key, parts = ["j", "cell"], F.lit(1)
        if total > 4 * cell_rows:  # or no cell can have so many rows
            hot = entries.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 4 * cell_rows)
            hot = materialise(hot.select(*key, F.ceil(F.col("n") / (2 * cell_rows)).cast("int").alias("parts")), "cells")
            entries, probes, parts = entries.join(hot, key, "left"), probes.join(hot, key, "left"), F.coalesce("parts", F.lit(1))
        entries = entries.withColumn("part", F.pmod(F.xxhash64("cid"), parts).cast("int")).drop("parts")
        probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        met = _met(entries, probes, hasher, k + 1, slack).groupBy("query", "cid").agg(F.max("near").alias("near"))
        least = F.nth_value("near", k + 1).over(Window.partitionBy("query").orderBy(F.desc("near")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        met = met.withColumn("least", least).filter(F.col("near") >= F.coalesce("least", F.lit(-2.0)) - slack).select("query", "cid")
        other = classes.select("cid", "ids", F.col("v").alias("x"))
        mine = classes.filter("asks").select(F.col("cid").alias("query"), "v")
        near = _cosines(met.join(other, "cid").join(mine, "query"))
        near = materialise(near.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near")), "near")
        enough = F.aggregate("near", F.lit(0), lambda n, c: n + F.size(c["ids"])) > k
        everything = learned.radius >= bits * substrings
        results.append(near if everything else near.filter(enough))
        if everything or not (few := near.filter(~enough).select(F.col("query").alias("cid"))).head(1):
            break
        wanted = classes.select("cid", "v").join(few, "cid", "left_semi")
        learned = Hasher(learned.mean, learned.axes, bits, min(bits * substrings, learned.radius + 2 * substrings))

    found = results[0]
    for more in results[1:]:
        found = found.union(more)
    asked = asked.join(classes.filter("asks").select("h", "g", F.col("cid").alias("query")), ["h", "g"]).join(found, "query")
    each = F.flatten(F.transform("near", lambda c: F.transform(F.filter(c["ids"], lambda i: i != F.col("id")), lambda i: F.struct((-c["score"]).alias("less"), i.alias("id")))))
    asked = asked.select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.array_sort(each), 1, k)).alias("rank", "one"))
    return asked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("one.id").alias(id), (-F.col("one.less")).alias("score"))
