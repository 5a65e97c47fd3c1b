"""Exact Jaccard links between shingle sets, and their components.

Texts offer their distinct shingles (see _exchange) and learn how many texts hold each, which orders shingles from
rare to common.  If two sets are similar enough, they share a shingle within the first n - ceil(t n) + 1 of both.  A
set with no shingle there that another text has, links with nothing and drops out: passages that many texts share
bring no candidates, as rarer shingles come first.  The sets left, one for each distinct set, are joined in groups
that share such shingles, possibly through others.  A group that is too large for a task is split into blocks by size
class and hash, each joined within, and then the least set of each component so found meets those of other blocks; this
joins large groups of near copies.  Sets of such a group that are still apart meet for each shingle in the prefixes of
sets of different components, so chains of chance that hold unlike sets together cost no pairs of blocks.

Within a group, the index lists are ordered by set size, and blocks of a list outside of a set's possible sizes are
skipped by position.  The overlaps of a set with all others are derived from those of a highly similar set, computed
before: the lists of the few shingles that only one of the two has are added or subtracted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._components import connected_components
from ._exchange import OFFERS, Offer, answers, buckets_for, tiled, trimmed
from ._spark import materialise
from ._words import U64, Words, salted, shingles

#: Overlap vectors of sets that others may be derived from, at a time.
LEADERS = 16


def link_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set (ascending keys) the least index of a set that it is joined with by links, possibly through others."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([sets[i] for i in order]) if n else np.zeros(0, U64)
    _, element = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    index = np.sort(element * n + owner)  # lists by element, within them sets by size
    holders = index % n
    least = np.searchsorted(sizes, -(-sizes * percent // 100))  # the first set that is not too small
    label = np.arange(n)
    leaders: list[tuple[int, int, np.ndarray]] = []

    def overlaps(elements: np.ndarray, low: int, high: int) -> np.ndarray:
        a, b = np.searchsorted(index, elements * n + low), np.searchsorted(index, elements * n + high)
        length = b - a
        where = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        return np.bincount(holders[np.repeat(a, length) + where] - low, minlength=high - low)

    for x in range(n):
        mine = element[starts[x] : starts[x + 1]]
        low = int(least[x])
        near = None
        for p, at, counts in leaders:
            if at <= low and x < at + len(counts):
                apart = sizes[p] + sizes[x] - 2 * counts[x - at]
                if 2 * apart < sizes[x] and (near is None or apart < near[0]):
                    near = (apart, p, at, counts)
        if near is None:
            high = int(np.searchsorted(sizes, sizes[x] * 100 // percent, "right"))
            counts = overlaps(mine, low, max(high, x + 1))
            leaders = [*leaders[1 - LEADERS :], (x, low, counts)]
            counts = counts[: x - low]
        else:
            _, p, at, counts = near
            other = element[starts[p] : starts[p + 1]]
            counts = counts[low - at : x - at]
            if x > low:
                counts = counts + overlaps(np.setdiff1d(mine, other, True), low, x) - overlaps(np.setdiff1d(other, mine, True), low, x)
        if x > low:
            linked = np.flatnonzero(100 * counts >= percent * (sizes[x] + sizes[low:x] - counts)) + low
            for old in np.unique(label[linked]):
                if old != label[x]:
                    a, b = sorted((int(old), int(label[x])))
                    label[label == b] = a
    out = np.empty(n, np.int64)
    roots = np.full(n, n, np.int64)
    np.minimum.at(roots, label, order)
    out[order] = roots[label]
    return out


def set_digest(doc: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each text's shingle set."""
    out = []
    for salt in (1, 2):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(salted(keys, salt))])
        at = np.searchsorted(doc, np.arange(n + 1))
        out.append((sums[at[1:]] - sums[at[:-1]]).astype(np.int64))
    return out[0], out[1]


def shingle_sets(df: DataFrame, id: str, text: str, size: int, percent: int) -> DataFrame:
    """(id, row_key, s1, s2, n, prefix, items) per row; prefix and items only where the set may link with another text's."""
    d, total = tiled(df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("row_key")), "tile")
    buckets = buckets_for(total)
    schema = T.StructType([T.StructField("id", df.schema[id].dataType), T.StructField("row_key", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("n", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("items", T.BinaryType())])

    def keys_of(table: pa.Table):
        w = Words(table.column("text"), lower=True)
        doc, keys = shingles(w, w.hashes(), size)
        return len(w), doc, keys, Offer(keys, buckets, True)

    @trimmed
    def offer(table: pa.Table) -> pa.Table:
        return keys_of(table)[3].rows(table.column("tile")[0].as_py())

    @trimmed
    def choose(table: pa.Table, found: pa.Table) -> pa.Table:
        n, doc, keys, offered = keys_of(table)
        level = offered.read(found)[offered.inverse]
        at = np.searchsorted(doc, np.arange(n + 1))
        counts = np.diff(at)
        most = counts - (-(-counts * percent // 100)) + 1
        order = np.lexsort((keys, level, doc))
        rank = np.arange(len(doc)) - at[:-1][doc]
        first = (rank < most[doc]) & (level[order] > 1)
        pick = order[first]
        bounds = np.searchsorted(doc[pick], np.arange(n + 1))
        s1, s2 = set_digest(doc, keys, n)
        some = np.diff(bounds) > 0
        chosen = keys[pick].astype(np.int64)
        return pa.table(
            [
                table.column("id"),
                table.column("row_key"),
                pa.array(s1),
                pa.array(s2),
                pa.array(counts.astype(np.int64)),
                pa.array([chosen[a:b] if s else None for a, b, s in zip(bounds[:-1], bounds[1:], some)], pa.list_(pa.int64())),
                pa.array([keys[a:b].tobytes() if s else None for a, b, s in zip(at[:-1], at[1:], some)], pa.binary()),
            ],
            names=["id", "row_key", "s1", "s2", "n", "prefix", "items"],
        )

    got = answers(d.groupBy("tile").applyInArrow(offer, OFFERS), narrow=True)
    return d.groupBy("tile").cogroup(got.groupBy("tile")).applyInArrow(choose, schema)


def _links(tasks: DataFrame, percent: int) -> DataFrame:
    """tasks (cid, items, task) -> links (a, b) that join the linked sets of each task, at most one for each set."""

    @trimmed
    def link(table: pa.Table) -> pa.Table:
        cid, first = np.unique(table.column("cid").to_numpy(), return_index=True)  # a set may come by several shingles
        items = table.column("items")
        root = link_sets([np.frombuffer(items[int(i)].as_py(), np.uint64) for i in first], percent)
        some = root != np.arange(len(root))
        return pa.table({"a": pa.array(cid[root[some]]), "b": pa.array(cid[some])})

    return materialise(tasks.select("cid", "items", "task").groupBy("task").applyInArrow(link, "a long, b long"), "links")


def _labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    """sets with the label of their component so far."""
    return sets.join(connected_components(links), F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "cid")).drop("node")


def _within_groups(s: DataFrame, percent: int, most_items: int, links: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """s (cid, g, n, items, i) -> links, those given included, and the sets of too large groups with their blocks, if any.

    Groups of up to most_items shingles share tasks and are joined in full.  Blocks of larger ones are joined within,
    and then one set of each component of the group with others, in random rooms.
    """
    parts = materialise(s.groupBy("g", "i").agg(F.sum("n").alias("items_n")), "parts")
    whole = parts.groupBy("g").agg(F.sum("items_n").alias("group_n"))
    bins = max(1, -(-(whole.filter(F.col("group_n") <= most_items).agg(F.sum("group_n")).first()[0] or 0) // most_items))
    large = whole.filter(F.col("group_n") > most_items).select("g")
    little = _links(s.join(large, "g", "left_anti").withColumn("task", F.pmod(F.xxhash64("g"), F.lit(bins)).cast("string")), percent)
    links = little if links is None else links.union(little)
    if not large.head(1):
        return links, None
    split = parts.join(large, "g").select("g", "i", F.ceil(F.col("items_n") / most_items).cast("int").alias("p"))
    big = materialise(s.join(split, ["g", "i"]).withColumn("block", F.concat_ws("/", "g", "i", F.pmod(F.xxhash64("cid"), F.col("p")).cast("string"))), "blocks")
    links = links.union(_links(big.withColumn("task", F.col("block")), percent))
    leaders = _labelled(big, links).filter("cid = label")
    rooms = leaders.groupBy("g").agg(F.ceil(F.sum("n") / most_items).alias("rooms"))
    links = links.union(_links(leaders.join(rooms, "g").withColumn("task", F.concat_ws("/", "g", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("rooms")).cast("string"))), percent))
    return links, big


def linked_sets(sets: DataFrame, percent: int, most_items: int = 1 << 20) -> DataFrame:
    """sets (cid, n, prefix, items; one row per distinct set) -> (node, label) for those with links to other sets.

    Sets that share prefix shingles, possibly through others, form groups, joined by _within_groups.  What a too large
    group leaves apart is joined by _within_groups again, now for each prefix shingle that sets of different components
    have.  Only where the sets with one such shingle are themselves too many, pairs of their blocks meet: those of
    compatible sizes that aren't both wholly in the main component of these sets.
    """
    entries = sets.select("cid", F.explode("prefix").alias("key"))
    lead = entries.groupBy("key").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).filter("a <> z")
    near = connected_components(entries.join(lead, "key").filter("cid <> a").select("a", F.col("cid").alias("b")).distinct())
    step = -float(np.log(percent / 100)) * 1.000001  # so that rounding never puts two compatible sizes two classes apart
    s = sets.join(near, F.col("cid") == F.col("node")).select("cid", F.col("label").alias("g"), "n", "items", (F.floor(F.log("n") / F.lit(step)) if step else F.col("n")).cast("int").alias("i"))
    links, big = _within_groups(s, percent, most_items, None)
    if big is None:
        return connected_components(links)

    apart = materialise(_labelled(entries.join(big.select("cid"), "cid", "left_semi"), links), "apart")
    keys = apart.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("z")).filter("a <> z").select("key")
    shared = apart.join(keys, "key").select("cid", F.col("key").alias("g"))
    links, big = _within_groups(shared.join(big.drop("g", "block", "p"), "cid"), percent, most_items, links)
    if big is None:
        return connected_components(links)

    blocks = materialise(_labelled(big, links).groupBy("g", "i", "block").agg(F.min("label").alias("low"), F.max("label").alias("high")), "summary")
    main = blocks.filter("low = high").groupBy("g", "low").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("low", F.struct("c", "low")).alias("main"))
    rest = blocks.join(main, "g", "left").filter("main is null or low <> main or high <> main").select("g", F.col("i").alias("j"), F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = blocks.join(rest, "g").filter("abs(i - j) <= 1 and block <> other and not (low = high and low = low2 and low2 = high2)")
    pairs = pairs.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).distinct().withColumn("task", F.concat_ws("+", "x", "y"))
    tasks = pairs.select(F.col("x").alias("block"), "task").union(pairs.select("y", "task"))
    links = links.union(_links(big.join(tasks, "block"), percent))
    return connected_components(links)


def jaccard_components(df: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90) -> DataFrame:
    """Per row of df: id, row_key (hash of the row), n_shingles, component_id, keep.

    Two rows link if 100 * common >= percent * union of their sets of lower-cased `size`-word shingles.  component_id
    is the least id reached by links; keep marks the rows with the least (id, row_key) of a component (equal rows
    all, so that a caller may drop repeats).  A text with fewer words than a shingle is one shingle; a null, empty or
    blank text links with nothing and has its own id.  A text longer than a tile is a tile of its own, so it has to
    fit a worker (some 20 times its bytes).  Null ids never are a component's id unless all are null.  All
    links between different sets are found; equal sets are linked through their class.  An empty table stays empty.
    """
    rows = materialise(shingle_sets(df, id, text, size, percent), "sets")
    classes = rows.filter("prefix is not null").groupBy("s1", "s2").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("items").alias("items"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    labels = linked_sets(classes, percent)
    named = classes.select("s1", "s2", "cid").join(labels, F.col("cid") == F.col("node")).select("s1", "s2", "label")
    docs = rows.select("id", "row_key", "s1", "s2", "n")
    d = materialise(docs.join(named, ["s1", "s2"], "left").select("id", "row_key", "n", F.when(F.col("label").isNotNull(), F.struct(F.col("label").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(True).alias("z"))).otherwise(F.struct(F.col("s1").alias("x"), F.col("s2").alias("y"), F.lit(False).alias("z"))).alias("k")), "keyed")
    least = materialise(d.filter("n > 0").groupBy("k").agg(F.min("id").alias("least"), F.min(F.struct("id", "row_key")).alias("first")), "least")  # so that the join below can split a large component
    some = d.filter("n > 0").join(least, "k").select("id", "row_key", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), (F.struct("id", "row_key").eqNullSafe(F.col("first"))).alias("keep"))
    none = d.filter("n = 0").select("id", "row_key", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(True).alias("keep"))
    return some.union(none).withColumnRenamed("id", id)
