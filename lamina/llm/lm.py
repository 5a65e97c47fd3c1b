"""Language-model scores from a log-frequency Bloom filter.

Training texts give counts of words and of word pairs (with a start and an end mark), added up by the exchange of
_exchange.  A count c is kept as its level 1 + floor(log2 c): a key is put into a Bloom filter once for each level up
to its own, and read back by membership probes at level 1, 2, ... until one fails.  Each bucket of keys is a segment
of the filter, of its own size.  Workers get the filter by broadcast and score whole texts without any shuffle:

    p(w | v) = (min(c(v w), c(v)) + k p(w)) / (c(v) + k),   p(w) = (c(w) + 1) / (N + V + 1)

The base score uses exact counts, which the buckets answer to the tiles.  A filter of more than `broadcast_bytes` is not
broadcast: tiles then offer all their words and pairs, each bucket builds its segment and probes it for them, and the
levels go back to the tiles, which gives the same scores by one more exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._exchange import ANSWERS, OFFERS, Offer, answered, buckets_for, gathered, tiled, trimmed
from ._spark import materialise
from ._words import ROLL_A, U64, Words, batches, mix, salted

PROBES = 4
START, END = U64(0x5354415254), U64(0x454E44)
WORD, PAIR = 0, 1
ENTRY_BITS = 8
_BITS = np.array([1, 2, 4, 8, 16, 32, 64, 128], np.uint8)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c) for c > 0, else 0."""
    return np.frexp(counts.astype(np.float64))[1] * (counts > 0)


def expected(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that have a level."""
    return np.where(level > 0, 1.5 * np.exp2(level - 1.0) - 0.5, 0.0)


def _places(first: np.ndarray, step: np.ndarray, level: int, probe: int, size) -> np.ndarray:
    """Double hashing; the upper half of the hash is scaled to the size, which is below 2 ** 32."""
    return (((first + U64(PROBES * level + probe) * step) >> U64(32)) * size) >> U64(32)


def _seeds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return salted(keys, 1), salted(keys, 2) | U64(1)


def build_segment(keys: np.ndarray, counts: np.ndarray, entry_bits: int = ENTRY_BITS) -> bytes:
    level = levels(counts)
    size = max(64, -(-int(level.sum()) * entry_bits // 64) * 64)
    bits = np.zeros(size, bool)
    first, step = _seeds(keys)
    for j in range(1, int(level.max(initial=0)) + 1):
        some = level >= j
        for i in range(PROBES):
            bits[_places(first[some], step[some], j, i, U64(size))] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Segments by bucket; buckets that are absent hold nothing."""

    def __init__(self, segments: dict[int, bytes], buckets: int):
        self.buckets = buckets
        sizes = np.array([len(segments.get(b, b"")) for b in range(buckets)], np.int64)
        self.at, self.bits = np.cumsum(sizes) - sizes, (sizes * 8).astype(np.uint64)
        self.data = np.frombuffer(b"".join(segments[b] for b in sorted(segments)), np.uint8)

    def level(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Fast where keys come by bucket, as then a segment's probes are near each other."""
        out = np.zeros(len(keys), np.int64)
        live = np.flatnonzero(self.bits[bucket] > 0)
        first, step = _seeds(keys[live])
        size, base = self.bits[bucket[live]], self.at[bucket[live]]
        j = 1
        while len(live):
            for i in range(PROBES):
                place = _places(first, step, j, i, size).astype(np.int64)
                hit = np.flatnonzero(self.data[base + (place >> 3)] & _BITS[place & 7])
                live, first, step, size, base = live[hit], first[hit], step[hit], size[hit], base[hit]
            out[live] += 1
            j += 1
        return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> U64(32)) * U64(buckets)) >> U64(32)).astype(np.int64)


def narrow(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The form that Offer(narrow=True) gives to keys."""
    return (bucket_of(keys, buckets).astype(np.uint64) << U64(32)) | (keys & U64(0xFFFFFFFF))


class Tokens:
    """Per token (each word, and an end for each text): its text, its hash, and the hash of the pair that it ends."""

    def __init__(self, column):
        w = Words(column, lower=True)
        n = len(w)
        counts = w.counts
        self.counts = counts + 1
        self.doc = np.repeat(np.arange(n), self.counts)
        last = np.cumsum(self.counts) - 1
        self.token = np.empty(int(self.counts.sum()), U64)
        word = np.ones(len(self.token), bool)
        word[last] = False
        self.token[word] = w.hashes()
        self.token[last] = END
        self.before = np.empty_like(self.token)
        self.before[1:] = self.token[:-1]
        if n:
            self.before[last - counts] = START
        self.pair = mix(self.before * ROLL_A + self.token)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=len(self.counts))


def score_texts(df: DataFrame, train: Column, id: str = "doc_id", text: str = "text", strength: float = 64.0, broadcast_bytes: int = 256 << 20) -> DataFrame:
    """Per row of df: id, trained, n_tokens, n_known, train_tokens, base_score, score (log10 of the whole text).

    train: which rows the counts come from (null: not).  A null text counts as empty: its end mark alone.  Repeated
    rows count, and are scored, each on its own.  Counts are exact up to 2 ** 53.  A text longer than a tile is a tile of
    its own, so it has to fit a worker (some 20 times its bytes).  Other columns are dropped, whatever their names.  With no training row, N and V are 0 and every token has base
    probability 1.  An empty table stays empty.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.xxhash64(F.col(f"`{id}`"), F.col(f"`{text}`"), train).alias("row_key"))
    d, total = tiled(docs, "tile", 4 << 20)
    buckets = buckets_for(total)

    @trimmed
    def offers(table: pa.Table) -> pa.Table:
        tile, t = table.column("tile")[0].as_py(), Tokens(table.column("text"))
        learn = table.column("train").to_numpy()[t.doc]
        words = Offer(t.token, buckets, False, learn).rows(tile, np.uint32)
        pairs = Offer(t.pair[learn], buckets, True).rows(tile, np.uint32)
        kinds = [WORD] * words.num_rows + [PAIR] * pairs.num_rows
        return pa.concat_tables([words, pairs]).append_column("kind", pa.array(kinds, pa.int32()))

    @trimmed
    def answer(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py() == PAIR:
            return pa.table({"tile": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "answer": pa.array([], pa.binary())})
        return answered(table, False, np.uint32, wide=True)

    @trimmed
    def segment(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys, totals, _, _ = gathered(table, kind == PAIR, np.uint32)
        if kind == PAIR:
            keys = (U64(bucket) << U64(32)) | keys.astype(np.uint64)
        some = totals > 0
        return pa.table({"kind": pa.array([kind], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "distinct": pa.array([int(some.sum())]), "tokens": pa.array([int(totals.sum())]), "segment": pa.array([build_segment(keys[some], totals[some])], pa.binary())})

    @trimmed
    def base(table: pa.Table, found: pa.Table) -> pa.Table:
        t = Tokens(table.column("text"))
        counts = Offer(t.token, buckets, False)
        c = counts.read(found, np.uint32)[counts.inverse].astype(np.float64)
        return pa.table([table.column("id"), table.column("row_key"), pa.array(t.counts.astype(np.int64)), pa.array(t.sums(c > 0).astype(np.int64)), pa.array(t.sums(np.log10(c + 1)))], names=["id", "row_key", "n_tokens", "n_known", "logs"])

    sent = d.groupBy("tile").applyInArrow(offers, OFFERS + ", kind int")
    got = sent.groupBy("kind", "bucket").applyInArrow(answer, ANSWERS)
    based = d.groupBy("tile").cogroup(got.groupBy("tile")).applyInArrow(base, T.StructType([T.StructField("id", df.schema[id].dataType), *T._parse_datatype_string("row_key long, n_tokens long, n_known long, logs double").fields]))
    parts = sent.groupBy("kind", "bucket").applyInArrow(segment, "kind int, bucket int, distinct long, tokens long, segment binary")
    both = materialise(based.unionByName(parts, allowMissingColumns=True), "counts")

    sizes = {r[0]: r[1:] for r in both.filter("kind is not null").groupBy("kind").agg(F.sum("distinct"), F.sum("tokens"), F.sum(F.octet_length("segment"))).collect()}
    v, n, word_size = sizes.get(WORD, (0, 0, 0))
    pair_size = sizes.get(PAIR, (0, 0, 0))[2]
    whole, kind = float(n + v + 1), df.schema[id].dataType
    if word_size + pair_size <= broadcast_bytes:

        def read(kind: int) -> Filter:
            return Filter({r[0]: bytes(r[1]) for r in both.filter(F.col("kind") == kind).select("bucket", "segment").toLocalIterator()}, buckets)

        shared = spark.sparkContext.broadcast((read(WORD), read(PAIR)))
        scored = _score_by_broadcast(docs, shared, buckets, whole, strength, kind)
    else:
        scored = _score_by_exchange(d, buckets, whole, strength, kind)
    once = both.filter("kind is null").groupBy("id", "row_key").agg(F.first("n_tokens").alias("n_tokens"), F.first("n_known").alias("n_known"), F.first("logs").alias("logs"))
    a, b = scored.alias("a"), once.alias("b")
    return a.join(b, F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.row_key") == F.col("b.row_key"))).select(
        F.col("a.id").alias(id),
        F.col("a.train").alias("trained"),
        "n_tokens",
        "n_known",
        F.lit(n or 0).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10((n or 0) + (v or 0) + 1)))).alias("base_score"),
        "score",
    )


def _token_logs(t: Tokens, single: np.ndarray, pair: np.ndarray, starts: float, whole: float, strength: float) -> np.ndarray:
    """log10 of each token's probability from the counts of words and of pairs."""
    history = np.empty_like(single)
    history[1:] = single[:-1]
    history[t.before == START] = starts
    return np.log10((np.minimum(pair, history) + strength * (single + 1) / whole) / (history + strength))


def _scored(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("id", kind), T.StructField("train", T.BooleanType()), T.StructField("row_key", T.LongType()), T.StructField("score", T.DoubleType())])


def _score_by_broadcast(docs: DataFrame, shared: Broadcast, buckets: int, whole: float, strength: float, kind: T.DataType) -> DataFrame:
    def score(stream):
        words, pairs = shared.value
        end = np.array([END])
        starts = float(expected(words.level(end, bucket_of(end, buckets)))[0])
        for batch in batches(stream, "text", 2 << 20):
            at = batch.schema.get_field_index
            t = Tokens(batch.column(at("text")))
            distinct, back = np.unique(t.token, return_inverse=True)
            single = expected(words.level(distinct, bucket_of(distinct, buckets)))[back]
            distinct, back = np.unique(narrow(t.pair, buckets), return_inverse=True)  # ascending, so by bucket
            pair = expected(pairs.level(distinct, (distinct >> U64(32)).astype(np.int64)))[back]
            logs = _token_logs(t, single, pair, starts, whole, strength)
            yield pa.RecordBatch.from_arrays([batch.column(at("id")), batch.column(at("train")), batch.column(at("row_key")), pa.array(t.sums(logs))], names=["id", "train", "row_key", "score"])

    return docs.mapInArrow(score, _scored(kind))


def _score_by_exchange(d: DataFrame, buckets: int, whole: float, strength: float, kind: T.DataType) -> DataFrame:
    @trimmed
    def offers(table: pa.Table) -> pa.Table:
        tile, t = table.column("tile")[0].as_py(), Tokens(table.column("text"))
        learn = table.column("train").to_numpy()[t.doc]
        parts = [Offer(t.token, buckets, False, learn).rows(tile, np.uint32), Offer(t.pair, buckets, True, learn).rows(tile, np.uint32)]
        return pa.concat_tables(parts).append_column("kind", pa.array([WORD] * parts[0].num_rows + [PAIR] * parts[1].num_rows, pa.int32()))

    @trimmed
    def probe(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys, totals, inverse, at = gathered(table, kind == PAIR, np.uint32)
        if kind == PAIR:
            keys = (U64(bucket) << U64(32)) | keys.astype(np.uint64)
        held = Filter({0: build_segment(keys[totals > 0], totals[totals > 0])}, 1)
        flat = held.level(keys, np.zeros(len(keys), np.int64)).astype(np.uint8)[inverse]
        return pa.table([table.column("tile"), table.column("bucket"), pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()), table.column("kind")], names=["tile", "bucket", "answer", "kind"])

    @trimmed
    def score(table: pa.Table, found: pa.Table) -> pa.Table:
        t = Tokens(table.column("text"))
        kinds = found.column("kind").to_numpy()
        words, pairs = Offer(t.token, buckets, False), Offer(t.pair, buckets, True)
        single = expected(words.read(found.filter(pa.array(kinds == WORD)))[words.inverse].astype(np.int64))
        pair = expected(pairs.read(found.filter(pa.array(kinds == PAIR)))[pairs.inverse].astype(np.int64))
        logs = _token_logs(t, single, pair, float(single[t.token == END][0]), whole, strength)
        return pa.table([table.column("id"), table.column("train"), table.column("row_key"), pa.array(t.sums(logs))], names=["id", "train", "row_key", "score"])

    got = d.groupBy("tile").applyInArrow(offers, OFFERS + ", kind int").groupBy("kind", "bucket").applyInArrow(probe, ANSWERS + ", kind int")
    return d.groupBy("tile").cogroup(got.groupBy("tile")).applyInArrow(score, _scored(kind))
