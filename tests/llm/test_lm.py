import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lamina.llm import lm

from .common import DOCS, corpus, lower, words


def test_filter_never_reads_less_and_seldom_more():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    counts = rng.geometric(0.3, 20000) ** 2
    f = lm.Filter({0: lm.build_segment(keys, counts)}, 2)
    level = f.level(keys, np.zeros(len(keys), np.int64))
    assert (level >= lm.levels(counts)).all() and (level > lm.levels(counts)).mean() < 0.05
    other = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    assert (f.level(other, np.zeros(20000, np.int64)) > 0).mean() < 0.05
    assert not f.level(other, np.ones(20000, np.int64)).any()


def test_levels_are_log_counts():
    assert lm.levels(np.array([0, 1, 2, 3, 4, 7, 8, 1 << 40])).tolist() == [0, 1, 2, 2, 3, 3, 4, 41]
    for q in range(1, 10):
        assert lm.expected(np.array([q]))[0] == np.mean([1 << (q - 1), (1 << q) - 1])


def exact(docs, train, strength):
    """The model's scores with exact counts and with counts read by level."""
    tokens = {i: [lower(x) for x in words(t)] + [None] for i, (_, t) in enumerate(docs)}
    c = Counter(x for i in tokens if train(docs[i][0]) for x in tokens[i])
    pairs = Counter(p for i in tokens if train(docs[i][0]) for p in zip(["<s>"] + tokens[i][:-1], tokens[i]))
    n, v = sum(c.values()), len(c)
    seen = lambda x: float(lm.expected(lm.levels(np.array([x])))[0])
    out = []
    for i, w in tokens.items():
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        score, before = 0.0, "<s>"
        for x in w:
            h = seen(c[None] if before == "<s>" else c[before])
            score += math.log10((min(seen(pairs[before, x]), h) + strength * (seen(c[x]) + 1) / (n + v + 1)) / (h + strength))
            before = x
        out.append((docs[i][0], len(w), sum(c[x] > 0 for x in w), n, base, score))
    return out


def test_scores(spark, monkeypatch):
    monkeypatch.setattr("lamina.llm.lm.buckets_for", lambda n: 4)
    docs = corpus(5) + [(500, "A a  A"), (500, "A a  A"), (None, "b")]
    train = lambda d: d is not None and d % 3 != 0
    df = spark.createDataFrame(docs, DOCS)
    got = lm.score_texts(df, F.col("doc_id") % 3 != 0).collect()
    routed = lm.score_texts(df, F.col("doc_id") % 3 != 0, broadcast_bytes=0).collect()
    assert sorted(map(str, got)) == sorted(map(str, routed))  # the way without a broadcast gives the same scores
    key = lambda x: (str(x[0]), x[1], x[4])
    mine = sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got], key=key)
    want = sorted(exact(docs, train, 64.0), key=key)
    assert len(mine) == len(want)
    near = 0
    for a, b in zip(mine, want):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9)
        near += abs(a[5] - b[5]) < 0.03 * abs(b[5])  # but for false hits of the filter
    assert near > 0.9 * len(want)


def test_no_training_rows_clashes_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, tile string")
    got = lm.score_texts(df, F.lit(False)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got) == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
    assert lm.score_texts(df.limit(0), F.lit(True)).count() == 0
    assert lm.score_texts(df.limit(0), F.lit(True), broadcast_bytes=0).count() == 0
