import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lamina.llm import nbsvm
from lamina.llm.queries import QUERIES

from .common import DOCS, SF, corpus
from .test_cascade import brute as measures


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = QUERIES["op9_nb_svm"](spark, sf).filter("held_out").join(labels, "doc_id").collect()
    right = {y: [r["predicted"] == y for r in got if r["quality"] == y] for y in (0, 1)}
    assert len(got) > 500 and np.mean(right[0]) > 0.95 and np.mean(right[1]) > 0.99
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_descent_is_the_hinge_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(12, 4, replace=False)).astype(np.int32) for _ in range(60)]
    label = np.array([int(0 in x or 1 in x) for x in rows])
    scale = np.ones(nbsvm.FEATURES)
    w, bias = nbsvm.hinge_descent(rows, scale, label, np.full(60, 1.0), rounds=400)

    def loss(w, b):
        margin = np.array([w[x].sum() / 2 + b for x in rows]) * np.where(label > 0, 1, -1)
        return (w @ w + b * b) / 2 + np.maximum(1 - margin, 0).sum()

    best = loss(w, bias)
    for _ in range(300):
        step = np.zeros_like(w)
        step[:12] = rng.normal(0, 0.02, 12)
        assert loss(w + step, bias + rng.normal(0, 0.02)) >= best - 1e-3


def test_ratio_and_calibration():
    rows, label = [np.array([0, 1]), np.array([1]), np.array([1, 2])], np.array([1, 1, 0])
    ratio = nbsvm.log_count_ratio(rows, label)
    assert ratio[0] > 0 > ratio[2]
    slope, offset = nbsvm.calibrate(np.array([-2.0, -1, 1, 2] * 20), np.array([0, 0, 1, 1] * 20), np.ones(80))
    assert slope > 0 and abs(offset) < 0.1


def test_equal_texts_score_alike_and_odd_rows_pass(spark):
    docs = [(i, "clean plain words here " * 5 if i % 2 else "bad$$$ bad### " * 9, "x") for i in range(40)] + [(100, None, "y"), (101, "", "y"), (None, "é", "z"), (100, "w " * 60000, "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (None, 0), (2, None), (999, 1)], "doc_id long, quality int")
    model = nbsvm.fit(df, labels, F.lit(True))
    out = nbsvm.classify(df, model)
    assert out.columns == ["doc_id", "text", "score", "_score", "predicted"]
    got = out.collect()
    assert len(got) == len(docs) and len({r["_score"] for r in got if r["text"] in (None, "")}) == 1
    assert all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 40)
    assert nbsvm.classify(df.limit(0), model).count() == 0


def test_without_two_classes_the_prior_is_the_score(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for rows, want in (([], 0.5), ([(1, 1), (2, 1)], 0.75)):
        model = nbsvm.fit(df, spark.createDataFrame(rows, "doc_id long, quality int"), F.lit(True))
        assert [round(r["score"], 6) for r in nbsvm.classify(df, model).collect()] == [want, want]


def slow_indicators(text):
    """The numbers of a text's indicators, one by one."""
    raw = (text or "").encode()
    out = {65536 + b for b in raw}
    out |= {(((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1) & 0xFFFFFFFF) >> 16 for i in range(len(raw) - 2)}
    n, _, _, dup, repeat, lines, stutters, *_ = measures(text)
    for k, (part, whole) in enumerate(((stutters, n), (dup, lines), (repeat, n))):
        step = min(max(math.floor(math.log2(part / whole)) + 16, 1), 15) if part else 0
        out.add(65536 + 256 + 16 * k + step)
    return out


def test_against_a_plain_version(spark):
    """Indicators, ratios and margins, each from its definition."""
    texts = [t for _, t in corpus(6, 40)] + ["la la la " * 30, "same\n" * 9, "é\U0001f600" * 50]
    fast = []
    for _, flags in nbsvm.indicators(pa.array(texts, pa.string())):
        fast += [nbsvm.numbers(nbsvm.stored(f)) for f in flags]
    slow = [slow_indicators(t) for t in texts]
    assert [set(f.tolist()) for f in fast] == slow
    label = np.array([i % 3 != 0 for i in range(len(texts))], np.int64)
    counts = [[1 + sum(j in s for s, y in zip(slow, label) if y == c) for j in range(nbsvm.FEATURES)] for c in (0, 1)]
    scale = [math.log((b / sum(counts[1])) / (a / sum(counts[0]))) for a, b in zip(*counts)]
    assert np.allclose(nbsvm.log_count_ratio(fast, label), scale)
    w, bias = nbsvm.hinge_descent(fast, np.array(scale), label, np.ones(len(texts)), rounds=300)
    margins = [sum(w[j] * scale[j] for j in s) / math.sqrt(sum(scale[j] ** 2 for j in s)) + bias for s in slow]
    model = nbsvm.Model(w, bias, np.array(scale), 2.0, -0.5)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in nbsvm.classify(df, model).collect()}
    for i, m in enumerate(margins):
        want = 1 / (1 + math.exp(-(2 * m - 0.5)))
        assert abs(got[i][0] - want) < 1e-4 and (got[i][1] == (want >= 0.3) or abs(want - 0.3) < 1e-4)
