from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lamina.llm import mixing, nbsvm
from lamina.llm._spark import materialise

from .common import SF, words
from .test_jaccard import brute as components
from .test_packing import check
from .test_substrings import brute as cut


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), "test")
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
        seen.append((name, docs, out))
        docs = out
    assert [s[0] for s in seen] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing", "packing"]
    pairs = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())

    _, before, after = seen[0]
    model = nbsvm.fit(before, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    column = before.select("doc_id", "text").toArrow().combine_chunks()
    keep = model.scores(column.column("text").chunk(0)) >= 0.3
    assert [p[0] for p in pairs(after)] == sorted(d for d, k in zip(column.column("doc_id").to_pylist(), keep) if k)

    _, before, after = seen[1]
    rows = pairs(before)
    assert pairs(after) == sorted((d, t) for (d, t), (_, _, c) in zip(rows, components(rows, 5, 80)) if c == d)

    _, before, after = seen[2]
    rows = pairs(before)
    assert pairs(after) == sorted((d, t if not gone else left) for (d, t), (_, _, gone, left) in zip(rows, cut(rows, 50)))

    _, before, after = seen[3]
    sizes: dict = {}
    for r in before.collect():
        sizes.setdefault(r["source"], []).append(len(words(r["text"])))
    names = sorted(sizes)
    goal = dict(zip(names, mixing.targets([sum(sizes[s]) for s in names], [1 + i % 3 for i in range(len(names))])))
    for s in names:
        assert abs(sum(len(words(r["text"])) for r in after.filter(after.source == s).collect()) - goal[s]) <= 16 * 40
    source = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["n_chars"] == len(r["text"]) and (r["text"] == source[r["doc_id"]] or " ".join(words(r["text"])) in " ".join(words(source[r["doc_id"]])))

    _, before, after = seen[4]
    check(after.collect(), pairs(before), 2048)
    assert pipeline.ORACLE_SQL is None
    whole = pipeline.run(spark, SF)
    assert whole.count() == after.count() and whole.columns == after.columns


def test_odd_documents(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, row_key long, copies int, predicted string, tile string, size string"
    words_ = " ".join(f"plain{i % 97} word{i}" for i in range(200))
    rows = [(1, words_, "en", "a", 1, 9, 8, "0", "t", "s"), (1, words_, "en", "a", 1, 9, 8, "0", "t", "s"), (2, None, None, None, None, None, None, None, None, None), (3, "", "en", "a", 0, 1, 1, "1", "u", "v"), (4, words_ + " more", "en", None, 5, 1, 1, "1", "u", "v"), (None, "other text here", "de", "b", 5, 1, 1, "1", "u", "v")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, names)
        for name, stage in pipeline.STAGES:
            out = materialise(stage(spark, docs, SF), "odd")
            if name != "packing":
                assert out.columns == docs.columns
                if name == "n-gram Jaccard join" and data:
                    assert out.filter("doc_id in (1, 4)").count() == 1 and out.filter("doc_id in (1, 4)").first()["copies"] == 8
                docs = out
            else:
                assert (out.count() > 0) == bool(data)
