from collections import Counter

import pytest

from lamina.llm import substrings

from .common import DOCS, corpus, words


def brute(docs, window):
    texts = [words(x) for _, x in docs]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, texts):
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window", [1, 2, 5, 12, 35, 50])
def test_against_brute_force(spark, window):
    docs = corpus(window)
    got = substrings.dedup_substrings(spark.createDataFrame(docs, DOCS), window=window, bucket_bytes=20000)
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got.collect()) == brute(docs, window)


@pytest.mark.parametrize("period", [v for v in substrings.COVERS if v > 1])
def test_covers_have_all_differences(period):
    cover = substrings.COVERS[period]
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_overlapping_repeats_within_one_text(spark):
    docs = [(1, "a " * 50), (2, "b c " * 20), (3, "d")]
    got = substrings.dedup_substrings(spark.createDataFrame(docs, DOCS), window=7).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == brute(docs, 7)


def test_repeated_rows_nulls_clashes_and_empty_tables(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(1, text, 5, None), (1, text, 5, None), (None, None, None, None), (2, "kept  as\nit is", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, tile int")
    got = substrings.dedup_substrings(df, window=35, keep_untouched=True)
    assert got.columns == ["doc_id", "text", "n_words", "tile", "_n_words", "n_removed"]
    assert sorted((r["doc_id"] or 0, r["text"], r["_n_words"], r["n_removed"]) for r in got.collect()) == [(0, "", 0, 0), (1, "", 40, 40), (1, "", 40, 40), (2, "kept  as\nit is", 4, 0)]
    assert substrings.dedup_substrings(df.limit(0)).count() == 0
