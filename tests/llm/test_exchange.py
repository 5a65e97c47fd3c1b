import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.llm import _exchange, jaccard, lm, substrings

from .common import DOCS, corpus
from .test_jaccard import brute as components
from .test_lm import exact
from .test_substrings import brute as cut


def test_rows_grow_with_the_input():
    """Tiles times buckets, the most rows that tiles can send, for each GB of input; up to 16 TB no more than at 64 GB."""
    per_gb = lambda n: _exchange.tiles_for(n) * _exchange.buckets_for(n) / (n >> 30)
    assert [per_gb(1 << k) <= 1.01 * per_gb(64 << 30) for k in range(30, 45)] == [True] * 15
    keys = (32 << 20) / 6 / _exchange.buckets_for(100 << 40)
    assert keys > 10  # a row still holds several keys at 100 TB


def test_totals_above_32_bits():
    """Two tiles, each with 3e9 of one key, and one of another."""
    tiles = [_exchange.Offer(np.array([5, 9 << 40], np.uint64), 1, False, np.array([3e9, n])) for n in (1, 0)]
    sent = pa.concat_tables([t.rows(i, np.uint32) for i, t in enumerate(tiles)])
    got = _exchange.answered(sent, False, np.uint32, wide=True)
    for i, t in enumerate(tiles):
        assert t.read(got.filter(pa.array(got.column("tile").to_numpy() == i)), np.uint32).tolist() == [6_000_000_000, 1]
    assert lm.levels(np.array([6_000_000_000])).tolist() == [33]


def test_bytes_keep_the_order_of_totals():
    totals = np.unique(np.concatenate([np.arange(1000), np.geomspace(1000, 1e9, 5000).astype(np.int64)]))
    coded = _exchange.as_byte(totals).astype(int)
    assert (np.diff(coded) >= 0).all() and coded[:193].tolist() == list(range(193)) and coded[193] == 193 and coded[-1] == 255


@pytest.fixture
def small_tiles(monkeypatch):
    """Tiles of 2000 bytes; gives the most rows of any tile."""
    sizes, real = [], _exchange.tiled

    def tiled(df, name, *_):
        d, total = real(df, name, 2000)
        sizes.append(max(r["count"] for r in d.groupBy(name).count().collect()))
        return d, total

    for module in (substrings, jaccard, lm):
        monkeypatch.setattr(module, "tiled", tiled)
        monkeypatch.setattr(module, "buckets_for", lambda n, *_: 3)
    return sizes


def test_a_row_repeated_beyond_a_tile(spark, small_tiles):
    """400 equal rows, and 400 rows without text, are dealt to many tiles; results are those of brute force."""
    same = " ".join(f"r{i}" for i in range(40))
    docs = corpus(4, 12)[:-1] + [(900, same)] * 400 + [(901, None)] * 400
    df = spark.createDataFrame(docs, DOCS)
    got = substrings.dedup_substrings(df).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in got) == sorted(cut(docs, 35))
    got = jaccard.jaccard_components(df).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(components(docs, 3, 90))
    got = lm.score_texts(df, F.col("doc_id") % 3 != 0).collect()
    want = sorted(exact(docs, lambda d: d % 3 != 0, 64.0))
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [w[:4] for w in want]
    assert np.allclose(sorted(r["base_score"] for r in got), sorted(w[4] for w in want))
    assert len(small_tiles) == 3 and max(small_tiles) < 300
