import itertools
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lamina.llm import packing
from lamina.llm.queries import tokenizer_path

from .common import DOCS, corpus


def slow():
    return Tokenizer.from_file(tokenizer_path())


def check(rows, docs, window):
    t = slow()
    ids = defaultdict(list)
    for d, x in docs:
        ids[d].append(np.array(t.encode(x or "", add_special_tokens=False).ids + [1], np.uint32))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, texts in ids.items():
        assert sum(len(x) for x in texts) == sum(r["length"] for r in pieces[d])
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces[d], key=lambda r: r["start"]):
                assert r["start"] == at and r["doc_tokens"] == len(texts[0])
                assert zlib.crc32(texts[0][at : at + r["length"]].tobytes()) == r["ids_crc32"]
                at += r["length"]
    padding = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0
    return len(rows)


def test_all_ids_once_without_padding(spark):
    docs = corpus() + [(900, "x <|endoftext|> y"), (901, "ab" * 6000), (902, " " * 9000)]
    rows = packing.pack(spark.createDataFrame(docs, DOCS).repartition(3), tokenizer_path(), window=256).collect()
    check(rows, docs, 256)


def test_few_cuts(spark):
    docs = [(i, "word " * (1 + 37 * i % 150)) for i in range(400)]
    rows = packing.pack(spark.createDataFrame(docs, DOCS).coalesce(1), tokenizer_path(), window=512).collect()
    assert check(rows, docs, 512) < len(docs) + 20


def test_repeated_rows_null_ids_and_clashing_names(spark):
    docs = [(None, "a b c", 1), (7, "same text", 2), (7, "same text", 3), (8, None, 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, sequence_id int").coalesce(1)
    rows = packing.pack(df, tokenizer_path(), with_ids=True).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows if r["start"] == 0) == [(False, 0), (True, 7), (True, 7), (True, 8)]
    assert all(zlib.crc32(np.array(r["ids"], np.uint32).tobytes()) == r["ids_crc32"] for r in rows)
    assert packing.pack(df.limit(0), tokenizer_path()).count() == 0


@given(st.lists(st.integers(1, 40), max_size=9), st.integers(1, 90))
@settings(max_examples=200, deadline=None)
def test_fill_is_the_best_subset(items, room):
    counts = {n: items.count(n) for n in set(items)}
    used = packing.fill(sorted(counts), counts, room)
    assert all(0 < n <= counts[size] for size, n in used.items())
    best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
    assert sum(size * n for size, n in used.items()) == best


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_fast_encoder_is_the_tokenizer(text):
    e = packing.encoder(tokenizer_path())
    assert e.fast is not None
    assert e.fast.encode_ordinary(text) == slow_ids(text)


def test_special_strings():
    text = "hello <|endoftext|> x"
    assert packing.encoder(tokenizer_path()).ids(text).tolist() == slow_ids(text) and 50256 in slow_ids(text)
    plain = packing.encoder(tokenizer_path(), True).ids(text).tolist()
    assert 50256 not in plain and slow().decode(plain) == text


_SLOW = []


def slow_ids(text):
    if not _SLOW:
        _SLOW.append(slow())
    return _SLOW[0].encode(text, add_special_tokens=False).ids
