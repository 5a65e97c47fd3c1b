import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lamina.llm import warc

PAGES = "page_id long, url string, html string"


def pages():
    rows = [(i, f"http://x.test/{i}", f"<p>{i % 7}</p>" * (1 + i % 3)) for i in range(60)]
    return rows + [(100, None, None), (101, "http://x.test/a b\r\nInjected: 1", ""), (102, "http://é.test", "x\r\n\r\nWARC/1.1\r\n" * 5), (103, "u", "é" * 200000), (103, "u", "é" * 200000), (None, "u", "lonely"), (None, "u", None)]


def test_round_trip(spark):
    rows = pages()
    index = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3))
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    top = {}
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top.get(h or "", -1), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        best = top.get(h or "")
        full = best is None or i == best
        want.append((i if i is not None else -1, "response" if full else "revisit", -1 if full else best, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), (h or "") if full else None))
    key = lambda x: tuple(map(str, x))
    assert sorted([(-1 if r["page_id"] is None else r["page_id"], r["record_type"], -1 if r["refers_to"] is None else r["refers_to"], r["payload_bytes"], r["payload_digest"], r["payload"]) for r in got], key=key) == sorted(want, key=key)
    assert all("\r" not in (r["url"] or "") and " " not in (r["url"] or "") for r in got)


def test_archives_are_concatenated_gzip_members(spark):
    index = warc.write_archives(spark.createDataFrame(pages()[:10], PAGES).coalesce(1)).collect()
    fs, path = warc.filesystem(index[0]["file"])
    raw = fs.open_input_file(path).read()
    assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == 11  # and one warcinfo
    r = index[3]
    assert warc.parse(gzip.decompress(raw[r["offset"] : r["offset"] + r["length"]]))["page_id"] == r["page_id"]


def test_selected_records_only_and_short_payloads(spark):
    df = spark.createDataFrame(pages(), PAGES)
    index = warc.write_archives(df, least_bytes=10, file_bytes=2000)
    some = warc.read_records(index.filter(F.col("page_id") % 20 == 0), gap=0, region=500).collect()
    assert sorted(r["page_id"] for r in some) == [0, 20, 40, 100]
    assert all(r["record_type"] == "response" for r in warc.read_records(index).collect() if r["payload_bytes"] < 10)


def test_ranges_are_joined():
    assert warc.joined_ranges([(0, 5), (5, 5), (20, 5), (100, 1)], 10, 1000) == [(0, 25), (100, 101)]
    assert warc.joined_ranges([(0, 5), (5, 5), (10, 5)], 10, 10) == [(0, 10), (10, 15)]


def test_damage_is_noticed_and_empty_tables(spark):
    raw = warc.record(1, "u", b"abc", warc.sha1_base32(b"abc"), None)
    for bad in (raw[:-1], raw.replace(b"abc\r\n", b"abd\r\n"), b"x" + raw):
        with pytest.raises(ValueError):
            warc.parse(bad)
    df = spark.createDataFrame([(1, "u", "h", "x")], PAGES + ", file string")
    assert warc.read_records(warc.write_archives(df.limit(0))).count() == 0
    assert warc.read_records(warc.write_archives(df)).count() == 1
